"""Temperature mixing of sources, realised as budgeted permutations of blocks; column functions only.

A source with the share p of all tokens gets the weight p^a / sum of p^a. The exponent a in [0, 1]
is bisected on a grid of millionths: the flattest mix whose most repeated source is repeated at
most ``repeat_limit`` times as often as the least repeated one, and no flatter than
``target_entropy`` (nats) if that is given. Several interior points are tried at once, so a few small
aggregates over the per-source sums settle it and the driver sees one row each time.

With the default budget every source is used once in full at least. A source's quota is met by whole
passes and one partial pass over its documents in a permuted order: blocks in the order of a digest
of (seed, pass, block), then sub-blocks, then documents. The cut is found level by level, so a window
holds 4,096 rows of a source, not all its documents.

Defined results: a null source is a source of its own; null or empty texts have no tokens, belong to
every pass and use no budget; a source without tokens is passed once; repeated rows are drawn apart;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvedge.llm.quality_rules import words_of
from selvedge.session import stage

GRID = 1_000_000
FAN = 64
SALTS = 32


def token_counts(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, source, n_tokens: words between white space."""
    return docs.select(
        F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"),
        F.size(words_of(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("n_tokens"),
    )


def source_sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def bisect_exponent(sums: DataFrame, repeat_limit: float, target_entropy: float | None = None) -> int:
    """The exponent in millionths. Both measures fall or rise with it, so one bracket suffices."""
    used = sums.filter("tokens > 0")
    least, most, total = used.agg(F.min("tokens"), F.max("tokens"), F.sum("tokens")).first()
    if not total or least == most:
        return GRID
    shares = used.select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def flattest(points: list[int]) -> list[tuple[int, float, float]]:
        tried = shares.select(F.explode(F.array(*[F.lit(x) for x in points])).alias("a"), "p")
        powers = tried.select("a", F.pow("p", F.col("a") / F.lit(float(GRID))).alias("q"))
        rows = powers.groupBy("a").agg(
            F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("qlogq")
        )
        entropy = F.log("z") - F.col("qlogq") / F.col("z")
        ratio = F.pow(F.lit(most / least), 1 - F.col("a") / F.lit(float(GRID)))
        return [tuple(r) for r in rows.select("a", ratio, entropy).collect()]  # FAN rows at most

    def bracket(meets) -> int:
        """The smallest grid point that meets a condition which holds from some point on."""
        low, high = -1, GRID
        while high - low > 1:
            step = max(1, (high - low) // FAN)
            points = list(range(low + step, high, step))[:FAN]
            held = {a: meets(r, h) for a, r, h in flattest(points)}
            good = [a for a in points if held[a]]
            bad = [a for a in points if not held[a]]
            high = min(good, default=high)
            low = max((a for a in bad if a < high), default=low)
        return high

    exponent = bracket(lambda ratio, entropy: ratio <= repeat_limit)
    if target_entropy is not None:
        # The largest exponent whose entropy is still the target or more.
        falling = bracket(lambda ratio, entropy: entropy < target_entropy)
        exponent = max(exponent, max(falling - 1, 0))
    return exponent


def quotas(sums: DataFrame, exponent: int, budget: int | None = None) -> DataFrame:
    """Per source: weight, token quota, whole passes and tokens left for a partial one."""
    a = exponent / GRID
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a))).otherwise(F.lit(0.0))
    powers = sums.withColumn("power", power)
    whole = powers.agg(
        F.sum("power").alias("z"), F.max(F.when(F.col("power") > 0, F.col("tokens") / F.col("power"))).alias("scale")
    )
    z, scale = whole.first()
    z, scale = z or 1.0, (scale or 1.0) if budget is None else float(budget) / (z or 1.0)
    quota = F.round(F.col("power") * F.lit(scale), 0).cast("long")
    return (
        powers.withColumn("weight", F.col("power") / F.lit(z))
        .withColumn("quota", quota)
        .withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)))
        .withColumn("passes", F.col("passes").cast("long"))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("passes") * F.col("tokens")).otherwise(F.lit(0)))
        .select("source", "tokens", "weight", "quota", "passes", "rest")
    )


def _digest(seed: int, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p if isinstance(p, Column) else F.col(p).cast("string") for p in parts]))


def _cut(rows: DataFrame, keys: list[str], order: list[str], limit: str) -> DataFrame:
    """Running tokens within ``keys``; ``before`` is what precedes a row."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("n_tokens").over(window)
    return rows.withColumn("before", upto - F.col("n_tokens")).withColumn("left", F.col(limit) - F.col("before"))


def realise(counts: DataFrame, quota: DataFrame, seed: int = 7) -> DataFrame:
    """(key, source, pass, n_tokens, block, place): sorting by ``place`` gives the training order."""
    rows = counts.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    spread = quota.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    same = rows["source"].eqNullSafe(spread["source"]) & (rows["salt"] == spread["salt"])
    drawn = rows.join(spread, same).select(
        rows["key"], rows["source"], "n_tokens", "passes", "rest", _digest(seed, F.coalesce(F.col("key").cast("string"), F.lit(""))).alias("d")
    )
    drawn = stage(drawn.withColumn("block", F.substring("d", 1, 3)).withColumn("sub", F.substring("d", 4, 3)), "draw")
    full = drawn.filter("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))))
    last = (
        drawn.filter("rest > 0 OR n_tokens = 0 AND passes = 0")
        .withColumn("pass", F.col("passes") + 1)
        .withColumn("b1", _digest(seed, "pass", "block"))
        .withColumn("b2", _digest(seed, "pass", "block", "sub"))
        .withColumn("b3", _digest(seed, "pass", "d"))
    )
    # Level 1: blocks of a source; the block that crosses the rest is opened, the ones before are taken.
    level1 = last.groupBy("source", "rest", "b1").agg(F.sum("n_tokens").alias("n_tokens"))
    level1 = _cut(level1, ["source"], ["b1"], "rest").select(
        F.col("source").alias("s1"), F.col("b1").alias("k1"), F.col("left").alias("left1"), (F.col("left") >= F.col("n_tokens")).alias("whole1")
    ).filter("left1 > 0")
    taken1 = last.join(level1, last["source"].eqNullSafe(F.col("s1")) & (F.col("b1") == F.col("k1")))
    open1 = taken1.filter("NOT whole1")
    level2 = open1.groupBy("source", "left1", "b1", "b2").agg(F.sum("n_tokens").alias("n_tokens"))
    level2 = _cut(level2, ["source", "b1"], ["b2"], "left1").select(
        F.col("source").alias("s2"), F.col("b2").alias("k2"), F.col("left").alias("left2"), (F.col("left") >= F.col("n_tokens")).alias("whole2")
    ).filter("left2 > 0")
    taken2 = open1.join(level2, open1["source"].eqNullSafe(F.col("s2")) & (F.col("b2") == F.col("k2")))
    open2 = _cut(taken2.filter("NOT whole2"), ["source", "b2"], ["b3", "key", "n_tokens"], "left2")
    columns = ["key", "source", "pass", "n_tokens", "block", "sub", "d"]
    parts = [
        full.select(columns),
        taken1.filter("whole1").select(columns),
        taken2.filter("whole2").select(columns),
        open2.filter("left >= n_tokens").select(columns),
    ]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    place = F.concat(_digest(seed, "pass", "block"), _digest(seed, "pass", "d"))
    return chosen.select("key", "source", "pass", "n_tokens", F.conv("block", 16, 10).cast("long").alias("block"), place.alias("place"))


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    repeat_limit: float = 3.0,
    target_entropy: float | None = None,
    budget: int | None = None,
    seed: int = 7,
) -> DataFrame:
    counts = stage(token_counts(docs, key, source, text), "mix")
    sums = stage(source_sums(counts), "sources")
    plan = stage(quotas(sums, bisect_exponent(sums, repeat_limit, target_entropy), budget), "quotas")
    return realise(counts, plan, seed).withColumnRenamed("key", key)
