"""Snapshots, trailing windows, validity intervals and versioned dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Buckets over which facts after the last change of a dimension are dealt.
OPEN_PARTS = 16


def latest_value(df: DataFrame, column: str) -> Column:
    """``max(column)`` as a scalar subquery: no driver round trip and no join."""
    return df.agg(F.max(column)).scalar()


def at_latest(df: DataFrame, date_col: str) -> DataFrame:
    """Rows of the newest snapshot."""
    return df.filter(F.col(date_col) == latest_value(df, date_col))


def trailing(
    df: DataFrame, date_col: str, days: int, anchor: Column | None = None, inclusive_extra_day: bool = True
) -> DataFrame:
    """Rows dated within ``days`` of the anchor (newest date by default).

    The bound itself is kept, so ``days`` = 14 covers 15 dates; switch that off with
    ``inclusive_extra_day=False``.
    """
    anchor = latest_value(df, date_col) if anchor is None else anchor
    back = days if inclusive_extra_day else days - 1
    return df.filter(F.col(date_col) >= F.date_sub(anchor, back))


def interval_join(
    fact: DataFrame, dim: DataFrame, keys: Sequence[str], at: str, start: str, end: str
) -> DataFrame:
    """Match each fact to the dimension row in force at ``at``.

    Intervals are half-open; a NULL end is still in force. Equality keys drive the join and
    the range is its residual, so a small dimension is broadcast by measured size and a
    large one is shuffled on the keys.
    """
    f, d = fact.alias("f"), dim.alias("d")
    moment = F.col(f"f.{at}")
    in_force = (moment >= F.col(f"d.{start}")) & (F.col(f"d.{end}").isNull() | (moment < F.col(f"d.{end}")))
    for key in keys:
        in_force = in_force & (F.col(f"f.{key}") == F.col(f"d.{key}"))
    kept = [F.col(f"d.{c}") for c in dim.columns if c not in keys]
    return f.join(d, in_force).select("f.*", *kept)


def interval_join_bucketed(
    fact: DataFrame, dim: DataFrame, keys: Sequence[str], at: str, start: str, end: str, bucket_days: int
) -> DataFrame:
    """:func:`interval_join` for a dimension too large to broadcast or a hot key.

    Time is cut into buckets that join the equality keys: a key holding a large share of the
    facts spreads over its buckets, and a fact only meets the intervals of its own bucket.
    Facts from the dimension's last change on, where intervals are open, are dealt over
    ``OPEN_PARTS`` further buckets by their moment. Only the dimension is looked through for that.
    """
    width = bucket_days * 86_400

    def bucket(moment: Column) -> Column:
        return F.floor(F.unix_seconds(moment.cast("timestamp")) / width).cast("bigint")

    final = dim.agg(F.max(F.greatest(bucket(F.col(start)), bucket(F.col(end))))).scalar()
    top = final + OPEN_PARTS - 1
    ended = bucket(F.col(end))
    first = F.least(final, bucket(F.col(start)))
    last = F.when(ended < final, ended).otherwise(top)
    cut = dim.withColumn("_bucket", F.explode(F.sequence(first, last)))
    own = bucket(F.col(at))
    dealt = final + F.pmod(F.xxhash64(at), F.lit(OPEN_PARTS))
    placed = fact.withColumn("_bucket", F.when(own < final, own).otherwise(dealt))
    return interval_join(placed, cut, [*keys, "_bucket"], at, start, end).drop("_bucket")


def asof_join(
    fact: DataFrame, dim: DataFrame, keys: Sequence[str], at: str, start: str, end: str, range_days: int, parts: int = 8
) -> DataFrame:
    """:func:`interval_join` for intervals of a key that do not overlap, whatever their length.

    Facts and the starts of intervals stand in one stream, sorted by moment within a key and a range of time, and a
    fact takes the last start before it. What is in force when a range begins is carried in as a start of its own,
    found from the dimension and the ranges that hold facts, so an interval of many years costs one row for each
    range with facts, not one for each range it covers. A key holding a large share of the facts spreads over its
    ranges, and those of one range over ``parts``. Equal moments: an interval holds from its start on. Facts
    without a key or a moment match nothing.
    """
    width = range_days * 86_400
    kept = [c for c in dim.columns if c not in keys]
    names = [f"_key{k}" for k in range(len(keys))]
    reach = lambda moment: F.floor(F.unix_seconds(moment.cast("timestamp")) / width).cast("bigint")
    by = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    every = reduce(and_, [F.col(c).isNotNull() for c in (*keys, at)])
    facts = fact.filter(every).select(*by, reach(F.col(at)).alias("_range"), F.col(at).cast("timestamp").alias("_at"), F.struct(*fact.columns).alias("_fact"))
    opened = reduce(and_, [F.col(c).isNotNull() for c in (*keys, start)])
    begins = dim.filter(opened).select(
        *by, reach(F.col(start)).alias("_range"), F.col(start).cast("timestamp").alias("_at"), F.struct(start, *[c for c in kept if c != start]).alias("_dim")
    )
    ended = F.col("_dim")[end]
    # Ranges that hold facts get the last interval that began in a range before.
    asked = facts.select(*names, "_range").distinct().withColumn("_dim", F.lit(None).cast(begins.schema["_dim"].dataType))
    lasting = begins.groupBy(*names, "_range").agg(F.max_by("_dim", F.struct("_at", ended.isNull(), ended)).alias("_dim"))
    before = Window.partitionBy(*names).orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)
    grid = asked.withColumn("_asked", F.lit(True)).unionByName(lasting.withColumn("_asked", F.lit(False)))
    carried = grid.withColumn("_carry", F.last("_dim", ignorenulls=True).over(before)).filter("_asked AND _carry IS NOT NULL")
    starts = begins.unionByName(carried.select(*names, "_range", F.lit(None).cast("timestamp").alias("_at"), F.col("_carry").alias("_dim")))

    plain = [F.col(f"_fact.{f.name}") for f in fact.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    dealt = facts.withColumn("_part", F.pmod(F.xxhash64(*plain), F.lit(parts)))
    copied = starts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    both = dealt.unionByName(copied, allowMissingColumns=True)
    stream = Window.partitionBy(*names, "_range", "_part").orderBy(F.asc_nulls_first("_at"), "_is_fact", F.asc_nulls_last(ended))
    held = both.withColumn("_is_fact", F.col("_fact").isNotNull()).withColumn("_in_force", F.last("_dim", ignorenulls=True).over(stream))
    matched = held.filter(F.col("_fact").isNotNull() & F.col("_in_force").isNotNull())
    until = F.col("_in_force")[end]
    return matched.filter(until.isNull() | (F.col("_fact")[at] < until)).select("_fact.*", *[F.col("_in_force")[c].alias(c) for c in kept])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key.

    ``max_by`` aggregates on the map side, so a key with very many versions reaches the
    shuffle as one row per task; a window would sort all of them in one.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def dedupe_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per business key, keeping the newest by ``order``."""
    return latest_per_key(df, keys, order)


def flag_known(df: DataFrame, known: DataFrame, on: str, flag: str = "_sku_known") -> DataFrame:
    """Mark rows whose key exists in ``known``; NULL flag otherwise. Row count never changes."""
    return df.join(known.select(on).distinct().withColumn(flag, F.lit(True)), on, "left")


def fanout(fact: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What an inner join on ``keys`` would do to the fact rows, without running it.

    Both sides are counted per key first; the join then multiplies counts, not rows.
    """
    left = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("_facts"))
    right = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_versions"))
    return (
        left.join(right, list(keys), "left")
        .agg(
            F.sum("_facts").alias("rows_in"),
            F.coalesce(F.sum(F.col("_facts") * F.col("_versions")), F.lit(0)).alias("rows_out"),
            F.coalesce(F.max("_versions"), F.lit(0)).alias("max_versions"),
        )
    )


def assert_no_fanout(fact: DataFrame, dim: DataFrame, keys: Sequence[str]) -> None:
    """Refuse a join whose dimension has several rows for a key the facts use."""
    versions = fanout(fact, dim, keys).first()["max_versions"]
    if versions > 1:
        raise ValueError(f"joining on {list(keys)} would repeat rows: up to {versions} versions per key")
