"""Exact copies, batch by batch: binary fuse filters of earlier snapshots, exact buckets, comparison of bytes.

1. Each row's text is stripped of white space and digested; rows are dealt into batches, as if they came one batch
   after another.
2. The copies inside a new batch are grouped by digest first, combined before the shuffle: one entry a digest, so
   a text that a third of all rows hold is one entry of a batch.
3. A batch that has been grouped is a snapshot and never changes. Its digests are dealt into shards of bounded size
   and a static binary fuse filter is built of each. The entries of the next batch are screened by the filters of
   all snapshots before it; what no filter knows is new, and only what one may know is joined with that snapshot's
   bucket of the digest.
4. Texts are compared byte by byte by grouping them whole, within each task first; what is left is joined with the
   buckets of all digests that are held more than once, and a bucket must have one text. One with unlike texts (equal
   digests of unlike texts) is grouped again by whole texts.

Filters are never sent to all tasks: a shard of digests meets the same shard's filter. The driver sees counts only.

Defined results: texts are equal when identical without space, tab, LF, VT, FF and CR; null counts as empty, and all
empty texts are one group. Of a group the row with the most code points in its original text stays, then that with the
least key; a null key comes last, and of rows alike in all of that an arbitrary one stays. Very long texts are
compared whole; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvedge.llm import fuse
from selvedge.session import stage

BATCHES = 4
SHARD = 500_000  # digests in a filter, and about as many that it is asked for at a time
SPACES = "[\\x20\\x09-\\x0D]+"


class Snapshot(NamedTuple):
    number: int
    entries: DataFrame  # digest, rows, best
    filters: DataFrame  # snapshot, shard, seed, length, segments, body
    count: int
    shards: int


def bare(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def _digest(stripped: Column, chars: int) -> Column:
    return F.substring(F.sha2(stripped, 256), 1, chars)


def digest_rows(docs: DataFrame, key: str, text: str, batches: int, chars: int) -> DataFrame:
    """row, id, size, sha256, digest, batch per row; written to the shared folder without the texts."""
    rows = docs.select(
        F.col(key).alias("id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("size"),
        F.sha2(bare(text), 256).alias("sha256"),
        F.monotonically_increasing_id().alias("row"),
    )
    named = rows.withColumn("digest", F.substring("sha256", 1, chars))
    return stage(named.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")), "digests")


def _order() -> Column:
    """Rows in the order in which they would stay, as a struct."""
    return F.struct((-F.col("size")).alias("short"), F.col("id").isNull().alias("unnamed"), "id", "row")


def _shard(shards: int | Column) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards) if isinstance(shards, int) else shards).cast("int")


def take_snapshot(rows: DataFrame, number: int, label: str = "snapshot") -> Snapshot:
    """A batch's digests once each, and their filters; both are written and never change."""
    entries = stage(
        rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min(_order()).alias("best")), f"{label}-{number}"
    )
    count = entries.count()
    shards = max(1, math.ceil(count / SHARD))

    def build(table: pa.Table) -> pa.Table:
        made = fuse.build(np.unique(table["word"].to_numpy()).view(np.uint64))
        return pa.table(
            {
                "shard": table["shard"].slice(0, 1),
                "seed": pa.array([made.seed], pa.int64()),
                "length": pa.array([made.length], pa.int64()),
                "segments": pa.array([made.segments], pa.int64()),
                "body": pa.array([made.table.tobytes()], pa.binary()),
            }
        )

    words = entries.select(_shard(shards).alias("shard"), F.xxhash64("digest").alias("word"))
    filters = words.groupBy("shard").applyInArrow(build, "shard int, seed bigint, length bigint, segments bigint, body binary")
    return Snapshot(number, entries, stage(filters.withColumn("snapshot", F.lit(number)), f"fuse-{number}"), count, shards)


def screen(incoming: DataFrame, count: int, snapshots: list[Snapshot]) -> DataFrame:
    """(snapshot, digest): the incoming digests that a snapshot's filter may know."""
    schema = "snapshot int, digest string"

    def ask(keys: pa.Table, filters: pa.Table) -> pa.Table:
        if not len(filters) or not len(keys):
            return keys.select(["snapshot", "digest"]).slice(0, 0)
        body = filters["body"][0].as_buffer()
        made = fuse.Fuse(*(filters[c][0].as_py() for c in ("seed", "length", "segments")), np.frombuffer(body, dtype=np.uint8))
        known = fuse.holds(made, keys["word"].to_numpy().view(np.uint64))
        return keys.select(["snapshot", "digest"]).filter(pa.array(known))

    asked, filters = [], []
    for s in snapshots:
        parts = max(1, math.ceil(count / (SHARD * s.shards)))  # a large batch asks a small snapshot in parts
        asked.append(
            incoming.select(
                F.lit(s.number).alias("snapshot"),
                _shard(s.shards).alias("shard"),
                F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(parts)).cast("int").alias("part"),
                F.xxhash64("digest").alias("word"),
                "digest",
            )
        )
        given = [F.col(c).alias(c) for c in ("snapshot", "shard", "seed", "length", "segments", "body")]
        filters.append(s.filters.select(*given, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")))
    by = ["snapshot", "shard", "part"]
    keys, known = reduce(DataFrame.unionByName, asked), reduce(DataFrame.unionByName, filters)
    return keys.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(ask, schema)


def known_digests(snapshots: list[Snapshot], fresh: Snapshot) -> DataFrame:
    """Digests of a new batch that an earlier snapshot holds: screened, then joined with its bucket."""
    maybe = screen(fresh.entries.select("digest"), fresh.count, snapshots)
    buckets = reduce(
        DataFrame.unionByName, [s.entries.select(F.lit(s.number).alias("snapshot"), "digest") for s in snapshots]
    )
    return maybe.join(buckets, ["snapshot", "digest"], "left_semi").select("digest").distinct()


def _totals(entries: DataFrame, by: list[str]) -> DataFrame:
    return entries.groupBy(*by).agg(F.sum("rows").alias("rows"), F.min("best").alias("best"))


def _answer(rows: DataFrame, totals: DataFrame, by: list[str], key: str) -> DataFrame:
    """Every row with the row of its group that stays; a row without a group is one of its own."""
    found = rows.join(totals.select(*by, "rows", "best"), by, "left")
    alone = F.col("rows").isNull()
    return found.select(
        F.col("id").alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, digest_chars: int = 64
) -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 per row. Fewer ``digest_chars`` only mean more texts to compare."""
    rows = digest_rows(docs, key, text, batches, digest_chars)
    snapshots: list[Snapshot] = []
    seen: list[DataFrame] = []
    for number in range(batches):
        fresh = take_snapshot(rows.filter(F.col("batch") == number), number)
        if not fresh.count:
            continue
        if snapshots:
            seen.append(known_digests(snapshots, fresh))
        snapshots.append(fresh)
    if not snapshots:
        return _answer(rows, rows.select("digest", F.lit(0).alias("rows"), _order().alias("best")), ["digest"], key)
    entries = reduce(DataFrame.unionByName, [s.entries for s in snapshots])
    repeated = reduce(DataFrame.unionByName, [entries.filter("rows > 1").select("digest"), *seen]).distinct()
    totals = stage(_totals(entries.join(stage(repeated, "repeated"), "digest", "left_semi"), ["digest"]), "groups")

    stripped = bare(text)
    texts = docs.select(_digest(stripped, digest_chars).alias("digest"), stripped.alias("bare"))
    # Equal texts meet as wholes, and within a task before they travel: a text that many rows hold costs a row a task.
    distinct = texts.groupBy("digest", "bare").agg(F.count(F.lit(1)).alias("rows")).select("digest")
    buckets = distinct.join(totals.select("digest"), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    unlike = stage(buckets.filter("texts > 1").select("digest"), "unlike")
    if unlike.isEmpty():
        return _answer(rows, totals, ["digest"], key)

    # Equal digests of unlike texts: these rows are read again and grouped by their whole texts.
    alike = _answer(rows.join(unlike, "digest", "left_anti"), totals.join(unlike, "digest", "left_anti"), ["digest"], key)
    whole = docs.select(
        F.col(key).alias("id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("size"),
        stripped.alias("bare"),
        F.sha2(stripped, 256).alias("sha256"),
        F.monotonically_increasing_id().alias("row"),
    )
    clash = stage(whole.withColumn("digest", F.substring("sha256", 1, digest_chars)).join(unlike, "digest", "left_semi"), "clash")
    by = ["digest", "bare"]
    regrouped = clash.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min(_order()).alias("best"))
    return alike.unionByName(_answer(clash, regrouped, by, key))
