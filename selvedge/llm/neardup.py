"""Near copies by MinHash: universal hash minima, banding, signature and full-set verification, components.

1. One pass over the texts gives each document the size and a 128-bit fingerprint of its set of
   word shingles, a signature of minima under many universal hashes, and a hash for each band of it.
2. Documents with equal sets form a class, represented by its smallest id; only classes go on.
3. Classes that share a band are tied to the least class of that bucket, and the components of these
   ties bound where links can be: no link leaves one. A component is a work group; one of very many
   classes is worked bucket by bucket instead. Groups are dealt into blocks of bounded classes and
   shingles, and every pair of blocks is compared in a task of its own, so all pairs of a group are
   compared and none is emitted: a task compares signatures first, then the full sets of those that
   can reach the similarity, and returns a spanning forest of the links it found.
4. Components of the links by alternating large-star and small-star name each group by its least id.

A pair at the similarity shares no band with a chance of 1e-5 at most (see ``bands_for``), and a signature
estimates it lower by ``SLACK`` with a chance below 1e-6; every link reported is confirmed on full sets.

Defined results: words are runs of anything but space, tab, LF, VT, FF, CR, lower-cased for A-Z; a text with
fewer words than a shingle has one shingle, of all of them; null or empty text has no shingles and is
linked with nothing. Rows with the same id are one document; a null id is never a representative but of a
class that has only null ids. Very long texts are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvedge.llm.components import connected_components
from selvedge.llm.words import chunks, hash_words, mix, shingles
from selvedge.session import stage

HASHES = 128
SLACK = 0.2
MISS = 1e-5
# A block of a work group holds about this many classes and shingles; a task holds two blocks.
BLOCK_CLASSES, BLOCK_SHINGLES = 1_000, 1_500_000
# A component of more classes is worked by bucket.
GROUP_CLASSES = 20_000
COLUMNS = 2_048


def bands_for(similarity: float, hashes: int = HASHES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most rows a band at which a pair of this similarity is missed by ``miss`` at most."""
    for rows in range(16, 0, -1):
        bands = hashes // rows
        if (1 - similarity**rows) ** bands <= miss:
            return bands, rows
    return hashes, 1


def _multipliers(hashes: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    a = random.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, random.integers(0, 1 << 63, hashes, dtype=np.uint64)


def signatures(values: np.ndarray, offsets: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Minima of each text's shingles under universal (multiply-add-shift) hashes; 0 without shingles."""
    a, b = _multipliers(hashes)
    full = np.flatnonzero(np.diff(offsets))
    minima = np.zeros((len(offsets) - 1, hashes), dtype=np.uint32)
    if len(full):
        starts = offsets[full]
        for k in range(hashes):
            minima[full, k] = np.minimum.reduceat(((values * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return minima


def _band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(minima), bands), dtype=np.uint64)
    for k in range(bands):
        key = np.full(len(minima), k + 1, dtype=np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, k * rows + r])
        keys[:, k] = key
    return keys.view(np.int64)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For runs of texts: all shingles, their offsets and each text's distinct ones."""
    for _, _, data, at in chunks(column):
        values, offsets = shingles(*hash_words(data, at), size)
        yield values, offsets, [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def features(docs: DataFrame, key: str, text: str, similarity: float, size: int) -> DataFrame:
    """id, n (set size), f1, f2 (fingerprint) and bands per row; written to the shared folder."""
    bands, rows = bands_for(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for values, offsets, sets in _sets(batch.column(1), size):
                minima = signatures(values, offsets)
                keys = _band_keys(minima, bands, rows)
                prints = np.array(
                    [(int(s.sum(dtype=np.uint64)), int(mix(s + np.uint64(77)).sum(dtype=np.uint64))) for s in sets],
                    dtype=np.uint64,
                ).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prints[:, 0].view(np.int64)),
                        pa.array(prints[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())
                        ),
                    ],
                    ["id", "n", "f1", "f2", "bands"],
                )
                low += len(sets)

    rows_in = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>"
    return stage(rows_in.mapInArrow(run, schema), "minhash")


def work_groups(classes: DataFrame) -> DataFrame:
    """(node, part, i, j, side): the block pairs in which a class is compared; bounded classes and shingles each."""
    members = stage(
        classes.select("node", "n", F.explode("bands").alias("bucket")), "buckets"
    )
    buckets = members.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    shared = members.join(buckets, "bucket")
    ties = shared.filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    bound = connected_components(ties, "candidates")
    bound = bound.unionByName(bound.select(F.col("v").alias("u"), "v").distinct())
    sizes = bound.groupBy("v").agg(F.count(F.lit(1)).alias("size"))
    bound = stage(bound.join(sizes, "v").select(F.col("u").alias("node"), F.col("v").alias("part"), "size"), "bound")
    weights = classes.groupBy("node").agg(F.max("n").alias("n"))
    whole = bound.filter(F.col("size") <= GROUP_CLASSES).join(weights, "node").select("node", "n", F.lit(0).alias("by"), "part")
    split = (
        shared.join(bound.filter(F.col("size") > GROUP_CLASSES).select("node"), "node", "left_semi")
        .select("node", "n", F.lit(1).alias("by"), F.col("bucket").alias("part"))
    )
    rows = whole.unionByName(split)
    need = rows.groupBy("by", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    need = need.select(
        "by", "part", F.greatest(F.ceil(F.col("c") / BLOCK_CLASSES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    dealt = rows.join(need, ["by", "part"]).withColumn("b", F.pmod(F.xxhash64("node", "part"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return stage(
        paired.select(
            "node", "by", "part", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), (F.col("b") > F.col("x")).alias("right")
        ),
        "work",
    )


def _forest(pairs: tuple[np.ndarray, np.ndarray], count: int) -> np.ndarray:
    """The least index each index is connected to."""
    root = np.arange(count)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(*(p.tolist() for p in pairs), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(count)])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, a fixed number of shingles at a time."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, held = np.unique(values, return_inverse=True, return_counts=True)
    common = held > 1
    number = np.cumsum(common) - 1
    keep = common[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        held_by = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        held_by[owner[a:b], column[a:b] - low] = 1
        total += held_by @ held_by.T
    return total.astype(np.int64)


def compare(
    nodes: np.ndarray, right: np.ndarray, cross: bool, minima: np.ndarray, sets: list[np.ndarray], similarity: Fraction
) -> list[tuple[int, int]]:
    """Links of a spanning forest among the pairs of one block, or across two blocks."""
    least = float(similarity) - SLACK
    near_a, near_b = [], []
    for a in range(len(nodes) - 1):
        agree = (minima[a + 1 :] == minima[a]).sum(axis=1) >= least * minima.shape[1]
        if cross:
            agree &= right[a + 1 :] != right[a]
        hit = np.flatnonzero(agree) + a + 1
        near_a.append(np.full(len(hit), a))
        near_b.append(hit)
    pairs = (np.concatenate(near_a), np.concatenate(near_b)) if near_a else (np.zeros(0, int), np.zeros(0, int))
    if not len(pairs[0]):
        return []
    group = _forest(pairs, len(nodes))
    links = []
    order = np.argsort(group[pairs[0]], kind="stable")
    pairs = (pairs[0][order], pairs[1][order])
    cuts = np.flatnonzero(np.diff(group[pairs[0]])) + 1
    for pa_, pb_ in zip(np.split(pairs[0], cuts), np.split(pairs[1], cuts), strict=True):
        own = np.unique(np.concatenate([pa_, pb_]))
        x, y = np.searchsorted(own, pa_), np.searchsorted(own, pb_)
        size = np.array([len(sets[k]) for k in own])
        if len(own) == 2:
            both = np.array([len(np.intersect1d(sets[own[0]], sets[own[1]], assume_unique=True))])
        else:
            both = _shared([sets[k] for k in own])[x, y]
        union = size[x] + size[y] - both
        true = both * similarity.denominator >= union * similarity.numerator
        root = _forest((x[true], y[true]), len(own))
        links += [(int(nodes[own[k]]), int(nodes[own[r]])) for k, r in enumerate(root) if k != r]
    return links


def verified_links(docs: DataFrame, work: DataFrame, key: str, text: str, similarity: Fraction, size: int) -> DataFrame:
    """(u, v): links confirmed on full sets, a spanning forest for each block pair."""

    def run(table: pa.Table) -> pa.Table:
        cross = table["i"][0].as_py() != table["j"][0].as_py()
        parts = list(_sets(table["text"], size))
        sets = [s for _, _, own in parts for s in own]
        minima = np.concatenate([signatures(values, offsets) for values, offsets, _ in parts])
        nodes = table["node"].to_numpy()
        full = np.array([len(s) > 0 for s in sets])
        keep = np.flatnonzero(full)
        links = compare(
            nodes[keep], table["right"].to_numpy(zero_copy_only=False)[keep], cross, minima[keep], [sets[k] for k in keep], similarity
        )
        return pa.table(
            {"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())}
        )

    texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text"))
    rows = work.join(texts, "node").select("by", "part", "i", "j", "node", "right", "text")
    return rows.groupBy("by", "part", "i", "j").applyInArrow(run, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, size: int = 5
) -> DataFrame:
    """Per row: key, n_shingles, component_id (least key of its group) and kept (it is that least one)."""
    found = features(docs, key, text, similarity, size)
    named = found.filter("n > 0").groupBy("f1", "f2", "n").agg(
        F.min("id").alias("node"), F.min_by("bands", F.coalesce("id", F.lit(0))).alias("bands")
    )
    named = stage(named, "classes")
    classes = named.filter("node IS NOT NULL")
    work = work_groups(classes)
    links = verified_links(docs, work, key, text, Fraction(str(similarity)), size)
    group = connected_components(links, "links")
    least = named.join(group, named["node"] == group["u"], "left").select(
        "f1", "f2", "n", F.coalesce("v", "node").alias("component")
    )
    rows = found.select("id", "n", "f1", "f2").join(least, ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    # Rows with one id are one document: all its texts take the least component.
    return rows.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull()))
