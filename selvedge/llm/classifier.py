"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. Every hashed word has a fixed sparse ternary index vector. A word's context vector is the sum, over
   the whole corpus, of the index vectors of the words within two places of it. Tasks add up their
   own texts; the sums of tasks are added in two levels by slices of the vocabulary.
2. A document is the mean and the spread of its words' unit vectors, the mean likeness of
   neighbouring ones, and the logarithm of its length.
3. Labelled rows outside the held-out quarter, at most ``max_rows`` of them drawn by a hash of their
   key, train the network; a fifth of them is set aside to fit the temperature that calibrates
   its probabilities.

The vocabulary is hashed into 2**14 places, so the vectors sent to tasks are 4 MB at any size of input.

Defined results: null or empty text has no words; its vector is zero and it is scored like any other.
Labels other than 0 and 1, null keys and keys without a document are ignored; without labels of both
kinds every score is the share of label 1, or 0.5. Repeated rows repeat. Only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvedge.llm.sums import SCHEMA, sliced, total
from selvedge.llm.words import alphabet, chunks, hash_words
from selvedge.session import stage

PLACES_BITS, WIDTH, NONZERO, REACH = 14, 64, 4, 2
PLACES = 1 << PLACES_BITS
TEXT_BYTES = 1 << 17  # texts taken at a time: the rows of their words' vectors stay within a processor's cache
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
LETTERS = alphabet(b" \t\n\x0b\x0c\r", MARKS, fold=False, seed=23)


def index_vectors(seed: int = 3) -> np.ndarray:
    random = np.random.default_rng(seed)
    vectors = np.zeros((PLACES, WIDTH), dtype=np.int8)
    where = np.argsort(random.random((PLACES, WIDTH)), axis=1)[:, :NONZERO]
    signs = random.choice(np.array([-1, 1], dtype=np.int8), (PLACES, NONZERO))
    np.put_along_axis(vectors, where, signs, axis=1)
    return vectors


def _places(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, _, data, at in chunks(column, TEXT_BYTES):
        hashes, offsets = hash_words(data, at, LETTERS)
        yield (hashes >> np.uint64(64 - PLACES_BITS)).astype(np.uint16), offsets


def _add_contexts(held: np.ndarray, place: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> None:
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    own = vectors.take(place, axis=0)
    around = np.zeros_like(own)
    for d in range(1, REACH + 1):
        around[:-d] += own[d:]
        around[d:] += own[:-d]
        # Words of two texts are no neighbours.
        apart = np.flatnonzero(text[d:] != text[:-d])
        around[apart] -= own[apart + d]
        around[apart + d] -= own[apart]
    order = np.argsort(place, kind="stable")
    sorted_places = place[order]
    first = np.flatnonzero(np.r_[True, sorted_places[1:] != sorted_places[:-1]])
    held[sorted_places[first]] += np.add.reduceat(around.take(order, axis=0), first, axis=0, dtype=np.int64)


def context_vectors(docs: DataFrame, text: str) -> np.ndarray:
    """PLACES x WIDTH sums over all texts."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, held = index_vectors(), np.zeros((PLACES, WIDTH), dtype=np.int64)
        for batch in batches:
            for place, offsets in _places(batch.column(0)):
                if len(place):
                    _add_contexts(held, place, offsets, vectors)
        yield sliced(held.astype(np.int32))

    return total(docs.select(text).mapInArrow(collect, SCHEMA), (PLACES, WIDTH), np.int32, np.int64)


def unit_vectors(contexts: np.ndarray) -> np.ndarray:
    norm = np.sqrt((contexts.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (contexts / np.maximum(norm, 1.0)).astype(np.float32)


def pool(docs: DataFrame, vectors: np.ndarray, key: str, text: str) -> DataFrame:
    """(key, pooled array<float>) per row; ``vectors`` is of a fixed size and sent to every task."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            low = 0
            for place, offsets in _places(batch.column(1)):
                counts = np.diff(offsets)
                full = np.flatnonzero(counts)
                mean = np.zeros((len(counts), WIDTH), dtype=np.float32)
                spread, near = np.zeros_like(mean), np.zeros(len(counts), dtype=np.float32)
                if len(full):
                    held = words.take(place, axis=0)
                    n = counts[full][:, None].astype(np.float32)
                    mean[full] = np.add.reduceat(held, offsets[full], axis=0) / n
                    alike = np.zeros(len(place), dtype=np.float32)
                    alike[1:] = np.einsum("ij,ij->i", held[1:], held[:-1])
                    alike[offsets[full]] = 0
                    near[full] = np.add.reduceat(alike, offsets[full]) / np.maximum(counts[full] - 1, 1)
                    np.square(held, out=held)
                    spread[full] = np.sqrt(np.maximum(np.add.reduceat(held, offsets[full], axis=0) / n - mean[full] ** 2, 0))
                pooled = np.column_stack([mean, spread, near, np.log1p(counts)]).astype(np.float32)
                at = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * pooled.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(counts)), pa.ListArray.from_arrays(at, pa.array(pooled.ravel()))], ["key", "pooled"]
                )
                low += len(counts)

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, pooled array<float>")


@dataclass(frozen=True)
class Network:
    """Standardised input, one hidden layer, a logit divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 13) -> Network:
    """Adam on the log loss with weight decay; every fifth row only fits the temperature."""
    random = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 5 == 4
    own, goal = x[~aside].astype(np.float64), y[~aside].astype(np.float64)
    mean, scale = own.mean(axis=0), own.std(axis=0) + 1e-3
    own = (own - mean) / scale
    p = {
        "w1": random.normal(0, own.shape[1] ** -0.5, (own.shape[1], hidden)),
        "b1": np.zeros(hidden),
        "w2": random.normal(0, hidden**-0.5, hidden),
        "b2": np.zeros(1),
    }
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step, batch = 0, 128
    for _ in range(epochs):
        order = random.permutation(len(goal))
        for low in range(0, len(order), batch):
            rows = order[low : low + batch]
            h = np.tanh(own[rows] @ p["w1"] + p["b1"])
            error = (1 / (1 + np.exp(-(h @ p["w2"] + p["b2"]))) - goal[rows]) / len(rows)
            back = error[:, None] * p["w2"] * (1 - h * h)
            slope = {"w1": own[rows].T @ back + 1e-4 * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ error + 1e-4 * p["w2"], "b2": error.sum(keepdims=True)}
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * slope[k]
                v[k] = 0.999 * v[k] + 0.001 * slope[k] ** 2
                p[k] = p[k] - 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    found = Network(mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]))
    if not aside.any():
        return found
    z, held = found.logits(x[aside].astype(np.float64)), y[aside].astype(np.float64)

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, z / t) - held * z / t))

    best = min(np.geomspace(0.25, 8, 61), key=loss)
    return Network(mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]), float(best))


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_rows: int = 20_000,
    threshold: float = 0.7,
) -> DataFrame:
    """key, held_out, score, predicted per row of ``docs``. ``max_rows`` bounds the labelled rows that train."""
    pooled = stage(pool(docs, unit_vectors(context_vectors(docs, text)), key, text), "pooled")
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    marked = marked.filter(F.col("label").isin(0, 1) & F.col("key").isNotNull() & ~held_out(F.col("key")))
    marked = stage(marked.join(pooled.select("key"), "key", "left_semi"), "labelled")
    share = min(1.0, max_rows / max(1, marked.count()))
    drawn = F.xxhash64("key").cast("double") / F.lit(2.0**63) < F.lit(2 * share - 1) if share < 1 else F.lit(True)
    # About max_rows rows, drawn by a hash of their key, and never more.
    sample = pooled.join(marked.filter(drawn), "key").limit(max_rows).toPandas()
    sample = sample.iloc[np.lexsort((sample["label"], sample["key"]))]
    y = sample["label"].to_numpy(dtype=np.int64)
    if len(set(y.tolist())) == 2:
        network = train(np.stack(sample["pooled"].to_numpy()), y)
        score = network.probability
    else:
        constant = float(y.mean()) if len(y) else 0.5

        def score(x: np.ndarray) -> np.ndarray:
            return np.full(len(x), constant)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(x.astype(np.float64)))], ["key", "score"])

    kind = pooled.schema["key"].dataType.simpleString()
    scored = pooled.mapInArrow(run, f"key {kind}, score double")
    return scored.select(
        F.col("key").alias(key),
        F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
