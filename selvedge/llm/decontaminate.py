"""Benchmark decontamination by latent semantic retrieval.

Items are cut evenly into passages of at most PASSAGE words, taken in blocks of about ITEMS passages, so all that
is sent to tasks is bounded whatever the size of the benchmark (an item stays whole in its block, so by the longest
item at most); each block is searched against all documents:

1. Documents become arrays of vocabulary places (the block's words; others are -1), read as half passages of
   HALF words; two neighbouring halves are a passage. Document frequencies come from all of them.
2. A randomised SVD of the TF-IDF matrix of all passages and items, one pass: with a Gaussian test matrix W
   tasks sum Z = A'(A W), and the Nystroem form Z (W'Z)^-1 Z' gives right singular vectors. The test matrix
   also holds the items themselves, so that their own directions are in the range that is found.
3. Every passage and passage of an item is projected, and pairs with a cosine of COSINE or more are candidates.
4. A candidate is confirmed on the whole item, whatever its length, by the longest common subsequence of words
   within a stretch little longer than the item: ``COPY`` of the item's words make a copy; ``PARAPHRASE`` of them
   and the item's answer (its last sentence of any length, word by word in order; a point within a number or a
   word ends no sentence) make a paraphrase; of an item of one sentence, which has no answer of its own, ``PARAPHRASE`` of the words alone do.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased for A-Z. Frequent words (in over
COMMON of all half passages, and in more than FEW) weigh nothing in the search but count in the subsequence; the
OWN rarest words of every passage of an item always weigh, so an item is found however often it has leaked.

Defined results: null or empty items and texts match nothing; an item repeated under several ids is reported
under each; rows that repeat are reported once; items of fewer than LEAST words need all their words in a
row. Texts are searched whole, a bounded run of words at a time, however long. An empty benchmark or corpus gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvedge.llm.sums import SCHEMA, sliced, total
from selvedge.llm.words import alphabet, chunks, hash_words
from selvedge.session import stage

HALF, PASSAGE, ITEMS = 32, 64, 256
RANK, EXTRA = 256, 16
COMMON, FEW, OWN, COSINE = 0.002, 64, 8, 0.3
RUN = 1 << 17
COPY, PARAPHRASE, LEAST = 0.75, 0.5, 8
WORDS = alphabet(bytes(b for b in range(128) if not chr(b).isalnum()), fold=True, seed=31)
NON_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_texts(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(item, text, answer, parts): words of items; the last ``answer`` ones answer it, ``parts`` passages hold it."""
    body = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)

    def words(column):
        return F.filter(F.split(column, NON_WORD), lambda w: w != "")

    last = F.element_at(F.split(F.regexp_replace(body, f"{NON_WORD}$", ""), "[.!?](?![0-9A-Za-z])"), -1)
    rows = benchmark.select(F.col(key).alias("item"), words(body).alias("w"), F.size(words(last)).alias("answer")).filter("size(w) > 0")
    return rows.select("item", F.array_join("w", " ").alias("text"), "answer", F.ceil(F.size("w") / PASSAGE).alias("parts")).distinct()


@dataclass(frozen=True)
class Block:
    """Items of one block: their words as places in the sorted vocabulary of word hashes, and their passages."""

    names: list
    answers: list[int]
    words: list[np.ndarray]
    vocabulary: np.ndarray
    passages: list[tuple[int, int, int]]  # (item, first word, end)

    def passage_words(self) -> list[np.ndarray]:
        return [self.words[k][a:b] for k, a, b in self.passages]


def read_block(rows: list) -> Block:
    hashes, offsets = [], [0]
    for _, _, data, at in chunks(pa.array([r["text"] for r in rows], pa.string())):
        own, begin = hash_words(data, at, WORDS)
        hashes.append(own)
        offsets += (begin[1:] + offsets[-1]).tolist()
    every = np.concatenate(hashes)
    vocabulary, place = np.unique(every, return_inverse=True)
    words = [place[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    passages = []
    for k, own in enumerate(words):
        parts = -(-len(own) // PASSAGE)
        cuts = [len(own) * n // parts for n in range(parts + 1)]
        passages += [(k, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return Block([r["item"] for r in rows], [r["answer"] for r in rows], words, vocabulary, passages)


def place_type(size: int) -> type:
    """The type of places in a vocabulary; long items may hold more words than int16 counts."""
    return np.int16 if size < 1 << 15 else np.int32


def _lookup(vocabulary: np.ndarray, hashes: np.ndarray, likely: np.ndarray) -> np.ndarray:
    found = np.full(len(hashes), -1, dtype=place_type(len(vocabulary)))
    maybe = np.flatnonzero(likely[hashes >> np.uint64(44)])
    own = hashes[maybe]
    at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
    true = vocabulary[at] == own
    found[maybe[true]] = at[true]
    return found


def vocabulary_places(docs: DataFrame, key: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """(key, places as binary) for each text, and one row without a key per task: its document frequencies."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        likely = np.zeros(1 << 20, dtype=bool)
        likely[known >> np.uint64(44)] = True
        seen = np.zeros(size + 1, dtype=np.int64)
        kind = pa.int64()
        for batch in batches:
            kind, low = batch.schema.field(0).type, 0
            for _, _, data, at in chunks(batch.column(1), 1 << 20):
                hashes, offsets = hash_words(data, at, WORDS)
                place = _lookup(known, hashes, likely)
                half, _ = halves(offsets)
                inside = place >= 0
                for a in range(0, len(place), RUN):  # a half passage cut here counts twice
                    own, where = place[a : a + RUN], half[a : a + RUN]
                    own, where = own[own >= 0].astype(np.int64), where[own >= 0]
                    pairs = np.sort((where - half[a]) * size + own)
                    first = np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]
                    seen[:size] += np.bincount(pairs[first] % size, minlength=size)
                seen[size] += int(half[-1]) + 1 if len(half) else 0
                keep = np.flatnonzero(np.add.reduceat(np.r_[inside, False].astype(np.int64), np.minimum(offsets[:-1], len(inside))) * (np.diff(offsets) > 0) > 0)
                own = [place[offsets[k] : offsets[k + 1]].tobytes() for k in keep]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(at) - 1).take(pa.array(keep)), pa.array(own, pa.binary()), pa.array([False] * len(keep), pa.bool_())], ["key", "places", "sums"]
                )
                low += len(at) - 1
        yield pa.RecordBatch.from_arrays([pa.array([None], kind), pa.array([seen.tobytes()], pa.binary()), pa.array([True])], ["key", "places", "sums"])

    kind = rows.schema["key"].dataType.simpleString()
    return stage(rows.mapInArrow(run, f"key {kind}, places binary, sums boolean"), "places")


def halves(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word's half passage, and of each text's first one (with one more at the end)."""
    counts = np.diff(offsets)
    per_text = -(-counts // HALF)
    first = np.concatenate([[0], np.cumsum(per_text)])
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)
    return np.repeat(first[:-1], counts) + inside // HALF, first


def _texts(batch: pa.RecordBatch, column: int, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, places, offsets) for runs of texts of about RUN words."""
    low, size, parts = 0, 0, []
    for k, value in enumerate(batch.column(column)):
        parts.append(np.frombuffer(value.as_buffer(), dtype=kind))
        size += len(parts[-1])
        if size > RUN:
            yield low, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            low, size, parts = k + 1, 0, []
    if parts:
        yield low, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _sum_halves(place: np.ndarray, half: np.ndarray, count: int, weighted: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``weighted`` summed for each half, with the words that weigh and their halves."""
    kept = np.flatnonzero((place >= 0) & heavy[place])
    words, where = place[kept], half[kept]
    sums = np.zeros((count, weighted.shape[1]), dtype=np.float32)
    if len(kept):
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        sums[where[first]] = np.add.reduceat(weighted[words], first, axis=0)
    return sums, words, where


def _passages(sums: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each half with the next one of its text."""
    both = sums.copy()
    both[:-1] += sums[1:]
    ends = first[1:][np.diff(first) > 0] - 1
    both[ends] = sums[ends]
    return both


def weights(seen: np.ndarray, halves_seen: int, block: Block) -> np.ndarray:
    """Smoothed inverse document frequencies; 0 for frequent words but the rarest of each passage of an item."""
    idf = 1 + np.log((halves_seen + 1) / (seen + 1))
    light = seen > max(FEW, COMMON * halves_seen)
    for words in block.passage_words():
        own = np.unique(words)
        light[own[np.argsort(seen[own], kind="stable")[:OWN]]] = False
    idf[light] = 0
    return idf


def latent_vectors(places: DataFrame, block: Block, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF matrix of all passages and items."""
    size = len(idf)
    own = block.passage_words()
    items = np.zeros((len(own), size))
    for k, words in enumerate(own):
        np.add.at(items[k], words, idf[words])
    items /= np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-9)
    width = min(size, RANK + EXTRA)
    random = np.random.default_rng(17)
    test = random.normal(0, size**-0.5, (size, width))
    test[:, : min(len(items), width)] += items[:width].T
    sent = places.sparkSession.sparkContext.broadcast((idf[:, None] * test).astype(np.float32))
    heavy = idf > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, held = sent.value, np.zeros((size, width), dtype=np.float32)
        for batch in batches:
            for _, place, offsets in _texts(batch, 0, place_type(size)):
                half, first = halves(offsets)
                sums, words, where = _sum_halves(place, half, int(first[-1]), weighted, heavy)
                if not len(words):
                    continue
                norm = np.bincount(where, idf[words] ** 2, minlength=len(sums)).astype(np.float32)[:, None]
                passage = _passages(sums, first) / np.maximum(_passages(norm, first), 1e-6)
                # A word of a half stands in the passage that begins with it and in the one before.
                back = passage.copy()
                back[1:] += passage[:-1]
                begins = first[:-1][np.diff(first) > 0]
                back[begins] = passage[begins]
                order = np.argsort(words, kind="stable")
                words, where = words[order], where[order]
                lead = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
                held[words[lead]] += np.add.reduceat(back[where], lead, axis=0)
        yield sliced(held)

    parts = places.filter("NOT sums").select("places").mapInArrow(run, SCHEMA)
    z = total(parts, (size, width), np.float32, np.float64) * idf[:, None]
    weight = max(1.0, float(np.abs(z).max(initial=0.0)))
    z += weight * items.T @ (items @ test)
    core = test.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-9
    left, scale, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return left[:, :RANK][:, scale[:RANK] > scale[0] * 1e-7].astype(np.float32)


def common_length(masks: dict[int, int], size: int, text: list[int]) -> tuple[int, int]:
    """Length of the longest common subsequence and how much of ``text`` it takes to reach it."""
    row = full = (1 << size) - 1
    best, reach = 0, 0
    for k, word in enumerate(text):
        mask = masks.get(word)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
            length = size - row.bit_count()
            if length > best:
                best, reach = length, k + 1
    return best, reach


def _masks(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for k, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << k
    return masks


class Item:
    """A whole item ready to be compared with stretches of text."""

    def __init__(self, words: np.ndarray, answer: int):
        self.words, self.answer = words.tolist(), answer
        self.size = len(self.words)
        self.masks, self.backward = _masks(self.words), _masks(self.words[::-1])
        self.closing = self.words[self.size - answer :] if answer < self.size else []
        self.stretch = self.size + self.size // 2 + 8

    def judge(self, text: list[int]) -> tuple[int, int, int, bool] | None:
        """(common words, begin, end, answer found) of the best stretch that is a copy or a paraphrase."""
        at = -1
        for _ in range(text.count(self.words[0])):
            at = text.index(self.words[0], at + 1)
            if text[at : at + self.size] == self.words:
                return self.size, at, at + self.size, True
        if self.size < LEAST:
            return None
        if common_length(self.masks, self.size, text)[0] < PARAPHRASE * self.size:
            return None
        best = None
        for low in range(0, max(1, len(text) - self.stretch + self.size // 4), max(4, self.size // 4)):
            part = text[low : low + self.stretch]
            length, reach = common_length(self.masks, self.size, part)
            if length < PARAPHRASE * self.size or (best and length <= best[0]):
                continue
            length, back = common_length(self.backward, self.size, part[:reach][::-1])
            begin, end = low + reach - back, low + reach
            answered = bool(self.closing) and common_length(_masks(self.closing), self.answer, text[begin : end + self.answer])[0] == self.answer
            if length >= COPY * self.size or answered or not self.closing:
                best = length, begin, end, answered
        return best


def joined(places: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """(text, item, begin, end, cosine) with overlapping places of an item in a text as one, of the highest cosine."""
    found: list[tuple[int, int, int, int, float]] = []
    for text, item, begin, end, cosine in sorted(places):
        if found and found[-1][:2] == (text, item) and begin <= found[-1][3]:
            _, _, low, high, best = found.pop()
            found.append((text, item, low, max(high, end), max(best, cosine)))
        else:
            found.append((text, item, begin, end, cosine))
    return found


def search(places: DataFrame, block: Block, idf: np.ndarray, latent: np.ndarray) -> DataFrame:
    """Confirmed (key, number of the item, cosine, common, size, begin, end, answered)."""
    items = np.zeros((len(block.passages), latent.shape[1]), dtype=np.float32)
    for k, words in enumerate(block.passage_words()):
        items[k] = idf[words] @ latent[words]
    norms = np.linalg.norm(items, axis=1, keepdims=True)
    items = np.where(norms > 0, items / np.maximum(norms, 1e-9), 0).astype(np.float32)
    context = places.sparkSession.sparkContext
    sent = context.broadcast(((idf[:, None] * latent).astype(np.float32), items, block.words, block.answers, block.passages))
    heavy, size = idf > 0, len(idf)
    kind = places.schema["key"].dataType.simpleString()
    schema = f"key {kind}, number int, cosine double, common int, size int, begin bigint, end bigint, answered boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, sought, words_of, answers, passages = sent.value
        ready = [Item(w, a) for w, a in zip(words_of, answers, strict=True)]
        for batch in batches:
            rows, out = [], []
            for low, place, offsets in _texts(batch, 1, place_type(size)):
                half, first = halves(offsets)
                sums, words, where = _sum_halves(place, half, int(first[-1]), weighted, heavy)
                if not len(words):
                    continue
                passage = _passages(sums, first)
                # The norm before projection: what an unrelated passage loses by it must not raise its cosine.
                norm = np.bincount(where, idf[words] ** 2, minlength=len(sums)).astype(np.float32)
                norm = np.sqrt(_passages(norm[:, None], first)[:, 0])
                alive = np.flatnonzero(norm > 0)
                near = []
                for cut in range(0, len(alive), 8192):
                    some = alive[cut : cut + 8192]
                    cosine = passage[some] / norm[some, None] @ sought.T
                    for a, b in zip(*np.nonzero(cosine >= COSINE), strict=True):
                        number = int(some[a])
                        text = int(np.searchsorted(first, number, side="right")) - 1
                        at = int(offsets[text]) + (number - int(first[text])) * HALF
                        # The rest of the item stands before and after what is alike, half as long again at most.
                        item, head, tail = passages[b]
                        before, after = head * 3 // 2, (len(words_of[item]) - tail) * 3 // 2
                        begin = max(int(offsets[text]), at - HALF - before)
                        near.append((text, item, begin, min(int(offsets[text + 1]), at + PASSAGE + HALF + after), float(cosine[a, b])))
                for text, item, begin, end, alike in joined(near):
                    found = ready[item].judge(place[begin:end].tolist())
                    if found:
                        length, x, y, answered = found
                        shift = begin - int(offsets[text])
                        rows.append(low + text)
                        out.append((item, alike, length, ready[item].size, shift + x, shift + y, answered))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                [c.split()[0] for c in schema.split(", ")],
            )

    return places.filter("NOT sums").select("key", "places").mapInArrow(run, schema)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, item, kind, share, cosine, first_word, last_word): one row for each item found in a document."""
    spark = docs.sparkSession
    items = stage(item_texts(benchmark, item, item_text), "items")
    blocks = max(1, math.ceil((items.agg(F.sum("parts")).first()[0] or 0) / ITEMS))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    found = None
    for k in range(blocks):
        rows = items.filter(F.col("block") == k).orderBy("item", "text").collect()  # about ITEMS passages of PASSAGE words
        if not rows:
            continue
        block = read_block(rows)
        places = vocabulary_places(docs, key, text, block.vocabulary)
        size = len(block.vocabulary)
        seen = total(places.filter("sums").select(F.lit(0).alias("slice"), F.col("places").alias("part")), (size + 1,), np.int64, np.int64, slices=1)
        idf = weights(seen[:size], int(seen[size]), block)
        hits = search(places, block, idf, latent_vectors(places, block, idf))
        kind = items.schema["item"].dataType
        names = spark.createDataFrame(list(enumerate(block.names)), f"number int, item {kind.simpleString()}")
        own = stage(hits.join(names, "number"), "leaks")
        found = own if found is None else found.unionByName(own)
    if found is None:
        kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
        return spark.createDataFrame(
            [], f"{key} {kinds[0]}, {item} {kinds[1]}, kind string, share double, cosine double, first_word bigint, last_word bigint"
        )
    best = found.groupBy("key", "item").agg(
        F.max_by(
            F.struct("cosine", "common", "size", "begin", "end"),
            F.struct(F.col("common") / F.col("size"), "cosine", -F.col("begin")),
        ).alias("best")
    )
    share = F.col("best.common") / F.col("best.size")
    return best.select(
        F.col("key").alias(key),
        F.col("item").alias(item),
        F.when(share >= COPY, "copy").otherwise("paraphrase").alias("kind"),
        share.alias("share"),
        F.col("best.cosine").alias("cosine"),
        F.col("best.begin").alias("first_word"),
        (F.col("best.end") - 1).alias("last_word"),
    )
