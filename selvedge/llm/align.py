"""Alignment of two tokenizers' cuts of one text by pointer jumping, and how well their ids pair up corpus-wide.

A text is cut by a byte-level BPE vocabulary (A, of space + text) and by a sentence-piece model (B, of the text, to
which the model adds a space). Both cuts tile the same bytes. Every token points to the farthest-right token that
overlaps it: one of A to the B token that holds its last byte, one of B to the A token that holds its last byte if
that reaches farther, else to itself. Doubling all pointers of a run of texts at once leads each token to the last
token of its component in as many rounds as the longest chain has binary digits; that token names the group.

The A and B token that end a group together are linked. How often a pair of ids is linked is summed over all texts:
a run of texts (a chunk of bounded size, or one longer text) brings its distinct pairs once, counts are added by
pair, and each chunk gets back the counts of its own pairs only, to sum them over its texts. No table of all pairs
is sent anywhere; of the ids, only the highest count of each B id is looked up apart, one row per id of B.

Defined results: a text that is null or empty, or whose tokens do not spell space + text (one that holds U+2581,
say), has no tokens: zeros and an empty digest. Rows are answered one by one, so repeated rows repeat and each
counts; null keys are kept; other columns are ignored. A very long text is a chunk of its own. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvedge.llm.tokens import PATTERN, _byte_letters
from selvedge.session import stage

CHUNK = 4 << 20  # bytes of text whose pairs are looked up together
SLICE = 1 << 20  # characters that are cut and aligned at a time
SPACE = "▁"


REMEMBERED, REMEMBERED_TOKENS = 300_000, 3_000_000  # words whose pieces a task keeps


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE characters."""
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high] or "") <= SLICE):
            size += len(texts[high] or "")
            high += 1
        yield low, high
        low = high


class ByteLevel:
    """Byte-level BPE of a tokenizer file whose ids follow the ranks of its merges; special strings are plain text.

    Every byte has a symbol, so the tokens of a text always spell it. ``size[id]`` are the bytes of an id.
    """

    def __init__(self, file: str):
        import tiktoken

        parts = json.loads(file)
        model, split = parts["model"], parts.get("pre_tokenizer") or {}
        if parts.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level vocabulary")
        byte = {letter: k for k, letter in enumerate(_byte_letters())}
        ids = {bytes(byte[x] for x in name): k for name, k in model["vocab"].items() if all(x in byte for x in name)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][x + y] for x, y in pairs]
        if made != sorted(made):
            raise ValueError("the ids do not follow the ranks of the merges")
        self.library = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
        self.size = np.zeros(max(ids.values()) + 1, dtype=np.int32)
        self.size[list(ids.values())] = [len(piece) for piece in ids]

    def tokenize(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all spaces + texts, how many each text has, and whether they spell it."""
        found = [self.library.encode_ordinary(" " + t) for t in texts]
        counts = np.array([len(f) for f in found], dtype=np.int64)
        tokens = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(counts.sum()))
        return tokens, counts, np.ones(len(texts), dtype=bool)


class Pieces:
    """A sentence-piece model; it adds the first space itself. ``size[id]`` are the bytes of an id.

    No piece goes over a space into a next word, so a text's pieces are those of its words, spaces first; the pieces of
    distinct words are remembered up to a fixed number.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        if any(SPACE in n.lstrip(SPACE) for n in names):
            raise ValueError("the model has pieces that go over a space into a next word")
        self.pieces = [
            bytes([int(n[3:5], 16)]) if self.library.is_byte(k) else n.replace(SPACE, " ").encode() for k, n in enumerate(names)
        ]
        self.size = np.array([len(p) for p in self.pieces], dtype=np.int32)
        self.lone = [self.library.piece_to_id(SPACE)]
        self.words = re.compile(" +[^ ]*")
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.tokens, self.at, self.spelt = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=bool)

    def _learn(self, words: set[str]) -> None:
        new = list(words - self.number.keys())
        if not new:
            return
        if len(self.number) + len(new) > REMEMBERED or len(self.tokens) > REMEMBERED_TOKENS:
            self._forget()
            new = list(words)
        # The model adds a first space itself, but to nothing.
        found = [f or self.lone for f in self.library.encode([w[1:] for w in new], num_threads=1)]
        spell = self.pieces.__getitem__
        self.spelt = np.append(self.spelt, [b"".join(map(spell, f)) == w.encode() for w, f in zip(new, found, strict=True)])
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.at = np.append(self.at, self.at[-1] + np.cumsum([len(f) for f in found]))
        self.tokens = np.append(self.tokens, np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32))

    def tokenize(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all texts, how many each text has, and whether they spell space + text."""
        words = [self.words.findall(" " + t) for t in texts]
        self._learn(set(itertools.chain.from_iterable(words)))
        ends = np.cumsum([len(ws) for ws in words])
        own = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(words)), dtype=np.int64, count=int(ends[-1]))
        length = self.at[own + 1] - self.at[own]
        upto = np.concatenate([[0], np.cumsum(length)])
        tokens = self.tokens[np.arange(upto[-1]) + np.repeat(self.at[own] - upto[:-1], length)]
        wrong = np.concatenate([[0], np.cumsum(~self.spelt[own])])[ends]
        return tokens, np.diff(upto[ends], prepend=0), np.diff(wrong, prepend=0) == 0


def join_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and each B token, numbered from 0, by pointer jumping."""
    count = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a).astype(np.int32) + count
    over_b = np.searchsorted(ends_a, ends_b).astype(np.int32)
    own = np.arange(count, count + len(ends_b), dtype=np.int32)
    last = ends_a[over_b] == ends_b
    point = np.concatenate([over_a, np.where(last, own, over_b)])
    while True:
        further = point[point]
        if np.array_equal(further, point):
            break
        point = further
    number = np.cumsum(last) - 1
    return number[point[:count] - count], number[point[count:] - count]


def decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 to ``most`` in the low seven bytes of a number, zero bytes before them, and how many each has."""
    if most >= 10**7:
        raise ValueError("ids of more than seven digits")
    rest, table, length = np.arange(most + 1), np.zeros(most + 1, dtype=np.uint64), np.zeros(most + 1, dtype=np.int32)
    for k in range(7):
        there = (rest > 0) | (k == 0)
        table |= np.where(there, rest % 10 + ord("0"), 0).astype(np.uint64) << np.uint64(8 * (6 - k))
        length += there
        rest = rest // 10
    return table, length


def spell_groups(
    a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, shown: tuple[np.ndarray, np.ndarray]
) -> tuple[bytes, np.ndarray]:
    """The bytes ``a1,a2|b1;a3|b2;`` of all groups in order, and where each group ends among them."""
    groups = int(group_a[-1]) + 1
    size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    upto = np.cumsum(size_a + size_b)
    ids = np.empty(len(a) + len(b), dtype=np.int32)
    ids[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]] = a
    ids[np.arange(len(b)) + np.cumsum(size_a)[group_b]] = b
    mark = np.full(len(ids), ord(","), dtype=np.uint64)
    mark[upto - size_b - 1] = ord("|")
    mark[upto - 1] = ord(";")
    table, length = shown
    spelt = (table[ids] | mark << np.uint64(56)).astype("<u8").tobytes().translate(None, b"\0")
    return spelt, np.cumsum(length[ids] + 1, dtype=np.int64)[upto - 1]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    low = 0
    while low < len(sizes):
        high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), CHUNK, side="right")))
        yield low, min(high, len(sizes))
        low = high


def align_texts(
    texts: list[str | None], left: ByteLevel, right: Pieces, shown: tuple[np.ndarray, np.ndarray]
) -> dict[str, list | np.ndarray]:
    """Sizes, digest and linked id pairs (b * 2**32 + a, as runs of ``n_groups``) of every text."""
    held = [t or "" for t in texts]
    full = np.array([len(t) > 0 for t in held], dtype=bool)
    (a, n_a, good_a), (b, n_b, good_b) = left.tokenize(held), right.tokenize(held)
    good = full & good_a & good_b
    a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
    n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
    n_groups, digests, pairs = np.zeros(len(held), dtype=np.int64), [""] * len(held), np.zeros(0, dtype=np.int64)
    if len(a):
        ends_a, ends_b = np.cumsum(left.size[a], dtype=np.int64), np.cumsum(right.size[b], dtype=np.int64)
        group_a, group_b = join_groups(ends_a, ends_b)
        upto = np.where(good, group_a[np.maximum(np.cumsum(n_a) - 1, 0)] + 1, 0)
        upto = np.maximum.accumulate(upto)
        n_groups = np.diff(upto, prepend=0)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        pairs = b[last_b].astype(np.int64) << 32 | a[last_a]
        spelt, at = spell_groups(a, b, group_a, group_b, shown)
        low = 0
        for k in np.flatnonzero(good):
            high = int(at[upto[k] - 1])
            digests[k] = hashlib.sha256(spelt[low : high - 1]).hexdigest()
            low = high
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "digest": digests, "pairs": pairs}


def _aligned(rows: DataFrame, vocabulary: str, model: bytes, kind: str) -> DataFrame:
    """Per text its sizes, digest and links as numbers in its chunk's list of pairs; that list stands on its first row."""
    sent = rows.sparkSession.sparkContext.broadcast((vocabulary, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = ByteLevel(sent.value[0]), Pieces(sent.value[1])
        shown = decimals(max(len(left.size), len(right.size)))
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low, high in _slices(batch.column(1)):
                texts = batch.column(1).slice(low, high - low).to_pylist()
                parts = [align_texts(texts[a:b], left, right, shown) for a, b in _runs(texts)]
                found = {c: np.concatenate([p[c] for p in parts]) for c in ("n_a", "n_b", "n_groups", "pairs")}
                found["digest"] = list(itertools.chain.from_iterable(p["digest"] for p in parts))
                number, pair = pd.factorize(found["pairs"])
                times = np.bincount(number, minlength=len(pair))
                count = high - low
                at = np.concatenate([[0], np.cumsum(found["n_groups"])]).astype(np.int32)
                first = np.full(count + 1, len(pair), dtype=np.int32)
                first[0] = 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(count, chunk), pa.int64()),
                        batch.column(0).slice(low, count),
                        pa.array(found["n_a"], pa.int64()),
                        pa.array(found["n_b"], pa.int64()),
                        pa.array(found["digest"], pa.string()),
                        pa.ListArray.from_arrays(at, pa.array(number.astype(np.int32))),
                        pa.ListArray.from_arrays(first, pa.array(pair)),
                        pa.ListArray.from_arrays(first, pa.array(times.astype(np.int64))),
                    ],
                    ["chunk", "key", "n_a", "n_b", "digest", "links", "pairs", "times"],
                )
                chunk += 1

    schema = f"chunk bigint, key {kind}, n_a bigint, n_b bigint, digest string, links array<int>, pairs array<bigint>, times array<bigint>"
    return stage(rows.mapInArrow(run, schema), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count, best: how often a pair is linked in all texts, and whether no pair of its B id is more often."""
    brought = aligned.filter(F.size("pairs") > 0).select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = stage(brought.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count")), "pairs")
    right = F.shiftright("pair", 32).alias("b")
    highest = counts.groupBy(right).agg(F.max("count").alias("most"))  # one row per id of the vocabulary at most
    named = counts.withColumn("b", right).join(highest, "b")
    return named.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, vocabulary: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row; the files are read by the driver."""
    with open(vocabulary, encoding="utf-8") as file:
        left = file.read()
    with open(model, "rb") as file:
        right = file.read()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    aligned = _aligned(rows, left, right, kind)
    asked = aligned.filter(F.size("pairs") > 0).select(F.col("chunk").alias("asker"), F.posexplode("pairs").alias("number", "pair"))
    looked = asked.join(pair_counts(aligned), "pair").select("asker", "number", "count", "best")

    def sums(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        number = pairs["number"].to_numpy()
        count, best = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int64)
        count[number] = pairs["count"].to_numpy()
        best[number] = pairs["best"].to_numpy(zero_copy_only=False)
        links = texts["links"].combine_chunks()
        sizes = pc.list_value_length(links).to_numpy(zero_copy_only=False).astype(np.int64)
        own = pc.list_flatten(links).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(sizes)])

        def per_text(values: np.ndarray) -> np.ndarray:
            running = np.concatenate([[0], np.cumsum(values[own])])
            return running[upto[1:]] - running[upto[:-1]]

        return pa.table(
            [texts["key"], texts["n_a"], texts["n_b"], pa.array(sizes), pa.array(per_text(best)), pa.array(per_text(count)), texts["digest"]],
            ["key", "n_a", "n_b", "n_links", "n_best", "count_sum", "groups_sha256"],
        )

    schema = f"key {kind}, n_a bigint, n_b bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    slim = aligned.select("chunk", "key", "n_a", "n_b", "digest", "links")
    done = slim.groupBy("chunk").cogroup(looked.groupBy("asker")).applyInArrow(sums, schema)
    return done.select(
        F.col("key").alias(key), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256"
    )
