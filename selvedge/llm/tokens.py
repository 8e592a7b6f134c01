"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging.

Texts are split into pre-tokens; the distinct new ones of a slice are held as one ragged numpy array
of symbols. In every round each sequence applies its own lowest-rank pair at all its places at
once, left to right, and only pairs beside a merge are looked up again; sequences without a pair
left are counted and dropped. Counts of seen pre-tokens are remembered up to a fixed number.

The strings of added special tokens inside a text count as one token each, as the tokenizer's
library does by default. Defined results: null or empty text has 0 bytes and 0 tokens; rows are
answered one by one, so repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the split of byte-level BPE, with white space as Unicode has it.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
REMEMBERED = 400_000
SLICE = 1 << 20
NONE = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Vocabulary:
    byte_ids: np.ndarray
    width: int
    keys: np.ndarray  # left * width + right, sorted
    ranks: np.ndarray
    merged: np.ndarray  # by rank
    specials: tuple[str, ...]


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next letter from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    split, model = parts.get("pre_tokenizer") or {}, parts["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if parts.get("normalizer") or not plain or model.get("ignore_merges") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
        raise ValueError(f"{path} is not a plain byte-level vocabulary: its counts would be wrong")
    ids = parts["model"]["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in parts["model"]["merges"]]
    width = max(ids.values()) + 1
    keys = np.array([ids[a] * width + ids[b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys)
    return Vocabulary(
        np.array([ids[c] for c in _byte_letters()], dtype=np.int64),
        width,
        keys[order],
        order.astype(np.int32),
        np.array([ids[a + b] for a, b in pairs], dtype=np.int64),
        tuple(t["content"] for t in parts.get("added_tokens", ()) if t.get("special")),
    )


def _ranks(vocabulary: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = left * vocabulary.width + right
    at = np.minimum(np.searchsorted(vocabulary.keys, key), len(vocabulary.keys) - 1)
    return np.where(vocabulary.keys[at] == key, vocabulary.ranks[at], NONE)


def count_symbols(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Symbols left of each word once no pair of it can be merged."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    counts = lengths.copy()
    names = np.flatnonzero(lengths > 1)
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    symbols = symbols[np.repeat(lengths > 1, lengths)]
    lengths = lengths[names]
    if not len(names):
        return counts
    rank = np.full(len(symbols), NONE, dtype=np.int32)
    rank[:-1] = _ranks(vocabulary, symbols[:-1], symbols[1:])
    rank[np.cumsum(lengths) - 1] = NONE  # no pair goes over the end of a word
    while len(names):
        starts = np.cumsum(lengths) - lengths
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == NONE
        if done.any():
            counts[names[done]] = lengths[done]
            stay = np.repeat(~done, lengths)
            symbols, rank = symbols[stay], rank[stay]
            names, lengths, lowest = names[~done], lengths[~done], lowest[~done]
            if not len(names):
                break
            starts = np.cumsum(lengths) - lengths
        own = np.repeat(np.arange(len(names)), lengths)
        hit = np.flatnonzero(rank == lowest[own])
        # Of neighbouring hits (a pair of equal symbols) every second one counts, from the left.
        fresh = np.ones(len(hit), dtype=bool)
        fresh[1:] = (hit[1:] - hit[:-1] != 1) | (own[hit[1:]] != own[hit[:-1]])
        run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        symbols[hit] = vocabulary.merged[lowest[own[hit]]]
        stay = np.ones(len(symbols), dtype=bool)
        stay[hit + 1] = False
        place = np.cumsum(stay) - 1
        lengths = lengths - np.bincount(own[hit], minlength=len(names))
        symbols, rank = symbols[stay], rank[stay]
        now, ends = place[hit], np.cumsum(lengths) - 1
        last = np.zeros(len(symbols), dtype=bool)
        last[ends] = True
        touched = np.unique(np.concatenate([now, now[now > 0] - 1]))
        closed = touched[last[touched]]
        rank[closed] = NONE
        touched = touched[~last[touched]]
        rank[touched] = _ranks(vocabulary, symbols[touched], symbols[touched + 1])
    return counts


class Counter:
    """Counts texts, remembering up to REMEMBERED pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(PATTERN)
        self.specials = (
            regex.compile("|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True))))
            if vocabulary.specials
            else None
        )
        self.seen: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen = {w: self.seen[w] for w in words if w in self.seen}
        found = count_symbols([w.encode() for w in new], self.vocabulary) if new else ()
        self.seen.update(zip(new, map(int, found), strict=True))

    def _parts(self, text: str) -> tuple[list[str], int]:
        if self.specials is None:
            return [text], 0
        pieces = self.specials.split(text)
        return pieces, len(pieces) - 1

    def _long(self, text: str) -> int:
        """A long text, a fixed number of pre-tokens at a time."""
        pieces, total = self._parts(text)
        found = (m.group() for piece in pieces for m in self.split.finditer(piece))
        while words := list(itertools.islice(found, SLICE // 4)):
            self.learn(set(words))
            total += sum(map(self.seen.__getitem__, words))
        return total

    def count(self, texts: list[str]) -> list[int]:
        totals, waiting, size = [0] * len(texts), [], 0

        def settle() -> None:
            self.learn(set(itertools.chain.from_iterable(words for _, words in waiting)))
            for k, words in waiting:
                totals[k] += sum(map(self.seen.__getitem__, words))
            waiting.clear()

        for k, text in enumerate(texts):
            if len(text) > SLICE:
                totals[k] = self._long(text)
                continue
            pieces, totals[k] = self._parts(text)
            waiting.extend((k, self.split.findall(piece)) for piece in pieces)
            size += len(text)
            if size > SLICE:
                settle()
                size = 0
        settle()
        return totals


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit per row. ``path`` is read by the driver; the vocabulary is sent once."""
    read = read_vocabulary(path)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(vars(read).values()))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Vocabulary(*sent.value))
        for batch in batches:
            counts = counter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["key", "n_tokens"])

    sized = rows.select("key", "text")
    counted = sized.select(F.struct("key", F.octet_length("text").cast("long").alias("n_bytes")).alias("key"), "text")
    found = counted.mapInArrow(run, f"key struct<key:{kind},n_bytes:bigint>, n_tokens bigint")
    return found.select(
        F.col("key.key").alias(key), F.col("key.n_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
