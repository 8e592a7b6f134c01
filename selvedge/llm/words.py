"""Word hashes of whole Arrow text columns in numpy: no Python object per word.

A word's hash is a polynomial over random 64-bit codes of its bytes, modulo 2**64, then mixed. Two
different words share a hash with a chance of about 2**-64. Texts are walked in blocks of a fixed
number of bytes, so a very long text needs no more working memory than many short ones; what is
returned grows with the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 16
CHUNK = 4 << 20
MASK = (1 << 64) - 1
_ROOT = 0x9E3779B97F4A7C15 | 1
_ROOT_INVERSE = pow(_ROOT, -1, 1 << 64)


def _powers(root: int) -> np.ndarray:
    factors = np.full(BLOCK, root, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


POW, INV = _powers(_ROOT), _powers(_ROOT_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Alphabet:
    """Kind 0 separates words; a change of kind ends a word. Codes fold A-Z to a-z if asked."""

    kind: np.ndarray
    code: np.ndarray


def alphabet(separators: bytes, marks: bytes = b"", fold: bool = True, seed: int = 11) -> Alphabet:
    kind = np.ones(256, dtype=np.uint8)
    kind[list(marks)] = 2
    kind[list(separators)] = 0
    code = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        code[65:91] = code[97:123]
    code[kind == 0] = 0
    return Alphabet(kind, code)


SPACED = alphabet(b" \t\n\x0b\x0c\r")


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of texts of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, side="right")) - 1)
        high = min(high, len(column))
        yield low, high, body[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def hash_words(data: np.ndarray, offsets: np.ndarray, letters: Alphabet = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of each text's words among them."""
    hashes: list[np.ndarray] = []
    begins: list[np.ndarray] = []
    previous, open_at = 0, -1
    for base in range(0, len(data), BLOCK):
        part = data[base : base + BLOCK]
        kind = letters.kind[part]
        before = np.empty_like(kind)
        before[0], before[1:] = previous, kind[:-1]
        previous = int(kind[-1])
        first = (kind != 0) & (kind != before)
        low, high = np.searchsorted(offsets, (base, base + len(part)))
        at = offsets[low:high] - base
        first[at] |= kind[at] != 0
        begin = np.flatnonzero(first)
        value = letters.code[part] * POW[: len(part)]
        head = int(begin[0]) if len(begin) else len(part)
        if head and open_at >= 0:
            rest = int(value[:head].sum(dtype=np.uint64))
            more = rest * pow(_ROOT, base - open_at, 1 << 64) & MASK
            hashes[-1][-1] = np.uint64((int(hashes[-1][-1]) + more) & MASK)
        if len(begin):
            hashes.append(np.add.reduceat(value, begin) * INV[begin])
            begins.append(begin + base)
            open_at = int(begin[-1]) + base
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    where = np.concatenate(begins)
    return mix(np.concatenate(hashes)), np.searchsorted(where, offsets)


def shingles(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words; a text with fewer words has one, of all of them; none without words."""
    counts = np.diff(offsets)
    ends = np.repeat(offsets[1:], counts)
    place = np.arange(len(words))
    chosen = place + size <= ends
    short = (counts > 0) & (counts < size)
    chosen[offsets[:-1][short]] = True
    start = np.flatnonzero(chosen)
    last = ends[start]
    total = np.zeros(len(start), dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(size, dtype=np.uint64)])
    for k in range(size):
        salt = np.uint64((0xD1342543DE82EF95 * (2 * k + 1)) & MASK)
        total += np.where(start + k < last, mix(padded[start + k] + salt), salt)
    per_text = np.where(short, 1, np.maximum(counts - size + 1, 0))
    return mix(total), np.concatenate([[0], np.cumsum(per_text)])
