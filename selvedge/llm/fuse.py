"""Static 8-bit binary fuse filters over 64-bit keys, built and asked in numpy.

A key has three places in three neighbouring segments of a table; the exclusive or of the bytes there is the key's
fingerprint. Places are found by peeling: in rounds, every place that a single key is left in is given to that key;
in reverse order of rounds the bytes can then be set. A key that was put in is always found; another is with a chance
of 1/256. A table takes about 1.13 bytes a key for large sets, and never changes once built.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from selvedge.llm.words import mix

TRIES = 100


@dataclass(frozen=True)
class Fuse:
    seed: int
    length: int  # places in a segment, a power of two
    segments: int  # segments in which a key may begin
    table: np.ndarray


def _geometry(keys: int) -> tuple[int, int]:
    """Places in a segment and segments to begin in, as published for three places a key."""
    size = max(keys, 2)
    length = 1 << min(18, int(math.log(size) / math.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(size))
    return length, max(1, math.ceil(size * factor / length) - 2)


def _places(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    hashed = mix(keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1)))
    first = ((hashed >> np.uint64(32)) * np.uint64(segments * length) >> np.uint64(32)).astype(np.int64)
    low, mask = hashed.astype(np.uint32).astype(np.int64), length - 1
    places = np.stack([first, (first + length) ^ (low >> 16 & mask), (first + 2 * length) ^ (low & mask)], axis=1)
    return places, (mix(hashed + np.uint64(1)) & np.uint64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> Fuse:
    """The filter of distinct 64-bit keys."""
    length, segments = _geometry(len(keys))
    slots = (segments + 2) * length
    for seed in range(TRIES):
        places, prints = _places(keys, seed, length, segments)
        left = np.bincount(places.ravel(), minlength=slots)
        held = np.zeros(slots, dtype=np.int64)
        np.bitwise_xor.at(held, places.ravel(), np.repeat(np.arange(len(keys)), 3))
        rounds, open_at = [], np.flatnonzero(left == 1)
        while len(open_at):
            key, first = np.unique(held[open_at], return_index=True)
            rounds.append((key, open_at[first]))
            touched = places[key].ravel()
            np.subtract.at(left, touched, 1)
            np.bitwise_xor.at(held, touched, np.repeat(key, 3))
            touched = np.unique(touched)
            open_at = touched[left[touched] == 1]
        if sum(len(key) for key, _ in rounds) == len(keys):
            table = np.zeros(slots, dtype=np.uint8)
            for key, own in reversed(rounds):
                table[own] = prints[key] ^ np.bitwise_xor.reduce(table[places[key]], axis=1)
            return Fuse(seed, length, segments, table)
    raise RuntimeError(f"{TRIES} seeds do not peel {len(keys)} keys; are they distinct?")


def holds(fuse: Fuse, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; never false for one that is."""
    places, prints = _places(keys, fuse.seed, fuse.length, fuse.segments)
    return np.bitwise_xor.reduce(fuse.table[places], axis=1) == prints
