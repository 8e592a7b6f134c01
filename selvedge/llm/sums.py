"""Sums of equal-sized matrices that tasks emit, added in two levels, by slices; the driver gets the sum alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES, SALTS = 16, 64
SCHEMA = "slice int, part binary"


def sliced(matrix: np.ndarray) -> pa.RecordBatch:
    """A task's matrix as SLICES rows; empty slices are left out."""
    parts = [(k, p) for k, p in enumerate(np.array_split(matrix.ravel(), SLICES)) if p.any()]
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in parts], pa.int32()), pa.array([p.tobytes() for _, p in parts], pa.binary())], ["slice", "part"]
    )


def total(parts: DataFrame, shape: tuple[int, ...], given: type, kept: type, slices: int = SLICES) -> np.ndarray:
    """The sum of what ``sliced`` emitted; ``shape`` is bounded by the caller, ``given`` is the type of the parts."""
    sizes = [len(p) for p in np.array_split(np.empty(int(np.prod(shape)), dtype=np.int8), slices)]

    def add(kind: type):
        def run(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = keys[0].as_py()
            held = np.zeros(sizes[place], dtype=kept)
            for batch in batches:
                for part in batch.column("part"):
                    held += np.frombuffer(part.as_buffer(), dtype=kind)
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["slice", "part"])

        return run

    salted = parts.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(SALTS)))
    first = salted.groupBy("slice", "salt").applyInArrow(add(given), SCHEMA)
    rows = first.groupBy("slice").applyInArrow(add(kept), SCHEMA).collect()  # a row for each slice, of a bounded size
    found = [np.zeros(size, dtype=kept) for size in sizes]
    for row in rows:
        found[row["slice"]] = np.frombuffer(row["part"], dtype=kept)
    return np.concatenate(found).reshape(shape)
