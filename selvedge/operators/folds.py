"""The shopping bag as a fold over its ordered events.

The outcome depends on order: a line enters only while the bag has room, so a removal decides whether a later SKU
fits. A bag's events are therefore read by one task in the order they happened, as a stream: what is held is one
bag's lines, never its events, and copies of an event combine before the shuffle. ``streaming.bags`` keeps the same
fold as a live stream, where a busy bag costs each micro-batch its new events only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The helpers below travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Limits of a bag.
MAX_LINES = 20
MAX_QUANTITY = 10

ORDER = ["bag_id", "at", "seq", "sku", "op", "quantity"]
_ROWS_PER_FRAME = 10_000


def conform_events(events: DataFrame) -> DataFrame:
    """Bag events row by row: quantities clamped, setting zero is removing; events without a bag or SKU, and other
    operations, go."""
    asked = F.greatest(F.lit(0), F.least(F.lit(MAX_QUANTITY), F.coalesce("quantity", F.lit(0))))
    removes = (F.col("op") == "remove") | ((F.col("op") == "set") & (asked == 0))
    quantity = F.when(removes, 0).when(F.col("op") == "add", F.greatest(F.lit(1), asked)).otherwise(asked)
    named = F.col("bag_id").isNotNull() & (F.col("sku") != "")
    return events.filter(F.col("op").isin("add", "set", "remove") & named).select(
        "bag_id",
        "at",
        F.col("seq").cast("bigint").alias("seq"),
        "sku",
        F.when(removes, F.lit("remove")).otherwise(F.col("op")).alias("op"),
        quantity.cast("bigint").alias("quantity"),
    )


def _merge_copies(events: DataFrame) -> DataFrame:
    """Copies share their place in the order: adding one quantity several times is adding their sum, the rest is done
    by the first."""
    merged = events.groupBy(*ORDER).agg(F.count(F.lit(1)).alias("copies"))
    total = F.least(F.lit(MAX_QUANTITY), F.col("quantity") * F.least(F.col("copies"), F.lit(MAX_QUANTITY)))
    added = F.when(F.col("op") == "add", total).otherwise(F.col("quantity"))
    return merged.select(*ORDER[:-1], added.cast("bigint").alias("quantity"))


def _held(state: DataFrame, events: DataFrame) -> DataFrame:
    """An earlier result as the adds it consists of, before any event."""
    return state.select(
        "bag_id",
        F.lit(None).cast(events.schema["at"].dataType).alias("at"),
        F.col("line_no").cast("bigint").alias("seq"),
        "sku",
        F.lit("add").alias("op"),
        F.col("quantity").cast("bigint").alias("quantity"),
    )


def apply_event(lines: dict[str, int], op: str, sku: str, quantity: int, max_lines: int) -> None:
    """One conformed event on a bag's lines, which keep the order they entered in."""
    if op == "remove":
        lines.pop(sku, None)
    elif sku in lines:
        lines[sku] = min(MAX_QUANTITY, lines[sku] + quantity) if op == "add" else quantity
    elif op == "add" and len(lines) < max_lines:
        lines[sku] = quantity


def fold_bags(events: DataFrame, state: DataFrame | None = None, max_lines: int = MAX_LINES) -> DataFrame:
    """The lines of every bag after its events, in the order they entered.

    ``add`` accumulates up to ten of a SKU, ``set`` replaces the quantity of a line that is
    there, ``remove`` (or setting zero) drops it. A full bag ignores further SKUs. ``state``
    is an earlier result to continue from.
    """
    ready = _merge_copies(conform_events(events))
    if state is not None:
        ready = _held(state, events).unionByName(ready)
    columns = ["bag_id", "line_no", "sku", "quantity"]

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
        out: list = []
        bag, lines = None, {}

        def close() -> None:
            out.extend((bag, n, sku, quantity) for n, (sku, quantity) in enumerate(lines.items(), 1))

        def batch() -> pa.RecordBatch:
            values = list(zip(*out, strict=True)) or [()] * len(columns)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], columns)

        for frame in frames:
            kinds[0] = frame.schema.field("bag_id").type
            wanted = ["bag_id", "op", "sku", "quantity"]
            for owner, op, sku, quantity in zip(*(frame.column(c).to_pylist() for c in wanted), strict=True):
                if owner != bag:
                    close()
                    bag, lines = owner, {}
                apply_event(lines, op, sku, quantity, max_lines)
            if len(out) >= _ROWS_PER_FRAME:
                yield batch()
                out = []
        close()
        if out:
            yield batch()

    bag_type = ready.schema["bag_id"].dataType.simpleString()
    ordered = ready.repartition("bag_id").sortWithinPartitions(*ORDER)
    return ordered.mapInArrow(fold, schema=f"bag_id {bag_type}, line_no bigint, sku string, quantity bigint")
