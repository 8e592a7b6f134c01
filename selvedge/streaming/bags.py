"""The shopping bag as a live stream: each bag's lines are keyed state, settled by an event-time timer.

Events come out of order. Those that a still earlier one may precede wait in the bag's state; once the watermark has
passed the moment of a waiting event it is applied to the settled lines, in order, and forgotten: when the bag is
touched next, or when its timer goes off. A bag has one timer at a time, set to its newest waiting event, so it costs a
micro-batch one reading of its state, however many events wait. After each micro-batch that touches a bag, the bag is
shown as all events seen so far leave it: settled lines, then the waiting events. Events older than the watermark are
dropped, as Spark does.

State of a bag is bounded: at most ``max_lines`` lines, the events of one watermark delay and those of the micro-batch
that brought the newest of them. The fold is that of ``operators.folds``, and its result is the same as long as nothing
comes later than the delay.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from selvedge.operators.folds import MAX_LINES, apply_event, conform_events

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENTS = "bag_id BIGINT, at TIMESTAMP, seq BIGINT, op STRING, sku STRING, quantity INT"
_SHOWN = "bag_id bigint, lines array<struct<sku:string,quantity:bigint>>"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _place(event: Row) -> tuple:
    return tuple((value is not None, value) for value in (event.micros, event.seq, event.sku, event.op, event.quantity))


class BagProcessor(StatefulProcessor):
    """Keyed state of one bag: ``lines`` settled so far, and the events ``waiting`` for the watermark."""

    def __init__(self, max_lines: int = MAX_LINES):
        self.max_lines = max_lines

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getValueState("lines", "skus array<string>, quantities array<bigint>, timer bigint")
        self.waiting = handle.getListState("waiting", "micros bigint, seq bigint, sku string, op string, quantity bigint, millis bigint")

    def _apply(self, lines: dict[str, int], events: list[Row]) -> dict[str, int]:
        for event in sorted(events, key=_place):
            apply_event(lines, event.op, event.sku, event.quantity, self.max_lines)
        return lines

    def _settle(self, timerValues, fresh: list[tuple], fired: int = -1) -> dict[str, int]:
        """The lines after all events seen; those the watermark has passed are settled for good."""
        upto = timerValues.getCurrentWatermarkInMs()
        held = self.lines.get()
        lines, timer = (dict(zip(held[0], held[1], strict=True)), held[2]) if held is not None else ({}, None)
        before = [tuple(e) for e in self.waiting.get()] if held is not None else []
        events = before + fresh
        ripe, rest = ([e for e in events if (e[-1] <= upto) == passed] for passed in (True, False))
        self._apply(lines, [_event(e) for e in ripe])
        due = None if timer is None or timer <= max(upto, fired) else timer
        if rest and due is None:
            due = max(e[-1] for e in rest)
            self.handle.registerTimer(due)
        if ripe or held is None or due != timer:
            self.lines.update((list(lines), list(lines.values()), due))
        if not ripe:
            if fresh:
                self.waiting.appendList(fresh)
        elif rest:
            self.waiting.put(rest)
        elif before:
            self.waiting.clear()
        return self._apply(lines, [_event(e) for e in rest])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [(r.micros, r.seq, r.sku, r.op, r.quantity, r.millis) for r in rows]
        lines = self._settle(timerValues, fresh)
        yield Row(bag_id=key[0], lines=[Row(sku=sku, quantity=quantity) for sku, quantity in lines.items()])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._settle(timerValues, [], expiredTimerInfo.getExpiryTimeInMs())
        return iter(())  # the bag is as it was shown already

    def close(self) -> None:
        pass


def _event(values) -> Row:
    return Row(**dict(zip(("micros", "seq", "sku", "op", "quantity", "millis"), tuple(values), strict=True)))


def bag_stream(events: DataFrame, delay: str, max_lines: int = MAX_LINES) -> DataFrame:
    """(bag_id, lines): each bag that a micro-batch touches, as all its events so far leave it."""
    # A timer is in milliseconds and goes off when nothing of that millisecond can come any more.
    moment = {"micros": F.unix_micros("at"), "millis": F.unix_millis("at") + F.lit(1)}
    timed = conform_events(events).filter(F.col("at").isNotNull()).withWatermark("at", delay).withColumns(moment)
    return timed.groupBy("bag_id").transformWithState(BagProcessor(max_lines), _SHOWN, "Update", "EventTime")


def keep_bags(
    spark: SparkSession, source: str, target: str, checkpoint: str, delay: str, files_per_batch: int = 1_000, max_lines: int = MAX_LINES
) -> DataFrame:
    """Take in the event files that are new since the last run, then stop; returns all bags as they are now.

    Every micro-batch owns one folder of ``target`` and replaces it when retried.
    """
    source, target, checkpoint = (p.rstrip("/") for p in (source, target, checkpoint))
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # the store that keyed state with timers needs
    try:
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        query = (
            bag_stream(events, delay, max_lines)
            .writeStream.foreachBatch(lambda shown, number: shown.write.mode("overwrite").parquet(f"{target}/batch={number}"))
            .option("checkpointLocation", checkpoint)
            .outputMode("update")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)
    return read_bags(spark, target)


def read_bags(spark: SparkSession, target: str) -> DataFrame:
    """(bag_id, line_no, sku, quantity): the newest showing of every bag, combined before the shuffle."""
    try:
        shown = spark.read.schema(f"{_SHOWN}, batch bigint").parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        shown = spark.createDataFrame([], f"{_SHOWN}, batch bigint")
    now = shown.groupBy("bag_id").agg(F.max_by("lines", "batch").alias("lines"))
    return now.select("bag_id", F.posexplode("lines").alias("place", "line")).select(
        "bag_id", (F.col("place") + 1).cast("bigint").alias("line_no"), "line.sku", "line.quantity"
    )
