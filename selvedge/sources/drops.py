"""Dated JSON drops: one directory per day under a landing folder, in it one per batch and attempt to land it.

A batch is there when its manifest is: a small file, written last, that names the attempt and its days. Files of an
attempt that stopped before that are never referred to, so landing can be tried again, and whether a batch has landed
is asked of its manifest alone, not of a listing of all that ever landed. One writer lands a batch at a time; of two,
the one that publishes second fails.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_landed/batches"
ENTRY = "batch STRING, attempt STRING, dt STRING"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def landed_batches(spark: SparkSession, path: str, batch_id: str = "*") -> DataFrame:
    """(batch, attempt, dt): what the landing folder's manifests name; a batch without rows has no day."""
    try:
        return spark.read.schema(ENTRY).json(f"{path}/{MANIFESTS}/{batch_id}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def published_paths(path: str, entries: list) -> list[str]:
    """The folders that manifest rows name."""
    return [f"{path}/dt={r['dt']}/batch={r['batch']}/attempt={r['attempt']}" for r in entries if r["dt"] is not None]


def write_lines(
    df: DataFrame, path: str, day: Column, line: Column, batch_id: str, gather: bool = True, compression: str = "none"
) -> None:
    """Write one text line per row into its day's directory, every row, under the batch's name, and publish the batch.

    A batch lands once: a second landing of the same ``batch_id`` is refused, so a rerun cannot bring
    rows in again under new file names, while late rows of a landed day come in as a batch of their
    own. The rebalance splits a heavy day over several files by size. Without ``gather`` no line is moved:
    each task writes its part of every day, for tables whose tasks hold enough of a day for a file.
    """
    if not batch_id or not batch_id.replace("-", "").replace("_", "").isalnum():
        raise ValueError("batch_id takes letters, digits, - and _")
    spark, attempt, days = df.sparkSession, uuid.uuid4().hex, Observation()
    if not landed_batches(spark, path, batch_id).isEmpty():
        raise ValueError(f"batch {batch_id} has landed already")
    dated = F.date_format(day, "yyyy-MM-dd")
    lines = df.select(line.alias("value"), dated.alias("dt"), F.lit(batch_id).alias("batch"), F.lit(attempt).alias("attempt"))
    spread = lines.hint("rebalance", F.col("dt")) if gather else lines
    seen = spread.observe(days, F.collect_set(F.coalesce("dt", F.lit(_NO_DAY))).alias("days"))
    out = seen.write.mode("append").partitionBy("dt", "batch", "attempt")
    out.option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(path)
    entries = [(batch_id, attempt, d) for d in days.get["days"]] or [(batch_id, attempt, None)]
    manifest = spark.createDataFrame(entries, ENTRY).coalesce(1)
    manifest.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/{MANIFESTS}/{batch_id}")


def write_drops(df: DataFrame, path: str, day_col: str, batch_id: str) -> None:
    """Drop a stream as JSON lines by the day of ``day_col``; days without rows get no directory."""
    day = F.col(day_col).cast("date")
    write_lines(df, path, day, F.to_json(F.struct(*df.columns)), batch_id)
