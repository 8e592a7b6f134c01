"""Named tables and evolving folders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def write_table(df: DataFrame, name: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Replace a table, schema included, or add to it."""
    df.write.format("parquet").mode(mode).partitionBy(*partition_by).saveAsTable(name)


def snapshot_copy(spark: SparkSession, source: str, target: str) -> None:
    """Create or replace ``target`` as a copy of ``source``."""
    write_table(read_table(spark, source), target)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})


def append_evolving(df: DataFrame, path: str) -> None:
    """Add rows to a folder; columns the folder has not seen simply begin here."""
    df.write.mode("append").parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """A folder under the union of its files' columns; rows older than a column have NULL in it."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """The rows a delete leaves: those for which the condition is not true, NULL included."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


LIVE = "_live"


def write_days(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """A folder cut by ``partition_by`` whose partitions can be rewritten one by one; rows carry a mark that they are there."""
    df.withColumn(LIVE, F.lit(True)).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(LIVE).drop(LIVE)


def _among(columns: Sequence[str], parts: Sequence[Row]) -> Column:
    """Whether a row is of one of the partitions; literals, so that the scan opens no other."""
    if len(columns) == 1:
        values = [r[0] for r in parts]
        listed = F.col(columns[0]).isin(*[v for v in values if v is not None])
        return listed | F.col(columns[0]).isNull() if None in values else listed
    each = [reduce(and_, [F.col(c).eqNullSafe(F.lit(r[c])) for c in columns]) for r in parts]
    return reduce(or_, each)


def touched_days(df: DataFrame, partition_by: Sequence[str]) -> list[Row]:
    """The partitions that rows of ``df`` are of: one entry a partition, on the driver like every listing of them."""
    return df.select(*partition_by).distinct().collect()


def days_of(df: DataFrame, parts: Sequence[Row], partition_by: Sequence[str]) -> DataFrame:
    return df.filter(_among(partition_by, parts)) if parts else df.limit(0)


def replace_days(df: DataFrame, parts: Sequence[Row], path: str, partition_by: Sequence[str]) -> None:
    """Put ``df`` in the place of the partitions ``parts``; no other is written.

    Every one of them gets a row that is not there, so one that keeps nothing is replaced too. Files of the old
    partitions go when the job commits; until then readers, this job among them, see them.
    """
    if not parts:
        return
    kinds = T.StructType([df.schema[c] for c in partition_by])
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name not in partition_by]
    marks = df.sparkSession.createDataFrame([tuple(r[c] for c in partition_by) for r in parts], kinds)
    rows = df.withColumn(LIVE, F.lit(True)).unionByName(marks.select(*partition_by, *blank, F.lit(False).alias(LIVE)))
    spread = rows.hint("rebalance", *[F.col(c) for c in partition_by])
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def delete_days(spark: SparkSession, path: str, condition: Column, partition_by: Sequence[str]) -> None:
    """Delete the rows for which ``condition`` is true: partitions without such a row keep their files.

    Reads the whole folder for the condition's columns, and in full only the partitions that hold a match.
    """
    there = read_days(spark, path)
    parts = touched_days(there.filter(condition), partition_by)
    replace_days(delete_where(days_of(there, parts, partition_by), condition), parts, path, partition_by)


def row_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that left and rows that came, with how many copies of each; equal rows meet as counts."""
    columns = before.columns
    both = before.select("*", F.lit(-1).alias("_n")).unionByName(after.select("*", F.lit(1).alias("_n")))
    change = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    kind = F.when(F.col("_n") > 0, F.lit("added")).otherwise(F.lit("removed"))
    return change.select(kind.alias("change"), F.abs("_n").alias("copies"), *columns)
