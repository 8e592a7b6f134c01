"""Physical layout: file report and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and length of every data file below ``path``, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return files.load(path).select("path", "length")


def table_detail(spark: SparkSession, path: str) -> DataFrame:
    """File count, total, mean and largest size: the small-files report."""
    return data_files(spark, path).agg(
        F.count(F.lit(1)).alias("num_files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"),
        F.avg("length").alias("avg_bytes"),
        F.coalesce(F.max("length"), F.lit(0)).alias("largest_bytes"),
    )


def compact(spark: SparkSession, source: str, target: str, target_file_bytes: int = 1 << 30) -> DataFrame:
    """Rewrite a folder into as few files as hold it at the target size, dealt out evenly; report the new layout."""
    size = table_detail(spark, source).first()["size_bytes"]
    spark.read.parquet(source).repartition(max(1, -(-size // target_file_bytes))).write.mode("overwrite").parquet(target)
    return table_detail(spark, target)
