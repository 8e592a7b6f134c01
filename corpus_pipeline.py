"""The corpus pipeline: quality rules, near copies, leaked benchmark items, secrets, source mixing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The result of
a stage is written to the shared folder and read again before the next, so a lost executor costs one
stage at most. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from selvedge.llm import stages
from selvedge.session import stage

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stages.quality_rules),
    ("near_dedup", stages.near_dedup),
    ("decontaminate", stages.decontaminate),
    ("secret_scan", stages.secret_scan),
    ("mix_sources", stages.mix_sources),
]

# MinHash, the retrieval of leaks and the components are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
