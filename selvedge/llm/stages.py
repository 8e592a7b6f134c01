"""Stages of the corpus pipeline; each keeps the columns of documents, and the last brings its order too.

Every stage judges rows, not ids: rows are numbered as they are read, so rows without an id, unlike texts under one id
and columns of any name are all told apart. Defined for all: a null text counts as empty; an empty table stays empty;
further columns are carried along, whatever their names; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.llm import decontaminate as leaks
from selvedge.llm import mixing, neardup, secrets
from selvedge.llm import quality_rules as rules
from selvedge.session import stage


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and its column's name.

    A stage is given files that were written before and do not change, so a row's place in the scan, its task and its
    place there, is the same whenever it is read, also by a task that runs again.
    """
    name = "row"
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; rows are judged one by one, so repeated rows stay or go together."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (similarity 0.8, five words): that with the least id, one without an id last.

    Of rows of a group that share that id the first as read stays. Texts without words are linked with nothing and stay.
    """
    rows, row = numbered(docs)
    groups = neardup.near_duplicates(rows, row).select(row, "component_id")
    named = groups.join(rows.select(row, F.col("doc_id").alias("_named")), row)
    first = F.min(F.struct(F.col("_named").isNull().alias("unnamed"), F.col("_named").alias("id"), F.col(row).alias("row")))
    kept = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias(row))
    return rows.join(stage(kept, "kept"), row, "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark; each copy of a row that does goes."""
    rows, row = numbered(docs)
    found = leaks.find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row).select(row).distinct()
    return rows.join(stage(found, "leaking"), row, "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each secret replaced by its kind in brackets; ``n_chars`` follows the text. A null text stays null."""
    found = secrets.scan_secrets(docs)
    text = secrets.redact(F.col("_row.text"), F.col("spans"))
    cleaned = found.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training set in training order: a row, with its cleaned text, for each pass over a document.

    Rows lie in files by ``place`` and sorted by it. Documents are weighed by their white-space words, not by the tokens
    of a vocabulary. A document without words is drawn once, whatever its source.
    """
    rows, row = numbered(docs)
    drawn = mixing.mix_sources(rows, row).select(row, "pass", "n_tokens", "block", "place")
    own = [c for c in docs.columns if c not in ("pass", "n_tokens", "block", "place")]
    whole = drawn.join(rows.select(row, *own), row)
    return whole.repartitionByRange("place").sortWithinPartitions("place").select(*own, "pass", "n_tokens", "block", "place")
