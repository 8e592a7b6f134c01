"""The registered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from selvedge.llm import (
    align,
    chat,
    classifier,
    decontaminate,
    exactdup,
    licenses,
    mixing,
    neardup,
    quality_rules,
    secrets,
    tokens,
    warc,
    whiten,
)
from selvedge.session import stage

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), similarity=0.85)


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    base = tuple(r.kind for r in secrets.BASE_RULES)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        *[count(kind) for kind in base],
        F.sha2(secrets.span_text(F.col("spans"), base), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.assess(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def conversation_records(turns: DataFrame) -> DataFrame:
    """Conversations as JSON records in all ten layouts: runs of one to four neighbouring turns, each in one that fits.

    A conversation's runs are of one length. Runs of a user and an assistant, alone or in a pair or behind a system
    turn, take the layouts that have a field for each; others take a list of turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ordered = Window.partitionBy("conv_id").orderBy("turn", role, text)
    place = F.row_number().over(ordered) - 1
    size = F.pmod(F.xxhash64("conv_id"), F.lit(4)) + 1
    numbered = turns.select("conv_id", role.alias("role"), text.alias("text"), place.alias("place"), F.floor(place / size).alias("run"))
    held = F.array_sort(F.collect_list(F.struct("place", "role", "text")))  # four at most
    runs = numbered.groupBy("conv_id", "run").agg(held.alias("held"))
    roles = F.transform("held", lambda x: x["role"])
    said = lambda k: F.col("held")[k]["text"]
    kind = F.pmod(F.xxhash64("conv_id", "run"), F.lit(4))

    def record(**fields: Column) -> Column:
        return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))

    def each(who: str, what: str) -> Column:
        names = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
        own = lambda x: names[x["role"]] if who == "from" else x["role"]
        return F.transform("held", lambda x: F.struct(own(x).alias(who), x["text"].alias(what)))

    is_roles = lambda *asked: roles == F.array(*[F.lit(r) for r in asked])
    pair = F.when(kind == 0, record(prompt=said(0), completion=said(1))).when(kind == 1, record(prompt=said(0), response=said(1)))
    pair = pair.when(kind == 2, record(question=said(0), answer=said(1))).otherwise(record(instruction=said(0), output=said(1)))
    two = F.forall(roles, lambda r: r.isin("user", "assistant"))
    lists = F.when((kind == 1) & two, record(conversations=each("from", "value")))
    lists = lists.when(kind == 2, record(chat=F.struct(each("role", "text").alias("turns"))))
    made = (
        F.when(is_roles("user"), record(prompt=said(0)))
        .when(is_roles("assistant"), record(completion=said(0)))
        .when(is_roles("user", "assistant"), pair)
        .when(is_roles("system", "user", "assistant"), record(instruction=said(0), input=said(1), output=said(2)))
        .otherwise(F.coalesce(lists, record(messages=each("role", "content"))))
    )
    return runs.select("conv_id", "run", made.alias("record"))


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    turns = chat.canonical_turns(conversation_records(given.unionByName(extra)))
    formatted = stage(chat.format_turns(turns), "chat")
    return chat.digest_conversations(formatted, "conv_id", ["run", "part"])


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(table(spark, folder, "pages")).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"
    )


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    base = F.sort_array(F.array_distinct(F.transform("base", lambda x: x["label"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["first"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join("label_list", ",").alias("labels"),
        "score",
    )


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_whiten_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    found = whiten.whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return exactdup.exact_duplicates(table(spark, folder, "documents"))


def op13_align_tokenizers(spark: SparkSession, folder: str) -> DataFrame:
    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align.align_tokenizers(table(spark, folder, "documents"), *files)


def llm_queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_secret_scan": op3_secret_scan,
        "op4_quality_rules": op4_quality_rules,
        "op5_chat_format": op5_chat_format,
        "op6_warc": op6_warc,
        "op7_mix_sources": op7_mix_sources,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_license_scan": op9_license_scan,
        "op10_token_counts": op10_token_counts,
        "op11_whiten_embeddings": op11_whiten_embeddings,
        "op12_exact_duplicates": op12_exact_duplicates,
        "op13_align_tokenizers": op13_align_tokenizers,
    }
