"""Every corpus query against its SQL, or against brute force where SQL cannot express it."""

import re

import duckdb
import pytest
from conftest import SMALL
from llm_brute import base_licenses, leaks

import corpus_pipeline
from selvedge.llm.oracles import llm_oracles
from selvedge.llm.queries import llm_queries

QUERIES, ORACLES = llm_queries(), llm_oracles()
TABLES = "documents pages benchmark labels conversations"
BY_BRUTE_FORCE = {"op1_decontaminate", "op8_quality_classifier", "op9_license_scan", "op10_token_counts"}
BY_BRUTE_FORCE |= {"op11_whiten_embeddings", "op13_align_tokenizers"}  # in test_llm_dedup_align_whiten


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(sql):
    return dict(sql.execute("SELECT doc_id, text FROM documents").fetchall())


def by_name(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([r[i] for i in order] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def test_each_query_has_sql_or_brute_force():
    assert set(QUERIES) - set(ORACLES) == BY_BRUTE_FORCE
    assert [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    result = QUERIES[name](spark, SMALL)
    cursor = sql.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert by_name([tuple(r) for r in result.collect()], result.columns) == by_name(cursor.fetchall(), columns)


def test_leaks_are_those_that_shared_word_runs_show(spark, sql, texts):
    items = dict(sql.execute("SELECT item_id, text FROM benchmark").fetchall())
    found = QUERIES["op1_decontaminate"](spark, SMALL).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaks(texts, items)


def test_token_counts_equal_the_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for row in QUERIES["op10_token_counts"](spark, SMALL).collect():
        text = texts[row.doc_id]
        tokens = len(library.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), tokens, tokens > 1024)


def test_base_licenses_equal_brute_force(spark, texts):
    for row in QUERIES["op9_license_scan"](spark, SMALL).collect():
        n_words, places = base_licenses(texts[row.doc_id])
        starts = [at for at, _ in places]
        labels = sorted({label for _, label in places})
        assert row.n_words == n_words and row.n_base == len(places)
        assert (row.first_word, row.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert row.base_labels == ",".join(labels) and set(labels) <= set(filter(None, row.labels.split(",")))
        assert 0 <= row.score <= 1


def test_quality_is_right_on_held_out_labels(spark):
    folder = SMALL.replace("sf0.001", "sf0.01")
    label = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect())
    rows = QUERIES["op8_quality_classifier"](spark, folder).collect()
    judged = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(a == b for a, b in judged) >= 0.93 * len(judged)


def test_pipeline_equals_brute_force(spark, sql, texts):
    from llm_brute import near_groups

    items = dict(sql.execute("SELECT item_id, text FROM benchmark").fetchall())
    good = {i for i, kept in sql.execute(f"SELECT doc_id, kept FROM ({ORACLES['op4_quality_rules']})").fetchall() if kept}
    group = near_groups({i: texts[i] for i in good}, 80)
    clean = {i for i in good if group[i] == i}
    clean -= {doc for doc, _ in leaks({i: texts[i] for i in clean}, items)}
    result = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in result} == clean
    assert len({r.place for r in result}) == len(result)


def test_secret_stage_replaces_what_was_found(spark):
    folder = SMALL.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    cleaned = dict(corpus_pipeline.stages.secret_scan(spark, docs, folder).select("doc_id", "text").collect())
    spans = {r.doc_id: r.spans for r in QUERIES["op3_secret_scan"](spark, folder).collect()}
    assert any(spans.values())
    for doc, text in texts.items():
        assert (cleaned[doc] == text) == (not spans[doc])
        assert not re.search("[0-9a-f]{24}", cleaned[doc])
