"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)
QUERIES, ORACLES = contract.all_queries(), contract.ORACLES
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_an_oracle_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    result = QUERIES[name](spark, SMALL)
    found = canonical([tuple(r) for r in result.collect()], result.columns)
    cursor = sql.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    expected = canonical(cursor.fetchall(), columns)
    assert found == expected
    types = [{type(v) for row in side for v in row[i : i + 1] if v is not None} for side in (found, expected) for i in range(len(columns))]
    assert types[: len(columns)] == types[len(columns) :]


def test_entry_is_the_flagship_query(spark):
    flagship = contract.entry(spark)
    assert {"sale_date", "category", "channel", "net_revenue"} <= set(flagship.columns)
    assert flagship.count() > 0


def test_bags_fold_like_one_pass_over_the_given_events(spark):
    from test_folds import brute

    from selvedge.plans.adapter import Retail

    events = [tuple(r) for r in Retail(spark, SMALL).bag_events.collect()]
    got = sorted(tuple(r) for r in QUERIES["fold_bags"](spark, SMALL).collect())
    assert got == brute(events)


LAZY = (
    "net_sales daily_sales inventory_health returns_analysis size_curve product_catalog top_styles list_styles_featured "
    "list_styles_filtered facets shelves styles_per_category catalogue_bundle order_summary order_documents availability price_bags"
).split()


def test_building_a_read_runs_no_job(spark):
    context = spark.sparkContext
    context.setJobGroup("building", "")
    try:
        for name in LAZY:
            assert QUERIES[name](spark, SMALL).columns
        assert not context.statusTracker().getJobIdsForGroup("building")
    finally:
        context.setJobGroup("rest", "")


def fact_scans(result):
    """Reads of lineitem in the plan that ran; adaptive plans print the one they began with as well."""
    found, skipped = 0, None
    for text in result._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(text) - len(text.lstrip(" :+-|"))
        if skipped is not None and depth > skipped:
            continue
        skipped = depth - 1 if "== Initial Plan ==" in text else None
        found += "FileScan parquet [l_" in text
    return found


@pytest.mark.parametrize("name,most", [("product_catalog", 4), ("style_markdown", 2), ("inventory_health", 3), ("net_sales", 3), ("price_bags", 9)])
def test_facts_are_read_a_few_times_at_most(spark, name, most):
    result = QUERIES[name](spark, SMALL)
    result.collect()
    assert 0 < fact_scans(result) <= most


@pytest.mark.parametrize("name,most", [("bag_lines", 7), ("price_bags", 7)])
def test_bags_are_priced_from_one_catalogue(spark, name, most):
    result = QUERIES[name](spark, SMALL)
    result.collect()
    assert 0 < fact_scans(result) <= most


@pytest.mark.parametrize("name", ["late_returns", "late_returns_files"])
def test_late_returns_are_checked_once(spark, monkeypatch, name):
    from selvedge.plans import registry

    read = []
    put = registry.refresh._put_returns
    monkeypatch.setattr(registry.refresh, "_put_returns", lambda returns, *rest: (read.append(fact_scans(returns)), put(returns, *rest)))
    QUERIES[name](spark, SMALL)
    assert read == [0, 0]
