import pytest
from conftest import rows
from pyspark.sql import functions as F

from selvedge.operators.quality import (
    SALES_RULES,
    evaluate_rules,
    passed,
    quarantine,
    quarantine_stats,
    rejected,
    violation_report,
)
from selvedge.plans import silver

SALES = """transaction_id string, sku string, store_id string, sold_at string, quantity int, unit_price double,
list_price double, discount_pct double, _rescued_data string"""
RETURNS = "return_id string, transaction_id string, sku string, returned_at string, quantity int, reason string, _rescued_data string"


def sale(txn="t", sku="a", at="2026-08-10T10:00:00", quantity=1, unit=100.0, listed=100.0, discount=0.0, rescued=None):
    return (txn, sku, "s", at, quantity, unit, listed, discount, rescued)


@pytest.fixture
def products(spark):
    return spark.createDataFrame([("a",), ("a",), ("b",)], "sku string")


def test_null_conditions_pass_unless_asked(spark):
    df = spark.createDataFrame([(None,), (0,), (5,)], "quantity int")
    rules = {"positive_quantity": "quantity > 0"}
    assert [r[1] for r in rows(evaluate_rules(df, rules))] == [[], ["positive_quantity"], []]
    strict = evaluate_rules(df, rules, null_policy="fail")
    assert [r[1] for r in rows(strict)] == [["positive_quantity"], ["positive_quantity"], []]
    with pytest.raises(ValueError):
        evaluate_rules(df, rules, null_policy="maybe")


def test_each_sales_rule_fires_alone_and_in_declared_order(spark, products):
    data = [
        sale("ok"),
        sale("rescued", rescued="{}"),
        sale("sku", sku="zzz"),
        sale("qty", quantity=0),
        sale("price", unit=0.0),
        sale("list", unit=100.2),
        sale("near", unit=100.1),
        sale("disc", discount=0.91),
        sale("neg", discount=-0.1),
        sale("all", sku="zzz", quantity=-1, unit=-1.0, discount=2.0, rescued="{}"),
        sale("unknown", quantity=None),
    ]
    checked = silver.check_sales(spark.createDataFrame(data, SALES), products)
    broken = {r["transaction_id"]: r["_violations"] for r in checked.collect()}
    assert broken == {
        "ok": [],
        "rescued": ["no_rescued_fields"],
        "sku": ["known_sku"],
        "qty": ["positive_quantity"],
        "price": ["positive_price"],
        "list": ["price_not_above_list"],
        "near": [],
        "disc": ["discount_within_bounds"],
        "neg": ["discount_within_bounds"],
        "all": [r for r in SALES_RULES if r != "price_not_above_list"],
        "unknown": [],
    }


def test_unparseable_moment_becomes_null(spark, products):
    df = silver.conform_sales(spark.createDataFrame([sale(at="junk"), sale()], SALES))
    assert [(r["sold_at"] is None, r["sale_date"] is None) for r in df.collect()] == [(True, True), (False, False)]


def test_returns_rules(spark):
    sales = silver.conform_sales(spark.createDataFrame([sale("t1"), sale("t2")], SALES))
    data = [
        ("r1", "t1", "a", "2026-08-12", 1, "fit", None),
        ("r2", "none", "a", "2026-08-12", 1, "fit", None),
        ("r3", "t2", "a", "2026-08-09", 1, "fit", None),
        ("r4", "t2", "a", "2026-08-10", 0, "fit", "{}"),
        ("r5", "t2", "a", "never", 1, "fit", None),
    ]
    checked = silver.check_returns(spark.createDataFrame(data, RETURNS), sales)
    got = {r["return_id"]: (r["_violations"], r["days_to_return"]) for r in checked.collect()}
    assert got == {
        "r1": ([], 2),
        "r2": (["matched_to_sale"], None),
        "r3": (["returned_after_sale"], -1),
        "r4": (["no_rescued_fields", "positive_quantity"], 0),
        "r5": ([], None),
    }


def test_copies_of_a_sale_do_not_multiply_its_returns(spark):
    sales = silver.conform_sales(spark.createDataFrame([sale("t")] * 50, SALES))
    returns = spark.createDataFrame([("r", "t", "a", "2026-08-12", 1, "fit", None)] * 40, RETURNS)
    assert silver.check_returns(returns, sales).count() == 40


def test_net_revenue(spark):
    sales = silver.conform_sales(spark.createDataFrame([sale("t1", quantity=3, unit=10.0), sale("t2")], SALES))
    back = spark.createDataFrame([("t1", 1), ("t1", 1)], "transaction_id string, quantity int")
    got = {
        r["transaction_id"]: (r["returned_quantity"], r["kept_quantity"], r["returned_amount"], r["net_revenue"])
        for r in silver.net_sales(sales, back).collect()
    }
    assert got == {"t1": (2, 1, 20.0, 10.0), "t2": (0, 1, 0.0, 100.0)}


def test_stats_and_report_account_for_every_row(spark, products):
    data = [sale("a"), sale("b", quantity=0), sale("c", quantity=0, unit=-1.0), sale("d")]
    checked = silver.check_sales(spark.createDataFrame(data, SALES), products)
    assert rows(quarantine_stats(checked)) == [(4, 2, 2, 50.0)]
    assert rows(violation_report(rejected(checked))) == [("positive_quantity", 2), ("positive_price", 1)]
    assert rows(quarantine_stats(checked.limit(0))) == [(0, 0, 0, 0.0)]


def test_running_a_batch_again_replaces_its_quarantine(spark, products, tmp_path):
    data = [sale("a"), sale("b", quantity=0)]
    checked = silver.check_sales(spark.createDataFrame(data, SALES), products)
    for _ in range(2):
        kept, bad = quarantine(checked, str(tmp_path / "q"), "bronze.sales", "1")
    assert [r["transaction_id"] for r in kept.collect()] == ["a"]
    assert kept.columns == passed(checked).columns
    assert [(r["transaction_id"], r["_violations"], r["_source_table"]) for r in bad.collect()] == [
        ("b", ["positive_quantity"], "bronze.sales")
    ]
    assert bad.filter(F.col("_quarantined_at").isNull()).isEmpty()


def test_what_is_derived_from_a_sale_does_not_travel_to_the_join(spark):
    from conftest import SMALL

    from selvedge.plans import silver
    from selvedge.plans.adapter import Retail

    given = Retail(spark, SMALL)
    plan = silver.check_sales(given.bronze_sales, given.products)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join LeftOuter", 1)
    assert "gross_amount" in above and "gross_amount" not in below


def test_rules_hold_no_lambda(spark):
    kept = passed(evaluate_rules(spark.createDataFrame([(1,)], "quantity int"), {"positive_quantity": "quantity > 0"}))
    assert "lambda" not in kept._jdf.queryExecution().optimizedPlan().toString()
