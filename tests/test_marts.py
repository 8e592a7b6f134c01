from datetime import date, timedelta

import pytest
from conftest import rows

from selvedge.plans import marts, storefront

LAST = date(2026, 8, 28)


@pytest.fixture(scope="module")
def lake(spark):
    product = "sku string, style_id string, style_name string, category string, subcategory string, colour string, size string, season string, cost_price double, retail_price double, launch_date date"
    make = lambda sku, style, size, colour="Navy": (
        sku, style, style + " name", "Tops", "Shirt", colour, size, "SS26", 40.0, 100.0, LAST - timedelta(days=30)
    )
    products = spark.createDataFrame(
        [make("a-s", "A", "S"), make("a-m", "A", "M"), make("a-l", "A", "L"), make("b-os", "B", "OS", "Olive")], product
    )
    stores = spark.createDataFrame(
        [("1", "One", "X", "N", "retail"), ("2", "Two", "Y", "N", "online")],
        "store_id string, store_name string, city string, region string, channel string",
    )
    sale = "transaction_id string, sku string, store_id string, sale_date date, quantity int, unit_price double, list_price double, discount_pct double, gross_amount double, discount_amount double, net_amount double, kept_quantity bigint, net_revenue double"

    def sold(txn, sku, store, back, quantity, discount=0.0, kept=None):
        kept = quantity if kept is None else kept
        price = 100.0 * (1 - discount)
        return (
            txn, sku, store, LAST - timedelta(days=back), quantity, price, 100.0, discount, 100.0 * quantity,
            (100.0 - price) * quantity, price * quantity, kept, price * kept,
        )

    sales = spark.createDataFrame(
        [
            sold("t1", "a-s", "1", 0, 7),
            sold("t1", "a-m", "1", 0, 3, 0.5),
            sold("t2", "a-m", "2", 14, 7),
            sold("t3", "a-m", "1", 15, 100, kept=90),
            sold("t4", "b-os", "9", 1, 5),
            sold("t5", "zzz", "1", 1, 5),
        ],
        sale,
    )
    returns = spark.createDataFrame(
        [("a-m", "fit", 10, 4), ("a-m", "size", 2, 3), ("a-s", "fit", 1, None)],
        "sku string, reason string, quantity int, days_to_return int",
    )
    inventory = spark.createDataFrame(
        [
            (LAST, "a-s", "1", 10, 0),
            (LAST, "a-m", "1", 0, 5),
            (LAST, "a-l", "1", 30, 5),
            (LAST, "a-m", "2", 50, 5),
            (LAST - timedelta(days=1), "a-s", "1", 999, 0),
        ],
        "snapshot_date date, sku string, store_id string, on_hand int, on_order int",
    )
    return products, stores, sales, returns, inventory


def test_daily_sales_drops_unknown_stores_and_counts_transactions_once(lake):
    products, stores, sales, _, _ = lake
    got = {(r["sale_date"], r["channel"]): r for r in marts.daily_sales(sales, products, stores).collect()}
    assert set(got) == {(LAST, "retail"), (LAST - timedelta(14), "online"), (LAST - timedelta(15), "retail")}
    today = got[LAST, "retail"]
    assert (today["units_sold"], today["transactions"], today["gross_amount"], today["net_revenue"]) == (10, 1, 1000.0, 850.0)
    assert (today["cost_of_goods"], today["margin_amount"], today["margin_pct"], today["discount_pct"]) == (400.0, 450.0, 52.9, 15.0)


def test_sell_rate_divides_fifteen_dates_by_fourteen(lake):
    _, _, sales, _, inventory = lake
    got = {(r["sku"], r["store_id"]): r["daily_sell_rate"] for r in marts.sell_rate(sales, inventory).collect()}
    assert got["a-s", "1"] == 0.5 and got["a-m", "2"] == 0.5
    assert got["a-m", "1"] == pytest.approx(3 / 14)


def test_inventory_health(lake):
    products, stores, sales, _, inventory = lake
    health = marts.inventory_health(sales, inventory, products, stores)
    got = {(r["sku"], r["store_id"]): (r["status"], r["days_of_cover"], r["stock_value"]) for r in health.collect()}
    assert got == {
        ("a-s", "1"): ("low", 20.0, 1000.0),
        ("a-m", "1"): ("stockout", 0.0, 0.0),
        ("a-l", "1"): ("dead", None, 3000.0),
        ("a-m", "2"): ("overstock", 100.0, 5000.0),
    }
    assert rows(storefront.inventory_by_status(health)) == [
        ("stockout", 1, 0.0), ("low", 1, 1000.0), ("overstock", 1, 5000.0), ("dead", 1, 3000.0),
    ]


def test_size_curve_leaves_out_unsold_sizes_and_one_size(lake):
    products, stores, sales, _, inventory = lake
    curve = marts.size_curve(sales, inventory, products, stores)
    got = {r["size"]: (r["demand_share"], r["stock_share"], r["signal"]) for r in curve.collect()}
    assert got == {"S": (6.0, 16.7, "over-stocked"), "M": (94.0, 83.3, "under-stocked")}
    assert storefront.worst_size_style(curve).first()["style_id"] == "A"


def test_catalogues_keep_unsold_products(lake):
    products, _, sales, returns, inventory = lake
    catalog = marts.product_catalog(sales, returns, inventory, products)
    got = {r["sku"]: r for r in catalog.collect()}
    assert set(got) == {"a-s", "a-m", "a-l", "b-os"}
    assert (got["a-l"]["units_sold"], got["a-l"]["return_rate_pct"], got["a-l"]["current_price"]) == (0, 0.0, 75.0)
    assert (got["a-m"]["units_sold"], got["a-m"]["on_hand"], got["a-m"]["return_rate_pct"]) == (110, 50, 10.9)
    styles = {r["product_id"]: r for r in marts.style_catalog(catalog, sales).collect()}
    a = styles["A-NAV"]
    assert (a["sizes_all"], a["sizes_in_stock"], a["in_stock"], a["is_new"], a["popularity_rank"]) == (
        ["S", "M", "L"], ["S", "M", "L"], True, True, 1,
    )
    b = styles["B-OLI"]
    assert (b["sizes_all"], b["sizes_in_stock"], b["in_stock"], b["popularity_rank"]) == (["OS"], [], False, 2)


def test_top_products_and_returns(lake):
    products, stores, sales, returns, _ = lake
    top = marts.top_products(sales, returns, products, stores).collect()
    assert [(r["style_id"], r["units_sold"], r["returned_units"], r["revenue_rank"]) for r in top] == [("A", 117, 13, 1)]
    assert (top[0]["avg_discount_pct"], top[0]["sku_count"]) == (12.5, 2)
    analysis = marts.returns_analysis(sales, returns, products, stores)
    got = {r["reason"]: (r["returned_units"], r["avg_days_to_return"], r["return_rate_pct"]) for r in analysis.collect()}
    assert got == {"fit": (11, 4.0, 9.4), "size": (2, 3.0, 1.71)}
    assert rows(storefront.fit_note(analysis)) == [("Tops", "fit", 11, 85.0, True)]


def styles(spark):
    columns = "product_id string, category string, colour string, list_price double, current_price double, in_stock boolean, is_new boolean, units_sold int, sizes_in_stock array<string>, sizes_all array<string>"
    data = [
        ("p1", "Tops", "Navy", 100.0, 100.0, False, True, 40, [], ["S", "M"]),
        ("p2", "Tops", "Navy", 100.0, 60.0, True, False, 30, ["M"], ["M", "XL"]),
        ("p3", "Shoes", "Olive", 200.0, 199.5, True, True, 20, ["40"], ["38", "40"]),
        ("p4", "Tops", "Olive", 90.0, 50.0, True, False, 10, ["OS"], ["OS"]),
    ]
    return spark.createDataFrame(data, columns)


@pytest.mark.parametrize(
    "sort,order",
    [
        ("featured", ["p2", "p3", "p4", "p1"]),
        ("new", ["p1", "p3", "p2", "p4"]),
        ("price-low", ["p4", "p2", "p1", "p3"]),
        ("price-high", ["p3", "p1", "p2", "p4"]),
        ("discount", ["p2", "p4", "p3", "p1"]),
    ],
)
def test_listing_sorts(spark, sort, order):
    assert [r["product_id"] for r in storefront.list_styles(styles(spark), sort).collect()] == order


def test_listing_filters_facets_and_shelves(spark):
    s = styles(spark)
    pick = lambda **f: {r["product_id"] for r in storefront.list_styles(s, **f).collect()}
    assert pick(category="Tops") == {"p1", "p2", "p4"}
    assert pick(size="M") == {"p2"} and pick(sale=True) == {"p2", "p4"} and pick(colour="Olive", category="Tops") == {"p4"}
    with pytest.raises(ValueError):
        storefront.list_styles(s, "random")
    assert [(r["facet"], r["value"]) for r in storefront.facets(s).collect()] == [
        ("colour", "Navy"), ("colour", "Olive"),
        ("size", "OS"), ("size", "S"), ("size", "M"), ("size", "XL"), ("size", "38"), ("size", "40"),
    ]
    assert sorted(rows(storefront.shelves(s))) == [
        ("new_in", 1, "p3"), ("reduced", 1, "p2"), ("reduced", 2, "p4"),
        ("trending", 1, "p2"), ("trending", 2, "p3"), ("trending", 3, "p4"),
    ]
    assert rows(storefront.styles_per_category(s)) == [("Shoes", 1), ("Tops", 3)]


def test_kpis_cover_the_days_asked_for(spark):
    columns = "sale_date date, category string, net_revenue double, margin_amount double, units_sold bigint, gross_amount double, discount_amount double, transactions bigint"
    data = [
        (LAST, "Tops", 100.0, 50.0, 2, 110.0, 10.0, 1),
        (LAST, "Shoes", 0.0, 0.0, 1, 0.0, 0.0, 1),
        (LAST - timedelta(days=7), "Tops", 300.0, 50.0, 3, 310.0, 10.0, 2),
        (LAST - timedelta(days=8), "Tops", 999.0, 1.0, 1, 1.0, 1.0, 1),
    ]
    daily = spark.createDataFrame(data, columns)
    assert rows(storefront.kpis(daily, 7)) == [(400.0, 25.0, 6, 4.8, 4)]
    assert [r["net_revenue"] for r in storefront.trend(daily, 7).collect()] == [300.0, 100.0]
    assert rows(storefront.revenue_by_category(daily, 0)) == [("Tops", 100.0), ("Shoes", 0.0)]
    only_shoes = storefront.kpis(daily.filter("category = 'Shoes'"), 7).first()
    assert (only_shoes["margin_pct"], only_shoes["discount_pct"]) == (None, None)


def test_daily_sales_count_transactions_beside_their_sums(spark):
    made = [("t1", "a", 1, 5.0), ("t1", "a", 2, 5.0), ("t1", "b", 1, None), ("t2", "a", None, 3.0), (None, "a", 4, 1.0), (None, "a", 4, 1.0)]
    sales = spark.createDataFrame(made, "transaction_id string, sku string, quantity int, net_revenue double").selectExpr(
        "*", "'1' AS store_id", "DATE'2026-08-01' AS sale_date", "cast(quantity as bigint) AS kept_quantity", "6D AS gross_amount",
        "cast(NULL as double) AS discount_amount",
    )
    products = spark.createDataFrame([("a", "x", 2.0), ("b", "y", 1.0)], "sku string, category string, cost_price double")
    stores = spark.createDataFrame([("1", "online")], "store_id string, channel string")
    shown = "category", "units_sold", "units_kept", "gross_amount", "discount_amount", "net_revenue", "cost_of_goods", "transactions"
    got = marts.daily_sales(sales, products, stores).select(*shown)
    assert sorted(tuple(r) for r in got.collect()) == [("x", 11, 11, 30.0, None, 15.0, 22.0, 2), ("y", 1, 1, 6.0, None, None, 1.0, 1)]


def test_good_sales_are_those_the_rules_pass(spark):
    from itertools import product

    from selvedge.operators.quality import passed
    from selvedge.plans import silver

    kinds = product(["a", "z", None], [1, 0, None], [9.0, 12.0, -1.0, None], [10.0, None], [0.1, 0.95, None], [None, "{}"], ["2026-08-01T10:00:00", "never"])
    made = [(f"t{n}", "1", *k) for n, k in enumerate(kinds)]
    bronze = spark.createDataFrame(made, "transaction_id string, store_id string, sku string, quantity int, unit_price double, list_price double, discount_pct double, _rescued_data string, sold_at string")
    products = spark.createDataFrame([("a",), ("a",), (None,)], "sku string")
    told, got = passed(silver.check_sales(bronze, products)), silver.good_sales(bronze, products)
    assert got.columns == told.columns and got.count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, told.collect()))
