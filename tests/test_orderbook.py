from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from selvedge.plans import orderbook as ob
from selvedge.sources import orderbook as tables

START = datetime(2026, 8, 1)


def order(order_id, status="placed", note=None, at=START, email="a@b.c", items=1, total=10.0):
    return (order_id, at, at, "N", email, "", "addr", "city", "1", items, total, 0.0, total, status, "online", note)


def book(spark, *orders):
    return spark.createDataFrame(list(orders), tables.ORDERS)


def line(order_id, line_no, sku, quantity=1):
    return (order_id, line_no, sku, "p", "s", "c", "col", "M", quantity, 1.0, 1.0, 1.0 * quantity)


def test_status_events_fold(spark):
    orders = book(spark, order("1"), order("2", note="old"), order("3"))
    at = lambda h: START + timedelta(hours=h)
    events = spark.createDataFrame(
        [
            ("1", 1, "packed", "first", at(1)),
            ("1", 3, "shipped", "  ", at(2)),
            ("1", 2, "cancelled", None, at(2)),
            ("2", 1, "delivered", None, at(1)),
            ("2", 2, "lost", "nope", at(5)),
            ("9", 1, "packed", None, at(1)),
        ],
        tables.STATUS_EVENTS,
    )
    got = {r["order_id"]: (r["status"], r["note"], r["updated_at"]) for r in ob.apply_status_events(orders, events).collect()}
    assert got == {
        "1": ("shipped", "first", at(2)),
        "2": ("delivered", "old", at(1)),
        "3": ("placed", None, START),
    }
    assert [r["status"] for r in ob.unknown_statuses(events).collect()] == ["lost"]


def test_tracker_and_actions(spark):
    df = spark.createDataFrame([(s,) for s in (*ob.ORDER_STATUSES, "odd")], "status string")
    got = {r[0]: (r[1], r[2]) for r in df.select("status", ob.tracker_stage(F.col("status")), ob.offered_actions(F.col("status"))).collect()}
    assert got == {
        "placed": (0, ["packed", "cancelled"]),
        "packed": (1, ["shipped", "cancelled"]),
        "shipped": (2, ["delivered"]),
        "delivered": (3, []),
        "cancelled": (None, []),
        "odd": (0, []),
    }


def test_conform_customer(spark):
    raw = ("  Ann\t", " " + "e" * 200, None, " 1  High \t Street\n", "c" * 70, "123456789012")
    got = ob.conform_customer(spark.createDataFrame([raw], "name string, email string, phone string, address string, city string, postcode string")).first()
    assert tuple(got) == ("Ann", "e" * 120, None, "1 High Street", "c" * 60, "1234567890")


def test_reads(spark):
    orders = book(
        spark,
        order("1", at=START, email="Ann@X.com", items=2, total=10.4),
        order("2", at=START + timedelta(1), email="ann@x.COM", status="cancelled", total=5.0),
        order("3", at=START + timedelta(2), email="bob@x.com", status="delivered"),
    )
    assert [r["order_id"] for r in ob.orders_by_email(orders, "ANN@x.com").collect()] == ["2", "1"]
    assert ob.orders_by_email(orders, "' OR 1=1 --").count() == 0
    assert [r["order_id"] for r in ob.recent_orders(orders, n=2).collect()] == ["3", "2"]
    assert [r["order_id"] for r in ob.recent_orders(orders, "placed").collect()] == ["1"]
    summary = ob.order_summary(orders)
    assert sorted(rows(summary)) == [("cancelled", 1, 1, 5.0), ("delivered", 1, 1, 10.0), ("placed", 1, 2, 10.0)]
    assert rows(ob.order_rollup(summary)) == [(1, 3, 25.0)]
    assert rows(ob.order_rollup(summary.limit(0))) == [(0, 0, 0.0)]


def test_documents_nest_lines_in_order_and_keep_empty_orders(spark):
    orders = book(spark, order("1"), order("2"))
    lines = spark.createDataFrame([line("1", 2, "b"), line("1", 1, "a"), line("9", 1, "orphan")], tables.ORDER_LINES)
    got = {r["order_id"]: [x["sku"] for x in r["lines"]] for r in ob.order_documents(orders, lines).collect()}
    assert got == {"1": ["a", "b"], "2": []}


def test_long_orders_continue_on_further_pages(spark):
    lines = [line("long", n, f"s{n:03d}") for n in range(1, 36)] + [line("long", 35, "s035")] * 4 + [line("short", 1, "x")]
    frame = spark.createDataFrame(lines, tables.ORDER_LINES)
    got = ob.order_documents(book(spark, order("long"), order("short")), frame, page_lines=10).collect()
    pages = {(r["order_id"], r["page"]): [x["sku"] for x in r["lines"]] for r in got}
    assert sorted(pages) == [("long", 0), ("long", 1), ("long", 2), ("long", 3), ("short", 0)]
    assert [s for p in range(4) for s in pages["long", p]] == [x[2] for x in sorted(lines[:-1], key=lambda x: x[1])]


def test_one_document_by_id(spark):
    orders = book(spark, order("1"), order("2"))
    lines = spark.createDataFrame([line("1", n, f"s{n}") for n in range(1, 1002)] + [line("2", 1, "x")], tables.ORDER_LINES)
    found = ob.order_documents(orders, lines, "1").collect()
    assert sorted((r["page"], len(r["lines"])) for r in found) == [(0, 1000), (1, 1)]
    assert ob.order_documents(orders, lines, "9").count() == 0


@pytest.fixture
def shop(spark):
    catalog = spark.createDataFrame(
        [("a", "p1", 5, 100.0, 80.0), ("b", "p1", 1, 2000.0, 2000.0), ("c", "p2", 0, 10.0, 10.0)],
        "sku string, product_id string, on_hand bigint, list_price double, current_price double",
    )
    orders = book(spark, order("1"), order("2", status="cancelled"))
    lines = spark.createDataFrame(
        [line("1", 1, "a", 2), line("1", 2, "a", 1), line("1", 3, "b", 4), line("2", 1, "a", 5)], tables.ORDER_LINES
    )
    return catalog, ob.reserved_units(orders, lines)


def test_availability(shop):
    catalog, reserved = shop
    assert sorted(rows(reserved)) == [("a", 3), ("b", 4)]
    assert sorted(rows(ob.availability(catalog, reserved))) == [("a", "p1", 2), ("b", "p1", 0), ("c", "p2", 0)]
    asked = catalog.sparkSession.createDataFrame([("b",), ("c",), ("nope",)], "sku string")
    assert sorted(rows(ob.availability_of(catalog, reserved, asked))) == [("b", 0), ("c", 0), ("nope", 0)]
    assert sorted(rows(ob.style_availability(catalog, reserved))) == [("p1", 0, True), ("p2", 0, True)]


def test_bag_prices(spark, shop):
    bags = spark.createDataFrame(
        [(1, "a", 2), (2, "a", 3), (2, "gone", 1), (3, "gone", 1), (4, "b", 2)], "bag_id bigint, sku string, quantity bigint"
    )
    got = {r["bag_id"]: r.asDict() for r in ob.price_bags(bags, *shop).collect()}
    view = lambda n: tuple(got[n][c] for c in ("lines", "items", "subtotal", "delivery", "total", "saved", "short", "to_free_delivery"))
    assert view(1) == (1, 2, 160.0, 149.0, 309.0, 40.0, False, 2839.0)
    assert view(2) == (1, 3, 240.0, 149.0, 389.0, 60.0, True, 2759.0)
    assert view(3) == (0, 0, 0.0, 0.0, 0.0, 0.0, False, 0.0)
    assert view(4) == (1, 2, 4000.0, 0.0, 4000.0, 0.0, True, 0.0)
    lines = {(r["bag_id"], r["sku"]): (r["line_total"], r["available"], r["short"]) for r in ob.bag_lines(bags, *shop).collect()}
    assert lines == {(1, "a"): (160.0, 2, False), (2, "a"): (240.0, 2, True), (4, "b"): (4000.0, 0, True)}


def test_order_book_tables(spark):
    tables.ensure_ops_tables(spark, "ops_test")
    tables.ensure_ops_tables(spark, "ops_test")
    headers = book(spark, order("1", status="ignored"), order("2")).drop("placed_at", "updated_at", "status", "channel", "note")
    lines = spark.createDataFrame([line("1", 1, "a"), line("2", 1, "b")], tables.ORDER_LINES)
    tables.place_orders(headers, lines, "ops_test")
    placed = spark.read.table("ops_test.orders")
    assert {(r["order_id"], r["status"], r["channel"], r["note"]) for r in placed.collect()} == {
        ("1", "placed", "online", None), ("2", "placed", "online", None),
    }
    assert placed.filter("placed_at IS NULL").isEmpty()
    event = spark.createDataFrame([("1", 1, "packed", "x", datetime(2100, 1, 1))], tables.STATUS_EVENTS)
    tables.record_status_events(event, "ops_test")
    now = ob.apply_status_events(placed, spark.read.table("ops_test.status_events"))
    assert {(r["order_id"], r["status"], r["note"]) for r in now.collect()} == {("1", "packed", "x"), ("2", "placed", None)}
    assert spark.read.table("ops_test.order_lines").count() == 2
