from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from selvedge.functions import measures as m
from selvedge.functions import report


def values(spark, column, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column).collect()]


def test_stock_ladder_never_calls_unsold_stock_healthy(spark):
    data = [(0, 0.0), (5, 0.0), (5, 1.0), (100, 1.0), (20, 1.0), (50, 1.0), (91, 1.0), (21, 1.0), (7, 1.0)]
    cover = m.days_of_cover(F.col("h"), F.col("r"))
    got = values(spark, m.stock_status(F.col("h"), F.col("r"), cover), data, "h int, r double")
    assert got == ["stockout", "dead", "critical", "overstock", "low", "healthy", "overstock", "healthy", "low"]


def test_cover_is_null_without_sales(spark):
    assert values(spark, m.days_of_cover(F.col("h"), F.col("r")), [(5, 0.0), (5, 2.0)], "h int, r double") == [None, 2.5]


def test_ratios_are_guarded(spark):
    data = [(1.0, 0.0), (1.0, 4.0), (None, 4.0), (1.0, None), (1.0, -2.0)]
    assert values(spark, m.pct(F.col("a"), F.col("b"), 1), data, "a double, b double") == [0.0, 25.0, None, 0.0, 0.0]
    assert values(spark, m.pct_null(F.col("a"), F.col("b"), 1), data, "a double, b double") == [
        None, 25.0, None, None, -50.0,
    ]


def test_rounding_is_half_up_on_the_decimal_text(spark):
    data = [(1.005,), (2.675,), (0.285,), (2.5,), (-2.5,)]
    assert values(spark, F.round("x", 2), data, "x double") == [1.01, 2.68, 0.29, 2.5, -2.5]
    assert values(spark, F.round("x", 0), data, "x double") == [1.0, 3.0, 0.0, 3.0, -3.0]


def test_size_ranks(spark):
    sizes = [("OS",), ("XS",), ("S",), ("M",), ("L",), ("XL",), ("38",), ("43",), ("XXL",)]
    assert values(spark, m.size_rank(F.col("s")), sizes, "s string") == [0, 1, 2, 3, 4, 5, 38, 43, 99]
    tied = m.size_rank(F.col("s"), numeric=False, other=6)
    assert values(spark, tied, sizes, "s string")[-3:] == [6, 6, 6]


def test_size_signal_bounds(spark):
    data = [(-10.1,), (-10.0,), (0.0,), (10.0,), (10.1,)]
    got = values(spark, m.size_signal(F.col("x")), data, "x double")
    assert got == ["under-stocked", "balanced", "balanced", "balanced", "over-stocked"]


def test_shown_discount_hides_small_markdowns_and_rounds_half_even(spark):
    data = [(100.0, 99.0), (100.0, 98.0), (200.0, 175.0), (200.0, 185.0), (None, 5.0)]
    got = values(spark, m.shown_discount(F.col("a"), F.col("b")), data, "a double, b double")
    assert got == [None, 2, 12, 8, None]


def test_available_units_clamp(spark):
    data = [(5, 2), (5, 9), (None, 1), (5, None)]
    assert values(spark, m.available_units(F.col("a"), F.col("b")), data, "a bigint, b bigint") == [3, 0, 0, 5]


def test_mean_of_fixed_ignores_nulls_and_empty(spark):
    df = spark.createDataFrame([(0.05,), (None,), (0.10,)], "d double")
    mean = m.mean_of_fixed(F.sum(m.fixed_point(F.col("d"))), F.count("d"))
    assert df.agg(mean).first()[0] == pytest.approx(0.075)
    assert df.filter("d > 1").agg(mean).first()[0] is None


def test_product_id(spark):
    assert values(spark, m.product_id(F.col("a"), F.col("b")), [("STY0001", "Burgundy")], "a string, b string") == [
        "STY0001-BUR"
    ]


def test_indian_grouping(spark):
    data = [(0.0,), (999.0,), (1000.0,), (123456.0,), (1234567.0,), (-12345678.9,), (None,)]
    assert values(spark, report.rupees(F.col("x")), data, "x double") == [
        "0", "999", "1,000", "1,23,456", "12,34,567", "-1,23,45,678", "0",
    ]
    assert values(spark, report.rupees(F.col("x"), 2), [(1234.5,), (-0.25,)], "x double") == ["1,234.50", "-0.25"]


def test_compact_numbers(spark):
    data = [(950.0,), (1500.0,), (1240000.0,), (25000000.0,), (-1500.0,)]
    assert values(spark, report.compact(F.col("x")), data, "x double") == ["₹950", "₹1.5k", "₹12.4L", "₹2.50Cr", "₹-1.5k"]


def test_text_of_moments_and_percentages(spark):
    data = [(datetime(2026, 9, 12, 14, 30), 12.34), (None, None)]
    df = spark.createDataFrame(data, "t timestamp, p double")
    got = df.select(report.moment_text(F.col("t")), report.day_text(F.col("t")), report.pct_text(F.col("p")))
    assert rows(got) == [("12 Sep, 14:30", "12 Sep", "12.3%"), ("—", "—", "0.0%")]
