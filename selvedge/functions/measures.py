"""Measures, guarded ratios and status ladders as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the stock ladder, size signal and sale display.
CRITICAL_BELOW_DAYS = 7
LOW_BELOW_DAYS = 21
OVERSTOCK_ABOVE_DAYS = 90
IMBALANCE_POINTS = 10
SALE_MARGIN = 1

# Letter sizes in shop order; numeric sizes rank by value, others last.
LETTER_SIZES = ("OS", "XS", "S", "M", "L", "XL")
UNKNOWN_SIZE_RANK = 99

# Stock statuses in report order.
STOCK_STATUSES = ("stockout", "critical", "low", "healthy", "overstock", "dead")


def amount(price: str | Column, units: str | Column) -> Column:
    """Price times units, to the cent."""
    price = F.col(price) if isinstance(price, str) else price
    units = F.col(units) if isinstance(units, str) else units
    return F.round(price * units, 2)


def pct(part: Column, whole: Column, digits: int) -> Column:
    """``part`` as a percentage of ``whole``; zero unless ``whole`` is positive."""
    return F.round(F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0)), digits)


def pct_null(part: Column, whole: Column, digits: int) -> Column:
    """``part`` as a percentage of ``whole``; NULL when ``whole`` is zero."""
    return F.round(part / F.nullif(whole, F.lit(0)) * 100, digits)


def fixed_point(value: Column) -> Column:
    """A fraction as an exact decimal, so that sums do not depend on row order."""
    return value.cast("decimal(38,18)")


def mean_of_fixed(total: Column, rows: Column) -> Column:
    """Mean of fractions summed as :func:`fixed_point`; NULL over no rows."""
    return total.cast("double") / F.nullif(rows, F.lit(0))


def days_of_cover(on_hand: Column, daily_rate: Column) -> Column:
    """Days the stock lasts at the current rate; NULL when nothing sells."""
    return F.when(daily_rate > 0, F.round(on_hand / F.nullif(daily_rate, F.lit(0.0)), 1))


def stock_status(on_hand: Column, daily_rate: Column, cover: Column) -> Column:
    """Stock ladder. Empty shelves and unsold lines are decided before cover, which is NULL for both."""
    return (
        F.when(on_hand == 0, F.lit("stockout"))
        .when(daily_rate <= 0, F.lit("dead"))
        .when(cover < CRITICAL_BELOW_DAYS, F.lit("critical"))
        .when(cover < LOW_BELOW_DAYS, F.lit("low"))
        .when(cover > OVERSTOCK_ABOVE_DAYS, F.lit("overstock"))
        .otherwise(F.lit("healthy"))
    )


def size_signal(imbalance: Column) -> Column:
    """Whether a size holds less, more or about the share of stock its demand calls for."""
    return (
        F.when(imbalance < -IMBALANCE_POINTS, F.lit("under-stocked"))
        .when(imbalance > IMBALANCE_POINTS, F.lit("over-stocked"))
        .otherwise(F.lit("balanced"))
    )


def size_rank(size: Column, numeric: bool = True, other: int = UNKNOWN_SIZE_RANK) -> Column:
    """Position of a size in shop order; with ``numeric=False`` all non-letter sizes tie at ``other``."""
    letters = F.array(*[F.lit(s) for s in LETTER_SIZES])
    letter = F.nullif(F.array_position(letters, size), F.lit(0)) - 1
    number = size.try_cast("int") if numeric else F.lit(None)
    return F.coalesce(letter.cast("int"), number, F.lit(other)).cast("int")


def status_rank(status: Column) -> Column:
    """Position of a stock status in report order."""
    return F.array_position(F.array(*[F.lit(s) for s in STOCK_STATUSES]), status).cast("int")


def product_id(style_id: Column, colour: Column) -> Column:
    """Style plus the colour's first three letters: what a shopper opens as one page."""
    return F.concat_ws("-", style_id, F.upper(F.substring(colour, 1, 3)))


def on_sale(list_price: Column, current_price: Column) -> Column:
    """Marked down by more than the display margin; NULL prices count as zero."""
    return F.coalesce(list_price, F.lit(0.0)) > F.coalesce(current_price, F.lit(0.0)) + SALE_MARGIN


def shown_discount(list_price: Column, current_price: Column) -> Column:
    """The markdown printed on a product card, or NULL when it is too small to show."""
    was, now = F.coalesce(list_price, F.lit(0.0)), F.coalesce(current_price, F.lit(0.0))
    off = (was - now) / F.nullif(was, F.lit(0.0)) * 100
    return F.when(on_sale(list_price, current_price), F.bround(off, 0).cast("bigint"))


def available_units(on_hand: Column, reserved: Column) -> Column:
    """Stock left after open orders, never below zero; unknown stock or reservations count as none."""
    return F.greatest(F.lit(0), F.coalesce(on_hand, F.lit(0)) - F.coalesce(reserved, F.lit(0))).cast("bigint")
