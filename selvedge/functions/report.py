"""Report text: Indian digit grouping, lakh and crore, percentages and moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUPEE = "₹"
MISSING = "—"
CRORE, LAKH, THOUSAND = 10_000_000, 100_000, 1_000

# Last three digits form a group, everything above it groups in pairs.
_GROUP_BREAK = r"(?<=\d)(?=(\d{2})*\d{3}$)"


def _number(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def rupees(value: Column, decimals: int = 0) -> Column:
    """12,34,567 style digits. The whole part truncates; shown decimals round half to even."""
    number = _number(value)
    size = F.abs(number)
    whole = F.floor(size)
    text = F.regexp_replace(whole.cast("string"), _GROUP_BREAK, ",")
    if decimals:
        part = F.bround((size - whole) * 10**decimals, 0).cast("bigint")
        text = F.concat(text, F.lit("."), F.format_string(f"%0{decimals}d", part))
    return F.concat(F.when(number < 0, F.lit("-")).otherwise(F.lit("")), text)


def price_text(value: Column) -> Column:
    return F.concat(F.lit(RUPEE), rupees(value))


def compact(value: Column) -> Column:
    """Lakh and crore above a hundred thousand, k above a thousand, plain digits below."""
    number = _number(value)
    size = F.abs(number)

    def scaled(unit: int, digits: int, suffix: str) -> Column:
        return F.format_string(f"{RUPEE}%.{digits}f{suffix}", F.bround(number / unit, digits))

    return (
        F.when(size >= CRORE, scaled(CRORE, 2, "Cr"))
        .when(size >= LAKH, scaled(LAKH, 1, "L"))
        .when(size >= THOUSAND, scaled(THOUSAND, 1, "k"))
        .otherwise(price_text(number))
    )


def count_text(value: Column) -> Column:
    return rupees(F.coalesce(value.try_cast("bigint"), F.lit(0)))


def pct_text(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.bround(_number(value), digits))


def moment_text(value: Column) -> Column:
    """``12 Sep, 14:30``, or a dash when there is no moment."""
    return F.coalesce(F.date_format(value, "dd MMM, HH:mm"), F.lit(MISSING))


def day_text(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "dd MMM"), F.lit(MISSING))
