"""Global ranks, shares of a group and top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES, CELL_SAMPLES = 4_096, 16  # rows drawn for the bounds of cells, and how many of them lie in a cell

Order = Sequence[str]


def sort_columns(order: Order) -> list[Column]:
    """``name`` ascending (nulls first), ``-name`` descending (nulls last)."""
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def _precedes(a: Column, b: Column, order: Order) -> Column:
    """Whether struct ``a`` stands before struct ``b``."""
    before = F.lit(False)
    for c in reversed(order):
        down, name = c.startswith("-"), c.removeprefix("-")
        x, y = a[name], b[name]
        own = (y.isNull() & x.isNotNull()) | (x > y) if down else (x.isNull() & y.isNotNull()) | (x < y)
        before = F.coalesce(own, F.lit(False)) | (x.eqNullSafe(y) & before)
    return before


def global_rank(df: DataFrame, order: Order, name: str) -> DataFrame:
    """``row_number`` over the whole table without pulling it into one task, and without a job while it is built.

    ``order`` must end in a unique key. Rows are cut into cells by bounds in the full order, key included, so ties in
    the leading columns, however many, fall into different cells. The bounds come from one row for each remainder of
    a hash of the order columns, the one with the least hash: the same rows whenever they are drawn. A rank is the
    row's number in its cell plus the rows of the cells before it; bounds and counts are scalar subqueries of a few
    thousand entries at most, whatever the table's size. Rows of equal order share a cell and are numbered arbitrarily.

    Bounds, counts and rows each read ``df``. All columns take part in each, so that a shuffle ``df`` ends in has the
    same plan in all three and is run once.
    """
    names = [c.removeprefix("-") for c in order]
    rest = [c for c in df.columns if c not in names]
    drawn = F.xxhash64(*names)
    picked = df.groupBy(F.pmod(drawn, F.lit(SAMPLES)).alias("_part")).agg(F.min(F.struct(drawn.alias("_hash"), *names, *rest)).alias("_row"))
    sample = F.collect_list(F.struct(*[F.col(f"_row.{c}").alias(c) for c in names]))
    compared = lambda a, b: F.when(_precedes(a, b, order), -1).when(_precedes(b, a, order), 1).otherwise(0)
    ordered = picked.agg(F.array_sort(sample, compared).alias("_rows"))
    bounds = ordered.select(F.filter("_rows", lambda _, k: (k + 1) % CELL_SAMPLES == 0)).scalar()

    # The number of bounds that do not stand after the row, by halving.
    own = F.struct(*names)
    placed = df.withColumns({"_bounds": bounds, "_cell": F.lit(0)})
    step = SAMPLES // CELL_SAMPLES
    while step:
        there = F.col("_cell") + step
        bound = F.try_element_at("_bounds", there)
        placed = placed.withColumn("_cell", F.when(bound.isNotNull() & ~_precedes(own, bound, order), there).otherwise(F.col("_cell")))
        step //= 2
    placed = placed.drop("_bounds")
    # Counts by cell, and for every cell the rows of those before it.
    rows = F.when(F.max(F.struct(*names, *rest)).isNotNull(), F.count(F.lit(1))).alias("rows")
    sizes = placed.groupBy("_cell").agg(rows).agg(F.collect_list(F.struct("_cell", "rows")).alias("_sizes"))
    total = lambda cell: F.aggregate(
        F.filter("_sizes", lambda x: x["_cell"] < cell), F.lit(0).cast("bigint"), lambda t, x: t + x["rows"]
    )
    cells = F.sequence(F.lit(0), F.lit(SAMPLES // CELL_SAMPLES))
    before = F.get(sizes.select(F.transform(cells, total)).scalar(), F.col("_cell"))
    within = F.row_number().over(Window.partitionBy("_cell").orderBy(*sort_columns(order)))
    return placed.withColumn(name, (before + within).cast("bigint")).select(*df.columns, name)


def share_of(value: str, by: str, digits: int, empty: float | None = None) -> Column:
    """Percentage of the group total; ``empty`` for a group whose total is not positive.

    Meant for rows already aggregated to a few per group.
    """
    total = F.sum(value).over(Window.partitionBy(by))
    return F.round(F.when(total > 0, F.col(value) / total * 100).otherwise(F.lit(empty).cast("double")), digits)


def top_rows(df: DataFrame, order: Sequence[Column], n: int, position: str | None = None) -> DataFrame:
    """First ``n`` rows; ``position`` numbers them, over those ``n`` rows only."""
    if n < 0:
        raise ValueError("n must not be negative")
    top = df.orderBy(*order).limit(n)
    if position:
        top = top.withColumn(position, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return top
