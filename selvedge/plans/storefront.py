"""Reads over the marts: merchandising figures, catalogue listings and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvedge.functions.measures import on_sale, pct_null, size_rank, status_rank
from selvedge.operators.ranking import top_rows
from selvedge.operators.temporal import trailing

# Listing sorts and shelf lengths.
SORTS = ("featured", "new", "price-low", "price-high", "discount")
NEW_IN, TRENDING, REDUCED = 8, 8, 4


def _margin_pct() -> Column:
    return pct_null(F.sum("margin_amount"), F.sum("net_revenue"), 1).alias("margin_pct")


def _revenue() -> Column:
    return F.round(F.sum("net_revenue"), 0).alias("net_revenue")


# --- merchandising ---


def kpis(daily: DataFrame, days: int) -> DataFrame:
    """Headline figures over the last days. Transactions add per-group distinct counts."""
    return trailing(daily, "sale_date", days).agg(
        _revenue(),
        _margin_pct(),
        F.sum("units_sold").alias("units_sold"),
        pct_null(F.sum("discount_amount"), F.sum("gross_amount"), 1).alias("discount_pct"),
        F.sum("transactions").alias("transactions"),
    )


def trend(daily: DataFrame, days: int) -> DataFrame:
    return trailing(daily, "sale_date", days).groupBy("sale_date").agg(_revenue(), _margin_pct()).orderBy("sale_date")


def revenue_by_category(daily: DataFrame, days: int) -> DataFrame:
    rows = trailing(daily, "sale_date", days).groupBy("category").agg(_revenue())
    return rows.orderBy(F.desc("net_revenue"), "category")


def returns_by_reason(analysis: DataFrame) -> DataFrame:
    """Units per reason; the delay is the plain mean of the categories' means."""
    rows = analysis.groupBy("reason").agg(
        F.sum("returned_units").alias("returned_units"),
        F.round(F.avg("avg_days_to_return"), 1).alias("avg_days"),
    )
    return rows.orderBy(F.desc("returned_units"), "reason")


def inventory_by_status(health: DataFrame) -> DataFrame:
    """Lines and stock value per status, in report order."""
    rows = health.groupBy("status").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("stock_value"), 0).alias("stock_value")
    )
    return rows.orderBy(status_rank(F.col("status")))


def top_styles(styles: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` best styles by net revenue; their rank is their place among these ``n``."""
    best = top_rows(styles, [F.desc("net_revenue"), F.asc("style_id")], n, "revenue_rank")
    return best.select(
        "revenue_rank", "style_name", "category", "season", "units_sold", F.round("net_revenue", 0).alias("net_revenue"),
        "margin_amount", "avg_discount_pct", "return_rate_pct",
    ).orderBy("revenue_rank")


def worst_size_style(curve: DataFrame) -> DataFrame:
    """The style whose stock is furthest from its demand in some size."""
    worst = curve.groupBy("style_id").agg(F.max(F.abs("imbalance")).alias("worst_imbalance"))
    return top_rows(worst, [F.desc("worst_imbalance"), F.asc("style_id")], 1)


def size_curve_for_style(curve: DataFrame, style_id: str) -> DataFrame:
    """One style's curve, letter sizes in shop order and all others after them."""
    rows = curve.sparkSession.sql(
        "SELECT size, demand_share, stock_share, signal FROM {curve} WHERE style_id = :style",
        args={"style": style_id},
        curve=curve,
    )
    return rows.orderBy(size_rank(F.col("size"), numeric=False, other=6), "size")


def inventory_lines(health: DataFrame, status: str | None = None, n: int = 200) -> DataFrame:
    """The most valuable stock lines, of one status or of all."""
    rows = health if status is None else health.filter(F.col("status") == status)
    order = [F.desc("stock_value"), F.asc("sku"), F.asc("store_id")]
    return top_rows(rows, order, n).select(
        "sku", "style_name", "category", "colour", "size", "store_name", "city", "on_hand", "on_order",
        "daily_sell_rate", "days_of_cover", "status", "stock_value",
    )


# --- catalogue ---


def _listing_order(sort: str) -> list[Column]:
    popular, current = [F.desc("units_sold"), F.asc("product_id")], F.coalesce("current_price", F.lit(0.0))
    markdown = F.coalesce("list_price", F.lit(0.0)) - current
    leading = {
        "featured": [F.desc("in_stock"), *popular],
        "new": [F.desc("is_new"), *popular],
        "price-low": [current.asc()],
        "price-high": [current.desc()],
        "discount": [markdown.desc()],
    }
    if sort not in leading:
        raise ValueError(f"sort must be one of {SORTS}, not {sort!r}")
    return [*leading[sort], F.asc("product_id")]


def filter_styles(
    styles: DataFrame, category: str | None = None, colour: str | None = None, size: str | None = None, sale: bool = False
) -> DataFrame:
    """Styles matching every given facet; a size must be in stock to match."""
    if category:
        styles = styles.filter(F.col("category") == category)
    if colour:
        styles = styles.filter(F.col("colour") == colour)
    if size:
        styles = styles.filter(F.array_contains("sizes_in_stock", size))
    if sale:
        styles = styles.filter(on_sale(F.col("list_price"), F.col("current_price")))
    return styles


def list_styles(styles: DataFrame, sort: str = "featured", **facets) -> DataFrame:
    """A sorted catalogue page: all matching styles, ties by product."""
    return filter_styles(styles, **facets).orderBy(*_listing_order(sort))


def facets(listing: DataFrame) -> DataFrame:
    """The sizes and colours present in a listing, each in display order (``place`` sorts them).

    One pass: every style contributes its few facet values, which are deduplicated on the map side.
    """
    sizes = F.transform("sizes_all", lambda s: F.struct(F.lit("size").alias("facet"), s.alias("value")))
    colour = F.array(F.struct(F.lit("colour").alias("facet"), F.col("colour").alias("value")))
    found = listing.select(F.inline(F.concat(sizes, colour))).distinct()
    place = F.when(F.col("facet") == "size", size_rank(F.col("value"))).otherwise(F.lit(0))
    return found.withColumn("place", place.cast("bigint")).orderBy("facet", "place", "value")


def shelves(styles: DataFrame) -> DataFrame:
    """The home page: new in, trending, and the largest reductions, all in stock.

    One pass over the styles: each goes to the shelves it fits, and every task keeps only a shelf's best.
    """
    was, now = F.col("list_price"), F.col("current_price")
    # What puts a style on each shelf, and its weight there before popularity.
    shelf = F.filter(
        F.array(
            F.struct(F.lit("new_in").alias("name"), F.lit(NEW_IN).alias("places"), F.col("is_new").alias("fits"), F.lit(0.0).alias("weight")),
            F.struct(F.lit("trending").alias("name"), F.lit(TRENDING).alias("places"), F.lit(True).alias("fits"), F.lit(0.0).alias("weight")),
            F.struct(F.lit("reduced").alias("name"), F.lit(REDUCED).alias("places"), on_sale(was, now).alias("fits"), (was - now).alias("weight")),
        ),
        lambda s: s["fits"],
    )
    shown = styles.filter("in_stock").select("product_id", "units_sold", F.explode(shelf).alias("s"))
    best = Window.partitionBy("s.name").orderBy(F.desc("s.weight"), F.desc("units_sold"), F.asc("product_id"))
    top = shown.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= max(NEW_IN, TRENDING, REDUCED))
    return top.filter(F.col("position") <= F.col("s.places")).select(
        F.col("s.name").alias("shelf"), F.col("position").cast("bigint").alias("position"), "product_id"
    )


def styles_per_category(styles: DataFrame) -> DataFrame:
    return styles.groupBy("category").agg(F.count(F.lit(1)).alias("styles")).orderBy("category")


def catalogue_values(styles: DataFrame, column: str) -> DataFrame:
    """The distinct categories, colours or the like, sorted."""
    return styles.select(column).distinct().orderBy(column)


def catalogue_bundle(styles: DataFrame) -> DataFrame:
    """Everything a product page shows: its SKUs in size order (``colourways(..., with_skus=True)``) and its style's
    other colours, best seller first.

    Both arrays hold what one style offers, a handful of sizes and colours.
    """
    colour = F.struct((-F.col("units_sold")).alias("units"), "product_id")
    ways = F.array_sort(F.collect_list(colour).over(Window.partitionBy("style_id")))
    return styles.withColumn("colourways", ways.getField("product_id"))


def fit_note(analysis: DataFrame) -> DataFrame:
    """The main reason each category comes back, and its share of that category's returns.

    ``take_larger`` marks the reasons a shopper can act on by sizing up.
    """
    first = F.struct(-F.col("returned_units"), F.col("reason"))
    main = F.min_by(F.struct("reason", "returned_units"), first)
    rows = analysis.groupBy("category").agg(main.alias("main"), F.sum("returned_units").alias("total"))
    share = F.round(F.col("main.returned_units") / F.nullif("total", F.lit(0)) * 100, 0)
    return rows.select(
        "category",
        F.col("main.reason").alias("reason"),
        F.col("main.returned_units").alias("returned_units"),
        share.alias("share"),
        F.col("main.reason").isin("size", "fit").alias("take_larger"),
    )
