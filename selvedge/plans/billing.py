"""Cost attribution: usage valued at the list price in force when it was consumed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvedge.operators.temporal import asof_join, interval_join, interval_join_bucketed, latest_per_key

# Fixed value: rupees per dollar used for the approximate figure.
INR_PER_USD = 88

_PRICE_KEYS = ("cloud", "sku_name")
_PRICE_TIMES = ("usage_start_time", "price_start_time", "price_end_time")


def usage_freshness(usage: DataFrame) -> DataFrame:
    """First and last day, rows, distinct SKUs and total quantity."""
    return usage.agg(
        F.min("usage_date").alias("earliest"),
        F.max("usage_date").alias("latest"),
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("sku_name").alias("distinct_skus"),
        F.round(F.sum("usage_quantity"), 3).alias("total_dbus"),
    )


def priced_usage(
    usage: DataFrame, prices: DataFrame, bucket_days: int | None = None, range_days: int | None = None
) -> DataFrame:
    """Usage with its value in dollars; ``bucket_days`` switches to the time-bucketed join, ``range_days`` to the
    as-of join, which needs price rows that do not overlap."""
    if range_days:
        rows = asof_join(usage, prices, _PRICE_KEYS, *_PRICE_TIMES, range_days=range_days)
    elif bucket_days:
        rows = interval_join_bucketed(usage, prices, _PRICE_KEYS, *_PRICE_TIMES, bucket_days=bucket_days)
    else:
        rows = interval_join(usage, prices, _PRICE_KEYS, *_PRICE_TIMES)
    return rows.withColumn("_usd", F.col("usage_quantity") * F.col("pricing.default"))


def _spend(rows: DataFrame, by: Mapping[str, Column], *more: Column) -> DataFrame:
    return rows.groupBy(*[value.alias(name) for name, value in by.items()]).agg(
        *more,
        F.round(F.sum("usage_quantity"), 3).alias("dbus"),
        F.round(F.sum("_usd"), 4).alias("usd"),
    )


def spend_by_day_sku(
    usage: DataFrame,
    prices: DataFrame,
    inr_per_usd: float = INR_PER_USD,
    bucket_days: int | None = None,
    range_days: int | None = None,
) -> DataFrame:
    rupees = F.round(F.sum("_usd") * inr_per_usd, 2).alias("inr_approx")
    by = {c: F.col(c) for c in ("usage_date", "sku_name")}
    rows = _spend(priced_usage(usage, prices, bucket_days, range_days), by, rupees)
    return rows.orderBy(F.desc("usage_date"), F.desc("usd"), "sku_name")


def cost_per_job(usage: DataFrame, prices: DataFrame) -> DataFrame:
    job = F.col("usage_metadata.job_id")
    runs = F.countDistinct("usage_metadata.job_run_id").alias("runs")
    rows = _spend(priced_usage(usage.filter(job.isNotNull()), prices), {"job_id": job}, runs)
    return rows.orderBy(F.desc("usd"), "job_id")


def spend_by_tag(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Spend per purpose, owner and product; spend nobody owns groups under NULL."""
    tags = {name: F.col("custom_tags")[name] for name in ("purpose", "owner")}
    by = {**tags, "billing_origin_product": F.col("billing_origin_product")}
    return _spend(priced_usage(usage, prices), by).orderBy(F.desc("usd"), *by)


def current_clusters(clusters: DataFrame) -> DataFrame:
    """One row per cluster: its newest configuration."""
    columns = ["cluster_id", "cluster_name", "cluster_source", "change_time"]
    return latest_per_key(clusters.select(*columns), ["cluster_id"], ["change_time"]).drop("change_time")


def spend_by_cluster(usage: DataFrame, prices: DataFrame, clusters: DataFrame) -> DataFrame:
    """Spend per cluster source and name: summed per cluster first, so a busy one meets its name as one row."""
    by_id = priced_usage(usage, prices).groupBy(F.col("usage_metadata.cluster_id").alias("cluster_id"))
    sums = by_id.agg(F.sum("usage_quantity").alias("usage_quantity"), F.sum("_usd").alias("_usd"))
    named = sums.join(current_clusters(clusters), "cluster_id")
    return _spend(named, {c: F.col(c) for c in ("cluster_source", "cluster_name")})
