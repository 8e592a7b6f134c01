"""Late returns without a full rebuild.

Returns arrive days after their sales. A batch of them changes the net amounts of the sales it refers to and nothing
else, so only the days of those sales are netted again, and only those days of the mart are summed again. Sales and
mart lie in folders cut by day; days that no return refers to keep their files. Every step can be run again: returns
of a batch replace themselves, and a day is always netted from its sales and all returns that are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.plans import marts, silver
from selvedge.sources.tables import days_of, read_days, replace_days, touched_days, write_days

DAY = ["sale_date"]
_NET = ("returned_quantity", "kept_quantity", "returned_amount", "net_revenue")


def _put_returns(returns: DataFrame, root: str, batch_id: str) -> None:
    returns.select("transaction_id", "quantity").write.mode("overwrite").parquet(f"{root}/returns/batch={batch_id}")


def _returns(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/returns")


def build_net_lake(
    sales: DataFrame, returns: DataFrame, products: DataFrame, stores: DataFrame, root: str, batch_id: str = "first"
) -> None:
    """Good sales net of good returns, and daily sales, by day.

    Net sales are not moved once more to lie together by day: each task of the join writes its part of every day.
    """
    spark = sales.sparkSession
    _put_returns(returns, root, batch_id)
    write_days(silver.net_sales(sales, _returns(spark, root)), f"{root}/sales", DAY)
    write_days(marts.daily_sales(read_days(spark, f"{root}/sales"), products, stores), f"{root}/daily_sales", DAY)


def add_returns(late: DataFrame, products: DataFrame, stores: DataFrame, root: str, batch_id: str) -> None:
    """Net a batch of late good returns off the days it touches, and refresh those days of the mart."""
    spark = late.sparkSession
    _put_returns(late, root, batch_id)
    sales = read_days(spark, f"{root}/sales")
    fresh = spark.read.parquet(f"{root}/returns/batch={batch_id}").select("transaction_id").distinct()
    days = touched_days(sales.select(*DAY, "transaction_id").join(fresh, "transaction_id", "left_semi"), DAY)
    again = days_of(sales, days, DAY).drop(*_NET)
    netted = silver.net_sales(again, _returns(spark, root)).select(*sales.columns)
    replace_days(netted, days, f"{root}/sales", DAY)
    touched = days_of(read_days(spark, f"{root}/sales"), days, DAY)
    replace_days(marts.daily_sales(touched, products, stores), days, f"{root}/daily_sales", DAY)


def net_sales_now(spark: SparkSession, root: str) -> DataFrame:
    return read_days(spark, f"{root}/sales")


def daily_sales_now(spark: SparkSession, root: str) -> DataFrame:
    return read_days(spark, f"{root}/daily_sales")
