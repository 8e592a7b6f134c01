"""The whole lake, from landed drops to marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from selvedge.operators.quality import quarantine, with_rates
from selvedge.plans import marts, silver
from selvedge.session import tune
from selvedge.sources.tables import read_table, write_table
from selvedge.streaming.ingest import STREAM_HINTS, ingest_json, ingest_landing

MARTS = (
    "daily_sales",
    "top_products",
    "inventory_health",
    "returns_analysis",
    "size_curve",
    "product_catalog",
    "style_catalog",
)


def ingest_streams(
    spark: SparkSession, landing: str, checkpoints: str, lake: str, published: bool = False
) -> dict[str, DataFrame]:
    """Bronze: take in what is new of every stream, from all files or, if ``published``, from batches with a manifest."""
    take = ingest_landing if published else ingest_json
    return {
        name: take(spark, f"{landing}/{name}", f"{lake}/bronze/{name}", f"{checkpoints}/{name}", hints)
        for name, hints in STREAM_HINTS.items()
    }


def refine(
    spark: SparkSession, bronze: dict[str, DataFrame], products: DataFrame, lake: str, batch_id: str
) -> dict[str, DataFrame]:
    """Silver: check every stream, set failing rows aside, net returns off sales, write the tables.

    Each checked stream is written once, kept and quarantined rows side by side, and read
    back, so later steps start from files.
    """
    columns = {
        "sales": "transaction_id string, sku string, store_id string, sold_at string, customer_id string",
        "returns": "return_id string, transaction_id string, sku string, returned_at string, reason string",
        "inventory": "snapshot_date string, sku string, store_id string",
    }
    present = {name: _with_columns(bronze[name], ddl) for name, ddl in columns.items()}

    def settle(name: str, checked: DataFrame) -> DataFrame:
        counts = Observation()
        kept, _ = quarantine(checked, f"{lake}/silver_checked/{name}", f"bronze.{name}", batch_id, counts)
        row = spark.createDataFrame([(counts.get["rows_in"], counts.get["rejected"])], "rows_in long, rejected long")
        row.write.mode("overwrite").json(_stats_folder(lake, name, batch_id))
        return kept

    sales = settle("sales", silver.check_sales(present["sales"], products))
    returns = settle("returns", silver.check_returns(present["returns"], sales))
    inventory = settle("inventory", silver.check_inventory(present["inventory"], products))
    by_date = {
        "sales": (silver.net_sales(sales, returns), "sale_date"),
        "returns": (returns, "returned_at"),
        "inventory": (inventory, "snapshot_date"),
    }
    for name, (df, day) in by_date.items():
        write_table(df.hint("rebalance", F.col(day)), f"silver.{name}", partition_by=[day])
    return {name: read_table(spark, f"silver.{name}") for name in by_date}


def _with_columns(df: DataFrame, ddl: str) -> DataFrame:
    """Columns a young stream has not shown yet, as NULL."""
    missing = [c.split() for c in ddl.split(", ") if c.split()[0] not in df.columns]
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in missing}) if missing else df


def build_marts(spark: SparkSession, facts: dict[str, DataFrame], products: DataFrame, stores: DataFrame) -> None:
    """Gold: write the seven marts, the catalogue from the mart it summarises."""
    sales, returns, inventory = facts["sales"], facts["returns"], facts["inventory"]
    write_table(marts.daily_sales(sales, products, stores), "gold.daily_sales")
    write_table(marts.top_products(sales, returns, products, stores), "gold.top_products")
    write_table(marts.inventory_health(sales, inventory, products, stores), "gold.inventory_health")
    write_table(marts.returns_analysis(sales, returns, products, stores), "gold.returns_analysis")
    write_table(marts.size_curve(sales, inventory, products, stores), "gold.size_curve")
    write_table(marts.product_catalog(sales, returns, inventory, products), "gold.product_catalog")
    catalog = read_table(spark, "gold.product_catalog")
    write_table(marts.style_catalog(catalog, sales), "gold.style_catalog")


def run_medallion(
    spark: SparkSession,
    landing: str,
    checkpoints: str,
    lake: str,
    products: DataFrame,
    stores: DataFrame,
    batch_id: str = "full",
    published: bool = False,
) -> dict[str, DataFrame]:
    """Ingest, refine and build the marts; returns the marts by name."""
    for name, value in (("landing", landing), ("checkpoints", checkpoints), ("lake", lake)):
        if not value or not value.strip():
            raise ValueError(f"{name} is required")
    tune(spark)
    for layer in ("bronze", "silver", "gold"):
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {layer}")
    write_table(products, "bronze.products")
    write_table(stores, "bronze.stores")
    products, stores = read_table(spark, "bronze.products"), read_table(spark, "bronze.stores")
    bronze = ingest_streams(spark, landing, checkpoints, lake, published)
    facts = refine(spark, bronze, products, lake, batch_id)
    build_marts(spark, facts, products, stores)
    return {name: read_table(spark, f"gold.{name}") for name in MARTS}


def batch_stats(spark: SparkSession, lake: str, stream: str, batch_id: str) -> DataFrame:
    """Rows in, kept and rejected of a checked batch, as counted while it was written."""
    counted = spark.read.schema("rows_in long, rejected long").json(_stats_folder(lake, stream, batch_id))
    return with_rates(counted)


def _stats_folder(lake: str, stream: str, batch_id: str) -> str:
    return f"{lake}/silver_stats/{stream}/batch_id={batch_id}"
