"""The order book's own tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the order book.
ORDERS = """order_id STRING, placed_at TIMESTAMP, updated_at TIMESTAMP, customer_name STRING,
customer_email STRING, phone STRING, address_line STRING, city STRING, postcode STRING, item_count BIGINT,
subtotal DOUBLE, delivery_fee DOUBLE, total DOUBLE, status STRING, channel STRING, note STRING"""
ORDER_LINES = """order_id STRING, line_no BIGINT, sku STRING, product_id STRING, style_name STRING,
category STRING, colour STRING, size STRING, quantity BIGINT, unit_price DOUBLE, list_price DOUBLE,
line_total DOUBLE"""
STATUS_EVENTS = "order_id STRING, seq BIGINT, status STRING, note STRING, updated_at TIMESTAMP"


def ensure_ops_tables(spark: SparkSession, schema: str) -> None:
    """Create the order book where it does not exist yet; every batch of rows is a partition of its table."""
    spark.sql("CREATE SCHEMA IF NOT EXISTS IDENTIFIER(:schema)", args={"schema": schema})
    for table, columns in (("orders", ORDERS), ("order_lines", ORDER_LINES), ("status_events", STATUS_EVENTS)):
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS IDENTIFIER(:name) ({columns}, batch STRING) USING parquet PARTITIONED BY (batch)",
            args={"name": f"{schema}.{table}"},
        )


def _put(df: DataFrame, table: str, batch_id: str | None) -> None:
    """Write a batch's rows; a batch of that name which is there already is replaced."""
    batch = batch_id or uuid.uuid4().hex
    if not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError("batch_id takes letters, digits, - and _")
    spark = df.sparkSession
    columns = [c for c in spark.read.table(table).columns if c != "batch"]
    spark.sql(
        f"INSERT OVERWRITE TABLE IDENTIFIER(:name) PARTITION (batch = '{batch}') SELECT * FROM {{rows}}",
        args={"name": table},
        rows=df.select(*columns),
    )


def place_orders(headers: DataFrame, lines: DataFrame, schema: str, batch_id: str | None = None) -> None:
    """Record a batch of orders: its lines, then its headers.

    Readers start from headers, so a batch that stops after its lines is not there yet. Placing a batch again under
    its ``batch_id`` replaces both parts of it; without one every call is a batch of its own.
    """
    now = F.current_timestamp()
    placed = headers.withColumns(
        {
            "placed_at": now,
            "updated_at": now,
            "phone": F.coalesce("phone", F.lit("")),
            "status": F.lit("placed"),
            "channel": F.lit("online"),
            "note": F.lit(None).cast("string"),
        }
    )
    batch = batch_id or uuid.uuid4().hex
    _put(lines, f"{schema}.order_lines", batch)
    _put(placed, f"{schema}.orders", batch)


def record_status_events(events: DataFrame, schema: str, batch_id: str | None = None) -> None:
    """Add a batch of status changes, once for each ``batch_id``; the orders themselves are never rewritten."""
    _put(events, f"{schema}.status_events", batch_id)
