"""Every registered query over a folder of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvedge.functions import report
from selvedge.functions.measures import shown_discount
from selvedge.operators.folds import fold_bags
from selvedge.operators.quality import passed, quarantine, quarantine_stats, rejected, violation_report, with_rates
from selvedge.operators.ranking import global_rank
from selvedge.operators.temporal import dedupe_by, fanout
from selvedge.plans import billing, marts, orderbook, refresh, silver, storefront
from selvedge.plans.adapter import Retail
from selvedge.session import run_dir, stage, tune
from selvedge.sources import layout, tables
from selvedge.sources import orderbook as book_tables
from selvedge.sources.drops import write_lines
from selvedge.sources.tables import delete_days, delete_where, read_days, row_diff, write_days
from selvedge.streaming.bags import keep_bags
from selvedge.streaming.ingest import STREAM_HINTS, ingest_json, ingest_landing, tail_types

Query = Callable[[SparkSession, str], DataFrame]


class Lake(Retail):
    """Silver and gold over the retail inputs, each built when first asked for."""

    @cached_property
    def checked_sales(self) -> DataFrame:
        return silver.check_sales(self.bronze_sales, self.products)

    @cached_property
    def good_sales(self) -> DataFrame:
        return silver.good_sales(self.bronze_sales, self.products)

    @cached_property
    def checked_returns(self) -> DataFrame:
        return silver.check_returns(self.bronze_returns, self.good_sales)

    @cached_property
    def returns(self) -> DataFrame:
        return passed(self.checked_returns)

    @cached_property
    def checked_inventory(self) -> DataFrame:
        return silver.check_inventory(self.bronze_inventory, self.products)

    @cached_property
    def inventory(self) -> DataFrame:
        return passed(self.checked_inventory)

    @cached_property
    def sales(self) -> DataFrame:
        return silver.net_sales(self.good_sales, self.returns)

    @cached_property
    def daily_sales(self) -> DataFrame:
        return marts.daily_sales(self.sales, self.products, self.stores)

    @cached_property
    def top_products(self) -> DataFrame:
        return marts.ranked_styles(self.style_sales)

    @cached_property
    def style_sales(self) -> DataFrame:
        rows = silver.sales_beside_returns(self.good_sales, self.bronze_returns)
        return marts.styles_of(rows, self.products, self.stores)

    @cached_property
    def inventory_health(self) -> DataFrame:
        return marts.inventory_health(self.good_sales, self.inventory, self.products, self.stores)

    @cached_property
    def returns_analysis(self) -> DataFrame:
        return marts.returns_analysis(self.sales, self.returns, self.products, self.stores)

    @cached_property
    def size_curve(self) -> DataFrame:
        return marts.size_curve(self.sales, self.inventory, self.products, self.stores)

    @cached_property
    def product_catalog(self) -> DataFrame:
        return self.dated_catalog.select(*marts.CATALOG)

    @cached_property
    def dated_catalog(self) -> DataFrame:
        return marts.dated_catalog(self.good_sales, self.returns, self.inventory, self.products)

    @cached_property
    def style_catalog(self) -> DataFrame:
        return marts.style_catalog(self.dated_catalog)

    @cached_property
    def colourways(self) -> DataFrame:
        return marts.colourways(self.dated_catalog)

    @cached_property
    def current_orders(self) -> DataFrame:
        return orderbook.current_orders(self.orders, self.status_events)

    @cached_property
    def reserved(self) -> DataFrame:
        return orderbook.reserved_units(self.current_orders, self.order_lines)


def portable(df: DataFrame) -> DataFrame:
    """Results in types every engine spells alike: whole numbers as bigint, dates and arrays as text."""

    def plain(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            value = value.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.IntegralType):
            value = value.cast("bigint")
        elif isinstance(field.dataType, T.ArrayType):
            value = F.array_join(value, ",")
        return value.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


# --- queries that need more than one call ---


def _rank_lines(lake: Lake) -> DataFrame:
    lines = lake.good_sales.groupBy("sku", "store_id").agg(F.sum("quantity").alias("units"))
    return global_rank(lines, ["-units", "sku", "store_id"], "line_rank")


def _fanout_check(lake: Lake) -> DataFrame:
    usage = lake.usage.select(F.col("usage_metadata.cluster_id").alias("cluster_id"))
    checks = {"raw": lake.clusters, "collapsed": billing.current_clusters(lake.clusters)}
    parts = [fanout(usage, dim, ["cluster_id"]).select(F.lit(k).alias("dimension"), "*") for k, dim in checks.items()]
    return parts[0].unionByName(parts[1])


def _bundle(lake: Lake) -> DataFrame:
    bundle = storefront.catalogue_bundle(marts.colourways(lake.dated_catalog, with_skus=True))
    money = lambda x: x.cast("bigint").cast("string")
    entry = lambda s: F.concat_ws(":", s["size"], s["sku"], s["on_hand"].cast("string"), money(s["list_price"]), money(s["current_price"]))
    return bundle.withColumn("sizes", F.transform("sizes", entry))


def _documents(lake: Lake) -> DataFrame:
    found = orderbook.order_documents(lake.current_orders, lake.order_lines)
    line = lambda x: F.concat_ws(":", x["line_no"].cast("string"), x["sku"])
    return found.select("order_id", "status", "total", "page", F.transform("lines", line).alias("lines"))


def _tracking(lake: Lake) -> DataFrame:
    status = F.col("status")
    return lake.current_orders.select(
        "order_id",
        "status",
        orderbook.tracker_stage(status).alias("stage"),
        orderbook.offered_actions(status).alias("actions"),
    )


def _shown(lake: Lake) -> DataFrame:
    shown = shown_discount(F.col("list_price"), F.col("current_price"))
    return lake.product_catalog.select("sku", "list_price", "current_price", shown.alias("shown_discount"))


def _customers(lake: Lake) -> DataFrame:
    raw = lake.orders.select(
        "order_id",
        F.concat(F.lit(" \t"), "customer_name", F.lit("  ")).alias("name"),
        F.concat(F.lit(" "), "customer_email").alias("email"),
        F.repeat("phone", 4).alias("phone"),
        F.col("address_line").alias("address"),
        F.concat("city", F.lit("\n")).alias("city"),
        F.repeat("postcode", 3).alias("postcode"),
    )
    return orderbook.conform_customer(raw)


def _report(lake: Lake) -> DataFrame:
    revenue = F.col("net_revenue")
    return lake.daily_sales.select(
        "category",
        "channel",
        report.day_text(F.col("sale_date")).alias("day"),
        report.moment_text(F.col("sale_date")).alias("moment"),
        report.rupees(revenue, 2).alias("rupees"),
        report.price_text(revenue).alias("price"),
        report.compact(revenue).alias("compact"),
        report.count_text(F.col("units_sold")).alias("units"),
        report.pct_text(F.col("margin_pct")).alias("margin"),
    )


# --- ingest ---


def _drop_lines(lake: Lake, path: str, promo: Column, batch: str, when: str = "true", compression: str = "snappy") -> None:
    """Land the sales as JSON lines by day; some broken, some with a mistyped quantity."""
    key = F.split("transaction_id", "-")[0].cast("bigint")
    mistyped, broken = key % 211 == 0, key % 503 == 0
    fields = F.struct(
        "transaction_id",
        "sku",
        "store_id",
        "sold_at",
        F.when(~mistyped, F.col("quantity")).alias("quantity"),
        "unit_price",
        "list_price",
        "discount_pct",
        "customer_id",
        promo.alias("promo"),
    )
    text = F.to_json(fields)
    text = F.when(mistyped, F.regexp_replace(text, r"\}$", ',"quantity":"x"}')).otherwise(text)
    cut = F.concat(F.lit('{"transaction_id":"'), "transaction_id", F.lit('",'))
    rows = lake.bronze_sales.filter(when)
    write_lines(rows, path, F.to_date("sold_at"), F.when(broken, cut).otherwise(text), batch, gather=False, compression=compression)


def _promo() -> Column:
    key = F.split("transaction_id", "-")[0].cast("bigint")
    return F.when(key % 401 == 0, F.concat(F.lit("P"), (key % 7).cast("string")))


class _Landing:
    """A landing folder and the table it is ingested into."""

    def __init__(self, lake: Lake, label: str):
        root = run_dir(lake.spark, label)
        self.lake, self.landing = lake, f"{root}/landing"
        self.target, self.checkpoint = f"{root}/bronze", f"{root}/checkpoint"

    def ingest(self, **options) -> DataFrame:
        """What is published in the landing folder; with ``once`` its files, whoever wrote them."""
        take = ingest_json if "once" in options else ingest_landing
        return take(self.lake.spark, self.landing, self.target, self.checkpoint, STREAM_HINTS["sales"], **options)


def _ingest_rescue(lake: Lake) -> DataFrame:
    place = _Landing(lake, "ingest-rescue")
    _drop_lines(lake, place.landing, _promo(), "all")
    return place.ingest().drop("_source_file", "_ingested_at", "ingest_batch")


def _ingest_provenance(lake: Lake) -> DataFrame:
    """Where and when the rows of each day came from."""
    place = _Landing(lake, "ingest-provenance")
    _drop_lines(lake, place.landing, _promo(), "only")
    origin = F.concat(F.lit("/dt="), "dt", F.lit("/batch=only/"))
    return place.ingest().groupBy("dt", "ingest_batch").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_source_file").contains(origin)).alias("traced"),
        F.count_if(F.col("_ingested_at").between(F.current_timestamp() - F.expr("INTERVAL 1 DAY"), F.current_timestamp())).alias("stamped"),
    )


def _drops_late_rows(lake: Lake) -> DataFrame:
    """A day lands in two batches, the second bringing its late rows."""
    place = _Landing(lake, "late-rows")
    _drop_lines(lake, place.landing, _promo(), "first", "store_id % 2 = 0")
    _drop_lines(lake, place.landing, _promo(), "late", "store_id % 2 = 1")
    return place.ingest().groupBy("dt").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("transaction_id").alias("transactions"))


def _ingest_idempotent(lake: Lake) -> DataFrame:
    """Ingest three times: nothing new adds nothing, new files of landed days add their rows once."""
    place = _Landing(lake, "ingest-again")
    _drop_lines(lake, place.landing, _promo(), "first", "store_id % 2 = 0")
    place.ingest()
    place.ingest()
    _drop_lines(lake, place.landing, _promo(), "second", "store_id % 2 = 1")
    table = place.ingest()
    return table.groupBy("dt").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("transaction_id").alias("transactions")
    )


def _ingest_evolving(lake: Lake) -> DataFrame:
    """The first half of the days lands without ``promo``, the second half with it."""
    place = _Landing(lake, "ingest-evolving")
    _drop_lines(lake, place.landing, F.lit(None).cast("string"), "before", "sold_at < '2026-08-15'")
    place.ingest()
    _drop_lines(lake, place.landing, _promo(), "after", "sold_at >= '2026-08-15'")
    table = place.ingest()
    return table.groupBy("dt").agg(F.count(F.lit(1)).alias("rows"), F.count("promo").alias("promo_rows"))


def _ingest_tail(lake: Lake) -> DataFrame:
    """Every sale brings a key of its own kind, a thousand in all, half of them numbers: what the tail holds."""
    place = _Landing(lake, "ingest-tail")
    key = F.split("transaction_id", "-")[0].cast("bigint") % 1000
    value = F.when(key % 2 == 0, key.cast("string")).otherwise(F.concat(F.lit('"v'), key.cast("string"), F.lit('"')))
    more = F.concat(F.lit(',"k'), key.cast("string"), F.lit('":'), value, F.lit("}"))
    columns = [c for c in lake.bronze_sales.columns if c != "_rescued_data"]
    whole = F.to_json(F.struct(*columns))
    text = F.concat(F.left(whole, F.length(whole) - 1), more)
    write_lines(lake.bronze_sales, place.landing, F.to_date("sold_at"), text, "only", gather=False, compression="snappy")
    names = tail_types(place.ingest(tail=True))
    return names.withColumn("type", F.col("type").cast("string"))


def _landing_retried(lake: Lake) -> DataFrame:
    """A landing that stopped after its files, before its manifest, and was tried again."""
    place = _Landing(lake, "retried")
    _drop_lines(lake, place.landing, _promo(), "first", "store_id % 2 = 0")
    half = lake.bronze_sales.filter("store_id % 4 = 1").select(
        F.to_json(F.struct("transaction_id")).alias("value"), F.date_format(F.to_date("sold_at"), "yyyy-MM-dd").alias("dt"),
        F.lit("late").alias("batch"), F.lit("stopped").alias("attempt"),
    )
    half.write.mode("append").partitionBy("dt", "batch", "attempt").text(place.landing)
    place.ingest()
    _drop_lines(lake, place.landing, _promo(), "late", "store_id % 2 = 1")
    return place.ingest().groupBy("dt").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("transaction_id").alias("transactions"))


def _ingest_once(lake: Lake) -> DataFrame:
    """The same rows land twice under other file names, in one run and in the next.

    All copies lie there at once, so they are compressed closer than elsewhere.
    """
    place = _Landing(lake, "ingest-once")
    for batch in ("first", "again"):
        _drop_lines(lake, place.landing, _promo(), batch, compression="gzip")
    place.ingest(once="transaction_id")
    _drop_lines(lake, place.landing, _promo(), "later", compression="gzip")
    table = place.ingest(once="transaction_id")
    return table.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("transaction_id").alias("transactions"))


# --- live bags ---


def _fold_bags_stream(lake: Lake) -> DataFrame:
    """The bag events arrive in three batches, some of them a batch late but within the watermark's delay."""
    root = run_dir(lake.spark, "bags")
    events = lake.bag_events.withColumn("at", F.col("at").cast("timestamp"))
    first, last = events.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first()
    third = max(1, (last - first) // 3 + 1)
    own = F.unix_micros("at") - first
    # Of a third's second half every third event is late.
    late = (own % third > third // 2) & (F.col("seq") % 3 == 0) & (own < 2 * third)
    dealt = events.withColumn("batch", F.floor(own / third) + late.cast("int"))
    for number in range(3):
        dealt.filter(F.col("batch") == number).drop("batch").write.mode("append").parquet(f"{root}/events")
        shown = keep_bags(lake.spark, f"{root}/events", f"{root}/bags", f"{root}/checkpoint", f"{third} microseconds")
    return shown


# --- table upkeep ---


def _compacted(lake: Lake) -> DataFrame:
    """Daily sales in one file per day, then compacted to a target size: what the layout became."""
    path = run_dir(lake.spark, "compact")
    lake.daily_sales.repartitionByRange(28, "sale_date").write.parquet(f"{path}/small")
    before = layout.table_detail(lake.spark, f"{path}/small").first()
    target = max(1, before["size_bytes"] // 3)
    after = layout.compact(lake.spark, f"{path}/small", f"{path}/packed", target)
    kept = lake.spark.read.parquet(f"{path}/packed").agg(F.count(F.lit(1)).alias("rows"), F.sum("units_sold").alias("units_sold"))
    most = -(-before["size_bytes"] // target)
    files = after.select("num_files").scalar()
    return kept.select("rows", "units_sold", (files <= most).alias("few_files"), (files < before["num_files"]).alias("fewer_files"))


def _detail(lake: Lake) -> DataFrame:
    path = run_dir(lake.spark, "detail")
    # Dealt by what is in a row: that keeps the order within a task, so that rows travel well compressed and unsorted.
    lake.good_sales.repartition(5, *lake.good_sales.columns).write.parquet(path)
    rows = lake.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
    found = layout.table_detail(lake.spark, path)
    told = found.select(F.struct(*found.columns)).scalar()
    means = told["avg_bytes"] * told["num_files"] == told["size_bytes"]
    fits = told["largest_bytes"].between(told["avg_bytes"], told["size_bytes"])
    return rows.select("rows", told["num_files"].alias("num_files"), means.alias("mean_fits"), fits.alias("largest_fits"))


def _quarantine_rerun(lake: Lake) -> DataFrame:
    """A batch quarantined twice: its rows are there once, tagged with their source."""
    path = run_dir(lake.spark, "quarantine")
    for _ in range(2):
        _, bad = quarantine(lake.checked_sales, path, "bronze.sales", "day-1")
    tagged = bad.withColumn("dated", F.col("_quarantined_at").isNotNull())
    return tagged.select("transaction_id", F.array_join("_violations", ",").alias("violations"), F.col("_source_table").alias("source_table"), "dated")


def _quarantine_observed(lake: Lake) -> DataFrame:
    """Counts of a batch from the one write that splits it."""
    counts = Observation()
    quarantine(lake.checked_sales, run_dir(lake.spark, "observed"), "bronze.sales", "day-1", counts)
    return with_rates(lake.spark.createDataFrame([(counts.get["rows_in"], counts.get["rejected"])], "rows_in long, rejected long"))


def _file_days(lake: Lake, path: str) -> DataFrame:
    """The data files of a folder cut by day, by name."""
    day = F.regexp_extract("path", "/sale_date=([^/]+)/", 1)
    return layout.data_files(lake.spark, path).select(day.alias("sale_date"), "path")


def _untouched(lake: Lake, path: str, before: list) -> DataFrame:
    """sale_date, kept: whether each day still has the files it had ``before``."""
    old = lake.spark.createDataFrame(before, "sale_date string, path string").withColumn("old", F.lit(1))
    both = old.unionByName(_file_days(lake, path).withColumn("old", F.lit(0)))
    files = both.groupBy("sale_date", "path").agg(F.countDistinct("old").alias("times"))
    return files.groupBy("sale_date").agg((F.min("times") == 2).alias("kept_files"))


def _delete_days(lake: Lake) -> DataFrame:
    """Daily sales in a folder by day, of which some days lose their online rows and one day all of its rows."""
    path = run_dir(lake.spark, "delete")
    write_days(lake.daily_sales.hint("rebalance", F.col("sale_date")), path, ["sale_date"])
    before = [tuple(r) for r in _file_days(lake, path).collect()]
    day = F.col("sale_date")
    unwanted = ((F.day(day) % 7 == 0) & (F.col("channel") == "online")) | (day == F.lit("2026-08-10").cast("date"))
    delete_days(lake.spark, path, unwanted, ["sale_date"])
    left = read_days(lake.spark, path).groupBy(day.cast("string").alias("sale_date"))
    rows = left.agg(F.count(F.lit(1)).alias("rows"), F.sum("units_sold").alias("units_sold"))
    kept = _untouched(lake, path, before).join(rows, "sale_date", "left")
    return kept.select("sale_date", "kept_files", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("units_sold", F.lit(0)).alias("units_sold"))


def _late(returned: str) -> Column:
    """Returns that come in a batch of their own."""
    return F.col(returned) >= F.lit("2026-08-20").cast("date")


def _late_returns(lake: Lake) -> DataFrame:
    """Daily sales after late returns were netted off the days they touch only."""
    root = run_dir(lake.spark, "late-returns")
    late = _late("returned_at")
    # Checked once: both batches are of the same returns.
    returns = stage(lake.returns.select("transaction_id", "quantity", "returned_at"), "good-returns")
    refresh.build_net_lake(lake.good_sales, returns.filter(~late), lake.products, lake.stores, root)
    refresh.add_returns(returns.filter(late), lake.products, lake.stores, root, "late")
    return refresh.daily_sales_now(lake.spark, root).select(*lake.daily_sales.columns)


def _late_returns_files(lake: Lake) -> DataFrame:
    """Late returns of three days of sales: which days of sales and mart kept their files."""
    root = run_dir(lake.spark, "late-returns-files")
    # A transaction has a sale that early if its first sale is, which the check of its returns finds.
    early = F.coalesce(F.col("_sale_date") <= F.lit("2026-08-03").cast("date"), F.lit(False)).alias("early")
    matched = passed(silver.check_matched(silver.match_returns(lake.bronze_returns, lake.good_sales)))
    returns = stage(matched.select("transaction_id", "quantity", early), "good-returns")
    few, rest = returns.filter("early"), returns.filter("NOT early")
    refresh.build_net_lake(lake.good_sales, rest, lake.products, lake.stores, root)
    before = {t: [tuple(r) for r in _file_days(lake, f"{root}/{t}").collect()] for t in ("sales", "daily_sales")}
    refresh.add_returns(few, lake.products, lake.stores, root, "late")
    sales, daily = (_untouched(lake, f"{root}/{t}", before[t]) for t in before)
    return sales.withColumnRenamed("kept_files", "kept_sales").join(daily.withColumnRenamed("kept_files", "kept_daily"), "sale_date")


def _quality_report(lake: Lake) -> DataFrame:
    """Broken rules of all three streams."""
    streams = {"sales": lake.checked_sales, "returns": lake.checked_returns, "inventory": lake.checked_inventory}
    parts = [violation_report(rejected(df)).select(F.lit(name).alias("stream"), "*") for name, df in streams.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _table_name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"


def _overwritten(lake: Lake) -> DataFrame:
    """A named table, replaced under another schema, and copied."""
    name, copy = _table_name("daily"), _table_name("copy")
    tables.write_table(lake.daily_sales, name)
    tables.write_table(tables.read_table(lake.spark, name).groupBy("category").agg(F.sum("units_sold").alias("units")), f"{name}_new")
    tables.write_table(tables.read_table(lake.spark, f"{name}_new"), name)
    tables.snapshot_copy(lake.spark, name, copy)
    tables.drop_table(lake.spark, name)
    tables.drop_table(lake.spark, f"{name}_new")
    return tables.read_table(lake.spark, copy)


def _evolved(lake: Lake) -> DataFrame:
    """A folder whose second append brings a column."""
    path = run_dir(lake.spark, "evolving")
    tables.append_evolving(lake.products.filter("season = 'SS26'").select("sku", "season"), path)
    tables.append_evolving(lake.products.filter("season <> 'SS26'").select("sku", "season", "colour"), path)
    return tables.read_evolving(lake.spark, path).groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.count("colour").alias("coloured"))


def _placed(lake: Lake, times: int = 1) -> DataFrame:
    """Orders placed into tables of their own, changed by events, and summed up; a retried batch counts once."""
    schema = _table_name("ops")
    for _ in range(2):
        book_tables.ensure_ops_tables(lake.spark, schema)
    headers = lake.orders.drop("placed_at", "updated_at", "status", "channel", "note")
    for _ in range(times):
        book_tables.place_orders(headers, lake.order_lines, schema, "checkout-1")
        book_tables.record_status_events(lake.status_events, schema, "console-1")
    read = lambda name: lake.spark.read.table(f"{schema}.{name}")
    now = orderbook.current_orders(read("orders"), read("status_events"))
    units = read("order_lines").groupBy("order_id").agg(F.sum("quantity").alias("line_units"))
    return now.join(units, "order_id", "left").groupBy("status").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("item_count").alias("units"), F.sum("line_units").alias("line_units")
    )


def _document_of(lake: Lake) -> DataFrame:
    found = orderbook.order_documents(lake.current_orders, lake.order_lines, "ORD-7")
    return found.select("order_id", "status", "total", "page", F.explode("lines").alias("line")).select("order_id", "status", "total", "page", "line.*")


def _availability_of(lake: Lake) -> DataFrame:
    asked = lake.bags.select("sku").distinct()
    unknown = lake.spark.createDataFrame([("no-such-sku",)], "sku string")
    return orderbook.availability_of(lake.product_catalog, lake.reserved, asked.unionByName(unknown))


def _bag_lines(lake: Lake) -> DataFrame:
    found = orderbook.bag_lines(lake.bags, lake.product_catalog, lake.reserved)
    return found.select("bag_id", "sku", "product_id", "quantity", "list_price", "current_price", "available", "line_total", "short")


# Arguments the registered queries are run with.
DAYS = 14
BUSY_DAY = 10_000_000

_QUERIES: dict[str, Callable[[Lake], DataFrame]] = {
    # silver
    "silver_sales_good": lambda k: k.good_sales,
    "silver_sales_quarantine": lambda k: rejected(k.checked_sales),
    "silver_returns_good": lambda k: k.returns,
    "silver_returns_quarantine": lambda k: rejected(k.checked_returns),
    "silver_inventory_good": lambda k: k.inventory,
    "silver_inventory_quarantine": lambda k: rejected(k.checked_inventory),
    "violation_report": lambda k: violation_report(rejected(k.checked_sales)),
    "violation_report_returns": lambda k: violation_report(rejected(k.checked_returns)),
    "violation_report_inventory": lambda k: violation_report(rejected(k.checked_inventory)),
    "quality_report": _quality_report,
    "quarantine_rerun": _quarantine_rerun,
    "quarantine_observed": _quarantine_observed,
    "quarantine_stats": lambda k: quarantine_stats(k.checked_sales),
    "net_sales": lambda k: k.sales,
    "dedupe_sales": lambda k: dedupe_by(k.good_sales, ["transaction_id"], ["sold_at", "sku"]),
    # marts
    "daily_sales": lambda k: k.daily_sales,
    "top_products": lambda k: k.top_products,
    "sell_rate": lambda k: marts.sell_rate(k.good_sales, k.inventory),
    "inventory_health": lambda k: k.inventory_health,
    "returns_analysis": lambda k: k.returns_analysis,
    "size_curve": lambda k: k.size_curve,
    "style_markdown": lambda k: marts.style_markdown(marts.sku_activity(k.good_sales), k.products),
    "product_catalog": lambda k: k.product_catalog,
    "style_catalog": lambda k: k.style_catalog,
    "global_rank_scaled": _rank_lines,
    # billing
    "usage_freshness": lambda k: billing.usage_freshness(k.usage),
    "spend_by_day_sku": lambda k: billing.spend_by_day_sku(k.usage, k.list_prices),
    "interval_join_bucketed": lambda k: billing.spend_by_day_sku(k.usage, k.list_prices, bucket_days=90),
    "cost_per_job": lambda k: billing.cost_per_job(k.usage, k.list_prices),
    "spend_by_tag": lambda k: billing.spend_by_tag(k.usage, k.list_prices),
    "asof_join": lambda k: billing.spend_by_day_sku(k.usage, k.list_prices, range_days=30),
    "spend_by_cluster": lambda k: billing.spend_by_cluster(k.usage, k.list_prices, k.clusters),
    "current_clusters": lambda k: billing.current_clusters(k.clusters),
    "fanout_check": _fanout_check,
    # merchandising reads
    "kpis": lambda k: storefront.kpis(k.daily_sales, DAYS),
    "trend": lambda k: storefront.trend(k.daily_sales, DAYS),
    "revenue_by_category": lambda k: storefront.revenue_by_category(k.daily_sales, DAYS),
    "returns_by_reason": lambda k: storefront.returns_by_reason(k.returns_analysis),
    "inventory_by_status": lambda k: storefront.inventory_by_status(k.inventory_health),
    "top_styles": lambda k: storefront.top_styles(k.style_sales),
    "worst_size_style": lambda k: storefront.worst_size_style(k.size_curve),
    "size_curve_for_style": lambda k: storefront.size_curve_for_style(k.size_curve, "STY0005"),
    "inventory_lines": lambda k: storefront.inventory_lines(k.inventory_health),
    "inventory_lines_dead": lambda k: storefront.inventory_lines(k.inventory_health, "dead"),
    # catalogue reads
    **{
        f"list_styles_{sort.replace('-', '_')}": lambda k, sort=sort: storefront.list_styles(k.colourways, sort)
        for sort in storefront.SORTS
    },
    "list_styles_filtered": lambda k: storefront.list_styles(
        k.colourways, category="Tops", colour="Navy", size="M", sale=True
    ),
    "facets": lambda k: storefront.facets(storefront.filter_styles(k.colourways, colour="Navy")),
    "shelves": lambda k: storefront.shelves(k.colourways),
    "styles_per_category": lambda k: storefront.styles_per_category(k.colourways),
    "catalogue_values": lambda k: storefront.catalogue_values(k.products, "colour"),
    "catalogue_bundle": _bundle,
    "fit_note": lambda k: storefront.fit_note(k.returns_analysis),
    "shown_discount": _shown,
    # order book
    "conform_customer": _customers,
    "order_status_latest": lambda k: k.current_orders.select("order_id", "status", "updated_at", "note", "total"),
    "order_tracking": _tracking,
    "order_status_strict": lambda k: orderbook.apply_status_events(k.orders, k.status_events, strict=True).select(
        "order_id", "status", "updated_at", "note", "total"
    ),
    "illegal_transitions": lambda k: orderbook.illegal_transitions(k.orders, k.status_events),
    "unknown_statuses": lambda k: orderbook.unknown_statuses(k.status_events),
    "orders_by_email": lambda k: orderbook.orders_by_email(k.current_orders, "c7@EXAMPLE.com"),
    "recent_orders": lambda k: orderbook.recent_orders(k.current_orders),
    "recent_orders_placed": lambda k: orderbook.recent_orders(k.current_orders, "placed", 100),
    "recent_orders_packed": lambda k: orderbook.recent_orders(k.current_orders, "packed", 100),
    "order_summary": lambda k: orderbook.order_summary(k.current_orders),
    "order_rollup": lambda k: orderbook.order_rollup(orderbook.order_summary(k.current_orders)),
    "order_documents": _documents,
    "order_document_by_id": _document_of,
    "place_orders": _placed,
    "place_orders_again": lambda k: _placed(k, times=2),
    "reserved_units": lambda k: k.reserved,
    "availability": lambda k: orderbook.availability(k.product_catalog, k.reserved),
    "availability_of": _availability_of,
    "bag_lines": _bag_lines,
    "style_availability": lambda k: orderbook.style_availability(k.product_catalog, k.reserved),
    "price_bags": lambda k: orderbook.price_bags(k.bags, k.product_catalog, k.reserved),
    "fold_bags": lambda k: fold_bags(k.bag_events),
    "fold_bags_stream": _fold_bags_stream,
    # report text
    "format_report": _report,
    # ingest
    "ingest_rescue": _ingest_rescue,
    "ingest_provenance": _ingest_provenance,
    "drops_late_rows": _drops_late_rows,
    "ingest_idempotent": _ingest_idempotent,
    "ingest_evolving": _ingest_evolving,
    "ingest_once": _ingest_once,
    "ingest_tail": _ingest_tail,
    "landing_retried": _landing_retried,
    # table upkeep
    "delete_where": lambda k: delete_where(k.daily_sales, F.col("net_revenue") > BUSY_DAY),
    "delete_days": _delete_days,
    "late_returns": _late_returns,
    "late_returns_files": _late_returns_files,
    "version_diff": lambda k: row_diff(k.daily_sales, delete_where(k.daily_sales, F.col("net_revenue") > BUSY_DAY)),
    "table_detail": _detail,
    "compact": _compacted,
    "overwrite_schema": _overwritten,
    "append_evolving": _evolved,
}


def all_queries() -> dict[str, Query]:
    def runner(build: Callable[[Lake], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            tune(spark)
            return portable(build(Lake(spark, folder)))

        return run

    return {name: runner(build) for name, build in _QUERIES.items()}
