"""The given star-schema tables read as a retail business.

Every rule is arithmetic on keys, so a retail column costs no join the business itself would
not need. Money is in whole numbers, which keeps sums of doubles exact in any order.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The retail domain.
CATEGORIES = ("Dresses", "Tops", "Trousers", "Outerwear", "Footwear", "Accessories")
SUBCATEGORIES = {
    "Dresses": ("Midi", "Maxi", "Mini"),
    "Tops": ("Shirt", "Blouse", "T-Shirt"),
    "Trousers": ("Chino", "Denim", "Formal"),
    "Outerwear": ("Jacket", "Coat"),
    "Footwear": ("Sneaker", "Heel", "Sandal"),
    "Accessories": ("Bag", "Belt", "Scarf"),
}
NAMES = ("Classic", "Relaxed", "Tailored", "Everyday")
COLOURS = ("Black", "Ivory", "Navy", "Olive")
SEASONS = ("SS26", "AW25")
APPAREL_SIZES = ("XS", "S", "M", "L", "XL")
REASONS = ("size", "fit", "quality", "changed_mind", "damaged")
FIRST_DAY = "2026-08-01"
LAST_DAY = "2026-08-28"
WINDOW_DAYS = 28


def pick(values: tuple[str, ...], index: str) -> str:
    """SQL for the value at a zero-based index."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), cast({index} as int) + 1)"


def style(key: str) -> dict[str, str]:
    """SQL for the product attributes that follow from a part key."""
    number = f"({key} div 20)"
    kind = f"({number} % 6)"
    options = " ".join(
        f"WHEN {i} THEN {pick(SUBCATEGORIES[name], f'({number} div 6) % {len(SUBCATEGORIES[name])}')}"
        for i, name in enumerate(CATEGORIES)
    )
    subcategory = f"CASE {kind} {options} END"
    retail = f"cast(2000 + {number} * 37 % 41 * 100 as double)"
    return {
        "sku": f"cast({key} as string)",
        "style_id": f"format_string('STY%04d', {number} + 1)",
        "style_name": f"concat({subcategory}, ' ', {pick(NAMES, f'{number} % 4')})",
        "category": pick(CATEGORIES, kind),
        "subcategory": subcategory,
        "colour": pick(COLOURS, f"{key} % 20 div 5"),
        "size": f"CASE {kind} WHEN 5 THEN 'OS' WHEN 4 THEN cast({key} % 5 + 38 as string) "
        f"ELSE {pick(APPAREL_SIZES, f'{key} % 5')} END",
        "season": pick(SEASONS, f"{number} % 2"),
        "cost_price": f"{retail} * 2 / 5",
        "retail_price": retail,
        "launch_date": f"date_add(DATE'2026-06-01', cast({number} * 7 % 88 as int))",
    }


_TRANSACTION = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_SALE_DAY = (
    f"date_add(DATE'{FIRST_DAY}', pmod(datediff(cast(l_shipdate as date), DATE'1995-01-01'), {WINDOW_DAYS}))"
)
_QUANTITY = "CASE WHEN l_orderkey % 601 = 0 THEN NULL WHEN l_orderkey % 211 = 0 THEN 0 ELSE cast(l_quantity as int) END"
_ORDER_ID = "concat('ORD-', {0})"


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


# The columns of the given tables that the retail reading uses. Declared, so
# that no file is opened to infer them.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "customer": "c_custkey BIGINT, c_name STRING",
    "part": "p_partkey BIGINT, p_brand STRING, p_type STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_discount DOUBLE, l_returnflag STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, props STRING",
}


class Retail:
    """Retail inputs over one folder of the given tables, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    # --- dimensions ---

    @cached_property
    def products(self) -> DataFrame:
        sold = self.table("part").filter("p_partkey div 20 % 6 <> 5 OR p_partkey % 5 = 0")
        return project(sold, style("p_partkey"))

    @cached_property
    def stores(self) -> DataFrame:
        supplier, nation, region = self.table("supplier"), self.table("nation"), self.table("region")
        placed = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(
            region, nation.n_regionkey == region.r_regionkey
        )
        return project(
            placed,
            {
                "store_id": "cast(s_suppkey as string)",
                "store_name": "s_name",
                "city": "n_name",
                "region": "r_name",
                "channel": "if(s_suppkey % 6 = 5, 'online', 'retail')",
            },
        )

    # --- fact streams ---

    @cached_property
    def bronze_sales(self) -> DataFrame:
        """Sales as they arrive, faults included. The loyalty number is the till's, not the order's customer."""
        listed = style("l_partkey")["retail_price"]
        return project(
            self.table("lineitem"),
            {
                "transaction_id": _TRANSACTION,
                "sku": "cast(l_partkey as string)",
                "store_id": "cast(l_suppkey as string)",
                "sold_at": f"concat({_SALE_DAY}, 'T', lpad(9 + l_linenumber % 13, 2, '0'), ':', "
                "lpad(l_orderkey % 60, 2, '0'), ':00')",
                "quantity": _QUANTITY,
                "unit_price": f"if(l_orderkey % 307 = 0, {listed} * 11 / 10, round({listed} * (1 - l_discount), 0))",
                "list_price": listed,
                "discount_pct": "if(l_orderkey % 401 = 0, 0.95D, l_discount)",
                "customer_id": "concat('CUST', l_orderkey % 9000)",
                "_rescued_data": """if(l_orderkey % 503 = 0, '{"legacy":"1"}', NULL)""",
            },
        )

    @cached_property
    def bronze_returns(self) -> DataFrame:
        return project(
            self.table("lineitem").filter("l_returnflag = 'R'"),
            {
                "return_id": f"concat('R-', {_TRANSACTION})",
                "transaction_id": f"concat(if(l_partkey % 97 = 0, 'X-', ''), {_TRANSACTION})",
                "sku": "cast(l_partkey as string)",
                "returned_at": f"cast(date_add({_SALE_DAY}, "
                "cast(if(l_partkey % 113 = 0, -1, 2 + l_partkey % 11) as int)) as string)",
                "quantity": _QUANTITY,
                "reason": pick(REASONS, "l_linenumber % 5"),
                "_rescued_data": """if(l_orderkey % 509 = 0, '{"legacy":"1"}', NULL)""",
            },
        )

    @cached_property
    def bronze_inventory(self) -> DataFrame:
        """The newest snapshot and the one of the day before, which holds one unit more everywhere."""
        base = "((l_partkey * 13 + l_suppkey * 7) % 61)"
        on_hand = (
            f"CASE WHEN (l_partkey + l_suppkey) % 127 = 0 THEN -1 WHEN l_partkey % 5 = 0 THEN {base} * 3 "
            f"WHEN l_partkey % 5 = 2 THEN {base} div 4 ELSE {base} END"
        )
        lines = self.table("lineitem").select("l_partkey", "l_suppkey").distinct()
        days = f"inline(array(struct('{LAST_DAY}' AS day, 0 AS extra), struct('2026-08-27' AS day, 1 AS extra)))"
        return project(
            lines.selectExpr("*", days),
            {
                "snapshot_date": "day",
                "sku": "cast(l_partkey as string)",
                "store_id": "cast(l_suppkey as string)",
                "on_hand": f"cast({on_hand} + extra as int)",
                "on_order": f"cast({base} % 3 * 10 as int)",
                "_rescued_data": "cast(NULL as string)",
            },
        )

    # --- order book ---

    @cached_property
    def orders(self) -> DataFrame:
        """Order headers with the customer's details, as at checkout; counts and totals are those of their lines."""
        sums = self.order_lines.groupBy("order_id").agg(
            F.sum("quantity").alias("units"), F.sum("line_total").alias("amount")
        )
        customer = self.table("customer")
        given = self.table("orders").withColumn("order_id", F.expr(_ORDER_ID.format("o_orderkey")))
        headers = given.join(sums, "order_id", "left").join(customer, given.o_custkey == customer.c_custkey, "left")
        subtotal = "coalesce(amount, 0D)"
        fee = f"if({subtotal} >= 2999, 0D, 149D)"
        placed = "timestampadd(HOUR, cast(o_orderkey % 24 as int), cast(o_orderdate as timestamp))"
        return project(
            headers,
            {
                "order_id": "order_id",
                "placed_at": placed,
                "updated_at": placed,
                "customer_name": "coalesce(c_name, concat('Customer ', o_custkey))",
                "customer_email": "concat('C', o_custkey, '@Example.com')",
                "phone": "concat('+91 ', o_custkey)",
                "address_line": r"concat('  ', o_custkey, '   Market \t Road ')",
                "city": "concat('City ', o_custkey % 25)",
                "postcode": "format_string('%06d', o_custkey % 1000000)",
                "item_count": "coalesce(units, 0L)",
                "subtotal": subtotal,
                "delivery_fee": fee,
                "total": f"{subtotal} + {fee}",
                "status": "CASE WHEN o_orderstatus = 'F' THEN 'delivered' "
                "WHEN o_orderstatus = 'P' THEN if(o_orderpriority = '5-LOW', 'cancelled', 'placed') "
                "WHEN o_orderpriority = '1-URGENT' THEN 'shipped' "
                "WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'packed' ELSE 'placed' END",
                "channel": "'online'",
                "note": "cast(NULL as string)",
            },
        )

    @cached_property
    def order_lines(self) -> DataFrame:
        attribute = style("l_partkey")
        charged = f"round({attribute['retail_price']} * (1 - l_discount), 0)"
        named = {c: attribute[c] for c in ("style_name", "category", "colour", "size")}
        return project(
            self.table("lineitem"),
            {
                "order_id": _ORDER_ID.format("l_orderkey"),
                "line_no": "cast(l_linenumber as bigint)",
                "sku": attribute["sku"],
                "product_id": f"concat({attribute['style_id']}, '-', upper(left({attribute['colour']}, 3)))",
                **named,
                "quantity": "cast(l_quantity as bigint)",
                "unit_price": charged,
                "list_price": attribute["retail_price"],
                "line_total": f"round({charged} * cast(l_quantity as bigint), 2)",
            },
        )

    @cached_property
    def status_events(self) -> DataFrame:
        """Two status changes for most orders, some with a note and some naming an unknown status."""
        first = (
            "struct(1L AS seq, 'packed' AS status, o_orderkey % 5 + 1 AS hours, "
            "if(o_orderkey % 3 = 0, concat('first ', o_orderkey), NULL) AS note)"
        )
        second = (
            "struct(2L AS seq, CASE WHEN o_orderkey % 13 = 0 THEN 'lost' WHEN o_orderkey % 11 = 0 THEN 'cancelled' "
            "ELSE 'shipped' END AS status, o_orderkey % 7 + 1 AS hours, "
            "if(o_orderkey % 6 = 1, concat('second ', o_orderkey), NULL) AS note)"
        )
        return project(
            self.table("orders")
            .filter("o_orderkey % 17 <> 0")
            .selectExpr("o_orderkey", "o_orderdate", f"inline(array({first}, {second}))"),
            {
                "order_id": _ORDER_ID.format("o_orderkey"),
                "seq": "seq",
                "status": "status",
                "note": "note",
                "updated_at": "timestampadd(HOUR, cast(hours as int), cast(o_orderdate as timestamp))",
            },
        )

    @cached_property
    def bags(self) -> DataFrame:
        """One bag per order: its SKUs with quantities clamped to 1..10."""
        units = self.table("lineitem").groupBy("l_orderkey", "l_partkey").agg({"l_quantity": "sum"})
        return project(
            units.toDF("l_orderkey", "l_partkey", "units"),
            {
                "bag_id": "l_orderkey",
                "sku": "cast(l_partkey as string)",
                "quantity": "least(10L, greatest(1L, cast(units as bigint)))",
            },
        )

    @cached_property
    def bag_events(self) -> DataFrame:
        """Bag operations; of the five event types ``signup`` touches no bag and is none."""
        op = "CASE WHEN event_type IN ('purchase', 'click') THEN 'add' WHEN event_type = 'view' THEN 'set' ELSE 'remove' END"
        return project(
            self.table("events").filter("event_type IN ('purchase', 'click', 'view', 'error')"),
            {
                "bag_id": "user_id",
                "at": "ts",
                "seq": "event_id",
                "op": op,
                "sku": "get_json_object(props, '$.k')",
                "quantity": "cast(1 + event_id % 12 as int)",
            },
        )

    # --- billing ---

    @cached_property
    def usage(self) -> DataFrame:
        part, lineitem = self.table("part"), self.table("lineitem")
        return project(
            lineitem.join(part, lineitem.l_partkey == part.p_partkey),
            {
                "usage_date": "cast(l_shipdate as date)",
                "usage_start_time": "cast(l_shipdate as timestamp)",
                "cloud": "if(l_suppkey % 2 = 0, 'AZURE', 'GCP')",
                "sku_name": "p_brand",
                "usage_quantity": "l_quantity",
                "billing_origin_product": pick(("JOBS", "ALL_PURPOSE", "SQL"), "l_linenumber % 3"),
                "usage_metadata": "named_struct('job_id', if(l_suppkey % 4 <> 0, concat('job-', l_suppkey % 40), NULL), "
                "'job_run_id', concat('run-', l_orderkey), 'cluster_id', concat('cl-', l_suppkey))",
                "custom_tags": "if(l_partkey % 3 = 0, map('purpose', p_type), "
                "map('purpose', p_type, 'owner', concat('team-', l_partkey % 4)))",
            },
        )

    @cached_property
    def list_prices(self) -> DataFrame:
        """Three price rows per cloud and SKU, one after the other; the last is still in force."""
        brands = self.table("part").select("p_brand").distinct()
        offers = brands.selectExpr("p_brand", "explode(array('AZURE', 'GCP')) AS cloud").selectExpr(
            "*", "explode(array(0, 1, 2)) AS step"
        )
        number = r"cast(regexp_extract(p_brand, '([0-9]+)$', 1) as int)"
        return project(
            offers,
            {
                "cloud": "cloud",
                "sku_name": "p_brand",
                "price_start_time": "cast(date_add(DATE'1995-01-01', step * 800) as timestamp)",
                "price_end_time": "cast(if(step < 2, date_add(DATE'1995-01-01', (step + 1) * 800), NULL) as timestamp)",
                "pricing": f"named_struct('default', (10 + {number} % 7 + step * 3 + if(cloud = 'GCP', 1, 0)) / 4)",
            },
        )

    @cached_property
    def clusters(self) -> DataFrame:
        """One to three configuration rows per cluster."""
        rows = self.table("supplier").selectExpr("s_suppkey", "explode(sequence(1, cast(1 + s_suppkey % 3 as int))) AS v")
        return project(
            rows,
            {
                "cluster_id": "concat('cl-', s_suppkey)",
                "cluster_name": "concat('cluster ', s_suppkey, ' v', v)",
                "cluster_source": "if((s_suppkey + v) % 2 = 0, 'JOB', 'UI')",
                "change_time": "cast(date_add(DATE'2020-01-01', v * 30) as timestamp)",
            },
        )
