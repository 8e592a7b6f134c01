"""The order book as a table: status history, reservations, availability and bag pricing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvedge.functions.measures import available_units

# Order statuses in order of fulfilment, then the closing one; delivery terms.
TRACK = ("placed", "packed", "shipped", "delivered")
CANCELLED = "cancelled"
ORDER_STATUSES = (*TRACK, CANCELLED)
OPEN_STATUSES = ("placed", "packed", "shipped")
CANCELLABLE = ("placed", "packed")
FREE_DELIVERY_OVER = 2999.0
DELIVERY_FEE = 149.0

# Longest accepted checkout inputs.
CUSTOMER_LENGTHS = {"name": 80, "email": 120, "phone": 20, "address": 200, "city": 60, "postcode": 10}
PAGE_LINES = 1000


def conform_customer(df: DataFrame) -> DataFrame:
    """Trim checkout inputs to their accepted lengths; runs of whitespace in the address become one space."""
    edges = r"(?U)^\s+|\s+$"
    cleaned = {}
    for name, length in CUSTOMER_LENGTHS.items():
        value = F.regexp_replace(name, edges, "")
        if name == "address":
            value = F.regexp_replace(value, r"(?U)\s+", " ")
        cleaned[name] = F.substring(value, 1, length)
    return df.withColumns(cleaned)


# --- status history ---


def unknown_statuses(events: DataFrame) -> DataFrame:
    """Events naming a status the book does not have; they are never applied."""
    return events.filter(~F.col("status").isin(*ORDER_STATUSES) | F.col("status").isNull())


def accepted_steps(orders: DataFrame, events: DataFrame) -> DataFrame:
    """order_id, the status its header names (``first``) and the legal ``steps`` it took, in order.

    Of all events after an order's last step, the earliest one that its status allows is the next step; the others
    before it are skipped. Fulfilment only goes forward, so as many rounds as it has steps find them all, each a
    minimum per order. An event without a moment comes first. Events of one moment count by status and note.
    """
    step = F.struct("updated_at", "seq", "status", F.nullif(F.trim("note"), F.lit("")).alias("note"))
    known = events.filter(F.col("status").isin(*ORDER_STATUSES)).select("order_id", step.alias("_event"))
    none = F.array().cast(f"array<{known.schema['_event'].dataType.simpleString()}>")
    walked = orders.select("order_id", F.col("status").alias("first"), none.alias("steps"))
    for _ in TRACK[1:]:
        last = F.try_element_at("steps", F.lit(-1))
        now = F.coalesce(last["status"], F.col("first"))
        moment = lambda s: F.struct(s["updated_at"], s["seq"])
        later = last.isNull() | (moment(F.col("_event")) > moment(last))
        allowed = F.array_contains(offered_actions(now), F.col("_event.status"))
        rounds = walked.join(known, "order_id", "left").groupBy("order_id", "first", "steps")
        found = rounds.agg(F.min(F.when(F.coalesce(allowed & later, F.lit(False)), F.col("_event"))).alias("_next"))
        walked = found.select("order_id", "first", F.concat("steps", F.array_compact(F.array("_next"))).alias("steps"))
    return walked


def illegal_transitions(orders: DataFrame, events: DataFrame) -> DataFrame:
    """Events that are no step an order could take then, unknown statuses included, and the status they ``met``.

    Copies of a step, of its moment and status, are no fault. An event of an unknown order met nothing.
    """
    own = [F.col(c) for c in ("order_id", "seq", "status", "note", "updated_at")]
    joined = events.join(accepted_steps(orders, events), "order_id", "left")
    earlier = F.filter("steps", lambda s: F.struct(s["updated_at"], s["seq"]) < F.struct("updated_at", "seq"))
    same = lambda s: s["updated_at"].eqNullSafe(F.col("updated_at")) & s["seq"].eqNullSafe(F.col("seq")) & s["status"].eqNullSafe(F.col("status"))
    taken = F.coalesce(F.exists("steps", same), F.lit(False))
    met = F.coalesce(F.try_element_at(earlier, F.lit(-1))["status"], F.col("first"))
    return joined.filter(~taken).select(*own, met.alias("met"))


def apply_status_events(orders: DataFrame, events: DataFrame, strict: bool = False) -> DataFrame:
    """The order book after its status events.

    The newest event sets the status; a note stays until a later event brings another.
    The fold is a ``max_by`` per order, combined on the map side, so an order with very many
    events costs one row per task in the shuffle. ``strict`` lets an order only take the steps
    the console offers; :func:`illegal_transitions` tells what was skipped.
    """
    known = events.filter(F.col("status").isin(*ORDER_STATUSES))
    if strict:
        known = accepted_steps(orders, events).select("order_id", F.inline("steps"))
    note = F.nullif(F.trim("note"), F.lit(""))
    moment = F.struct("updated_at", "seq")
    folded = known.groupBy("order_id").agg(
        F.max_by("status", moment).alias("_status"),
        F.max("updated_at").alias("_updated_at"),
        F.max_by(note, F.when(note.isNotNull(), moment)).alias("_note"),
    )
    changed = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("status", "updated_at", "note")}
    return orders.join(folded, "order_id", "left").withColumns(changed).select(*orders.columns)


def current_orders(orders: DataFrame, events: DataFrame) -> DataFrame:
    """The book as it stands now; every read of orders goes through this."""
    return apply_status_events(orders, events)


def tracker_stage(status: Column) -> Column:
    """How many steps of fulfilment an order has passed; NULL for a cancelled one."""
    steps = F.array(*[F.lit(s) for s in TRACK])
    return F.when(status != CANCELLED, F.greatest(F.array_position(steps, status) - 1, F.lit(0))).cast("bigint")


def offered_actions(status: Column) -> Column:
    """The status changes the console offers: the next step, and cancelling while that is still possible."""
    following = F.create_map(*[F.lit(s) for pair in zip(TRACK, TRACK[1:]) for s in pair])
    cancel = F.when(status.isin(*CANCELLABLE), F.lit(CANCELLED))
    return F.array_compact(F.array(following[status], cancel))


# --- reads ---


def orders_by_email(orders: DataFrame, email: str, n: int = 25) -> DataFrame:
    """A customer's newest orders, whatever the case their address was typed in."""
    theirs = orders.filter(F.lower("customer_email") == F.lower(F.lit(email)))
    newest = theirs.orderBy(F.desc("placed_at"), F.asc("order_id")).limit(n)
    return newest.select("order_id", "placed_at", "status", "item_count", "total")


def recent_orders(orders: DataFrame, status: str | None = None, n: int = 60) -> DataFrame:
    rows = orders if status is None else orders.filter(F.col("status") == status)
    return (
        rows.select("order_id", "placed_at", "updated_at", "customer_name", "city", "item_count", "total", "status")
        .orderBy(F.desc("placed_at"), F.asc("order_id"))
        .limit(n)
    )


def order_summary(orders: DataFrame) -> DataFrame:
    """Orders, units and value by status, the most frequent first."""
    rows = orders.groupBy("status").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("item_count").alias("units"),
        F.round(F.sum("total"), 0).alias("value"),
    )
    return rows.orderBy(F.desc("orders"), "status")


def order_rollup(summary: DataFrame) -> DataFrame:
    """Open orders, orders ever taken, and their value."""
    is_open = F.col("status").isin(*OPEN_STATUSES)
    return summary.agg(
        F.coalesce(F.sum(F.when(is_open, F.col("orders"))), F.lit(0)).alias("open_orders"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders_taken"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("lifetime_value"),
    )


def order_documents(
    orders: DataFrame, lines: DataFrame, order_id: str | None = None, page_lines: int = PAGE_LINES
) -> DataFrame:
    """Each order with its lines nested in line order; an order without lines has none.

    ``order_id`` looks one order up; an unknown one gives no row. Line ``n`` stands on page
    ``(n - 1) div page_lines``, so that no array grows without bound.
    """
    if order_id is not None:
        orders, lines = (df.filter(F.col("order_id") == order_id) for df in (orders, lines))
    entry = F.struct("line_no", "sku", *[c for c in lines.columns if c not in ("order_id", "line_no", "sku")])
    page = F.call_function("div", F.coalesce("line_no", F.lit(1)) - 1, F.lit(page_lines)).cast("bigint")
    nested = lines.groupBy("order_id", page.alias("page")).agg(F.array_sort(F.collect_list(entry)).alias("lines"))
    joined = orders.join(nested, "order_id", "left")
    none = F.array().cast(nested.schema["lines"].dataType)
    return joined.withColumns({"page": F.coalesce("page", F.lit(0)), "lines": F.coalesce("lines", none)})


# --- availability and bags ---


def reserved_units(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Units per SKU in orders that were not cancelled.

    Lines are summed per order and SKU before they meet the headers, which keeps an order
    with very many lines small.
    """
    live = orders.filter(F.col("status") != CANCELLED).select("order_id")
    units = lines.groupBy("order_id", "sku").agg(F.sum("quantity").alias("units"))
    return units.join(live, "order_id").groupBy("sku").agg(F.sum("units").alias("reserved"))


def availability(catalog: DataFrame, reserved: DataFrame) -> DataFrame:
    """Units of each SKU that can still be sold: the snapshot less orders since, not a reservation."""
    return with_available(catalog, reserved).select("sku", "product_id", "available")


def with_available(catalog: DataFrame, reserved: DataFrame) -> DataFrame:
    """The catalogue beside what is left of each SKU, so that who needs both derives the catalogue once."""
    left = available_units(F.col("on_hand"), F.col("reserved"))
    return catalog.join(reserved, "sku", "left").select(*catalog.columns, left.alias("available"))


def availability_of(catalog: DataFrame, reserved: DataFrame, skus: DataFrame) -> DataFrame:
    """Units left of each asked SKU; one the catalogue does not know has none."""
    left = skus.select("sku").distinct().join(availability(catalog, reserved).select("sku", "available"), "sku", "left")
    return left.withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))


def style_availability(catalog: DataFrame, reserved: DataFrame) -> DataFrame:
    """The same over all sizes of a product: totals first, then the floor at zero."""
    stock = catalog.select("sku", "product_id", "on_hand").join(reserved, "sku", "left")
    totals = stock.groupBy("product_id").agg(F.sum("on_hand").alias("on_hand"), F.sum("reserved").alias("reserved"))
    left = available_units(F.col("on_hand"), F.col("reserved"))
    return totals.select("product_id", left.alias("available"), (left <= 0).alias("sold_out"))


def bag_lines(bags: DataFrame, catalog: DataFrame, reserved: DataFrame) -> DataFrame:
    """Bag contents priced against the catalogue; SKUs no longer in it drop out."""
    return bags.join(with_available(catalog, reserved), "sku").withColumns(
        {
            "line_total": F.round(F.col("current_price") * F.col("quantity"), 2),
            "short": F.col("quantity") > F.col("available"),
        }
    )


def price_bags(bags: DataFrame, catalog: DataFrame, reserved: DataFrame) -> DataFrame:
    """Totals of every bag, including bags whose SKUs have all left the catalogue."""
    stock = with_available(catalog, reserved).select("sku", "list_price", "current_price", "available")
    quantity, price = F.col("quantity"), F.coalesce("current_price", F.lit(0.0))
    found = F.col("available").isNotNull()
    saving = (F.coalesce("list_price", F.lit(0.0)) - price) * quantity
    line_total = F.round(price * quantity, 2)
    totals = bags.join(stock, "sku", "left").groupBy("bag_id").agg(
        F.count_if(found).alias("lines"),
        F.coalesce(F.sum(F.when(found, quantity)), F.lit(0)).alias("items"),
        F.coalesce(F.round(F.sum(F.when(found, line_total)), 2), F.lit(0.0)).alias("subtotal"),
        F.coalesce(F.round(F.sum(F.when(found, saving)), 2), F.lit(0.0)).alias("saved"),
        F.coalesce(F.bool_or(quantity > F.col("available")), F.lit(False)).alias("short"),
    )
    empty = F.col("lines") == 0
    free = empty | (F.col("subtotal") >= FREE_DELIVERY_OVER)
    missing = F.greatest(F.lit(0.0), F.lit(FREE_DELIVERY_OVER) - F.col("subtotal"))
    return totals.withColumn("delivery", F.when(free, F.lit(0.0)).otherwise(F.lit(DELIVERY_FEE))).withColumns(
        {
            "total": F.round(F.col("subtotal") + F.col("delivery"), 2),
            "to_free_delivery": F.when(empty, F.lit(0.0)).otherwise(missing),
        }
    )
