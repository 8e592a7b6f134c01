"""The live bag, strict status steps, deletes and refreshes by day, as-of joins and lazy ranks."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F
from test_folds import SCHEMA, START, brute, make

from selvedge.operators.ranking import global_rank
from selvedge.operators.temporal import asof_join, interval_join
from selvedge.plans import orderbook as ob
from selvedge.plans import refresh
from selvedge.sources import layout, tables
from selvedge.sources import orderbook as book
from selvedge.streaming.bags import keep_bags, read_bags


def keep(spark, root, events, delay="1 hour", max_lines=20):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/events")
    return keep_bags(spark, f"{root}/events", f"{root}/bags", f"{root}/checkpoint", delay, max_lines=max_lines)


@pytest.mark.parametrize("seed,removal,max_lines,skus", [(1, 2, 20, 12), (3, 0.3, 3, 30)])
def test_live_bags_equal_the_fold(spark, tmp_path, seed, removal, max_lines, skus):
    """Three batches, each out of order and some of its events a batch late."""
    events, rng = make(seed, 600, 6, skus, removal), random.Random(seed)
    batches = [[], [], []]
    for k, event in enumerate(events):
        late = k % 200 > 120 and rng.random() < 0.3
        batches[min(2, k // 200 + late)].append(event)
    seen = []
    for batch in batches:
        rng.shuffle(batch)
        seen += batch
        got = keep(spark, tmp_path, batch, "200 seconds", max_lines)
        assert sorted(rows(got)) == brute(seen, max_lines)


def test_settled_events_are_forgotten_and_late_ones_dropped(spark, tmp_path):
    day = timedelta(days=1)
    keep(spark, tmp_path, [(1, START, 1, "add", "a", 1)])
    keep(spark, tmp_path, [(1, START + day, 2, "add", "b", 2)])
    keep(spark, tmp_path, [(2, START + 2 * day, 3, "add", "c", 3)])
    # A day behind the watermark: the bag was settled without it.
    got = keep(spark, tmp_path, [(1, START + timedelta(seconds=1), 4, "add", "z", 9), (1, START + 2 * day, 5, "set", "a", 7)])
    assert sorted(rows(got)) == [(1, 1, "a", 7), (1, 2, "b", 2), (2, 1, "c", 3)]


def test_live_bags_that_empty_and_odd_events(spark, tmp_path):
    got = keep(spark, tmp_path, [(1, START, 1, "add", "a", None), (1, None, 1, "add", "x", 1), (None, START, 1, "add", "x", 1), (2, START, 1, "peek", "a", 1)])
    assert rows(got) == [(1, 1, "a", 1)]
    assert rows(keep(spark, tmp_path, [(1, START, 2, "remove", "a", 0)])) == []
    assert rows(read_bags(spark, f"{tmp_path}/nowhere")) == []


# --- status steps ---

LEGAL = {"placed": ("packed", "cancelled"), "packed": ("shipped", "cancelled"), "shipped": ("delivered",)}


def walk(first, events):
    """(status, accepted, skipped) of one order, event by event."""
    status, accepted, skipped = first, [], []
    for at, seq, to, note in sorted(events, key=lambda e: (e[0], e[1], e[2] or "", e[3] or "")):
        last = accepted[-1] if accepted else None
        if to in LEGAL.get(status, ()) and (last is None or (at, seq) > last[:2]):
            status = to
            accepted.append((at, seq, to, note))
        elif not any((at, seq, to) == a[:3] for a in accepted):
            met = next((a[2] for a in reversed(accepted) if a[:2] < (at, seq)), first)
            skipped.append((seq, to, at, met))
    return status, accepted, skipped


def test_strict_steps_equal_an_event_by_event_walk(spark):
    rng, names = random.Random(5), [*ob.ORDER_STATUSES, "lost"]
    orders = [(f"o{k}", rng.choice(ob.ORDER_STATUSES)) for k in range(60)]
    events = [
        (order, rng.randrange(3), rng.choice(names), rng.choice([None, "", f"n{k}"]), START + timedelta(hours=rng.randrange(12)))
        for k, order in enumerate(rng.choice([o for o, _ in orders]) for _ in range(400))
    ]
    events = list({(e[0], e[1], e[4]): e for e in events}.values())
    book_of = spark.createDataFrame([(o, s, START, None, 1.0) for o, s in orders], "order_id string, status string, updated_at timestamp, note string, total double")
    log = spark.createDataFrame(events, "order_id string, seq long, status string, note string, updated_at timestamp")
    now = {r.order_id: r for r in ob.apply_status_events(book_of, log, strict=True).collect()}
    told = sorted((r.order_id, r.seq, r.status, r.updated_at, r.met) for r in ob.illegal_transitions(book_of, log).collect())
    expected = []
    for order, first in orders:
        status, accepted, skipped = walk(first, [(at, seq, to, note or None) for o, seq, to, note, at in events if o == order])
        assert now[order].status == status
        assert now[order].updated_at == max([a[0] for a in accepted], default=START)
        assert now[order].note == next((a[3] for a in reversed(accepted) if a[3]), None)
        expected += [(order, *s) for s in skipped]
    assert told == sorted(expected)


def test_steps_of_unknown_orders_copies_and_nothing(spark):
    book_of = spark.createDataFrame([("a", "placed")], "order_id string, status string")
    log = spark.createDataFrame(
        [("a", 1, "packed", "", START)] * 2 + [("b", 1, "packed", None, START), ("a", 2, None, None, START), ("a", 3, "packed", None, None)],
        "order_id string, seq long, status string, note string, updated_at timestamp",
    )
    steps = ob.accepted_steps(book_of, log).first()
    assert [(s.seq, s.status) for s in steps.steps] == [(3, "packed")]  # an event without a moment comes first
    assert sorted((r.order_id, r.seq, r.met) for r in ob.illegal_transitions(book_of, log).collect()) == [("a", 1, "packed"), ("a", 1, "packed"), ("a", 2, "packed"), ("b", 1, None)]
    assert rows(ob.illegal_transitions(book_of, log.limit(0))) == []


# --- rewriting days ---


def files(spark, path):
    return {r.path for r in layout.data_files(spark, path).collect()}


def test_deletes_rewrite_only_days_that_hold_a_match(spark, tmp_path):
    path = f"{tmp_path}/t"
    data = [(d, k, None if k == 3 else float(k)) for d in ("a", "b", "c", None) for k in range(5)]
    tables.write_days(spark.createDataFrame(data, "d string, k int, v double"), path, ["d"])
    before = files(spark, path)
    tables.delete_days(spark, path, ((F.col("d") == "a") & (F.col("v") > 1)) | (F.col("d") == "b") | (F.col("d").isNull() & (F.col("k") == 0)), ["d"])
    left = {(r.d, r.k) for r in tables.read_days(spark, path).collect()}
    assert left == {("a", 0), ("a", 1), ("a", 3)} | {("c", k) for k in range(5)} | {(None, k) for k in range(1, 5)}
    after = files(spark, path)
    assert {p for p in before if "d=c" in p} == {p for p in after if "d=c" in p}
    assert not {p for p in before if "d=c" not in p} & after
    tables.delete_days(spark, path, F.col("k") > 100, ["d"])
    assert files(spark, path) == after
    tables.delete_days(spark, path, F.lit(True), ["d"])
    assert tables.read_days(spark, path).count() == 0 and tables.read_days(spark, path).columns == ["k", "v", "d"]


def test_days_by_two_columns(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.write_days(spark.range(20).coalesce(1).selectExpr("id", "id % 2 AS a", "id % 3 AS b"), path, ["a", "b"])
    before = files(spark, path)
    tables.delete_days(spark, path, F.col("id") == 7, ["a", "b"])
    assert sorted(r.id for r in tables.read_days(spark, path).collect()) == [k for k in range(20) if k != 7]
    assert len(before - files(spark, path)) == 1


def test_late_returns_twice_are_netted_once(spark, tmp_path):
    from selvedge.plans.registry import Lake

    lake, root = Lake(spark, SMALL), str(tmp_path)
    late = lake.returns.filter("returned_at >= '2026-08-20'")
    refresh.build_net_lake(lake.good_sales, lake.returns.filter("returned_at < '2026-08-20' OR returned_at IS NULL"), lake.products, lake.stores, root)
    for _ in range(2):
        refresh.add_returns(late, lake.products, lake.stores, root, "late")
    now = refresh.net_sales_now(spark, root).select(*lake.sales.columns)
    assert tables.row_diff(lake.sales, now).isEmpty()
    held = files(spark, f"{root}/sales")
    refresh.add_returns(late.limit(0), lake.products, lake.stores, root, "none")
    assert files(spark, f"{root}/sales") == held


def test_a_batch_of_orders_is_placed_once(spark):
    book.ensure_ops_tables(spark, "ops_once")
    head = spark.createDataFrame([("o1", "n", "e", None, "a", "c", "p", 1, 1.0, 0.0, 1.0)], "order_id string, customer_name string, customer_email string, phone string, address_line string, city string, postcode string, item_count long, subtotal double, delivery_fee double, total double")
    line = spark.createDataFrame([("o1", 1, "s", "p", "n", "c", "x", "M", 1, 1.0, 1.0, 1.0)], book.ORDER_LINES)
    for batch in ("b-1", "b-1", "b-2", None):
        book.place_orders(head, line, "ops_once", batch)
    assert spark.read.table("ops_once.orders").count() == spark.read.table("ops_once.order_lines").count() == 3
    with pytest.raises(ValueError):
        book.place_orders(head, line, "ops_once", "b'; DROP")


# --- as-of join ---


def test_asof_join_equals_the_interval_join(spark):
    rng, day = random.Random(4), timedelta(days=1)
    dims = [("long", START - 10_000 * day, None, 0)]  # one interval of many years
    for key in ("hot", "cold", "gap"):
        at = START
        for k in range(6):
            until = at + rng.randint(0, 40) * day
            if not (key == "gap" and k % 2):
                dims.append((key, at, until if k < 5 else None, k))
            at = until
    facts = [(n, "hot" if rng.random() < 0.6 else rng.choice(["long", "cold", "gap", "none"]), START + timedelta(hours=rng.randint(-100, 6000)), {"m": "x"}) for n in range(800)]
    facts += [(900, None, START, None), (901, "hot", None, None)] + [(902 + k, "hot", d[1], None) for k, d in enumerate(dims)]
    fact = spark.createDataFrame(facts, "n int, k string, at timestamp, tags map<string,string>")
    dim = spark.createDataFrame(dims, "k string, since timestamp, until timestamp, v int")
    for width in (1, 7, 365):
        got = sorted((r.n, r.v) for r in asof_join(fact, dim, ["k"], "at", "since", "until", range_days=width).collect())
        assert got == sorted((r.n, r.v) for r in interval_join(fact, dim, ["k"], "at", "since", "until").collect())
    assert asof_join(fact, dim, ["k"], "at", "since", "until", range_days=7).columns == ["n", "k", "at", "tags", "since", "until", "v"]
    assert rows(asof_join(fact.limit(0), dim, ["k"], "at", "since", "until", range_days=7)) == []
    assert rows(asof_join(fact, dim.limit(0), ["k"], "at", "since", "until", range_days=7)) == []


# --- lazy ranks ---


@pytest.mark.parametrize("order", [["v", "w", "id"], ["-v", "-w", "-id"], ["-w", "v", "id"]])
def test_ranks_with_nulls_strings_and_hot_ties(spark, order):
    rng = random.Random(8)
    data = [(None if rng.random() < 0.1 else 7.5 if rng.random() < 0.5 else rng.gauss(0, 9), rng.choice([None, "x", "y"]), n) for n in range(9000)]
    frame = spark.createDataFrame(data, "v double, w string, id int")
    ranked = global_rank(frame, order, "r")
    got = {r.id: r.r for r in ranked.collect()}
    sorts = [F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc() for c in order]
    assert got == {r.id: n for n, r in enumerate(frame.orderBy(*sorts).collect(), 1)}


def test_ranking_runs_no_job_while_it_is_built(spark):
    from test_oracles import QUERIES

    context = spark.sparkContext
    context.setJobGroup("ranking", "")
    try:
        for name in ("top_products", "style_catalog", "global_rank_scaled"):
            assert QUERIES[name](spark, SMALL).columns
        assert not context.statusTracker().getJobIdsForGroup("ranking")
    finally:
        context.setJobGroup("rest", "")


@pytest.mark.parametrize("name,most", [("top_products", 6), ("style_catalog", 4), ("list_styles_featured", 4), ("shelves", 4), ("catalogue_bundle", 4)])
def test_the_catalogue_is_derived_once(spark, name, most):
    from test_oracles import QUERIES, fact_scans

    result = QUERIES[name](spark, SMALL)
    result.collect()
    assert 0 < fact_scans(result) <= most


def test_a_bag_has_one_timer_however_many_events_wait():
    """Waiting events cost a micro-batch one reading of the bag's state and one timer, not one for each of them."""
    from selvedge.streaming.bags import BagProcessor

    calls = []

    class Held:
        def __init__(self, value=None):
            self.value = value

        def get(self):
            calls.append("get")
            return self.value if self.value is not None else None

        def update(self, value):
            self.value = value

    class Listed(Held):
        def get(self):
            return iter(self.value or [])

        def put(self, values):
            self.value = list(values)

        def appendList(self, values):
            self.value = [*(self.value or []), *values]

        def clear(self):
            self.value = None

    class Handle:
        timers = []

        def getValueState(self, *_):
            return Held()

        def getListState(self, *_):
            return Listed()

        def registerTimer(self, at):
            self.timers.append(at)

    class Moment:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

        getExpiryTimeInMs = getCurrentWatermarkInMs

    class Event:
        def __init__(self, n):
            self.micros, self.seq, self.sku, self.op, self.quantity, self.millis = n * 1000, n, f"s{n}", "add", 1, n + 1

    bag = BagProcessor(max_lines=1000)
    bag.init(Handle())
    shown = list(bag.handleInputRows((1,), iter(Event(n) for n in range(500)), Moment(0)))
    assert len(shown[0].lines) == 500 and Handle.timers == [500] and len(calls) == 1
    list(bag.handleInputRows((1,), iter(Event(n) for n in range(500, 600)), Moment(300)))
    assert Handle.timers == [500] and len(bag.waiting.value) == 300 and len(bag.lines.value[0]) == 300
    list(bag.handleExpiredTimer((1,), Moment(550), Moment(500)))
    assert Handle.timers == [500, 600] and len(bag.waiting.value) == 50 and len(calls) == 3
    list(bag.handleExpiredTimer((1,), Moment(900), Moment(600)))
    assert Handle.timers == [500, 600] and not bag.waiting.value and len(bag.lines.value[0]) == 600


def test_sales_and_returns_meet_once(spark):
    """With joins shuffled the ranking of styles scans sales once and returns once, whatever it reads them for."""
    from test_oracles import QUERIES, fact_scans

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = QUERIES["top_products"](spark, SMALL)
        result.collect()
        assert fact_scans(result) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32MB")


def test_styles_of_rows_side_by_side_are_those_of_both_streams(spark):
    from selvedge.plans import marts, silver

    rng = random.Random(7)
    some = lambda *values: rng.choice(values)
    day = lambda k: f"2026-08-0{k}"
    made = [(f"t{rng.randrange(150)}", some("a", "b", "c", "d", None), some("1", "2", "9", None), some(day(3), day(4), None), some(1, 2, 3), some(5.0, 7.0), some(0.1, None)) for _ in range(200)]
    made += [(None, "a", "1", day(3), 1, 5.0, 0.1)] * 5
    sales = spark.createDataFrame(made, "transaction_id string, sku string, store_id string, day string, quantity int, unit_price double, discount_pct double")
    sales = sales.withColumns({"sale_date": F.col("day").cast("date"), "net_amount": F.round(F.col("unit_price") * F.col("quantity"), 2)})
    back = [(f"t{rng.randrange(200)}", some("a", "b", "c", "e", None), some(day(2), day(3), day(5), "never", None), some(1, 2, 0, None), some(None, None, "{}")) for _ in range(150)]
    back += [(None, "a", day(5), 1, None)] * 5
    bronze = spark.createDataFrame(back, "transaction_id string, sku string, returned_at string, quantity int, _rescued_data string")
    items = [(k, 2.0, f"s{i // 2}", "n", "c", "u", "w") for i, k in enumerate("aabcde")]
    products = spark.createDataFrame(items, "sku string, cost_price double, style_id string, style_name string, category string, subcategory string, season string")
    stores = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "store_id string")
    good = silver.check_returns(bronze, sales).filter("size(_violations) = 0")
    told = marts.style_sales(silver.net_sales(sales, good), good, products, stores)
    got = marts.styles_of(silver.sales_beside_returns(sales, bronze), products, stores)
    assert sorted(rows(got)) == sorted(rows(told)) and got.columns == told.columns and len(rows(told)) == 3

    # Counted by hand: the first good return of each kind, and no other.
    one = sales.limit(0).unionByName(spark.sql("SELECT 't' AS transaction_id, 'a' AS sku, '1' AS store_id, '2026-08-03' AS day, 3 AS quantity, 5D AS unit_price, 0.1D AS discount_pct, DATE'2026-08-03' AS sale_date, 15D AS net_amount"))
    came = spark.createDataFrame([("t", "b", day(3), 1, None), ("t", "b", day(2), 1, None), ("x", "b", day(5), 1, None), ("t", "b", day(5), 1, "{}")], bronze.schema)
    seen = silver.sales_beside_returns(one, came)
    assert sorted((r.sku, r.quantity, r.kept_quantity, r.net_revenue, r._sold) for r in seen.collect()) == [("a", 3, 2, 10.0, True), ("b", 1, None, None, None)]


def test_sales_of_the_net_lake_travel_once(spark, tmp_path):
    """With joins shuffled a sale is moved to its returns and from there written into its day."""
    from test_landing import shuffled

    wide = spark.range(0, 4000, 1, 4).selectExpr(
        "concat('t', id) AS transaction_id", "cast(id % 50 as string) AS sku", "'1' AS store_id",
        "date_add(DATE'2026-08-01', cast(id % 3 as int)) AS sale_date", "2 AS quantity", "5D AS unit_price", "10D AS gross_amount",
        "10D AS net_amount", "0D AS discount_amount", "concat(sha2(cast(id as string), 512), sha2(cast(-id as string), 512)) AS more",
    )
    back = spark.range(0, 4000, 10).selectExpr("concat('t', id) AS transaction_id", "1 AS quantity")
    products = spark.range(50).selectExpr("cast(id as string) AS sku", "'c' AS category", "1D AS cost_price")
    stores = spark.createDataFrame([("1", "online")], "store_id string, channel string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        refresh.build_net_lake(wide, back, products, stores, str(tmp_path))
        assert shuffled(spark) - before < 4000 * 256 * 1.7
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32MB")
    daily = sorted((str(r.sale_date)[-1], r.units_sold, r.units_kept, r.transactions, r.cost_of_goods) for r in refresh.daily_sales_now(spark, str(tmp_path)).collect())
    assert daily == [("1", 2668, 2534, 1334, 2534.0), ("2", 2666, 2533, 1333, 2533.0), ("3", 2666, 2533, 1333, 2533.0)]
    assert refresh.net_sales_now(spark, str(tmp_path)).filter("length(more) = 256").count() == 4000
