import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from selvedge.operators import temporal as t
from selvedge.operators.ranking import global_rank, share_of, top_rows


def test_trailing_covers_one_day_more_than_its_length(spark):
    days = [date(2026, 8, 28) - timedelta(days=n) for n in (0, 13, 14, 15)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert t.trailing(df, "d", 14).count() == 3
    assert t.trailing(df, "d", 14, inclusive_extra_day=False).count() == 2
    assert t.at_latest(df, "d").count() == 1


def prices(spark, data):
    return spark.createDataFrame(data, "k string, s timestamp, e timestamp, p int")


def test_interval_bounds_are_half_open(spark):
    dim = prices(spark, [("a", datetime(2020, 1, 1), datetime(2020, 2, 1), 1), ("a", datetime(2020, 2, 1), None, 2)])
    moments = [datetime(2019, 12, 31), datetime(2020, 1, 1), datetime(2020, 1, 31, 23), datetime(2020, 2, 1), datetime(2030, 1, 1)]
    fact = spark.createDataFrame([("a", m) for m in moments] + [("b", moments[1])], "k string, at timestamp")
    got = sorted(t.interval_join(fact, dim, ["k"], "at", "s", "e").select("at", "p").collect())
    assert [r["p"] for r in got] == [1, 1, 2, 2]
    for days in (1, 10, 400):
        bucketed = t.interval_join_bucketed(fact, dim, ["k"], "at", "s", "e", days).select("at", "p")
        assert sorted(bucketed.collect()) == got


def test_bucketed_join_equals_plain_join_on_a_hot_key(spark):
    rng = random.Random(3)
    start = datetime(2020, 1, 1)
    dim, fact = [], []
    for key in ("hot", "b", "c"):
        at = start
        for n in range(6):
            end = at + timedelta(days=rng.randint(5, 60))
            dim.append((key, at, None if n == 5 else end, n))
            at = end
    for n in range(600):
        fact.append((rng.choice(["hot", "hot", "hot", "b", "c", "d"]), start + timedelta(hours=rng.randint(-100, 9000))))
    f, d = spark.createDataFrame(fact, "k string, at timestamp"), prices(spark, dim)
    plain = sorted(rows(t.interval_join(f, d, ["k"], "at", "s", "e").select("k", "at", "p")))
    bucketed = sorted(rows(t.interval_join_bucketed(f, d, ["k"], "at", "s", "e", 20).select("k", "at", "p")))
    assert plain == bucketed and plain


def test_latest_row_per_key_and_fanout(spark):
    dim = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, v int, name string")
    assert sorted(rows(t.latest_per_key(dim, ["id"], ["v"]))) == [("a", 2, "y"), ("b", 1, "z")]
    fact = spark.createDataFrame([("a", 0.21), ("b", 0.1), ("c", 0.1)], "id string, q double")
    assert rows(t.fanout(fact, dim, ["id"])) == [(3, 3, 2)]
    with pytest.raises(ValueError):
        t.assert_no_fanout(fact, dim, ["id"])
    single = t.latest_per_key(dim, ["id"], ["v"])
    t.assert_no_fanout(fact, single, ["id"])
    doubled = fact.join(dim, "id").filter("id = 'a'").agg(F.sum("q")).first()[0]
    assert (doubled, fact.join(single, "id").filter("id = 'a'").agg(F.sum("q")).first()[0]) == (0.42, 0.21)


def test_flag_known_keeps_the_row_count(spark):
    fact = spark.createDataFrame([("a",), ("a",), ("x",), (None,)], "sku string")
    known = spark.createDataFrame([("a",), ("a",), ("b",)], "sku string")
    got = t.flag_known(fact, known, "sku")
    assert sorted(r["_sku_known"] is True for r in got.collect()) == [False, False, True, True]


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_global_rank_is_row_number_whatever_the_partitions(spark, partitions):
    rng = random.Random(1)
    data = [(0 if rng.random() < 0.4 else rng.randint(0, 50), f"id{n:04d}") for n in range(800)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(data, "v int, id string")
        got = rows(global_rank(df, ["-v", "id"], "r").select("id", "r"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = {i: n for n, (_, i) in enumerate(sorted(data, key=lambda r: (-r[0], r[1])), 1)}
    assert dict(got) == expected


def test_global_rank_of_nothing(spark):
    df = spark.createDataFrame([], "v int, id string")
    assert rows(global_rank(df, ["-v", "id"], "r")) == []


def test_shares(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 0)], "g string, v int")
    got = df.select("g", share_of("v", "g", 1).alias("s"), share_of("v", "g", 1, empty=0.0).alias("z"))
    assert sorted(rows(got), key=str) == [("a", 25.0, 25.0), ("a", 75.0, 75.0), ("b", None, 0.0)]


def test_top_rows_number_themselves(spark):
    df = spark.range(100)
    assert rows(top_rows(df, [F.desc("id")], 3, "place")) == [(99, 1), (98, 2), (97, 3)]
    with pytest.raises(ValueError):
        top_rows(df, [F.desc("id")], -1)
