import random
from datetime import datetime, timedelta

import pytest
from conftest import rows

from selvedge.operators.folds import fold_bags

SCHEMA = "bag_id bigint, at timestamp, seq bigint, op string, sku string, quantity int"
START = datetime(2026, 1, 1)


def brute(events, max_lines=20):
    bags = {}
    for bag, _at, _seq, op, sku, quantity in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        lines = bags.setdefault(bag, {})
        if op == "add":
            quantity = max(1, min(10, quantity))
            if sku in lines:
                lines[sku] = min(10, lines[sku] + quantity)
            elif len(lines) < max_lines:
                lines[sku] = quantity
        else:
            quantity = 0 if op == "remove" else max(0, min(10, quantity))
            if quantity == 0:
                lines.pop(sku, None)
            elif sku in lines:
                lines[sku] = quantity
    return sorted((b, n, s, q) for b, lines in bags.items() for n, (s, q) in enumerate(lines.items(), 1))


def make(seed, count, bags, skus, removal):
    rng = random.Random(seed)
    events = []
    for seq in range(count):
        bag = 0 if rng.random() < 0.5 else rng.randrange(bags)
        op = rng.choices(["add", "set", "remove"], weights=[5, 2, removal])[0]
        events.append((bag, START + timedelta(seconds=seq // 2), seq, op, f"s{rng.randrange(skus)}", rng.randint(-1, 12)))
    return events


@pytest.fixture
def many_pieces(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(
    "seed,removal,max_lines,skus", [(1, 2, 20, 12), (2, 1, 3, 12), (3, 0, 3, 30), (4, 0.1, 5, 40), (5, 6, 2, 6)]
)
def test_fold_equals_one_pass_although_a_bag_spans_pieces(spark, many_pieces, seed, removal, max_lines, skus):
    events = make(seed, 1200, 6, skus, removal)
    got = fold_bags(spark.createDataFrame(events, SCHEMA), max_lines=max_lines)
    assert sorted(rows(got)) == brute(events, max_lines)


def test_rules_of_the_bag(spark):
    e = [
        (1, START, 1, "add", "a", 7),
        (1, START, 2, "add", "a", 7),
        (1, START, 3, "set", "ghost", 4),
        (1, START, 4, "add", "b", -3),
        (1, START, 5, "set", "b", 99),
        (1, START, 6, "add", "c", 2),
        (1, START, 7, "set", "c", 0),
        (2, START, 8, "add", "x", 1),
        (2, START, 9, "remove", "x", 5),
        (3, START, 10, "peek", "x", 5),
        (3, START, 11, "add", "", 5),
    ]
    assert sorted(rows(fold_bags(spark.createDataFrame(e, SCHEMA)))) == [(1, 1, "a", 10), (1, 2, "b", 10)]


def test_line_limit(spark):
    e = [(1, START, n, "add", f"s{n:02d}", 1) for n in range(25)]
    got = sorted(rows(fold_bags(spark.createDataFrame(e, SCHEMA))))
    assert [g[2] for g in got] == [f"s{n:02d}" for n in range(20)]


def test_copies_of_an_event_add_up(spark):
    e = [(1, START, 1, "add", "a", 2)] * 3 + [(1, START, 2, "set", "a", 7)] * 2 + [(2, START, 3, "add", "b", 4)] * 500
    assert sorted(rows(fold_bags(spark.createDataFrame(e, SCHEMA)))) == [(1, 1, "a", 7), (2, 1, "b", 10)]


def test_continuing_from_a_state(spark, many_pieces):
    events = make(9, 600, 5, 10, 2)
    whole = brute(events, 4)
    first = fold_bags(spark.createDataFrame(events[:300], SCHEMA), max_lines=4)
    then = fold_bags(spark.createDataFrame(events[300:], SCHEMA), state=first, max_lines=4)
    assert sorted(rows(then)) == whole


def test_keys_beyond_the_doubles_and_events_without_a_bag(spark):
    big = 2**53 + 1
    events = [(big, START, 1, "add", "a", 2), (None, START, 2, "add", "a", 1), (big + 1, START, 3, "add", "b", 1)]
    events += [(7, START, 1, "add", "a", 1), (7, START, 2, "set", "a", 5), (7, START, 2, "set", "a", 3)]
    got = sorted(rows(fold_bags(spark.createDataFrame(events, SCHEMA))))
    assert got == [(7, 1, "a", 5), (big, 1, "a", 2), (big + 1, 1, "b", 1)]
