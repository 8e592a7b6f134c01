import json

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvedge.plans import pipeline
from selvedge.plans.adapter import Retail
from selvedge.sources.drops import write_drops
from selvedge.streaming.ingest import ingest_json, known_columns, read_bronze, rescue

HINTS = "quantity INT, price DOUBLE"


@pytest.fixture
def place(spark, tmp_path):
    class Place:
        source, target, checkpoint = (str(tmp_path / n) for n in ("landing", "bronze", "checkpoint"))

        def drop(self, day, name, *lines):
            folder = tmp_path / "landing" / f"dt={day}"
            folder.mkdir(parents=True, exist_ok=True)
            with open(folder / name, "a") as f:
                f.writelines((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines)

        def ingest(self, **options):
            return ingest_json(spark, self.source, self.target, self.checkpoint, HINTS, **options)

    return Place()


def by_id(df):
    return {r["id"]: r.asDict() for r in df.collect()}


def test_rescue_keeps_what_does_not_fit(spark):
    columns = T.StructType.fromDDL("quantity INT, price DOUBLE, id STRING")
    lines = [
        '{"id":"ok","quantity":5,"price":1.5}',
        '{"id":"text","quantity":"5","price":2}',
        '{"id":"float","quantity":5.5,"price":"z"}',
        '{"id":"extra","quantity":1,"more":{"a":1},"gone":null}',
        '{"id":"case","Quantity":1}',
        '{"id":"null","quantity":null}',
        '{"broken',
        "[1,2]",
        "   ",
    ]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [(r["id"], r["quantity"], r["price"], r["_rescued_data"], r["_novel"]) for r in rescue(raw, columns).collect()]
    assert got == [
        ("ok", 5, 1.5, None, False),
        ("text", None, 2.0, '{"quantity":"5"}', False),
        ("float", None, None, '{"quantity":"5.5","price":"z"}', False),
        ("extra", 1, None, '{"more":"{\\"a\\":1}"}', True),
        ("case", None, None, '{"Quantity":"1"}', False),
        ("null", None, None, None, False),
        (None, None, None, '{"broken', False),
        (None, None, None, "[1,2]", False),
    ]


def test_only_new_files_are_taken_in(spark, place):
    place.drop("2026-08-01", "a.json", {"id": "1", "quantity": 1}, {"id": "2", "quantity": "x"}, "junk")
    place.drop("2026-08-02", "a.json", {"id": "3", "quantity": 3})
    first = place.ingest()
    assert first.count() == 4
    assert place.ingest().count() == 4
    place.drop("2026-08-02", "a.json", {"id": "late", "quantity": 3})
    assert place.ingest().count() == 4
    place.drop("2026-08-02", "b.json", {"id": "4", "quantity": 4})
    table = place.ingest()
    got = by_id(table.filter("id IS NOT NULL"))
    assert set(got) == {"1", "2", "3", "4"}
    assert got["2"]["_rescued_data"] == '{"quantity":"x"}'
    assert (got["3"]["dt"], got["1"]["dt"]) == ("2026-08-02", "2026-08-01")
    assert got["4"]["_source_file"].endswith("dt=2026-08-02/b.json")
    assert table.filter("_ingested_at IS NULL").isEmpty()
    assert table.schema["quantity"].dataType == T.IntegerType() and table.schema["dt"].dataType == T.StringType()
    assert [r["_rescued_data"] for r in table.filter("id IS NULL").collect()] == ["junk"]


def test_new_fields_widen_the_table(spark, place):
    place.drop("2026-08-01", "a.json", {"id": "1", "quantity": 1})
    assert "promo" not in place.ingest().columns
    place.drop("2026-08-02", "a.json", {"id": "2", "promo": "P"}, {"id": "3", "Promo": "Q", "dt": "own"})
    got = by_id(place.ingest())
    assert known_columns(spark, place.checkpoint, HINTS).names == ["quantity", "price", "id", "Promo"]
    assert [got[n]["Promo"] for n in ("1", "2", "3")] == [None, None, "Q"]
    assert json.loads(got["2"]["_rescued_data"]) == {"promo": "P"}
    assert json.loads(got["3"]["_rescued_data"]) == {"dt": "own"}


def test_small_batches_give_the_same_table(spark, place):
    for n in range(6):
        place.drop(f"2026-08-0{n + 1}", "a.json", {"id": str(n), "quantity": n, f"f{n % 2}": "v"})
    table = place.ingest(files_per_batch=2)
    assert table.count() == 6 and table.select("ingest_batch").distinct().count() == 3
    assert sorted(r[0] for r in rows(table.select(F.coalesce("f0", "f1")))) == ["v"] * 6


def test_a_repeated_batch_replaces_itself(spark, place):
    place.drop("2026-08-01", "a.json", {"id": "1", "quantity": 1})
    table = place.ingest()
    table.limit(0).select("id").write.mode("append").parquet(place.target + "/ingest_batch=0/dt=2026-08-01")
    again = ingest_json(spark, place.source, place.target, place.checkpoint + "-lost", HINTS)
    assert again.count() == 1


def test_empty_and_missing_inputs(spark, place, tmp_path):
    (tmp_path / "landing").mkdir()
    assert place.ingest().count() == 0
    assert read_bronze(spark, str(tmp_path / "nothing"), place.checkpoint, HINTS).count() == 0
    for bad in ({"source": ""}, {"target": " "}, {"checkpoint": ""}):
        with pytest.raises(ValueError):
            ingest_json(spark, **{"source": "s", "target": "t", "checkpoint": "c", "hints": HINTS, **bad})


def test_more_than_two_thousand_keys_all_become_columns(spark, place):
    place.drop("2026-08-01", "a.json", {"id": "1", **{f"k{n:04d}": "v" for n in range(2100)}}, {"id": "2", "zz": "last"})
    got = by_id(place.ingest())
    assert got["1"]["_rescued_data"] is None and got["2"]["_rescued_data"] is None
    assert got["2"]["zz"] == "last" and got["1"]["k2099"] == "v"


def test_the_whole_lake(spark, tmp_path):
    given = Retail(spark, SMALL)
    paths = [str(tmp_path / n) for n in ("landing", "checkpoints", "lake")]
    streams = {"sales": (given.bronze_sales, "sold_at"), "returns": (given.bronze_returns, "returned_at"), "inventory": (given.bronze_inventory, "snapshot_date")}
    for name, (df, day) in streams.items():
        write_drops(df.drop("_rescued_data"), f"{paths[0]}/{name}", day, "first")
    made = pipeline.run_medallion(spark, *paths, given.products, given.stores)
    count = {name: df.count() for name, (df, _) in streams.items()}
    for stream, rows_in in count.items():
        stats = pipeline.batch_stats(spark, paths[2], stream, "full").first()
        assert stats["rows_in"] == rows_in == stats["kept"] + stats["rejected"]
        assert spark.read.table(f"silver.{stream}").count() == stats["kept"]
    assert set(made) == set(pipeline.MARTS)
    products = given.products.count()
    assert made["product_catalog"].count() == products
    silver = spark.read.table("silver.sales")
    kept = silver.count()
    assert made["daily_sales"].agg(F.sum("units_sold")).first()[0] == silver.agg(F.sum("quantity")).first()[0]
    assert silver.filter("net_revenue > net_amount").isEmpty()
    shares = made["size_curve"].groupBy("style_id").agg(F.sum("demand_share").alias("s"))
    assert shares.filter("abs(s - 100) > 0.5").isEmpty()
    ranks = sorted(r[0] for r in rows(made["style_catalog"].select("popularity_rank")))
    assert ranks == list(range(1, len(ranks) + 1))
    again = pipeline.run_medallion(spark, *paths, given.products, given.stores)
    assert spark.read.table("silver.sales").count() == kept
    assert again["product_catalog"].count() == products
    with pytest.raises(ValueError):
        pipeline.run_medallion(spark, "", paths[1], paths[2], given.products, given.stores)
