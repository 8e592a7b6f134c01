"""Published batches, the VARIANT tail and copies taken in once."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvedge.sources import drops
from selvedge.streaming import ingest

HINTS = "id INT, v DOUBLE"


class Place:
    def __init__(self, spark, root):
        self.spark, self.landing = spark, f"{root}/landing"
        self.target, self.checkpoint = f"{root}/bronze", f"{root}/checkpoint"

    def write(self, lines, batch, dt="2026-08-01"):
        frame = self.spark.createDataFrame([(x, dt) for x in lines], "line string, dt string")
        drops.write_lines(frame, self.landing, F.col("dt").try_cast("date"), F.col("line"), batch)

    def take(self, **options):
        return ingest.ingest_landing(self.spark, self.landing, self.target, self.checkpoint, HINTS, **options)


def test_a_landing_that_stops_half_way_can_be_tried_again(spark, tmp_path):
    place = Place(spark, tmp_path)
    assert rows(place.take()) == []  # nothing has landed yet
    place.write(['{"id":1}'], "a")
    # Files without a manifest: an attempt that stopped.
    stopped = spark.createDataFrame([('{"id":2}', "2026-08-01", "b", "x")], "value string, dt string, batch string, attempt string")
    stopped.write.mode("append").partitionBy("dt", "batch", "attempt").text(place.landing)
    assert [r.id for r in place.take().collect()] == [1]
    place.write(['{"id":2}', '{"id":3}'], "b")
    place.write([], "empty")
    place.write(['{"id":4}'], "undated", dt="no day")
    assert sorted(r.id for r in place.take().collect()) == [1, 2, 3, 4]
    assert sorted(r.id for r in place.take().collect()) == [1, 2, 3, 4]
    for batch in ("a", "b", "empty"):
        with pytest.raises(ValueError):
            place.write(['{"id":9}'], batch)
    assert {(r.batch, r.dt) for r in drops.landed_batches(spark, place.landing).collect()} == {
        ("a", "2026-08-01"), ("b", "2026-08-01"), ("empty", None), ("undated", "__HIVE_DEFAULT_PARTITION__"),
    }
    assert drops.landed_batches(spark, place.landing, "nothing").isEmpty()


def test_the_tail_keeps_types_of_any_number_of_keys(spark, tmp_path):
    place = Place(spark, tmp_path)
    lines = [json.dumps({"id": k, f"k{k}": k, "Id": "other", "deep": {"a": [1, k]}, "sometimes": k if k % 2 else f"s{k}", "none": None}) for k in range(2000)]
    lines += ['{"id":"x","v":1.5,"more":true}', '{"id":7}', "broken {", '{"id":8,"v":2.0}']
    place.write(lines, "a")
    table = place.take(tail=True)
    types = {r.name: (r.type, r.rows) for r in ingest.tail_types(table).collect()}
    assert len(types) == 2004 and types["k7"] == ("BIGINT", 1) and types["Id"] == ("STRING", 2000) and types["more"] == ("BOOLEAN", 1)
    assert types["deep"] == ("OBJECT<a: ARRAY<BIGINT>>", 2000) and types["sometimes"][1] == 2000
    got = table.select("id", "v", ingest.tail_column("k5", "int").alias("k5"), ingest.tail_column("more", "boolean").alias("more"), "_rescued_data", F.col("_tail").isNull().alias("bare"))
    by_id = {r.id: r for r in got.collect() if r.id is not None and r._rescued_data is None}
    assert by_id[5].k5 == 5 and by_id[6].k5 is None and by_id[8].bare and not by_id[5].bare
    rescued = sorted(r._rescued_data for r in got.collect() if r._rescued_data)
    assert rescued == ["broken {", '{"id":"x"}']
    place.write(['{"id":3000,"later":1}'], "b")
    assert "later" in {r.name for r in ingest.tail_types(place.take(tail=True)).collect()}


def test_copies_come_in_once_whatever_their_files(spark, tmp_path):
    place = Place(spark, tmp_path)

    def take():
        return ingest.ingest_json(spark, place.landing, place.target, place.checkpoint, HINTS, once="id")

    place.write(['{"id":1}', '{"id":2}', "broken", '{"v":1.0}'], "a")
    place.write(['{"id":1,"v":2.0}', "broken", '{"id":3}'], "b", dt="2026-08-02")
    assert take().count() == 5
    place.write(['{"id":3}', '{"id":4}', '{"v":1.0}'], "c")
    assert sorted(r.id or 0 for r in take().collect()) == [0, 0, 1, 2, 3, 4]


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(found.apply(k).shuffleWriteBytes() for k in range(found.size()))


def test_lines_taken_in_once_are_not_moved(spark, tmp_path):
    """Half of the lines are copies in other files; of all only keys and places travel, and no state store holds them."""
    place = Place(spark, tmp_path)
    text = "concat('{\"id\":', id, ',\"more\":\"', sha2(cast(id as string), 512), sha2(cast(-id as string), 512), '\"}') AS line"
    frame = spark.range(0, 9000, 1, 4).selectExpr(text, "concat('2026-08-0', 1 + id % 2) AS dt")
    for batch in "ab":
        drops.write_lines(frame, place.landing, F.col("dt").cast("date"), F.col("line"), batch, gather=False, compression="gzip")
    before = shuffled(spark)
    table = ingest.ingest_json(spark, place.landing, place.target, place.checkpoint, HINTS, once="id")
    assert shuffled(spark) - before < 18_000 * 100  # a line has more than 280 characters that do not compress to fewer than 128
    assert not (tmp_path / "checkpoint" / "commits" / "state").exists()
    assert sorted(r.id for r in table.collect()) == list(range(9000))
    wrong = table.filter("more <> concat(sha2(cast(id as string), 512), sha2(cast(-id as string), 512)) OR more IS NULL")
    assert wrong.isEmpty()


def test_a_key_is_forgotten_long_after_it_landed(spark, tmp_path, monkeypatch):
    place, clock = Place(spark, tmp_path), [0]
    monkeypatch.setattr(ingest.time, "time_ns", lambda: clock[0])

    def take(day, *lines):
        clock[0] = day * 86_400 * 10**9
        place.write(lines, f"day{day}")
        return ingest.ingest_json(spark, place.landing, place.target, place.checkpoint, HINTS, once="id", within="2 days").count()

    assert take(1, '{"id":1}', '{"id":2}', " ", "") == 2
    assert take(3, '{"id":1}', '{"id":3}') == 3  # within the time
    assert take(9, '{"id":2}', '{"id":3}', '{"id":4}') == 4  # nothing landed so late before
    assert take(10, '{"id":3}') == 4
    assert take(11, '{"id":1}', '{"id":3}', '{"id":4}') == 6  # that of day 9 came long after the first two days


def test_a_retried_batch_leaves_its_first_lines_once(spark, tmp_path, monkeypatch):
    place = Place(spark, tmp_path)
    options = (spark, place.landing, place.target, place.checkpoint, HINTS)
    place.write(['{"id":1}', '{"id":1,"v":1.0}'], "a")
    assert ingest.ingest_json(*options, once="id").count() == 1
    place.write(['{"id":1}', '{"id":2}', '{"id":2}', '{"id":3}'], "b")
    with monkeypatch.context() as patch:  # it stops after its keys were written down
        patch.setattr(ingest._Table, "_write", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            ingest.ingest_json(*options, once="id")
    assert sorted(r.id for r in ingest.ingest_json(*options, once="id").collect()) == [1, 2, 3]


def test_lines_can_land_without_being_moved(spark, tmp_path):
    place = Place(spark, tmp_path)
    frame = spark.range(0, 4000, 1, 4).selectExpr("concat('{\"id\":', id, '}') AS line", "concat('2026-08-0', 1 + id % 2) AS dt")
    context = spark.sparkContext
    context.setJobGroup("landing", "")
    try:
        drops.write_lines(frame, place.landing, F.col("dt").cast("date"), F.col("line"), "a", gather=False, compression="snappy")
        status = context.statusTracker()
        tasks = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("landing") for s in status.getJobInfo(j).stageIds]
    finally:
        context.setJobGroup("rest", "")
    files = list((tmp_path / "landing").rglob("*.snappy"))
    assert 4 in tasks and len(files) == 8  # two days of four tasks
    assert sorted(r.id for r in place.take().collect()) == list(range(4000))


@pytest.mark.parametrize("late", ['{"id":2,"more":"x"}', '{"id":2,"First":"x"}', '{"id":2}'])
def test_columns_of_a_glance_are_those_of_the_whole_batch(spark, tmp_path, monkeypatch, late):
    looked = []
    discover = ingest._discover
    monkeypatch.setattr(ingest, "_GLANCE", 1)
    monkeypatch.setattr(ingest, "_discover", lambda lines, columns: looked.append(1) or discover(lines, columns))
    place = Place(spark, tmp_path)
    place.write(['{"id":1,"first":"a"}'] * 3 + [late], "a")
    table = place.take()
    whole = discover(spark.createDataFrame([('{"id":1,"first":"a"}',), (late,)], "value string"), T.StructType.fromDDL(HINTS))
    assert table.columns[: len(whole)] == whole.names and table.count() == 4
    assert len(looked) == (1 if len(whole) == 3 and whole.names[2] == "first" else 2)
    assert table.filter("_rescued_data IS NOT NULL").count() == (3 if "First" in late else 0)
