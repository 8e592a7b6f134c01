import json
from pathlib import Path

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from selvedge import session
from selvedge.plans.adapter import Retail
from selvedge.sources import drops, layout, tables


def test_row_diff_counts_copies(spark):
    old = spark.createDataFrame([(1, 5.0), (2, 20.0), (2, 20.0), (3, None)], "id int, v double")
    left = tables.delete_where(old, F.col("v") > 10)
    assert rows(tables.row_diff(old, left)) == [("removed", 2, 2, 20.0)]
    assert rows(tables.row_diff(left, old)) == [("added", 2, 2, 20.0)]
    assert rows(tables.row_diff(old, old)) == []


def test_compaction(spark, tmp_path):
    small, packed = str(tmp_path / "small"), str(tmp_path / "packed")
    spark.range(2000).repartition(20).write.parquet(small)
    before = layout.table_detail(spark, small).first()
    assert before["num_files"] == 20 and before["avg_bytes"] == before["size_bytes"] / 20
    after = layout.compact(spark, small, packed).first()
    assert after["num_files"] == 1
    assert sorted(rows(spark.read.parquet(packed))) == [(n,) for n in range(2000)]
    more = layout.compact(spark, packed, str(tmp_path / "more"), target_file_bytes=after["size_bytes"] // 3).first()
    assert more["num_files"] >= 3


def test_late_rows_land_and_a_batch_lands_once(spark, tmp_path):
    path = str(tmp_path / "landing")
    df = spark.createDataFrame([("2026-08-01T10:00:00", 1), ("2026-08-03T10:00:00", 2)], "at string, v int")
    drops.write_drops(df, path, "at", "a")
    late = spark.createDataFrame([("2026-08-01T11:00:00", 9), ("2026-08-04T10:00:00", 3)], "at string, v int")
    drops.write_drops(late, path, "at", "b")
    for batch in ("a", "b", "", "x/y"):
        with pytest.raises(ValueError):
            drops.write_drops(df, path, "at", batch)
    assert sorted(p.name for p in Path(path).glob("dt=*")) == ["dt=2026-08-01", "dt=2026-08-03", "dt=2026-08-04"]
    assert sorted(json.loads(line)["v"] for p in Path(path).rglob("*.txt") for line in p.read_text().splitlines()) == [1, 2, 3, 9]


def test_named_tables(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS named")
    tables.write_table(spark.range(3), "named.a")
    tables.snapshot_copy(spark, "named.a", "named.b")
    tables.write_table(spark.range(2).select(F.col("id").cast("string").alias("other")), "named.a")
    assert tables.read_table(spark, "named.a").columns == ["other"]
    assert tables.read_table(spark, "named.b").count() == 3
    tables.drop_table(spark, "named.b")
    tables.drop_table(spark, "named.b")
    assert not spark.catalog.tableExists("named.b")


def test_evolving_folder(spark, tmp_path):
    path = str(tmp_path / "e")
    tables.append_evolving(spark.createDataFrame([(1,)], "a int"), path)
    tables.append_evolving(spark.createDataFrame([(2, "x")], "a int, b string"), path)
    assert sorted(rows(tables.read_evolving(spark, path).select("a", "b")), key=str) == [(1, None), (2, "x")]


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    a, b = session.run_dir(spark, "x"), session.run_dir(spark, "x")
    assert a != b and a.startswith(session.shared_dir(spark))
    assert session.stage(spark.range(4), "s").count() == 4


def test_adapter_reads_only_what_a_query_needs(spark):
    plan = Retail(spark, SMALL).bronze_sales.select("sku", "quantity")._jdf.queryExecution().executedPlan().toString()
    assert "l_discount" not in plan and "l_shipdate" not in plan and "l_quantity" in plan


def test_shuffle_files_go_with_the_query_that_wrote_them(spark, tmp_path):
    from pathlib import Path

    places = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {f for d in places for f in Path(d).rglob("shuffle_*.data")}
    before = held()
    spark.range(0, 50_000, 1, 4).selectExpr("id", "id % 1000 AS k").repartition(3, "k").write.parquet(f"{tmp_path}/t")
    assert held() <= before
