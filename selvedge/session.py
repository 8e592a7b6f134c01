"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def tune(spark: SparkSession) -> None:
    """Let AQE split a skewed join even where that costs a further shuffle.

    Joins that are shuffled sort both sides: AQE would hash the one that is a shuffle itself, which is the facts where the
    other side is summed first, and a subquery, planned without measures, would not share the shuffles above such a join.
    The files of a shuffle go when the query that wrote them has ended, not when the driver collects its garbage.
    A write into folders keeps a file open for each of up to a hundred folders and sorts its rows only beyond that.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "100")


def lake_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for.

    Joins carry no broadcast hints: Catalyst broadcasts a side only when its measured size
    is under the threshold and falls back to a shuffled join, whose skewed partitions AQE
    splits, when it is not.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.autoBroadcastJoinThreshold", "32MB")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    tune(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session in one process may run without the setting; a cluster without it, a local one
    included, is an error, because a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="selvedge-")
    return _local_dirs[app]


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/selvedge/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    Parquet rather than ``checkpoint()``: later readers still prune columns and row groups.
    """
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
