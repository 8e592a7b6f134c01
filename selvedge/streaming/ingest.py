"""Incremental JSON ingest: new files only, nothing dropped, columns discovered as they appear."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvedge.sources.drops import ENTRY, MANIFESTS, published_paths

# Lines looked at before the first batch is written.
_GLANCE = 10_000

# Lines whose choice by key comes back to them as one row of words, a bit for each line.
_BLOCK, _WORD = 4_096, 64

# Numeric columns pinned per stream.
STREAM_HINTS = {
    "sales": "quantity INT, unit_price DOUBLE, list_price DOUBLE, discount_pct DOUBLE",
    "inventory": "on_hand INT, on_order INT",
    "returns": "quantity INT",
}

RESCUED, TAIL = "_rescued_data", "_tail"
_OWN = T.StructType().add(RESCUED, "string").add("_source_file", "string").add("_ingested_at", "timestamp")
_FOLDERS = T.StructType().add("ingest_batch", "long").add("dt", "string")
_RESERVED = {TAIL, *[f.name for f in (*_OWN.fields, *_FOLDERS.fields)]}


# --- discovered columns, kept beside the checkpoint ---


def _remembered(spark: SparkSession, checkpoint: str) -> T.StructType | None:
    try:
        found = spark.read.schema("step INT, columns STRING").json(f"{checkpoint}/columns")
        last = found.agg(F.max_by("columns", "step")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    return None if last is None else T.StructType.fromDDL(last)


def known_columns(spark: SparkSession, checkpoint: str, hints: str) -> T.StructType:
    """The columns found so far, or the hinted ones before the first run."""
    return _remembered(spark, checkpoint) or T.StructType.fromDDL(hints)


def _remember(spark: SparkSession, checkpoint: str, columns: T.StructType) -> None:
    entry = [(len(columns), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns))]
    rows = spark.createDataFrame(entry, "step INT, columns STRING")
    rows.coalesce(1).write.mode("append").json(f"{checkpoint}/columns")


# --- rescue ---


def _fields(line: Column) -> Column:
    return F.from_json(line, "map<string,string>")


def _unknown(name: Column, columns: T.StructType) -> Column:
    """A key that could become a column: no column has its name in any case."""
    taken = [f.name.lower() for f in columns] + [c.lower() for c in _RESERVED]
    return ~F.lower(name).isin(*taken) & (name != "")


def _sum(terms: list[Column]) -> Column:
    """The terms added up by halves: thousands of them nest a few levels deep."""
    if len(terms) < 2:
        return terms[0] if terms else F.lit(0)
    half = len(terms) // 2
    return _sum(terms[:half]) + _sum(terms[half:])


def rescue(raw: DataFrame, columns: T.StructType, tail: bool = False, hinted: T.StructType | None = None) -> DataFrame:
    """Parse JSON lines to ``columns``, keeping whatever does not fit in ``_rescued_data``.

    Rescued are values of the wrong type and keys without a column; a line that is no JSON
    object is rescued whole. ``_novel`` marks rows with a key that could become a column.
    With ``tail`` keys without a column are kept, types and all, in the VARIANT ``_tail`` instead.
    With ``hinted``, the columns that were not found but given, a key that differs from a found one in its case alone
    is marked too: the column's name is not settled then.
    """
    parsed = raw.filter(F.trim("value") != "").withColumns(
        {"_typed": F.from_json("value", columns), "_keys": F.json_object_keys("value")}
    )
    fields = _fields(F.col("value"))
    if columns.fields:
        blank = F.array_compact(
            F.array(*[F.when(F.col("_typed").getField(f.name).isNull(), F.lit(f.name)) for f in columns])
        )
        names = F.array(*[F.lit(f.name) for f in columns])
    else:
        blank = names = F.array().cast("array<string>")

    def misfit(key: Column, value: Column) -> Column:
        named = F.array_contains(names, key)
        return value.isNotNull() & (named & F.array_contains(blank, key) if tail else ~named | F.array_contains(blank, key))

    # A row with as many typed values as keys has nothing to rescue. That is the usual case,
    # and it is spared the second parse.
    typed = _sum([F.col("_typed").getField(f.name).isNotNull().cast("int") for f in columns])
    clean = typed == F.size("_keys")
    left_over = F.nullif(F.to_json(F.map_filter(fields, misfit)), F.lit("{}"))
    new = (lambda k: _unknown(k, columns)) if hinted is None else (lambda k: _unknown(k, hinted) & ~F.array_contains(names, k))
    novel = F.when(clean, False).otherwise(F.exists("_keys", new))
    kept_apart = []
    if tail:
        rest = F.map_filter(F.from_json("value", "map<string,variant>"), lambda k, v: ~F.is_variant_null(v) & ~F.array_contains(names, k))
        parsed = parsed.withColumn("_rest", F.when(~clean, rest))  # a column of its own, so that it is parsed once
        kept_apart = [F.when(F.size("_rest") > 0, F.to_variant_object("_rest")).alias(TAIL)]
        novel = F.lit(False)
        # Only a hinted column that is blank can have a value that does not fit it.
        left_over = F.when(typed < len(columns), left_over)
    rescued = F.when(F.col("_keys").isNull(), F.col("value")).when(clean, None).otherwise(left_over)
    carried = [c for c in raw.columns if c != "value"]
    return parsed.select(
        *[F.col("_typed").getField(f.name).alias(f.name) for f in columns],
        *carried,
        *kept_apart,
        rescued.alias(RESCUED),
        F.coalesce(novel, F.lit(False)).alias("_novel"),
    )


def _discover(raw: DataFrame, columns: T.StructType) -> T.StructType:
    """``columns`` plus every new key of the batch as a string, in name order.

    Keys differing only in case are one column, named after the first in order. Every key becomes
    a column, so no key's place in that order decides what later steps keep.
    """
    shapes = raw.select(F.json_object_keys("value").alias("keys")).distinct()
    keys = shapes.select(F.explode("keys").alias("key")).filter(_unknown(F.col("key"), columns))
    names = keys.groupBy(F.lower("key").alias("name")).agg(F.min("key").alias("key")).orderBy("key")
    found = names.collect()  # column names, not rows
    return T.StructType([*columns.fields, *[T.StructField(row["key"], T.StringType()) for row in found]])


# --- the stream ---


def with_provenance(df: DataFrame) -> DataFrame:
    """Which file a row came from, taken before anything hides the source."""
    return df.withColumn("_source_file", F.col("_metadata.file_path"))


def _checked(**places: str) -> list[str]:
    for name, value in places.items():
        if not value or not value.strip():
            raise ValueError(f"{name} is required")
    return [p.rstrip("/") for p in places.values()]


class _Table:
    """An ingested table: every micro-batch owns one folder of it and replaces it when retried."""

    def __init__(self, target: str, checkpoint: str, hints: str, tail: bool = False):
        self.target, self.checkpoint, self.hints, self.tail = target, checkpoint, hints, tail

    def _write(self, lines: DataFrame, batch_id: int, columns: T.StructType, hinted: T.StructType | None = None) -> bool:
        seen = Observation()
        rows = rescue(lines, columns, self.tail, hinted).withColumn("_ingested_at", F.current_timestamp())
        counted = rows.observe(seen, F.coalesce(F.bool_or("_novel"), F.lit(False)).alias("novel")).drop("_novel")
        counted.write.mode("overwrite").partitionBy("dt").parquet(f"{self.target}/ingest_batch={batch_id}")
        return seen.get["novel"]

    def _widen(self, lines: DataFrame, columns: T.StructType) -> T.StructType:
        if self.tail:
            return columns
        wider = _discover(lines, columns)
        if len(wider) > len(columns):
            _remember(lines.sparkSession, self.checkpoint, wider)
        return wider

    def land(self, lines: DataFrame, batch_id: int) -> None:
        """A batch is written in one pass, and only when it turns out to bring new keys are the columns widened and the
        batch written again. The first batch is written under the columns of a glance at some of its lines; if it holds
        others they are found from all of its lines, so that the columns are those of the whole batch either way."""
        columns = _remembered(lines.sparkSession, self.checkpoint)
        if columns is None:
            hinted = T.StructType.fromDDL(self.hints)
            guess = hinted if self.tail else _discover(lines.limit(_GLANCE), hinted)
            if self._write(lines, batch_id, guess, hinted):
                self._write(lines, batch_id, self._widen(lines, hinted))
            elif len(guess) > len(hinted):
                _remember(lines.sparkSession, self.checkpoint, guess)
        elif self._write(lines, batch_id, columns):
            wider = self._widen(lines, columns)
            if len(wider) > len(columns):
                self._write(lines, batch_id, wider)

    def take_in(self, stream: DataFrame, land) -> DataFrame:
        query = (
            stream.writeStream.foreachBatch(land)
            .option("checkpointLocation", f"{self.checkpoint}/commits")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return read_bronze(stream.sparkSession, self.target, self.checkpoint, self.hints, self.tail)


class _Once:
    """The keys that were taken in, kept beside the checkpoint, and the lines of a batch that bring new ones.

    The lines stay where they are read: their keys travel with the places of the lines in the batch, and what was chosen
    comes back as one bit for each line. Every batch owns one folder of keys and replaces it when retried.
    """

    def __init__(self, checkpoint: str, key: str, within: str):
        self.keys, self.chosen = f"{checkpoint}/once/keys", f"{checkpoint}/once/chosen"
        self.key = F.coalesce(F.get_json_object("value", f"$['{key}']"), F.col("value"))
        self.within = F.expr(f"INTERVAL '{within}'")

    def _known(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The keys of earlier batches but those that are forgotten: lines had landed more than twice the time after them."""
        schema = "key STRING, place LONG, batch LONG, landed LONG"
        try:
            log = spark.read.schema(schema).parquet(self.keys).withColumn("landed", F.timestamp_micros("landed"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)
        newest = log.filter(F.col("batch") < batch_id - 1).agg(F.max("landed")).scalar()
        kept = F.coalesce(F.col("landed") + self.within + self.within > newest, F.lit(True))
        return log.filter((F.col("batch") < batch_id) & kept)

    def _choose(self, lines: DataFrame, batch_id: int) -> int:
        """Write down the new keys of a batch and the places of their first lines; returns how many they are."""
        spark, mine = lines.sparkSession, f"{self.keys}/batch={batch_id}"
        placed = lines.select(self.key.alias("key"), F.monotonically_increasing_id().alias("place"), "value")
        keys = placed.filter(F.trim("value") != "").select("key", "place")
        # Dealt by key first: keys hardly repeat within a task, so summing them there would only hold them in memory.
        firsts = keys.repartition("key").groupBy("key").agg(F.min("place").alias("place"))
        fresh = firsts.join(self._known(spark, batch_id).select("key"), "key", "left_anti")
        dated = fresh.withColumn("landed", F.lit(time.time_ns() // 1000))
        dated.write.mode("overwrite").partitionBy("landed").option("compression", "zstd").parquet(mine)
        places = spark.read.schema("place LONG").parquet(mine)
        dealt = places.select("place", F.floor(F.col("place") / _BLOCK).alias("_block")).repartition("_block")
        bit = F.expr(f"shiftleft(1L, cast(place % {_WORD} as int))")
        word = F.floor(F.col("place") % _BLOCK / _WORD).alias("word")
        words = dealt.groupBy("_block", word).agg(F.bit_or(bit).alias("bits"))
        found = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
        every = F.sequence(F.lit(0).cast("long"), F.lit(_BLOCK // _WORD - 1).cast("long"))
        filled = F.transform(every, lambda i: F.coalesce(F.try_element_at("_found", i), F.lit(0).cast("long")))
        blocks = words.groupBy("_block").agg(found.alias("_found")).select("_block", filled.alias("_words"))
        blocks.write.mode("overwrite").parquet(f"{self.chosen}/batch={batch_id}")
        return places.count()

    def land(self, table: _Table, lines: DataFrame, batch_id: int) -> None:
        """Land the first line of every key that is not known. Both passes read the batch's one scan, whose places are fixed."""
        spark = lines.sparkSession
        most = self._choose(lines, batch_id)
        blocks = spark.read.schema("_block LONG, _words ARRAY<LONG>").parquet(f"{self.chosen}/batch={batch_id}")
        placed = lines.withColumn("_place", F.monotonically_increasing_id())
        placed = placed.withColumn("_block", F.floor(F.col("_place") / _BLOCK))
        # The words are an eighth of a byte for each line, so they go to the lines.
        marked = placed.join(F.broadcast(blocks), "_block")
        own = F.get("_words", F.floor(F.col("_place") % _BLOCK / _WORD).cast("int"))
        taken = marked.filter(F.getbit(own, F.col("_place") % _WORD) == 1).select(*lines.columns)
        table.land(taken, batch_id)
        written = spark.read.schema(_OWN).parquet(f"{table.target}/ingest_batch={batch_id}").count()
        if written != most:
            raise RuntimeError(f"batch {batch_id} was read otherwise the second time: {written} lines for {most} keys; run it again")


def ingest_json(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    hints: str,
    files_per_batch: int = 10_000,
    once: str | None = None,
    within: str = "7 days",
    tail: bool = False,
) -> DataFrame:
    """Ingest the files that are new since the last run, then stop; returns the whole table.

    A batch that fails half-way and runs again leaves its rows once.

    ``tail`` keeps to the hinted columns and puts all other keys of a row into one VARIANT, however many there are:
    no list of names is kept anywhere, and :func:`tail_types` tells what came.

    ``once`` names a key, such as the transaction id: of lines that share it only the first is taken in, if the others
    land ``within`` that time after it, whatever files they come in. A line without the key is known by its whole text.
    The time is that of landing, so late rows are no older than others and none is dropped for its age. The keys lie
    beside the checkpoint; one is forgotten when lines landed more than twice that time after it.
    """
    source, target, checkpoint = _checked(source=source, target=target, checkpoint=checkpoint)
    lines = spark.readStream.schema("value STRING, dt STRING").option("maxFilesPerTrigger", files_per_batch).text(source)
    traced = with_provenance(lines.select("value", "dt", "_metadata"))
    table = _Table(target, checkpoint, hints, tail)
    if once:
        first = _Once(checkpoint, once, within)
        return table.take_in(traced, lambda lines, batch_id: first.land(table, lines, batch_id))
    return table.take_in(traced, table.land)


def ingest_landing(
    spark: SparkSession, landing: str, target: str, checkpoint: str, hints: str, batches_per_run: int = 1_000, tail: bool = False
) -> DataFrame:
    """Ingest the batches published in a landing folder since the last run, then stop; returns the whole table.

    The stream is that of the manifests; a micro-batch reads the folders they name, so files of a landing that stopped
    half-way are never seen, and a batch comes in once however often its landing was tried.
    """
    landing, target, checkpoint = _checked(landing=landing, target=target, checkpoint=checkpoint)
    manifests = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", batches_per_run).option("recursiveFileLookup", "true")
    table = _Table(target, checkpoint, hints, tail)

    def land(named: DataFrame, batch_id: int) -> None:
        paths = published_paths(landing, named.collect())  # a row for each day of a batch
        if paths:
            reader = named.sparkSession.read.schema("value STRING, dt STRING").option("basePath", landing)
            table.land(with_provenance(reader.text(paths).select("value", "dt", "_metadata")), batch_id)

    try:
        stream = manifests.json(f"{landing}/{MANIFESTS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return read_bronze(spark, target, checkpoint, hints, tail)
    return table.take_in(stream, land)


def read_bronze(spark: SparkSession, target: str, checkpoint: str, hints: str, tail: bool = False) -> DataFrame:
    """The ingested table under all columns found so far; no file is opened to learn the schema."""
    columns = known_columns(spark, checkpoint.rstrip("/"), hints)
    apart = [T.StructField(TAIL, T.VariantType())] if tail else []
    schema = T.StructType([*columns.fields, *apart, *_OWN.fields, *_FOLDERS.fields])
    try:
        return spark.read.schema(schema).parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def tail_types(table: DataFrame) -> DataFrame:
    """(name, type, rows): the keys in the tail, the type that holds all their values, and how many rows have them."""
    keys = table.sparkSession.sql(f"SELECT t.key AS name, t.value FROM {{table}}, LATERAL variant_explode({TAIL}) AS t", table=table)
    return keys.groupBy("name").agg(F.schema_of_variant_agg("value").alias("type"), F.count(F.lit(1)).alias("rows"))


def tail_column(name: str, kind: str) -> Column:
    """One key of the tail as a column of a type; NULL where it is not there or does not fit."""
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(F.col(TAIL), f"$['{quoted}']", kind)
