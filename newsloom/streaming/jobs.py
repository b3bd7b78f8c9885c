"""Streaming jobs: item counts, dedup, fetch cooldown, ingestion, cache upsert.

Results are written as files under a shared folder, never gathered on the
driver. Jobs run with ``availableNow`` here; drop the trigger to keep them up.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from newsloom.operators.ranking import top_per_group
from newsloom.session import checkpoint_dir
from newsloom.sources.cachelog import CacheLog

LATENESS = "36 hours"


def landed_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str, files: int = 100) -> DataFrame:
    """New files of a landing folder as a stream, a bounded number per batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files)
        .parquet(folder)
    )


def _arrive(spark: SparkSession, files: list) -> None:
    """Set the times that the file source goes by, one second apart."""
    for i, file in enumerate(files):
        fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.setTimes(file, 1_000_000_000_000 + 1_000 * i, -1)


def _parts_in(spark: SparkSession, folder) -> list:
    """Data files of a folder, by name."""
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted((f.getPath() for f in found if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())


def land_in_order(rows: DataFrame, name: str, by: list[str], files: int) -> str:
    """Write a table as files that a stream reads in the order of some columns.

    Ranges of the order become files, which arrive one after the other.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark)}/landed/{name}-{uuid.uuid4().hex}"
    rows.repartitionByRange(files, *by).sortWithinPartitions(*by).write.parquet(folder)
    _arrive(spark, _parts_in(spark, spark._jvm.org.apache.hadoop.fs.Path(folder)))
    return folder


def land_by(rows: DataFrame, name: str, number: str) -> str:
    """Write a table as one file per value of an integer column, arriving in its order."""
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark)}/landed/{name}-{uuid.uuid4().hex}"
    rows.repartition(F.col(number)).write.partitionBy(number).parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    batches = sorted((f.getPath() for f in found if "=" in f.getPath().getName()), key=lambda p: int(p.getName().split("=")[1]))
    _arrive(spark, [p for b in batches for p in _parts_in(spark, b)])
    return folder


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    return f"{base}/rows", f"{base}/state"


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_append(stream: DataFrame, name: str, rocksdb: bool = False) -> DataFrame:
    """Run an append stream over what is there and return its rows."""
    spark = stream.sparkSession
    rows, state = _folders(spark, name)
    before = spark.conf.get(PROVIDER)
    if rocksdb:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("path", rows)
            .option("checkpointLocation", state)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(rows)


def run_update(stream: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Run an updating stream; the newest row per key is the result.

    A batch replayed after a failure overwrites its own folder.
    """
    spark = stream.sparkSession
    rows, state = _folders(spark, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", state)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    saved = spark.read.option("basePath", rows).parquet(f"{rows}/batch=*")
    return top_per_group(saved, key, [F.desc("batch")], 1).drop("batch")


def item_counts(stream: DataFrame, ts: str, source: str, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Items per source and window; rows later than the limit are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    counts = stream.withWatermark(ts, LATENESS).groupBy(w.alias("w"), source).agg(F.count(F.lit(1)).alias("items"))
    return counts.select(F.col("w.start").alias("window_start"), source, "items")


def length_histogram(stream: DataFrame, ts: str, source: str, length: str) -> DataFrame:
    """Items per source, day and length: a summary that adds up over days.

    Kept in streaming state instead of the lengths themselves, so the state has a
    row per distinct length of a day, and medians over any days are exact.
    """
    day = F.window(ts, "1 day").alias("w")
    counts = stream.withWatermark(ts, LATENESS).groupBy(day, source, length).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date("w.start").alias("day"), source, length, "n")


def rolling_medians(histogram: DataFrame, source: str, length: str, days: int = 14) -> DataFrame:
    """(day, source, items, median) over the ``days`` up to each day that has items.

    Every histogram row is added to the days that it counts for; a day's rows of a
    source are then a histogram themselves, combined per task before the shuffle.
    """
    active = histogram.select(source, F.col("day").alias("_day")).distinct()
    spread = histogram.withColumn("_day", F.explode(F.expr(f"sequence(day, date_add(day, {days - 1}))")))
    rolled = spread.groupBy(source, "_day", length).agg(F.sum("n").alias("n")).join(active, [source, "_day"], "left_semi")
    out = rolled.groupBy(source, "_day").agg(F.sum("n").alias("items"), F.percentile(length, 0.5, F.col("n")).alias("median"))
    return out.withColumnRenamed("_day", "day").select("day", source, "items", "median")


class LateRows:
    """Sink that tells rows in time from late ones, and keeps both.

    A row is late if it is older than the newest row of all earlier batches by
    more than the lateness. Each batch writes its rows under (batch, late) and one
    line on what it saw; a replayed batch overwrites its own.
    """

    def __init__(self, base: str, ts: str, lateness: str = LATENESS):
        self.base, self.ts, self.lateness = base, ts, lateness

    _SEEN = "batch long, newest timestamp, rows long, late long"

    def seen(self, spark: SparkSession) -> DataFrame:
        """(batch, newest, rows, late) of the batches."""
        return spark.read.schema(self._SEEN).json(f"{self.base}/seen/*")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        limit = None
        if batch_id:
            before = self.seen(spark).where(F.col("batch") < batch_id)
            limit = before.agg((F.max("newest") - F.expr(f"INTERVAL {self.lateness}")).alias("t")).first()["t"]
        late = F.lit(False) if limit is None else F.coalesce(F.col(self.ts) < F.lit(limit), F.lit(False))
        told = Observation()
        rows = batch.withColumn("late", late).observe(
            told, F.max(self.ts).alias("newest"), F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late")
        )
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{self.base}/rows/batch={batch_id}")
        line = [(batch_id, told.get["newest"], told.get["rows"], told.get["late"])]
        spark.createDataFrame(line, self._SEEN).coalesce(1).write.mode("overwrite").json(f"{self.base}/seen/{batch_id}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows with ``batch`` and ``late``."""
        rows = spark.read.option("basePath", f"{self.base}/rows").parquet(f"{self.base}/rows/batch=*")
        return rows.withColumn("late", F.col("late").cast("boolean"))


def run_late_rows(stream: DataFrame, name: str, ts: str, lateness: str = LATENESS) -> LateRows:
    """Run the sink over what is there and return it."""
    base, state = _folders(stream.sparkSession, name)
    sink = LateRows(base, ts, lateness)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return sink


def dropped_rows(progress: list) -> int:
    """Rows that stateful operators dropped as late, from a query's ``recentProgress``."""
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in json.loads(p.json)["stateOperators"])


def first_seen(stream: DataFrame, ts: str, key: list[str]) -> DataFrame:
    """First item per key; keys are remembered for the lateness limit."""
    return stream.withWatermark(ts, LATENESS).dropDuplicatesWithinWatermark(key)


def arrival_time(published: Column, fetched_at: Column) -> Column:
    """Event time of an item; undated ones count from their retrieval."""
    return F.coalesce(published, fetched_at)


# Seconds without fetching after a failed attempt, by status.
TOO_MANY = 429
TOO_MANY_SECONDS = 6 * 3600
GONE = [400, 401, 404, 410]
GONE_SECONDS = 24 * 3600

STATE = "cooldown_until double, last_checked double, last_status int, last_success double"
DECISION = T.StructType(
    [
        T.StructField("feed_key", T.StringType()),
        T.StructField("attempt", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("cooldown_until", T.DoubleType()),
    ]
)


DECIDED = Row(*DECISION.names)


def _known(v: float | None) -> float | None:
    """A number, none for NaN."""
    return None if v is None or v != v else v


def _after(at: float, status: int | None, ok: bool, too_many: int, gone: int) -> float:
    """End of the cooldown that an attempt opens, 0 for none."""
    if ok or status is None:
        return 0.0
    if status == TOO_MANY:
        return at + too_many
    return at + gone if status in GONE else 0.0


class Cooldown(StatefulProcessor):
    """Cooldown state of a feed, and the decisions on its attempts.

    The state is one value per feed; it starts from the table carried over from
    runs before. Rows come in batches of many feeds: a data frame per feed costs
    more than its few attempts. With ``forget_days``, timers in event time report a feed as due
    when its cooldown ends and forget a feed that has had no attempt for so long.
    """

    def __init__(self, too_many: int, gone: int, forget_days: int | None):
        self.too_many, self.gone = too_many, gone
        self.forget = None if forget_days is None else forget_days * 86_400.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feed", STATE)

    def _timers(self, until: float, checked: float | None) -> None:
        """Timers for the end of the cooldown and for forgetting, in place of older ones."""
        if self.forget is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            for at in {until, (checked or 0.0) + self.forget} - {0.0}:
                self.handle.registerTimer(int(at * 1000))

    def _state(self) -> tuple:
        # One call to the state store per feed; an empty state reads as none.
        return self.state.get() or (0.0, None, None, None)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        status = _known(initialState.last_status)
        until, checked = _known(initialState.cooldown_until) or 0.0, _known(initialState.last_checked)
        self.state.update((until, checked, None if status is None else int(status), _known(initialState.last_success)))
        self._timers(until, checked if checked is not None else until)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        until, checked, last, success = self._state()
        # Slim rows of the feed's attempts of one micro-batch, which its files bound.
        some = [(_known(r.at), r.attempt, _known(r.status_code), r.has_content, _known(r.own_429), _known(r.own_error)) for r in rows]
        some.sort(key=lambda r: (r[0] is None, r[0] or 0.0, r[1] is None, r[1] or 0))
        out = []
        for at, number, code, content, own_429, own_error in some:
            timed = at is not None
            if timed and until > at:
                out.append(DECIDED(key[0], number, "skipped_cooldown", until))
                continue
            status, ok = None if code is None else int(code), bool(content)
            too_many = self.too_many if own_429 is None else int(own_429)
            gone = self.gone if own_error is None else int(own_error)
            until, last = _after(at, status, ok, too_many, gone) if timed else 0.0, status
            checked = at if timed else checked
            success = at if ok and timed else success
            out.append(DECIDED(key[0], number, "ok" if ok else "http_error", until))
        self.state.update((float(until), checked, last, success))
        self._timers(until, checked)
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until, checked, _, _ = self._state()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if checked is not None and at >= int((checked + self.forget) * 1000):
            self.state.clear()
        if until and at == int(until * 1000):
            yield DECIDED(key[0], None, "due", until)

    def close(self) -> None:
        pass


def cooldown_stream(
    attempts: DataFrame,
    too_many: int = TOO_MANY_SECONDS,
    gone: int = GONE_SECONDS,
    state: DataFrame | None = None,
    forget_days: int | None = None,
) -> DataFrame:
    """Decide attempts per feed with the cooldown state of the feed.

    ``attempts``: feed_key, attempt, at (epoch seconds), status_code,
    has_content, and optionally a feed's own cooldowns
    (cooldown_on_429_seconds, cooldown_on_error_seconds). An attempt inside a
    cooldown is skipped and changes nothing; one without a time is never skipped
    and opens none. ``state`` is a table as ``apply_attempts`` returns it. The
    session needs the RocksDB state store (``run_append(..., rocksdb=True)``).
    With ``forget_days`` attempts later than the watermark are dropped.
    """
    own = {"own_429": "cooldown_on_429_seconds", "own_error": "cooldown_on_error_seconds"}
    extra = [(F.col(c) if c in attempts.columns else F.lit(None)).cast("double").alias(n) for n, c in own.items()]
    given = attempts.select("feed_key", "attempt", "at", F.col("status_code").cast("double").alias("status_code"), "has_content", *extra)
    if forget_days is not None:
        given = given.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", LATENESS)
    first = None
    if state is not None:
        kept = state.select("feed_key", "cooldown_until", "last_checked", F.col("last_status").cast("double").alias("last_status"), "last_success")
        first = kept.groupBy("feed_key")
    mode = "None" if forget_days is None else "EventTime"
    return given.groupBy("feed_key").transformWithState(Cooldown(too_many, gone, forget_days), DECISION, "append", mode, first)


def cooldown_replay(attempts: DataFrame, too_many: int = TOO_MANY_SECONDS, gone: int = GONE_SECONDS) -> DataFrame:
    """Decide the whole history of every feed at once, as ``cooldown_stream`` does.

    A task reads its feeds sorted by time and holds one state, so a feed of any
    length needs no memory; its attempts depend on each other and stay in one
    task. An attempt without a time is never skipped and opens no cooldown.
    """
    names = ["feed_key", "attempt", "at", "status_code", "has_content"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, until = None, 0.0
        for batch in batches:
            feeds, numbers, times, codes, contents = (batch.column(c).to_pylist() for c in names)
            outcomes, ends = [], []
            for feed, at, status, ok in zip(feeds, times, codes, contents, strict=True):
                if feed != now:
                    now, until = feed, 0.0
                if at is not None and until > at:
                    outcomes.append("skipped_cooldown")
                else:
                    until = 0.0 if at is None else _after(at, status, bool(ok), too_many, gone)
                    outcomes.append("ok" if ok else "http_error")
                ends.append(until)
            columns = [pa.array(feeds, pa.string()), pa.array(numbers, pa.int64()), pa.array(outcomes, pa.string()), pa.array(ends, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in DECISION])

    dealt = attempts.select(*names).repartition("feed_key")
    return dealt.sortWithinPartitions("feed_key", F.asc_nulls_last("at"), "attempt").mapInArrow(decide, DECISION)


STATE_DDL = "feed_key string, cooldown_until double, last_checked double, last_status int, last_error string, last_success double"


def apply_attempts(
    state: DataFrame, attempts: DataFrame, too_many: int = TOO_MANY_SECONDS, gone: int = GONE_SECONDS
) -> tuple[DataFrame, DataFrame]:
    """(decisions, next state) of one run with at most one attempt per feed.

    The batch form: the state table is carried from run to run. A feed may
    name its own cooldowns (cooldown_on_429_seconds, cooldown_on_error_seconds).
    """

    def own(name: str, default: int) -> Column:
        return F.coalesce(F.col(f"a.{name}"), F.lit(default)) if name in attempts.columns else F.lit(default)

    rows = state.alias("s").join(attempts.alias("a"), "feed_key", "full")
    tried = F.col("a.at").isNotNull()
    before = F.coalesce("s.cooldown_until", F.lit(0.0))
    skipped = tried & (before > F.col("a.at"))
    taken = tried & ~skipped
    status, ok = F.col("a.status_code"), F.col("a.has_content")
    until = (
        F.when(ok, 0.0)
        .when(status == TOO_MANY, F.col("a.at") + own("cooldown_on_429_seconds", too_many))
        .when(status.isin(GONE), F.col("a.at") + own("cooldown_on_error_seconds", gone))
        .otherwise(0.0)
    )
    error = F.col("a.error") if "error" in attempts.columns else F.lit("")
    outcome = F.when(skipped, "skipped_cooldown").when(ok, "ok").otherwise("http_error")
    decisions = rows.where(tried).select("feed_key", F.col("a.at").alias("at"), outcome.alias("outcome"))
    after = rows.select(
        "feed_key",
        F.when(taken, until).otherwise(F.col("s.cooldown_until")).alias("cooldown_until"),
        F.when(taken, F.col("a.at")).otherwise(F.col("s.last_checked")).alias("last_checked"),
        F.when(taken, status).otherwise(F.col("s.last_status")).cast("int").alias("last_status"),
        F.when(taken, error).otherwise(F.col("s.last_error")).alias("last_error"),
        F.when(taken & ok, F.col("a.at")).otherwise(F.col("s.last_success")).alias("last_success"),
    )
    return decisions, after


def cache_sink(log: CacheLog):
    """``foreachBatch`` function that appends a batch to the cache log."""

    def save(batch: DataFrame, batch_id: int) -> None:
        log.append(batch, batch_id)

    return save


def run_cache_sink(stream: DataFrame, name: str) -> CacheLog:
    """Run the cache sink over what is there and return the log."""
    spark = stream.sparkSession
    base, state = _folders(spark, name)
    log = CacheLog(spark, base, stream.schema)
    query = (
        stream.writeStream.foreachBatch(cache_sink(log))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return log
