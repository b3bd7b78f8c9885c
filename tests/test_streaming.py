"""Streaming jobs: late data, state over batches, replays."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.streaming import jobs as S

SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)


def land(spark, folder, batches):
    """One file per batch, in arrival order."""
    for i, rows in enumerate(batches):
        path = f"{folder}/b{i}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return (
        spark.readStream.schema(SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", 1)
        .parquet(folder)
    )


def day(d, h=0):
    return dt.datetime(2024, 1, d, h)


def test_late_items_are_dropped(spark, tmp_path):
    batches = [
        [(day(1), "a", "u1"), (day(1), "a", "u2")],
        [(day(9), "a", "u3")],
        [(day(9), "b", "u5")],  # lateness is judged by the batch before the last
        [(day(1), "a", "late"), (day(8, 23), "a", "in time")],
        [(day(9), "a", "u4")],
    ]
    out = S.run_update(
        S.item_counts(land(spark, str(tmp_path), batches), "ts", "source"), "late", ["window_start", "source"]
    )
    got = {(r.window_start.day, r.source, r["items"]) for r in out.collect()}
    assert got == {(1, "a", 2), (8, "a", 1), (9, "a", 2), (9, "b", 1)}


def test_dedup_over_batches(spark, tmp_path):
    batches = [[(day(1), "a", "u1")], [(day(1, 5), "b", "u1"), (day(1, 6), "b", "u2")]]
    out = S.run_append(S.first_seen(land(spark, str(tmp_path), batches), "ts", ["url"]), "first")
    assert sorted((r.source, r.url) for r in out.collect()) == [("a", "u1"), ("b", "u2")]


def test_cooldown_state_carries(spark, tmp_path):
    h = 3600.0
    rows = [
        ("f", 0, 0.0, 429, False),
        ("f", 1, 5 * h, 200, True),  # inside six hours: not tried
        ("f", 2, 6 * h, 404, False),
        ("f", 3, 29 * h, 200, True),
        ("f", 4, 30 * h, 500, False),
        ("f", 5, 31 * h, 200, True),
    ]
    ddl = "feed_key string, attempt bigint, at double, status_code int, has_content boolean"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], ddl).coalesce(1).write.parquet(f"{tmp_path}/b{i}")
    stream = (
        spark.readStream.schema(ddl).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    )
    got = {r.attempt: r.outcome for r in S.run_append(S.cooldown_stream(stream), "cool", rocksdb=True).collect()}
    want = {0: "http_error", 1: "skipped_cooldown", 2: "http_error", 3: "skipped_cooldown", 4: "http_error", 5: "ok"}
    assert got == want

    state = spark.createDataFrame([], S.STATE_DDL)
    for r in rows:
        made, state = S.apply_attempts(state, spark.createDataFrame([r], ddl).drop("attempt"))
        assert made.first().outcome == want[r[1]]
    end = state.first()
    assert (end.last_success, end.last_status, end.cooldown_until) == (31 * h, 200, 0.0)


def test_cache_sink_keeps_newest(spark, tmp_path):
    batches = [[(day(1), "old", "u1"), (day(2), "x", "u2")], [(day(3), "new", "u1")]]
    rows = land(spark, str(tmp_path), batches).select("url", F.col("source").alias("status"), F.col("ts").alias("fetched_at"))
    got = {r.url: r.status for r in S.run_cache_sink(rows, "sink").read().collect()}
    assert got == {"u1": "new", "u2": "x"}


def test_cooldown_replay_decides_every_attempt(spark):
    h = 3600.0
    rows = [
        ("f", 0, 0.0, 429, False),
        ("f", 1, 5 * h, 200, True),
        ("f", 2, 6 * h, 404, False),
        ("f", 3, 29 * h, 200, True),
        ("f", 4, 30 * h, 500, False),
        ("f", 5, 31 * h, 200, True),
        ("g", 6, 1 * h, 200, True),
        ("g", 7, 1 * h, None, None),  # no answer: no cooldown
        ("g", 8, None, 404, False),
    ]
    ddl = "feed_key string, attempt bigint, at double, status_code int, has_content boolean"
    attempts = spark.createDataFrame(rows[::-1], ddl)
    with_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = [tuple(r) for r in S.cooldown_replay(attempts).orderBy("attempt").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_batches)
    assert got == [
        ("f", 0, "http_error", 6 * h),
        ("f", 1, "skipped_cooldown", 6 * h),
        ("f", 2, "http_error", 30 * h),
        ("f", 3, "skipped_cooldown", 30 * h),
        ("f", 4, "http_error", 0.0),
        ("f", 5, "ok", 0.0),
        ("g", 6, "ok", 0.0),
        ("g", 7, "http_error", 0.0),
        ("g", 8, "http_error", 0.0),
    ]


ENTRY = "url string, status string, fetched_at timestamp"


def test_cache_log_costs_the_batch(spark, tmp_path):
    """Twenty batches with updates, removals, ties and a replay; rows rewritten stay logarithmic."""
    import random

    from newsloom.sources.cachelog import CacheLog

    rng = random.Random(3)
    schema = spark.createDataFrame([], ENTRY).schema
    log = CacheLog(spark, f"file://{tmp_path}/log", schema)
    held, sizes, rewritten, earlier = {}, 0, 0, None
    assert log.read().count() == 0 and log.runs() == []
    for n in range(20):
        rows = [(f"u{rng.randint(0, 60)}", f"s{n}-{i}", day(1 + rng.randint(0, 9))) for i in range(12)]
        newest = {}
        for u, s, t in rows:
            if u not in newest or t > newest[u][1]:
                newest[u] = (s, t)
        rows = [(u, s, t) for u, (s, t) in newest.items()]
        gone = [(f"u{rng.randint(0, 60)}", day(rng.randint(5, 9))) for _ in range(2)] if n % 3 == 2 else []
        gone = [g for g in dict(gone).items() if g[0] not in newest]
        removed = spark.createDataFrame(gone, "url string, fetched_at timestamp") if gone else None
        runs = log.append(spark.createDataFrame(rows, ENTRY), n, removed)
        for u, s, t in rows + [(u, None, t) for u, t in gone]:
            if u not in held or t >= held[u][1]:
                held[u] = (s, t)
        sizes += len(rows) + len(gone)
        rewritten += sum(r["rows"] for r in runs if r["last"] == n)
        assert len(runs) <= 6
        if n == 10:
            earlier = (log.versions()[-1], {u: s for u, (s, _) in held.items() if s})
    want = {u: s for u, (s, _) in held.items() if s}
    assert {r.url: r.status for r in log.read().collect()} == want
    assert rewritten <= 4 * sizes
    # A replayed batch changes nothing, and an older version stays readable.
    assert log.append(spark.createDataFrame([("u1", "replay", day(30))], ENTRY), 19) == log.runs()
    assert {r.url: r.status for r in log.read(earlier[0]).collect()} == earlier[1]
    asked = spark.createDataFrame([("u1",), ("u2",), ("none",)], "url string")
    assert {r.url: r.status for r in log.lookup(asked).collect()} == {u: s for u, s in want.items() if u in ("u1", "u2")}
    # Of two writers that saw the same version one fails, and readers see the other's.
    other = CacheLog(spark, log.base, schema)
    seen = log.versions()
    log.append(spark.createDataFrame([("u1", "won", day(30))], ENTRY), 20)
    other.versions = lambda: seen
    with pytest.raises(RuntimeError, match="another writer"):
        other.append(spark.createDataFrame([("u1", "lost", day(31))], ENTRY), 20)
    want["u1"] = "won"
    assert log.vacuum() > 0 and len(log.versions()) == 1
    assert {r.url: r.status for r in CacheLog(spark, log.base, schema).read().collect()} == want


OVERRIDES = "feed_key string, attempt bigint, at double, status_code int, has_content boolean, cooldown_on_429_seconds int, cooldown_on_error_seconds int"


def attempts_in_batches(spark, tmp_path, rows):
    for i, r in enumerate(rows):
        spark.createDataFrame([r], OVERRIDES).coalesce(1).write.parquet(f"{tmp_path}/b{i}")
    return spark.readStream.schema(OVERRIDES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_cooldown_state_and_overrides(spark, tmp_path):
    h = 3600.0
    rows = [
        ("f", 0, 1 * h, 200, True, None, None),  # inside the carried cooldown
        ("f", 1, 2 * h, 429, False, 3600, None),
        ("f", 2, 2.5 * h, 200, True, 3600, None),
        ("f", 3, 3 * h, 404, False, None, 600),
        ("f", 4, 3.5 * h, None, None, None, None),  # no answer
        ("g", 5, None, 429, False, None, None),
        ("g", 6, 1 * h, 429, False, None, None),
    ]
    stream = attempts_in_batches(spark, tmp_path, rows)
    state = spark.createDataFrame([("f", 2 * h, None, 429, None, None), ("z", 9 * h, None, None, None, None)], S.STATE_DDL)
    got = S.run_append(S.cooldown_stream(stream, state=state), "carried", rocksdb=True).collect()
    want = {0: ("skipped_cooldown", 2 * h), 1: ("http_error", 3 * h), 2: ("skipped_cooldown", 3 * h), 3: ("http_error", 3 * h + 600), 4: ("http_error", 0.0)}
    want |= {5: ("http_error", 0.0), 6: ("http_error", 7 * h)}
    assert {r.attempt: (r.outcome, r.cooldown_until) for r in got} == want and len(got) == len(want)


def test_cooldown_takes_rows_and_asks_once():
    """A feed's batch costs one look-up and one update, and no data frame."""
    calls = []

    class Held:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    job = S.Cooldown(S.TOO_MANY_SECONDS, S.GONE_SECONDS, None)
    job.state = Held()
    attempt = Row("feed_key", "attempt", "at", "status_code", "has_content", "own_429", "own_error")
    h, nan = 3600.0, float("nan")
    rows = [attempt("f", 3, None, 404.0, False, None, None), attempt("f", 2, 2 * h, 200.0, True, None, None), attempt("f", 1, h, 429.0, None, nan, None)]
    rows.append(attempt("f", None, 2 * h, 200.0, True, None, None))
    got = [tuple(r) for r in job.handleInputRows(("f",), iter(rows), None)]
    assert got == [("f", 1, "http_error", 7 * h), ("f", 2, "skipped_cooldown", 7 * h), ("f", None, "skipped_cooldown", 7 * h), ("f", 3, "http_error", 0.0)]
    assert calls == ["get", "update"] and job.state.value == (0.0, h, 404, None)


def test_cooldown_timers(spark, tmp_path):
    """A feed is reported when its cooldown ends, and forgotten after long silence."""
    d = 86_400.0
    rows = [
        ("f", 0, 1 * d, 404, False, None, 40 * 86_400),  # cools down until day 41
        ("g", 1, 4 * d, 429, False, None, None),
        ("g", 2, 6 * d, 200, True, None, None),
        ("g", 3, 20 * d, 200, True, None, None),
        ("g", 4, 21 * d, 200, True, None, None),
        ("f", 5, 22 * d, 200, True, None, None),  # forgotten on day 11, so not skipped
    ]
    stream = attempts_in_batches(spark, tmp_path, rows)
    got = S.run_append(S.cooldown_stream(stream, forget_days=10), "timers", rocksdb=True).collect()
    assert {r.attempt: r.outcome for r in got if r.outcome != "due"} == {0: "http_error", 1: "http_error", 2: "ok", 3: "ok", 4: "ok", 5: "ok"}
    assert {(r.feed_key, r.cooldown_until) for r in got if r.outcome == "due"} <= {("g", 4 * d + S.TOO_MANY_SECONDS)}


def test_landing_keeps_order(spark):
    rows = spark.range(500).selectExpr("id", "500 - id AS at")
    folder = S.land_in_order(rows, "order", ["at"], 4)
    stream = S.landed_stream(spark, folder, rows.schema, "*.parquet", 1)
    seen = []
    query = stream.writeStream.foreachBatch(lambda b, n: seen.append(b.agg(F.min("at"), F.max("at")).first())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(seen) == 4 and all(a[1] < b[0] for a, b in zip(seen, seen[1:], strict=False))


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    batches = [
        [(day(1), "a", "u1"), (None, "a", "undated")],
        [(day(9), "a", "u2")],
        [(day(7, 11), "a", "late"), (day(7, 13), "a", "in time"), (None, "b", "undated")],
        [(day(2), "b", "very late"), (day(20), "b", "u3")],
        [(day(9), "c", "late now")],
    ]
    sink = S.run_late_rows(land(spark, str(tmp_path), batches), "late-rows", "ts")
    rows = {(r.url, r.batch): r.late for r in sink.rows(spark).collect()}
    assert {k[0] for k, late in rows.items() if late} == {"late", "very late", "late now"} and len(rows) == 9
    assert [(r.batch, r["rows"], r.late) for r in sink.seen(spark).orderBy("batch").collect()] == [(0, 2, 0), (1, 1, 0), (2, 3, 1), (3, 2, 1), (4, 1, 1)]
    # A replayed batch overwrites itself.
    again = spark.createDataFrame(batches[2], SCHEMA)
    sink(again, 2)
    assert {(r.url, r.batch): r.late for r in sink.rows(spark).collect()} == rows


def test_dropped_rows_are_reported(spark, tmp_path):
    batches = [[(day(1), "a", "u1")], [(day(9), "a", "u3")], [(day(9), "b", "u5")], [(day(1), "a", "late")], [(day(9), "a", "u4")]]
    counts = S.item_counts(land(spark, str(tmp_path), batches), "ts", "source")
    query = counts.writeStream.format("noop").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert S.dropped_rows(query.recentProgress) == 1


def test_rolling_medians(spark, tmp_path):
    import random
    import statistics

    rng = random.Random(2)
    rows = [(day(d, rng.randint(0, 23)), rng.choice("ab"), str(rng.randint(0, 9))) for d in range(1, 29) for _ in range(rng.randint(0, 6))]
    batches = [[r for r in rows if r[0].day in days] for days in (range(1, 8), range(8, 15), range(15, 22), range(22, 29))]
    stream = land(spark, str(tmp_path), batches).withColumn("length", F.col("url").cast("int"))
    saved = S.run_update(S.length_histogram(stream, "ts", "source", "length"), "medians", ["day", "source", "length"])
    got = {(r.day.day, r.source): (r["items"], r.median) for r in S.rolling_medians(saved, "source", "length", 5).collect()}
    want = {}
    for d, source in {(t.day, s) for t, s, _ in rows}:
        held = [int(n) for t, s, n in rows if s == source and d - 4 <= t.day <= d]
        want[(d, source)] = (len(held), statistics.median(held))
    assert got == want


def test_one_batch_of_many_files(spark, tmp_path):
    """The events of a batch are landed by several tasks and read as one batch."""
    from pathlib import Path

    from newsloom.catalog import streams
    from newsloom.session import checkpoint_dir

    rows = spark.range(4_000).selectExpr(
        "id AS event_id", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, CAST(id % 700 AS int)) AS ts", "id % 50 AS user_id", "CAST(id % 3 AS string) AS event_type"
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    stream = streams._events(spark, str(tmp_path), batches=1, files=8)
    batches = []

    def save(batch, number):
        batches.append((number, batch.count()))

    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert batches == [(0, 4_000)]
    assert streams._dedup(spark, str(tmp_path)).count() == 150
    landed = Path(checkpoint_dir(spark).removeprefix("file:")) / "landed"
    folders = sorted(landed.glob("events-*"), key=lambda p: p.stat().st_mtime)
    assert len(list(folders[-1].glob("part-*"))) > 8
