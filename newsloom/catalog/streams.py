"""Streaming jobs over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.registry import SQL, query, table
from newsloom.streaming import jobs as S


def _events(spark, d, batches: int = 6, files: int = 1):
    """Events landed in the order of their time, so many files per micro-batch."""
    events = table(spark, d, "events")
    folder = S.land_in_order(events, "events", ["ts", "event_id"], batches * files)
    return S.landed_stream(spark, folder, events.schema, "*.parquet", files).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_counts",
    """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, user_id, CAST(count(*) AS BIGINT) AS items FROM events GROUP BY ALL""",
)
def _counts(spark, d):
    return S.run_update(S.item_counts(_events(spark, d), "ts", "user_id"), "counts", ["window_start", "user_id"])


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _dedup(spark, d):
    # A key that comes back after the lateness limit counts as new; in one batch none does.
    # The batch has many files, so that no task sorts or reads all events.
    seen = S.first_seen(_events(spark, d, batches=1, files=64), "ts", ["user_id", "event_type"])
    return S.run_append(seen.select("user_id", "event_type"), "dedup")


@query("stream_dedup_daily", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def _dedup_daily(spark, d):
    events = _events(spark, d).withColumn("day", F.to_date("ts"))
    seen = S.first_seen(events, "ts", ["user_id", "event_type", "day"])
    return S.run_append(seen.select("user_id", "event_type", "day"), "dedup-daily")


def _attempts(events):
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("feed"), F.col("user_id").cast("string")).alias("feed_key"),
        F.col("event_id").alias("attempt"),
        F.unix_micros("ts").cast("double").alias("micros"),
        F.when(kind == "error", F.when(F.col("event_id") % 2 == 0, 429).otherwise(404)).otherwise(200).alias("status_code"),
        (kind != "error").alias("has_content"),
    ).withColumn("at", F.floor(F.col("micros") / 1_000_000).cast("double")).drop("micros")


@query(
    "stream_cooldown",
    """WITH RECURSIVE a AS (SELECT 'feed' || user_id AS feed_key, event_id AS attempt, CAST(floor(epoch_us(ts) / 1000000) AS DOUBLE) AS at_s,
      event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN 0 WHEN event_id % 2 = 0 THEN 21600 ELSE 86400 END AS cool FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY feed_key ORDER BY at_s, attempt) AS rn FROM a),
    w AS (SELECT feed_key, attempt, rn, CASE WHEN ok THEN 'ok' ELSE 'http_error' END AS outcome, CASE WHEN ok THEN 0.0::DOUBLE ELSE at_s + cool END AS cooldown_until FROM n WHERE rn = 1
      UNION ALL SELECT n.feed_key, n.attempt, n.rn, CASE WHEN w.cooldown_until > n.at_s THEN 'skipped_cooldown' WHEN ok THEN 'ok' ELSE 'http_error' END,
        CASE WHEN w.cooldown_until > n.at_s THEN w.cooldown_until WHEN ok THEN 0.0::DOUBLE ELSE n.at_s + cool END
      FROM w JOIN n ON n.feed_key = w.feed_key AND n.rn = w.rn + 1)
    SELECT feed_key, attempt, outcome, cooldown_until FROM w""",
)
def _cooldown(spark, d):
    return S.run_append(S.cooldown_stream(_attempts(_events(spark, d))), "cooldown", rocksdb=True)


def _feeds(spark, d):
    """Feeds with cooldowns of their own: some for too many requests, some for gone pages."""
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select(
        F.concat(F.lit("feed"), F.col("user_id").cast("string")).alias("feed_key"),
        F.when(F.col("user_id") % 3 == 0, 1800 + 600 * (F.col("user_id") % 7)).alias("cooldown_on_429_seconds"),
        F.when(F.col("user_id") % 4 == 1, 43200).alias("cooldown_on_error_seconds"),
    )


@query(
    "stream_cooldown_overrides",
    """WITH RECURSIVE a AS (SELECT 'feed' || user_id AS feed_key, event_id AS attempt, CAST(floor(epoch_us(ts) / 1000000) AS DOUBLE) AS at_s,
      event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN 0 WHEN event_id % 2 = 0 THEN CASE WHEN user_id % 3 = 0 THEN 1800 + 600 * (user_id % 7) ELSE 21600 END
      ELSE CASE WHEN user_id % 4 = 1 THEN 43200 ELSE 86400 END END AS cool FROM events),
    s AS (SELECT feed_key, CASE WHEN min(attempt) % 2 = 0 THEN min(at_s) + 7200 ELSE 0.0::DOUBLE END AS until FROM a GROUP BY feed_key),
    n AS (SELECT *, row_number() OVER (PARTITION BY feed_key ORDER BY at_s, attempt) AS rn FROM a),
    w AS (SELECT feed_key, attempt, rn, CASE WHEN until > at_s THEN 'skipped_cooldown' WHEN ok THEN 'ok' ELSE 'http_error' END AS outcome,
        CASE WHEN until > at_s THEN until WHEN ok THEN 0.0::DOUBLE ELSE at_s + cool END AS cooldown_until FROM n JOIN s USING (feed_key) WHERE rn = 1
      UNION ALL SELECT n.feed_key, n.attempt, n.rn, CASE WHEN w.cooldown_until > n.at_s THEN 'skipped_cooldown' WHEN ok THEN 'ok' ELSE 'http_error' END,
        CASE WHEN w.cooldown_until > n.at_s THEN w.cooldown_until WHEN ok THEN 0.0::DOUBLE ELSE n.at_s + cool END
      FROM w JOIN n ON n.feed_key = w.feed_key AND n.rn = w.rn + 1)
    SELECT feed_key, attempt, outcome, cooldown_until FROM w""",
)
def _cooldown_overrides(spark, d):
    # Half of the feeds come from earlier runs inside a cooldown.
    past = _attempts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).groupBy("feed_key")
    past = past.agg(F.min("attempt").alias("first"), F.min("at").alias("at"))
    state = past.select(
        "feed_key",
        F.when(F.col("first") % 2 == 0, F.col("at") + 7200).otherwise(0.0).alias("cooldown_until"),
        F.lit(None).cast("double").alias("last_checked"),
        F.lit(429).alias("last_status"),
        F.lit(None).cast("double").alias("last_success"),
    )
    attempts = _attempts(_events(spark, d)).join(_feeds(spark, d), "feed_key", "left")
    return S.run_append(S.cooldown_stream(attempts, state=state), "cooldown-overrides", rocksdb=True)


@query("cooldown_replay", SQL["stream_cooldown"])
def _cooldown_replay(spark, d):
    # Every attempt of every feed; cooldown_run below is one step of it from a carried state.
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.cooldown_replay(_attempts(events))


@query(
    "cooldown_run",
    """WITH a AS (SELECT 'feed' || user_id AS feed_key, event_id AS attempt, CAST(date_part('day', ts) AS INTEGER) AS day, CAST(floor(epoch_us(ts) / 1000000) AS DOUBLE) AS at_s,
      event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN 0 WHEN event_id % 2 = 0 THEN 21600 ELSE 86400 END AS cool FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY feed_key, day ORDER BY attempt) AS rn FROM a WHERE day IN (1, 2)),
    x AS (SELECT * FROM f WHERE rn = 1 AND day = 1), y AS (SELECT * FROM f WHERE rn = 1 AND day = 2)
    SELECT y.feed_key, y.at_s AS "at", CASE WHEN coalesce(CASE WHEN x.ok THEN 0.0::DOUBLE ELSE x.at_s + x.cool END, 0) > y.at_s THEN 'skipped_cooldown' WHEN y.ok THEN 'ok' ELSE 'http_error' END AS outcome
    FROM y LEFT JOIN x ON x.feed_key = y.feed_key""",
)
def _cooldown_run(spark, d):
    from newsloom.operators.ranking import top_per_group

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _attempts(e).withColumn("day", F.dayofmonth(F.timestamp_seconds("at")))

    def of(day: int):
        return top_per_group(rows.where(F.col("day") == day), ["feed_key"], ["attempt"], 1).drop("day", "attempt")

    empty = spark.createDataFrame([], S.STATE_DDL)
    _, state = S.apply_attempts(empty, of(1))
    decisions, _ = S.apply_attempts(state, of(2))
    return decisions


@query(
    "stream_cache",
    """SELECT url, status, raw_length FROM (SELECT 'http://u' || user_id || '/' AS url, event_type AS status, CAST(event_id AS BIGINT) AS raw_length,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1""",
)
def _cache(spark, d):
    rows = _events(spark, d, batches=20).select(
        F.format_string("http://u%d/", "user_id").alias("url"),
        F.col("event_type").alias("status"),
        F.col("event_id").alias("raw_length"),
        F.col("ts").alias("fetched_at"),
    )
    return S.run_cache_sink(rows, "cache").read().drop("fetched_at")


ROLLING_SQL = """
e AS (SELECT CAST(ts AS DATE) AS day, event_type AS source, CAST(floor(value * 10) AS BIGINT) % 997 AS length FROM events),
d AS (SELECT DISTINCT day, source FROM e)
"""


@query(
    "stream_rolling_medians",
    f"""WITH {ROLLING_SQL} SELECT d.day, d.source, count(*) AS items, CAST(median(length) AS DOUBLE) AS median
    FROM d JOIN e ON e.source = d.source AND e.day BETWEEN d.day - 13 AND d.day GROUP BY 1, 2""",
)
def _rolling(spark, d):
    rows = _events(spark, d).select("ts", F.col("event_type").alias("source"), (F.floor(F.col("value") * 10) % 997).alias("length"))
    saved = S.run_update(S.length_histogram(rows, "ts", "source", "length"), "histogram", ["day", "source", "length"])
    return S.rolling_medians(saved, "source", "length")


# Events arrive in blocks of three days; some come nine days after their time.
LATE_SQL = """
e AS (SELECT event_id, ts, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) // 3 + CASE WHEN event_id % 41 = 0 THEN 3 ELSE 0 END AS block FROM events),
m AS (SELECT block, max(ts) AS newest FROM e GROUP BY block),
w AS (SELECT block, max(newest) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 36 HOUR AS since, row_number() OVER (ORDER BY block) - 1 AS batch FROM m),
l AS (SELECT event_id, batch, coalesce(ts < since, false) AS late FROM e JOIN w USING (block))
"""


def _late(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    rows = e.select("event_id", "ts").withColumn("block", (F.floor(day / 3) + F.when(F.col("event_id") % 41 == 0, 3).otherwise(0)).cast("int"))
    folder = S.land_by(rows, "late-events", "block")
    stream = S.landed_stream(spark, f"{folder}/block=*", rows.drop("block").schema, "*.parquet", 1)
    return S.run_late_rows(stream, "late", "ts")


@query("stream_late_rows", f"WITH {LATE_SQL} SELECT event_id, batch FROM l WHERE late")
def _late_rows(spark, d):
    return _late(spark, d).rows(spark).where("late").select("event_id", F.col("batch").cast("long").alias("batch"))


@query(
    "stream_late_counts",
    f"""WITH {LATE_SQL} SELECT batch, count(*) AS "rows", count(*) FILTER (late) AS late FROM l GROUP BY batch""",
)
def _late_counts(spark, d):
    return _late(spark, d).seen(spark).select("batch", "rows", "late")
