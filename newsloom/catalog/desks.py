"""Desks, transcripts, calendars, landed answers and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.catalog.registry import query, table
from newsloom.functions import bands as B
from newsloom.functions import dates as T
from newsloom.functions import text as X
from newsloom.operators import routing as D
from newsloom.operators.ranking import position_bucket, running
from newsloom.operators.validation import validate_urls
from newsloom.plans import collect as C
from newsloom.plans.health import feed_checks, new_feed_errors
from newsloom.session import checkpoint_dir
from newsloom.sources import api as A
from newsloom.sources import tables as S

FIRST_DAY = "2024-01-01"
# Rows of a landed document at most; a run of more has several.
DOCUMENT_ROWS = 500


def in_documents(rows, run, order, buckets=None):
    """Rows with the document (run_date, part) of their position in the run.

    ``buckets`` coarsen the leading part of ``order``, as in ``running``.
    """
    runs = rows.withColumn("run_date", F.col(run) if isinstance(run, str) else run)
    placed = running(runs, ["run_date"], buckets or position_bucket(order[0]), order, {"_at": F.lit(1)})
    return placed.withColumn("part", F.floor((F.col("_at") - 1) / DOCUMENT_ROWS).cast("int")).drop("_at")


DESKS = {
    "world": {"categories": ["en", "fr"], "channels": ["src0", "src1"]},
    "culture": {"categories": ["fr", "de"], "channels": ["src1", "src2"]},
}

DESKS_SQL = """
c(desk, category) AS (VALUES ('world', 'en'), ('world', 'fr'), ('culture', 'fr'), ('culture', 'de')),
h(desk, channel) AS (VALUES ('world', 'src0'), ('world', 'src1'), ('culture', 'src1'), ('culture', 'src2'))
"""


def transcripts(spark, d):
    """Documents as transcripts of their source's channel; every fourth is compressed."""
    docs = table(spark, d, "documents")
    k = F.col("doc_id")
    return docs.select(
        F.date_add(F.lit(FIRST_DAY).cast("date"), (k % 14).cast("int")).alias("run_date"),
        k.alias("pos"),
        F.col("source").alias("channel"),
        F.concat(F.lit("Talk "), k.cast("string")).alias("title"),
        F.when(k % 4 == 0, F.concat(F.lit("short "), F.col("lang"))).otherwise("").alias("compressed_transcript"),
        F.concat(F.lit("long "), F.col("lang")).alias("transcript"),
        F.when(k % 5 != 0, F.lit(FIRST_DAY).cast("timestamp") + F.make_dt_interval(hours=(k % 200).cast("int"))).alias("published"),
    )


@query(
    "transcript_routing",
    f"WITH {DESKS_SQL} SELECT doc_id AS pos, source AS channel, desk FROM documents JOIN h ON source = channel",
)
def _transcript_routing(spark, d):
    return D.route_transcripts(transcripts(spark, d), D.desk_table(spark, DESKS)).select("pos", "channel", "desk")


@query(
    "desk_manifest",
    f"""WITH {DESKS_SQL} SELECT desk, category, CAST(count(*) AS BIGINT) AS items FROM documents JOIN c ON lang = category
    WHERE desk = 'culture' GROUP BY ALL""",
)
def _manifest(spark, d):
    desks = D.desk_table(spark, DESKS, [{"name": "nope"}, {"name": "culture"}, 5])
    its = table(spark, d, "documents").select(F.col("lang").alias("category"), F.lit("full").alias("analysis_mode"))
    return D.route_items(its, desks).groupBy("desk", "category").agg(F.count(F.lit(1)).alias("items"))


@query(
    "desk_pack",
    f"""WITH {DESKS_SQL}, r AS (SELECT DATE '2024-01-01' + CAST(doc_id % 14 AS INTEGER) AS run_date, desk, doc_id, source, lang FROM documents JOIN c ON lang = category),
    k AS (SELECT *, row_number() OVER (PARTITION BY run_date, desk ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY run_date, desk) AS n FROM r)
    SELECT run_date, desk, CAST(any_value(n) AS BIGINT) AS items, string_agg('SOURCE: ' || source || ' [wire] | ' || run_date || chr(10) || 'CATEGORY: ' || lang || chr(10)
      || 'TITLE: Doc ' || doc_id || chr(10) || 'URL: http://d/' || doc_id || chr(10) || 'SUMMARY: About ' || lang || chr(10), chr(10) || '---' || chr(10) ORDER BY rn) AS text
    FROM k WHERE rn <= 6 GROUP BY run_date, desk""",
)
def _desk_pack(spark, d):
    k = F.col("doc_id").cast("string")
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("doc_id") % 14).cast("int"))
    its = table(spark, d, "documents").select(
        day.alias("run_date"),
        F.col("doc_id").alias("pos"),
        "source",
        F.lit("wire").alias("reliability"),
        day.cast("timestamp").alias("published"),
        F.col("lang").alias("category"),
        F.concat(F.lit("Doc "), k).alias("title"),
        F.concat(F.lit("http://d/"), k).alias("url"),
        F.concat(F.lit("About "), F.col("lang")).alias("summary"),
        F.lit("full").alias("analysis_mode"),
    )
    return D.desk_pack(D.route_items(its, D.desk_table(spark, DESKS)), 6)


@query(
    "transcript_blocks",
    """SELECT doc_id AS pos, 'CHANNEL: ' || source || ' [analysis-opinion]' || chr(10) || 'TITLE: Talk ' || doc_id || chr(10) || 'SUMMARY:' || chr(10)
      || CASE WHEN doc_id % 4 = 0 THEN 'short ' ELSE 'long ' END || lang || chr(10) AS block FROM documents""",
)
def _blocks(spark, d):
    return transcripts(spark, d).select("pos", D.transcript_block().alias("block"))


@query(
    "quote_lines",
    """SELECT event_id, '  ' || event_type || ': $' || (event_id % 90) || ' (' || CASE WHEN event_id % 11 = 0 OR value >= 40 THEN '+' ELSE '' END
      || printf('%.1f', CASE WHEN event_id % 11 = 0 THEN 0 ELSE (value - 40) / 4 END) || '%)' AS line FROM events""",
)
def _quote_lines(spark, d):
    quotes = table(spark, d, "events").select(
        "event_id",
        F.lit("x").alias("symbol"),
        F.col("event_type").alias("label"),
        (F.col("event_id") % 90).alias("price"),
        F.when(F.col("event_id") % 11 != 0, (F.col("value") - 40) / 4).alias("change_pct"),
    )
    return quotes.select("event_id", D.quote_line().alias("line"))


@query(
    "recent_transcripts",
    """SELECT doc_id AS pos FROM documents WHERE doc_id % 5 <> 0
      AND TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 200 AS INTEGER)) >= TIMESTAMP '2024-01-05' - INTERVAL 48 HOUR""",
)
def _recent(spark, d):
    return C.recent_transcripts(transcripts(spark, d), F.lit("2024-01-05").cast("timestamp")).select("pos")


@query(
    "coming_days",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%A, %B %-d, %Y') AS shown FROM orders
    WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-06-01' AND DATE '1995-08-30'""",
)
def _coming(spark, d):
    day = F.to_date("o_orderdate")
    rows = table(spark, d, "orders").where(T.within_days(day, F.lit("1995-06-01").cast("date"), 90))
    return rows.select("o_orderkey", day.alias("day"), T.display_date(day).alias("shown"))


@query(
    "conference_sessions",
    """SELECT o_orderkey, 'LDS General Conference — ' || CASE WHEN month(o_orderdate) = 4 THEN 'Spring ' ELSE 'Fall ' END || year(o_orderdate)
      || CASE WHEN dayofweek(o_orderdate) = 6 THEN ' (Saturday)' ELSE ' (Sunday)' END AS event FROM orders""",
)
def _sessions(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.conference_event(F.to_date("o_orderdate")).alias("event"))


@query(
    "source_diagnostics",
    """SELECT DATE '2024-01-01' + CAST(doc_id % 14 AS INTEGER) AS run_date, source, doc_id AS pos,
      CASE WHEN doc_id % 6 = 0 THEN 'failed' WHEN doc_id % 6 = 1 THEN 'ok_empty' WHEN doc_id % 6 = 2 THEN 'degraded' ELSE 'ok' END AS status,
      CASE WHEN doc_id % 6 <> 0 THEN n_chars END AS item_count, round_even(n_chars / 512.0::DOUBLE, 2) AS elapsed_seconds FROM documents""",
)
def _diagnostics(spark, d):
    k = F.col("doc_id") % 6
    rows = table(spark, d, "documents").select(
        F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("doc_id") % 14).cast("int")).alias("run_date"),
        F.struct("source", "doc_id").alias("source"),
        F.col("n_chars").alias("item_count"),
        (k == 0).alias("failed"),
        F.when(k == 1, "ok_empty").when(k == 2, "degraded").alias("reported"),
        (F.col("n_chars") / 512.0).alias("elapsed_seconds"),
    )
    out = C.source_diagnostics(rows.withColumn("source", F.concat_ws("#", "source.source", "source.doc_id")))
    source = F.split("source", "#")
    return out.withColumns({"pos": F.get(source, F.lit(1)).cast("bigint"), "source": F.get(source, F.lit(0))})


@query(
    "daily_forecasts",
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS hi, min(value) AS lo FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn FROM e)
    SELECT user_id AS run_date, strftime(day, '%Y-%m-%d') AS date, CAST(round_even(hi, 0) AS INTEGER) AS high_f, CAST(round_even(lo, 0) AS INTEGER) AS low_f FROM r WHERE rn <= 7""",
)
def _forecasts(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("day").cast("string").alias("day"), "hi", "lo")))
    docs = e.groupBy(F.col("user_id").alias("run_date")).agg(rows.alias("r"))
    r = F.col("r")
    daily = F.struct(r["day"].alias("time"), r["hi"].alias("temperature_2m_max"), r["lo"].alias("temperature_2m_min"))
    out = A.daily_forecast(docs.select("run_date", F.to_json(F.struct(daily.alias("daily"))).alias("payload")))
    return out.select("run_date", "date", "high_f", "low_f")


@query(
    "air_forecasts",
    """WITH e AS (SELECT user_id AS run_date, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_type <> 'error' THEN CAST(trunc(value) AS INTEGER) END AS aqi,
      row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) AS rn FROM events)
    SELECT run_date, date, aqi, CASE WHEN aqi IS NULL THEN 'Moderate' WHEN aqi <= 50 THEN 'Good' WHEN aqi <= 100 THEN 'Moderate' WHEN aqi <= 150 THEN 'Unhealthy for Sensitive Groups'
      WHEN aqi <= 200 THEN 'Unhealthy' WHEN aqi <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END AS aqi_label FROM e WHERE rn = 1""",
)
def _air(spark, d):
    one = F.struct(
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" ")).alias("DateForecast"),
        F.when(F.col("event_type") != "error", F.col("value").cast("int")).alias("AQI"),
    )
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", one.alias("x")))), lambda r: r["x"])
    placed = in_documents(table(spark, d, "events"), "user_id", ["event_id"])
    return A.air_forecast(placed.groupBy("run_date", "part").agg(F.to_json(rows).alias("payload")))


@query(
    "on_this_day",
    """WITH o AS (SELECT o_custkey AS run_date, o_orderkey, year(o_orderdate) AS y, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'selected' ELSE 'events' END AS list FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_date, list ORDER BY o_orderkey) - 1 AS pos FROM o)
    SELECT run_date, list, CAST(pos AS INTEGER) AS pos, CAST(y AS VARCHAR) AS year, o_orderpriority AS text FROM r WHERE pos < 3""",
)
def _on_this_day(spark, d):
    one = F.struct("o_orderkey", F.struct(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("text")).alias("x"))
    chosen = F.col("o_orderstatus") == "F"

    def of(kind):
        return F.transform(F.array_sort(F.collect_list(F.when(kind, one))), lambda r: r["x"])

    docs = in_documents(table(spark, d, "orders"), "o_custkey", ["o_orderkey"]).groupBy("run_date", "part").agg(
        F.to_json(F.struct(of(chosen).alias("selected"), of(~chosen).alias("events"))).alias("payload")
    )
    return A.on_this_day(docs, 3)[0]


CONDITIONS = ["", "Thunderstorms likely", "Rain and Snow", "Light Snow", "Rain Showers", "Mostly Sunny", "Overcast", "Patchy Fog", "Blowing dust and smoke", "hazy"]
SHORT = ["", "T-storm", "Mix", "Snow", "Shwrs", "Sunny", "Cloudy", "Fog", "blowing dust...", "Hazy"]


@query(
    "short_conditions",
    f"""SELECT event_id, {SHORT}[event_id % 10 + 1] AS condition, CAST(round_even(value * 9 / 5 + 32, 0) AS INTEGER) AS fahrenheit,
      CAST(round_even(value * 2.237::DOUBLE, 0) AS INTEGER) AS mph FROM events""",
)
def _conditions(spark, d):
    said = F.get(F.array(*[F.lit(c) for c in CONDITIONS]), F.col("event_id") % 10)
    return table(spark, d, "events").select(
        "event_id", B.short_condition(said).alias("condition"), B.fahrenheit(F.col("value")).alias("fahrenheit"), B.miles_per_hour(F.col("value")).alias("mph")
    )


@query(
    "summary_rejections",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'meta_response:' || 'as an ai' WHEN n_chars >= 800 AND doc_id % 7 = 1 THEN 'too_short' ELSE '' END AS reason FROM documents""",
)
def _rejections(spark, d):
    k = F.col("doc_id") % 7
    summary = F.when(k == 0, "As an AI, I cannot.").when(k == 1, "short").otherwise(F.repeat(F.lit("a good summary "), 8))
    return table(spark, d, "documents").select("doc_id", X.summary_rejection(summary, F.col("text"), ["as an ai"]).alias("reason"))


@query(
    "distinct_paragraphs",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || '|' || o_orderstatus || ' is new' WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE o_orderpriority || '!' END AS kept FROM orders""",
)
def _paragraphs(spark, d):
    p, k = F.col("o_orderpriority"), F.col("o_orderkey") % 3
    second = F.when(k == 0, F.concat(F.col("o_orderstatus"), F.lit(" is new"))).when(k == 1, F.substring(p, 1, 4)).otherwise(p)
    first = F.when(k == 2, F.concat(p, F.lit("!"))).otherwise(p)
    kept = X.distinct_paragraphs(F.array(F.lit(""), first, second, F.lit(None).cast("string"), first))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(kept, "|").alias("kept"))


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/stores/{uuid.uuid4().hex}"


def _dated(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(F.date_add(F.lit(FIRST_DAY).cast("date"), (k % 14).cast("int")).alias("run_date"), k.alias("pos"), "source")


@query(
    "saved_runs",
    """SELECT DATE '2024-01-01' + CAST(doc_id % 14 AS INTEGER) AS run_date, doc_id AS pos, CASE WHEN doc_id % 14 = 3 THEN 'again' ELSE source END AS source FROM documents
    WHERE doc_id % 14 <> 3 OR doc_id % 3 = 0""",
)
def _saved(spark, d):
    # A run that is saved again is replaced; the others stay.
    base, rows = _folder(spark), _dated(spark, d)
    S.save_runs(rows, base, "items")
    again = rows.where("run_date = '2024-01-04' and pos % 3 = 0").withColumn("source", F.lit("again"))
    S.save_runs(again, base, "items")
    return S.read_table(spark, base, "items").select("run_date", "pos", "source")


@query(
    "retained_runs",
    """SELECT DATE '2024-01-01' + CAST(doc_id % 14 AS INTEGER) AS run_date, CAST(count(*) AS BIGINT) AS items,
      DATE '2024-01-01' + CAST(doc_id % 14 AS INTEGER) < DATE '2024-01-15' - 7 AS dropped FROM documents GROUP BY ALL""",
)
def _retained(spark, d):
    rows = _dated(spark, d)
    keep, drop = S.retention(rows, "2024-01-15", 7)
    both = keep.withColumn("dropped", F.lit(False)).unionByName(rows.join(drop, "run_date", "left_semi").withColumn("dropped", F.lit(True)))
    return both.groupBy("run_date", "dropped").agg(F.count(F.lit(1)).alias("items"))


@query(
    "json_round_trip",
    """SELECT DATE '2024-01-01' + CAST(doc_id % 14 AS INTEGER) AS run_date, doc_id AS pos, source FROM documents""",
)
def _json(spark, d):
    path, rows = _folder(spark), _dated(spark, d)
    S.dump_json(rows, path)
    return S.read_landed_json(spark, path, rows.schema)[0]


@query(
    "validated_urls",
    """SELECT l_orderkey AS pos, l_linenumber AS at, CASE WHEN l_partkey % 3 = 0 THEN '' WHEN l_partkey % 3 = 1 THEN 'http://p/' || l_partkey
      WHEN l_partkey % 2 = 0 THEN 'http://p/' || l_partkey || '?utm_source=x' ELSE '' END AS url FROM lineitem""",
)
def _urls(spark, d):
    k = F.col("l_partkey")
    plain = F.concat(F.lit("http://p/"), k.cast("string"))
    day = F.lit(FIRST_DAY).cast("date").alias("run_date")
    li = table(spark, d, "lineitem")
    rows = li.select(
        day, F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("at"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, plain).otherwise(F.concat(plain, F.lit("?utm_source=x"))).alias("url"),
    )
    known = li.where((k % 3 == 1) | (k % 2 == 0)).select(day, plain.alias("url")).distinct()
    return validate_urls(rows, known, "reading")[0].select("pos", "at", "url")


@query(
    "stale_feeds",
    """WITH f AS (SELECT source AS name, max(CASE WHEN doc_id % 5 <> 0 THEN doc_id % 60 END) AS newest, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS k FROM documents GROUP BY source)
    SELECT name, CASE WHEN k % 3 <> 0 AND coalesce(TIMESTAMP '2024-01-01' + to_hours(CAST(newest AS INTEGER)) < TIMESTAMP '2024-01-10 10:00:00' - INTERVAL 7 DAY, true)
      THEN 'no item dated within the last 7 days' ELSE '' END AS errors FROM f""",
)
def _stale(spark, d):
    docs = table(spark, d, "documents")
    k = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    feeds = docs.select(F.col("source").alias("name")).distinct().select(
        "name", F.lit("en").alias("category"), F.when(k % 3 == 0, "headline_radar").otherwise("active").alias("health")
    )
    hours = F.make_dt_interval(hours=(F.col("doc_id") % 60).cast("int"))
    when = F.when(F.col("doc_id") % 5 != 0, F.lit(FIRST_DAY).cast("timestamp") + hours)
    entries = docs.select(F.col("source").alias("feed"), F.col("source").alias("title"), when.alias("published"))
    now = F.lit("2024-01-10 10:00:00").cast("timestamp")
    out = new_feed_errors(feed_checks(feeds, entries), ["en"], now)
    return out.select("name", F.array_join("errors", "; ").alias("errors"))
