"""Weather, calendar and landed JSON, carried by events and orders.

Documents hold the readings of a user on one day, or the orders of a customer in
a five-year period; a run may have several.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.desks import in_documents
from newsloom.catalog.registry import query, table
from newsloom.functions import bands as B
from newsloom.functions import dates as T
from newsloom.operators import metrics as M
from newsloom.operators import weather as W
from newsloom.operators.ranking import position_in_group
from newsloom.plans import week as K
from newsloom.sources import api as A

def period():
    return F.floor(F.year("o_orderdate") / 5)


AQI_SQL = """CASE WHEN aqi IS NULL THEN 'unavailable' WHEN aqi <= 50 THEN 'Good' WHEN aqi <= 100 THEN 'Moderate' WHEN aqi <= 150 THEN 'Unhealthy for Sensitive Groups'
  WHEN aqi <= 200 THEN 'Unhealthy' WHEN aqi <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END"""


@query(
    "daily_max_band",
    f"WITH m AS (SELECT CAST(ts AS DATE) AS date, max(value) AS aqi FROM events GROUP BY 1) SELECT date, aqi, {AQI_SQL} AS aqi_label FROM m",
)
def _bands(spark, d):
    out = M.day_max(table(spark, d, "events").select("ts", F.col("value").alias("aqi")), "ts", "aqi")
    return out.withColumn("aqi_label", B.aqi_label(F.col("aqi")))


def hourly_documents(spark, d):
    """Readings of each user as one parallel-array document."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "value", "event_type")
    v = F.when(F.col("event_type") != "error", (F.col("value") * 3).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("t"), v.alias("v"))))
    docs = e.groupBy(F.col("user_id").alias("run_date"), F.to_date("ts")).agg(rows.alias("r"))
    body = F.to_json(
        F.struct(F.struct(F.col("r")["t"].alias("time"), F.col("r")["v"].alias("us_aqi")).alias("hourly")),
        {"ignoreNullFields": "false"},
    )
    return docs.select("run_date", body.alias("payload"))


@query(
    "air_by_day",
    f"""WITH m AS (SELECT user_id AS run_date, strftime(ts, '%Y-%m-%d') AS date, max(CAST(trunc(value * 3) AS INTEGER)) AS aqi FROM events WHERE event_type <> 'error' GROUP BY ALL)
    SELECT run_date, date, aqi, {AQI_SQL} AS aqi_label FROM m""",
)
def _air(spark, d):
    return A.air_by_day(A.hourly_air(hourly_documents(spark, d)))


MONTHS_SQL = """t AS (SELECT month(o_orderdate) AS month, round_even(avg(o_totalprice) / 1000, 1) AS hi, round_even(avg(o_totalprice) / 2000, 1) AS lo FROM orders GROUP BY 1)"""


def _months(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.month("o_orderdate").alias("month")).agg(
        F.bround(F.avg("o_totalprice") / 1000, 1).alias("hi"), F.bround(F.avg("o_totalprice") / 2000, 1).alias("lo")
    )


@query(
    "monthly_interp",
    f"""WITH {MONTHS_SQL}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
    a AS (SELECT date, month(date) AS m, day(date) >= 15 AS late, year(date) AS y FROM d),
    b AS (SELECT *, CASE WHEN late THEN m ELSE (m + 10) % 12 + 1 END AS ma, CASE WHEN late THEN m % 12 + 1 ELSE m END AS mb,
      CASE WHEN NOT late AND m = 1 THEN y - 1 ELSE y END AS ya, CASE WHEN late AND m = 12 THEN y + 1 ELSE y END AS yb FROM a),
    c AS (SELECT *, dayofyear(make_date(ya, ma, 15)) AS da, dayofyear(make_date(yb, mb, 15)) AS db, dayofyear(date) AS dd FROM b),
    f AS (SELECT *, greatest(0, least(1, CASE WHEN db < da THEN CASE WHEN dd < db THEN (365 - da + dd) / (365 - da + db)::DOUBLE ELSE (dd - da) / (365 - da + db)::DOUBLE END
      ELSE (dd - da) / (db - da)::DOUBLE END)) AS frac FROM c)
    SELECT date, round(x.hi + frac * (z.hi - x.hi), 6) AS hi, round(x.lo + frac * (z.lo - x.lo), 6) AS lo FROM f JOIN t x ON x.month = ma JOIN t z ON z.month = mb""",
)
def _interp(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    out = W.interpolate_monthly(days, _months(spark, d))
    return out.select("date", F.round("hi", 6).alias("hi"), F.round("lo", 6).alias("lo"))


@query(
    "monthly_normals",
    """SELECT CAST(month(o_orderdate) AS INTEGER) AS month, round_even(avg(o_totalprice), 1) AS hi, round_even(avg(o_custkey), 1) AS lo FROM orders GROUP BY 1""",
)
def _normals(spark, d):
    o = table(spark, d, "orders")
    history = o.select(
        F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("hi"), F.col("o_custkey").cast("double").alias("lo")
    )
    return W.monthly_normals(history, _months(spark, d))


def period_documents(spark, d):
    """Forecast documents per user: a day and a night period per event day."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "value", "event_type")
    per = e.groupBy("user_id", "day").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.min("event_type").alias("kind"))
    text = F.when(F.col("kind") == "click", "Rain and snow in the morning").when(F.col("kind") == "error", "Sunny").otherwise(
        "Mainly snow at night"
    )
    halves = F.array(
        F.struct(
            F.concat(F.col("day").cast("string"), F.lit("T06:00:00")).alias("startTime"),
            F.lit(True).alias("isDaytime"),
            F.col("hi").alias("temperature"),
            text.alias("shortForecast"),
            text.alias("detailedForecast"),
        ),
        F.struct(
            F.concat(F.col("day").cast("string"), F.lit("T18:00:00")).alias("startTime"),
            F.lit(False).alias("isDaytime"),
            F.when(F.col("lo") != F.col("hi"), F.col("lo")).alias("temperature"),
            F.lit("Clear").alias("shortForecast"),
            F.lit("Clear night").alias("detailedForecast"),
        ),
    )
    docs = per.groupBy(F.col("user_id").alias("run_date")).agg(F.flatten(F.collect_list(halves)).alias("p"))
    body = F.to_json(F.struct(F.struct(F.array_sort("p").alias("periods")).alias("properties")))
    return docs.select("run_date", body.alias("payload"))


FORECAST_SQL = """
p AS (SELECT user_id AS run_date, CAST(ts AS DATE) AS day, max(value) AS hi, min(value) AS lo, min(event_type) AS kind FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY day) AS rn FROM p),
f AS (SELECT run_date, CAST(day AS VARCHAR) AS date, day, CAST(round_even(hi, 0) AS INTEGER) AS high_f, CAST(round_even(CASE WHEN lo <> hi THEN lo ELSE hi END, 0) AS INTEGER) AS low_f,
  CASE kind WHEN 'click' THEN 'mix' WHEN 'error' THEN 'none' ELSE 'snow' END AS precip_type,
  CASE kind WHEN 'click' THEN 'AM' WHEN 'error' THEN '' ELSE 'night' END AS precip_timing FROM r WHERE rn <= 7)
"""


@query(
    "forecast_days",
    f"WITH {FORECAST_SQL} SELECT run_date, date, strftime(day, '%a') AS day_name, high_f, low_f, precip_type, precip_timing FROM f",
)
def _forecast(spark, d):
    days = W.fold_periods(A.forecast_periods(period_documents(spark, d)))
    return days.select(
        "run_date",
        "date",
        "day_name",
        "high_f",
        "low_f",
        B.precipitation(F.col("short_forecast"), F.col("detailed_forecast")).alias("precip_type"),
        B.precipitation_timing(F.col("detailed_forecast")).alias("precip_timing"),
    )


@query(
    "temperature_bars",
    f"""WITH {FORECAST_SQL}, s AS (SELECT run_date, least(min(high_f), min(low_f)) - 5 AS a, greatest(max(high_f), max(low_f)) + 5 AS b FROM f GROUP BY run_date)
    SELECT f.run_date, date, round((low_f - a) / (b - a)::DOUBLE * 100, 6) AS lo_pct, round((high_f - a) / (b - a)::DOUBLE * 100, 6) AS hi_pct FROM f JOIN s ON f.run_date = s.run_date""",
)
def _bars(spark, d):
    out = W.temperature_bars(W.fold_periods(A.forecast_periods(period_documents(spark, d))))
    return out.select("run_date", "date", F.round("lo_pct", 6).alias("lo_pct"), F.round("hi_pct", 6).alias("hi_pct"))


@query(
    "weather_days",
    f"""WITH {FORECAST_SQL}, {MONTHS_SQL},
    m AS (SELECT user_id AS run_date, strftime(ts, '%Y-%m-%d') AS date, max(CAST(trunc(value * 3) AS INTEGER)) AS aqi FROM events WHERE event_type <> 'error' GROUP BY ALL),
    b AS (SELECT DISTINCT day, CASE WHEN day(day) >= 15 THEN month(day) ELSE (month(day) + 10) % 12 + 1 END AS ma, CASE WHEN day(day) >= 15 THEN month(day) % 12 + 1 ELSE month(day) END AS mb,
      year(day) - CASE WHEN day(day) < 15 AND month(day) = 1 THEN 1 ELSE 0 END AS ya, year(day) + CASE WHEN day(day) >= 15 AND month(day) = 12 THEN 1 ELSE 0 END AS yb FROM f),
    c AS (SELECT *, dayofyear(make_date(ya, ma, 15)) AS da, dayofyear(make_date(yb, mb, 15)) AS db, dayofyear(day) AS dd FROM b),
    g AS (SELECT *, greatest(0, least(1, CASE WHEN db < da THEN CASE WHEN dd < db THEN (365 - da + dd) / (365 - da + db)::DOUBLE ELSE (dd - da) / (365 - da + db)::DOUBLE END
      ELSE (dd - da) / (db - da)::DOUBLE END)) AS frac FROM c),
    n AS (SELECT day, x.hi + frac * (z.hi - x.hi) AS hi, x.lo + frac * (z.lo - x.lo) AS lo FROM g JOIN t x ON x.month = ma JOIN t z ON z.month = mb)
    SELECT f.run_date, f.date, high_f, low_f, precip_type, round_even(hi, 1) AS normal_hi, round_even(lo, 1) AS normal_lo, round(hi, 6) AS record_hi, aqi, CASE WHEN aqi IS NOT NULL THEN {AQI_SQL} END AS aqi_label
    FROM f JOIN n ON n.day = f.day LEFT JOIN m ON m.run_date = f.run_date AND m.date = f.date""",
)
def _weather(spark, d):
    days = W.fold_periods(A.forecast_periods(period_documents(spark, d)))
    air = A.air_by_day(A.hourly_air(hourly_documents(spark, d)))
    months = _months(spark, d)
    out = W.weather_days(days, air, months, months)
    record = F.round("record_hi", 6).alias("record_hi")
    return out.select("run_date", "date", "high_f", "low_f", "precip_type", "normal_hi", "normal_lo", record, "aqi", "aqi_label")


@query(
    "week_ahead",
    """WITH e AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS run_date, o_orderkey AS pos, o_orderdate,
      CASE WHEN o_orderkey % 17 = 0 THEN 'junk' WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%MZ') END AS date,
      CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 WHEN o_orderpriority LIKE '3%' THEN 2 ELSE 3 END AS kind FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY CASE WHEN date <> 'junk' THEN o_orderdate END ASC NULLS LAST, kind, pos) AS rn FROM e)
    SELECT run_date, date, 'Event ' || pos AS event, ['holiday', 'church', 'economic', 'launch'][kind + 1] AS type, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 5""",
)
def _week(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    date = (
        F.when(k % 17 == 0, "junk")
        .when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm'Z'"))
    )
    e = o.select(
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("run_date"),
        k.alias("pos"),
        date.alias("date"),
        F.format_string("Event %d", "o_orderkey").alias("event"),
        F.substring("o_orderpriority", 1, 1).alias("p"),
    )
    parts = [e.where(F.col("p") == x).drop("p") for x in "123"] + [e.where("p in ('4', '5')").drop("p")]
    return K.week_ahead(*parts)


@query(
    "event_dates",
    """SELECT o_orderkey, o_orderdate AS at_time, strftime(o_orderdate, '%A, %B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS shown,
      CASE WHEN m < 1.85 THEN 'New Moon' WHEN m < 5.53 THEN 'Waxing Crescent' WHEN m < 9.22 THEN 'First Quarter' WHEN m < 12.91 THEN 'Waxing Gibbous' WHEN m < 16.61 THEN 'Full Moon'
        WHEN m < 20.30 THEN 'Waning Gibbous' WHEN m < 23.99 THEN 'Last Quarter' WHEN m < 27.68 THEN 'Waning Crescent' ELSE 'New Moon' END AS moon
    FROM (SELECT *, ((date_diff('day', DATE '2000-01-06', CAST(o_orderdate AS DATE)) % 29.53058867::DOUBLE) + 29.53058867::DOUBLE) % 29.53058867::DOUBLE AS m FROM orders)""",
)
def _dates(spark, d):
    o = table(spark, d, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+05:00'")
    return o.select(
        "o_orderkey",
        T.parse_event_date(text).alias("at_time"),
        T.display_date(F.col("o_orderdate")).alias("shown"),
        T.moon_phase(F.to_date("o_orderdate")).alias("moon"),
    )


@query(
    "date_ranges",
    """SELECT o_orderkey, strftime(o_orderdate, '%B ') || day(o_orderdate) || '–' || CASE WHEN month(o_orderdate) = month(o_orderdate + INTERVAL 6 DAY) THEN '' ELSE strftime(o_orderdate + INTERVAL 6 DAY, '%B ') END || day(o_orderdate + INTERVAL 6 DAY) AS label FROM orders""",
)
def _ranges(spark, d):
    start = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", T.date_range_label(start, F.date_add(start, 6)).alias("label"))


def quote_documents(spark, d):
    """Events of a day as quote calls in order; errors are failed calls."""
    e = table(spark, d, "events")
    body = F.format_string('{"c":%.2f,"dp":%.3f}', F.when(F.col("event_id") % 13 == 0, 0.0).otherwise(F.col("value") * 40), F.col("value") - 50)
    return e.select(
        F.to_date("ts").alias("run_date"),
        F.col("event_id").alias("pos"),
        F.when(F.col("user_id") % 3 == 0, "^IDX").otherwise("ABC").alias("symbol"),
        F.when(F.col("event_type") != "error", body).alias("payload"),
    )


@query(
    "quotes",
    """WITH e AS (SELECT CAST(ts AS DATE) AS run_date, event_id AS pos, CASE WHEN user_id % 3 = 0 THEN '^IDX' ELSE 'ABC' END AS symbol, event_type = 'error' AS bad,
      round(CASE WHEN event_id % 13 = 0 THEN 0 ELSE value * 40 END, 2) AS price, round(value - 50, 3) AS change FROM events),
    i AS (SELECT *, sum(CASE WHEN NOT bad AND price <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_date ORDER BY pos) AS island FROM e),
    s AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY run_date, island ORDER BY pos) AS streak FROM i),
    b AS (SELECT run_date, min(pos) AS p FROM s WHERE bad AND streak = 4 GROUP BY run_date)
    SELECT e.run_date, e.pos, e.symbol, CASE WHEN change >= 0 THEN 'up' ELSE 'down' END AS direction FROM e LEFT JOIN b ON e.run_date = b.run_date
    WHERE NOT bad AND price <> 0 AND (b.p IS NULL OR e.pos <= b.p)""",
)
def _quotes(spark, d):
    out = A.quotes(quote_documents(spark, d), {"^IDX": "Index", "ABC": "Stock"}, 4)
    return out.select("run_date", "pos", "symbol", "direction")


@query(
    "ranked_stories",
    """WITH r AS (SELECT o_custkey || '-' || (year(o_orderdate) // 5) AS run_date, o_orderkey AS id,
      row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) // 5 ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders),
    k AS (SELECT r.*, CAST(trunc(o_totalprice) AS INTEGER) AS score FROM r JOIN orders ON o_orderkey = id WHERE pos < 5 AND o_orderstatus <> 'P')
    SELECT run_date, id, score, CAST(row_number() OVER (PARTITION BY run_date ORDER BY score DESC, pos) AS INTEGER) AS rank FROM k""",
)
def _stories(spark, d):
    o = table(spark, d, "orders")
    run, month = F.format_string("%d-%d", "o_custkey", period()), F.trunc("o_orderdate", "month")
    placed = in_documents(o, run, ["o_orderdate", "o_orderkey"], {"_b_month": month})
    ranks = placed.groupBy("run_date", "part").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"])).alias("payload")
    )
    body = F.to_json(
        F.struct(
            F.when(F.col("o_orderstatus") == "P", "job").otherwise("story").alias("type"),
            F.lit("T").alias("title"),
            F.col("o_totalprice").cast("int").alias("score"),
        )
    )
    docs = o.select(F.col("o_orderkey").alias("id"), body.alias("payload"))
    return A.stories(ranks, docs, 5).select("run_date", "id", "score", "rank")


@query(
    "launch_list",
    """WITH l AS (SELECT o_custkey || '-' || (year(o_orderdate) // 5) AS run_date, o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 'military' ELSE 'unknown' END AS mission_type,
       row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) // 5 ORDER BY o_orderkey) - 1 AS pos FROM orders)
    SELECT run_date, 'L' || o_orderkey AS name, strftime(o_orderdate, '%Y-%m-%d %H:%MZ') AS date, mission_type, 'Pad, Cape' AS launch_site,
      CAST(row_number() OVER (PARTITION BY run_date ORDER BY CASE WHEN mission_type = 'military' THEN 0 ELSE 1 END, strftime(o_orderdate, '%Y-%m-%d %H:%MZ'), pos) AS BIGINT) AS rank
    FROM l WHERE o_orderdate <= TIMESTAMP '1998-01-11 00:00:00'""",
)
def _launches(spark, d):
    o = table(spark, d, "orders")
    item = F.struct(
        F.col("o_orderkey"),
        F.struct(
            F.format_string("L%d", "o_orderkey").alias("name"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("net"),
            F.when(F.col("o_orderstatus") == "F", F.struct(F.lit("Military").alias("type"))).alias("mission"),
            F.struct(F.lit("Pad").alias("name"), F.struct(F.lit("Cape").alias("name")).alias("location")).alias("pad"),
        ).alias("r"),
    )
    run = F.format_string("%d-%d", "o_custkey", period())
    docs = in_documents(o, run, ["o_orderkey"]).groupBy("run_date", "part").agg(
        F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]).alias("results"))).alias("payload")
    )
    now = F.lit("1998-01-01 00:00:00").cast("timestamp")
    return A.launches(docs, now, 10).select("run_date", "name", "date", "mission_type", "launch_site", "rank")


@query(
    "economic_events",
    """SELECT o_custkey AS run_date, strftime(o_orderdate, '%Y-%m-%d') AS date, '08:30' AS time, 'Release ' || o_orderkey AS event, 'high' AS impact
    FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0""",
)
def _economic(spark, d):
    o = in_documents(table(spark, d, "orders"), "o_custkey", ["o_orderkey"])
    item = F.struct(
        F.when(F.col("o_orderkey") % 2 == 0, "us").otherwise("DE").alias("country"),
        F.when(F.col("o_orderstatus") == "F", "High").otherwise("low").alias("impact"),
        F.date_format("o_orderdate", "yyyy-MM-dd 08:30:00").alias("time"),
        F.format_string("Release %d", "o_orderkey").alias("event"),
    )
    docs = o.groupBy("run_date", "part").agg(
        F.to_json(F.struct(F.collect_list(item).alias("economicCalendar"))).alias("payload")
    )
    return A.economic_events(docs).select("run_date", "date", "time", "event", "impact")


@query(
    "aggregator_items",
    r"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS run_date, 'Clerk ' || o_orderpriority AS source, 'Order ' || o_orderkey AS title, 'http://a/' || o_orderkey AS url,
      o_orderdate AS published FROM orders""",
)
def _aggregator(spark, d):
    from newsloom.sources.feeds import aggregator_items

    o = table(spark, d, "orders")
    item = F.struct(
        F.struct(F.concat(F.lit("Clerk "), F.col("o_orderpriority")).alias("title")).alias("origin"),
        F.format_string(" Order %d ", "o_orderkey").alias("title"),
        F.array(F.struct(F.format_string("http://a/%d", "o_orderkey").alias("href"))).alias("alternate"),
        F.unix_timestamp("o_orderdate").alias("published"),
        F.struct(F.lit("<b>x</b> y").alias("content")).alias("summary"),
    )
    docs = o.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("run_date"), "o_custkey").agg(
        F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("payload")
    )
    out = aggregator_items(docs)
    return out.select("run_date", "source", "title", "url", "published")


@query(
    "reading_text",
    """SELECT event_id, CASE WHEN value * 40 > 1000 THEN 'big' WHEN user_id % 3 = 0 THEN 'index' ELSE 'plain' END AS kind FROM events""",
)
def _price(spark, d):
    e = table(spark, d, "events")
    text = B.price_text(F.col("value") * 40, F.when(F.col("user_id") % 3 == 0, "^I").otherwise("A"))
    kind = F.when(text.startswith("$"), "plain").when(F.contains(text, F.lit(".")), "index").otherwise("big")
    return e.select("event_id", kind.alias("kind"))


def _units(spark, d):
    """Orders of a customer as the units of a week."""
    o = table(spark, d, "orders")
    placed = position_in_group(o, ["o_custkey"], "o_orderkey")
    return placed.select(
        F.col("o_custkey").alias("week_start"),
        (F.col("rank") - 1).cast("int").alias("pos"),
        F.when(F.col("o_orderkey") % 3 == 0, "")
        .when(F.col("o_orderkey") % 7 == 0, "focus-3")
        .otherwise(F.col("o_orderstatus"))
        .alias("id"),
        F.when(F.col("o_orderkey") % 2 == 0, "Key_Scripture").otherwise("odd").alias("kind"),
        F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("A")).otherwise("").alias("anchor_ref"),
        F.array(F.lit(" B "), F.lit("")).alias("source_refs"),
        *[F.lit("").alias(c) for c in ("core_claim", "supporting_excerpt", "enhancement", "application", "prompt_hint")],
    )


UNITS_SQL = """
u AS (SELECT o_custkey AS week_start, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS k,
  CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'focus-3' ELSE o_orderstatus END AS g FROM orders),
g AS (SELECT *, 'focus-' || (pos + 1) AS f, CASE WHEN g = '' THEN 'focus-' || (pos + 1) ELSE g END AS i FROM u),
n AS (SELECT week_start, pos, k, i AS id, [i] AS seen FROM g WHERE pos = 0
  UNION ALL SELECT g.week_start, g.pos, g.k, CASE WHEN list_contains(seen, i) THEN f ELSE i END,
    list_append(seen, CASE WHEN list_contains(seen, i) THEN f ELSE i END) FROM n JOIN g ON g.week_start = n.week_start AND g.pos = n.pos + 1)
"""


@query(
    "weekly_units",
    f"""WITH RECURSIVE {UNITS_SQL} SELECT week_start, CAST(pos AS INTEGER) AS pos, id, CASE WHEN k % 2 = 0 THEN 'key_scripture' ELSE 'narrative_unit' END AS kind,
      CASE WHEN k % 5 = 0 THEN 'A' ELSE 'B' END AS anchor_ref, CASE WHEN k % 5 = 0 THEN 'A,B' ELSE 'B' END AS refs FROM n""",
)
def _weekly(spark, d):
    out = K.normalize_units(_units(spark, d))
    return out.select("week_start", "pos", "id", "kind", "anchor_ref", F.array_join("source_refs", ",").alias("refs"))


@query(
    "unit_of_day",
    f"""WITH RECURSIVE {UNITS_SQL}, s AS (SELECT week_start, id, pos AS day FROM n WHERE pos < 6),
    d AS (SELECT DISTINCT o_custkey AS week_start, CAST(o_orderdate AS DATE) AS date, CASE WHEN dayofweek(o_orderdate) = 0 THEN 0 ELSE dayofweek(o_orderdate) - 1 END AS today FROM orders)
    SELECT date, d.week_start, arg_min(id, (day - today + 6) % 6) AS unit_id FROM d JOIN s ON d.week_start = s.week_start GROUP BY date, d.week_start""",
)
def _unit_of_day(spark, d):
    units = K.normalize_units(_units(spark, d))
    empty = units.select("week_start", F.lit("monday").alias("day"), F.lit("none").alias("unit_id")).where("false")
    sequence = K.proposed_sequence(units, empty)
    dates = table(spark, d, "orders").select(
        F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("week_start")
    ).distinct()
    return K.unit_of_day(units, sequence, dates)
