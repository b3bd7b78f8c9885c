"""Rows out of landed JSON answers: weather, air, quotes, launches, stories.

Every reader takes one document per row, with ``run_date`` and the JSON text in
``payload``, so a whole history of answers is read in one pass. ``air_forecast``,
``launches``, ``stories`` (ranks) and ``on_this_day`` also take a run in several
documents, numbered by ``part``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.bands import aqi_label, fahrenheit, miles_per_hour, price_text, weather_text
from newsloom.operators.ranking import circuit_breaker, running, top_per_group

PERIODS_DDL = (
    "properties struct<periods: array<struct<startTime: string, isDaytime: boolean, temperature: double,"
    " shortForecast: string, detailedForecast: string, windSpeed: string, windDirection: string,"
    " probabilityOfPrecipitation: struct<value: double>>>>"
)
DAILY_DDL = (
    "daily struct<time: array<string>, temperature_2m_max: array<double>, temperature_2m_min: array<double>,"
    " precipitation_probability_max: array<int>, weather_code: array<int>, wind_speed_10m_max: array<double>,"
    " wind_direction_10m_dominant: array<double>>"
)


def _in_parts(docs: DataFrame) -> DataFrame:
    """Documents with their number inside the run, 0 where a run has one."""
    return docs if "part" in docs.columns else docs.withColumn("part", F.lit(0))


def forecast_periods(docs: DataFrame) -> DataFrame:
    """Half-day forecast periods in order."""
    doc = F.from_json("payload", PERIODS_DDL)
    rows = docs.select("run_date", F.posexplode(doc["properties"]["periods"]).alias("pos", "p"))
    return rows.select(
        "run_date",
        "pos",
        F.substring("p.startTime", 1, 10).alias("date"),
        F.coalesce("p.isDaytime", F.lit(False)).alias("is_daytime"),
        F.col("p.temperature").alias("temperature"),
        F.coalesce("p.shortForecast", F.lit("")).alias("short_forecast"),
        F.coalesce("p.detailedForecast", F.lit("")).alias("detailed_forecast"),
        F.coalesce("p.windSpeed", F.lit("")).alias("wind_speed"),
        F.coalesce("p.windDirection", F.lit("")).alias("wind_direction"),
        F.col("p.probabilityOfPrecipitation.value").alias("precip_chance"),
    ).where(F.coalesce("date", F.lit("")) != "")


def daily_forecast(docs: DataFrame, days: int = 7) -> DataFrame:
    """Days of a parallel-array forecast, as many as the shortest array has."""
    d = F.from_json("payload", DAILY_DDL)["daily"]

    def given(name: str, kind: str) -> Column:
        # An absent array counts as an empty one.
        return F.coalesce(d[name], F.array().cast(f"array<{kind}>"))

    times, highs = given("time", "string"), given("temperature_2m_max", "double")
    lows = given("temperature_2m_min", "double")
    n = F.least(F.lit(days), F.size(times), F.size(highs), F.size(lows))
    zipped = F.arrays_zip(
        times.alias("t"),
        highs.alias("hi"),
        lows.alias("lo"),
        given("precipitation_probability_max", "int").alias("pc"),
        given("weather_code", "int").alias("code"),
    )
    rows = docs.select("run_date", F.posexplode(F.slice(zipped, F.lit(1), n)).alias("pos", "x"))
    x = F.col("x")
    return rows.select(
        "run_date",
        "pos",
        x.getField("t").alias("date"),
        F.bround(x.getField("hi")).cast("int").alias("high_f"),
        F.bround(x.getField("lo")).cast("int").alias("low_f"),
        F.coalesce(x.getField("pc"), F.lit(0)).alias("precip_chance"),
        weather_text(F.coalesce(x.getField("code"), F.lit(0))).alias("condition"),
    )


OBSERVATION_DDL = (
    "properties struct<temperature: struct<value: double>, textDescription: string, windSpeed: struct<value: double>,"
    " windDirection: struct<value: double>, relativeHumidity: struct<value: double>>"
)


def current_conditions(docs: DataFrame) -> DataFrame:
    """Latest station reading in customary units."""
    p = F.from_json("payload", OBSERVATION_DDL)["properties"]
    return docs.select(
        "run_date",
        fahrenheit(p["temperature"]["value"]).alias("temperature_f"),
        F.coalesce(p["textDescription"], F.lit("Unknown")).alias("condition"),
        miles_per_hour(p["windSpeed"]["value"]).alias("wind_mph"),
        p["windDirection"]["value"].alias("wind_direction"),
        p["relativeHumidity"]["value"].alias("humidity"),
    )


def hourly_air(docs: DataFrame) -> DataFrame:
    """Hourly air quality readings without the missing ones."""
    h = F.from_json("payload", "hourly struct<time: array<string>, us_aqi: array<int>>")["hourly"]
    pairs = F.arrays_zip(h["time"].alias("ts"), h["us_aqi"].alias("aqi"))
    rows = docs.select("run_date", F.explode(pairs).alias("x"))
    ts = F.col("x").getField("ts")
    return rows.select("run_date", ts.alias("ts"), F.substring(ts, 1, 10).alias("date"), F.col("x").getField("aqi").alias("aqi")).where(
        F.col("aqi").isNotNull() & F.col("ts").isNotNull()
    )


def air_by_day(hourly: DataFrame) -> DataFrame:
    """Worst reading of each day with its band."""
    out = hourly.groupBy("run_date", "date").agg(F.max("aqi").alias("aqi"))
    return out.withColumn("aqi_label", aqi_label(F.col("aqi")))


def air_forecast(docs: DataFrame) -> DataFrame:
    """Forecast per day; a later entry for a day replaces an earlier one."""
    rows = _in_parts(docs).select(
        "run_date",
        "part",
        F.posexplode(F.from_json("payload", "array<struct<DateForecast: string, AQI: int>>")).alias("pos", "x"),
    ).select("run_date", "part", "pos", F.substring("x.DateForecast", 1, 10).alias("date"), F.col("x.AQI").alias("aqi"))
    last = rows.where(F.coalesce("date", F.lit("")) != "").groupBy("run_date", "date").agg(
        F.max_by(F.struct("aqi"), F.struct("part", "pos")).alias("_x")
    )
    aqi = F.col("_x.aqi")
    return last.select(
        "run_date", "date", aqi.alias("aqi"), F.when(aqi.isNull(), "Moderate").otherwise(aqi_label(aqi)).alias("aqi_label")
    )


def air_now(docs: DataFrame) -> DataFrame:
    """First observation of an answer."""
    first = F.get(F.from_json("payload", "array<struct<AQI: int, `PM2.5`: double, PM10: double>>"), F.lit(0))
    return docs.select("run_date", first.alias("x")).where("x is not null").select(
        "run_date",
        F.col("x.AQI").alias("current_aqi"),
        aqi_label(F.col("x.AQI")).alias("current_aqi_label"),
        F.col("x.`PM2.5`").alias("pm2_5"),
        F.col("x.PM10").alias("pm10"),
    )


def valid_quote(price: Column, change: Column) -> tuple[Column, Column]:
    """A price that is neither missing nor zero, with a change (0.0 is one)."""
    return F.coalesce(price, F.lit(0.0)) != 0.0, change.isNotNull()


def quotes(docs: DataFrame, labels: Mapping[str, str], limit: int = 3) -> DataFrame:
    """Quotes of the configured symbols, in their order.

    ``docs`` has one row per run and symbol with its position; a null payload
    is a failed call. After ``limit`` failures in a row the rest is not used;
    an answer without a valid quote neither counts nor ends the row.
    """
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    q = F.from_json("payload", "c double, dp double")
    rows = docs.where(F.col("symbol").isin(list(labels))).withColumns({"price": q["c"], "change": q["dp"]})
    has_price, has_change = valid_quote(F.col("price"), F.col("change"))
    valid = has_price & has_change
    used = circuit_breaker(rows, ["run_date"], F.col("payload").isNull(), F.coalesce(valid, F.lit(False)), limit)
    return used.where(valid).select(
        "run_date",
        "pos",
        "symbol",
        names[F.col("symbol")].alias("label"),
        price_text(F.col("price"), F.col("symbol")).alias("price"),
        F.bround("change", 2).alias("change_pct"),
        F.when(F.col("change") >= 0, "up").otherwise("down").alias("direction"),
    )


LAUNCH_DDL = (
    "results array<struct<name: string, net: string, mission: struct<type: string, description: string>,"
    " rocket: struct<configuration: struct<full_name: string>>, launch_service_provider: struct<name: string>,"
    " pad: struct<name: string, location: struct<name: string>>, status: struct<name: string>>>"
)

# Mission types listed first.
PRIORITY_MISSIONS = ["government", "military", "classified"]


def launches(docs: DataFrame, now: Column, days: int = 10, first: list[str] | None = None) -> DataFrame:
    """Launches up to a horizon; priority missions first, then by date."""
    blank = F.lit("")
    doc = F.from_json("payload", LAUNCH_DDL)
    rows = _in_parts(docs).select("run_date", "part", F.posexplode(doc["results"]).alias("pos", "r"))
    at = F.try_to_timestamp(F.col("r.net"))
    kind = F.lower(F.coalesce("r.mission.type", blank))
    pad, place = F.col("r.pad.name"), F.col("r.pad.location.name")
    near = rows.where(F.coalesce("r.net", blank) != "").where(at <= now + F.expr(f"INTERVAL {int(days)} DAYS"))
    out = near.select(
        "run_date",
        "part",
        "pos",
        F.coalesce("r.name", blank).alias("name"),
        F.coalesce("r.rocket.configuration.full_name", blank).alias("vehicle"),
        F.coalesce("r.launch_service_provider.name", blank).alias("provider"),
        F.date_format(at, "yyyy-MM-dd HH:mm'Z'").alias("date"),
        F.concat_ws(", ", F.when(pad != "", pad), F.when(place != "", place)).alias("launch_site"),
        F.when(kind == "", "unknown").otherwise(kind).alias("mission_type"),
        F.substring(F.coalesce("r.mission.description", blank), 1, 300).alias("mission_description"),
        F.coalesce("r.status.name", blank).alias("status"),
    )
    lead = F.when(F.col("mission_type").isin(first or PRIORITY_MISSIONS), 0).otherwise(1)
    listed = out.withColumn("_lead", lead)
    buckets = {"_b_lead": F.col("_lead"), "_b_date": F.col("date")}
    return running(listed, ["run_date"], buckets, ["_lead", "date", "part", "pos"], {"rank": F.lit(1)}).drop("_lead", "part")


def stories(ranks: DataFrame, docs: DataFrame, most: int = 15) -> DataFrame:
    """The first ids of a ranked list with their item, best score first.

    ``ranks``: run_date, payload = JSON list of ids; ``docs``: id, payload.
    """
    ids = _in_parts(ranks).select(
        "run_date", "part", F.posexplode(F.slice(F.from_json("payload", "array<bigint>"), 1, most)).alias("pos", "id")
    )
    if "part" in ranks.columns:
        ids = top_per_group(ids, ["run_date"], ["part", "pos"], most, "_rank").withColumn("pos", F.col("_rank") - 1)
    d = F.from_json("payload", "type string, title string, url string, score int, descendants int")
    info = docs.select("id", d.alias("d")).where((F.col("d.type") == "story") & (F.coalesce("d.title", F.lit("")) != ""))
    out = ids.join(info, "id", "inner").select(
        "run_date",
        "pos",
        "id",
        F.col("d.title").alias("title"),
        F.coalesce("d.url", F.lit("")).alias("url"),
        F.coalesce("d.score", F.lit(0)).alias("score"),
        F.coalesce("d.descendants", F.lit(0)).alias("comments"),
    )
    return top_per_group(out, ["run_date"], [F.desc("score"), "pos"], most, "rank")


def economic_events(docs: DataFrame) -> DataFrame:
    """United States events of high or medium impact."""
    doc = F.from_json(
        "payload", "economicCalendar array<struct<country: string, impact: string, time: string, event: string>>"
    )
    rows = docs.select("run_date", F.posexplode(doc["economicCalendar"]).alias("pos", "e"))
    impact = F.lower(F.coalesce("e.impact", F.lit("")))
    time = F.coalesce("e.time", F.lit(""))
    return rows.where((F.upper(F.coalesce("e.country", F.lit(""))) == "US") & impact.isin("high", "medium")).select(
        "run_date",
        "pos",
        F.substring(time, 1, 10).alias("date"),
        F.substring(time, 12, 5).alias("time"),
        F.coalesce("e.event", F.lit("")).alias("event"),
        impact.alias("impact"),
    )


def on_this_day(docs: DataFrame, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(events per list, diagnostics of runs that have none)."""
    doc = F.from_json(
        "payload",
        "selected array<struct<year: string, text: string>>, events array<struct<year: string, text: string>>",
    )
    split = "part" in docs.columns
    parsed = _in_parts(docs).select("run_date", "part", F.col("payload").isNull().alias("failed"), doc.alias("d"))
    none = F.array().cast("array<struct<year:string,text:string>>")
    out = None
    for name in ("selected", "events"):
        rows = parsed.select(
            "run_date",
            "part",
            F.lit(name).alias("list"),
            F.posexplode(F.slice(F.coalesce(F.col("d")[name], none), 1, most)).alias("pos", "e"),
        ).select("run_date", "part", "list", "pos", F.coalesce("e.year", F.lit("")).alias("year"), F.coalesce("e.text", F.lit("")).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    if split:
        out = top_per_group(out, ["run_date", "list"], ["part", "pos"], most, "_rank").withColumn("pos", F.col("_rank") - 1)
    count = F.size(F.coalesce(F.col("d.selected"), none)) + F.size(F.coalesce(F.col("d.events"), none))
    told = parsed.select("run_date", "failed", count.alias("count"))
    if split:
        told = told.groupBy("run_date").agg(F.max("failed").alias("failed"), F.sum("count").alias("count"))
    status = F.when(F.col("count") == 0, F.when(F.col("failed"), "failed").otherwise("ok_empty"))
    notes = told.select("run_date", status.alias("status")).where("status is not null")
    return out.select("run_date", "list", "pos", "year", "text"), notes
