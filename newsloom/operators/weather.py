"""Forecast days, monthly normals, bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.bands import precipitation, precipitation_timing, scale_position


def fold_periods(periods: DataFrame, days: int = 7) -> DataFrame:
    """One row per calendar day from its day and night periods.

    The day limit comes before days without any temperature are dropped. A
    missing side takes the other's value.
    """
    day, night = F.col("is_daytime"), ~F.col("is_daytime")
    temp = F.bround("temperature").cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "is_daytime", "detailed_forecast")))
    # At most two periods share a date.
    folded = periods.groupBy("run_date", "date").agg(
        F.max_by(F.when(day, temp), F.when(day & temp.isNotNull(), F.col("pos"))).alias("_hi"),
        F.max_by(F.when(night, temp), F.when(night & temp.isNotNull(), F.col("pos"))).alias("_lo"),
        F.max_by("short_forecast", F.struct(day.alias("d"), F.when(day, F.col("pos")).otherwise(-F.col("pos")).alias("p"))).alias(
            "short_forecast"
        ),
        F.min_by("wind_speed", "pos").alias("wind_speed"),
        F.min_by("wind_direction", "pos").alias("wind_direction"),
        F.min_by(F.struct("precip_chance"), "pos").alias("_pc"),
        ordered.alias("_texts"),
    )
    w = Window.partitionBy("run_date").orderBy("date")
    kept = folded.withColumn("_day", F.row_number().over(w)).where(F.col("_day") <= days)
    first_day = F.get(F.filter("_texts", lambda x: x["is_daytime"]), F.lit(0))["detailed_forecast"]
    nights = F.transform(F.filter("_texts", lambda x: ~x["is_daytime"]), lambda x: x["detailed_forecast"])
    text = F.array_join(
        F.filter(F.concat(F.array(F.coalesce(first_day, F.lit(""))), nights), lambda t: t != ""), " "
    )
    return kept.where(F.col("_hi").isNotNull() | F.col("_lo").isNotNull()).select(
        "run_date",
        "date",
        F.date_format(F.to_date("date"), "EEE").alias("day_name"),
        F.coalesce("_hi", "_lo").alias("high_f"),
        F.coalesce("_lo", "_hi").alias("low_f"),
        "short_forecast",
        F.trim(text).alias("detailed_forecast"),
        "wind_speed",
        "wind_direction",
        F.coalesce("_pc.precip_chance", F.lit(0.0)).alias("precip_chance"),
        F.col("short_forecast").alias("condition"),
    )


def monthly_normals(history: DataFrame, fallback: DataFrame) -> DataFrame:
    """Mean high and low per month; the fallback table if a month is missing.

    ``history``: date, hi, lo over years; ``fallback``: month, hi, lo.
    """
    own = (
        history.where(F.col("hi").isNotNull() & F.col("lo").isNotNull())
        .groupBy(F.month("date").alias("month"))
        .agg(F.bround(F.avg("hi"), 1).alias("_hi"), F.bround(F.avg("lo"), 1).alias("_lo"))
    )
    whole = own.agg((F.count(F.lit(1)) == 12).alias("_whole"))
    # Twelve rows and one flag: both have a fixed size.
    both = fallback.join(own, "month", "left").withColumn("_one", F.lit(1)).join(
        F.broadcast(whole.withColumn("_one", F.lit(1))), "_one"
    )
    return both.select(
        "month",
        F.when(F.col("_whole"), F.col("_hi")).otherwise(F.col("hi")).alias("hi"),
        F.when(F.col("_whole"), F.col("_lo")).otherwise(F.col("lo")).alias("lo"),
    )


def interpolate_monthly(days: DataFrame, table: DataFrame, date: str = "date") -> DataFrame:
    """Value of a day between the mid-months around it (columns hi, lo).

    A month's value is that of its 15th; over the turn of the year the range
    is measured on a year of 365 days.
    """
    d = F.to_date(date)
    m, late = F.month(d), F.dayofmonth(d) >= 15
    a = F.when(late, m).otherwise(F.pmod(m - 2, F.lit(12)) + 1)
    b = F.when(late, F.pmod(m, F.lit(12)) + 1).otherwise(m)
    year_a = F.when(~late & (m == 1), F.year(d) - 1).otherwise(F.year(d))
    year_b = F.when(late & (m == 12), F.year(d) + 1).otherwise(F.year(d))
    mid_a = F.dayofyear(F.make_date(year_a, a, F.lit(15)))
    mid_b = F.dayofyear(F.make_date(year_b, b, F.lit(15)))
    doy = F.dayofyear(d)
    span = F.lit(365) - mid_a + mid_b
    over = F.when(doy < mid_b, (F.lit(365) - mid_a + doy) / span).otherwise((doy - mid_a) / span)
    frac = F.when(mid_b < mid_a, over).otherwise((doy - mid_a) / (mid_b - mid_a))
    frac = F.greatest(F.lit(0.0), F.least(F.lit(1.0), frac))
    rows = days.withColumns({"_a": a, "_b": b, "_f": frac})
    ta = table.select(F.col("month").alias("_a"), F.col("hi").alias("_ha"), F.col("lo").alias("_la"))
    tb = table.select(F.col("month").alias("_b"), F.col("hi").alias("_hb"), F.col("lo").alias("_lb"))
    # The table has twelve rows.
    out = rows.join(F.broadcast(ta), "_a", "left").join(F.broadcast(tb), "_b", "left")
    return out.withColumns(
        {
            "hi": F.col("_ha") + F.col("_f") * (F.col("_hb") - F.col("_ha")),
            "lo": F.col("_la") + F.col("_f") * (F.col("_lb") - F.col("_la")),
        }
    ).drop("_a", "_b", "_f", "_ha", "_la", "_hb", "_lb")


def weather_days(
    forecast: DataFrame, air: DataFrame, normals: DataFrame, records: DataFrame
) -> DataFrame:
    """Forecast days with precipitation, air quality, normals and records.

    ``air``: run_date, date, aqi, aqi_label; ``normals`` and ``records`` are
    monthly tables. Everything joins on the date.
    """
    days = forecast.withColumns(
        {
            "precip_type": precipitation(F.col("short_forecast"), F.col("detailed_forecast")),
            "precip_timing": precipitation_timing(F.col("detailed_forecast")),
        }
    )
    usual = interpolate_monthly(days, normals).withColumnsRenamed({"hi": "_nh", "lo": "_nl"})
    both = interpolate_monthly(usual, records).withColumnsRenamed({"hi": "record_hi", "lo": "record_lo"})
    out = both.withColumns({"normal_hi": F.bround("_nh", 1), "normal_lo": F.bround("_nl", 1)}).drop("_nh", "_nl")
    return out.join(air, ["run_date", "date"], "left")


def temperature_bars(days: DataFrame, run: str = "run_date") -> DataFrame:
    """Place of each day's low and high on a common scale per run."""
    ends = days.groupBy(run).agg(
        (F.least(F.min("high_f"), F.min("low_f")) - 5).alias("scale_min"),
        (F.greatest(F.max("high_f"), F.max("low_f")) + 5).alias("scale_max"),
    )
    out = days.join(ends, run, "left").fillna({"scale_min": 0, "scale_max": 100})
    low, high = F.col("scale_min"), F.col("scale_max")

    def place(c: str, default: float) -> Column:
        return F.coalesce(scale_position(F.col(c), low, high), F.lit(default))

    return out.withColumns({"lo_pct": place("low_f", 0.0), "hi_pct": place("high_f", 100.0)}).withColumn(
        "bar_width", F.greatest(F.col("hi_pct") - F.col("lo_pct"), F.lit(1.0))
    )
