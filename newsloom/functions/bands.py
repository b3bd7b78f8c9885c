"""Bands, labels and conversions of numeric readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper limits of the air quality bands.
AQI_BANDS = [
    (50, "Good", "#15803d"),
    (100, "Moderate", "#854d0e"),
    (150, "Unhealthy for Sensitive Groups", "#c2410c"),
    (200, "Unhealthy", "#dc2626"),
    (300, "Very Unhealthy", "#7c3aed"),
]
AQI_TOP = ("Hazardous", "#991b1b")
AQI_NONE = ("unavailable", "#666666")

# Weather codes.
WEATHER_CODES = {
    0: "Clear",
    1: "Mainly clear",
    2: "Partly cloudy",
    3: "Overcast",
    45: "Fog",
    48: "Rime fog",
    51: "Light drizzle",
    53: "Drizzle",
    55: "Heavy drizzle",
    56: "Light freezing drizzle",
    57: "Freezing drizzle",
    61: "Light rain",
    63: "Rain",
    65: "Heavy rain",
    66: "Light freezing rain",
    67: "Freezing rain",
    71: "Light snow",
    73: "Snow",
    75: "Heavy snow",
    77: "Snow grains",
    80: "Light showers",
    81: "Showers",
    82: "Heavy showers",
    85: "Light snow showers",
    86: "Snow showers",
    95: "Thunderstorm",
    96: "Thunderstorm w/ hail",
    99: "Severe thunderstorm",
}


def _band(aqi: Column, at: int) -> Column:
    out = F.when(aqi.isNull(), AQI_NONE[at - 1])
    for band in AQI_BANDS:
        out = out.when(aqi <= band[0], band[at])
    return out.otherwise(AQI_TOP[at - 1])


def aqi_label(aqi: Column) -> Column:
    return _band(aqi, 1)


def aqi_color(aqi: Column) -> Column:
    return _band(aqi, 2)


def weather_text(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in WEATHER_CODES.items() for x in kv])
    return F.coalesce(known[code.cast("int")], F.lit("Unknown"))


def fahrenheit(celsius: Column) -> Column:
    return F.bround(celsius * 9 / 5 + 32).cast("int")


def miles_per_hour(metres_per_second: Column) -> Column:
    return F.bround(metres_per_second * F.lit(2.237)).cast("int")


def _says(text: Column, *words: str) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def precipitation(short: Column, detailed: Column) -> Column:
    """Kind of precipitation named in a forecast; the first that fits."""
    text = F.lower(F.concat_ws(" ", short, detailed))
    snow = _says(text, "snow", "flurries", "blizzard", "winter storm")
    rain = _says(text, "rain", "shower", "drizzle", "precipitation")
    return (
        F.when(_says(text, "freezing rain", "ice", "sleet", "freezing drizzle"), "freezing_rain")
        .when(_says(text, "rain and snow", "snow and rain", "wintry mix") | (snow & rain), "mix")
        .when(_says(text, "thunderstorm", "thunder", "t-storm"), "thunderstorm")
        .when(snow, "snow")
        .when(rain, "rain")
        .otherwise("none")
    )


def precipitation_timing(detailed: Column) -> Column:
    text = F.lower(F.coalesce(detailed, F.lit("")))
    return (
        F.when(_says(text, "after noon", "in the afternoon"), "PM")
        .when(_says(text, "before noon", "in the morning"), "AM")
        .when(_says(text, "in the evening", "after midnight"), "eve")
        .when(_says(text, "mainly") & _says(text, "night"), "night")
        .otherwise("")
    )


def short_condition(condition: Column) -> Column:
    """Condition in a word or two."""
    c = F.lower(F.coalesce(condition, F.lit("")))
    return (
        F.when(c == "", "")
        .when(_says(c, "thunderstorm"), "T-storm")
        .when(_says(c, "snow") & _says(c, "rain"), "Mix")
        .when(_says(c, "snow"), "Snow")
        .when(_says(c, "rain", "shower"), "Shwrs")
        .when(_says(c, "clear", "sunny"), "Sunny")
        .when(_says(c, "cloudy", "overcast"), "Cloudy")
        .when(_says(c, "fog"), "Fog")
        .when(F.length(c) > 15, F.concat(F.substring(c, 1, 12), F.lit("...")))
        .otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 100)))
    )


def scale_position(value: Column, low: Column, high: Column) -> Column:
    """Place of a value on a bar, 0 to 100; the middle of an empty bar."""
    pct = (value - low) / (high - low) * 100
    return F.when(high == low, 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct)))


def fixed(value: Column, digits: int = 1) -> Column:
    """Number with up to four decimals, rounded from its exact binary value.

    Ties, which only exact halves are, go to the even digit.
    """
    unit, size = 2**62, 10**digits
    x = value.cast("double")
    whole = F.floor(F.abs(x))
    # The fraction as whole parts of 2^-62, in exact arithmetic from there on.
    parts = ((F.abs(x) - whole) * F.lit(float(unit))).cast("long").cast("decimal(19,0)") * F.lit(size).cast("decimal(6,0)")
    one = F.lit(unit).cast("decimal(19,0)")
    rest = parts % one
    low = ((parts - rest) / one).cast("long")
    half = F.lit(unit // 2).cast("decimal(19,0)")
    up = (rest > half) | ((rest == half) & (low % 2 == 1))
    total = whole.cast("long") * F.lit(size) + low + up.cast("long")
    sign = F.when(x < 0, "-").otherwise("")
    tail = F.lpad((total % size).cast("string"), digits, "0")
    return F.concat(sign, F.floor(total / F.lit(size)).cast("string"), F.lit("."), tail)


def rounded(value: Column, digits: int) -> Column:
    """The number itself rounded like ``fixed``."""
    return fixed(value, digits).cast("double")


def price_text(price: Column, symbol: Column) -> Column:
    """Quote as shown: large ones whole, indexes without currency."""
    return (
        F.when(price > 1000, F.format_number(F.bround(price, 0), 0))
        .when(symbol.startswith("^"), fixed(price, 2))
        .otherwise(F.concat(F.lit("$"), fixed(price, 2)))
    )


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost of a call at prices per million tokens."""
    million = F.lit(1_000_000)
    return tokens_in / million * price_in + tokens_out / million * price_out
