"""Date and time column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats of calendar events, tried in this order. A zone is
# dropped, not converted, so it is removed before parsing.
EVENT_FORMATS = [
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})?$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}Z?$", "yyyy-MM-dd HH:mm"),
]

# Date formats of feed entries, the weekday left out.
FEED_FORMATS = [
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy HH:mm Z",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
]


def parse_event_date(text: Column) -> Column:
    """Wall-clock time of an event; null when blank or in no known format."""
    zone = r"(Z|(?<=\d{2}:\d{2}:\d{2})[+-]\d{2}:?\d{2})$"
    bare = F.regexp_replace(text, zone, "")
    out = None
    for pattern, fmt in EVENT_FORMATS:
        parsed = F.try_to_timestamp(bare, F.lit(fmt))
        out = F.when(text.rlike(pattern), parsed) if out is None else out.when(text.rlike(pattern), parsed)
    return out


def parse_feed_date(*fields: Column) -> Column:
    """UTC time of the first field that parses; zoneless text is taken as UTC."""
    tries = []
    for c in fields:
        text = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},\s*", "")
        text = F.regexp_replace(text, r"\s(GMT|UTC|UT|Z)$", " +0000")
        tries += [F.try_to_timestamp(text, F.lit(fmt)) for fmt in FEED_FORMATS]
    return F.coalesce(*tries)


def moon_phase(day: Column) -> Column:
    """Phase of the moon by days since a known new moon."""
    # Reference new moon, length of a lunation, phase limits.
    age = F.pmod(F.datediff(day, F.lit("2000-01-06").cast("date")).cast("double"), F.lit(29.53058867))
    limits = [
        (1.85, "New Moon"),
        (5.53, "Waxing Crescent"),
        (9.22, "First Quarter"),
        (12.91, "Waxing Gibbous"),
        (16.61, "Full Moon"),
        (20.30, "Waning Gibbous"),
        (23.99, "Last Quarter"),
        (27.68, "Waning Crescent"),
    ]
    out = None
    for limit, name in limits:
        out = F.when(age < limit, name) if out is None else out.when(age < limit, name)
    return out.otherwise("New Moon")


def date_range_label(start: Column, end: Column) -> Column:
    """``March 2–8``, or both months when they differ."""
    head = F.concat(F.date_format(start, "MMMM"), F.lit(" "), F.dayofmonth(start).cast("string"), F.lit("–"))
    other = F.concat(F.date_format(end, "MMMM"), F.lit(" "))
    same = F.month(start) == F.month(end)
    return F.concat(head, F.when(same, "").otherwise(other), F.dayofmonth(end).cast("string"))


def display_date(day: Column) -> Column:
    return F.date_format(day, "EEEE, MMMM d, y")


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "h:mm a")


def within_days(day: Column, today: Column, days: int) -> Column:
    """Inclusive window that starts today."""
    return day.between(today, F.date_add(today, days))


def conference_event(day: Column) -> Column:
    """Name of a conference session by month and weekday."""
    season = F.when(F.month(day) == 4, "Spring").otherwise("Fall")
    label = F.when(F.dayofweek(day) == 7, "Saturday").otherwise("Sunday")
    return F.format_string("LDS General Conference — %s %d (%s)", season, F.year(day), label)
