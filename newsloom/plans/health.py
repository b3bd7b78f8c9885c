"""Source health, feed recommendations, rules for new feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.anomaly import severity_rank
from newsloom.operators.metrics import enrich_rates, feed_metrics, last_nonempty_date, merge_enrich_rates
from newsloom.sources.tables import window_of

# Health labels of a feed.
HEALTHS = ["active", "headline_radar", "low_frequency", "enrichment_required", "degraded", "broken"]

_SOFT = ["active", "low_frequency"]


def percent(rate: Column) -> Column:
    """Whole percent, cut not rounded; ``--`` when unknown."""
    return F.coalesce(F.concat(F.floor(rate * 100).cast("string"), F.lit("%")), F.lit("--"))


def computed_health(health: Column, items: Column, median: Column, fallback: Column, http_error: Column) -> Column:
    """Health from evidence. Rules read the configured health, the last wins."""
    soft = health.isin(_SOFT)
    return (
        F.when((http_error >= 0.5) & soft, "degraded")
        .when(((fallback >= 0.5) | ((median < 100) & (items > 0))) & soft, "enrichment_required")
        .when((items > 0) & (health == "broken"), "degraded")
        .when((items == 0) & (health == "active"), "degraded")
        .when((items > 0) & (items <= 3) & (health == "active"), "low_frequency")
        .otherwise(health)
    )


def observations(
    health: Column, items: Column, median: Column, fallback: Column, http_error: Column, paywall: Column, days: int
) -> Column:
    """What the rules noticed, in their order."""
    volume = (
        F.when((items > 0) & (health == "broken"), "Broken feed produced items; review for recovery")
        .when(items == 0, f"Zero items in {days}-day window")
        .when(items <= 3, F.format_string(f"Very low volume (%d items in {days} days)", items))
    )
    return F.array_compact(
        F.array(
            volume,
            F.when((median < 100) & (items > 0), F.format_string("Short RSS bodies (median %d chars)", median)),
            F.when(fallback >= 0.5, F.format_string("High normalizer fallback rate (%s)", percent(fallback))),
            F.when(http_error >= 0.5, F.format_string("High HTTP error rate (%s)", percent(http_error))),
            F.when(paywall >= 0.8, F.format_string("High paywall rate (%s)", percent(paywall))),
        )
    )


def status_transition(configured: Column, computed: Column) -> Column:
    a, b = severity_rank(configured), severity_rank(computed)
    return (
        F.when(configured == computed, "unchanged").when(b > a, "worse").when(b < a, "better").otherwise("changed")
    )


def source_health(
    feeds: DataFrame,
    items: DataFrame,
    records: DataFrame,
    today: str | None = None,
    window_days: int = 14,
    length: Column | None = None,
) -> DataFrame:
    """Health of every configured feed over a window of runs."""
    if today is not None:
        items = window_of(items, today, window_days)
        records = window_of(records, today, window_days)
    metrics = merge_enrich_rates(feed_metrics(items, length), enrich_rates(records))
    metrics = metrics.join(last_nonempty_date(items), "source", "left")
    known = feeds.select(
        F.col("name"), F.coalesce(F.col("health"), F.lit("active")).alias("health")
    ).where(F.coalesce(F.col("name"), F.lit("")) != "")
    joined = known.join(metrics, known["name"] == metrics["source"], "left").drop("source")
    n = F.coalesce(F.col("items"), F.lit(0))
    median = F.coalesce(F.col("median_chars"), F.lit(0))
    fallback, http_error = F.col("normalizer_fallback_rate"), F.col("http_error_rate")
    found = computed_health(F.col("health"), n, median, fallback, http_error)
    notes = observations(F.col("health"), n, median, fallback, http_error, F.col("paywall_rate"), window_days)
    return joined.select(
        "name",
        "health",
        found.alias("computed_health"),
        n.cast("bigint").alias("items"),
        median.cast("bigint").alias("median_chars"),
        F.bround(F.coalesce(F.col("empty_rate"), F.lit(0.0)), 2).alias("empty_rate"),
        F.bround("success_rate", 2).alias("enrichment_success_rate"),
        F.bround("normalizer_fallback_rate", 2).alias("normalizer_fallback_rate"),
        "last_nonempty_date",
        status_transition(F.col("health"), found).alias("status_transition"),
        notes.alias("observations"),
    )


def resolve_strategy(enrich: Column) -> Column:
    """Strategy of a feed for reports: named, else from its switches."""
    named = F.when(F.coalesce(enrich["strategy"], F.lit("")) != "", enrich["strategy"])
    cookies = F.coalesce(enrich["cookies_file"], F.lit("")) != ""
    return F.coalesce(
        named,
        F.when(enrich["skip"], "skip")
        .when(enrich["fetch_article"] & cookies, "fetch_with_cookies")
        .when(enrich["fetch_article"], "fetch")
        .otherwise("auto"),
    )


def recommend_action(
    items: Column,
    median: Column,
    empty_rate: Column,
    paywall_rate: Column,
    mode: Column,
    strategy: Column,
    has_cookies: Column,
    title_only_ok: Column,
    browser_failure_rate: Column,
) -> Column:
    """Suggested change of a feed's configuration; the first rule that fits."""
    return (
        F.when(
            (strategy == "browser_fetch") & (browser_failure_rate >= 0.8),
            "browser_fetch failing; revise wait/policy",
        )
        .when((strategy == "skip") & title_only_ok, "ok (title/teaser-only accepted)")
        .when((strategy == "skip") & ((median < 80) | (empty_rate > 0)), "define skip policy or retire")
        .when(strategy == "skip", "ok (intentionally skipped)")
        .when((paywall_rate >= 0.8) & has_cookies, "refresh cookies (paywall rate high)")
        .when(paywall_rate >= 0.8, 'strategy: "skip"')
        .when(
            strategy.isin("fetch", "fetch_with_cookies") & (paywall_rate.isNull() | (paywall_rate < 0.3)),
            "ok (enrichment working)",
        )
        .when((median == 0) & (mode == "html_index"), 'strategy: "fetch"')
        .when((median < 200) | (empty_rate > 0.2), 'strategy: "fetch"')
        .when(items == 0, "retire feed")
        .otherwise("ok")
    )


def feed_recommendations(metrics: DataFrame, feeds: DataFrame) -> DataFrame:
    """Metrics per feed with its configuration and the suggested action."""
    enrich = F.col("enrich")
    dims = feeds.select(
        F.col("name").alias("source"),
        F.coalesce(F.col("mode"), F.lit("rss")).alias("mode"),
        F.coalesce(F.col("health"), F.lit("active")).alias("health"),
        resolve_strategy(enrich).alias("strategy"),
        (F.coalesce(enrich["cookies_file"], F.lit("")) != "").alias("_cookies"),
        F.coalesce(enrich["title_only_ok"], F.lit(False)).alias("_title_ok"),
        F.coalesce(
            F.when(enrich["skip_reason"] != "", enrich["skip_reason"]),
            F.when(enrich["title_only_ok"], F.lit("title_only_ok")),
            F.lit(""),
        ).alias("policy"),
    )
    out = metrics.join(dims, "source", "left").fillna(
        {"mode": "rss", "health": "active", "strategy": "auto", "policy": "", "_cookies": False, "_title_ok": False}
    )
    action = recommend_action(
        F.col("items"),
        F.col("median_chars"),
        F.col("empty_rate"),
        F.col("paywall_rate"),
        F.col("mode"),
        F.col("strategy"),
        F.col("_cookies"),
        F.col("_title_ok"),
        F.col("browser_failure_rate"),
    )
    return out.withColumn("recommend", action).drop("_cookies", "_title_ok")


def audit_lines(recommended: DataFrame) -> DataFrame:
    """One table row of text per feed, shortest median first."""
    cells = [
        F.col("source"),
        F.col("items").cast("string"),
        F.col("median_chars").cast("string"),
        percent(F.col("empty_rate")),
        percent(F.col("paywall_rate")),
        percent(F.col("http_error_rate")),
        percent(F.col("browser_failure_rate")),
        percent(F.col("normalizer_fallback_rate")),
        F.col("mode"),
        F.col("strategy"),
        F.col("health"),
        F.col("policy"),
        F.col("recommend"),
    ]
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return recommended.select("median_chars", "source", text.alias("line")).orderBy("median_chars", "source")


def health_lines(report: DataFrame) -> DataFrame:
    """One table row of text per feed, by name."""
    notes = F.when(F.size("observations") > 0, F.array_join("observations", "; ")).otherwise("—")
    cells = [
        F.col("name"),
        F.col("health"),
        F.col("computed_health"),
        F.col("status_transition"),
        F.col("items").cast("string"),
        F.col("median_chars").cast("string"),
        F.coalesce(F.col("last_nonempty_date").cast("string"), F.lit("never")),
        notes,
    ]
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return report.select("name", text.alias("line")).orderBy("name")


def feed_checks(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """Per feed: usable or not, entry count, newest date.

    ``entries`` has one row per landed entry (feed, title, published). Feeds
    without entries fail, and so do feeds of which no entry has a title.
    """
    from newsloom.functions.text import py_strip

    titled = py_strip(F.coalesce(F.col("title"), F.lit(""))) != ""
    seen = entries.groupBy(F.col("feed").alias("name")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(titled).alias("_titled"),
        F.max("published").alias("latest"),
    )
    error = (
        F.when(F.col("entries").isNull(), "No entries found")
        .when(F.col("_titled") == 0, "No entries with titles")
        .otherwise("")
    )
    out = feeds.join(seen, "name", "left").withColumn("error", error)
    return (
        out.withColumn("entries", F.coalesce(F.col("entries"), F.lit(0)).cast("bigint"))
        .withColumn("status", F.when(F.col("error") == "", "OK").otherwise("FAIL"))
        .withColumn("latest", F.when(F.col("error") == "", F.col("latest")))
        .drop("_titled")
    )


def is_recent(latest: Column, now: Column, days: int = 7) -> Column:
    return F.coalesce(latest >= now - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(False))


def new_feed_errors(checked: DataFrame, categories: Sequence[str], now: Column) -> DataFrame:
    """Rules a new feed breaks, as an ordered array ``errors``."""
    cat = F.coalesce(F.col("category"), F.lit(""))
    health = F.coalesce(F.col("health"), F.lit(""))
    errors = F.array_compact(
        F.array(
            F.when(cat == "", "missing category").when(
                ~cat.isin(list(categories)), F.format_string("category '%s' not routed to any desk", cat)
            ),
            F.when(health == "", "missing health field").when(
                ~health.isin(HEALTHS), F.format_string("invalid health '%s'", health)
            ),
            F.when(
                (F.col("status") == "OK")
                & ~health.isin("low_frequency", "headline_radar")
                & ~is_recent(F.col("latest"), now),
                "no item dated within the last 7 days",
            ),
        )
    )
    return checked.withColumn("errors", errors)
