"""Collecting landed feeds into items with diagnostics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.bands import rounded
from newsloom.functions.text import sanitize, sanitize_title
from newsloom.operators.joins import key_counts
from newsloom.operators.ranking import circuit_breaker
from newsloom.sources.feeds import feed_items
from newsloom.sources.markup import index_items


def usable_fetches(fetches: DataFrame, limit: int = 5) -> DataFrame:
    """Fetches that are looked at: not broken, and before the breaker opens.

    ``fetches``: run_date, pos, source, health, skipped, status_code, payload.
    Broken and cooling feeds neither count as failures nor end a row of them.
    """
    counted = (F.col("health") != "broken") & ~F.coalesce("skipped", F.lit(False))
    failed = counted & F.col("payload").isNull()
    done = circuit_breaker(fetches, ["run_date"], failed, counted & F.col("payload").isNotNull(), limit)
    return done.where(counted)


def fetch_status(items: Column) -> Column:
    return (
        F.when(F.col("health") == "broken", "skipped_broken")
        .when(F.coalesce("skipped", F.lit(False)), "skipped_cooldown")
        .when(F.col("payload").isNull(), "http_error")
        .when(items > 0, "ok")
        .otherwise("empty")
    )


def collect_items(
    fetches: DataFrame,
    entries: DataFrame,
    now: Column,
    caps: Mapping[str, int] | None = None,
    limit: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """(items, one diagnostic row per feed).

    ``fetches`` holds what was landed per feed and run (mode ``rss`` or
    ``html_index``); ``entries`` the parsed entries of its feed documents.
    Feeds after the breaker opened give neither items nor diagnostics.
    """
    used = usable_fetches(fetches, limit)
    meta = used.where("mode <> 'html_index'").select("run_date", "source", "category", "tag")
    rss = feed_items(entries.drop("category", "tag").join(meta, ["run_date", "source"], "inner"), now, caps)
    pages = used.where("mode = 'html_index' and payload is not null").select(
        "run_date", "source", "url", F.col("payload").alias("html"), now.alias("fetched_at"), "category", "tag"
    )
    items = rss.unionByName(index_items(pages, dict(caps or {})).select(*rss.columns))
    counts = items.groupBy("run_date", "source").agg(F.count(F.lit(1)).alias("item_count"))
    skipped = (F.col("health") == "broken") | F.coalesce("skipped", F.lit(False))
    seen = used.unionByName(_before_breaker(fetches, limit).where(skipped))
    report = seen.join(counts, ["run_date", "source"], "left").withColumn(
        "item_count", F.coalesce("item_count", F.lit(0))
    )
    diagnostics = report.select(
        "run_date", "source", "url", "mode", fetch_status(F.col("item_count")).alias("status"), "status_code", "item_count"
    )
    return items, diagnostics


def _before_breaker(fetches: DataFrame, limit: int) -> DataFrame:
    counted = (F.col("health") != "broken") & ~F.coalesce("skipped", F.lit(False))
    failed = counted & F.col("payload").isNull()
    return circuit_breaker(fetches, ["run_date"], failed, counted & F.col("payload").isNotNull(), limit)


def sanitize_items(items: DataFrame, cap: int = 500) -> DataFrame:
    """Items with cleaned titles and bounded, cleaned summaries."""
    return items.withColumn("summary", sanitize(F.col("summary"), cap)).withColumn("title", sanitize_title(F.col("title")))


def recent_transcripts(transcripts: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Transcripts of the last two days; undated ones are left out."""
    return transcripts.where(F.col("published") >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def source_diagnostics(sources: DataFrame) -> DataFrame:
    """Status per source task: ok, ok_empty, degraded or failed.

    ``sources``: run_date, source, item_count, failed, reported (a status the
    source gave itself), elapsed_seconds.
    """
    status = (
        F.when(F.col("failed"), "failed")
        .when(F.coalesce("reported", F.lit("")) != "", F.col("reported"))
        .otherwise("ok")
    )
    return sources.select(
        "run_date",
        "source",
        status.alias("status"),
        F.when(~F.col("failed"), F.col("item_count")).alias("item_count"),
        rounded(F.col("elapsed_seconds"), 2).alias("elapsed_seconds"),
    )


def items_per_source(items: DataFrame) -> DataFrame:
    return key_counts(items, ["run_date", "source"])
