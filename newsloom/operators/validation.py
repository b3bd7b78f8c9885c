"""Validation of nested edition records against known URLs and vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import keep_allowed_tags, py_strip
from newsloom.functions.urls import netloc
from newsloom.operators.joins import HOT_ROWS, hot_join, key_counts, mark_known
from newsloom.operators.links import drop_blank_links
from newsloom.operators.tags import tag_label, valid_tag


def strip_reasons(links: DataFrame, known: DataFrame, run: str = "run_date", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Why an unknown URL was stripped: its host is known, or not."""
    hosts = (
        known.select(run, F.lower(netloc(F.col("url"))).alias("_host")).where(F.col("_host") != "").distinct()
    ).withColumn("_known_host", F.lit(True))
    # One row per stripped URL decides; the reasons then go back to the links.
    asked = key_counts(links, [run, "url"])
    judged = asked.withColumn("_host", F.lower(netloc(F.col("url")))).join(hosts, [run, "_host"], "left")
    out = hot_join(links, judged.drop("rows"), [run, "url"], "left", asked, hot_rows)
    reason = F.when(F.col("_known_host"), "known_domain_unknown_path").otherwise("unknown_domain")
    return out.withColumn("reason", reason).drop("_host", "_known_host")


def validate_links(
    items: DataFrame,
    known: DataFrame,
    links: str,
    section: str,
    key: Sequence[str] = ("run_date", "pos"),
    run: str = "run_date",
    indexed: bool = True,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(items with unsupported links removed, one issue per stripped URL)."""
    rows = items.select(*key, F.posexplode(links).alias("_at", "_link")).select(
        *key, "_at", "_link", F.col("_link.url").alias("url")
    )
    marked = mark_known(rows, known, run, hot_rows)
    where = f"{section}[%d].{links}[%d].url" if indexed else f"{section}.{links}[%d].url"
    at = [F.col(key[-1]), F.col("_at")] if indexed else [F.col("_at")]
    bad = strip_reasons(marked.where("not known"), known, run, hot_rows)
    issues = bad.select(
        run,
        F.lit("stripped_url").alias("kind"),
        F.format_string(where, *at).alias("path"),
        "url",
        "reason",
        "canonical_url",
    )
    lists = marked.where("known").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", "_link"))).alias("_kept"))
    kind = items.schema[links].dataType.simpleString()
    clean = (
        items.join(lists, list(key), "left")
        .withColumn(links, F.coalesce(F.transform("_kept", lambda x: x["_link"]), F.array().cast(kind)))
        .drop("_kept")
        .withColumn(links, drop_blank_links(F.col(links)))
    )
    return clean, issues


def validate_glance(
    items: DataFrame, known: DataFrame, titles: DataFrame, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Short items with valid tags, labels and links; ``echo`` marks a headline
    that repeats a source title word for word."""
    clean, issues = validate_links(items, known, "links", "at_a_glance", hot_rows=hot_rows)
    tag = valid_tag(F.coalesce(F.col("tag"), F.lit("")))
    given = F.when(F.coalesce(F.col("tag_label"), F.lit("")) != "", F.col("tag_label"))
    clean = (
        clean.withColumn("tag", tag)
        .withColumn("tag_label", F.coalesce(given, tag_label(F.col("tag"))))
        .withColumn("headline", py_strip(F.coalesce(F.col("headline"), F.lit(""))))
        .withColumn("_low", F.lower("headline"))
    )
    seen = titles.select("run_date", F.lower(F.coalesce("title", F.lit(""))).alias("_low")).distinct()
    on = ["run_date", "_low"]
    out = hot_join(clean, seen.withColumn("_echo", F.lit(True)), on, "left", key_counts(clean, on), hot_rows)
    return out.withColumn("echo", F.coalesce(F.col("_echo"), F.lit(False))).drop("_low", "_echo"), issues


def validate_dives(dives: DataFrame, known: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Long reads with allowed markup and supported reading links."""
    clean, issues = validate_links(dives, known, "further_reading", "deep_dives", hot_rows=hot_rows)
    return (
        clean.withColumn("headline", F.coalesce("headline", F.lit("")))
        .withColumn("body", keep_allowed_tags(F.coalesce("body", F.lit(""))))
        .withColumn("why_it_matters", F.coalesce("why_it_matters", F.lit(""))),
        issues,
    )


def validate_seams(
    seams: DataFrame, known: DataFrame, kind: str, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Contested narratives (``contested``) or coverage gaps (``gap``)."""
    clean, issues = validate_links(seams, known, "links", kind, indexed=False, hot_rows=hot_rows)
    extra = ["sources_a", "sources_b"] if kind == "contested" else ["present_in", "absent_from"]
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ["topic", "description", *extra]]
    return clean.select("run_date", "pos", *text, "links"), issues


def validate_urls(
    rows: DataFrame, known: DataFrame, section: str, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Rows with one ``url`` each: an unsupported one is blanked and reported."""
    marked = mark_known(rows, known, hot_rows=hot_rows)
    bad = strip_reasons(marked.where("not known"), known, hot_rows=hot_rows)
    issues = bad.select(
        "run_date",
        F.lit("stripped_url").alias("kind"),
        F.format_string(f"{section}[%d].url", F.col("pos")).alias("path"),
        "url",
        "reason",
        "canonical_url",
    )
    clean = marked.withColumn("url", F.when(F.col("known"), F.col("url")).otherwise("")).drop("known", "canonical_url")
    return clean, issues


def size_warning(count: Column, least: int = 3, most: int = 20) -> Column:
    """Note on an edition with suspiciously few or many short items."""
    return F.when(count < least, F.format_string(f"only %d at_a_glance items (min {least})", count)).when(
        count > most, F.format_string(f"%d at_a_glance items exceeds max {most}", count)
    )
