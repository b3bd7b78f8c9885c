"""Desks: configuration, routing of items and transcripts, text packs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.bands import fixed
from newsloom.functions.text import sanitize
from newsloom.operators.metrics import text_pack

# Older names of desks.
DESK_ALIASES = {"geopolitics": "geopolitics_events"}

DESK_DDL = "desk string, desk_pos int, categories array<string>, channels array<string>"


def resolve_desks(
    desks: Mapping[str, Mapping[str, Sequence[str]]], manifest: Sequence[Mapping] | None = None
) -> list[tuple[str, int, list[str], list[str]]]:
    """Desks in use: the manifest's, with its categories where it names some.

    ``desks`` gives ``categories`` and ``channels`` by name. Unknown names of the
    manifest are left out; without any known one all desks are in use.
    """
    chosen: dict[str, tuple[list[str], list[str]]] = {}
    for entry in manifest or []:
        if not isinstance(entry, Mapping):
            continue
        name = DESK_ALIASES.get(entry.get("name"), entry.get("name"))
        if name in desks:
            own = entry.get("categories")
            chosen[name] = (list(desks[name]["categories"] if own is None else own), list(desks[name].get("channels", [])))
    if not chosen:
        chosen = {name: (list(d["categories"]), list(d.get("channels", []))) for name, d in desks.items()}
    return [(name, i, cats, channels) for i, (name, (cats, channels)) in enumerate(chosen.items())]


def desk_table(
    spark: SparkSession, desks: Mapping[str, Mapping[str, Sequence[str]]], manifest: Sequence[Mapping] | None = None
) -> DataFrame:
    return spark.createDataFrame(resolve_desks(desks, manifest), DESK_DDL)


def route_items(items: DataFrame, desks: DataFrame) -> DataFrame:
    """Items per desk by category; headline-only sources are left out.

    An item goes to every desk that lists its category. The desk table is
    configuration: one row per desk and category.
    """
    wanted = desks.select("desk", "desk_pos", F.explode("categories").alias("category"))
    usable = items.where(~F.col("analysis_mode").eqNullSafe("headline_radar"))
    return usable.join(wanted, "category", "inner")


def route_transcripts(transcripts: DataFrame, desks: DataFrame) -> DataFrame:
    """Transcripts per desk by channel; a channel may feed several desks."""
    wanted = desks.select("desk", "desk_pos", F.explode("channels").alias("channel"))
    return transcripts.join(wanted, "channel", "inner")


def unrouted_categories(items: DataFrame, desks: DataFrame) -> DataFrame:
    """Categories in use that no desk lists."""
    wanted = desks.select(F.explode("categories").alias("category")).distinct()
    used = items.select("category").where(F.coalesce("category", F.lit("")) != "").distinct()
    return used.join(wanted, "category", "left_anti")


def item_block(cap: int = 600) -> Column:
    """Text of one item in a desk pack."""
    mark = F.when(F.coalesce("reliability", F.lit("")) != "", F.concat(F.lit(" ["), F.col("reliability"), F.lit("]")))
    return F.concat(
        F.lit("SOURCE: "),
        F.col("source"),
        F.coalesce(mark, F.lit("")),
        F.lit(" | "),
        F.coalesce(F.substring(F.col("published").cast("string"), 1, 10), F.lit("")),
        F.lit("\nCATEGORY: "),
        F.coalesce("category", F.lit("")),
        F.lit("\nTITLE: "),
        F.coalesce("title", F.lit("")),
        F.lit("\nURL: "),
        F.coalesce("url", F.lit("")),
        F.lit("\nSUMMARY: "),
        sanitize(F.coalesce("summary", F.lit("")), cap),
        F.lit("\n"),
    )


def transcript_block(cap: int = 3000) -> Column:
    body = F.coalesce(
        F.when(F.col("compressed_transcript") != "", F.col("compressed_transcript")), F.col("transcript"), F.lit("")
    )
    return F.concat(
        F.lit("CHANNEL: "),
        F.col("channel"),
        F.lit(" [analysis-opinion]\nTITLE: "),
        F.col("title"),
        F.lit("\nSUMMARY:\n"),
        sanitize(body, cap),
        F.lit("\n"),
    )


def quote_line() -> Column:
    """One line per quote with its signed change."""
    change = F.coalesce("change_pct", F.lit(0.0))
    sign = F.when(change >= 0, "+").otherwise("")
    price = F.coalesce(F.col("price").cast("string"), F.lit("?"))
    return F.concat(
        F.lit("  "),
        F.coalesce("label", "symbol", F.lit("?")),
        F.lit(": $"),
        price,
        F.lit(" ("),
        sign,
        fixed(change),
        F.lit("%)"),
    )


def desk_pack(routed: DataFrame, most: int) -> DataFrame:
    """Text per run and desk: its items in order, blocks ruled off."""
    return text_pack(routed, ["run_date", "desk"], item_block(), most, joiner="\n---\n")


def category_pack(items: DataFrame, most: int = 8, cap: int = 320) -> DataFrame:
    """Text per run and category: the count, then the first items."""
    mark = F.when(F.coalesce("reliability", F.lit("")) != "", F.concat(F.lit(" ["), F.col("reliability"), F.lit("]")))
    line = F.concat(
        F.lit("  "),
        F.coalesce("source", F.lit("?")),
        F.coalesce(mark, F.lit("")),
        F.lit(": "),
        F.coalesce("title", F.lit("?")),
        F.lit(" — "),
        sanitize(F.coalesce("summary", F.lit("")), cap),
        F.coalesce(F.when(F.col("url") != "", F.concat(F.lit("\n    URL: "), F.col("url"))), F.lit("")),
    )
    named = items.withColumn("category", F.coalesce("category", F.lit("uncategorized")))
    header = F.concat(
        F.lit("\n--- "), F.upper("category"), F.lit(" ("), F.col("items").cast("string"), F.lit(" items) ---")
    )
    return text_pack(named, ["run_date", "category"], line, most, header)


# Outcomes of a research fetch that can be used.
USABLE_RESEARCH = [
    "ok",
    "normalizer_fallback",
    "llm_failed",
    "cache_hit:ok",
    "cache_hit:normalizer_fallback",
    "cache_hit:llm_failed",
]


def successful_research(results: DataFrame) -> DataFrame:
    """Usable research results; group by (run_date, desk) to read them."""
    return results.where(F.col("status").isin(USABLE_RESEARCH) & (F.coalesce("summary", F.lit("")) != ""))


def research_counts(results: DataFrame) -> DataFrame:
    """Desks that got research and results fetched, per run."""
    good = F.col("status").isin(USABLE_RESEARCH) & (F.coalesce("summary", F.lit("")) != "")
    return results.groupBy("run_date").agg(
        F.count_distinct(F.when(good, F.col("desk"))).alias("fired"),
        F.count(F.lit(1)).alias("articles_fetched"),
        F.bool_or(good).alias("changed_output"),
    )


def request_rows(raw: DataFrame, routed: DataFrame) -> DataFrame:
    """Research requests of desks as rows, checked against the desk's items.

    ``raw`` has run_date, desk, desk_pos, idx and the request as JSON text.
    """
    from newsloom.functions.text import py_strip
    from newsloom.operators.contracts import as_text, field, is_object

    v = F.try_parse_json("request")
    priority = F.lower(py_strip(as_text(field(v, "priority"), "medium")))
    rows = raw.select(
        "run_date",
        "desk",
        "desk_pos",
        "idx",
        is_object(v).alias("_object"),
        py_strip(as_text(field(v, "url"))).alias("url"),
        F.substring(as_text(field(v, "claim")), 1, 300).alias("claim"),
        F.substring(as_text(field(v, "reason")), 1, 300).alias("reason"),
        F.substring(as_text(field(v, "expected_use")), 1, 300).alias("expected_use"),
        F.when(priority.isin("high", "medium", "low"), priority).otherwise("medium").alias("priority"),
    )
    known = (
        routed.where(F.coalesce("url", F.lit("")) != "")
        .groupBy("run_date", "desk", "url")
        .agg(F.max_by(F.struct("source", "title"), "pos").alias("_item"))
    )
    out = rows.join(known, ["run_date", "desk", "url"], "left")
    unknown = (F.col("url") == "") | F.col("_item").isNull()
    status = F.when(~F.col("_object"), "rejected_malformed").when(unknown, "rejected_unknown_url").otherwise("selected")
    chosen = status == "selected"
    return out.select(
        "run_date",
        "desk",
        "desk_pos",
        "idx",
        F.when(F.col("_object"), F.col("url")).otherwise("").alias("url"),
        F.when(chosen, F.col("_item.source")).otherwise("").alias("source"),
        F.when(chosen, F.col("_item.title")).otherwise("").alias("title"),
        F.when(F.col("_object"), F.col("claim")).otherwise("").alias("claim"),
        F.when(F.col("_object"), F.col("reason")).otherwise("").alias("reason"),
        F.when(chosen, F.col("priority")).otherwise("medium").alias("priority"),
        F.when(chosen, F.col("expected_use")).otherwise("").alias("expected_use"),
        status.alias("status"),
    )
