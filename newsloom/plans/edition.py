"""Building and assembling editions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import display_text, py_strip, strip_markup_pairs, truncate_sentence
from newsloom.operators.joins import HOT_ROWS, best_annotation, join_selection, known_index, link_urls
from newsloom.operators.links import (
    domains_bridged,
    link_domains,
    most_common_outlet,
    prune_links,
    source_depth,
    source_names,
    supporting_links,
    url_desks,
)
from newsloom.operators.phrases import overlap_downgrade
from newsloom.operators.ranking import outlet_cap, top_per_group
from newsloom.operators.selection import diverse_top, primary_coverage
from newsloom.operators.tags import tag_label
from newsloom.operators.validation import validate_urls
from newsloom.session import cut

# Appended items come after every selected one.
_AFTER = 1 << 40


class Edition(NamedTuple):
    glance: DataFrame
    dives: DataFrame
    reading: DataFrame
    downgrades: DataFrame
    overrides: DataFrame


def glance_text(items: DataFrame) -> Column:
    """Words of a short item as compared with the long reads."""
    note = F.coalesce(F.col("cross_domain_note"), F.lit("None"))
    body = py_strip(F.concat_ws(" ", F.coalesce("facts", F.lit("")), F.coalesce("analysis", F.lit("")), note))
    head = F.coalesce("headline", F.lit(""))
    return F.concat_ws(" ", F.when(head != "", head), F.when(body != "", body))


def dive_text() -> Column:
    return F.concat_ws(" ", F.coalesce("headline", F.lit("")), strip_markup_pairs(F.col("body")))


def _label_change(df: DataFrame, section: str, item: Column, domains: Column) -> DataFrame:
    """Rows whose given label differs from the recomputed one."""
    changed = (F.coalesce("_given", F.lit("")) != "") & (F.col("_given") != F.col("source_depth"))
    return df.where(changed).select(
        "run_date",
        F.lit(section).alias("section"),
        "pos",
        item.alias("item_id"),
        F.col("_given").alias("original_depth"),
        F.col("source_depth").alias("recomputed_depth"),
        F.lit(None).cast("string").alias("reason"),
        domains.alias("domains"),
        F.lit(None).cast("bigint").alias("overlap_count"),
        F.lit(None).cast("string").alias("sample_phrase"),
    )


def build_edition(
    selections: DataFrame,
    desk_items: DataFrame,
    dives: DataFrame,
    reading: DataFrame,
    known: DataFrame,
    max_items: int = 7,
    hot_rows: int = HOT_ROWS,
) -> Edition:
    """Selections joined to desk content, checked, relabelled and capped.

    The order matters: links are pruned before coverage (which compares
    links), labels are recomputed before overlap lowers them, and the cap
    comes last.
    """
    known = cut(known_index(known))
    # Pruning reads its items several times, so each table of them is written first.
    joined = cut(prune_links(cut(join_selection(selections, desk_items)), known, hot_rows=hot_rows))
    added = cut(primary_coverage(joined, desk_items))
    added = added.withColumn("pos", F.lit(_AFTER) + F.col("_desk_order")).select(
        *[F.col(c).cast(joined.schema[c].dataType.simpleString()).alias(c) for c in joined.columns if c != "pos"],
        "pos",
    )
    added = prune_links(added, known, hot_rows=hot_rows)
    glance = joined.withColumn("pos", F.col("pos").cast("bigint")).unionByName(added)

    long = cut(prune_links(cut(dives), known, "further_reading", hot_rows=hot_rows))
    bridged = domains_bridged(long, url_desks(desk_items, link_urls(long, "further_reading")), hot_rows=hot_rows)
    long = long.drop("domains_bridged").join(bridged, ["run_date", "pos"], "left")
    long = long.withColumn("domains_bridged", F.coalesce("domains_bridged", F.array().cast("array<string>")))
    read, _ = validate_urls(reading, known, "worth_reading", hot_rows)

    glance = glance.withColumn("_given", F.col("source_depth")).withColumn("source_depth", source_depth(F.col("links")))
    support = supporting_links(F.col("further_reading"), F.col("links")) if "links" in dives.columns else F.col("further_reading")
    long = long.withColumn("_given", F.col("source_depth")).withColumn("source_depth", source_depth(support))
    glance, long = cut(glance), cut(long)
    short_head = F.substring(F.coalesce("headline", F.lit("")), 1, 40)
    downgrades = _label_change(glance, "at_a_glance", F.col("item_id"), link_domains(F.col("links"))).unionByName(
        _label_change(long, "deep_dives", short_head, F.coalesce(link_domains(support), F.array().cast("array<string>")))
    )

    texts = glance.select("run_date", "pos", glance_text(glance).alias("text"))
    lowered = cut(
        overlap_downgrade(long.drop("_given").withColumn("text", dive_text()), texts, hot_rows=hot_rows).drop("text")
    )
    by_words = lowered.where(
        F.col("overlap_count").isNotNull() & (F.col("original_depth") != F.col("source_depth"))
    ).select(
        "run_date",
        F.lit("deep_dives").alias("section"),
        "pos",
        short_head.alias("item_id"),
        "original_depth",
        F.col("source_depth").alias("recomputed_depth"),
        F.lit("phrase_overlap_with_at_a_glance").alias("reason"),
        F.lit(None).cast("array<string>").alias("domains"),
        F.col("overlap_count").cast("bigint").alias("overlap_count"),
        "sample_phrase",
    )
    downgrades = downgrades.unionByName(by_words)

    kinds = downgrades.select(
        "run_date", F.when(F.col("reason").isNull(), "recompute_source_depth").otherwise("overlap_downgrade").alias("override")
    ).unionByName(added.select("run_date", F.lit("ensure_primary_glance_coverage").alias("override")))
    overrides = kinds.groupBy("run_date", "override").agg(F.count(F.lit(1)).alias("count"))

    named = glance.drop("_given").withColumn("sources", source_names(F.col("links")))
    capped = diverse_top(named, max_items).drop("sources")
    final = lowered.drop("original_depth", "overlap_count", "sample_phrase")
    return Edition(capped, final, read, downgrades, overrides)


def passthrough_edition(desk_items: DataFrame, most_dives: int = 3) -> tuple[DataFrame, DataFrame]:
    """(glance, dives) straight from desk items, when there is no synthesis."""
    dive = F.coalesce("deep_dive_candidate", F.lit(False))
    glance = desk_items.where(~dive)

    def part(c: str, before: str, after: str) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), F.col(c), F.lit(after)))

    first = top_per_group(desk_items.where(dive), ["run_date"], ["desk_pos", "pos"], most_dives, "rank")
    dives = first.select(
        "run_date",
        F.col("rank").alias("pos"),
        F.coalesce("headline", F.lit("")).alias("headline"),
        F.concat_ws(
            "\n",
            part("facts", "<p>", "</p>"),
            part("analysis", "<p>", "</p>"),
            part("deep_dive_rationale", "<p><em>Why this matters: ", "</em></p>"),
        ).alias("body"),
        F.col("links").alias("further_reading"),
        F.coalesce("source_depth", F.lit("")).alias("source_depth"),
        F.array().cast("array<string>").alias("domains_bridged"),
    )
    return glance, dives


def glance_items(items: DataFrame) -> DataFrame:
    """Short items as shown: label, and the texts run together."""
    given = F.when(F.coalesce("tag_label", F.lit("")) != "", F.col("tag_label"))
    return items.withColumn("tag_label", F.coalesce(given, tag_label(F.col("tag")))).withColumn(
        "context", display_text(F.col("facts"), F.col("analysis"), F.col("cross_domain_note"))
    )


def attach_annotations(glance: DataFrame, annotations: DataFrame) -> DataFrame:
    """Short items with their best annotation, cut to one line."""
    best = best_annotation(annotations).select(
        "run_date",
        py_strip("item_id").alias("item_id"),
        F.struct(
            truncate_sentence(F.col("one_line")).alias("one_line"), F.col("seam_type"), F.col("confidence")
        ).alias("seam_annotation"),
    )
    return glance.join(best, ["run_date", "item_id"], "left")


def assemble_edition(
    glance: DataFrame, dives: DataFrame, annotations: DataFrame, per_glance: int = 2, per_dive: int = 1
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(glance, dives, diagnostics) with caps per outlet and annotations."""
    short = glance_items(glance).withColumn("outlet", most_common_outlet(F.col("links")))
    support = supporting_links(F.col("links"), F.col("further_reading")) if "links" in dives.columns else F.col("further_reading")
    long = dives.withColumn("outlet", most_common_outlet(support))
    kept, lost = outlet_cap(short, ["run_date"], "outlet", per_glance)
    kept_long, lost_long = outlet_cap(long, ["run_date"], "outlet", per_dive)

    def note(df: DataFrame, section: str, most: int) -> DataFrame:
        return df.select(
            "run_date",
            F.lit("source_cap_enforced").alias("kind"),
            F.lit(section).alias("section"),
            "outlet",
            F.lit(most).alias("max_per_outlet"),
            F.coalesce("headline", F.lit("")).alias("headline"),
            F.lit("per_outlet_cap_exceeded").alias("reason"),
        )

    diagnostics = note(lost, "at-a-glance", per_glance).unionByName(note(lost_long, "deep-dive", per_dive))
    return attach_annotations(kept.drop("outlet"), annotations), kept_long.drop("outlet"), diagnostics
