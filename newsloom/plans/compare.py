"""Scores of model runs and checks of finished editions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.bands import cost, fixed
from newsloom.operators.tags import TAG_LABELS

KEY = ["run_date", "model"]


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost per run and model.

    ``prices``: model, input_per_m, output_per_m (one row per model).
    """
    sums = calls.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("llm_calls"),
        F.sum("tokens_in").alias("_in"),
        F.sum("tokens_out").alias("_out"),
    )
    priced = sums.join(prices, "model", "left")
    usd = F.coalesce(cost(F.col("_in"), F.col("_out"), F.col("input_per_m"), F.col("output_per_m")), F.lit(0.0))
    return priced.select(
        *KEY,
        "llm_calls",
        F.bround(F.col("_in") / 1000, 1).alias("input_k_tokens"),
        F.bround(F.col("_out") / 1000, 1).alias("output_k_tokens"),
        usd.alias("cost_usd"),
        F.concat(F.lit("$"), fixed(usd, 4)).alias("est_cost_usd"),
    )


def _score(*penalties: tuple[Column, int]) -> Column:
    total = F.lit(100)
    for cond, points in penalties:
        total = total - F.when(cond, points).otherwise(0)
    return F.greatest(F.lit(0), total)


def score_compression(pairs: DataFrame) -> DataFrame:
    """Scores from (run, model, transcript, compressed_transcript) rows."""
    from newsloom.functions.text import py_strip, words

    out = py_strip(F.coalesce("compressed_transcript", F.lit("")))
    n_in = F.greatest(F.lit(1), F.size(words(F.coalesce("transcript", F.lit("")))))
    agg = pairs.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("transcripts"),
        F.count_if(out != "").alias("nonempty_outputs"),
        F.bround(F.avg(F.size(words(out)) / n_in), 3).alias("avg_compression_ratio"),
    )
    ratio = F.col("avg_compression_ratio")
    score = _score(
        (F.col("nonempty_outputs") < F.col("transcripts"), 30),
        ((ratio != 0) & ((ratio < 0.05) | (ratio > 0.65)), 15),
    )
    return agg.withColumn("quality_score", score)


def score_desks(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Scores of desk analysis.

    ``items``: run, model, desk, analysis; ``runs``: run, model, source_count,
    failures, contract_issues, one row each.
    """
    text = F.trim(F.coalesce("analysis", F.lit("")))
    agg = items.groupBy(*KEY).agg(
        F.count_distinct("desk").alias("domains_with_items"),
        F.count(F.lit(1)).alias("total_items"),
        F.bround(F.avg(text.startswith("My read:").cast("double")), 2).alias("my_read_pct"),
        F.bround(F.avg(F.contains(F.lower(text), F.lit("watch for")).cast("double")), 2).alias("watch_for_pct"),
    )
    out = runs.join(agg, KEY, "left").fillna(
        0, subset=["domains_with_items", "total_items", "my_read_pct", "watch_for_pct"]
    )
    score = _score(
        (F.col("domains_with_items") < 4, 20),
        (F.col("my_read_pct") < 1.0, 20),
        (F.col("watch_for_pct") < 0.75, 10),
        (F.col("failures") > 0, 20),
        (F.col("contract_issues") > 0, 15),
    )
    share = F.col("total_items") / F.when(F.col("source_count") > 0, F.col("source_count"))
    return out.withColumn("coverage_vs_rss", F.coalesce(F.bround(share, 2), F.lit(0.0))).withColumn("quality_score", score)


def score_seams(runs: DataFrame) -> DataFrame:
    """``runs``: run, model, per_item, cross_domain (counts), quiet_day."""
    nothing = (F.col("per_item") == 0) & (F.col("cross_domain") == 0) & ~F.col("quiet_day")
    return runs.withColumn("quality_score", _score((nothing, 30)))


def score_editions(runs: DataFrame) -> DataFrame:
    """``runs``: counts per run and model of the finished edition."""
    score = F.when(F.col("at_a_glance") == 0, 0).otherwise(100)
    for cond, points in (
        (F.col("invalid_tags") > 0, 20),
        (F.col("deep_dives") > 3, 10),
        (F.col("validation_issues") > 0, 20),
        (F.col("contract_issues") > 0, 15),
    ):
        score = score - F.when(cond, points).otherwise(0)
    return runs.withColumn("quality_score", F.greatest(F.lit(0), score))


def score_enrichment(runs: DataFrame) -> DataFrame:
    """``runs``: items, records (counts) per run and model."""
    score = F.when(F.col("items") == 0, 0).when(F.col("records") == 0, 70).otherwise(100)
    return runs.withColumn("quality_score", score)


def score_weekly(runs: DataFrame) -> DataFrame:
    """``runs``: daily_foci, sequence_days (counts), missing_guide."""
    score = (
        F.when(F.col("missing_guide"), 0)
        .when(F.col("daily_foci") == 0, 50)
        .when(F.col("sequence_days") < 5, 85)
        .otherwise(100)
    )
    return runs.withColumn("quality_score", score)


def score_reflection(runs: DataFrame) -> DataFrame:
    """``runs``: reflection, scripture_text."""
    from newsloom.functions.text import py_strip, words

    text = py_strip(F.coalesce("reflection", F.lit("")))
    n = F.size(words(text))
    copied = text == py_strip(F.coalesce("scripture_text", F.lit("")))
    length = F.when((n < 60) | (n > 170), 15).otherwise(0)
    score = F.when(text == "", 0).otherwise(100 - F.when(copied, 30).otherwise(0) - length)
    return runs.withColumns({"reflection_words": n, "used_scripture_fallback": copied, "quality_score": score})


# Scorer per stage; add your own under its name.
SCORERS: dict[str, Callable[..., DataFrame]] = {
    "enrich_articles": score_enrichment,
    "compress": score_compression,
    "analyze_domain": score_desks,
    "prepare_spiritual_weekly": score_weekly,
    "prepare_spiritual": score_reflection,
    "seams": score_seams,
    "cross_domain": score_editions,
}


def rank_models(scores: DataFrame, costs: DataFrame) -> DataFrame:
    """Models of a run by score, then by cost."""
    from newsloom.operators.ranking import running

    both = scores.join(costs, KEY, "left")
    order = [F.desc("quality_score"), F.col("cost_usd").asc_nulls_last(), "model"]
    return running(both, ["run_date"], {"_b_score": -F.col("quality_score")}, order, {"rank": F.lit(1)})


# Tags and bridges that the structure check knows.
CHECKED_TAGS = ["war", "domestic", "econ", "ai", "tech", "defense", "space", "cyber"]


def edition_structure(glance: DataFrame, dives: DataFrame, reading: DataFrame, connections: DataFrame) -> DataFrame:
    """Counts and checks of an edition, one row per run."""
    labels = F.create_map(*[F.lit(x) for t in CHECKED_TAGS for x in (t, TAG_LABELS[t])])
    tag = F.col("tag")
    short = glance.groupBy("run_date").agg(
        F.count(F.lit(1)).alias("at_a_glance_count"),
        F.count_if(~F.coalesce(tag.isin(CHECKED_TAGS), F.lit(False))).alias("invalid_tags"),
        F.count_if(tag.isin(CHECKED_TAGS) & ~labels[tag].eqNullSafe(F.col("tag_label"))).alias("mismatched_tag_labels"),
        F.min(F.when(F.col("source_depth") == "widely-reported", F.col("pos"))).alias("_wide"),
        F.min(F.when(F.col("source_depth") == "single-source", F.col("pos"))).alias("_single"),
        F.sum(F.size("links")).alias("_urls"),
        F.sum(F.size(F.filter("links", lambda x: (x["url"] != "") & ~x["url"].startswith("http")))).alias("_odd"),
    )
    body = F.coalesce("body", F.lit(""))
    low = F.lower(body)
    long = dives.groupBy("run_date").agg(
        F.count(F.lit(1)).alias("deep_dive_count"),
        F.bool_and(F.contains(body, F.lit("<p>"))).alias("dives_have_html"),
        F.bool_and(~low.rlike("<h[1-6]")).alias("dives_no_headings"),
        F.bool_or(low.rlike("cross-domain|connects|across")).alias("dives_reference_cross_domain"),
        F.sum(F.size("further_reading")).alias("_urls2"),
        F.sum(F.size(F.filter("further_reading", lambda x: (x["url"] != "") & ~x["url"].startswith("http")))).alias("_odd2"),
    )
    read = reading.groupBy("run_date").agg(
        F.count(F.lit(1)).alias("worth_reading_count"),
        F.bool_and(F.coalesce("url", F.lit("")).startswith("http")).alias("worth_reading_has_urls"),
        F.count_if(F.coalesce("url", F.lit("")) != "").alias("_urls3"),
    )

    def has(*names: str) -> Column:
        return F.arrays_overlap("domains", F.array(*[F.lit(n) for n in names]))

    links = connections.groupBy("run_date").agg(
        F.count(F.lit(1)).alias("connection_count"),
        F.bool_and(F.size("domains") >= 2).alias("connections_have_domains"),
        F.bool_or(has("geopolitics") & has("econ")).alias("geopolitics_econ_bridge"),
        F.bool_or(has("defense_space", "defense") & has("ai_tech", "ai")).alias("defense_ai_bridge"),
        F.bool_or(has("econ", "economy") & has("defense_space", "defense")).alias("econ_defense_bridge"),
    )
    out = short
    for part in (long, read, links):
        out = out.join(part, "run_date", "full")
    zero = F.lit(0)
    return (
        out.withColumns(
            {
                "at_a_glance_capped": F.coalesce("at_a_glance_count", zero) <= 12,
                "deep_dives_in_range": F.coalesce("deep_dive_count", zero) <= 3,
                "total_urls": F.coalesce("_urls", zero) + F.coalesce("_urls2", zero) + F.coalesce("_urls3", zero),
                "urls_start_with_http": (F.coalesce("_odd", zero) + F.coalesce("_odd2", zero)) == 0,
                "ordering_widely_before_single": F.coalesce(F.col("_wide") < F.col("_single"), F.lit(False)),
            }
        )
        .drop("_urls", "_urls2", "_urls3", "_odd", "_odd2", "_wide", "_single")
    )


# Wording that gives away a framing, per question and side.
FRAMING = {
    "china_taiwan_framing": {
        "neutral": ["both sides", "cross-strait", "regional stability", "sovereignty"],
        "us_aligned": ["Chinese aggression", "provocation", "threat to Taiwan", "coercion"],
        "china_aligned": ["reunification", "internal affair", "US provocation", "interference"],
    },
    "russia_sanctions_framing": {
        "skeptical": ["symbolic", "intermediaries", "limited impact", "evasion"],
        "supportive": ["weakening", "pressure", "effective", "degradation"],
        "neutral": ["mixed results", "complex", "depends on", "uncertain"],
    },
    "india_acknowledged": {
        "acknowledged": ["India", "New Delhi", "regional player", "supply chain diversification"],
    },
    "ai_framing": {
        "skeptical": ["benchmark", "cautiously", "interpret", "doesn't always"],
        "enthusiastic": ["breakthrough", "revolutionary", "transformative", "unprecedented"],
        "balanced": ["significant", "practical", "workflow", "context window"],
    },
    "non_western_sources": {
        "al jazeera": ["al jazeera"],
        "dawn": ["dawn"],
        "the hindu": ["the hindu"],
        "scmp": ["scmp"],
        "nikkei": ["nikkei"],
    },
    "attribution": {
        "my_read": ["my read:"],
        "source": ["reports", "according to", "notes that"],
    },
}


# Questions whose wording is compared in lower case.
LOWERED = ["india_acknowledged"]


def framing_flags(texts: DataFrame, text: str = "text", key: str = "run_date") -> DataFrame:
    """Question, side and whether a text of the run uses its wording.

    Texts are lowered, wording is not, so wording with capitals never counts;
    only that of ``LOWERED`` questions is lowered too.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))

    def used(question: str, words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w.lower() if question in LOWERED else w))
        return out

    tests = [(q, side, used(q, words)) for q, sides in FRAMING.items() for side, words in sides.items()]
    flags = texts.groupBy(key).agg(*[F.bool_or(c).alias(f"_{i}") for i, (_, _, c) in enumerate(tests)])
    rows = F.array(
        *[
            F.struct(F.lit(q).alias("question"), F.lit(side).alias("side"), F.col(f"_{i}").alias("used"))
            for i, (q, side, _) in enumerate(tests)
        ]
    )
    return flags.select(key, F.explode(rows).alias("r")).select(key, "r.*")
