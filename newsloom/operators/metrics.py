"""Feed metrics, enrichment rates, tier outcomes, usage totals.

Medians and percentiles come from a histogram of lengths: the first
aggregation combines map-side and leaves one row per (source, length), so a
source with a third of all items costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _truncate(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("bigint")


def _length_stats(hist: DataFrame, group: Sequence[str], prefix: str) -> DataFrame:
    """Count, mean, median, p10 from (group, length, n) rows."""
    run = Window.partitionBy(*group).orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    h = hist.withColumns({"_upto": F.sum("n").over(run), "_all": F.sum("n").over(whole)})
    at = F.col("_all") - 1

    def value_at(index: Column) -> Column:
        # Smallest length whose running count passes a zero-based index.
        return F.min(F.when(F.col("_upto") > index, F.col("length")))

    low, high = F.floor(at / 2), F.ceil(at / 2)
    return h.groupBy(*group).agg(
        F.max("_all").cast("bigint").alias("items"),
        _truncate(F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias(f"{prefix}mean_chars"),
        _truncate((value_at(low) + value_at(high)) / F.lit(2)).alias(f"{prefix}median_chars"),
        value_at(F.bround(at * F.lit(0.1))).cast("bigint").alias(f"{prefix}p10_chars"),
        F.coalesce(F.sum(F.when(F.col("length") == 0, F.col("n"))), F.lit(0)).cast("bigint").alias("empty_count"),
    )


def feed_metrics(items: DataFrame, length: Column | None = None, group: Sequence[str] = ("source",)) -> DataFrame:
    """Summary-length metrics per feed."""
    n = F.length(F.coalesce(F.col("summary"), F.lit(""))) if length is None else length
    hist = items.groupBy(*group, n.cast("bigint").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    stats = _length_stats(hist, group, "")
    return stats.withColumn("empty_rate", F.col("empty_count") / F.col("items"))


# Statuses that stand for the same outcome.
_OK = ["ok", "cache_hit:ok"]
_FALLBACK = ["normalizer_fallback", "cache_hit:normalizer_fallback"]
_MODEL_FAILED = ["llm_failed", "cache_hit:llm_failed"]


def enrich_rates(records: DataFrame, group: Sequence[str] = ("source",)) -> DataFrame:
    """Outcome rates of enrichment records per feed."""
    status = F.coalesce(F.col("status"), F.lit(""))

    def rate(cond: Column) -> Column:
        return F.avg(cond.cast("double"))

    rates = records.groupBy(*group).agg(
        F.count(F.lit(1)).alias("enrichment_attempts"),
        rate(status.isin(_OK)).alias("success_rate"),
        rate(status == "paywall").alias("paywall_rate"),
        rate(status == "http_error").alias("http_error_rate"),
        rate(status.startswith("browser_")).alias("browser_failure_rate"),
        F.count_if(status == "skipped_fetch_cap").alias("fetch_cap_skipped"),
        F.count_if(status == "skipped_browser_fetch_cap").alias("browser_cap_skipped"),
        rate(status == "extraction_failed").alias("extraction_failed_rate"),
        rate(status.isin(_FALLBACK)).alias("normalizer_fallback_rate"),
        rate(status.isin(_MODEL_FAILED)).alias("llm_failure_rate"),
    )
    native = F.coalesce(F.col("native_length"), F.lit(0)).cast("bigint")
    hist = records.groupBy(*group, native.alias("length")).agg(F.count(F.lit(1)).alias("n"))
    lengths = _length_stats(hist, group, "native_").select(
        *group, "native_mean_chars", "native_median_chars"
    )
    return rates.join(lengths, list(group), "inner")


def merge_enrich_rates(metrics: DataFrame, rates: DataFrame, group: Sequence[str] = ("source",)) -> DataFrame:
    """Feed metrics with enrichment rates; counts of feeds without records are 0."""
    return metrics.join(rates, list(group), "left").fillna(
        0,
        subset=[
            "enrichment_attempts",
            "fetch_cap_skipped",
            "browser_cap_skipped",
            "native_mean_chars",
            "native_median_chars",
        ],
    )


def tier_outcomes(records: DataFrame, group: Sequence[str] = ("run_date",)) -> DataFrame:
    """Attempts, successes, cap skips and fallbacks per health tier."""
    status = F.coalesce(F.col("status"), F.lit(""))
    capped = status.startswith("skipped_") & status.endswith("_cap")
    fallback = F.contains(status, F.lit("fallback")) | (F.coalesce(F.col("fallback_reason"), F.lit("")) != "")
    return records.groupBy(*group, F.coalesce(F.col("tier"), F.lit("active")).alias("tier")).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~capped & (status != "skipped")).alias("attempted"),
        F.count_if(~capped & status.isin(_OK)).alias("succeeded"),
        F.count_if(capped).alias("skipped_by_cap"),
        F.count_if(~capped & fallback).alias("fallback"),
    )


def usage_by_stage(
    calls: DataFrame, group: Sequence[str] = ("run_date", "stage"), pos: str = "pos"
) -> DataFrame:
    """Token sums and the most used model per stage; first seen wins ties."""
    per_model = calls.groupBy(*group, "model").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(pos).alias("_first"),
        F.sum(F.coalesce(F.col("tokens_in"), F.lit(0))).alias("_in"),
        F.sum(F.coalesce(F.col("tokens_out"), F.lit(0))).alias("_out"),
        F.sum(F.coalesce(F.col("tokens_cached"), F.lit(0))).alias("_cached"),
        F.count_if(F.col("tokens_in").isNull() | F.col("tokens_out").isNull()).alias("_missing"),
    )
    return per_model.groupBy(*group).agg(
        F.max_by("model", F.struct(F.col("_n"), (-F.col("_first")).alias("f"))).alias("model"),
        F.sum("_n").cast("bigint").alias("calls"),
        F.sum("_in").cast("bigint").alias("tokens_in"),
        F.sum("_out").cast("bigint").alias("tokens_out"),
        F.sum("_cached").cast("bigint").alias("tokens_cached"),
        F.sum("_missing").cast("bigint").alias("usage_missing"),
    )


def run_totals(calls: DataFrame, run: str = "run_date", stage: str = "stage") -> DataFrame:
    """Token totals per stage, per run and over all runs."""
    zero = F.lit(0)
    return calls.rollup(run, stage).agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.coalesce(F.col("tokens_in"), zero)).cast("bigint").alias("tokens_in"),
        F.sum(F.coalesce(F.col("tokens_out"), zero)).cast("bigint").alias("tokens_out"),
        F.sum(F.coalesce(F.col("tokens_cached"), zero)).cast("bigint").alias("tokens_cached"),
    )


def items_out(rows: DataFrame, group: Sequence[str] = ("run_date", "stage", "key")) -> DataFrame:
    """Size of every list a stage put out."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("items"))


def source_counts(items: DataFrame, kinds: Sequence[str], kind: str = "kind", run: str = "run_date") -> DataFrame:
    """Items per run and kind, one column per kind."""
    return items.groupBy(run).agg(*[F.count_if(F.col(kind) == k).alias(f"{k}_items") for k in kinds])


def last_nonempty_date(items: DataFrame, run: str = "run_date") -> DataFrame:
    given = items.where(F.coalesce(F.col("source"), F.lit("")) != "")
    return given.groupBy("source").agg(F.max(run).alias("last_nonempty_date"))


def most_frequent(
    df: DataFrame, group: Sequence[str], value: str, pos: str = "pos", out: str | None = None
) -> DataFrame:
    """Mode per group; the value seen first wins ties."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_first"))
    best = F.max_by(value, F.struct(F.col("_n"), (-F.col("_first")).alias("f")))
    return counts.groupBy(*group).agg(best.alias(out or value))


def outlet_share(
    links: DataFrame, items: DataFrame, least: float = 0.4, run: str = "run_date", item: str = "item_id"
) -> DataFrame:
    """Outlets named by more than a share of a run's items.

    The outlet is the link label up to its first colon; an item counts once
    per outlet. The total counts every item of the run, linked or not.
    """
    from newsloom.functions.text import py_strip

    label = F.coalesce(F.col("label"), F.lit(""))
    outlet = F.when(F.instr(label, ":") > 0, py_strip(F.substring_index(label, ":", 1))).otherwise(label)
    named = links.select(run, item, outlet.alias("outlet")).where(F.col("outlet") != "").distinct()
    counts = named.groupBy(run, "outlet").agg(F.count(F.lit(1)).alias("items"))
    totals = items.groupBy(run).agg(F.count(F.lit(1)).alias("total"))
    return (
        counts.join(totals, run, "inner")
        .withColumn("share", F.col("items") / F.col("total"))
        .where(F.col("share") > least)
    )


def changed_summaries(raw: DataFrame, enriched: DataFrame, run: str = "run_date") -> DataFrame:
    """How many summaries enrichment changed, per run."""
    from newsloom.functions.text import py_strip

    before = raw.select(run, "pos", py_strip(F.coalesce(F.col("summary"), F.lit(""))).alias("_a"))
    after = enriched.select(run, "pos", py_strip(F.coalesce(F.col("summary"), F.lit(""))).alias("_b"))
    return (
        before.join(after, [run, "pos"], "inner")
        .groupBy(run)
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.count_if(F.col("_a") != F.col("_b")).alias("changed"),
        )
    )


def status_histogram(records: DataFrame, group: Sequence[str] = ("run_date",)) -> DataFrame:
    return records.groupBy(*group, "status").agg(F.count(F.lit(1)).alias("records"))


def diagnostics_summary(issues: DataFrame, group: Sequence[str] = ("run_date", "artifact")) -> DataFrame:
    """Issue count per stage output with its first issue."""
    return issues.groupBy(*group).agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.min_by("message", "pos").alias("first_message"),
    )


def day_max(readings: DataFrame, ts: str, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Highest reading per day, null readings skipped."""
    return (
        readings.where(F.col(value).isNotNull())
        .groupBy(*group, F.to_date(ts).alias("date"))
        .agg(F.max(value).alias(value))
    )


def text_pack(
    items: DataFrame,
    group: Sequence[str],
    line: Column,
    first: int,
    header: Column | None = None,
    pos: str = "pos",
    joiner: str = "\n",
) -> DataFrame:
    """Text per group: the first items rendered in order, and the full count.

    Only ``first`` rendered items per group are gathered.
    """
    from newsloom.operators.ranking import top_per_group

    head = top_per_group(items, group, [pos], first, "_rank").withColumn("_line", line)
    texts = head.groupBy(*group).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_line"))), lambda x: x["_line"]), joiner
        ).alias("text")
    )
    sizes = items.groupBy(*group).agg(F.count(F.lit(1)).alias("items"))
    on = [F.col(f"t.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    both = texts.alias("t").join(sizes.alias("s"), on, "inner").select("t.*", "s.items")
    if header is None:
        return both
    return both.withColumn("text", F.concat(header, F.lit(joiner), F.col("text")))
