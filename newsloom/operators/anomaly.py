"""Checks of editions against expectation and history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsloom.functions.bands import fixed
from newsloom.functions.text import any_contains
from newsloom.functions.urls import netloc
from newsloom.operators.joins import HOT_ROWS
from newsloom.operators.phrases import cross_section_phrases, representative_phrases
from newsloom.operators.tags import PRIMARY_DOMAINS, PRIMARY_KEYWORDS, PRIMARY_TAGS

REPORT = "run_date {run}, check STRING, severity STRING, detail STRING"


def finding(check: str, severity: Column | str, detail: Column, run: str = "run_date") -> list[Column]:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return [F.col(run), F.lit(check).alias("check"), level.alias("severity"), detail.alias("detail")]


def category_skew(
    glance: DataFrame, tags: Sequence[str] = tuple(PRIMARY_TAGS), least: int = 5, run: str = "run_date"
) -> DataFrame:
    """Primary tags without any item in runs of more than ``least`` items."""
    counts = glance.groupBy(run).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.coalesce(F.col("tag"), F.lit("")) == t).alias(f"_{i}") for i, t in enumerate(tags)],
    )
    absent = F.array_compact(F.array(*[F.when(F.col(f"_{i}") == 0, F.lit(t)) for i, t in enumerate(tags)]))
    return counts.where(F.col("total") > least).select(run, "total", F.explode(absent).alias("tag"))


def severity_rank(health: Column) -> Column:
    # Severity of the health labels.
    return (
        F.when(health == "low_frequency", 1)
        .when(health == "headline_radar", 1)
        .when(health == "enrichment_required", 2)
        .when(health == "degraded", 3)
        .when(health == "broken", 4)
        .otherwise(0)
    )


def category_health(feeds: DataFrame) -> DataFrame:
    """Dominant health of a category's feeds; any broken feed decides it."""
    label = F.coalesce(F.col("health"), F.lit("active"))
    counts = feeds.groupBy("category", label.alias("health")).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max_by(
        "health",
        F.struct(
            (F.col("health") == "broken").alias("b"), F.col("_n"), severity_rank(F.col("health")).alias("s"), "health"
        ),
    )
    return counts.groupBy("category").agg(best.alias("health"))


def source_absence(
    items: DataFrame,
    covered: DataFrame,
    categories: Sequence[str] | None = None,
    least: int = 3,
    run: str = "run_date",
) -> DataFrame:
    """Categories with raw items whose hosts no analysed link refers to.

    ``covered`` has one row per analysed link (run, url, category). Adds
    ``selected``: whether an analysed item names the category.
    """
    named = items.where(F.coalesce(F.col("category"), F.lit("")) != "")
    if categories is not None:
        named = named.where(F.col("category").isin(list(categories)))
    hosts = named.select(run, "category", netloc(F.col("url")).alias("_host"))
    # Collapse to distinct hosts before the join: few rows per category.
    per_host = hosts.groupBy(run, "category", "_host").agg(F.count(F.lit(1)).alias("_n"))
    seen = (
        covered.select(run, netloc(F.col("url")).alias("_host")).where(F.col("_host") != "").distinct()
    ).withColumn("_seen", F.lit(True))
    marked = per_host.join(seen, [run, "_host"], "left")
    totals = marked.groupBy(run, "category").agg(
        F.sum("_n").cast("bigint").alias("items"), F.coalesce(F.bool_or("_seen"), F.lit(False)).alias("_met")
    )
    missing = totals.where((F.col("items") >= least) & ~F.col("_met")).drop("_met")
    chosen = (
        covered.where(F.coalesce(F.col("category"), F.lit("")) != "")
        .select(run, "category")
        .distinct()
        .withColumn("_chosen", F.lit(True))
    )
    return (
        missing.join(chosen, [run, "category"], "left")
        .withColumn("selected", F.coalesce(F.col("_chosen"), F.lit(False)))
        .drop("_chosen")
    )


def absence_report(
    missing: DataFrame, health: DataFrame, most: int = 4, listed: int = 5, run: str = "run_date"
) -> DataFrame:
    """The largest missing categories as rows, the others folded into one."""
    w = Window.partitionBy(run).orderBy(F.desc("items"), "category")
    ranked = missing.join(health, "category", "left").withColumn("_rank", F.row_number().over(w))
    label = F.coalesce(F.col("health"), F.lit("active"))
    case = F.when(F.col("selected"), "desk_selected_but_cross_domain_omitted").otherwise(
        "raw_present_but_not_selected_by_desk"
    )
    level = F.when(label.isin("low_frequency", "headline_radar"), "info").otherwise("warning")
    detail = F.format_string(
        "Category '%s' (%s) had %d raw items but contributed 0 items to analysis outputs — case: %s",
        F.col("category"),
        label,
        F.col("items"),
        case,
    )
    head = ranked.where(F.col("_rank") <= most).select(*finding("source_absence", level, detail, run))
    rest = ranked.where(F.col("_rank") > most)
    names = F.transform(
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("_rank") <= most + listed,
                    F.struct("_rank", F.format_string("%s (%d)", "category", "items").alias("text")),
                )
            )
        ),
        lambda x: x["text"],
    )
    folded = rest.groupBy(run).agg(F.count(F.lit(1)).alias("_n"), F.array_join(names, ", ").alias("_names"))
    summary = F.format_string(
        "%d additional categories had raw items with no domain-analysis coverage: %s", F.col("_n"), F.col("_names")
    )
    return head.unionByName(folded.select(*finding("source_absence", "warning", summary, run)))


def is_primary_dive(
    domains: Column, tag: Column, headline: Column, tags: Sequence[str] = tuple(PRIMARY_TAGS)
) -> Column:
    """A long read is primary by desk, by tag, or by a word in its headline."""
    by_desk = F.arrays_overlap(
        F.coalesce(domains, F.array().cast("array<string>")), F.array(*[F.lit(d) for d in PRIMARY_DOMAINS])
    )
    by_tag = F.coalesce(tag, F.lit("")).isin(list(tags))
    return by_desk | by_tag | any_contains(headline, PRIMARY_KEYWORDS)


def unusual_dives(
    dives: DataFrame, desk_items: DataFrame, tags: Sequence[str] = tuple(PRIMARY_TAGS), run: str = "run_date"
) -> DataFrame:
    """Dives off the primary topics in runs that had primary candidates.

    ``candidates`` are the first three candidate headlines of the run.
    """
    from newsloom.operators.ranking import top_per_group

    primary = desk_items.where(F.col("deep_dive_candidate") & F.col("tag").isin(list(tags)))
    three = top_per_group(primary, [run], ["desk_pos", "pos"], 3, "_rank")
    listed = three.groupBy(run).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rank", F.coalesce("headline", F.lit("?")).alias("headline")))),
            lambda x: x["headline"],
        ).alias("candidates")
    )
    tag = F.col("tag") if "tag" in dives.columns else F.lit("")
    domains = F.col("domains_bridged")
    off = dives.where(~is_primary_dive(domains, tag, F.col("headline"), tags))
    return off.join(listed, run, "inner")


def length_drift(
    runs: DataFrame,
    count: str = "items",
    run: str = "run_date",
    window: int = 7,
    least: int = 3,
    high: float = 2.0,
    low: float = 0.5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Item count of each run against the mean of its newest runs.

    ``runs`` has one row per run; a null count is a run without edition, which
    takes a place in the window but not in the mean. ``flag`` is high, low or
    null. One row per run keeps the window as small as the calendar.
    """
    w = Window.partitionBy(*by).orderBy(run).rowsBetween(-(window - 1), 0)
    out = runs.withColumns({"window_runs": F.count(count).over(w), "window_mean": F.avg(count).over(w)})
    usable = (F.col("window_runs") >= least) & (F.col("window_mean") != 0)
    ratio = F.when(usable, F.col(count) / F.when(F.col("window_mean") != 0, F.col("window_mean")))
    out = out.withColumn("ratio", ratio)
    return out.withColumn("flag", F.when(F.col("ratio") > high, "high").when(F.col("ratio") < low, "low"))


def drift_detail(count: str = "items") -> Column:
    more = F.format_string(
        "Today's digest has %d items — %sx the %d-day average (%s)",
        F.col(count),
        fixed(F.col("ratio")),
        F.col("window_runs"),
        fixed(F.col("window_mean")),
    )
    less = F.format_string(
        "Today's digest has %d items — only %s%% of the %d-day average (%s)",
        F.col(count),
        fixed(F.col("ratio") * 100),
        F.col("window_runs"),
        fixed(F.col("window_mean")),
    )
    return F.when(F.col("flag") == "high", more).otherwise(less)


def repeated_phrases(
    texts: DataFrame, most: int = 6, window: int = 10, run: str = "run_date", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Report rows on phrases shared by different sections of a run."""
    found = cross_section_phrases(texts, window, [run], hot_rows)
    kept = representative_phrases(found, most, run=run)
    names = texts.select(run, "pos", "item_id")
    a = names.select(run, F.col("pos").alias("pos_a"), F.col("item_id").alias("_a"))
    b = names.select(run, F.col("pos").alias("pos_b"), F.col("item_id").alias("_b"))
    full = kept.join(a, [run, "pos_a"], "left").join(b, [run, "pos_b"], "left")
    detail = F.format_string(
        "10-word phrase appears in '%s' (item: %s) and '%s' (item: %s): \"%s\"",
        "section_a",
        "_a",
        "section_b",
        "_b",
        "phrase",
    )
    rows = full.select(*finding("repeated_phrase", "warning", detail, run))
    folded = kept.groupBy(run).agg(F.max("suppressed").alias("_n")).where(F.col("_n") > 0)
    more = F.format_string("Suppressed %d additional overlapping repeated-phrase matches", F.col("_n"))
    return rows.unionByName(folded.select(*finding("repeated_phrase", "warning", more, run)))


def edition_texts(glance: DataFrame, dives: DataFrame, contested: DataFrame) -> DataFrame:
    """Texts of an edition in reading order, by section."""
    from newsloom.functions.text import py_strip, strip_markup_pairs

    def s(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    note = F.when(F.col("cross_domain_note").isNull(), "None").otherwise(F.col("cross_domain_note"))
    body = py_strip(F.concat_ws(" ", s("facts"), s("analysis"), note))
    text = F.concat_ws(" ", F.when(s("headline") != "", s("headline")), F.when(body != "", body))
    first = glance.select(
        "run_date", F.lit("at_a_glance").alias("section"), F.lit(0).alias("_s"), "pos", s("item_id").alias("item_id"), text.alias("text")
    )
    second = dives.select(
        "run_date",
        F.lit("deep_dives").alias("section"),
        F.lit(1).alias("_s"),
        "pos",
        F.substring(s("headline"), 1, 40).alias("item_id"),
        F.concat_ws(" ", s("headline"), strip_markup_pairs(F.col("body"))).alias("text"),
    )
    third = contested.select(
        "run_date",
        F.lit("contested_narratives").alias("section"),
        F.lit(2).alias("_s"),
        "pos",
        F.substring(s("topic"), 1, 40).alias("item_id"),
        F.concat_ws(" ", s("topic"), s("description")).alias("text"),
    )
    rows = first.unionByName(second).unionByName(third)
    # Reading order as one sortable number per run: section, then place.
    return rows.withColumn("pos", F.col("_s") * F.lit(1 << 40) + F.col("pos").cast("bigint")).drop("_s")


def anomaly_report(*checks: DataFrame, run: str = "run_date") -> DataFrame:
    """Union of the checks with the number of findings per run."""
    out = None
    for c in checks:
        out = c if out is None else out.unionByName(c)
    counts = out.groupBy(run).agg(F.count(F.lit(1)).alias("anomaly_count"))
    return out.join(counts, run, "inner").withColumn("checks_run", F.lit(len(checks)))
