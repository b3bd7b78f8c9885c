"""Join helpers and the join-shaped operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.urls import canonical_url

# A key is hot from this many rows on. A table of n rows so has at most n / HOT_ROWS
# hot keys: a hundred thousand of them in 10^11 rows, which is what gets broadcast.
HOT_ROWS = 1_000_000
SALTS = 64


def key_counts(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows per key, combined map-side."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("rows"))


def hot_keys(counts: DataFrame, on: Sequence[str], rows: int = HOT_ROWS) -> DataFrame:
    """The keys with so many rows or more."""
    return counts.where(F.col("rows") >= rows).select(*on)


def hot_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    counts: DataFrame,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join whose left side may hold very frequent keys.

    ``counts`` is ``key_counts`` of the left side, which callers mostly need
    anyway. Rows of hot keys are spread over ``salts`` tasks by a hash of the
    row, and the right rows of just those keys are repeated once per salt. The
    result is that of the plain join on ``on`` (null keys do not match).
    """
    hot = hot_keys(counts, on, hot_rows).withColumn("_hot", F.lit(True))
    # Hashable row content decides the salt, so a recomputed task agrees.
    plain = [c for c, t in left.dtypes if not t.startswith(("map", "variant"))]
    salted = left.join(F.broadcast(hot), list(on), "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.xxhash64(*plain), F.lit(salts))).otherwise(F.lit(0)).cast("int"),
    )
    spread = right.join(F.broadcast(hot), list(on), "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    joined = salted.drop("_hot").join(spread.drop("_hot"), [*on, "_salt"], how)
    return joined.drop("_salt")


# Fields of a landed record which can carry its URL.
URL_FIELDS = ["url", "final_url", "resolved_url", "canonical_url"]


def known_urls(*tables: DataFrame, key: str = "run_date") -> DataFrame:
    """Distinct (run, url) over every URL field of the given tables."""
    out = None
    for t in tables:
        fields = [f for f in URL_FIELDS if f in t.columns]
        # One field needs no explode, so URLs already apart are not shuffled again.
        one = F.col(fields[0]) if len(fields) == 1 else F.explode(F.array(*[F.col(f) for f in fields]))
        part = t.select(key, one.alias("url"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.coalesce(F.col("url"), F.lit("")) != "").distinct()


def link_urls(items: DataFrame, links: str = "links", key: str = "run_date") -> DataFrame:
    """Distinct (run, url) of the links nested in items."""
    urls = items.select(key, F.explode(F.col(links)["url"]).alias("url"))
    return urls.where(F.coalesce(F.col("url"), F.lit("")) != "").distinct()


def known_index(known: DataFrame, key: str = "run_date") -> DataFrame:
    """Known URLs with their comparison form; write it once for several checks."""
    return known.select(key, "url").distinct().withColumn("canonical", canonical_url(F.col("url")))


def mark_known(links: DataFrame, known: DataFrame, key: str = "run_date", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``known``: blank, or equal to a known URL exactly or canonically.

    Equal URLs have equal comparison forms, so one lookup by the form decides;
    URLs without a form are looked up as they are. Forms asked for are looked
    up once, however many links have them, and what is found returns to the
    links. Blank links find none, and are spread over tasks. ``known`` is a
    table of URLs or its ``known_index``.
    """
    blank = F.coalesce(F.col("url"), F.lit("")) == ""
    plain = [c for c, t in links.dtypes if not t.startswith(("map", "variant"))]
    links = links.withColumns(
        {
            "_spread": F.when(blank, F.pmod(F.xxhash64(*plain), F.lit(SALTS))),
            "_canonical": F.when(blank | F.col(key).isNull(), "").otherwise(canonical_url(F.col("url"))),
        }
    )
    form = lambda c: F.when(c != "", c).otherwise(F.concat(F.lit("="), F.col("url")))
    # Numbers sort faster than URLs, so a hash leads the keys.
    on = ["_hash", key, "_form"]
    number = F.xxhash64(key, "_form").alias("_hash")
    links = links.withColumn("_form", F.when(~blank, form(F.col("_canonical")))).withColumn("_hash", F.coalesce("_spread", number)).drop("_spread")
    asked = key_counts(links.where(~blank), on)
    canonical = F.col("canonical") if "canonical" in known.columns else canonical_url(F.col("url"))
    forms = known.select(key, form(canonical).alias("_form")).select(number, key, "_form")
    # With its count the table is that which tells the hot keys: Spark makes it once.
    wanted = asked.where("rows > 0").select(*on)
    found = forms.join(wanted, on, "left_semi").distinct()
    out = hot_join(links, found.withColumn("_known", F.lit(True)), on, "left", asked, hot_rows).drop("_form", "_hash")
    return (
        out.withColumn("known", blank | F.coalesce(F.col("_known"), F.lit(False)))
        .withColumn("canonical_url", F.col("_canonical"))
        .drop("_known", "_canonical")
    )


def best_annotation(annotations: DataFrame, group: Sequence[str] = ("run_date", "item_id")) -> DataFrame:
    """One annotation per item: highest confidence, then the earliest."""
    from newsloom.functions.text import py_strip
    from newsloom.operators.ranking import confidence_rank, top_per_group

    usable = annotations.where(py_strip(F.coalesce(F.col("one_line"), F.lit(""))) != "").where(
        py_strip(F.coalesce(F.col(group[-1]).cast("string"), F.lit(""))) != ""
    )
    return top_per_group(usable, group, [F.desc(confidence_rank(F.col("confidence"))), "pos"], 1)


def latest_desk_item(desk_items: DataFrame) -> DataFrame:
    """One desk item per id; the last desk wins when an id occurs twice."""
    from newsloom.operators.ranking import top_per_group

    given = desk_items.where(F.coalesce(F.col("item_id"), F.lit("")) != "")
    return top_per_group(
        given, ["run_date", "item_id"], [F.desc("desk_pos"), F.desc("pos")], 1
    )


def join_selection(selections: DataFrame, desk_items: DataFrame) -> DataFrame:
    """Selected ids with the content of their desk item, in selection order."""
    from newsloom.functions.text import py_strip
    from newsloom.operators.tags import tag_label

    items = latest_desk_item(desk_items).drop("pos")
    picks = selections.select(
        "run_date",
        F.col("pos"),
        py_strip(F.coalesce(F.col("item_id"), F.lit(""))).alias("item_id"),
        F.when(F.col("cross_domain_note") != "", F.col("cross_domain_note")).alias("cross_domain_note"),
    )
    tag = py_strip(F.coalesce(F.col("tag"), F.lit("")))
    return (
        picks.join(items, ["run_date", "item_id"], "inner")
        .withColumn("tag", tag)
        .withColumn("tag_label", tag_label(F.col("tag")))
        .withColumn("headline", py_strip(F.coalesce(F.col("headline"), F.lit(""))))
        .withColumn("facts", F.coalesce(F.col("facts"), F.lit("")))
        .withColumn("analysis", F.coalesce(F.col("analysis"), F.lit("")))
        .withColumn("source_depth", F.coalesce(F.col("source_depth"), F.lit("single-source")))
        .select(
            "run_date",
            "pos",
            "item_id",
            "tag",
            "tag_label",
            "headline",
            "facts",
            "analysis",
            "source_depth",
            "cross_domain_note",
            "links",
            "connection_hooks",
        )
    )


def previous_run(df: DataFrame, group: Sequence[str], run: str = "run_date") -> DataFrame:
    """Each run of a group with the newest run strictly before it."""
    runs = df.select(*group, run).distinct()
    w = Window.partitionBy(*group).orderBy(run)
    return runs.withColumn(f"previous_{run}", F.lag(run).over(w))


def asof_runs(dates: DataFrame, runs: DataFrame, date: str = "date", run: str = "run_date") -> DataFrame:
    """Newest run on or before each date (null when there is none).

    Both sides are distinct calendar values, so the merged timeline stays as
    small as the calendar.
    """
    marks = runs.select(F.col(run).alias("_at"), F.col(run).alias("_run")).distinct()
    asks = dates.select(F.col(date).alias("_at"), F.lit(None).cast(runs.schema[run].dataType).alias("_run")).distinct()
    by_month = marks.unionByName(asks).groupBy("_at").agg(F.max("_run").alias("_run"))
    w = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    found = by_month.withColumn("_found", F.last("_run", ignorenulls=True).over(w))
    return dates.join(
        found.select(F.col("_at").alias(date), F.col("_found").alias(run)), date, "left"
    )


def schedule_lookup(
    df: DataFrame, schedule: DataFrame, date: str, blanks: Sequence[str], start: str = "start", end: str = "end"
) -> DataFrame:
    """Schedule row whose inclusive range holds the date; blanks when none.

    Ranges are unrolled to days (a calendar, so its size is fixed by the
    dates it covers) and joined by equality. The earliest range wins.
    """
    days = schedule.withColumn("_day", F.explode(F.sequence(F.to_date(start), F.to_date(end))))
    w = Window.partitionBy("_day").orderBy(start)
    days = days.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    out = df.join(days, F.to_date(F.col(date)) == F.col("_day"), "left").drop("_day")
    return out.fillna("", subset=list(blanks))


def prefer_enriched(raw: DataFrame, enriched: DataFrame, field: str = "summary") -> DataFrame:
    """Raw items with the enriched field where their run has been enriched."""
    better = enriched.select("run_date", "pos", F.col(field).alias("_better"))
    return (
        raw.join(better, ["run_date", "pos"], "left")
        .withColumn(field, F.coalesce(F.col("_better"), F.col(field)))
        .drop("_better")
    )


def propagate_to_duplicates(items: DataFrame, kept: DataFrame, field: str, key: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Duplicates of a kept item take over its value."""
    source = kept.select(*key, F.col(field).alias("_kept"))
    out = hot_join(items, source, key, "left", key_counts(items, key), hot_rows)
    return out.withColumn(field, F.coalesce(F.col("_kept"), F.col(field))).drop("_kept")


def first_available(primary: DataFrame, fallback: DataFrame, run: str = "run_date") -> DataFrame:
    """Rows of the primary source; of the fallback for runs it does not cover."""
    covered = primary.select(run).distinct()
    return primary.unionByName(fallback.join(covered, run, "left_anti"), allowMissingColumns=True)


def added_rows(current: DataFrame, previous: DataFrame, key: str = "url") -> DataFrame:
    """Rows of the current snapshot whose key the previous one lacks."""
    return current.join(previous.select(key).distinct(), key, "left_anti")
