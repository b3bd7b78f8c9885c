"""Week ahead and weekly study units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_event_date
from newsloom.functions.text import py_strip
from newsloom.operators.ranking import top_per_group

# Order in which kinds of events are listed, and their names.
EVENT_KINDS = ["holiday", "church", "economic", "launch"]

# Kinds and days of weekly units, wording of added corrections.
UNIT_KINDS = [
    "narrative_unit",
    "key_scripture",
    "misuse_correction",
    "scholarly_insight",
    "language_context",
    "faithful_application",
]
ADDED_APPLICATION = "Read the passage more carefully before repeating the common use."
ADDED_HINT = "Write this as a corrective but charitable daily note."
UNIT_DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]


def week_ahead(
    holidays: DataFrame, church: DataFrame, economic: DataFrame, launches: DataFrame, most: int = 5
) -> DataFrame:
    """The next events of all kinds; undated ones last.

    Inputs carry run_date, pos, date (text), event and their own extra fields.
    """
    out = None
    for order, (kind, df) in enumerate(zip(EVENT_KINDS, (holidays, church, economic, launches), strict=True)):
        rows = df.withColumns({"type": F.lit(kind), "_kind": F.lit(order)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    dated = out.withColumn("_at", parse_event_date(F.col("date")))
    order = [F.col("_at").asc_nulls_last(), "_kind", "pos"]
    return top_per_group(dated, ["run_date"], order, most, "rank").drop("_at", "_kind", "pos")


def legacy_units(foci: DataFrame) -> DataFrame:
    """Units from the older focus lists (week_start, pos, id, text_ref, guide_excerpt).

    A week with units of its own does not use them; see ``week_units``.
    """
    blank = F.lit("")
    ref = F.coalesce("text_ref", blank)
    return foci.select(
        "week_start",
        "pos",
        F.coalesce("id", blank).alias("id"),
        F.lit("narrative_unit").alias("kind"),
        ref.alias("title"),
        ref.alias("anchor_ref"),
        F.array(ref).alias("source_refs"),
        blank.alias("core_claim"),
        F.coalesce("guide_excerpt", blank).alias("supporting_excerpt"),
        *[blank.alias(c) for c in ("enhancement", "application", "prompt_hint")],
    )


def week_units(units: DataFrame, foci: DataFrame) -> DataFrame:
    """Units of every week, the legacy foci where a week has none."""
    lacking = foci.join(units.select("week_start").distinct(), "week_start", "left_anti")
    return units.unionByName(legacy_units(lacking), allowMissingColumns=True)


def _free_ids(given: Column) -> Column:
    """Ids of a week's units (place, id): one that is blank or seen takes its place's.

    Generated ids count as seen for the units after them.
    """

    def step(acc: Column, x: Column) -> Column:
        place = F.concat(F.lit("focus-"), (x["pos"] + 1).cast("string"))
        taken = (x["id"] == "") | F.exists(acc, lambda y: y["id"] == x["id"])
        return F.array_append(acc, F.struct(x["pos"].alias("pos"), F.when(taken, place).otherwise(x["id"]).alias("id")))

    return F.aggregate(F.array_sort(given), F.array().cast("array<struct<pos:int,id:string>>"), step)


def normalize_units(units: DataFrame) -> DataFrame:
    """Weekly units with ids of their own, valid kinds and an anchor among the refs.

    A blank or repeated id becomes ``focus-N`` by place; the first keeps it. The
    units of one week are gathered for that; a week has a handful.
    """
    place = F.concat(F.lit("focus-"), (F.col("pos") + 1).cast("string"))
    given = py_strip(F.coalesce(F.when(F.col("id") != "", F.col("id")), place))
    lists = units.groupBy("week_start").agg(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), given.alias("id"))).alias("_given"))
    ids = lists.select("week_start", F.inline(_free_ids(F.col("_given"))))
    rows = units.drop("id").join(ids, ["week_start", "pos"])
    kind = F.lower(py_strip(F.coalesce("kind", F.lit(""))))
    refs = F.filter(
        F.transform(F.coalesce("source_refs", F.array().cast("array<string>")), py_strip), lambda r: r != ""
    )
    anchor = py_strip(F.coalesce("anchor_ref", F.lit("")))
    return rows.select(
        "week_start",
        "pos",
        "id",
        F.when(kind.isin(UNIT_KINDS), kind).otherwise("narrative_unit").alias("kind"),
        py_strip(F.coalesce("title", F.lit(""))).alias("title"),
        F.when(anchor != "", anchor).otherwise(F.coalesce(F.get(refs, F.lit(0)), F.lit(""))).alias("anchor_ref"),
        F.when((anchor != "") & ~F.array_contains(refs, anchor), F.array_prepend(refs, anchor)).otherwise(refs).alias(
            "source_refs"
        ),
        *[
            py_strip(F.coalesce(c, F.lit(""))).alias(c)
            for c in ("core_claim", "supporting_excerpt", "enhancement", "application", "prompt_hint")
        ],
    )


def top_up_corrections(units: DataFrame, misuses: DataFrame, least: int = 2) -> DataFrame:
    """Units with corrections added from the misuse list until there are two.

    A misuse whose title is already a correction, or repeats, adds nothing.
    """
    title = py_strip(F.coalesce("text", F.lit("")))
    have = units.where("kind = 'misuse_correction'")
    counts = have.groupBy("week_start").agg(F.count(F.lit(1)).alias("_have"))
    sizes = units.groupBy("week_start").agg(F.count(F.lit(1)).alias("_n"))
    fresh = misuses.withColumn("title", title).where("title <> ''")
    fresh = fresh.join(have.select("week_start", "title").distinct(), ["week_start", "title"], "left_anti")
    fresh = top_per_group(fresh, ["week_start", "title"], ["pos"], 1)
    ranked = top_per_group(fresh, ["week_start"], ["pos"], least, "_rank")
    ranked = ranked.join(counts, "week_start", "left").join(sizes, "week_start", "left")
    take = ranked.where(F.col("_rank") <= F.lit(least) - F.coalesce("_have", F.lit(0)))
    n = F.coalesce("_n", F.lit(0)) + F.col("_rank")

    def text(c: str):
        return py_strip(F.coalesce(c, F.lit("")))

    added = take.select(
        "week_start",
        (n - 1).cast(units.schema["pos"].dataType).alias("pos"),
        F.concat(F.lit("focus-"), n.cast("string")).alias("id"),
        F.lit("misuse_correction").alias("kind"),
        "title",
        F.lit("").alias("anchor_ref"),
        F.array().cast("array<string>").alias("source_refs"),
        text("correction").alias("core_claim"),
        text("common_use").alias("supporting_excerpt"),
        text("cost_bearer").alias("enhancement"),
        F.lit(ADDED_APPLICATION).alias("application"),
        F.lit(ADDED_HINT).alias("prompt_hint"),
    )
    return units.unionByName(added)


def proposed_sequence(units: DataFrame, raw: DataFrame) -> DataFrame:
    """Unit per weekday: the proposed ones that exist, else units in order."""
    valid = raw.join(units.select("week_start", F.col("id").alias("unit_id")).distinct(), ["week_start", "unit_id"], "left_semi")
    valid = valid.where(F.col("day").isin(UNIT_DAYS)).select("week_start", "day", "unit_id")
    missing = units.join(valid.select("week_start").distinct(), "week_start", "left_anti")
    head = top_per_group(missing, ["week_start"], ["pos"], len(UNIT_DAYS), "_rank")
    days = F.array(*[F.lit(d) for d in UNIT_DAYS])
    return valid.unionByName(
        head.select("week_start", F.element_at(days, F.col("_rank")).alias("day"), F.col("id").alias("unit_id"))
    )


def unit_of_day(units: DataFrame, sequence: DataFrame, dates: DataFrame) -> DataFrame:
    """Unit for each date of a week: its weekday's, else the next weekday with
    one, going round; a week without any sequence gives its first unit.

    ``dates``: date, week_start. Sunday starts from Monday.
    """
    index = F.create_map(*[F.lit(x) for i, d in enumerate(UNIT_DAYS) for x in (d, i)])
    known = sequence.join(units.select("week_start", F.col("id").alias("unit_id")).distinct(), ["week_start", "unit_id"], "left_semi")
    today = F.coalesce(index[F.lower(F.date_format("date", "EEEE"))], F.lit(0))
    offered = dates.join(known, "week_start", "left").withColumn(
        "_ahead", F.pmod(index[F.col("day")] - today, F.lit(len(UNIT_DAYS)))
    )
    best = offered.groupBy("date", "week_start").agg(F.min_by("unit_id", "_ahead").alias("_unit"))
    first = units.groupBy("week_start").agg(F.min_by("id", "pos").alias("_first"))
    return best.join(first, "week_start", "inner").select(
        "date", "week_start", F.coalesce("_unit", "_first").alias("unit_id")
    )


def reflection(units: DataFrame) -> DataFrame:
    """Prose of a unit: its fields as paragraphs, contained ones left out."""
    from newsloom.functions.text import collapse, distinct_paragraphs

    fields = ["supporting_excerpt", "core_claim", "enhancement", "application"]
    texts = F.array(*[collapse(F.coalesce(c, F.lit(""))) for c in fields])
    return units.withColumn("reflection", F.array_join(distinct_paragraphs(texts), "\n\n"))
