"""Normalising drifting JSON of edition stages, with issue reports.

Raw documents come as JSON text per run (and desk). They are parsed to
VARIANT, so any shape loads; declared fields are coerced, what is not an
object is dropped and reported with its path, unknown fields are kept in a map.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import clip, py_strip
from newsloom.operators.ranking import confidence_cap, top_per_group

ISSUE = "array<struct<path:string,message:string>>"


class Shape(NamedTuple):
    """Declared fields of one kind of entry."""

    entry: str
    texts: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    # Field -> (name of its entries in messages, text fields of an entry).
    objects: Mapping[str, tuple[str, tuple[str, ...]]] = {}
    # Texts that default to something else than blank.
    defaults: Mapping[str, str] = {}
    # Texts that stay null when absent.
    nullable: tuple[str, ...] = ()
    words_message: str = "value"


LINK = ("link", ("url", "label"))
HOOK = ("connection_hook", ("entity", "region", "theme", "policy"))
EVIDENCE = ("evidence", ("source", "excerpt", "framing"))

# Fields and messages of the stage contracts.
DESK_ITEM = Shape(
    "domain item is not an object",
    texts=("item_id", "tag", "tag_label", "headline", "facts", "analysis", "source_depth"),
    nullable=("deep_dive_rationale",),
    flags=("deep_dive_candidate",),
    objects={"links": LINK, "connection_hooks": HOOK},
)
GLANCE = Shape(
    "at_a_glance entry is not an object",
    texts=(
        "item_id",
        "tag",
        "tag_label",
        "headline",
        "context",
        "facts",
        "analysis",
        "source_depth",
        "cross_domain_note",
    ),
    objects={"connection_hooks": HOOK, "links": LINK},
)
DIVE = Shape(
    "deep dive entry is not an object",
    texts=("headline", "body", "why_it_matters", "source_depth"),
    words=("domains_bridged",),
    objects={"further_reading": LINK},
)
CONNECTION = Shape(
    "cross-domain connection is not an object",
    texts=("title", "summary", "why_it_matters"),
    words=("domains", "entities"),
)
READING = Shape(
    "worth_reading entry is not an object", texts=("title", "url", "source", "description", "read_time")
)
ANNOTATION = Shape(
    "annotation is not an object",
    texts=("item_id", "seam_type", "one_line", "confidence"),
    defaults={"confidence": "medium"},
    objects={"evidence": EVIDENCE, "links": LINK},
)
CROSS_ANNOTATION = Shape(
    "cross-domain annotation is not an object",
    texts=("seam_type", "one_line"),
    words=("linked_item_ids",),
    words_message="linked_item_ids",
)
CANDIDATE = Shape(
    "candidate is not an object",
    texts=("item_id", "seam_type", "candidate_one_line", "why_it_might_matter", "drop_if_weak_reason"),
    objects={"possible_evidence": EVIDENCE},
)
CROSS_CANDIDATE = Shape(
    "cross-domain candidate is not an object",
    texts=("candidate_one_line", "why_it_might_matter"),
    words=("linked_item_ids",),
    words_message="linked_item_ids",
)
PLAN_ENTRY = Shape("plan entry is not an object")

EDITION_SECTIONS = {
    "at_a_glance": GLANCE,
    "deep_dives": DIVE,
    "cross_domain_connections": CONNECTION,
    "worth_reading": READING,
}
PLAN_SECTIONS = ("cross_domain_connections", "deep_dives", "worth_reading", "rejected_alternatives")
SEAM_TYPES = [
    "framing_divergence",
    "selection_divergence",
    "causal_divergence",
    "magnitude_divergence",
    "credible_dissent",
]


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def as_list(v: Column) -> Column:
    """Elements of a JSON array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_object(v: Column) -> Column:
    # Without fields to fill, nothing of the object is copied.
    return F.coalesce(F.try_variant_get(v, "$", "struct<>").isNotNull(), F.lit(False))


def _spelled(text: Column, v: Column, default: str | None) -> Column:
    # Only texts that look like a flag are asked for their kind, which walks the value.
    flag = text.isin("true", "false") & (F.schema_of_variant(v) == "BOOLEAN")
    spelled = F.when(flag, F.initcap(text)).otherwise(text)
    return spelled if default is None else F.coalesce(spelled, F.lit(default))


def as_text(v: Column, default: str | None = "") -> Column:
    """Text of any JSON value; absent and null give the default."""
    return _spelled(F.try_variant_get(v, "$", "string"), v, default)


def field_text(v: Column, name: str, default: str | None = "") -> Column:
    """``as_text`` of a field, taken in one step."""
    return _spelled(F.try_variant_get(v, f"$.{name}", "string"), field(v, name), default)


def as_flag(v: Column) -> Column:
    """Truth of any JSON value: words for yes, non-zero numbers, non-empty lists."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(
        F.when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", F.lower(py_strip(text)).isin("1", "true", "yes", "y"))
        .when(kind == "VOID", F.lit(False))
        .when(kind.startswith("ARRAY"), F.size(as_list(v)) > 0)
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(F.try_variant_get(v, "$", "double") != 0),
        F.lit(False),
    )


def extra_fields(v: Column, known: Sequence[str]) -> Column:
    """Fields outside the declaration, as JSON text by name."""
    every = F.from_json(F.to_json(v), "map<string,string>")
    return F.map_filter(every, lambda k, _: ~k.isin(list(known)))


def _issue(path: Column, message: str) -> Column:
    return F.struct(path.alias("path"), F.lit(message).alias("message"))


def _none() -> Column:
    return F.array().cast(ISSUE)


def _list_issue(v: Column, path: Column, message: str) -> Column:
    """One issue when a field is present but not a list."""
    wrong = v.isNotNull() & as_list(v).isNull()
    return F.when(wrong, F.array(_issue(path, message))).otherwise(_none())


def _at(path: Column, i: Column) -> Column:
    return F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))


def _child_issues(v: Column, path: Column, message: str) -> Column:
    found = F.transform(as_list(v), lambda x, i: F.when(~is_object(x), _issue(_at(path, i), message)))
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), _none())


def _children(v: Column, fields: Sequence[str]) -> Column:
    objects = F.filter(as_list(v), is_object)
    made = F.transform(objects, lambda x: F.struct(*[field_text(x, f).alias(f) for f in fields]))
    kind = "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    return F.coalesce(made, F.array().cast(kind))


def _word_list(v: Column) -> Column:
    texts = F.transform(as_list(v), lambda x: py_strip(as_text(x)))
    return F.coalesce(F.filter(texts, lambda x: x != ""), F.array().cast("array<string>"))


def entries(
    docs: DataFrame, section: Column, path: Column, shape: Shape, keep: Sequence[str] = ("run_date",)
) -> tuple[DataFrame, DataFrame]:
    """(normalised entries, issues) of one list in each document.

    Entries keep their place in the list as ``pos``.
    """
    # The outer form, as for the other Spark first asks for the list's size, which parses the document again.
    rows = docs.select(*keep, path.alias("_path"), F.posexplode_outer(as_list(section)).alias("pos", "_v"))
    rows = rows.where(F.col("pos").isNotNull())
    here = _at(F.col("_path"), F.col("pos"))
    known = [*shape.texts, *shape.nullable, *shape.flags, *shape.words, *shape.objects]
    v = F.col("_v")
    good = rows.where(is_object(v)).select(
        *keep,
        "pos",
        *[field_text(v, t, shape.defaults.get(t, "")).alias(t) for t in shape.texts],
        *[field_text(v, t, None).alias(t) for t in shape.nullable],
        *[as_flag(field(v, t)).alias(t) for t in shape.flags],
        *[_word_list(field(v, t)).alias(t) for t in shape.words],
        *[_children(field(v, t), fields).alias(t) for t, (_, fields) in shape.objects.items()],
        extra_fields(v, known).alias("extra"),
    )
    nested = [_none()]
    for name, (label, _) in shape.objects.items():
        child = F.concat(here, F.lit(f".{name}"))
        list_name = "links" if label == "link" else name
        nested.append(_list_issue(field(v, name), child, f"{list_name} is not a list"))
        nested.append(_child_issues(field(v, name), child, f"{label} entry is not an object"))
    for name in shape.words:
        nested.append(
            _list_issue(field(v, name), F.concat(here, F.lit(f".{name}")), f"{shape.words_message} is not a list")
        )
    found = F.when(~is_object(v), F.array(_issue(here, shape.entry))).otherwise(F.concat(*nested))
    issues = rows.select(*keep, "pos", F.posexplode(found).alias("_n", "_i")).select(
        *keep, "pos", F.col("_n").alias("at"), "_i.path", "_i.message"
    )
    return good, issues


def _head_issues(docs: DataFrame, checks: Sequence[tuple[Column, Column, str]], keep: Sequence[str]) -> DataFrame:
    """Issues of a document itself; they come before those of its entries."""
    found = F.concat(
        _none(), *[F.when(c, F.array(_issue(p, m))).otherwise(_none()) for c, p, m in checks]
    )
    return docs.select(*keep, F.posexplode(found).alias("at", "_i")).select(
        *keep, F.lit(-1).alias("pos"), "at", "_i.path", "_i.message"
    )


def desk_results(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(desk items, issues) from one JSON document per run and desk.

    A bare list counts as the list of items.
    """
    docs = raw.withColumn("_doc", F.try_parse_json("raw"))
    doc = F.col("_doc")
    path = F.concat(F.lit("domain_analysis."), F.col("desk"))
    bare = as_list(doc).isNotNull()
    section = F.when(bare, doc).otherwise(field(doc, "items"))
    keep = ["run_date", "desk", "desk_pos"]
    good, issues = entries(docs, section, F.concat(path, F.lit(".items")), DESK_ITEM, keep)
    wrong = ~bare & ~is_object(doc)
    no_list = ~bare & is_object(doc) & section.isNotNull() & as_list(section).isNull()
    head = _head_issues(
        docs,
        [
            (wrong, path, "domain result is not an object"),
            (no_list, F.concat(path, F.lit(".items")), "items is not a list"),
        ],
        keep,
    )
    return good, head.unionByName(issues).withColumn("artifact", F.lit("domain_analysis"))


def market_context(raw: DataFrame, desk: str = "econ") -> DataFrame:
    """Market note of the economy desk per run."""
    docs = raw.where(F.col("desk") == desk).withColumn("_doc", F.try_parse_json("raw"))
    return docs.select("run_date", as_text(field(F.col("_doc"), "market_context")).alias("market_context"))


def edition_output(raw: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(entries per section, issues) from one JSON document per run.

    A section that is absent is reported; an empty one is fine.
    """
    docs = raw.withColumn("_doc", F.try_parse_json("raw"))
    doc = F.col("_doc")
    name = "cross_domain_output"
    checks = [(~is_object(doc), F.lit(name), "artifact is not an object")]
    for s in EDITION_SECTIONS:
        checks.append(
            (field(doc, s).isNull(), F.lit(f"{name}.{s}"), "required section missing; defaulted to empty")
        )
    for s in EDITION_SECTIONS:
        value = field(doc, s)
        checks.append((value.isNotNull() & as_list(value).isNull(), F.lit(f"{name}.{s}"), f"{s} is not a list"))
    issues = _head_issues(docs, checks, ["run_date"])
    parts = {}
    for s, shape in EDITION_SECTIONS.items():
        parts[s], found = entries(docs, field(doc, s), F.lit(f"{name}.{s}"), shape)
        issues = issues.unionByName(found)
    return parts, issues.withColumn("artifact", F.lit(name))


def edition_plan(
    raw: DataFrame, dives: int = 2, reading: int = 3, connections: int = 3
) -> tuple[DataFrame, DataFrame]:
    """(plan entries, issues) from one JSON document per run.

    Sections are cut to their count of objects; entries after the cut are not
    looked at. Entries come as JSON text with their section.
    """
    docs = raw.withColumn("_doc", F.try_parse_json("raw"))
    doc = F.col("_doc")
    name = "cross_domain_plan"
    scope = field(doc, "planning_scope")
    limits = dict(zip(PLAN_SECTIONS, (connections, dives, reading, None), strict=True))
    checks = [
        (~is_object(doc), F.lit(name), "artifact is not an object"),
        (
            scope.isNotNull() & ~F.is_variant_null(scope) & ~is_object(scope),
            F.lit(f"{name}.planning_scope"),
            "planning_scope is not an object",
        ),
    ]
    out, issues = None, None
    for s, limit in limits.items():
        value = field(doc, s)
        checks.append((value.isNotNull() & as_list(value).isNull(), F.lit(f"{name}.{s}"), "value is not a list"))
        places = F.transform(as_list(value), lambda x, i: F.struct(i.alias("i"), is_object(x).alias("ok"), x.alias("v")))
        rows = docs.select("run_date", F.explode(places).alias("e"), F.size(as_list(value)).alias("_n")).select(
            "run_date", F.lit(s).alias("section"), F.col("e.i").alias("pos"), F.col("e.ok").alias("_ok"), F.col("e.v").alias("_v")
        )
        good = rows.where("_ok")
        bad = rows.where("not _ok")
        if limit is not None:
            good = top_per_group(good, ["run_date"], ["pos"], limit, "_rank")
            last = good.where(F.col("_rank") == limit).select("run_date", F.col("pos").alias("_last"))
            bad = bad.join(last, "run_date", "left").where(F.col("_last").isNull() | (F.col("pos") < F.col("_last")))
            good = good.drop("_rank")
        part = good.select("run_date", "section", "pos", F.to_json("_v").alias("entry"))
        found = bad.select(
            "run_date",
            "pos",
            F.lit(0).alias("at"),
            F.format_string(f"{name}.{s}[%d]", "pos").alias("path"),
            F.lit(PLAN_ENTRY.entry).alias("message"),
        )
        out = part if out is None else out.unionByName(part)
        issues = found if issues is None else issues.unionByName(found)
    head = _head_issues(docs, checks, ["run_date"])
    return out, head.unionByName(issues).withColumn("artifact", F.lit(name))


def planning_scope(raw: DataFrame, dives: int = 2, reading: int = 3, connections: int = 3) -> DataFrame:
    """Planning scope per run as JSON text; the defaults when there is none."""
    scope = field(F.try_parse_json("raw"), "planning_scope")
    default = f'{{"deep_dive_count":{dives},"worth_reading_count":{reading},"connection_count":{connections}}}'
    return raw.select(
        "run_date", F.when(is_object(scope), F.to_json(scope)).otherwise(default).alias("planning_scope")
    )


def known_ids(desk_items: DataFrame) -> DataFrame:
    """Distinct (run, item id) of desk items."""
    ids = desk_items.select("run_date", py_strip(F.coalesce("item_id", F.lit(""))).alias("item_id"))
    return ids.where(F.col("item_id") != "").distinct()


def _split_known(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows with an unknown id). Runs without ids are not checked."""
    checked = ids.select("run_date").distinct().withColumn("_checked", F.lit(True))
    out = rows.withColumn("item_id", py_strip("item_id")).join(checked, "run_date", "left")
    out = out.join(ids.withColumn("_there", F.lit(True)), ["run_date", "item_id"], "left")
    unknown = F.coalesce(F.col("_checked"), F.lit(False)) & (F.col("item_id") != "") & F.col("_there").isNull()
    marked = out.withColumn("_unknown", unknown).drop("_checked", "_there")
    return marked.where("not _unknown").drop("_unknown"), marked.where("_unknown").drop("_unknown")


def _filter_linked(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with unknown linked ids removed, (run, pos, item id) removed)."""
    checked = ids.select("run_date").distinct().withColumn("_checked", F.lit(True))
    one = rows.select("run_date", "pos", F.posexplode("linked_item_ids").alias("_at", "item_id")).join(
        checked, "run_date", "left"
    )
    one = one.join(ids.withColumn("_there", F.lit(True)), ["run_date", "item_id"], "left")
    unknown = F.coalesce(F.col("_checked"), F.lit(False)) & F.col("_there").isNull()
    kept = one.where(~unknown).groupBy("run_date", "pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "item_id"))), lambda x: x["item_id"]).alias("_ids")
    )
    clean = (
        rows.join(kept, ["run_date", "pos"], "left")
        .withColumn("linked_item_ids", F.coalesce("_ids", F.array().cast("array<string>")))
        .drop("_ids")
    )
    return clean, one.where(unknown).select("run_date", "pos", "_at", "item_id")


def _seam_artifact(
    raw: DataFrame, desk_items: DataFrame, artifact: str, own: tuple[str, Shape], cross: tuple[str, Shape]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = raw.withColumn("_doc", F.try_parse_json("raw"))
    doc = F.col("_doc")
    ids = known_ids(desk_items)
    checks = [(~is_object(doc), F.lit(artifact), "artifact is not an object")]
    for s in (own[0], cross[0]):
        value = field(doc, s)
        checks.append((value.isNotNull() & as_list(value).isNull(), F.lit(f"{artifact}.{s}"), f"{s} is not a list"))
    head = _head_issues(docs, checks, ["run_date"])
    rows, issues = entries(docs, field(doc, own[0]), F.lit(f"{artifact}.{own[0]}"), own[1])
    rows, unknown = _split_known(rows, ids)
    # An entry with an unknown id is dropped whole: its other issues go too.
    issues = issues.join(unknown.select("run_date", "pos"), ["run_date", "pos"], "left_anti").unionByName(
        unknown.select(
            "run_date",
            "pos",
            F.lit(0).alias("at"),
            F.format_string(f"{artifact}.{own[0]}[%d].item_id", "pos").alias("path"),
            F.lit("item_id is unknown").alias("message"),
        )
    )
    linked, more = entries(docs, field(doc, cross[0]), F.lit(f"{artifact}.{cross[0]}"), cross[1])
    linked, lost = _filter_linked(linked, ids)
    lost_issues = lost.select(
        "run_date",
        "pos",
        F.col("_at").alias("at"),
        F.format_string(f"{artifact}.{cross[0]}[%d].linked_item_ids", "pos").alias("path"),
        F.concat(F.lit("unknown item_id: "), F.col("item_id")).alias("message"),
    )
    every = head.unionByName(issues).unionByName(more).unionByName(lost_issues)
    return rows, linked, every.withColumn("artifact", F.lit(artifact))


def seam_annotations(raw: DataFrame, desk_items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per-item annotations, cross-desk annotations, issues)."""
    return _seam_artifact(
        raw, desk_items, "seam_annotations", ("per_item", ANNOTATION), ("cross_domain", CROSS_ANNOTATION)
    )


def seam_candidates(raw: DataFrame, desk_items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, cross-desk candidates, issues)."""
    return _seam_artifact(
        raw,
        desk_items,
        "seam_candidates",
        ("candidates", CANDIDATE),
        ("cross_domain_candidates", CROSS_CANDIDATE),
    )


def passes_evidence_gate(evidence: Column) -> Column:
    """Two entries, two distinct sources, two excerpts at least."""
    sources = F.array_distinct(
        F.filter(F.transform(evidence, lambda x: F.lower(py_strip(x["source"]))), lambda s: s != "")
    )
    excerpts = F.filter(evidence, lambda x: py_strip(x["excerpt"]) != "")
    return (F.size(evidence) >= 2) & (F.size(sources) >= 2) & (F.size(excerpts) >= 2)


def confidence_label(c: Column) -> Column:
    low = F.lower(py_strip(F.coalesce(c, F.lit(""))))
    return F.when(low.isin("high", "medium", "low"), low).otherwise("medium")


def accepted_annotations(per_item: DataFrame, desk_items: DataFrame, most: int = 6) -> DataFrame:
    """Annotations with a valid type and evidence, on known items, capped by
    confidence; links come from the desk item."""
    from newsloom.operators.links import item_links

    valid = (
        per_item.withColumn("item_id", py_strip("item_id"))
        .withColumn("seam_type", py_strip("seam_type"))
        .where(F.col("seam_type").isin(SEAM_TYPES) & passes_evidence_gate(F.col("evidence")))
        .join(known_ids(desk_items), ["run_date", "item_id"], "left_semi")
        .drop("links")
        .withColumn("confidence", confidence_label(F.col("confidence")))
        .withColumn("one_line", py_strip("one_line"))
        .withColumn(
            "evidence",
            F.transform("evidence", lambda x: F.struct(*[py_strip(x[f]).alias(f) for f in EVIDENCE[1]])),
        )
        .join(item_links(desk_items), ["run_date", "item_id"], "left")
    )
    valid = valid.withColumn("links", F.coalesce("links", F.array().cast("array<struct<url:string,label:string>>")))
    return confidence_cap(valid, ["run_date"], most)


def accepted_cross(cross: DataFrame) -> DataFrame:
    """Cross-desk annotations that link two items or more."""
    return cross.where(F.size("linked_item_ids") >= 2).withColumn("seam_type", F.lit("cross_desk"))


def seam_projection(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contested narratives and coverage gaps, counts per run)."""
    kind = F.when(F.col("seam_type") == "selection_divergence", "coverage_gap").otherwise("contested")
    rows = annotations.select(
        "run_date",
        F.col("rank").alias("pos"),
        kind.alias("kind"),
        F.col("item_id").alias("topic"),
        F.col("one_line").alias("description"),
        "links",
        F.when(kind == "contested", F.col("seam_type")).alias("analytical_significance"),
    )
    counts = rows.groupBy("run_date").agg(F.count(F.lit(1)).alias("seam_count"))
    return rows, counts.withColumn("quiet_day", F.col("seam_count") <= 1)


def candidate_rows(
    annotations: DataFrame, most: int = 5, evidence: int = 2, text: int = 220, quote: int = 140
) -> DataFrame:
    """Candidates restated from accepted annotations, clipped and capped."""
    head = top_per_group(annotations, ["run_date"], ["rank"], most)
    return head.select(
        "run_date",
        F.col("rank").alias("pos"),
        "item_id",
        "seam_type",
        clip(F.col("one_line"), text).alias("candidate_one_line"),
        F.transform(
            F.slice("evidence", 1, evidence), lambda x: F.struct(*[clip(x[f], quote).alias(f) for f in EVIDENCE[1]])
        ).alias("possible_evidence"),
    )


def accepted_candidates(
    candidates: DataFrame, desk_items: DataFrame, most: int = 5, evidence: int = 2, text: int = 220, quote: int = 140
) -> DataFrame:
    """First candidates of a valid type on known items, texts clipped."""
    long = ["candidate_one_line", "why_it_might_matter", "drop_if_weak_reason"]
    # Clipped first, since the checks below shuffle the rows.
    short = candidates.select(
        "run_date",
        "pos",
        "item_id",
        py_strip("seam_type").alias("seam_type"),
        *[clip(F.col(c), text).alias(c) for c in long],
        F.transform(
            F.slice("possible_evidence", 1, evidence),
            lambda x: F.struct(*[clip(x[f], quote).alias(f) for f in EVIDENCE[1]]),
        ).alias("possible_evidence"),
    ).where(F.col("seam_type").isin(SEAM_TYPES))
    kept, _ = _split_known(short, known_ids(desk_items))
    head = top_per_group(kept, ["run_date"], ["pos"], most)
    return head.select("run_date", "pos", "item_id", "seam_type", *long, "possible_evidence")


def accepted_cross_candidates(cross: DataFrame, most: int = 2, text: int = 220) -> DataFrame:
    linked = cross.where(F.size("linked_item_ids") >= 2)
    head = top_per_group(linked, ["run_date"], ["pos"], most)
    return head.select(
        "run_date",
        "pos",
        clip(F.col("candidate_one_line"), text).alias("candidate_one_line"),
        "linked_item_ids",
        clip(F.col("why_it_might_matter"), text).alias("why_it_might_matter"),
    )


def audit_artifacts(
    desk_raw: DataFrame, edition_raw: DataFrame, plan_raw: DataFrame, seam_raw: DataFrame, candidate_raw: DataFrame
) -> DataFrame:
    """All contract checks over stored runs as one table of issues."""
    items, found = desk_results(desk_raw)
    cols = ["run_date", "artifact", "pos", "at", "path", "message"]
    parts = [
        found,
        edition_output(edition_raw)[1],
        edition_plan(plan_raw)[1],
        seam_annotations(seam_raw, items)[2],
        seam_candidates(candidate_raw, items)[2],
    ]
    out = None
    for p in parts:
        out = p.select(*cols) if out is None else out.unionByName(p.select(*cols))
    return out
