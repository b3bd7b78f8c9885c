"""Evidence links: outlets, corroboration, known-URL pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import let, py_strip
from newsloom.functions.urls import netloc, registered_domain
from newsloom.operators.joins import HOT_ROWS, hot_join, key_counts, mark_known


def link_domains(links: Column) -> Column:
    """Distinct outlets of a link array, sorted."""
    domains = F.transform(F.coalesce(links["url"], F.array().cast("array<string>")), registered_domain)
    return F.array_sort(F.array_distinct(F.filter(domains, lambda d: d != "")))


def depth_label(domains: Column) -> Column:
    """Corroboration label of a number of distinct outlets."""
    return F.when(domains >= 4, "widely-reported").when(domains >= 2, "corroborated").otherwise("single-source")


def supporting_links(*fields: Column) -> Column:
    """First link field that has entries."""
    return F.coalesce(*[F.when(F.size(f) > 0, f) for f in fields])


def source_depth(links: Column) -> Column:
    return depth_label(F.coalesce(F.size(link_domains(links)), F.lit(0)))


def source_depth_of_links(links: DataFrame, item: Sequence[str], url: Column) -> DataFrame:
    """Distinct outlets and label per item, from one row per link."""
    domain = registered_domain(url)
    return (
        links.groupBy(*item)
        .agg(F.count_distinct(F.when(domain != "", domain)).alias("domains"))
        .withColumn("source_depth", depth_label(F.col("domains")))
    )


# One step down the corroboration scale.
ONE_STEP_DOWN = {
    "widely-reported": "corroborated",
    "corroborated": "single-source",
    "single-source": "single-source",
}


def step_down(depth: Column) -> Column:
    out = F.when(depth == "widely-reported", "corroborated")
    return out.otherwise("single-source")


def most_common_outlet(links: Column) -> Column:
    """Outlet most links point to; first seen wins ties, "" without links."""
    with_url = F.filter(links, lambda x: F.coalesce(x["url"], F.lit("")) != "")

    def mode(domains: Column) -> Column:
        counted = F.transform(
            F.array_distinct(domains),
            lambda d, i: F.struct(
                F.size(F.filter(domains, lambda x: x == d)).alias("n"), (-i).alias("first"), d.alias("domain")
            ),
        )
        return F.array_max(counted)["domain"]

    return F.coalesce(let(F.transform(with_url, lambda x: registered_domain(x["url"])), mode), F.lit(""))


def source_names(links: Column) -> Column:
    """Distinct outlet names in link labels (text before the first colon)."""
    labels = F.filter(
        F.transform(F.coalesce(links["label"], F.array().cast("array<string>")), lambda x: py_strip(F.coalesce(x, F.lit("")))),
        lambda x: x != "",
    )
    return F.array_distinct(
        F.transform(labels, lambda x: F.when(F.instr(x, ":") > 0, py_strip(F.substring_index(x, ":", 1))).otherwise(x))
    )


def drop_blank_links(links: Column) -> Column:
    return F.filter(links, lambda x: py_strip(F.coalesce(x["url"], F.lit(""))) != "")


def prune_links(
    items: DataFrame,
    known: DataFrame,
    links: str = "links",
    key: Sequence[str] = ("run_date", "pos"),
    run: str = "run_date",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Keep the links of each item that point to known URLs, in order."""
    rows = items.select(*key, F.posexplode(links).alias("_at", "_link")).select(
        *key, "_at", "_link", F.col("_link.url").alias("url")
    )
    kept = mark_known(rows, known, run, hot_rows).where(F.col("known"))
    lists = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", "_link"))).alias("_kept"))
    kind = items.schema[links].dataType.simpleString()
    return (
        items.join(lists, list(key), "left")
        .withColumn(
            links,
            F.coalesce(F.transform("_kept", lambda x: x["_link"]), F.array().cast(kind)),
        )
        .drop("_kept")
    )


def url_desks(desk_items: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The first desk that refers to each URL; only of the (run, url) ``asked``, if given."""
    rows = desk_items.select(
        "run_date", "desk", "desk_pos", "pos", F.posexplode("links").alias("_at", "_link")
    ).withColumn("url", py_strip(F.coalesce(F.col("_link.url"), F.lit(""))))
    if asked is not None:
        rows = rows.join(asked.select("run_date", py_strip("url").alias("url")), ["run_date", "url"], "left_semi")
    return (
        rows.where(F.col("url") != "")
        .groupBy("run_date", "url")
        .agg(F.min_by("desk", F.struct("desk_pos", "pos", "_at")).alias("desk"))
    )


def domains_bridged(
    dives: DataFrame, desks: DataFrame, links: str = "further_reading", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per dive the distinct desks behind its reading, in first-seen order."""
    rows = dives.select("run_date", "pos", F.posexplode(links).alias("_at", "_link")).select(
        "run_date", "pos", "_at", py_strip(F.coalesce(F.col("_link.url"), F.lit(""))).alias("url")
    )
    on = ["run_date", "url"]
    found = hot_join(rows, desks, on, "inner", key_counts(rows, on), hot_rows)
    first = found.groupBy("run_date", "pos", "desk").agg(F.min("_at").alias("_first"))
    return first.groupBy("run_date", "pos").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_first", "desk"))), lambda x: x["desk"]
        ).alias("domains_bridged")
    )


def keep_desk_links(desk_items: DataFrame, routed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keep links whose host occurs among the items routed to the same desk."""
    hosts = (
        routed.where(F.coalesce(F.col("url"), F.lit("")) != "")
        .select("run_date", "desk", netloc(F.col("url")).alias("_host"))
        .distinct()
    )
    rows = desk_items.select(
        "run_date", "desk", "pos", F.posexplode("links").alias("_at", "_link")
    ).withColumn("_host", netloc(F.col("_link.url")))
    on = ["run_date", "desk", "_host"]
    kept = hot_join(rows, hosts, on, "left_semi", key_counts(rows, on), hot_rows)
    lists = kept.groupBy("run_date", "desk", "pos").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_link"))).alias("_kept")
    )
    kind = desk_items.schema["links"].dataType.simpleString()
    return (
        desk_items.join(lists, ["run_date", "desk", "pos"], "left")
        .withColumn("links", F.coalesce(F.transform("_kept", lambda x: x["_link"]), F.array().cast(kind)))
        .drop("_kept")
    )


def item_links(desk_items: DataFrame) -> DataFrame:
    """Links per item id; the last desk item with links wins."""
    clean = F.transform(
        drop_blank_links(F.col("links")),
        lambda x: F.struct(
            py_strip(x["url"]).alias("url"), py_strip(F.coalesce(x["label"], F.lit(""))).alias("label")
        ),
    )
    rows = desk_items.select("run_date", "item_id", "desk_pos", "pos", clean.alias("links"))
    return (
        rows.where((F.coalesce(F.col("item_id"), F.lit("")) != "") & (F.size("links") > 0))
        .groupBy("run_date", "item_id")
        .agg(F.max_by("links", F.struct("desk_pos", "pos")).alias("links"))
    )
