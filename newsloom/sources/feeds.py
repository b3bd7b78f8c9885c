"""Feed payloads to items."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_feed_date
from newsloom.functions.text import clean_summary, py_strip
from newsloom.operators.ranking import cap_per_key

ENTRY_DDL = (
    "title string, link string, description string, summary string, pubDate string, published string,"
    " updated string, content array<string>, `content:encoded` string"
)
DEFAULT_CAP = 15
AGE_LIMIT = "INTERVAL 36 HOURS"


ATOM_DDL = (
    "title string, link array<struct<_href: string; _rel: string; _VALUE: string>>, summary string, published string,"
    " updated string, content array<struct<_type: string; _VALUE: string>>"
)


def _atom_entry(e: Column) -> Column:
    """An Atom entry with the fields of ``ENTRY_DDL``.

    Its link is the first alternate one (a link without relation is one), else
    the first of all.
    """
    links = F.filter(e["link"], lambda x: x["_href"].isNotNull())
    usual = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    none = F.lit(None).cast("string")
    return F.struct(
        e["title"].alias("title"),
        F.coalesce(F.get(usual, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"]).alias("link"),
        none.alias("description"),
        e["summary"].alias("summary"),
        none.alias("pubDate"),
        e["published"].alias("published"),
        e["updated"].alias("updated"),
        F.transform(e["content"], lambda x: x["_VALUE"]).alias("content"),
        none.alias("content:encoded"),
    )


def read_feed_xml(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of landed feed files; ``entry`` is the row tag of Atom."""
    ddl = ATOM_DDL.replace(";", ",") if row_tag == "entry" else ENTRY_DDL
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(ddl).load(path)
    if row_tag != "entry":
        return rows
    return rows.select(_atom_entry(F.struct(*rows.columns)).alias("_e")).select("_e.*")


def _document(payload: str) -> Column:
    """A landed feed: RSS has its items in a channel or at the root, Atom its entries."""
    item = f"array<struct<{_typed(ENTRY_DDL)}>>"
    kind = f"channel struct<item: {item}>, item {item}, entry array<struct<{_typed(ATOM_DDL)}>>"
    return F.from_xml(F.col(payload), F.lit(kind), {"mode": "PERMISSIVE"})


def _entries(doc: Column) -> Column:
    none = F.array().cast(f"array<struct<{_typed(ENTRY_DDL)}>>")
    return F.concat(
        F.coalesce(doc["channel"]["item"], none), F.coalesce(doc["item"], none), F.coalesce(F.transform(doc["entry"], _atom_entry), none)
    )


def parse_payloads(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Entries of landed RSS and Atom documents held in a string column, in order."""
    rest = [c for c in payloads.columns if c != payload]
    parsed = payloads.select(*rest, _document(payload).alias("_doc"))
    rows = parsed.select(*rest, F.posexplode(_entries(F.col("_doc"))).alias("pos", "_e"))
    return rows.select(*rest, "pos", "_e.*")


def payload_issues(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Landed documents without any entry: no feed, or an empty one."""
    rest = [c for c in payloads.columns if c != payload]
    given = F.coalesce(F.trim(F.col(payload)), F.lit("")) != ""
    parsed = payloads.select(*rest, given.alias("_given"), _document(payload).alias("_doc"))
    issue = F.when(F.col("_given"), "no entries").otherwise("empty payload")
    return parsed.where(F.size(_entries(F.col("_doc"))) <= 0).select(*rest, issue.alias("issue"))


def _typed(ddl: str) -> str:
    parts = [p.strip().split(" ", 1) for p in ddl.split(",")]
    return ", ".join(f"{name}: {kind}" for name, kind in parts).replace(";", ",")


def entry_body() -> Column:
    """First field of an entry that is not blank: content, summary, description."""
    texts = F.concat(
        F.coalesce("content", F.array().cast("array<string>")),
        F.array(F.col("`content:encoded`"), F.col("summary"), F.col("description")),
    )
    kept = F.filter(texts, lambda t: py_strip(F.coalesce(t, F.lit(""))) != "")
    return F.coalesce(F.get(kept, F.lit(0)), F.lit(""))


def recent(published: Column, now: Column) -> Column:
    """Not older than the age limit; undated entries count as recent."""
    return published.isNull() | (published >= now - F.expr(AGE_LIMIT))


def feed_items(entries: DataFrame, now: Column, caps: Mapping[str, int] | None = None) -> DataFrame:
    """Items from feed entries: dated, cleaned, aged out, then capped.

    ``entries``: run_date, source, pos and the entry fields, with category and
    tag of the feed. The age limit comes before the cap.
    """
    dated = entries.withColumn("published_at", parse_feed_date(F.col("pubDate"), F.col("published"), F.col("updated")))
    fresh = dated.where(recent(F.col("published_at"), now))
    capped = cap_per_key(fresh, ["run_date"], "source", ["pos"], caps or {}, DEFAULT_CAP)
    body = entry_body()
    return capped.select(
        "run_date",
        "source",
        "pos",
        py_strip(F.coalesce("title", F.lit(""))).alias("title"),
        F.coalesce("link", F.lit("")).alias("url"),
        F.col("published_at").alias("published"),
        now.alias("fetched_at"),
        F.lit(None).cast("string").alias("freshness"),
        clean_summary(body).alias("summary"),
        F.when(body != "", body).alias("rss_body"),
        "category",
        "tag",
    )


AGGREGATOR_DDL = (
    "items array<struct<origin: struct<title: string>, title: string, alternate: array<struct<href: string>>,"
    " published: bigint, summary: struct<content: string>>>"
)


def aggregator_items(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Items from an aggregator's JSON answer (one document per run)."""
    doc = F.from_json(payload, AGGREGATOR_DDL)
    rows = payloads.select("run_date", F.posexplode(doc["items"]).alias("pos", "e"))
    links = F.filter("e.alternate", lambda a: a["href"].isNotNull())
    return rows.select(
        "run_date",
        "pos",
        F.coalesce("e.origin.title", F.lit("RSS")).alias("source"),
        py_strip(F.coalesce("e.title", F.lit(""))).alias("title"),
        F.coalesce(F.get(links, F.lit(0))["href"], F.lit("")).alias("url"),
        F.timestamp_seconds(F.coalesce("e.published", F.lit(0))).alias("published"),
        clean_summary(F.coalesce("e.summary.content", F.lit(""))).alias("summary"),
    )
