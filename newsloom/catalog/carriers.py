"""The given tables seen as feed items, enrichment records, feeds, editions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.catalog.registry import table

FIRST_DAY = "2024-01-01"


def items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as feed items: 14 runs, language as category."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("doc_id") % 14).cast("int")).alias("run_date"),
        F.col("doc_id").alias("pos"),
        "source",
        F.col("lang").alias("category"),
        F.col("text").alias("summary"),
        "n_chars",
    )


ITEMS_SQL = """
items AS (
  SELECT DATE '2024-01-01' + CAST(doc_id % 14 AS INTEGER) AS run_date, doc_id AS pos, source,
         lang AS category, text AS summary, n_chars
  FROM documents)
"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as enrichment records."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    status = (
        F.when(F.col("toxic") == 1, "http_error").when(F.col("quality") == 1, "ok").otherwise("normalizer_fallback")
    )
    return (
        table(spark, d, "labels")
        .join(docs, "doc_id")
        .select(
            F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("doc_id") % 14).cast("int")).alias("run_date"),
            F.col("doc_id").alias("pos"),
            "source",
            status.alias("status"),
            F.col("n_chars").alias("native_length"),
            F.when(status == "normalizer_fallback", "too_short").alias("fallback_reason"),
        )
    )


RECORDS_SQL = """
records AS (
  SELECT DATE '2024-01-01' + CAST(l.doc_id % 14 AS INTEGER) AS run_date, l.doc_id AS pos, d.source,
         CASE WHEN toxic = 1 THEN 'http_error' WHEN quality = 1 THEN 'ok' ELSE 'normalizer_fallback' END AS status,
         d.n_chars AS native_length,
         CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN NULL ELSE 'too_short' END AS fallback_reason
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


def feeds(spark: SparkSession, d: str) -> DataFrame:
    """Configured feeds: every source of the documents with a health label."""
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 6
    health = (
        F.when(number == 0, "active")
        .when(number == 1, "low_frequency")
        .when(number == 2, "headline_radar")
        .when(number == 3, "broken")
        .when(number == 4, "degraded")
        .otherwise("active")
    )
    strategy = F.when(number == 1, "browser_fetch").when(number == 2, "skip").when(number == 4, "fetch")
    return (
        table(spark, d, "documents")
        .select("source")
        .distinct()
        .select(
            F.col("source").alias("name"),
            health.alias("health"),
            F.lit("rss").alias("mode"),
            F.struct(
                strategy.alias("strategy"),
                F.lit(False).alias("skip"),
                F.lit(False).alias("fetch_article"),
                F.lit("").alias("cookies_file"),
                F.lit("").alias("skip_reason"),
                F.lit(False).alias("title_only_ok"),
            ).alias("enrich"),
        )
    )


FEEDS_SQL = """
feeds AS (
  SELECT source AS name,
         CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 6
           WHEN 1 THEN 'low_frequency' WHEN 2 THEN 'headline_radar' WHEN 3 THEN 'broken'
           WHEN 4 THEN 'degraded' ELSE 'active' END AS health,
         CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 6
           WHEN 1 THEN 'browser_fetch' WHEN 2 THEN 'skip' WHEN 4 THEN 'fetch' ELSE 'auto' END AS strategy
  FROM (SELECT DISTINCT source FROM documents))
"""


def month_runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the month they belong to as their run."""
    return table(spark, d, "orders").withColumn("run_date", F.to_date(F.date_trunc("month", "o_orderdate")))


def outlet_links(spark: SparkSession, d: str) -> DataFrame:
    """Line items as links: order = item, supplier = outlet page."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    url = F.format_string("https://www.s%d.example.org/p/%d", "l_suppkey", "l_partkey")
    return li.select(
        F.col("l_orderkey").alias("item_id"),
        F.col("l_linenumber").alias("at"),
        url.alias("url"),
        F.format_string("Supplier %d: part %d", "l_suppkey", "l_partkey").alias("label"),
        "l_suppkey",
    )
