"""Enrichment planning, cache and summaries over documents, events, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.carriers import FEEDS_SQL, feeds
from newsloom.catalog.registry import query, table
from newsloom.plans import enrich as E
from newsloom.session import cut

NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def _items(spark, d):
    """Documents as one run of items; one URL per hundred copies of a title."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.lit("2024-01-30").cast("date").alias("run_date"),
        F.col("doc_id").alias("pos"),
        "source",
        F.concat(F.lit("http://n.org/"), F.md5("text")).alias("url"),
        F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.col("text")).alias("rss_body"),
        F.lit("").alias("summary"),
    )


def _feeds(spark, d):
    return feeds(spark, d).withColumn("priority", F.regexp_extract("name", r"(\d+)$", 1).cast("int") % 4)


CAND_SQL = f"""
{FEEDS_SQL}, raw AS (SELECT doc_id AS pos, source, 'http://n.org/' || md5(text) AS url, CASE WHEN doc_id % 6 = 0 THEN '' ELSE text END AS body,
  row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents),
lines AS (SELECT *, array_to_string(list_filter(list_transform(regexp_split_to_array(body, '\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM raw WHERE rn = 1),
c AS (SELECT pos, url, source, text, health AS tier, strategy, length(text) AS n,
  CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 4 WHEN 0 THEN 5 ELSE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 4 END AS prio
  FROM lines JOIN feeds ON source = name),
p AS (SELECT *, CASE WHEN strategy IN ('skip', 'browser_fetch') THEN false WHEN strategy = 'fetch' THEN true ELSE n < 200 END AS need,
  CASE WHEN strategy = 'skip' THEN 5 WHEN text = '' THEN 0 WHEN strategy IN ('fetch', 'browser_fetch') THEN 1 WHEN prio <= 2 THEN 2 ELSE 3 END AS p0,
  CASE WHEN strategy = 'skip' THEN 1 WHEN text = '' OR strategy IN ('fetch', 'browser_fetch') THEN 0 ELSE prio END AS p1,
  CASE WHEN strategy <> 'skip' AND text = '' THEN 0 ELSE n END AS p2 FROM c)
"""


@query(
    "enrich_candidates",
    f"""WITH {CAND_SQL} SELECT pos, url, tier, strategy, CAST(n AS BIGINT) AS native_length, need AS http_needed, p0, p1,
      CASE WHEN strategy = 'skip' THEN 'skip' WHEN text = '' THEN 'empty_native_text' WHEN strategy IN ('fetch', 'browser_fetch') THEN 'explicit_' || strategy
        WHEN prio <= 2 THEN 'high_priority_feed' ELSE 'short_native_text' END AS priority_reason FROM p""",
)
def _candidates(spark, d):
    c = E.candidates(_items(spark, d), _feeds(spark, d))
    return c.select("pos", "url", "tier", "strategy", "native_length", "http_needed", "p0", "p1", "priority_reason")


@query(
    "enrich_budget",
    f"""WITH {CAND_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY p0, p1, p2, pos) AS rn,
      CASE tier WHEN 'active' THEN 10 WHEN 'low_frequency' THEN 10 WHEN 'degraded' THEN 3 ELSE 0 END AS cap FROM p WHERE need)
    SELECT p.pos, coalesce(rn <= cap, false) AS http_allowed FROM p LEFT JOIN b ON p.pos = b.pos""",
)
def _budget(spark, d):
    caps = {"active": 10, "low_frequency": 10, "degraded": 3}
    cands = cut(E.candidates(_items(spark, d), _feeds(spark, d)).select(*E.PLANNED))
    out, _, _ = E.budgets(cands, caps, {})
    return out.select("pos", "http_allowed")


def _cache(spark, d):
    """Events as cache entries: user = URL, type = status."""
    e = table(spark, d, "events")
    kind = F.col("event_type")
    origin = F.when(F.col("event_id") % 3 == 0, "fetched_html").otherwise("rss_body")
    return e.select(
        F.format_string("http://u%d/", "user_id").alias("url"),
        F.sha1(F.format_string("http://u%d/", "user_id")).alias("url_sha1"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
        F.when(kind == "error", "paywall").otherwise("ok").alias("status"),
        F.lit(200).alias("http_status"),
        F.col("event_id").alias("raw_length"),
        F.lit(0).cast("bigint").alias("summary_length"),
        kind.alias("canonical_summary"),
        origin.alias("source_text_origin"),
        F.lit("").alias("source_name"),
        F.lit("").alias("error"),
        F.lit("").alias("fallback_reason"),
        F.lit("").alias("rejected_summary_preview"),
        F.when(F.col("event_id") % 11 == 0, E.CACHE_VERSION - 1).otherwise(E.CACHE_VERSION).alias("cache_version"),
        E.component_version(origin).alias("component_version"),
    )


CACHE_SQL = f"""
k AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'paywall' ELSE 'ok' END AS status,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events)
"""


@query(
    "cache_lookup",
    f"""WITH {CACHE_SQL}, v AS (SELECT * FROM k WHERE rn = 1 AND event_id % 11 <> 0 AND ((status = 'ok' AND ts >= {NOW_SQL} - INTERVAL 1 DAY) OR (status <> 'ok' AND ts >= {NOW_SQL} - INTERVAL 5 HOUR)))
    SELECT c_custkey, status AS cached_status, CAST(event_id AS BIGINT) AS raw_length FROM customer LEFT JOIN v ON c_custkey = user_id""",
)
def _lookup(spark, d):
    asks = table(spark, d, "customer").select("c_custkey", F.format_string("http://u%d/", "c_custkey").alias("url"))
    out = E.cache_lookup(asks, _cache(spark, d), _now(), ttl_days=1, backoff_hours=5)
    return out.select("c_custkey", F.col("cached.status").alias("cached_status"), F.col("cached.raw_length").alias("raw_length"))


@query(
    "cache_upsert",
    f"WITH {CACHE_SQL} SELECT 'http://u' || user_id || '/' AS url, status, CAST(event_id AS BIGINT) AS raw_length FROM k WHERE rn = 1",
)
def _upsert(spark, d):
    c = _cache(spark, d)
    old, new = c.where("raw_length % 2 = 0"), c.where("raw_length % 2 = 1")
    return E.cache_upsert(old, new).select("url", "status", "raw_length")


@query(
    "cache_prune",
    f"SELECT CAST(count(*) AS BIGINT) AS kept FROM events WHERE ts >= {NOW_SQL} - INTERVAL 10 DAY",
)
def _prune(spark, d):
    return E.cache_prune(_cache(spark, d), _now(), 10).agg(F.count(F.lit(1)).alias("kept"))


SUMMARY_SQL = """
t AS (SELECT doc_id, text AS s, trim(text, ' ' || chr(10) || chr(9)) AS full_text FROM documents),
o AS (SELECT doc_id, s, CASE WHEN length(replace(s, chr(13), '')) > 700 THEN trim(rtrim(substr(s, 1, 699), ' ' || chr(10) || chr(9)) || '…', ' ' || chr(10) || chr(9)) ELSE full_text END AS own FROM t)
"""


@query(
    "canonical_summary",
    f"""WITH {SUMMARY_SQL} SELECT doc_id, CASE WHEN length(s) >= 800 THEN 'normalizer_fallback' ELSE 'ok' END AS status,
      CASE WHEN length(s) >= 800 THEN 'no_model_config' ELSE '' END AS fallback_reason, md5(own) AS digest FROM o""",
)
def _summary(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.lit("r").alias("run_date"), F.col("doc_id").cast("string").alias("url"), "text", F.lit("rss_body").alias("origin")
    )
    out = E.canonical_summary(docs)
    return out.select("doc_id", "status", "fallback_reason", F.md5("canonical").alias("digest"))


@query(
    "model_summary",
    """SELECT doc_id, 'ok' AS status, '' AS fallback_reason, CASE WHEN length(text) >= 800 THEN 'opening' END AS model,
      CASE WHEN length(text) >= 800 THEN CAST(length(text) // 4 AS BIGINT) END AS tokens_in FROM documents""",
)
def _model(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.lit("r").alias("run_date"), F.col("doc_id").cast("string").alias("url"), "text", F.lit("rss_body").alias("origin")
    )
    out = E.canonical_summary(docs, E.truncating_model)
    return out.select("doc_id", "status", "fallback_reason", "model", "tokens_in")


def _landed(spark, d, name: str):
    """Pages as landed fetch results for the items' URLs."""
    docs = table(spark, d, "documents")
    url = F.concat(F.lit("http://n.org/"), F.md5("text"))
    ok = F.min("doc_id") % (3 if name == "http" else 2) != 0
    return docs.groupBy(url.alias("url")).agg(F.max("text").alias("text"), ok.alias("ok")).select(
        "url",
        F.when(F.col("ok"), F.col("text")).otherwise("").alias("text"),
        F.when(F.col("ok"), "ok").otherwise("http_error" if name == "http" else "browser_timeout").alias("status"),
        F.when(F.col("ok"), 200).otherwise(503).alias("http_status"),
        F.when(F.col("ok"), F.length("text")).otherwise(0).cast("bigint").alias("length"),
        F.when(F.col("ok"), "").otherwise("failed").alias("error"),
    )


# What a page or an HTTP answer may replace; the smallest id of equal texts decides what was landed.
RESOLVE_SQL = f"""
{CAND_SQL}, q AS (SELECT p.pos, p.url, p.text, strategy, n, need AND tier IN ('active', 'low_frequency') AS may_http, pos % 3 <> 0 AS ok_h, pos % 2 <> 0 AS ok_b,
    (strategy = 'browser_fetch' OR (strategy = 'auto' AND p.text = '')) AND tier IN ('active', 'low_frequency') AS may_page, d.text AS landed
  FROM p JOIN documents d ON d.doc_id = p.pos),
s AS (SELECT *, may_page AND strategy = 'browser_fetch' AS first_page FROM q),
x AS (SELECT *, CASE WHEN first_page AND ok_b THEN 'page' WHEN first_page AND text = '' THEN 'no page' WHEN may_http AND ok_h THEN 'web' WHEN may_http AND may_page AND ok_b THEN 'second page'
    WHEN may_http AND may_page AND text <> '' THEN 'both failed' WHEN may_http AND may_page THEN 'no page' WHEN may_http AND text <> '' THEN 'web failed' WHEN may_http THEN 'no web' ELSE 'own' END AS way FROM s),
z AS (SELECT pos, CASE WHEN way IN ('page', 'no page', 'second page') THEN 'browser_markdown' WHEN way IN ('web', 'no web') THEN 'fetched_html' ELSE CASE WHEN text = '' THEN 'none' ELSE 'rss_body' END END AS origin,
    way IN ('no page', 'no web') AS terminal, CASE way WHEN 'no page' THEN 'browser_timeout' WHEN 'no web' THEN 'http_error' END AS terminal_status,
    CASE WHEN way IN ('page', 'second page', 'web') THEN length(landed) ELSE 0 END::BIGINT AS fetched_length,
    CASE WHEN way IN ('page', 'second page', 'web') THEN 200 WHEN way IN ('no page', 'no web') THEN 503 END AS http_status,
    md5(CASE WHEN way IN ('no page', 'no web') THEN '' WHEN way IN ('page', 'second page', 'web') THEN landed ELSE text END) AS digest,
    CASE way WHEN 'second page' THEN 'fetch http_error: failed' WHEN 'web failed' THEN 'fetch http_error: failed' WHEN 'both failed' THEN 'fetch http_error: failed; browser browser_timeout: failed'
      WHEN 'no page' THEN 'failed' WHEN 'no web' THEN 'failed' WHEN 'page' THEN '' ELSE CASE WHEN first_page AND NOT ok_b THEN 'browser browser_timeout: failed' ELSE '' END END AS fetch_error FROM x)
"""


def _resolved(spark, d):
    http, page = E.default_caps(100000, 100000)
    cands = cut(E.candidates(_items(spark, d), _feeds(spark, d), browser=True).select(*E.PLANNED, "native_text"))
    planned, _, _ = E.budgets(cands.select(*E.PLANNED), http, page)
    decided = E.decide_source(planned, _landed(spark, d, "http"), _landed(spark, d, "browser"))
    return E.take_text(decided, cands)


@query("source_text_items", f"WITH {RESOLVE_SQL} SELECT * FROM z")
def _resolved_items(spark, d):
    columns = ["pos", "origin", "terminal", "terminal_status", "fetched_length", "http_status", "fetch_error"]
    return _resolved(spark, d).select(*columns, F.md5("text").alias("digest"))


@query(
    "source_text_resolution",
    f"""WITH {RESOLVE_SQL} SELECT origin, terminal, terminal_status, count(*) AS items, CAST(sum(fetched_length) AS BIGINT) AS fetched FROM z GROUP BY origin, terminal, terminal_status""",
)
def _resolve(spark, d):
    return _resolved(spark, d).groupBy("origin", "terminal", "terminal_status").agg(
        F.count(F.lit(1)).alias("items"), F.sum("fetched_length").alias("fetched")
    )


@query("enrich_run")
def _run(spark, d):
    cache = _cache(spark, d)
    items, records, _, _ = E.enrich_run(
        _items(spark, d),
        _feeds(spark, d),
        cache,
        _landed(spark, d, "http"),
        _landed(spark, d, "browser"),
        _now(),
        E.default_caps(50, 10),
        use_browser=True,
    )
    return records.groupBy("tier", "status", "source_text_origin").agg(
        F.count(F.lit(1)).alias("records"), F.sum("summary_length").alias("summary_chars")
    )
