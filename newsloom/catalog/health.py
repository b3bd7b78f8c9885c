"""Feed metrics and source health over documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.carriers import FEEDS_SQL, ITEMS_SQL, RECORDS_SQL, feeds, items, records
from newsloom.catalog.registry import query
from newsloom.operators.metrics import (
    enrich_rates,
    feed_metrics,
    last_nonempty_date,
    merge_enrich_rates,
    source_counts,
    status_histogram,
    tier_outcomes,
)
from newsloom.plans.health import audit_lines, feed_recommendations, health_lines, source_health
from newsloom.sources.tables import latest_run, run_before, window_of

METRICS_SQL = """
metrics AS (
  SELECT source, CAST(count(*) AS BIGINT) AS items, CAST(trunc(avg(length(summary))) AS BIGINT) AS mean_chars,
         CAST(trunc(median(length(summary))) AS BIGINT) AS median_chars,
         CAST(list_sort(list(length(summary)))[1 + CAST(round_even(0.1::DOUBLE * (count(*) - 1), 0) AS BIGINT)] AS BIGINT) AS p10_chars,
         CAST(count(*) FILTER (length(summary) = 0) AS BIGINT) AS empty_count,
         count(*) FILTER (length(summary) = 0)::DOUBLE / count(*) AS empty_rate
  FROM {src} GROUP BY source)
"""

RATES_SQL = """
rates AS (
  SELECT source, CAST(count(*) AS BIGINT) AS enrichment_attempts,
         avg(CASE WHEN status = 'ok' THEN 1.0::DOUBLE ELSE 0 END) AS success_rate,
         avg(CASE WHEN status = 'http_error' THEN 1.0::DOUBLE ELSE 0 END) AS http_error_rate,
         avg(CASE WHEN status = 'normalizer_fallback' THEN 1.0::DOUBLE ELSE 0 END) AS normalizer_fallback_rate,
         CAST(trunc(avg(native_length)) AS BIGINT) AS native_mean_chars,
         CAST(trunc(median(native_length)) AS BIGINT) AS native_median_chars
  FROM {src} GROUP BY source)
"""


@query(
    "feed_metrics",
    f"WITH {ITEMS_SQL}, {METRICS_SQL.format(src='items')} SELECT source, items, mean_chars, median_chars, p10_chars, "
    "empty_count, round(empty_rate, 6) AS empty_rate FROM metrics",
)
def _feed_metrics(spark, d):
    return feed_metrics(items(spark, d)).withColumn("empty_rate", F.round("empty_rate", 6))


@query(
    "enrich_rates",
    f"""WITH {ITEMS_SQL}, {RECORDS_SQL}, {METRICS_SQL.format(src='items')}, {RATES_SQL.format(src='records')}
    SELECT m.source, CAST(coalesce(enrichment_attempts, 0) AS BIGINT) AS enrichment_attempts,
           round(success_rate, 6) AS success_rate, round(http_error_rate, 6) AS http_error_rate,
           round(normalizer_fallback_rate, 6) AS normalizer_fallback_rate,
           CAST(coalesce(native_mean_chars, 0) AS BIGINT) AS native_mean_chars,
           CAST(coalesce(native_median_chars, 0) AS BIGINT) AS native_median_chars
    FROM metrics m LEFT JOIN rates r ON m.source = r.source""",
)
def _enrich_rates(spark, d):
    out = merge_enrich_rates(feed_metrics(items(spark, d)), enrich_rates(records(spark, d)))
    return out.select(
        "source",
        "enrichment_attempts",
        *[F.round(c, 6).alias(c) for c in ("success_rate", "http_error_rate", "normalizer_fallback_rate")],
        "native_mean_chars",
        "native_median_chars",
    )


@query(
    "tier_outcomes",
    f"""WITH {RECORDS_SQL}, {FEEDS_SQL}
    SELECT run_date, coalesce(health, 'active') AS tier, CAST(count(*) AS BIGINT) AS records,
           CAST(count(*) AS BIGINT) AS attempted,
           CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS succeeded,
           CAST(0 AS BIGINT) AS skipped_by_cap,
           CAST(count(*) FILTER (status LIKE '%fallback%' OR coalesce(fallback_reason, '') <> '') AS BIGINT) AS fallback
    FROM records LEFT JOIN feeds ON source = name GROUP BY ALL""",
)
def _tier_outcomes(spark, d):
    dims = feeds(spark, d).select(F.col("name").alias("source"), F.col("health").alias("tier"))
    return tier_outcomes(records(spark, d).join(dims, "source", "left"))


@query(
    "status_histogram",
    f"WITH {RECORDS_SQL} SELECT run_date, status, CAST(count(*) AS BIGINT) AS records FROM records GROUP BY ALL",
)
def _status_histogram(spark, d):
    return status_histogram(records(spark, d))


@query(
    "source_counts",
    f"""WITH {ITEMS_SQL} SELECT run_date, CAST(count(*) FILTER (category = 'en') AS BIGINT) AS en_items,
    CAST(count(*) FILTER (category = 'fr') AS BIGINT) AS fr_items,
    CAST(count(*) FILTER (category = 'de') AS BIGINT) AS de_items, CAST(count(*) FILTER (category = 'es') AS BIGINT) AS es_items FROM items GROUP BY run_date""",
)
def _source_counts(spark, d):
    return source_counts(items(spark, d), ["en", "fr", "de", "es"], kind="category")


@query(
    "last_nonempty_date",
    f"WITH {ITEMS_SQL} SELECT source, max(run_date) AS last_nonempty_date FROM items GROUP BY source",
)
def _last_nonempty(spark, d):
    return last_nonempty_date(items(spark, d))


@query(
    "window_load",
    f"""WITH {ITEMS_SQL} SELECT run_date, CAST(count(*) AS BIGINT) AS items FROM items
    WHERE run_date >= DATE '2024-01-14' - 7 GROUP BY run_date""",
)
def _window_load(spark, d):
    recent = window_of(items(spark, d), "2024-01-14", 7)
    return recent.groupBy("run_date").agg(F.count(F.lit(1)).alias("items"))


@query(
    "latest_run",
    f"""WITH {ITEMS_SQL} SELECT run_date, source, CAST(count(*) AS BIGINT) AS items FROM items
    WHERE run_date = (SELECT max(run_date) FROM items) GROUP BY ALL""",
)
def _latest_run(spark, d):
    return latest_run(items(spark, d)).groupBy("run_date", "source").agg(F.count(F.lit(1)).alias("items"))


@query(
    "run_before",
    f"""WITH {ITEMS_SQL} SELECT run_date, source, CAST(count(*) AS BIGINT) AS items FROM items
    WHERE run_date = (SELECT max(run_date) FROM items WHERE run_date < DATE '2024-01-10') GROUP BY ALL""",
)
def _run_before(spark, d):
    rows = run_before(items(spark, d), "2024-01-10")
    return rows.groupBy("run_date", "source").agg(F.count(F.lit(1)).alias("items"))


HEALTH_SQL = f"""
WITH {ITEMS_SQL}, {RECORDS_SQL}, {FEEDS_SQL},
recent_items AS (SELECT * FROM items WHERE run_date >= DATE '2024-01-14' - 10),
recent_records AS (SELECT * FROM records WHERE run_date >= DATE '2024-01-14' - 10),
{METRICS_SQL.format(src='recent_items')}, {RATES_SQL.format(src='recent_records')},
seen AS (SELECT source, max(run_date) AS last_nonempty_date FROM recent_items GROUP BY source),
j AS (
  SELECT name, health, coalesce(items, 0) AS items, coalesce(median_chars, 0) AS median_chars,
         coalesce(empty_rate, 0) AS empty_rate, success_rate, http_error_rate AS he,
         normalizer_fallback_rate AS fb, last_nonempty_date
  FROM feeds LEFT JOIN metrics m ON name = m.source LEFT JOIN rates r ON name = r.source
  LEFT JOIN seen s ON name = s.source),
c AS (
  SELECT *, CASE
    WHEN he >= 0.5 AND health IN ('active', 'low_frequency') THEN 'degraded'
    WHEN (fb >= 0.5 OR (median_chars < 100 AND items > 0)) AND health IN ('active', 'low_frequency') THEN 'enrichment_required'
    WHEN items > 0 AND health = 'broken' THEN 'degraded'
    WHEN items = 0 AND health = 'active' THEN 'degraded'
    WHEN items > 0 AND items <= 3 AND health = 'active' THEN 'low_frequency'
    ELSE health END AS computed_health,
    CASE WHEN items > 0 AND health = 'broken' THEN 'Broken feed produced items; review for recovery'
         WHEN items = 0 THEN 'Zero items in 10-day window'
         WHEN items <= 3 THEN 'Very low volume (' || items || ' items in 10 days)' END AS o1,
    CASE WHEN median_chars < 100 AND items > 0 THEN 'Short RSS bodies (median ' || median_chars || ' chars)' END AS o2,
    CASE WHEN fb >= 0.5 THEN 'High normalizer fallback rate (' || CAST(floor(fb * 100) AS INTEGER) || '%)' END AS o3,
    CASE WHEN he >= 0.5 THEN 'High HTTP error rate (' || CAST(floor(he * 100) AS INTEGER) || '%)' END AS o4
  FROM j),
rank AS (SELECT * FROM (VALUES ('active', 0), ('low_frequency', 1), ('headline_radar', 1),
  ('enrichment_required', 2), ('degraded', 3), ('broken', 4)) AS t(label, sev))
"""


@query(
    "source_health",
    HEALTH_SQL
    + """SELECT name, health, computed_health, CAST(items AS BIGINT) AS items, CAST(median_chars AS BIGINT) AS median_chars,
    round_even(empty_rate, 2) AS empty_rate, round_even(success_rate, 2) AS enrichment_success_rate,
    round_even(fb, 2) AS normalizer_fallback_rate, last_nonempty_date,
    CASE WHEN health = computed_health THEN 'unchanged' WHEN b.sev > a.sev THEN 'worse'
         WHEN b.sev < a.sev THEN 'better' ELSE 'changed' END AS status_transition,
    concat_ws('; ', o1, o2, o3, o4) AS observations
    FROM c JOIN rank a ON health = a.label JOIN rank b ON computed_health = b.label""",
)
def flagship(spark, d):
    report = source_health(feeds(spark, d), items(spark, d), records(spark, d), "2024-01-14", 10)
    return report.withColumn("observations", F.array_join("observations", "; "))


@query(
    "health_report",
    HEALTH_SQL
    + """SELECT name, '| ' || name || ' | ' || health || ' | ' || computed_health || ' | ' || CASE WHEN health = computed_health THEN 'unchanged' WHEN b.sev > a.sev THEN 'worse'
         WHEN b.sev < a.sev THEN 'better' ELSE 'changed' END || ' | ' || items || ' | ' || median_chars || ' | ' || coalesce(CAST(last_nonempty_date AS VARCHAR), 'never') || ' | ' ||
         CASE WHEN concat_ws('; ', o1, o2, o3, o4) = '' THEN '—' ELSE concat_ws('; ', o1, o2, o3, o4) END || ' |' AS line
    FROM c JOIN rank a ON health = a.label JOIN rank b ON computed_health = b.label""",
)
def _health_lines(spark, d):
    report = source_health(feeds(spark, d), items(spark, d), records(spark, d), "2024-01-14", 10)
    return health_lines(report)


RECOMMEND_SQL = f"""
WITH {ITEMS_SQL}, {RECORDS_SQL}, {FEEDS_SQL}, {METRICS_SQL.format(src='items')}, {RATES_SQL.format(src='records')},
r AS (
  SELECT m.source, items, median_chars, empty_rate, strategy, health,
    CASE WHEN strategy = 'skip' AND (median_chars < 80 OR empty_rate > 0) THEN 'define skip policy or retire'
         WHEN strategy = 'skip' THEN 'ok (intentionally skipped)'
         WHEN strategy = 'fetch' THEN 'ok (enrichment working)'
         WHEN median_chars < 200 OR empty_rate > 0.2 THEN 'strategy: "fetch"'
         ELSE 'ok' END AS recommend,
    http_error_rate, normalizer_fallback_rate, enrichment_attempts
  FROM metrics m JOIN feeds ON m.source = name LEFT JOIN rates q ON m.source = q.source)
"""


@query(
    "feed_recommendation",
    RECOMMEND_SQL + "SELECT source, items, median_chars, strategy, health, recommend FROM r",
)
def _recommend(spark, d):
    merged = merge_enrich_rates(feed_metrics(items(spark, d)), enrich_rates(records(spark, d)))
    out = feed_recommendations(merged, feeds(spark, d))
    return out.select("source", "items", "median_chars", "strategy", "health", "recommend")


@query(
    "audit_report",
    RECOMMEND_SQL
    + """, p AS (SELECT *, CAST(floor(empty_rate * 100) AS INTEGER) || '%' AS e,
      CASE WHEN enrichment_attempts IS NULL THEN '--' ELSE '0%' END AS z,
      coalesce(CAST(floor(http_error_rate * 100) AS INTEGER) || '%', '--') AS h,
      coalesce(CAST(floor(normalizer_fallback_rate * 100) AS INTEGER) || '%', '--') AS f FROM r)
    SELECT median_chars, source, '| ' || source || ' | ' || items || ' | ' || median_chars || ' | ' || e || ' | ' || z ||
      ' | ' || h || ' | ' || z || ' | ' || f || ' | rss | ' || strategy || ' | ' || health || ' |  | ' || recommend || ' |' AS line FROM p""",
)
def _audit(spark, d):
    merged = merge_enrich_rates(feed_metrics(items(spark, d)), enrich_rates(records(spark, d)))
    return audit_lines(feed_recommendations(merged, feeds(spark, d)))
