"""Anomaly checks, phrase reuse and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.carriers import ITEMS_SQL, items
from newsloom.catalog.registry import query, table
from newsloom.catalog.texts import WORD_SQL
from newsloom.operators import anomaly as A
from newsloom.operators import phrases as P
from newsloom.operators.selection import diverse_top
from newsloom.session import cut

TAG_SQL = "CASE p_type WHEN 'ECONOMY' THEN 'war' WHEN 'SMALL' THEN 'ai' WHEN 'PROMO' THEN 'defense' ELSE 'econ' END"


def _tag(c: str):
    kind = F.col(c)
    return F.when(kind == "ECONOMY", "war").when(kind == "SMALL", "ai").when(kind == "PROMO", "defense").otherwise("econ")


@query(
    "category_skew",
    f"""WITH g AS (SELECT p_brand || '/' || p_size AS run_date, {TAG_SQL} AS tag FROM part),
    c AS (SELECT run_date, count(*) AS total FROM g GROUP BY run_date HAVING count(*) > 5)
    SELECT c.run_date, CAST(total AS BIGINT) AS total, t.tag FROM c CROSS JOIN (VALUES ('war'), ('ai'), ('defense')) AS t(tag)
    WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.run_date = c.run_date AND g.tag = t.tag)""",
)
def _skew(spark, d):
    g = table(spark, d, "part").select(
        F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("run_date"), _tag("p_type").alias("tag")
    )
    return A.category_skew(g)


ABSENCE_SQL = f"""
{ITEMS_SQL}, it AS (SELECT run_date, category, 'http://h' || (pos % 40) || '.org/' || pos AS url, pos FROM items),
cov AS (SELECT run_date, 'http://h' || (pos % 40) || '.org/x' AS url, category FROM items WHERE pos % 9 = 0),
cnt AS (SELECT run_date, category, count(*) AS items FROM it GROUP BY ALL HAVING count(*) >= 3),
met AS (SELECT DISTINCT a.run_date, a.category FROM it a JOIN cov b ON a.run_date = b.run_date
  AND regexp_extract(a.url, '//([^/]*)', 1) = regexp_extract(b.url, '//([^/]*)', 1)),
miss AS (SELECT c.run_date, c.category, CAST(items AS BIGINT) AS items,
  EXISTS (SELECT 1 FROM cov WHERE cov.run_date = c.run_date AND cov.category = c.category) AS selected
  FROM cnt c WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.run_date = c.run_date AND m.category = c.category))
"""


def _absence_inputs(spark, d):
    base = items(spark, d)
    it = base.select("run_date", "category", F.format_string("http://h%d.org/%d", F.col("pos") % 40, "pos").alias("url"))
    cov = base.where("pos % 9 = 0").select(
        "run_date", F.format_string("http://h%d.org/x", F.col("pos") % 40).alias("url"), "category"
    )
    return it, cov


@query("source_absence", f"WITH {ABSENCE_SQL} SELECT run_date, category, items, selected FROM miss")
def _absence(spark, d):
    return A.source_absence(*_absence_inputs(spark, d))


@query(
    "absence_report",
    f"""WITH {ABSENCE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY items DESC, category) AS rn FROM miss)
    SELECT run_date, 'source_absence' AS "check", 'warning' AS severity, format('Category ''{{}}'' (active) had {{}} raw items but contributed 0 items to analysis outputs — case: {{}}', category, items,
      CASE WHEN selected THEN 'desk_selected_but_cross_domain_omitted' ELSE 'raw_present_but_not_selected_by_desk' END) AS detail FROM r WHERE rn <= 1
    UNION ALL SELECT run_date, 'source_absence', 'warning', count(*) || ' additional categories had raw items with no domain-analysis coverage: ' ||
      string_agg(category || ' (' || items || ')', ', ' ORDER BY rn) FILTER (rn <= 6) FROM r WHERE rn > 1 GROUP BY run_date""",
)
def _absence_report(spark, d):
    health = A.category_health(items(spark, d).select("category").distinct().withColumn("health", F.lit("active")))
    return A.absence_report(A.source_absence(*_absence_inputs(spark, d)), health, most=1)


@query(
    "category_health",
    """WITH f AS (SELECT p_brand AS category, CASE p_size % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'low_frequency' WHEN 2 THEN 'degraded'
        WHEN 3 THEN 'headline_radar' ELSE CASE WHEN p_partkey % 50 = 0 THEN 'broken' ELSE 'active' END END AS health FROM part),
    c AS (SELECT category, health, count(*) AS n FROM f GROUP BY ALL),
    s AS (SELECT *, CASE health WHEN 'low_frequency' THEN 1 WHEN 'headline_radar' THEN 1 WHEN 'degraded' THEN 3 WHEN 'broken' THEN 4 ELSE 0 END AS sev FROM c)
    SELECT category, health FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY health = 'broken' DESC, n DESC, sev DESC, health DESC) AS rn FROM s) WHERE rn = 1""",
)
def _cat_health(spark, d):
    k = F.col("p_size") % 5
    health = (
        F.when(k == 0, "active")
        .when(k == 1, "low_frequency")
        .when(k == 2, "degraded")
        .when(k == 3, "headline_radar")
        .when(F.col("p_partkey") % 50 == 0, "broken")
        .otherwise("active")
    )
    return A.category_health(table(spark, d, "part").select(F.col("p_brand").alias("category"), health.alias("health")))


@query(
    "unusual_items",
    f"""WITH p AS (SELECT p_brand AS run_date, p_partkey AS pos, {TAG_SQL} AS tag, p_name AS headline, p_size FROM part),
    c AS (SELECT run_date, string_agg(headline, '|' ORDER BY pos) AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY pos) AS rn
      FROM p WHERE p_size < 5 AND tag IN ('war', 'ai', 'defense')) WHERE rn <= 3 GROUP BY run_date)
    SELECT p.run_date, pos, headline, candidates FROM p JOIN c ON p.run_date = c.run_date
    WHERE p_size > 40 AND tag NOT IN ('war', 'ai', 'defense') AND NOT regexp_matches(lower(headline),
     'war|iran|israel|ukraine|russia|conflict|combat|attack|military|missile|defense|pentagon|nato|hormuz|ai|artificial intelligence|llm|openai|anthropic|space|satellite|launch|cislunar|orbit')""",
)
def _unusual(spark, d):
    p = table(spark, d, "part").select(
        F.col("p_brand").alias("run_date"),
        F.col("p_partkey").alias("pos"),
        _tag("p_type").alias("tag"),
        F.col("p_name").alias("headline"),
        "p_size",
    )
    dives = p.where("p_size > 40").withColumn("domains_bridged", F.array().cast("array<string>"))
    desk = p.withColumns({"deep_dive_candidate": F.col("p_size") < 5, "desk_pos": F.lit(0)})
    out = A.unusual_dives(dives, desk)
    return out.select("run_date", "pos", "headline", F.array_join("candidates", "|").alias("candidates"))


@query(
    "length_drift",
    """WITH r AS (SELECT user_id % 20 AS grp, CAST(ts AS DATE) AS run_date, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE count(*) END AS items FROM events GROUP BY ALL),
    w AS (SELECT *, count(items) OVER q AS window_runs, avg(items) OVER q AS window_mean FROM r
      WINDOW q AS (PARTITION BY grp ORDER BY run_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT grp, run_date, CAST(items AS BIGINT) AS items, CAST(window_runs AS BIGINT) AS window_runs, round(window_mean, 6) AS window_mean,
      CASE WHEN window_runs >= 3 AND window_mean <> 0 THEN CASE WHEN items / window_mean > 1.2 THEN 'high' WHEN items / window_mean < 0.8 THEN 'low' END END AS flag FROM w""",
)
def _drift(spark, d):
    runs = (
        table(spark, d, "events")
        .groupBy((F.col("user_id") % 20).alias("grp"), F.to_date("ts").alias("run_date"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("grp", "run_date", F.when(F.col("n") % 5 != 0, F.col("n")).alias("items"))
    )
    out = A.length_drift(runs, high=1.2, low=0.8, by=["grp"])
    return out.withColumn("window_mean", F.round("window_mean", 6)).drop("ratio")


GRAMS_SQL = f"""
dw AS (SELECT doc_id, {WORD_SQL} AS w FROM documents),
bw AS (SELECT item_id, {WORD_SQL} AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i+9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM dw WHERE len(w) >= 10))),
bg AS (SELECT DISTINCT g FROM (SELECT array_to_string(w[i:i+9], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 8)) AS i FROM bw WHERE len(w) >= 10))),
ov AS (SELECT doc_id, count(*) AS overlap_count, min(dg.g) AS sample_phrase FROM dg JOIN bg ON dg.g = bg.g GROUP BY doc_id)
"""


def _sections(spark, d):
    run = F.lit("r").alias("run_date")
    docs = table(spark, d, "documents").select(run, F.col("doc_id").alias("pos"), "text", "source")
    marks = table(spark, d, "benchmark").select(run, F.col("item_id").alias("pos"), "text")
    return docs, marks


@query(
    "phrase_overlap",
    f"WITH {GRAMS_SQL} SELECT doc_id AS pos, CAST(overlap_count AS BIGINT) AS overlap_count, sample_phrase FROM ov",
)
def _overlap(spark, d):
    docs, marks = _sections(spark, d)
    shared = P.shared_grams(docs.select("run_date", "pos", "text"), marks, ["pos"])
    return P.overlap_counts(shared, ["pos"]).drop("run_date")


@query(
    "overlap_downgrade",
    f"""WITH {GRAMS_SQL}, dd AS (SELECT doc_id, CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 3 WHEN 0 THEN 'widely-reported' WHEN 1 THEN 'corroborated' ELSE '' END AS s FROM documents)
    SELECT dd.doc_id AS pos, CASE WHEN overlap_count >= 3 AND s <> '' THEN CASE s WHEN 'widely-reported' THEN 'corroborated' ELSE 'single-source' END ELSE s END AS source_depth,
      s AS original_depth FROM dd LEFT JOIN ov ON dd.doc_id = ov.doc_id""",
)
def _downgrade(spark, d):
    docs, marks = _sections(spark, d)
    k = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 3
    dives = docs.withColumn("source_depth", F.when(k == 0, "widely-reported").when(k == 1, "corroborated").otherwise(""))
    return P.overlap_downgrade(dives, marks).select("pos", "source_depth", "original_depth")


def _texts(spark, d):
    docs, marks = _sections(spark, d)
    one = marks.select("run_date", F.lit("at_a_glance").alias("section"), "pos", "text")
    two = docs.select("run_date", F.lit("deep_dives").alias("section"), (F.col("pos") + 1_000_000_000).alias("pos"), "text")
    return one.unionByName(two)


@query(
    "cross_section_phrases",
    f"""WITH dw AS (SELECT doc_id + 1000000000 AS pos, 'deep_dives' AS section, {WORD_SQL} AS w FROM documents),
    bw AS (SELECT item_id AS pos, 'at_a_glance' AS section, {WORD_SQL} AS w FROM benchmark),
    g AS (SELECT pos, section, array_to_string(w[i:i+9], ' ') AS phrase FROM (SELECT pos, section, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT * FROM dw UNION ALL SELECT * FROM bw) WHERE len(w) >= 10)),
    m AS (SELECT phrase, min(pos) FILTER (section = 'at_a_glance') AS a, min(pos) FILTER (section = 'deep_dives') AS b FROM g GROUP BY phrase)
    SELECT phrase, a AS pos_a, 'at_a_glance' AS section_a, b AS pos_b, 'deep_dives' AS section_b FROM m WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def _cross(spark, d):
    return P.cross_section_phrases(_texts(spark, d)).drop("run_date")


@query("repeated_phrases")
def _repeated(spark, d):
    texts = _texts(spark, d).withColumn("item_id", F.col("pos").cast("string"))
    return A.repeated_phrases(texts)


@query("diverse_topk")
def _diverse(spark, d):
    li = table(spark, d, "lineitem")
    sources = li.groupBy("l_orderkey").agg(
        F.array_distinct(F.collect_list(F.format_string("s%d", F.col("l_suppkey") % 15))).alias("sources"),
        F.count_distinct("l_suppkey").alias("n"),
    )
    o = table(spark, d, "orders")
    k = F.substring("o_orderpriority", 1, 1)
    its = o.join(sources, o["o_orderkey"] == sources["l_orderkey"], "left").select(
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("run_date"),
        F.col("o_orderkey").alias("pos"),
        F.when(k == "1", "war").when(k == "2", "ai").when(k == "3", "defense").otherwise("econ").alias("tag"),
        F.when(F.col("n") >= 4, "widely-reported").when(F.col("n") >= 2, "corroborated").otherwise("single-source").alias("source_depth"),
        F.when(F.col("o_orderstatus") == "P", "note").alias("cross_domain_note"),
        "sources",
    )
    # Stands for the stored items of the editions.
    return diverse_top(cut(its), 7).select("run_date", "rank", "pos", "tag", "source_depth")


@query(
    "anomaly_report",
    f"""WITH g AS (SELECT p_brand || '/' || p_size AS run_date, {TAG_SQL} AS tag FROM part),
    c AS (SELECT run_date, count(*) AS total FROM g GROUP BY run_date HAVING count(*) > 5),
    r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_date, count(*) AS items FROM events GROUP BY 1),
    w AS (SELECT *, count(*) OVER q AS n, avg(items) OVER q AS mean FROM r WINDOW q AS (ORDER BY run_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
    f AS (SELECT run_date, 'category_skew' AS "check", format('Primary tag ''{{}}'' has 0 items in at_a_glance ({{}} total items)', t.tag, total) AS detail
        FROM c CROSS JOIN (VALUES ('war'), ('ai'), ('defense')) AS t(tag) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.run_date = c.run_date AND g.tag = t.tag)
      UNION ALL SELECT run_date, 'digest_length_anomaly', CASE WHEN items / mean > 1.02 THEN format('Today''s digest has {{}} items — {{:.1f}}x the {{}}-day average ({{:.1f}})', items, items / mean, n, mean)
        ELSE format('Today''s digest has {{}} items — only {{:.1f}}% of the {{}}-day average ({{:.1f}})', items, items / mean * 100, n, mean) END FROM w WHERE n >= 3 AND (items / mean > 1.02 OR items / mean < 0.98))
    SELECT run_date, "check", 'warning' AS severity, detail, count(*) OVER (PARTITION BY run_date) AS anomaly_count, 2 AS checks_run FROM f""",
)
def _report(spark, d):
    g = table(spark, d, "part").select(
        F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("run_date"), _tag("p_type").alias("tag")
    )
    skew = A.category_skew(g)
    detail = F.format_string("Primary tag '%s' has 0 items in at_a_glance (%d total items)", "tag", "total")
    one = skew.select(*A.finding("category_skew", "warning", detail))
    runs = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("run_date")).agg(
        F.count(F.lit(1)).alias("items")
    )
    drift = A.length_drift(runs, high=1.02, low=0.98).where("flag is not null")
    two = drift.select(*A.finding("digest_length_anomaly", "warning", A.drift_detail()))
    return A.anomaly_report(one, two)
