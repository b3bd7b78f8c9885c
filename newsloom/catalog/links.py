"""Joins and link evidence over line items, suppliers, orders, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.carriers import outlet_links
from newsloom.catalog.registry import query, table
from newsloom.catalog.texts import CANONICAL_SQL
from newsloom.functions.urls import canonical_url
from newsloom.operators import joins as J
from newsloom.operators import links as L
from newsloom.operators import metrics as M

def day():
    return F.lit("2024-01-01").cast("date")


def _order_links(spark, d):
    """Links of each order as an array of url and label, in line order."""
    rows = outlet_links(spark, d)
    return rows.groupBy("item_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", "url", "label"))),
            lambda x: F.struct(x["url"].alias("url"), x["label"].alias("label")),
        ).alias("links")
    )


@query(
    "source_depth",
    """SELECT l_orderkey AS item_id, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS domains,
      CASE WHEN count(DISTINCT l_suppkey) >= 4 THEN 'widely-reported' WHEN count(DISTINCT l_suppkey) >= 2 THEN 'corroborated' ELSE 'single-source' END AS source_depth
    FROM lineitem GROUP BY l_orderkey""",
)
def _depth(spark, d):
    return L.source_depth_of_links(outlet_links(spark, d), ["item_id"], F.col("url"))


@query(
    "nested_source_depth",
    """SELECT l_orderkey AS item_id, CASE WHEN count(DISTINCT l_suppkey) >= 4 THEN 'widely-reported'
      WHEN count(DISTINCT l_suppkey) >= 2 THEN 'corroborated' ELSE 'single-source' END AS source_depth,
      array_to_string(list_sort(list_distinct(list('s' || l_suppkey || '.example.org'))), ',') AS domains
    FROM lineitem GROUP BY l_orderkey""",
)
def _nested_depth(spark, d):
    o = _order_links(spark, d)
    return o.select(
        "item_id",
        L.source_depth(F.col("links")).alias("source_depth"),
        F.array_join(L.link_domains(F.col("links")), ",").alias("domains"),
    )


@query(
    "common_outlet",
    """WITH c AS (SELECT l_orderkey, l_suppkey, count(*) AS n, min(struct_pack(a := l_linenumber, b := 'https://www.s' || l_suppkey || '.example.org/p/' || l_partkey)) AS f FROM lineitem GROUP BY ALL)
    SELECT l_orderkey AS item_id, 's' || l_suppkey || '.example.org' AS outlet FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1""",
)
def _outlet(spark, d):
    return _order_links(spark, d).select("item_id", L.most_common_outlet(F.col("links")).alias("outlet"))


@query(
    "outlet_share",
    """WITH i AS (SELECT DISTINCT l_returnflag AS run_date, l_orderkey, 'Brand ' || (l_suppkey % 3) AS outlet FROM lineitem),
    t AS (SELECT run_date, count(*) AS total FROM (SELECT DISTINCT l_returnflag AS run_date, l_orderkey FROM lineitem) GROUP BY run_date)
    SELECT i.run_date, outlet, CAST(count(*) AS BIGINT) AS items, CAST(any_value(total) AS BIGINT) AS total, round(count(*) / any_value(total)::DOUBLE, 6) AS share
    FROM i JOIN t ON i.run_date = t.run_date GROUP BY i.run_date, outlet HAVING count(*) / any_value(total)::DOUBLE > 0.4""",
)
def _share(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("run_date"),
        F.col("l_orderkey").alias("item_id"),
        F.format_string("Brand %d: part %d", F.col("l_suppkey") % 3, F.col("l_partkey")).alias("label"),
    )
    out = M.outlet_share(li, li.select("run_date", "item_id").distinct(), 0.4)
    return out.withColumn("share", F.round("share", 6))


KNOWN_SQL = """
links AS (SELECT l_orderkey AS item_id, l_linenumber AS line, l_suppkey, l_partkey,
  'http://s' || l_suppkey || '.example.org/a/' || (l_partkey % 7) || '?utm_source=x' AS url FROM lineitem),
known AS (SELECT DISTINCT 'http://s' || s_suppkey || '.example.org/a/3/' AS url, s_suppkey FROM supplier WHERE s_acctbal >= 0)
"""


def _links_and_known(spark, d):
    li = table(spark, d, "lineitem").select(
        day().alias("run_date"),
        F.col("l_orderkey").alias("item_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey"),
        F.format_string("http://s%d.example.org/a/%d?utm_source=x", F.col("l_suppkey"), F.col("l_partkey") % 7).alias("url"),
    )
    known = table(spark, d, "supplier").where("s_acctbal >= 0").select(
        day().alias("run_date"), F.format_string("http://s%d.example.org/a/3/", "s_suppkey").alias("url")
    )
    return li, J.known_urls(known)


@query(
    "known_links",
    f"WITH {KNOWN_SQL} SELECT item_id, line, l_partkey, l.url FROM links l WHERE l_partkey % 7 = 3 AND l.l_suppkey IN (SELECT s_suppkey FROM known)",
)
def _known(spark, d):
    links, known = _links_and_known(spark, d)
    out = J.mark_known(links, known, hot_rows=2000)
    return out.where("known").select("item_id", "line", "l_partkey", "url")


@query(
    "unknown_links",
    f"""WITH {KNOWN_SQL} SELECT item_id, line, l_partkey, l.url, CASE WHEN k.s_suppkey IS NOT NULL THEN 'known_domain_unknown_path' ELSE 'unknown_domain' END AS reason
    FROM links l LEFT JOIN known k ON l.l_suppkey = k.s_suppkey WHERE NOT (l_partkey % 7 = 3 AND k.s_suppkey IS NOT NULL)""",
)
def _unknown(spark, d):
    from newsloom.operators.validation import strip_reasons

    links, known = _links_and_known(spark, d)
    bad = J.mark_known(links, known).where("not known")
    return strip_reasons(bad, known).select("item_id", "line", "l_partkey", "url", "reason")


@query(
    "known_pages",
    f"""WITH {CANONICAL_SQL}, k AS (SELECT DISTINCT canonical FROM canon WHERE page_id % 2 = 0)
    SELECT page_id, canonical IN (SELECT canonical FROM k) AS known FROM canon""",
)
def _known_pages(spark, d):
    pages = table(spark, d, "pages").select(day().alias("run_date"), "page_id", "url")
    known = J.known_urls(pages.where("page_id % 2 = 0"))
    return J.mark_known(pages, known).select("page_id", "known")


@query(
    "url_set_operations",
    f"""WITH {CANONICAL_SQL}, a AS (SELECT DISTINCT canonical FROM canon WHERE page_id % 3 <> 0), b AS (SELECT DISTINCT canonical FROM canon WHERE page_id % 2 = 0)
    SELECT 'union' AS op, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM a UNION SELECT * FROM b)
    UNION ALL SELECT 'intersect', CAST(count(*) AS BIGINT) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    UNION ALL SELECT 'except', CAST(count(*) AS BIGINT) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def _sets(spark, d):
    c = table(spark, d, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical"))
    a = c.where("page_id % 3 <> 0").select("canonical").distinct()
    b = c.where("page_id % 2 = 0").select("canonical").distinct()
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "domains_bridged",
    """WITH desk AS (SELECT s_suppkey, n_name AS desk FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    f AS (SELECT l_orderkey, desk, min(rn) AS first FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS rn FROM lineitem) JOIN desk ON l_suppkey = s_suppkey GROUP BY ALL)
    SELECT l_orderkey AS pos, string_agg(desk, ',' ORDER BY first) AS domains_bridged FROM f GROUP BY l_orderkey""",
)
def _bridged(spark, d):
    run = F.lit("r").alias("run_date")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    # Suppliers come with the line number, so the array sorts into reading order.
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    dives = li.groupBy("l_orderkey").agg(lines.alias("_l")).select(
        run,
        F.col("l_orderkey").alias("pos"),
        F.transform("_l", lambda x: F.struct(F.concat(F.lit("http://s"), x["l_suppkey"].cast("string"), F.lit("/")).alias("url"))).alias(
            "further_reading"
        ),
    )
    sup = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    desk_items = sup.select(
        run,
        F.col("n_name").alias("desk"),
        F.col("n_nationkey").alias("desk_pos"),
        F.col("s_suppkey").alias("pos"),
        F.array(F.struct(F.format_string("http://s%d/", "s_suppkey").alias("url"))).alias("links"),
    )
    out = L.domains_bridged(dives, L.url_desks(desk_items))
    return out.select("pos", F.array_join("domains_bridged", ",").alias("domains_bridged"))


@query(
    "best_annotation",
    """SELECT o_custkey AS item_id, o_orderkey AS pos, confidence FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS confidence,
      row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def _best(spark, d):
    conf = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    a = table(spark, d, "orders").select(
        day().alias("run_date"),
        F.col("o_custkey").alias("item_id"),
        F.col("o_orderkey").alias("pos"),
        conf.alias("confidence"),
        F.col("o_orderpriority").alias("one_line"),
    )
    return J.best_annotation(a).select("item_id", "pos", "confidence")


@query(
    "asof_previous",
    """SELECT o_custkey AS custkey, run_date, lag(run_date) OVER (PARTITION BY o_custkey ORDER BY run_date) AS previous_run_date
    FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS run_date FROM orders)""",
)
def _previous(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("run_date"))
    return J.previous_run(o, ["custkey"])


@query(
    "asof_weekly",
    """WITH w AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS run_date FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000),
    q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
    SELECT q.date, w.run_date FROM q ASOF LEFT JOIN w ON q.date >= w.run_date""",
)
def _weekly(spark, d):
    o = table(spark, d, "orders")
    weeks = o.where("o_orderstatus = 'P' and o_totalprice > 400000").select(
        F.to_date(F.date_trunc("week", "o_orderdate")).alias("run_date")
    )
    dates = o.select(F.to_date("o_orderdate").alias("date")).distinct()
    return J.asof_runs(dates, weeks)


@query(
    "schedule_range",
    """WITH b AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS start FROM orders GROUP BY 1),
    s AS (SELECT start, CAST(start + 45 AS DATE) AS "end", 'Lesson ' || start AS title FROM b)
    SELECT o_orderkey, coalesce(title, '') AS title FROM orders LEFT JOIN s ON CAST(o_orderdate AS DATE) BETWEEN start AND "end" """,
)
def _schedule(spark, d):
    o = table(spark, d, "orders")
    s = (
        o.select(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("start"))
        .distinct()
        .withColumn("end", F.date_add("start", 45))
        .withColumn("title", F.concat(F.lit("Lesson "), F.col("start").cast("string")))
    )
    out = J.schedule_lookup(o.select("o_orderkey", "o_orderdate"), s, "o_orderdate", ["title"])
    return out.select("o_orderkey", "title")


@query(
    "propagate_duplicates",
    """WITH t AS (SELECT doc_id, source, md5(text) AS k, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents)
    SELECT a.doc_id, b.source FROM t a JOIN t b ON a.k = b.k AND b.rn = 1""",
)
def _propagate(spark, d):
    from newsloom.operators.ranking import first_per_key

    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("k"), "source")
    kept = first_per_key(docs, ["k"], ["doc_id"])
    return J.propagate_to_duplicates(docs, kept, "source", ["k"]).select("doc_id", "source")


@query(
    "prefer_enriched",
    """SELECT d.doc_id AS pos, CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN 'enriched' ELSE source END AS summary
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _prefer(spark, d):
    raw = table(spark, d, "documents").select(day().alias("run_date"), F.col("doc_id").alias("pos"), F.col("source").alias("summary"))
    good = table(spark, d, "labels").where("quality = 1").select(
        day().alias("run_date"), F.col("doc_id").alias("pos"), F.lit("enriched").alias("summary")
    )
    return J.prefer_enriched(raw, good).select("pos", "summary")


@query(
    "source_priority",
    """WITH a AS (SELECT CAST(ts AS DATE) AS run_date, event_id FROM events WHERE event_type = 'purchase' AND user_id < 3),
    b AS (SELECT CAST(ts AS DATE) AS run_date, event_id FROM events WHERE event_type = 'error')
    SELECT run_date, event_id FROM a UNION ALL SELECT run_date, event_id FROM b WHERE run_date NOT IN (SELECT run_date FROM a)""",
)
def _priority(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("run_date"), "event_id", "event_type", "user_id")
    a = e.where("event_type = 'purchase' and user_id < 3").select("run_date", "event_id")
    b = e.where("event_type = 'error'").select("run_date", "event_id")
    return J.first_available(a, b)


@query(
    "added_feeds",
    """SELECT DISTINCT source AS url FROM documents WHERE doc_id >= 10 AND source NOT IN (SELECT source FROM documents WHERE doc_id < 10)""",
)
def _added(spark, d):
    docs = table(spark, d, "documents")
    now = docs.where("doc_id >= 10").select(F.col("source").alias("url")).distinct()
    return J.added_rows(now, docs.where("doc_id < 10").select(F.col("source").alias("url")))


@query(
    "tag_labels",
    r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN replace(p_name, ' ', '_')
        WHEN 2 THEN replace(p_name, ' ', '/') ELSE '3d' || replace(p_name, ' ', chr(39)) END AS tag FROM part)
    SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(tag, '\p{L}+|\P{L}+'),
      lambda w: upper(w[1:1]) || lower(w[2:])), '') AS label FROM t""",
)
def _labels(spark, d):
    from newsloom.operators.tags import tag_label

    k = F.col("p_partkey") % 4
    joint = F.when(k == 0, "-").when(k == 1, "_").when(k == 2, "/").otherwise("'")
    tag = F.concat(F.when(k == 3, "3d").otherwise(""), F.replace("p_name", F.lit(" "), joint))
    return table(spark, d, "part").select("p_partkey", tag_label(tag).alias("label"))
