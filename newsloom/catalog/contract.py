"""Contract checks over JSON documents built from events and orders.

A document holds the events of a user on one day, or the orders of a customer in
a five-year period.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.registry import query, table
from newsloom.operators import contracts as C
from newsloom.session import cut


def customer_run():
    """Key of a document: customer and five-year period."""
    return F.format_string("%d-%d", "o_custkey", F.floor(F.year("o_orderdate") / 5)).alias("run_date")


def desk_documents(spark, d):
    """One document per day and user, of drifting shapes, from its events."""
    e = table(spark, d, "events").select(
        F.to_date("ts").alias("run_date"),
        F.format_string("u%d", "user_id").alias("desk"),
        "event_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    k, i = F.col("k"), F.col("event_id").cast("string")
    item = (
        F.when(k % 7 == 0, F.lit('"oops"'))
        .when(k % 7 == 1, F.lit('{"headline":5,"links":"x"}'))
        .when(
            k % 7 == 2,
            F.concat(F.lit('{"item_id":"e'), i, F.lit('","links":[{"url":"http://h/'), k.cast("string"), F.lit('","label":"L"},7],"deep_dive_candidate":"yes"}')),
        )
        .otherwise(
            F.concat(
                F.lit('{"item_id":"e'), i, F.lit('","headline":"'), F.col("event_type"), F.lit('","links":[{"url":"http://h/'), k.cast("string"), F.lit('"}],"connection_hooks":null,"zz":1}')
            )
        )
    )
    rows = e.select("run_date", "desk", "event_id", item.alias("item"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "item"))), lambda x: x["item"])
    docs = rows.groupBy("run_date", "desk").agg(F.array_join(texts, ",").alias("t"))
    return docs.select("run_date", "desk", F.lit(0).alias("desk_pos"), F.concat(F.lit('{"items":['), F.col("t"), F.lit("]}")).alias("raw"))


BASE_SQL = """
e AS (SELECT CAST(ts AS DATE) AS run_date, 'u' || user_id AS desk, event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY event_id) - 1 AS pos FROM events)
"""


@query(
    "normalized_items",
    f"""WITH {BASE_SQL} SELECT run_date, desk, CAST(pos AS INTEGER) AS pos, CASE WHEN k % 7 = 1 THEN '' ELSE 'e' || event_id END AS item_id,
      CASE WHEN k % 7 = 1 THEN '5' WHEN k % 7 = 2 THEN '' ELSE event_type END AS headline, k % 7 = 2 AS deep_dive_candidate,
      CASE WHEN k % 7 = 1 THEN '' ELSE 'http://h/' || k END AS urls, CASE WHEN k % 7 = 2 THEN 'L' ELSE '' END AS labels,
      CASE WHEN k % 7 > 2 THEN 'zz' ELSE '' END AS extra FROM e WHERE k % 7 <> 0""",
)
def _normalized(spark, d):
    good, _ = C.desk_results(desk_documents(spark, d))
    return good.select(
        "run_date",
        "desk",
        "pos",
        "item_id",
        "headline",
        "deep_dive_candidate",
        F.array_join(F.col("links")["url"], ",").alias("urls"),
        F.array_join(F.col("links")["label"], ",").alias("labels"),
        F.array_join(F.map_keys("extra"), ",").alias("extra"),
    )


@query(
    "contract_issues",
    f"""WITH {BASE_SQL}, p AS (SELECT *, 'domain_analysis.' || desk || '.items[' || pos || ']' AS here FROM e)
    SELECT run_date, desk, here AS path, 'domain item is not an object' AS message FROM p WHERE k % 7 = 0
    UNION ALL SELECT run_date, desk, here || '.links', 'links is not a list' FROM p WHERE k % 7 = 1
    UNION ALL SELECT run_date, desk, here || '.links[1]', 'link entry is not an object' FROM p WHERE k % 7 = 2
    UNION ALL SELECT run_date, desk, here || '.connection_hooks', 'connection_hooks is not a list' FROM p WHERE k % 7 > 2""",
)
def _issues(spark, d):
    _, issues = C.desk_results(desk_documents(spark, d))
    return issues.select("run_date", "desk", "path", "message")


@query(
    "issue_summary",
    f"""WITH {BASE_SQL} SELECT run_date, 'domain_analysis' AS artifact, CAST(count(*) AS BIGINT) AS issue_count FROM e GROUP BY run_date""",
)
def _summary(spark, d):
    from newsloom.operators.metrics import diagnostics_summary

    _, issues = C.desk_results(desk_documents(spark, d))
    return diagnostics_summary(issues).drop("first_message")


def edition_documents(spark, d):
    """One edition document per customer and shape, from its orders."""
    o = table(spark, d, "orders").select(
        customer_run(), F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority"
    )
    text = F.col("k").cast("string")
    item = F.concat(F.lit('{"item_id":"i'), text, F.lit('","tag":"ai","links":[{"url":"http://h/'), text, F.lit('"}]}'))
    shaped = F.when(F.col("o_orderstatus") == "P", F.lit("3")).otherwise(item)
    rows = o.select("run_date", "k", shaped.alias("item"), "o_orderstatus")
    docs = rows.groupBy("run_date").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]), ",").alias("t"),
        F.min("k").alias("first"),
    )
    dives = F.when(F.col("first") % 3 == 0, ',"deep_dives":[]').when(F.col("first") % 3 == 1, ',"deep_dives":"none"').otherwise("")
    raw = F.concat(F.lit('{"at_a_glance":['), F.col("t"), F.lit("]"), dives, F.lit(',"worth_reading":[{"title":true,"url":"http://w"}]}'))
    return docs.select("run_date", raw.alias("raw"))


@query(
    "edition_contract",
    """WITH o AS (SELECT o_custkey || '-' || (year(o_orderdate) // 5) AS run_date, o_orderkey AS k, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) // 5 ORDER BY o_orderkey) - 1 AS pos FROM orders),
    f AS (SELECT run_date, min(k) AS first FROM o GROUP BY run_date)
    SELECT run_date, 'cross_domain_output.cross_domain_connections' AS path, 'required section missing; defaulted to empty' AS message FROM f
    UNION ALL SELECT run_date, 'cross_domain_output.deep_dives', 'required section missing; defaulted to empty' FROM f WHERE first % 3 = 2
    UNION ALL SELECT run_date, 'cross_domain_output.deep_dives', 'deep_dives is not a list' FROM f WHERE first % 3 = 1
    UNION ALL SELECT run_date, 'cross_domain_output.at_a_glance[' || pos || ']', 'at_a_glance entry is not an object' FROM o WHERE o_orderstatus = 'P'""",
)
def _edition(spark, d):
    _, issues = C.edition_output(edition_documents(spark, d))
    return issues.select("run_date", "path", "message")


@query(
    "edition_reading",
    """SELECT o_custkey || '-' || (year(o_orderdate) // 5) AS run_date, 0 AS pos, 'True' AS title, 'http://w' AS url FROM orders GROUP BY 1""",
)
def _reading(spark, d):
    parts, _ = C.edition_output(edition_documents(spark, d))
    return parts["worth_reading"].select("run_date", "pos", "title", "url")


def plan_documents(spark, d):
    o = table(spark, d, "orders").select(customer_run(), F.col("o_orderkey").alias("k"), "o_orderstatus")
    item = F.when(F.col("o_orderstatus") == "P", F.lit("null")).otherwise(F.concat(F.lit('{"k":'), F.col("k").cast("string"), F.lit("}")))
    docs = o.groupBy("run_date").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("item")))), lambda x: x["item"]), ","
        ).alias("t")
    )
    return docs.select("run_date", F.concat(F.lit('{"planning_scope":4,"deep_dives":['), F.col("t"), F.lit("]}")).alias("raw"))


PLAN_SQL = """
o AS (SELECT o_custkey || '-' || (year(o_orderdate) // 5) AS run_date, o_orderkey AS k, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) // 5 ORDER BY o_orderkey) - 1 AS pos FROM orders),
g AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY pos) AS rn FROM o WHERE o_orderstatus <> 'P'),
l AS (SELECT run_date, pos AS last FROM g WHERE rn = 2)
"""


@query(
    "plan_entries",
    f"""WITH {PLAN_SQL} SELECT run_date, 'deep_dives' AS section, CAST(pos AS INTEGER) AS pos, '{{"k":' || k || '}}' AS entry FROM g WHERE rn <= 2""",
)
def _plan(spark, d):
    return C.edition_plan(plan_documents(spark, d))[0]


@query(
    "plan_issues",
    f"""WITH {PLAN_SQL} SELECT o.run_date, 'cross_domain_plan.deep_dives[' || o.pos || ']' AS path, 'plan entry is not an object' AS message
      FROM o LEFT JOIN l ON o.run_date = l.run_date WHERE o_orderstatus = 'P' AND (last IS NULL OR pos < last)
    UNION ALL SELECT DISTINCT run_date, 'cross_domain_plan.planning_scope', 'planning_scope is not an object' FROM o""",
)
def _plan_issues(spark, d):
    return C.edition_plan(plan_documents(spark, d))[1].select("run_date", "path", "message")


def seam_inputs(spark, d):
    """Annotations per customer from orders; desk items are its other orders."""
    o = table(spark, d, "orders").select(
        customer_run(), F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority"
    )
    ids = F.concat(F.lit("i"), F.col("k").cast("string"))
    desk = o.where("k % 4 <> 0").select(
        "run_date",
        F.lit(0).alias("desk_pos"),
        F.col("k").alias("pos"),
        ids.alias("item_id"),
        F.array(
            F.struct(F.concat(F.lit("http://h/"), F.col("k").cast("string")).alias("url"), F.lit("L").alias("label"))
        ).alias("links"),
    )
    conf = F.when(F.col("o_orderstatus") == "F", "HIGH").when(F.col("o_orderstatus") == "O", "low").otherwise("odd")
    kind = F.when(F.substring("o_orderpriority", 1, 1) == "1", "gossip").otherwise("framing_divergence")
    second = F.when(F.col("k") % 5 == 0, "A").otherwise("B")
    item = F.concat(
        F.lit('{"item_id":"'), ids, F.lit('","seam_type":"'), kind, F.lit('","one_line":" x ","confidence":"'), conf,
        F.lit('","evidence":[{"source":"a","excerpt":"q"},{"source":"'), second, F.lit('","excerpt":"r"}]}'),
    )
    docs = o.groupBy("run_date").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("item")))), lambda x: x["item"]), ","
        ).alias("t"),
        F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: F.concat(F.lit('"i'), x.cast("string"), F.lit('"'))), ",").alias("ids"),
    )
    raw = F.concat(F.lit('{"per_item":['), F.col("t"), F.lit('],"cross_domain":[{"one_line":"c","linked_item_ids":['), F.col("ids"), F.lit("]}]}"))
    # Stands for the landed documents.
    return cut(docs.select("run_date", raw.alias("raw"))), desk


SEAM_SQL = """
o AS (SELECT o_custkey || '-' || (year(o_orderdate) // 5) AS run_date, o_orderkey AS k, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) // 5 ORDER BY o_orderkey) - 1 AS pos FROM orders),
has AS (SELECT run_date, bool_or(k % 4 <> 0) AS checked FROM o GROUP BY run_date),
v AS (SELECT o.* FROM o WHERE k % 4 <> 0 AND o_orderpriority NOT LIKE '1%' AND k % 5 <> 0),
r AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'low' ELSE 'medium' END AS confidence, count(*) OVER (PARTITION BY run_date) AS n,
  row_number() OVER (PARTITION BY run_date ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 2 ELSE 1 END, pos) AS rn FROM v),
acc AS (SELECT run_date, pos, 'i' || k AS item_id, confidence, 'http://h/' || k AS url, row_number() OVER (PARTITION BY run_date ORDER BY CASE WHEN n > 6 THEN rn END, pos) AS rank FROM r WHERE rn <= 6)
"""


@query(
    "seam_annotations",
    f"WITH {SEAM_SQL} SELECT run_date, CAST(pos AS INTEGER) AS pos, item_id, confidence, url, CAST(rank AS INTEGER) AS rank FROM acc",
)
def _seams(spark, d):
    raw, desk = seam_inputs(spark, d)
    own, _, _ = C.seam_annotations(raw, desk)
    out = C.accepted_annotations(own, desk)
    return out.select("run_date", "pos", "item_id", "confidence", F.col("links")[0]["url"].alias("url"), "rank")


@query(
    "seam_issues",
    f"""WITH {SEAM_SQL} SELECT o.run_date, 'seam_annotations.per_item[' || pos || '].item_id' AS path, 'item_id is unknown' AS message
      FROM o JOIN has ON o.run_date = has.run_date WHERE checked AND k % 4 = 0
    UNION ALL SELECT o.run_date, 'seam_annotations.cross_domain[0].linked_item_ids', 'unknown item_id: i' || k FROM o JOIN has ON o.run_date = has.run_date WHERE checked AND k % 4 = 0""",
)
def _seam_issues(spark, d):
    raw, desk = seam_inputs(spark, d)
    return C.seam_annotations(raw, desk)[2].select("run_date", "path", "message")


@query(
    "cross_annotations",
    f"""WITH {SEAM_SQL} SELECT o.run_date, string_agg('i' || k, ',' ORDER BY k) AS linked FROM o JOIN has ON o.run_date = has.run_date
      WHERE NOT checked OR k % 4 <> 0 GROUP BY o.run_date HAVING count(*) >= 2""",
)
def _cross(spark, d):
    raw, desk = seam_inputs(spark, d)
    out = C.accepted_cross(C.seam_annotations(raw, desk)[1])
    return out.select("run_date", F.array_join("linked_item_ids", ",").alias("linked"))


@query(
    "seam_projection",
    f"""WITH {SEAM_SQL} SELECT run_date, CAST(count(*) AS BIGINT) AS seam_count, count(*) <= 1 AS quiet_day FROM acc GROUP BY run_date""",
)
def _projection(spark, d):
    raw, desk = seam_inputs(spark, d)
    own, _, _ = C.seam_annotations(raw, desk)
    return C.seam_projection(C.accepted_annotations(own, desk))[1]


@query(
    "seam_candidates",
    f"""WITH {SEAM_SQL} SELECT run_date, CAST(rank AS INTEGER) AS pos, item_id, 'x' AS candidate_one_line FROM acc WHERE rank <= 5""",
)
def _candidates(spark, d):
    raw, desk = seam_inputs(spark, d)
    own, _, _ = C.seam_annotations(raw, desk)
    out = C.candidate_rows(C.accepted_annotations(own, desk))
    return out.select("run_date", "pos", "item_id", "candidate_one_line")


@query("artifact_audit")
def _audit(spark, d):
    raw, _ = seam_inputs(spark, d)
    desks = table(spark, d, "orders").select(
        customer_run(),
        F.lit("ai").alias("desk"),
        F.lit(0).alias("desk_pos"),
        F.when(F.col("o_orderkey") % 2 == 0, "[1]").otherwise('{"items":{}}').alias("raw"),
    )
    return C.audit_artifacts(desks, edition_documents(spark, d), plan_documents(spark, d), raw, raw)
