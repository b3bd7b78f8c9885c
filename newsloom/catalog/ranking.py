"""Caps, budgets, gates and top-k over orders, parts, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.carriers import ITEMS_SQL, items, month_runs
from newsloom.catalog.registry import query, table
from newsloom.catalog.texts import CANONICAL_SQL
from newsloom.functions.text import has_useful_summary
from newsloom.operators import ranking as R

def day():
    return F.lit("2024-01-01").cast("date")


@query(
    "dedup_first",
    """SELECT digest, pos FROM (SELECT md5(text) AS digest, doc_id AS pos,
       row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents WHERE text <> '') WHERE rn = 1""",
)
def _dedup(spark, d):
    docs = table(spark, d, "documents").where("text <> ''")
    keyed = docs.select(F.md5("text").alias("digest"), F.col("doc_id").alias("pos"))
    return R.first_per_key(keyed, ["digest"], ["pos"])


@query(
    "dedup_by_canonical_url",
    f"""WITH {CANONICAL_SQL} SELECT DATE '2024-01-01' AS run_date, min(page_id) AS pos, canonical AS url FROM canon GROUP BY canonical""",
)
def _dedup_url(spark, d):
    from newsloom.functions.urls import canonical_url

    pages = table(spark, d, "pages").select(
        day().alias("run_date"), F.col("page_id").alias("pos"), canonical_url(F.col("url")).alias("url")
    )
    return R.dedup_by_url(pages)


@query(
    "feed_cap",
    f"""WITH {ITEMS_SQL} SELECT run_date, source, pos FROM (SELECT *, row_number() OVER (PARTITION BY run_date, source ORDER BY pos) AS rn,
      CASE source WHEN 'src0' THEN 3 WHEN 'src7' THEN 1 ELSE 2 END AS cap FROM items) WHERE rn <= cap""",
)
def _feed_cap(spark, d):
    rows = items(spark, d).select("run_date", "source", "pos")
    return R.cap_per_key(rows, ["run_date"], "source", ["pos"], {"src0": 3, "src7": 1}, 2)


@query(
    "share_cap",
    """WITH p AS (SELECT p_brand AS desk, p_type AS category, p_partkey AS pos FROM part),
    r AS (SELECT *, count(*) OVER (PARTITION BY desk) AS n, row_number() OVER (PARTITION BY desk, category ORDER BY pos) AS rn FROM p)
    SELECT desk, category, pos, rn <= greatest(1, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT)) AS kept FROM r""",
)
def _share_cap(spark, d):
    p = table(spark, d, "part").select(
        F.col("p_brand").alias("desk"), F.col("p_type").alias("category"), F.col("p_partkey").alias("pos")
    )
    return R.share_cap(p, ["desk"], "category", 0.2)


@query(
    "outlet_cap",
    r"""WITH h AS (SELECT page_id AS pos, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS outlet FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY outlet ORDER BY pos) AS rn FROM h)
    SELECT pos, outlet, outlet = '' OR rn <= 2 AS kept FROM r""",
)
def _outlet_cap(spark, d):
    from newsloom.functions.urls import netloc

    pages = table(spark, d, "pages").select(F.col("page_id").alias("pos"), netloc(F.col("url")).alias("outlet"))
    kept, dropped = R.outlet_cap(pages, [], "outlet", 2)
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))


CAPS = {"1-URGENT": 10, "2-HIGH": 25, "3-MEDIUM": 5, "4-NOT SPECIFIED": 9999}
BUDGET_SQL = """
o AS (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS run_date, o_orderpriority AS tier, o_orderkey AS pos,
  CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 3 END AS p0,
  CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey % 5 END AS p1,
  CASE WHEN o_totalprice < 50000 THEN 0 ELSE CAST(floor(o_totalprice / 1000) AS BIGINT) END AS p2 FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY run_date, tier ORDER BY p0, p1, p2, pos) AS rn,
  count(*) OVER (PARTITION BY run_date, tier) AS n,
  CASE tier WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 25 WHEN '3-MEDIUM' THEN 5 WHEN '4-NOT SPECIFIED' THEN 9999 ELSE 0 END AS cap FROM o)
"""


def _budget(spark, d):
    o = table(spark, d, "orders")
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    none = price < 50000
    rows = o.select(
        F.to_date(F.date_trunc("year", "o_orderdate")).alias("run_date"),
        F.col("o_orderpriority").alias("tier"),
        F.col("o_orderkey").alias("pos"),
        F.when(none, 0).when(status == "F", 1).when(status == "O", 2).otherwise(3).alias("p0"),
        F.when(none, 0).when(status == "F", 0).otherwise(F.col("o_custkey") % 5).alias("p1"),
        F.when(none, 0).otherwise(F.floor(price / 1000)).alias("p2"),
        F.when(none, "empty_native_text").otherwise("short_native_text").alias("priority_reason"),
    )
    return R.tiered_budget(rows, F.lit(True), CAPS, "skipped_fetch_cap")


@query(
    "tiered_budget",
    f"""WITH {BUDGET_SQL} SELECT run_date, tier, pos, CAST(rn AS BIGINT) AS budget_rank, rn <= cap AS allowed,
    CASE WHEN rn > cap THEN 'skipped fetch cap hit; tier=' || tier || '; rank_reason=' ||
      CASE WHEN p0 = 0 THEN 'empty_native_text' ELSE 'short_native_text' END || '; candidates=' || n || '; cap=' || cap END AS reason FROM b""",
)
def _tiered_budget(spark, d):
    b = _budget(spark, d)
    reason = F.when(~F.col("allowed"), R.budget_reason())
    return b.select(
        "run_date", "tier", "pos", F.col("budget_rank").cast("bigint").alias("budget_rank"), "allowed", reason.alias("reason")
    )


@query(
    "tier_stats",
    f"""WITH {BUDGET_SQL} SELECT run_date, tier, CAST(count(*) AS BIGINT) AS needed, CAST(count(*) FILTER (rn <= cap) AS BIGINT) AS allowed,
    CAST(count(*) FILTER (rn > cap) AS BIGINT) AS skipped_by_cap, CAST(max(cap) AS BIGINT) AS cap FROM b GROUP BY ALL""",
)
def _tier_stats(spark, d):
    return R.tier_stats(_budget(spark, d))


@query(
    "request_gate",
    """WITH q AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS run_date, o_orderpriority AS desk,
      CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS desk_pos, o_orderkey AS idx,
      CASE WHEN o_orderstatus = 'F' THEN 'rejected_unknown_url' ELSE 'selected' END AS s FROM orders),
    e AS (SELECT *, row_number() OVER (PARTITION BY run_date, desk ORDER BY idx) AS rd FROM q WHERE s = 'selected'),
    c AS (SELECT run_date, desk, desk_pos, least(count(*), 3) AS can FROM e GROUP BY ALL),
    t AS (SELECT *, greatest(0, least(can, 8 - coalesce(sum(can) OVER (PARTITION BY run_date ORDER BY desk_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM c)
    SELECT e.run_date, e.desk, e.idx, CASE WHEN rd <= take THEN 'selected' WHEN take >= 3 THEN 'rejected_per_desk_cap' ELSE 'rejected_total_cap' END AS status
    FROM e JOIN t ON e.run_date = t.run_date AND e.desk = t.desk
    UNION ALL SELECT run_date, desk, idx, s FROM q WHERE s <> 'selected'""",
)
def _request_gate(spark, d):
    q = month_runs(spark, d).select(
        "run_date",
        F.col("o_orderpriority").alias("desk"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("desk_pos"),
        F.col("o_orderkey").alias("idx"),
        F.when(F.col("o_orderstatus") == "F", "rejected_unknown_url").otherwise("selected").alias("status"),
    )
    return R.request_gate(q, 3, 8).drop("desk_pos")


@query(
    "confidence_cap",
    """WITH a AS (SELECT o_custkey AS run_date, o_orderkey AS pos,
      CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS confidence,
      CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS c FROM orders),
    r AS (SELECT *, count(*) OVER (PARTITION BY run_date) AS n, row_number() OVER (PARTITION BY run_date ORDER BY c DESC, pos) AS rn FROM a),
    k AS (SELECT * FROM r WHERE rn <= 6)
    SELECT run_date, pos, confidence, row_number() OVER (PARTITION BY run_date ORDER BY CASE WHEN n > 6 THEN rn END, pos)::INTEGER AS rank FROM k""",
)
def _confidence(spark, d):
    conf = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    a = table(spark, d, "orders").select(
        F.col("o_custkey").alias("run_date"), F.col("o_orderkey").alias("pos"), conf.alias("confidence")
    )
    return R.confidence_cap(a, ["run_date"], 6)


@query(
    "useful_first",
    f"""WITH {ITEMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY CASE WHEN n_chars >= 200 THEN 0 ELSE 1 END, pos) AS rn FROM items)
    SELECT run_date, pos, rn::INTEGER AS rank FROM r WHERE rn <= 40""",
)
def _useful_first(spark, d):
    rows = items(spark, d).select("run_date", "pos", "n_chars")
    return R.useful_first(rows, ["run_date"], F.col("n_chars") >= 200, 40).drop("n_chars")


@query(
    "local_selection",
    f"""WITH {ITEMS_SQL}, g AS (SELECT *, length(trim(summary, ' ' || chr(10) || chr(9))) >= 40 AS useful FROM items WHERE
      NOT contains(summary, 'PRNewswire') AND NOT contains(summary, 'Business Wire') AND NOT contains(summary, 'GlobeNewswire') AND NOT contains(summary, 'PR Newswire')),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY CASE WHEN useful THEN 0 ELSE 1 END, pos) AS rn FROM g)
    SELECT run_date, pos, source, rn::INTEGER AS rank FROM r WHERE rn <= 4""",
)
def _local(spark, d):
    from newsloom.plans.local import local_selection

    rows = items(spark, d).withColumn("url", F.lit("")).withColumn("rss_body", F.lit(""))
    return local_selection(rows).select("run_date", "pos", "source", "rank")


@query(
    "circuit_breaker",
    """WITH e AS (SELECT event_id AS pos, event_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f,
      CASE WHEN event_type = 'error' OR event_type = 'view' THEN 0 ELSE 1 END AS ok, user_id FROM events),
    i AS (SELECT *, sum(ok) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM e),
    s AS (SELECT *, sum(f) OVER (PARTITION BY user_id, island ORDER BY pos) AS streak FROM i),
    b AS (SELECT user_id, min(pos) AS p FROM s WHERE f = 1 AND streak = 3 GROUP BY user_id)
    SELECT e.user_id, CAST(count(*) AS BIGINT) AS processed, max(e.pos) AS last_pos FROM e LEFT JOIN b ON e.user_id = b.user_id
    WHERE b.p IS NULL OR e.pos <= b.p GROUP BY e.user_id""",
)
def _breaker(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("pos"), "event_type")
    kind = F.col("event_type")
    done = R.circuit_breaker(e, ["user_id"], kind == "error", ~kind.isin("error", "view"), 3)
    return done.groupBy("user_id").agg(F.count(F.lit(1)).alias("processed"), F.max("pos").alias("last_pos"))


@query(
    "newest_first",
    """SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS published FROM orders ORDER BY 2 DESC NULLS LAST""",
)
def _newest(spark, d):
    # Every fifth item is undated.
    dated = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    return R.newest_first(table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), dated.alias("published")))


@query(
    "category_useful_share",
    f"""WITH {ITEMS_SQL} SELECT run_date, category, CAST(count(*) AS BIGINT) AS items,
      CAST(count(*) FILTER (length(trim(summary, ' ' || chr(10) || chr(9))) >= 40) AS BIGINT) AS useful FROM items GROUP BY ALL""",
)
def _category_useful(spark, d):
    ok = has_useful_summary(F.col("summary"), F.lit(""))
    return items(spark, d).groupBy("run_date", "category").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(ok).alias("useful")
    )
