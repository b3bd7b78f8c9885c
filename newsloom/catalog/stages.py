"""Scores of every stage's output, candidates, titles, regional news, research."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.registry import query, table
from newsloom.functions import text as X
from newsloom.operators import contracts as C
from newsloom.operators import validation as V
from newsloom.operators.routing import successful_research
from newsloom.plans import compare as M
from newsloom.plans.local import regional_selection


def month():
    return F.date_format("o_orderdate", "yyyy-MM").alias("run_date")


def _stage_inputs(spark, d):
    """What each scorer reads: days of events, months of orders, texts of conversations."""
    e = table(spark, d, "events")
    kind, n = F.col("event_type"), F.count(F.lit(1))
    days = e.select(F.to_date("ts").cast("string").alias("run_date"), F.format_string("m%d", F.col("user_id") % 40).alias("model"), "event_id", "event_type", "value")
    per_day = days.groupBy("run_date", "model").agg(
        F.count_if((kind == "view") & (F.col("event_id") % 2 == 0)).alias("a"),
        F.count_if(kind == "error").alias("b"),
        F.count_if(F.col("event_id") % 3 == 0).alias("c"),
        n.alias("n"),
    )
    o = table(spark, d, "orders").select(month(), F.col("o_orderstatus").alias("model"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    key = F.col("o_orderkey")
    read = F.when((F.col("model") == "F") | (key % 9 > 0), "  My read: ").otherwise("")
    desks = o.select(
        "run_date",
        "model",
        F.format_string("d%d", F.col("o_custkey") % F.when(F.col("model") == "P", 3).otherwise(6)).alias("desk"),
        F.concat(read, F.col("o_orderpriority"), F.when(key % 4 != F.when(F.col("model") == "O", key % 4).otherwise(1), ". Watch FOR more")).alias("analysis"),
    )
    desks = desks.withColumn("analysis", F.coalesce("analysis", F.lit("My read")))
    runs = o.groupBy("run_date", "model").agg(
        (n * 2).alias("source_count"),
        F.count_if(F.col("o_totalprice") > 455_000).alias("failures"),
        F.count_if(F.col("o_totalprice") > 440_000).alias("contract_issues"),
    )
    talks = table(spark, d, "conversations")
    spoken = talks.select(
        F.format_string("%d-%d", "conv_id", "turn").alias("run_date"),
        F.col("role").alias("model"),
        F.col("text").alias("reflection"),
        F.when(F.col("turn") % 5 == 1, F.concat(F.lit(" "), F.col("text"), F.lit("\n"))).alias("scripture_text"),
    )
    return {
        "enrich_articles": [per_day.select("run_date", "model", F.col("a").alias("items"), F.col("b").alias("records"))],
        "analyze_domain": [desks, runs],
        "prepare_spiritual_weekly": [
            per_day.select("run_date", "model", F.col("a").alias("daily_foci"), F.col("n").alias("sequence_days"), (F.col("c") == 0).alias("missing_guide"))
        ],
        "prepare_spiritual": [spoken],
        "seams": [per_day.select("run_date", "model", F.col("a").alias("per_item"), F.col("b").alias("cross_domain"), (F.col("c") == 0).alias("quiet_day"))],
        "cross_domain": [
            per_day.select(
                "run_date", "model", F.col("a").alias("at_a_glance"), F.col("b").alias("invalid_tags"), F.col("n").alias("deep_dives"),
                F.col("c").alias("validation_issues"), F.lit(0).alias("contract_issues"),
            )
        ],
    }


STAGE_SQL = r"""
e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_date, 'm' || (user_id % 40) AS model, count(*) FILTER (event_type = 'view' AND event_id % 2 = 0) AS a, count(*) FILTER (event_type = 'error') AS b,
  count(*) FILTER (event_id % 3 = 0) AS c, count(*) AS n FROM events GROUP BY ALL),
o AS (SELECT strftime(o_orderdate, '%Y-%m') AS run_date, o_orderstatus AS model, * FROM orders),
i AS (SELECT run_date, model, 'd' || (o_custkey % CASE WHEN model = 'P' THEN 3 ELSE 6 END) AS desk, model = 'F' OR o_orderkey % 9 > 0 AS my, o_orderkey % 4 <> CASE WHEN model = 'O' THEN o_orderkey % 4 ELSE 1 END AS watch FROM o),
g AS (SELECT run_date, model, count(DISTINCT desk) AS desks, round_even(avg(CASE WHEN my AND watch THEN 1.0 ELSE 0.0 END), 2) AS my, round_even(avg(CASE WHEN watch THEN 1.0 ELSE 0.0 END), 2) AS watch FROM i GROUP BY ALL),
r AS (SELECT run_date, model, count(*) FILTER (o_totalprice > 455000) AS failures, count(*) FILTER (o_totalprice > 440000) AS issues FROM o GROUP BY ALL),
t AS (SELECT conv_id || '-' || turn AS run_date, role AS model, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS x, turn % 5 = 1 AS copied, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM conversations),
scores AS (
  SELECT 'enrich_articles' AS stage, run_date, model, CASE WHEN a = 0 THEN 0 WHEN b = 0 THEN 70 ELSE 100 END AS quality_score FROM e
  UNION ALL SELECT 'analyze_domain', g.run_date, g.model, greatest(0, 100 - CASE WHEN desks < 4 THEN 20 ELSE 0 END - CASE WHEN my < 1 THEN 20 ELSE 0 END - CASE WHEN watch < 0.75 THEN 10 ELSE 0 END
    - CASE WHEN failures > 0 THEN 20 ELSE 0 END - CASE WHEN issues > 0 THEN 15 ELSE 0 END) FROM g JOIN r ON g.run_date = r.run_date AND g.model = r.model
  UNION ALL SELECT 'prepare_spiritual_weekly', run_date, model, CASE WHEN c = 0 THEN 0 WHEN a = 0 THEN 50 WHEN n < 5 THEN 85 ELSE 100 END FROM e
  UNION ALL SELECT 'prepare_spiritual', run_date, model, CASE WHEN x = '' THEN 0 ELSE 100 - CASE WHEN copied THEN 30 ELSE 0 END - CASE WHEN n < 60 OR n > 170 THEN 15 ELSE 0 END END FROM t
  UNION ALL SELECT 'seams', run_date, model, CASE WHEN a = 0 AND b = 0 AND c > 0 THEN 70 ELSE 100 END FROM e
  UNION ALL SELECT 'cross_domain', run_date, model, CASE WHEN a = 0 THEN 0 ELSE 100 - CASE WHEN b > 0 THEN 20 ELSE 0 END - CASE WHEN n > 3 THEN 10 ELSE 0 END - CASE WHEN c > 0 THEN 20 ELSE 0 END END FROM e)
"""


def _scores(spark, d):
    """(stage, run_date, model, quality_score) by every registered scorer that has inputs here."""
    out = None
    for stage, inputs in _stage_inputs(spark, d).items():
        part = M.SCORERS[stage](*inputs).select(F.lit(stage).alias("stage"), "run_date", "model", F.col("quality_score").cast("int").alias("quality_score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("stage_scores", f"WITH {STAGE_SQL} SELECT stage, run_date, model, quality_score::INTEGER AS quality_score FROM scores")
def _stage_scores(spark, d):
    return _scores(spark, d)


@query(
    "stage_model_ranking",
    f"""WITH {STAGE_SQL} SELECT stage || ' ' || run_date AS run_date, model, CAST(row_number() OVER (PARTITION BY stage, run_date ORDER BY quality_score DESC, length(model), model) AS BIGINT) AS rank FROM scores""",
)
def _stage_ranking(spark, d):
    scores = _scores(spark, d).withColumn("run_date", F.concat_ws(" ", "stage", "run_date"))
    costs = scores.select("run_date", "model", F.length("model").alias("cost_usd"))
    return M.rank_models(scores.drop("stage"), costs).select("run_date", "model", F.col("rank").cast("long").alias("rank"))


# Candidates: a document per customer and month, so that none grows with the table.
CANDIDATE_SQL = """
o AS (SELECT o_custkey || '-' || strftime(o_orderdate, '%Y-%m') AS run_date, o_orderkey AS k, o_orderpriority AS p,
  row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) - 1 AS pos FROM orders),
-- Without any item of its desks a run's ids are not checked.
has AS (SELECT run_date, bool_or(k % 5 <> 0) AS checked FROM o GROUP BY run_date),
u AS (SELECT o.*, NOT checked OR k % 5 <> 0 AS known FROM o JOIN has USING (run_date)),
v AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY pos) AS rn FROM u WHERE known AND k % 7 <> 0)
"""


def _candidate_documents(spark, d):
    o = table(spark, d, "orders").select(
        F.format_string("%d-%s", "o_custkey", F.date_format("o_orderdate", "yyyy-MM")).alias("run_date"),
        F.col("o_orderkey").alias("k"),
        F.col("o_orderpriority").alias("p"),
    )
    long = F.repeat(F.concat(F.col("p"), F.lit(" ")), 40)
    evidence = F.array(*[F.struct(F.concat(F.lit(f"s{i}"), F.col("p")).alias("source"), F.lit("q" * 150).alias("excerpt"), F.lit("f").alias("framing")) for i in range(3)])
    entry = F.struct(
        F.format_string(" i%d ", "k").alias("item_id"),
        F.when(F.col("k") % 7 == 0, "gossip").otherwise(" causal_divergence ").alias("seam_type"),
        long.alias("candidate_one_line"),
        F.col("p").alias("why_it_might_matter"),
        evidence.alias("possible_evidence"),
    )
    held = o.groupBy("run_date").agg(F.array_sort(F.collect_list(F.struct("k", entry.alias("entry")))).alias("x"))
    cross = F.transform("x", lambda a: F.struct(F.lit("c").alias("candidate_one_line"), F.transform(F.slice("x", 1, 3), lambda b: F.format_string("i%d", b["k"])).alias("linked_item_ids"), a["entry"]["why_it_might_matter"].alias("why_it_might_matter")))
    raw = F.to_json(F.struct(F.transform("x", lambda a: a["entry"]).alias("candidates"), cross.alias("cross_domain_candidates")))
    desk = o.where("k % 5 <> 0").select("run_date", F.lit("d").alias("desk"), F.lit(0).alias("desk_pos"), F.col("k").cast("int").alias("pos"), F.format_string("i%d", "k").alias("item_id"))
    return held.select("run_date", raw.alias("raw")), desk


@query(
    "accepted_candidates",
    f"""WITH {CANDIDATE_SQL} SELECT run_date, CAST(pos AS INTEGER) AS pos, 'i' || k AS item_id, 'causal_divergence' AS seam_type,
      md5(CASE WHEN length(trim(repeat(p || ' ', 40), ' ')) > 220 THEN rtrim(substr(trim(repeat(p || ' ', 40), ' '), 1, 217), ' ') || '...' ELSE trim(repeat(p || ' ', 40), ' ') END) AS line,
      's0' || p || ',s1' || p AS sources, 140 AS excerpt FROM v WHERE rn <= 5""",
)
def _accepted(spark, d):
    raw, desk = _candidate_documents(spark, d)
    own, _, _ = C.seam_candidates(raw, desk)
    out = C.accepted_candidates(own, desk)
    quoted = F.length(F.get("possible_evidence", F.lit(1))["excerpt"])
    return out.select(
        "run_date", "pos", F.trim("item_id").alias("item_id"), "seam_type", F.md5("candidate_one_line").alias("line"),
        F.array_join(F.col("possible_evidence")["source"], ",").alias("sources"), quoted.alias("excerpt"),
    )


@query(
    "accepted_cross_candidates",
    f"""WITH {CANDIDATE_SQL}, l AS (SELECT run_date, string_agg('i' || k, ',' ORDER BY k) AS linked, count(*) AS n FROM u WHERE pos < 3 AND known GROUP BY run_date)
    SELECT u.run_date, CAST(pos AS INTEGER) AS pos, linked, p AS why FROM u JOIN l USING (run_date) WHERE n >= 2 AND pos < 2""",
)
def _accepted_cross(spark, d):
    raw, desk = _candidate_documents(spark, d)
    _, cross, _ = C.seam_candidates(raw, desk)
    out = C.accepted_cross_candidates(cross)
    return out.select("run_date", "pos", F.array_join("linked_item_ids", ",").alias("linked"), F.col("why_it_might_matter").alias("why"))


@query(
    "sanitized_titles",
    """WITH t AS (SELECT doc_id, array_to_string(list_filter(
         string_split(regexp_replace(regexp_replace(regexp_replace(text, '[<>&]', ' ', 'g'), '\\r\\n?|[\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), '\\n$', ''), chr(10)),
         lambda x: NOT regexp_matches(lower(trim(x, ' ' || chr(9))), '^(system:|assistant:|ignore |important instruction|new instructions|override:|you are now|forget everything|\\[system\\]|\\[assistant\\])')
           AND NOT regexp_matches(lower(x), 'ignore previous instructions|ignore all previous|disregard the above|you must now|your new role is|act as if you are|pretend you are|disregard your previous')), chr(10)) AS a
       FROM documents)
    SELECT doc_id, substr(a, 1, 200) AS title FROM t""",
)
def _titles(spark, d):
    # Marks of markup become blanks first, as SQL has no parser; html_text covers markup.
    plain = F.regexp_replace("text", "[<>&]", " ")
    return table(spark, d, "documents").select("doc_id", X.sanitize_title(plain).alias("title"))


@query(
    "regional_selection",
    """WITH i AS (SELECT lang || '-' || (doc_id % 50) AS run_date, doc_id AS pos, source, length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) >= 400 AS useful FROM documents WHERE lang IN ('en', 'es')),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY CASE WHEN useful THEN 0 ELSE 1 END, pos) AS rn FROM i)
    SELECT run_date, pos, source, rn::INTEGER AS rank FROM r WHERE rn <= 4""",
)
def _regional(spark, d):
    # Long texts keep what stands after their first 360 characters: useful from 40 on.
    rest = F.expr("substring(trim(BOTH ' \\n\\t\\r' FROM text), 361)")
    items = table(spark, d, "documents").select(
        F.format_string("%s-%d", "lang", F.col("doc_id") % 50).alias("run_date"),
        F.col("doc_id").alias("pos"),
        "source",
        F.when(F.col("lang").isin("en", "es"), "regional-west").otherwise("world").alias("category"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x"), rest)).alias("summary"),
        F.concat(F.lit("x"), rest).alias("rss_body"),
    )
    items = items.withColumns({c: F.expr(f"substring({c}, 2)") for c in ("summary", "rss_body")})
    return regional_selection(items).select("run_date", "pos", "source", "rank")


@query(
    "successful_research",
    """SELECT user_id, CAST(count(*) AS BIGINT) AS results, max(event_id) AS newest FROM events
    WHERE event_type IN ('view', 'click') AND event_id % 9 <> 0 GROUP BY user_id""",
)
def _research(spark, d):
    from newsloom.operators.routing import USABLE_RESEARCH

    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "view", USABLE_RESEARCH[0]).when(F.col("event_type") == "click", USABLE_RESEARCH[-1]).otherwise("failed")
    rows = e.select("user_id", "event_id", status.alias("status"), F.when(F.col("event_id") % 9 != 0, "s").otherwise(F.when(F.col("event_id") % 2 == 0, "")).alias("summary"))
    return successful_research(rows).groupBy("user_id").agg(F.count(F.lit(1)).alias("results"), F.max("event_id").alias("newest"))


@query(
    "validated_seams",
    """WITH l AS (SELECT strftime(o_orderdate, '%Y-%m') AS run_date, o_orderkey AS pos, count(*) FILTER (l_suppkey % 3 <> 0) AS kept
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT run_date, pos, 'T' || pos AS topic, '' AS present_in, CAST(kept AS INTEGER) AS links FROM l""",
)
def _validated_seams(spark, d):
    o = table(spark, d, "orders").select(month(), F.col("o_orderkey").alias("pos"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pos"), "l_linenumber", "l_suppkey")
    # Each link has a URL of its own, so that repeats are no matter here.
    url = F.format_string("http://s%d.example.org/a/%d/%d", "l_suppkey", "pos", "l_linenumber")
    links = li.select("pos", "l_linenumber", "l_suppkey", url.alias("url"), F.lit("L").alias("label"))
    nested = links.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "url", "label"))).alias("x"))
    nested = nested.select("pos", F.transform("x", lambda x: F.struct(x["url"].alias("url"), x["label"].alias("label"))).alias("links"))
    none = F.lit(None).cast("string")
    seams = o.join(nested, "pos").select("run_date", "pos", F.format_string("T%d", "pos").alias("topic"), none.alias("description"), none.alias("present_in"), none.alias("absent_from"), "links")
    known = links.where("l_suppkey % 3 <> 0").join(o, "pos").select("run_date", "url")
    clean, _ = V.validate_seams(seams, known, "gap")
    return clean.select("run_date", "pos", "topic", "present_in", F.size("links").alias("links"))
