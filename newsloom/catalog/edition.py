"""Edition jobs: one edition per month of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.carriers import month_runs, outlet_links
from newsloom.catalog.registry import query, table
from newsloom.catalog.texts import SANITIZED_SQL
from newsloom.operators import routing as D
from newsloom.operators.joins import join_selection, known_urls, link_urls
from newsloom.operators.links import keep_desk_links
from newsloom.operators.selection import primary_coverage
from newsloom.operators.validation import validate_glance
from newsloom.plans import edition as P
from newsloom.session import cut

DESKS = ["geopolitics_events", "ai_tech", "defense_space", "econ", "culture_structural"]
TAGS = ["war", "ai", "defense", "econ", "domestic"]


def desk_items(spark, d):
    """Orders as desk items: priority = desk, line items = links."""
    links = outlet_links(spark, d).groupBy("item_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", "url", "label"))),
            lambda x: F.struct(x["url"].alias("url"), x["label"].alias("label")),
        ).alias("links")
    )
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    names = F.array(*[F.lit(x) for x in DESKS])
    tags = F.array(*[F.lit(x) for x in TAGS])
    o = month_runs(spark, d)
    none = F.array().cast("array<struct<url:string,label:string>>")
    return o.join(links, o["o_orderkey"] == links["item_id"], "left").select(
        "run_date",
        F.element_at(names, n).alias("desk"),
        n.alias("desk_pos"),
        F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("item_id"),
        F.element_at(tags, n).alias("tag"),
        F.format_string("Order %d of customer %d", "o_orderkey", "o_custkey").alias("headline"),
        F.col("o_orderpriority").alias("facts"),
        F.col("o_orderstatus").alias("analysis"),
        F.when(F.col("o_orderkey") % 2 == 0, "corroborated").otherwise("widely-reported").alias("source_depth"),
        F.coalesce("links", none).alias("links"),
        F.array().cast("array<struct<entity:string,region:string,theme:string,policy:string>>").alias("connection_hooks"),
        (F.col("o_orderkey") % 5 == 0).alias("deep_dive_candidate"),
        F.lit("matters").alias("deep_dive_rationale"),
    )


def selections(spark, d):
    """Every third order is selected, some with an id that does not exist."""
    o = month_runs(spark, d).where("o_orderkey % 3 = 0 and o_orderpriority not like '1%'")
    known = F.concat(F.lit("i"), F.col("o_orderkey").cast("string"))
    return o.select(
        "run_date",
        F.col("o_orderkey").alias("pos"),
        F.when(F.col("o_orderkey") % 7 == 0, "ghost").otherwise(known).alias("item_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("note")).alias("cross_domain_note"),
    )


SEL_SQL = """
d AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS run_date, o_orderkey AS pos, 'i' || o_orderkey AS item_id, CAST(o_orderpriority[1] AS INTEGER) AS n FROM orders),
s AS (SELECT run_date, pos, item_id FROM d WHERE pos % 3 = 0 AND n <> 1 AND pos % 7 <> 0)
"""


@query(
    "join_selection",
    f"""WITH {SEL_SQL} SELECT d.run_date, d.pos, d.item_id, ['war', 'ai', 'defense', 'econ', 'domestic'][n] AS tag,
      ['Conflict', 'AI', 'Defense', 'Economy', 'Politics'][n] AS tag_label, CASE WHEN d.pos % 2 = 0 THEN 'note' END AS cross_domain_note FROM s JOIN d ON s.item_id = d.item_id""",
)
def _join(spark, d):
    out = join_selection(selections(spark, d), desk_items(spark, d))
    return out.select("run_date", "pos", "item_id", "tag", "tag_label", "cross_domain_note")


@query(
    "primary_coverage",
    f"""WITH {SEL_SQL}, have AS (SELECT DISTINCT s.run_date, n FROM s JOIN d ON s.item_id = d.item_id),
    f AS (SELECT *, row_number() OVER (PARTITION BY run_date, n ORDER BY pos) AS rn FROM d WHERE n IN (1, 2, 3) AND pos % 5 <> 0)
    SELECT f.run_date, ['war', 'ai', 'defense'][f.n] AS tag, item_id FROM f LEFT JOIN have h ON f.run_date = h.run_date AND f.n = h.n WHERE rn = 1 AND h.n IS NULL""",
)
def _coverage(spark, d):
    desk = desk_items(spark, d)
    out = primary_coverage(join_selection(selections(spark, d), desk), desk)
    return out.select("run_date", "tag", "item_id")


@query(
    "passthrough_edition",
    f"""WITH {SEL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY n, pos) AS rn FROM d WHERE pos % 5 = 0)
    SELECT run_date, CAST(rn AS INTEGER) AS pos, 'Order ' || r.pos || ' of customer ' || o_custkey AS headline,
      '<p>' || o_orderpriority || '</p>' || chr(10) || '<p>' || o_orderstatus || '</p>' || chr(10) || '<p><em>Why this matters: matters</em></p>' AS body
    FROM r JOIN orders ON o_orderkey = r.pos WHERE rn <= 3""",
)
def _passthrough(spark, d):
    _, dives = P.passthrough_edition(desk_items(spark, d))
    return dives.select("run_date", "pos", "headline", "body")


def _inputs(spark, d):
    # Stands for the stored table of desk items.
    desk = cut(desk_items(spark, d))
    _, dives = P.passthrough_edition(desk)
    known = known_urls(link_urls(desk.where("pos % 4 <> 0")))
    reading = month_runs(spark, d).select(
        "run_date", F.col("o_orderkey").alias("pos"), F.lit("t").alias("title"), F.lit("http://nowhere.org/x").alias("url")
    )
    return desk, dives, known, reading


@query("edition_build")
def _build(spark, d):
    desk, dives, known, reading = _inputs(spark, d)
    out = P.build_edition(selections(spark, d), desk, dives, reading, known)
    return out.glance.select("run_date", "rank", "item_id", "tag", "source_depth", F.size("links").alias("links"))


@query("edition_assembly")
def _assembly(spark, d):
    desk, dives, known, reading = _inputs(spark, d)
    glance = join_selection(selections(spark, d), desk)
    notes = desk.where("pos % 6 = 0").select(
        "run_date",
        "item_id",
        "pos",
        F.lit("A line. ").alias("one_line"),
        F.lit("framing_divergence").alias("seam_type"),
        F.lit("high").alias("confidence"),
    )
    short, long, found = P.assemble_edition(glance, dives, notes)
    return short.select("run_date", "item_id", "context", F.col("seam_annotation.one_line").alias("one_line"))


@query(
    "validated_glance",
    f"""WITH {SEL_SQL}, l AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY l_orderkey)
    SELECT d.run_date, d.pos, CAST(coalesce(l.n, 0) AS INTEGER) AS links, d.pos % 11 = 0 AS echo FROM s JOIN d ON s.item_id = d.item_id LEFT JOIN l ON l_orderkey = d.pos""",
)
def _validated(spark, d):
    glance = join_selection(selections(spark, d), desk_items(spark, d))
    good = outlet_links(spark, d).where("l_suppkey % 2 = 0")
    runs = month_runs(spark, d).select("run_date", F.col("o_orderkey").alias("item_id"))
    known = known_urls(good.join(runs, "item_id").select("run_date", "url"))
    titles = desk_items(spark, d).where("pos % 11 = 0").select("run_date", F.upper("headline").alias("title"))
    clean, _ = validate_glance(glance, known, titles)
    return clean.select("run_date", "pos", F.size("links").alias("links"), "echo")


@query(
    "desk_routing",
    """WITH w AS (SELECT * FROM (VALUES ('en', 'world'), ('fr', 'world'), ('fr', 'culture'), ('de', 'culture')) AS t(lang, desk))
    SELECT doc_id AS pos, lang AS category, desk FROM documents JOIN w USING (lang) WHERE doc_id % 10 <> 0""",
)
def _routing(spark, d):
    desks = spark.createDataFrame([("world", 0, ["en", "fr"], []), ("culture", 1, ["fr", "de"], [])], D.DESK_DDL)
    its = table(spark, d, "documents").select(
        F.col("doc_id").alias("pos"),
        F.col("lang").alias("category"),
        F.when(F.col("doc_id") % 10 == 0, "headline_radar").alias("analysis_mode"),
    )
    return D.route_items(its, desks).select("pos", "category", "desk")


@query(
    "unrouted_categories",
    "SELECT DISTINCT lang AS category FROM documents WHERE lang NOT IN ('en', 'fr', 'de')",
)
def _unrouted(spark, d):
    desks = spark.createDataFrame([("world", 0, ["en", "fr"], []), ("culture", 1, ["fr", "de"], [])], D.DESK_DDL)
    return D.unrouted_categories(table(spark, d, "documents").select(F.col("lang").alias("category")), desks)


@query(
    "desk_link_filter",
    f"""WITH {SEL_SQL}, l AS (SELECT d.run_date, d.n, d.pos, l_suppkey FROM d JOIN lineitem ON l_orderkey = d.pos),
    h AS (SELECT DISTINCT run_date, n, l_suppkey FROM l WHERE pos % 4 = 0),
    k AS (SELECT l.pos, count(*) AS c FROM l JOIN h ON l.run_date = h.run_date AND l.n = h.n AND l.l_suppkey = h.l_suppkey GROUP BY l.pos)
    SELECT d.pos, CAST(coalesce(c, 0) AS INTEGER) AS links FROM d LEFT JOIN k ON d.pos = k.pos""",
)
def _desk_links(spark, d):
    desk = desk_items(spark, d)
    routed = desk.where("pos % 4 = 0").select("run_date", "desk", F.explode("links").alias("l")).select("run_date", "desk", "l.url")
    return keep_desk_links(desk, routed).select("pos", F.size("links").alias("links"))


@query(
    "text_pack",
    r"""WITH r AS (SELECT lang, doc_id, source, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang AS category, CAST(any_value(n) AS BIGINT) AS items, string_agg(source || '#' || doc_id, chr(10) ORDER BY rn) AS text FROM r WHERE rn <= 8 GROUP BY lang""",
)
def _pack(spark, d):
    from newsloom.operators.metrics import text_pack

    docs = table(spark, d, "documents").select(F.col("lang").alias("category"), F.col("doc_id").alias("pos"), "source")
    line = F.concat(F.col("source"), F.lit("#"), F.col("pos").cast("string"))
    return text_pack(docs, ["category"], line, 8)


@query(
    "category_pack",
    f"""WITH {SANITIZED_SQL}, c AS (SELECT d.doc_id, source, coalesce(lang, 'uncategorized') AS category, coalesce(split_part(text, chr(10), 1), '?') AS title, b,
      row_number() OVER (PARTITION BY coalesce(lang, 'uncategorized') ORDER BY d.doc_id) AS rn FROM documents d JOIN sanitized e ON e.doc_id = d.doc_id),
    l AS (SELECT category, rn, '  ' || coalesce(source, '?') || ' [wire]: ' || title || ' — ' ||
      trim(CASE WHEN length(b) > 320 THEN rtrim(substr(b, 1, 319), ' ' || chr(10) || chr(9)) || '…' ELSE b END, ' ' || chr(10) || chr(9)) || chr(10) || '    URL: http://x' AS line FROM c)
    SELECT category, count(*) AS items, md5(chr(10) || '--- ' || upper(category) || ' (' || count(*) || ' items) ---' || chr(10) || string_agg(line, chr(10) ORDER BY rn) FILTER (rn <= 8)) AS digest
    FROM l GROUP BY category""",
)
def _category_pack(spark, d):
    docs = table(spark, d, "documents").select(
        F.lit("r").alias("run_date"),
        F.col("lang").alias("category"),
        F.col("doc_id").alias("pos"),
        "source",
        F.lit("wire").alias("reliability"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("summary"),
        F.lit("http://x").alias("url"),
    )
    return D.category_pack(docs).select("category", "items", F.md5("text").alias("digest"))


@query(
    "research_rows",
    """WITH q AS (SELECT o_orderkey AS idx, CAST(date_trunc('month', o_orderdate) AS DATE) AS run_date, o_custkey, o_orderstatus FROM orders)
    SELECT run_date, idx, CASE WHEN o_orderstatus = 'P' THEN 'rejected_malformed' WHEN idx % 2 = 0 THEN 'selected' ELSE 'rejected_unknown_url' END AS status,
      CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'http://r/' || idx END AS url FROM q""",
)
def _research(spark, d):
    o = month_runs(spark, d)
    text = F.concat(F.lit('{"url":" http://r/'), F.col("o_orderkey").cast("string"), F.lit(' ","priority":"HIGH"}'))
    raw = o.select(
        "run_date",
        F.lit("ai_tech").alias("desk"),
        F.lit(0).alias("desk_pos"),
        F.col("o_orderkey").alias("idx"),
        F.when(F.col("o_orderstatus") == "P", "[]").otherwise(text).alias("request"),
    )
    routed = o.where("o_orderkey % 2 = 0").select(
        "run_date",
        F.lit("ai_tech").alias("desk"),
        F.col("o_orderkey").alias("pos"),
        F.format_string("http://r/%d", "o_orderkey").alias("url"),
        F.lit("s").alias("source"),
        F.lit("t").alias("title"),
    )
    return D.request_rows(raw, routed).select("run_date", "idx", "status", "url")


@query(
    "research_counts",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS run_date, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS fired,
      CAST(count(*) AS BIGINT) AS articles_fetched, bool_or(o_orderstatus = 'O') AS changed_output FROM orders GROUP BY 1""",
)
def _research_counts(spark, d):
    o = month_runs(spark, d).select(
        "run_date",
        F.col("o_orderpriority").alias("desk"),
        F.when(F.col("o_orderstatus") == "O", "cache_hit:ok").otherwise("http_error").alias("status"),
        F.lit("text").alias("summary"),
    )
    return D.research_counts(o)


@query("edition_structure")
def _structure(spark, d):
    from newsloom.plans.compare import edition_structure

    desk, dives, known, reading = _inputs(spark, d)
    glance = join_selection(selections(spark, d), desk)
    links = month_runs(spark, d).where("o_orderkey % 9 = 0").select(
        "run_date", F.array(F.lit("econ"), F.lit("defense")).alias("domains")
    )
    return edition_structure(glance, dives, reading, links)
