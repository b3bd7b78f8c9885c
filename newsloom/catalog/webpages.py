"""Landed pages and feeds: links, bodies, items, collection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.catalog.registry import SQL, query, table
from newsloom.plans import collect as C
from newsloom.session import checkpoint_dir
from newsloom.sources import feeds as S
from newsloom.sources import markup as H
from newsloom.sources.archive import PayloadArchive
from newsloom.streaming.jobs import run_append


# Links of the given pages are single words, so each page is an index of itself too. Titles
# are cut off anywhere, and HTML reads these entities without their semicolon as well.
LINKS_SQL = r"""
p AS (SELECT page_id, url AS base, regexp_extract(html, '<title>([^<]*)</title>', 1) AS shown FROM pages),
t AS (SELECT page_id, base AS url, regexp_extract(base, '^https?://[^/?#]*([^?#]*)', 1) AS path,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(shown, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS title FROM p)
"""


@query(
    "article_links",
    rf"""WITH {LINKS_SQL} SELECT page_id, 0 AS pos, url, title FROM t WHERE length(title) BETWEEN 18 AND 180 AND len(string_split(title, ' ')) >= 3
      AND NOT regexp_matches(lower(title), 'subscribe|sign in|log in') AND path NOT IN ('', '/')""",
)
def _links(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    href = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    link = F.concat(F.lit('<a href="'), href, F.lit('">'), title, F.lit("</a>"))
    return H.article_links(table(spark, d, "pages").withColumn("html", F.concat(link, F.col("html"))))


@query(
    "page_anchors",
    r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<a [^>]*href="[^"]+"')) AS BIGINT) AS anchors FROM pages""",
)
def _anchors(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.size(H.anchors(F.col("html"))).cast("bigint").alias("anchors"))


@query(
    "index_links",
    r"""WITH a AS (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS title FROM documents),
    f AS (SELECT * FROM a WHERE length(title) BETWEEN 18 AND 180 AND len(string_split(title, ' ')) >= 3 AND NOT contains(lower(title), 'subscribe')
      AND NOT contains(lower(title), 'sign in') AND NOT contains(lower(title), 'log in') AND doc_id % 4 <> 3)
    SELECT source AS page_id, 'https://' || source || '.org/' || CASE f.doc_id % 4 WHEN 0 THEN 'n/' WHEN 1 THEN 'list/' ELSE 'up/' END || f.doc_id AS url, title
    FROM f JOIN documents d ON f.doc_id = d.doc_id""",
)
def _index(spark, d):
    k = F.col("doc_id") % 4
    i = F.col("doc_id").cast("string")
    href = (
        F.when(k == 0, F.concat(F.lit("/n/"), i))
        .when(k == 1, i)
        .when(k == 2, F.concat(F.lit("../up/"), i))
        .otherwise(F.concat(F.lit("/tag/"), i))
    )
    shown = F.replace(F.replace(F.substring_index("text", "\n", 1), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    link = F.concat(F.lit('<li><a class="x" href="'), href, F.lit('">'), shown, F.lit("</a></li>"))
    docs = table(spark, d, "documents").select("source", F.floor(F.col("doc_id") / 70).alias("n"), link.alias("a"))
    # An index page shows a day's documents.
    pages = docs.groupBy(F.col("source").alias("page_id"), "n").agg(F.array_join(F.collect_list("a"), "").alias("html"))
    pages = pages.withColumn("url", F.concat(F.lit("https://"), F.col("page_id"), F.lit(".org/list/")))
    keyed = pages.withColumn("page", F.struct("page_id", "n"))
    return H.article_links(keyed, key="page").select("page.page_id", "url", "title")


@query("page_bodies")
def _bodies(spark, d):
    out = H.extract_bodies(table(spark, d, "pages"))
    return out.select("page_id", "status", "raw_length", F.md5("text").alias("digest"))


@query(
    "repository_cards",
    """WITH c AS (SELECT p_brand, p_partkey, p_name, p_type, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(p_partkey AS VARCHAR) || '">') AS rn FROM part)
    SELECT p_brand AS page_id, CAST(rn - 1 AS INTEGER) AS pos, 'o/' || replace(p_name, ' ', '') AS name, 'https://github.com/o/p' || p_partkey AS url, p_type AS description,
      'SQL' AS language, p_size || ' stars today' AS stars_today FROM c WHERE rn <= 10""",
)
def _cards(spark, d):
    card = F.concat(
        F.lit('<article class="Box-row"><h2><a href="/o/p'), F.col("p_partkey").cast("string"), F.lit('"> o / '), F.col("p_name"),
        F.lit('</a></h2><p>'), F.col("p_type"), F.lit('</p><span itemprop="programmingLanguage">SQL</span><span class="float-sm-right">'),
        F.col("p_size").cast("string"), F.lit(" stars today</span></article>"),
    )
    pages = table(spark, d, "part").groupBy(F.col("p_brand").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(card)), "").alias("html"))
    return H.repository_cards(pages, 10)


def feed_documents(spark, d):
    """Documents as landed feed files: one per source and day, 70 documents a day."""
    docs = table(spark, d, "documents").select(
        "doc_id", "source", F.date_add(
            F.lit("2024-01-01").cast("date"), F.floor(F.col("doc_id") / 70).cast("int")
        ).alias("run_date"), "text"
    )
    when = F.when(F.col("doc_id") % 5 == 0, "").otherwise(
        F.date_format(
            F.col("run_date").cast("timestamp") - F.make_dt_interval(hours=(F.col("doc_id") % 60).cast("int")),
            "EEE, d MMM yyyy HH:mm:ss '+0000'",
        )
    )
    item = F.concat(
        F.lit("<item><title> Doc "), F.col("doc_id").cast("string"), F.lit(" </title><link>http://d/"), F.col("doc_id").cast("string"),
        F.lit("</link><pubDate>"), when, F.lit("</pubDate><description><![CDATA[<p>"), F.regexp_replace("text", r"\]\]>|[\x00-\x08\x0b\x0c\x0e-\x1f]", ""),
        F.lit("</p>]]></description></item>"),
    )
    rows = docs.select("run_date", "source", "doc_id", item.alias("item"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"]), "")
    return rows.groupBy("run_date", "source").agg(
        F.concat(F.lit('<rss version="2.0"><channel>'), body, F.lit("</channel></rss>")).alias("payload")
    )


@query(
    "feed_items",
    """WITH d AS (SELECT *, DATE '2024-01-01' + CAST(doc_id // 70 AS INTEGER) AS run_date, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 60 END AS age FROM documents),
    f AS (SELECT *, row_number() OVER (PARTITION BY run_date, source ORDER BY doc_id) AS rn FROM d
      WHERE age IS NULL OR CAST(run_date AS TIMESTAMP) - to_hours(CAST(age AS INTEGER)) >= TIMESTAMP '2024-01-09 12:00:00' - INTERVAL 36 HOUR)
    SELECT run_date, source, 'Doc ' || doc_id AS title, 'http://d/' || doc_id AS url FROM f WHERE rn <= CASE source WHEN 'src1' THEN 1 ELSE 2 END""",
)
def _feed(spark, d):
    entries = S.parse_payloads(feed_documents(spark, d))
    now = F.lit("2024-01-09 12:00:00").cast("timestamp")
    plain = entries.withColumns({"category": F.lit("c"), "tag": F.lit("t")})
    items = S.feed_items(plain, now, {"src1": 1} | {f"src{i}": 2 for i in range(2, 20)} | {"src0": 2})
    return items.select("run_date", "source", "title", "url")


def _archive(spark, d, broken: bool = False) -> str:
    """Folder of feed documents as JSON lines; ``broken`` adds lines that are none."""
    spark.dataSource.register(PayloadArchive)
    feeds = feed_documents(spark, d)
    lines = feeds.select(F.to_json(F.struct("run_date", "source", "payload")).alias("value"))
    if broken:
        names = feeds.select(F.concat_ws(" ", F.col("run_date").cast("string"), "source").alias("name"), F.dayofmonth("run_date").alias("day"))
        bad = F.when(F.col("day") % 3 == 0, F.concat(F.lit('{"source": "'), F.col("name"))).when(
            F.col("day") % 3 == 1, F.concat(F.lit('{"run_date": "'), F.col("name"), F.lit('"}'))
        )
        lines = lines.unionByName(names.select(F.coalesce(bad, F.concat(F.lit('["'), F.col("name"), F.lit('"]'))).alias("value")))
    folder = f"{checkpoint_dir(spark)}/archives/{uuid.uuid4().hex}"
    lines.write.text(folder)
    return folder


def _feed_caps(entries):
    now = F.lit("2024-01-09 12:00:00").cast("timestamp")
    plain = entries.withColumns({"category": F.lit("c"), "tag": F.lit("t")})
    items = S.feed_items(plain, now, {"src1": 1} | {f"src{i}": 2 for i in range(2, 20)} | {"src0": 2})
    return items.select("run_date", "source", "title", "url")


@query("archive_feed_items", SQL["feed_items"])
def _archive_items(spark, d):
    rows = spark.read.format("payload_archive").load(_archive(spark, d))
    return _feed_caps(S.parse_payloads(rows.select("run_date", "source", "payload")))


@query("stream_archive_items", SQL["feed_items"])
def _archive_stream(spark, d):
    stream = spark.readStream.format("payload_archive").load(_archive(spark, d))
    entries = S.parse_payloads(stream.select("run_date", "source", "payload"))
    return _feed_caps(run_append(entries, "archive"))


@query(
    "archive_issues",
    """WITH f AS (SELECT DISTINCT DATE '2024-01-01' + CAST(doc_id // 70 AS INTEGER) AS run_date, source FROM documents),
    n AS (SELECT run_date || ' ' || source AS name, date_part('day', run_date) % 3 AS k FROM f)
    SELECT CASE k WHEN 0 THEN 'corrupt_json' WHEN 1 THEN 'not a date' ELSE 'not an object' END AS issue,
      CASE k WHEN 0 THEN '{"source": "' || name WHEN 1 THEN '{"run_date": "' || name || '"}' ELSE '["' || name || '"]' END AS payload FROM n""",
)
def _archive_issues(spark, d):
    rows = spark.read.format("payload_archive").load(_archive(spark, d, broken=True))
    return rows.where("issue IS NOT NULL").select("issue", "payload")


@query(
    "collect_diagnostics",
    """WITH d AS (SELECT *, DATE '2024-01-01' + CAST(doc_id // 70 AS INTEGER) AS run_date, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 60 END AS age,
      CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS k FROM documents),
    n AS (SELECT run_date, source, k, least(15, count(*) FILTER (age IS NULL OR CAST(run_date AS TIMESTAMP) - to_hours(CAST(age AS INTEGER)) >= TIMESTAMP '2024-01-09 12:00:00' - INTERVAL 36 HOUR)) AS c
      FROM d GROUP BY ALL),
    s AS (SELECT *, CASE WHEN k = 7 THEN 'skipped_broken' WHEN k = 9 THEN 'skipped_cooldown' WHEN k % 4 = 0 THEN 'http_error' WHEN c > 0 THEN 'ok' ELSE 'empty' END AS status FROM n)
    SELECT status, CAST(count(*) AS BIGINT) AS feeds, CAST(sum(CASE WHEN status = 'ok' THEN c ELSE 0 END) AS BIGINT) AS items FROM s GROUP BY status""",
)
def _collect(spark, d):
    docs = feed_documents(spark, d)
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    fetches = docs.select(
        "run_date",
        number.alias("pos"),
        "source",
        F.concat(F.lit("http://"), F.col("source")).alias("url"),
        F.lit("rss").alias("mode"),
        F.when(number == 7, "broken").otherwise("active").alias("health"),
        (number == 9).alias("skipped"),
        F.when(number % 4 == 0, 503).otherwise(200).alias("status_code"),
        F.when(number % 4 != 0, F.col("payload")).alias("payload"),
        F.lit("c").alias("category"),
        F.lit("t").alias("tag"),
    )
    entries = S.parse_payloads(fetches.where("payload is not null").select("run_date", "source", "payload", "category", "tag"))
    items, report = C.collect_items(fetches, entries, F.lit("2024-01-09 12:00:00").cast("timestamp"))
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("feeds"), F.sum("item_count").alias("items"))


@query(
    "new_feed_rules",
    """WITH f AS (SELECT source AS name, count(*) AS entries, max(CASE WHEN doc_id % 5 <> 0 THEN doc_id % 60 END) AS m, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS k FROM documents GROUP BY source)
    SELECT name, CAST(entries AS BIGINT) AS entries, concat_ws('; ', CASE WHEN k % 4 = 0 THEN 'missing category' WHEN k % 4 = 1 THEN 'category ''odd'' not routed to any desk' END,
      CASE WHEN k % 3 = 0 THEN 'missing health field' WHEN k % 3 = 1 THEN 'invalid health ''fine''' END) AS errors FROM f""",
)
def _rules(spark, d):
    from newsloom.plans.health import feed_checks, new_feed_errors

    docs = table(spark, d, "documents")
    k = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    feeds = docs.select(F.col("source").alias("name")).distinct().select(
        "name",
        F.when(k % 4 == 0, "").when(k % 4 == 1, "odd").otherwise("en").alias("category"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "fine").otherwise("low_frequency").alias("health"),
    )
    now = F.lit("2024-01-09 12:00:00").cast("timestamp")
    entries = docs.select(F.col("source").alias("feed"), F.col("source").alias("title"), now.alias("published"))
    out = new_feed_errors(feed_checks(feeds, entries), ["en", "fr"], now)
    return out.select("name", "entries", F.array_join("errors", "; ").alias("errors"))
