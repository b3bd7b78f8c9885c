"""Text and URL expressions over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.registry import query, table
from newsloom.functions import text as X
from newsloom.functions import urls as U

WORD_SQL = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+'), lambda x: x <> '')"


@query(
    "registered_domain",
    r"""SELECT page_id, lower(regexp_replace(split_part(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':', 1), '^(?i)www\.', '')) AS domain
    FROM pages""",
)
def _registered_domain(spark, d):
    return table(spark, d, "pages").select("page_id", U.registered_domain(F.col("url")).alias("domain"))


CANONICAL_SQL = r"""
parts AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS s,
         lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h,
         regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p,
         regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q
  FROM pages),
canon AS (
  SELECT page_id, url, s || '://' || h || CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/+$', '') END ||
    CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS canonical
  FROM (SELECT *, list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')
     AND NOT regexp_matches(lower(x), '^(fbclid|gclid|igshid|mc_cid|mc_eid)(=|$)')),
     lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END) AS k FROM parts))
"""


@query("url_canonical", f"WITH {CANONICAL_SQL} SELECT page_id, url, canonical FROM canon")
def _canonical(spark, d):
    return table(spark, d, "pages").select("page_id", "url", U.canonical_url(F.col("url")).alias("canonical"))


SANITIZED_SQL = """
stripped AS (SELECT doc_id, array_to_string(list_filter(
         string_split(regexp_replace(regexp_replace(text, '\\r\\n?|[\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), '\\n$', ''), chr(10)),
         lambda x: NOT regexp_matches(lower(trim(x, ' ' || chr(9))), '^(system:|assistant:|ignore |important instruction|new instructions|override:|you are now|forget everything|\\[system\\]|\\[assistant\\])')
           AND NOT regexp_matches(lower(x), 'ignore previous instructions|ignore all previous|disregard the above|you must now|your new role is|act as if you are|pretend you are|disregard your previous')), chr(10)) AS a
       FROM documents),
sanitized AS (SELECT doc_id, replace(replace(replace(a, '"}', '"' || chr(65533)), '}]', chr(65533) || ']'), '}}', chr(65533) || chr(65533)) AS b FROM stripped)
"""


@query(
    "sanitize_text",
    f"""WITH {SANITIZED_SQL} SELECT doc_id, md5(trim(CASE WHEN length(b) > 500 THEN rtrim(substr(b, 1, 499), ' ' || chr(10) || chr(9)) || '…' ELSE b END, ' ' || chr(10) || chr(9))) AS digest,
      CAST(length(trim(CASE WHEN length(b) > 500 THEN rtrim(substr(b, 1, 499), ' ' || chr(10) || chr(9)) || '…' ELSE b END, ' ' || chr(10) || chr(9))) AS BIGINT) AS chars
    FROM sanitized""",
)
def _sanitize(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.sanitize(F.col("text"), 500).alias("s"))
    return docs.select("doc_id", F.md5("s").alias("digest"), F.length("s").cast("bigint").alias("chars"))


@query(
    "clean_summary",
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)
    SELECT doc_id, CASE WHEN length(s) > 400 THEN substr(s, 1, 397) || '...' ELSE s END AS summary FROM t""",
)
def _clean_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_summary(F.col("text")).alias("summary"))


@query(
    "clip_text",
    r"""WITH t AS (SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS s FROM conversations)
    SELECT conv_id, turn, CASE WHEN length(s) > 220 THEN rtrim(substr(s, 1, 217), ' ' || chr(10) || chr(9) || chr(13)) || '...' ELSE s END AS clipped FROM t""",
)
def _clip(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.clip(F.col("text"), 220).alias("clipped"))


@query(
    "truncate_sentence",
    r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM conversations),
    c AS (SELECT *, rtrim(substr(s, 1, 220)) AS k FROM t),
    m AS (SELECT *, CASE WHEN instr(reverse(k), ' .') > 0 THEN length(k) - instr(reverse(k), ' .') - 1 ELSE -1 END AS a,
                    CASE WHEN instr(reverse(k), ' ?') > 0 THEN length(k) - instr(reverse(k), ' ?') - 1 ELSE -1 END AS b,
                    CASE WHEN instr(reverse(k), ' !') > 0 THEN length(k) - instr(reverse(k), ' !') - 1 ELSE -1 END AS e FROM c)
    SELECT conv_id, turn, CASE WHEN length(s) <= 220 THEN s WHEN a >= 80 THEN rtrim(substr(k, 1, a + 1))
      WHEN b >= 80 THEN rtrim(substr(k, 1, b + 1)) WHEN e >= 80 THEN rtrim(substr(k, 1, e + 1))
      ELSE rtrim(k, ' ,;:') || '...' END AS one_line FROM m""",
)
def _sentence(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", X.truncate_sentence(F.col("text")).alias("one_line")
    )


@query(
    "gram_counts",
    f"""WITH w AS (SELECT doc_id, {WORD_SQL} AS w FROM documents)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS words,
      CASE WHEN len(w) >= 10 THEN CAST(len(list_distinct(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' ')))) AS BIGINT) ELSE 0 END AS grams
    FROM w""",
)
def _grams(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id",
        F.size(X.gram_words(F.col("text"))).cast("bigint").alias("words"),
        F.size(X.word_grams(F.col("text"))).cast("bigint").alias("grams"),
    )


@query(
    "useful_summary",
    r"SELECT doc_id, length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) >= 40 AS useful FROM documents",
)
def _useful(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.has_useful_summary(F.col("text"), F.lit("")).alias("useful")
    )


@query(
    "press_release_filter",
    """SELECT page_id, url FROM pages WHERE NOT (contains(url, '/press_releases/') OR contains(html, 'PRNewswire')
    OR contains(html, '/ PRNewswire/') OR contains(html, 'Business Wire') OR contains(html, 'GlobeNewswire') OR contains(html, 'PR Newswire'))""",
)
def _press(spark, d):
    pages = table(spark, d, "pages")
    return pages.where(~X.is_press_release(F.col("url"), F.col("html"))).select("page_id", "url")


@query(
    "html_allow_list",
    r"""WITH k AS (SELECT page_id, regexp_replace(html, '<(/?)((?i:p|em|strong|a|ul|li|ol|br)\b[^>]*)>', chr(1) || '\1\2' || chr(2), 'g') AS t FROM pages),
    o AS (SELECT page_id, replace(replace(regexp_replace(t, '</?\w+[^>]*>', '', 'g'), chr(1), '<'), chr(2), '>') AS t FROM k)
    SELECT page_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM o""",
)
def _allow(spark, d):
    out = X.keep_allowed_tags(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(out).alias("digest"), F.length(out).alias("chars"))


@query("html_text")
def _html_text(spark, d):
    out = X.clean_body(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(out).alias("digest"), F.length(out).alias("chars"))


@query(
    "paywall_status",
    r"""WITH t AS (SELECT doc_id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS s FROM documents)
    SELECT doc_id, CASE WHEN length(s) >= 300 THEN 'ok'
      WHEN regexp_matches(lower(substr(s, 1, 500)), 'subscribe|sign in|paywall|log in to continue') THEN 'paywall'
      ELSE 'extraction_failed' END AS status FROM t""",
)
def _paywall(spark, d):
    return table(spark, d, "documents").select("doc_id", X.paywall_status(F.col("text")).alias("status"))


@query(
    "urls_in_text",
    r"SELECT page_id, CAST(len(regexp_extract_all(html, 'https?://\S+')) AS BIGINT) AS urls FROM pages",
)
def _find_urls(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(X.find_urls(F.col("html"))).cast("bigint").alias("urls"))


@query(
    "transcript_budget",
    r"""WITH t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS s FROM conversations GROUP BY conv_id),
    w AS (SELECT conv_id, s, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') AS w FROM t)
    SELECT conv_id, CAST(len(w) AS BIGINT) AS words,
      CAST(greatest(300, least(1200, round_even(len(w) * 0.175::DOUBLE, 0))) AS INTEGER) AS target,
      CASE WHEN s = '' THEN 0 ELSE greatest(1, length(s) // 4) END::BIGINT AS tokens,
      md5(array_to_string(w[1:CAST(greatest(300, least(1200, round_even(len(w) * 0.175::DOUBLE, 0))) AS INTEGER)], ' ')) AS fallback
    FROM w""",
)
def _transcripts(spark, d):
    from newsloom.sources.transcripts import join_snippets

    t = join_snippets(table(spark, d, "conversations"), ["conv_id"], "turn", "text")
    n = F.size(X.words(F.col("transcript")))
    return t.select(
        "conv_id",
        n.cast("bigint").alias("words"),
        X.target_words(n).alias("target"),
        X.token_estimate(F.col("transcript")).alias("tokens"),
        F.md5(X.first_words(F.col("transcript"), X.target_words(n))).alias("fallback"),
    )


@query(
    "content_ids",
    r"""WITH l AS (SELECT l_orderkey, list_sort(list('https://www.s' || l_suppkey || '.example.org/p/' || l_partkey)) AS u FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS item, 'desk-' || substr(sha256(CASE WHEN u IS NOT NULL THEN array_to_string(u, chr(10))
      ELSE lower(o_orderpriority) || chr(10) || lower(o_orderstatus) END), 1, 32) AS item_id
    FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""",
)
def _content_ids(spark, d):
    from newsloom.catalog.carriers import outlet_links

    links = outlet_links(spark, d).groupBy("item_id").agg(F.collect_list(F.struct("url")).alias("links"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), "o_orderpriority", "o_orderstatus")
    both = o.join(links, "item_id", "left")
    rid = X.content_id(F.lit("desk"), F.col("links"), F.col("o_orderpriority"), F.col("o_orderstatus"))
    return both.select(F.col("item_id").alias("item"), rid.alias("item_id"))


@query("cache_keys", "SELECT page_id, sha1(url) AS cache_key FROM pages")
def _cache_keys(spark, d):
    return table(spark, d, "pages").select("page_id", X.cache_key(F.col("url")).alias("cache_key"))
