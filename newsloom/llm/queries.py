"""The operators as queries over the given tables, with SQL where it can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.toxicity import toxicity

    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_tokens")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))




@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.substrings import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from newsloom.llm.bpe import load_ranks, round_trip

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm import secrets as s

    found = s.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = F.array_sort(F.concat("base", "added"))
    kinds = {f"n_{k}": s.count_kind(F.col("base"), i) for i, k in enumerate(s.KINDS[:3])}
    return found.select(
        "doc_id",
        *[c.alias(n) for n, c in kinds.items()],
        F.sha2(s.spelled(F.col("base")), 256).alias("base_sha256"),
        s.spelled(both).alias("spans"),
    )


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


@query
def op9_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.packing import shard_by_bytes

    out = shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.store import fresh
    from newsloom.llm.warc import read_archives, write_archives

    folder = fresh(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).drop("payload", "url")


SQL["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM o
"""


@query
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


SQL["op6_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("_row", "leads")


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.codes import compress, digest, hex_code

    out, books = compress(table(spark, sf_dir, "embeddings"))
    return out.select(
        F.col("id").alias("vec_id"),
        hex_code(F.col("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(digest(books)).alias("codebooks_sha256"),
    )


def _codes_sql(rounds: int = 2) -> str:
    """Two rounds unrolled: books b, assignments a."""
    assign = """
a{i} AS MATERIALIZED (
  SELECT p.vec_id, p.part, p.piece, arg_min(b.entry, [d, b.entry]) AS entry, min(d) AS d
  FROM p JOIN b{i} b USING (part), LATERAL (SELECT list_sum(list_transform(range(1, len(p.piece) + 1),
    lambda j: (p.piece[j] - b.piece[j]) * (p.piece[j] - b.piece[j])))::BIGINT AS d)
  GROUP BY p.vec_id, p.part, p.piece)"""
    refine = """
c{j} AS (
  SELECT part, entry, j, sum(piece[j])::BIGINT AS s, count(*) AS c
  FROM a{i}, range(1, (SELECT width + 1 FROM w)) t(j) GROUP BY part, entry, j),
n{j} AS (SELECT part, entry, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY j) AS piece FROM c{j} GROUP BY part, entry),
b{j} AS MATERIALIZED (SELECT part, entry, coalesce(n.piece, b.piece) AS piece FROM b{i} b LEFT JOIN n{j} n USING (part, entry))"""
    steps = [part for i in range(rounds) for part in (assign.format(i=i), refine.format(i=i, j=i + 1))]
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT max(len(e)) // 16 AS width FROM v),
p AS MATERIALIZED (
  SELECT vec_id, part, e[part * width + 1 : (part + 1) * width] AS piece FROM v, w, range(16) t(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 64),
b0 AS MATERIALIZED (SELECT part, entry, piece FROM p JOIN f USING (vec_id)),
{",".join(steps)},
{assign.format(i=rounds)},
h AS (
  SELECT sha256(string_agg(array_to_string(piece, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
r AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM r JOIN v USING (vec_id), h
"""


SQL["op13_vector_codes"] = _codes_sql()


@query
def op12_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.vptree import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


SQL["op12_vantage_trees"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) / (q.n * c.n) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


SQL["op11_phrases"] = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda s: s <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase
  FROM w, range(1, 5) r(k) WHERE len(ws) >= k),
f AS MATERIALIZED (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
u AS MATERIALIZED (
  SELECT lang, phrase, f AS a, cut, array_to_string(ws[1 : cut], ' ') AS lp, array_to_string(ws[cut + 1 :], ' ') AS rp
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1)),
c AS (
  SELECT u.lang, u.phrase, a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = lp JOIN f r ON r.lang = u.lang AND r.phrase = rp),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(ws[j : j + s - 1], ' ') AS phrase, f
    FROM f, range(2, 4) x(s), range(1, 4) y(j) WHERE s < k AND j + s - 1 <= k) GROUP BY lang, phrase),
o AS (
  SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE i.f IS NULL OR 100::HUGEINT * i.f < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
  phrase, a, l, r, n, score::BIGINT AS score
FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""
