"""Usage, costs and scores: conversation turns as model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.registry import query, table
from newsloom.operators import metrics as M
from newsloom.plans import compare as C


def calls(spark, d):
    t = table(spark, d, "conversations")
    n = F.length("text")
    return t.select(
        F.col("conv_id").alias("run_date"),
        F.when(F.col("turn") % 3 == 0, "collect").otherwise("analyze").alias("stage"),
        F.col("turn").alias("pos"),
        F.col("role").alias("model"),
        F.when(F.col("turn") % 4 != 3, n).alias("tokens_in"),
        F.floor(n / 3).alias("tokens_out"),
        F.when(F.col("turn") % 2 == 0, F.lit(5)).alias("tokens_cached"),
        "text",
    )


CALLS_SQL = """
calls AS (SELECT conv_id AS run_date, CASE WHEN turn % 3 = 0 THEN 'collect' ELSE 'analyze' END AS stage, turn AS pos, role AS model,
  CASE WHEN turn % 4 <> 3 THEN length(text) END AS tokens_in, length(text) // 3 AS tokens_out, CASE WHEN turn % 2 = 0 THEN 5 END AS tokens_cached, text FROM conversations)
"""


# The wording of every framing question, as rows.
FRAMING_SQL = ", ".join(
    "('{}', '{}', '{}')".format(q, side, (w.lower() if q in C.LOWERED else w).replace("'", "''"))
    for q, sides in C.FRAMING.items()
    for side, words in sides.items()
    for w in words
)


@query(
    "usage_fold",
    f"""WITH {CALLS_SQL}, m AS (SELECT run_date, stage, model, row_number() OVER (PARTITION BY run_date, stage ORDER BY count(*) DESC, min(pos)) AS rn FROM calls GROUP BY run_date, stage, model),
    s AS (SELECT run_date, stage, CAST(count(*) AS BIGINT) AS calls, CAST(sum(coalesce(tokens_in, 0)) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
      CAST(sum(coalesce(tokens_cached, 0)) AS BIGINT) AS tokens_cached, CAST(count(*) FILTER (tokens_in IS NULL OR tokens_out IS NULL) AS BIGINT) AS usage_missing FROM calls GROUP BY ALL)
    SELECT s.*, m.model FROM s JOIN m ON s.run_date = m.run_date AND s.stage = m.stage AND rn = 1""",
)
def _usage(spark, d):
    return M.usage_by_stage(calls(spark, d))


@query(
    "run_totals",
    f"""WITH {CALLS_SQL} SELECT run_date, stage, CAST(grouping_id(run_date, stage) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS calls,
      CAST(sum(coalesce(tokens_in, 0)) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(coalesce(tokens_cached, 0)) AS BIGINT) AS tokens_cached
    FROM calls GROUP BY ROLLUP (run_date, stage)""",
)
def _totals(spark, d):
    return M.run_totals(calls(spark, d))


@query(
    "items_out",
    f"WITH {CALLS_SQL} SELECT run_date, stage, model AS key, CAST(count(*) AS BIGINT) AS items FROM calls GROUP BY ALL",
)
def _items_out(spark, d):
    return M.items_out(calls(spark, d).withColumnRenamed("model", "key"))


@query(
    "model_costs",
    f"""WITH {CALLS_SQL}, s AS (SELECT run_date, model, count(*) AS n, sum(tokens_in) AS i, sum(tokens_out) AS o FROM calls GROUP BY ALL)
    SELECT run_date, model, CAST(n AS BIGINT) AS llm_calls, round_even(i / 1000::DOUBLE, 1) AS input_k_tokens, round_even(o / 1000::DOUBLE, 1) AS output_k_tokens,
      round(coalesce(i / 1000000::DOUBLE * CASE model WHEN 'user' THEN 2 ELSE 3 END + o / 1000000::DOUBLE * CASE model WHEN 'user' THEN 8 ELSE 15 END, 0), 9) AS cost_usd FROM s""",
)
def _costs(spark, d):
    prices = (
        table(spark, d, "conversations")
        .select(F.col("role").alias("model"))
        .distinct()
        .withColumns(
            {
                "input_per_m": F.when(F.col("model") == "user", 2.0).otherwise(3.0),
                "output_per_m": F.when(F.col("model") == "user", 8.0).otherwise(15.0),
            }
        )
    )
    out = C.call_costs(calls(spark, d), prices)
    return out.drop("est_cost_usd").withColumn("cost_usd", F.round("cost_usd", 9))


@query(
    "compression_score",
    r"""WITH p AS (SELECT conv_id AS run_date, role AS model, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM conversations),
    a AS (SELECT run_date, model, count(*) AS transcripts, round_even(avg(least(n, 30) / greatest(1, n)::DOUBLE), 3) AS r, count(*) FILTER (n > 0) AS ok FROM p GROUP BY ALL)
    SELECT run_date, model, CAST(transcripts AS BIGINT) AS transcripts, CAST(ok AS BIGINT) AS nonempty_outputs, r AS avg_compression_ratio,
      100 - CASE WHEN ok < transcripts THEN 30 ELSE 0 END - CASE WHEN r <> 0 AND (r < 0.05 OR r > 0.65) THEN 15 ELSE 0 END AS quality_score FROM a""",
)
def _compression(spark, d):
    from newsloom.functions.text import first_words

    pairs = calls(spark, d).select(
        "run_date", "model", F.col("text").alias("transcript"), first_words(F.col("text"), F.lit(30)).alias("compressed_transcript")
    )
    return C.score_compression(pairs)


@query(
    "model_ranking",
    f"""WITH {CALLS_SQL}, s AS (SELECT run_date, model, count(*) AS n, sum(coalesce(tokens_in, 0)) AS i FROM calls GROUP BY ALL)
    SELECT run_date, model, CAST(n % 3 AS INTEGER) AS quality_score, CAST(row_number() OVER (PARTITION BY run_date ORDER BY n % 3 DESC, i, model) AS BIGINT) AS rank FROM s""",
)
def _ranking(spark, d):
    n = F.count(F.lit(1))
    per = calls(spark, d).groupBy("run_date", "model").agg(
        (n % 3).cast("int").alias("quality_score"), F.sum(F.coalesce("tokens_in", F.lit(0))).alias("cost_usd")
    )
    out = C.rank_models(per.drop("cost_usd"), per.drop("quality_score"))
    return out.select("run_date", "model", "quality_score", "rank")


@query(
    "framing_flags",
    f"""WITH {CALLS_SQL}, w(question, side, word) AS (VALUES {FRAMING_SQL})
    SELECT run_date, question, side, bool_or(contains(lower(text), word)) AS used FROM calls, w GROUP BY ALL""",
)
def _framing(spark, d):
    return C.framing_flags(calls(spark, d))


@query(
    "changed_summaries",
    """SELECT source AS run_date, CAST(count(*) AS BIGINT) AS items, CAST(count(*) FILTER (length(trim(text)) > 400) AS BIGINT) AS changed FROM documents GROUP BY source""",
)
def _changed(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("run_date"), F.col("doc_id").alias("pos"), "text")
    raw = docs.withColumn("summary", F.trim("text")).drop("text")
    cut = docs.withColumn("summary", F.trim(F.when(F.length(F.trim("text")) > 400, "x").otherwise(F.col("text")))).drop("text")
    return M.changed_summaries(raw, cut)
