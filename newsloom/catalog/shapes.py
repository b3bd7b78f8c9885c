"""Shapes of landed documents and how they drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.registry import query, table
from newsloom.operators import drift as D

# Per source and day: which parts occur, and as what.
SHAPE_SQL = """
e AS (SELECT event_type AS source, CAST(ts AS DATE) AS run_date, event_id, user_id, value, event_id % 97 = 0 AS bad FROM events),
g AS (SELECT source, run_date, count(*) AS documents, count(*) FILTER (bad) AS broken, bool_or(NOT bad) AS told,
    coalesce(bool_or(event_id % 7 = 0) FILTER (NOT bad), false) AS text_value, coalesce(bool_or(event_id % 7 <> 0) FILTER (NOT bad), false) AS number_value,
    coalesce(bool_or(user_id % 5 <> 0) FILTER (NOT bad), false) AS has_user, coalesce(bool_or(user_id % 5 = 0) FILTER (NOT bad), false) AS no_user,
    coalesce(bool_or(value > 150) FILTER (NOT bad), false) AS tagged
  FROM e GROUP BY source, run_date),
p AS (
  SELECT source, run_date, '$' AS path, 'object' AS kind FROM g WHERE told
  UNION ALL SELECT source, run_date, '$.k', 'number' FROM g WHERE told
  UNION ALL SELECT source, run_date, '$.the value', CASE WHEN text_value AND number_value THEN 'mixed' WHEN text_value THEN 'string' ELSE 'number' END FROM g WHERE told
  UNION ALL SELECT source, run_date, '$.user', CASE WHEN has_user THEN 'object' ELSE 'null' END FROM g WHERE told
  UNION ALL SELECT source, run_date, '$.user.id', 'number' FROM g WHERE has_user
  UNION ALL SELECT source, run_date, '$.tags', 'array' FROM g WHERE tagged
  UNION ALL SELECT source, run_date, '$.tags[]', 'object' FROM g WHERE tagged
  UNION ALL SELECT source, run_date, '$.tags[].name', 'string' FROM g WHERE tagged
  UNION ALL SELECT source, run_date, '$.tags[].main', 'boolean' FROM g WHERE tagged),
r AS (SELECT source, run_date, lag(run_date) OVER (PARTITION BY source ORDER BY run_date) AS previous_run FROM g WHERE told)
"""


def _shapes(spark, d):
    """Events as landed JSON documents whose parts come and go."""
    e = table(spark, d, "events")
    value = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))).otherwise(
        F.col("value").cast("string")
    )
    user = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit('{"id": '), F.col("user_id").cast("string"), F.lit("}"))).otherwise("null")
    tags = F.when(F.col("value") > 150, ', "tags": [{"name": "high", "main": true}]').otherwise("")
    whole = F.concat(F.substring_index("props", "}", 1), F.lit(', "the value": '), value, F.lit(', "user": '), user, tags, F.lit("}"))
    broken = F.col("event_id") % 97 == 0
    docs = e.select(
        F.col("event_type").alias("source"), F.to_date("ts").alias("run_date"), F.when(broken, F.col("props").substr(1, 4)).otherwise(whole).alias("payload")
    )
    return D.run_shapes(docs, ["source"])


@query(
    "run_shapes",
    f"""WITH {SHAPE_SQL} SELECT g.source, g.run_date, documents, broken, coalesce(string_agg(path || ' ' || kind, ', ' ORDER BY path), '') AS shape
    FROM g LEFT JOIN p ON p.source = g.source AND p.run_date = g.run_date GROUP BY ALL""",
)
def _run_shapes(spark, d):
    parts = F.array_sort(F.transform(F.map_entries("paths"), lambda x: F.struct(x["key"].alias("p"), x["value"].alias("k"))))
    shape = F.array_join(F.transform(parts, lambda x: F.concat_ws(" ", x["p"], x["k"])), ", ")
    return _shapes(spark, d).select("source", "run_date", "documents", "broken", shape.alias("shape"))


@query(
    "shape_drift",
    f"""WITH {SHAPE_SQL}, n AS (SELECT p.source, p.run_date, previous_run, path, kind FROM p JOIN r USING (source, run_date) WHERE previous_run IS NOT NULL),
    o AS (SELECT r.source, r.run_date, previous_run, path, kind FROM r JOIN p ON p.source = r.source AND p.run_date = previous_run),
    b AS (SELECT source, run_date, previous_run, path, o.kind AS old_kind, n.kind AS new_kind FROM o FULL JOIN n USING (source, run_date, previous_run, path))
    SELECT *, CASE WHEN old_kind IS NULL THEN 'added' WHEN new_kind IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b WHERE old_kind IS DISTINCT FROM new_kind""",
)
def _shape_drift(spark, d):
    return D.shape_drift(_shapes(spark, d), ["source"])
