"""Saved runs: versions, corrections, retention, reading as of a date."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from newsloom.catalog.registry import query, table
from newsloom.session import checkpoint_dir
from newsloom.sources.snapshots import Snapshots

# Version 0 holds January's first twenty days, 1 adds the later ones, 2 corrects
# every third day, 3 drops the runs before the sixth.
SAVES_SQL = """
e AS (SELECT CAST(ts AS DATE) AS run_date, event_id, value, CAST(date_part('day', ts) AS INTEGER) AS day FROM events),
v AS (SELECT 0 AS version, run_date, event_id, value FROM e WHERE run_date < DATE '2024-01-21'
  UNION ALL SELECT 1, run_date, event_id, value FROM e
  UNION ALL SELECT 2, run_date, event_id, CASE WHEN day % 3 = 0 THEN value + 1000 ELSE value END FROM e WHERE day % 3 <> 0 OR event_id % 2 = 0
  UNION ALL SELECT 3, run_date, event_id, CASE WHEN day % 3 = 0 THEN value + 1000 ELSE value END FROM e WHERE (day % 3 <> 0 OR event_id % 2 = 0) AND run_date >= DATE '2024-01-06')
"""


def _saved(spark, d) -> Snapshots:
    e = table(spark, d, "events").select(F.to_date("ts").alias("run_date"), "event_id", "value")
    store = Snapshots(spark, f"{checkpoint_dir(spark)}/snapshots/{uuid.uuid4().hex}", e.schema)
    split = F.lit("2024-01-21").cast("date")
    store.save(e.where(F.col("run_date") < split))
    store.save(e.where(F.col("run_date") >= split))
    # A correction drops half of a day's rows: the run is replaced, not merged.
    store.save(e.where((F.dayofmonth("run_date") % 3 == 0) & (F.col("event_id") % 2 == 0)).withColumn("value", F.col("value") + 1000))
    store.retire(dt.date(2024, 1, 6))
    return store


@query("snapshot_rows", f"WITH {SAVES_SQL} SELECT run_date, event_id, value FROM v WHERE version = 3")
def _rows(spark, d):
    return _saved(spark, d).read()


@query(
    "snapshot_versions",
    f"""WITH {SAVES_SQL} SELECT CAST(version AS BIGINT) AS version, run_date, count(*) AS "rows", round(sum(value), 2) AS total FROM v GROUP BY version, run_date""",
)
def _versions(spark, d):
    store = _saved(spark, d)
    out = None
    for v in store.versions():
        rows = store.read(v).withColumn("version", F.lit(v).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("version", "run_date").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "snapshot_before",
    f"""WITH {SAVES_SQL} SELECT run_date, event_id, value FROM v
    WHERE version = 1 AND run_date = (SELECT max(run_date) FROM v WHERE version = 1 AND run_date < DATE '2024-01-16')""",
)
def _before(spark, d):
    return _saved(spark, d).before(dt.date(2024, 1, 16), version=1)
