"""Snapshots of saved runs: whole saves, two writers, versions, retention."""

import datetime as dt
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from newsloom.sources.snapshots import Snapshots

DDL = "run_date date, id int, text string"


def day(n):
    return dt.date(2024, 3, n)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())



@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "s"), spark.createDataFrame([], DDL).schema)


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def test_versions_replace_whole_runs(spark, store):
    assert store.versions() == [] and store.read().count() == 0 and store.before(day(9)).count() == 0
    assert store.history().count() == 0 and store.vacuum() == 0
    first = [(day(1), 1, "a"), (day(1), 1, "a"), (day(2), 2, None), (day(3), 3, "")]
    assert store.save(frame(spark, first)) == 0
    # Columns may come in any order, and more than the table has.
    assert store.save(frame(spark, [(day(2), 9, "new"), (day(5), 5, "e")]).select("text", "id", "run_date", F.lit(1).alias("more"))) == 1
    assert rows_of(store.read(0).na.fill("-")) == [(day(1), 1, "a"), (day(1), 1, "a"), (day(2), 2, "-"), (day(3), 3, "")]
    assert rows_of(store.read()) == [(day(1), 1, "a"), (day(1), 1, "a"), (day(2), 9, "new"), (day(3), 3, ""), (day(5), 5, "e")]
    assert rows_of(store.before(day(5))) == [(day(3), 3, "")] and rows_of(store.before(day(3))) == [(day(2), 9, "new")]
    assert rows_of(store.before(day(3), version=0).select("id")) == [(2,)]
    assert store.before(day(1)).count() == 0
    assert store.save(frame(spark, [])) == 2 and store.manifest(2) == store.manifest(1)
    assert store.history().groupBy("version").count().orderBy("version").collect() == [(0, 3), (1, 4), (2, 4)]
    with pytest.raises(ValueError):
        store.read(7)


def test_clashing_columns(spark, store):
    for ddl in ("run_date date, save string", "id int"):
        with pytest.raises(ValueError):
            Snapshots(spark, store.base, spark.createDataFrame([], ddl).schema)


def test_failed_save_shows_nothing(spark, store):
    store.save(frame(spark, [(day(1), 1, "a")]))
    with pytest.raises(ValueError):
        store.save(frame(spark, [(day(1), 2, "b"), (None, 3, "c")]))
    broken = frame(spark, [(day(1), 2, "b"), (day(2), 0, "c")]).withColumn("id", F.when(F.col("id") > 0, F.col("id")).otherwise(F.raise_error("x").cast("int")))
    with pytest.raises(PySparkException):
        store.save(broken)
    assert store.versions() == [0] and rows_of(store.read()) == [(day(1), 1, "a")]


def test_two_writers(spark, store):
    """Every save is published whole; of one run the later save counts."""
    store.save(frame(spark, [(day(1), 0, "start")]))
    saves = [[(day(1), i, w) for i in range(3)] + [(day(10 + n), n, w)] for n, w in enumerate("abcdef")]
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda s: store.save(frame(spark, s)), saves))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6] and store.versions() == list(range(7))
    by_version = dict(zip(versions, saves))
    live = {day(1): [(day(1), 0, "start")]}
    for v in range(1, 7):
        for r in {x[0] for x in by_version[v]}:
            live[r] = [x for x in by_version[v] if x[0] == r]
        assert rows_of(store.read(v)) == sorted(x for rows in live.values() for x in rows)


def test_claim_is_exclusive(store):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: store._claim({day(i + 1): "t"}, 0), range(8)))
    assert won.count(True) == 1
    assert store.manifest() == {day(won.index(True) + 1): "t"}
    assert not [n for n in os.listdir(f"{store.base}/manifest") if n.startswith("draft")]


def test_retention_and_vacuum(spark, store):
    store.save(frame(spark, [(day(n), n, "a") for n in range(1, 6)]))
    store.save(frame(spark, [(day(n), n, "b") for n in (2, 4)]))
    assert store.retire(day(3)) == 2
    assert [r[:2] for r in rows_of(store.read())] == [(day(3), 3), (day(4), 4), (day(5), 5)]
    assert len(rows_of(store.read(0))) == 5
    assert store.vacuum(keep=3, age_hours=-1) == 0 and store.vacuum(keep=1) == 0
    # Version 2 holds 3 and 5 of the first save and 4 of the second.
    assert store.versions() == [2]
    assert store.vacuum(keep=1, age_hours=-1) == 4
    assert rows_of(store.read()) == [(day(3), 3, "a"), (day(4), 4, "b"), (day(5), 5, "a")]
    with pytest.raises(ValueError):
        store.read(0)
    store.retire(day(30))
    assert store.read().count() == 0 and store.vacuum(age_hours=-1) == 3 and os.listdir(f"{store.base}/data") == []
