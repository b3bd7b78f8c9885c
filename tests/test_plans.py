"""Work that a plan must not do twice, and the rows of the forms that avoid it."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.urls import canonical_url
from newsloom.operators import contracts as C
from newsloom.operators import joins as J
from newsloom.operators.links import url_desks
from newsloom.operators.selection import primary_coverage


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


KNOWN = "run_date string, url string"


def test_mark_known_joins_once_by_the_form(spark):
    known = spark.createDataFrame([("r", "http://A.org/x/"), ("r", "feed:1"), ("r", " "), (None, "http://a.org/n")], KNOWN)
    rows = [("r", "http://a.org/x", 0), ("r", "http://a.org/x?utm_source=1", 1), ("r", "http://a.org/y", 2), ("r", "feed:1", 3), ("r", "feed:2", 4)]
    rows += [("r", "", 5), ("r", None, 6), (None, "http://a.org/n", 7), ("r", " ", 8), ("q", "http://a.org/x", 9)]
    links = spark.createDataFrame(rows, f"{KNOWN}, n int")
    for hot in (1, 1000):
        out = J.mark_known(links, known, hot_rows=hot)
        got = {r.n: (r.known, r.canonical_url) for r in out.collect()}
        assert got == {
            0: (True, "http://a.org/x"),
            1: (True, "http://a.org/x"),
            2: (False, "http://a.org/y"),
            3: (True, ""),
            4: (False, ""),
            5: (True, ""),
            6: (True, ""),
            7: (False, ""),
            8: (True, ""),
            9: (False, "http://a.org/x"),
        }
    # Hot keys on both sides, the lookup, and its return; a join by URL and one by form came before.
    assert optimized(out).count("Join ") == 4


def test_known_urls_of_one_field_are_not_exploded(spark):
    rows = spark.createDataFrame([("r", "u"), ("r", "u"), ("r", ""), ("r", None)], KNOWN)
    out = J.known_urls(rows)
    assert "Generate" not in optimized(out)
    assert [tuple(r) for r in out.collect()] == [("r", "u")]


def test_plain_urls_are_their_own_form(spark):
    urls = ["http://a.org/x", "https://a.org:80/x/y.html", "http://a.org/x/", "http://A.org/x", "http://a.org", "http://a.org/x;p", "http://a.org/x\n", "http://a.org/x#f", "http://a.org/a b", "ftp://a.org/x", None]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", canonical_url(F.col("url")).alias("c"))
    assert [r.c for r in rows.collect()] == [
        "http://a.org/x", "https://a.org:80/x/y.html", "http://a.org/x", "http://a.org/x", "http://a.org/", "http://a.org/x",
        "http://a.org/x", "http://a.org/x", "http://a.org/a b", "", "",
    ]


def test_documents_are_parsed_once(spark):
    raw = spark.range(1).select(F.lit("r").alias("run_date"), F.concat(F.lit('{"candidates":[{"item_id":true},1,[]],"n":'), F.col("id").cast("string"), F.lit("}")).alias("raw"))
    doc = raw.withColumn("_doc", F.try_parse_json("raw"))
    good, issues = C.entries(doc, C.field(F.col("_doc"), "candidates"), F.lit("c"), C.CANDIDATE)
    assert optimized(good).count("parseJson") == 1
    assert [(r.pos, r.item_id, r.possible_evidence) for r in good.collect()] == [(0, "True", [])]
    assert sorted(r.path for r in issues.collect()) == ["c[1]", "c[2]"]


DESK = "run_date string, desk string, desk_pos int, pos long, item_id string, headline string, links array<struct<url:string,label:string>>, deep_dive_candidate boolean"


def test_only_asked_urls_are_ranked_by_desk(spark):
    rows = [("r", "a", 0, 1, "i1", "h", [("u", "l"), ("v", "l")], False), ("r", "b", 1, 0, "i2", "h", [(" u ", "l"), ("w", "l")], False)]
    desk = spark.createDataFrame(rows, DESK)
    asked = spark.createDataFrame([("r", "u "), ("q", "v"), ("r", None)], KNOWN)
    got = url_desks(desk, asked).collect()
    assert [(r.run_date, r.url, r.desk) for r in got] == [("r", "u", "a")]
    assert {(r.url, r.desk) for r in url_desks(desk).collect()} == {("u", "a"), ("v", "a"), ("w", "b")}


def test_coverage_looks_at_short_items_in_place(spark):
    item = ("r", "geopolitics_events", 0, 1, "i1", "h", [("u", "l")], False)
    desk = spark.createDataFrame([item], DESK)
    glance = spark.createDataFrame([("r", "ai", "i1", "h", [("u", "l")])], "run_date string, tag string, item_id string, headline string, links array<struct<url:string,label:string>>")
    assert primary_coverage(glance, desk).count() == 0
    other = glance.withColumn("headline", F.lit("other"))
    out = primary_coverage(other.unionByName(other), desk)
    assert [(r.item_id, r.tag) for r in out.collect()] == [("i1", "war")]
    # The first items are written, not ranked again for each use.
    assert "Window" not in physical(out)
