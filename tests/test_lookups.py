"""Bloom filters, hook index, as-of rows and ranges against brute force."""

import datetime as dt
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.operators import bloom as B
from newsloom.operators import hooks as H
from newsloom.operators import joins as J
from newsloom.operators import ranges as R


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(0, 20_000, 2).selectExpr("id", "concat('k', id) AS name")
    blocks = B.blocks_for(10_000)
    key = [F.col("id"), F.col("name")]
    parts = [B.build(keys.where(f"id % 4 = {r}"), key, blocks) for r in (0, 2)]
    merged = B.merge(parts)
    whole = B.build(keys, key, blocks)
    assert {r.block: bytes(r.bits) for r in merged.collect()} == {r.block: bytes(r.bits) for r in whole.collect()}
    asked = spark.range(0, 20_000).selectExpr("id", "concat('k', id) AS name")
    got = B.probe(asked, merged, key, blocks, "maybe").groupBy((F.col("id") % 2).alias("odd"), "maybe").count().collect()
    counts = {(r.odd, r.maybe): r["count"] for r in got}
    assert counts[(0, True)] == 10_000 and (0, False) not in counts
    assert counts.get((1, True), 0) < 100
    one = B.probe(spark.createDataFrame([(None, None)], "id long, name string"), whole, key, blocks, "maybe").first()
    assert one.maybe is False


def test_filtered_links_are_spelled_once(spark):
    """The links' comparison form and probes are written, not computed by every pass."""
    links = spark.createDataFrame(LINKS, "run_date string, item int, url string")
    known = spark.createDataFrame([("r1", "http://a.org/x")], "run_date string, url string")
    plan = B.mark_known_filtered(links, known)._jdf.queryExecution().optimizedPlan().toString()
    assert "_words" not in plan and "tables/" not in plan and "_maybe" in plan


LINKS = [
    ("r1", 1, "http://a.org/x?utm_source=q"),
    ("r1", 2, "http://A.org/x/"),
    ("r1", 3, "http://b.org/none"),
    ("r1", 4, ""),
    ("r1", 5, None),
    ("r2", 6, "http://a.org/x"),
    ("r2", 7, "http://c.org/y"),
    (None, 8, "http://c.org/y"),
]


def test_filtered_links_agree_with_plain_join(spark, monkeypatch):
    links = spark.createDataFrame(LINKS * 3, "run_date string, item int, url string")
    known = spark.createDataFrame([("r1", "http://a.org/x"), ("r2", "http://c.org/y/")], "run_date string, url string")
    want = Counter(map(tuple, J.mark_known(links, known).collect()))
    assert Counter(map(tuple, B.mark_known_filtered(links, known).collect())) == want
    plan = B.mark_known_filtered(links, known)._jdf.queryExecution().toString()
    assert "might_contain" not in plan and "BroadcastHashJoin" in plan
    monkeypatch.setattr(B, "LIMIT", 0)
    assert Counter(map(tuple, B.mark_known_filtered(links, known).collect())) == want
    assert B.mark_known_filtered(links, known.limit(0)).where("known").count() == 6


def test_blank_links_are_spread(spark):
    """Blank links, mostly very many, don't meet in one task."""
    links = spark.range(8_000).selectExpr("'r' AS run_date", "CAST(id AS int) AS item", "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('http://a.org/', id % 8) ELSE '' END AS url")
    known = spark.createDataFrame([("r", "http://a.org/1")], "run_date string, url string")
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {c: spark.conf.get(c) for c in plain}
    try:
        for c, v in plain.items():
            spark.conf.set(c, v)
        out = J.mark_known(links, known)
        tasks = out.where("coalesce(url, '') = ''").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in tasks) < 3_000
        assert Counter((r.url, r.known, r.canonical_url != "") for r in out.collect()) == {
            (None, True, False): 2_000, ("", True, False): 4_000, ("http://a.org/1", True, True): 1_000, ("http://a.org/5", False, True): 1_000
        }
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def hook_rows():
    rng = random.Random(5)
    rows = []
    for i in range(150):
        hooks = [("Entity", rng.choice([" US", "united  states", "US "]))] if i % 3 == 0 else []
        hooks += [("theme", f"T{rng.randint(0, 25)}") for _ in range(rng.randint(0, 4))]
        hooks += [("policy", None), ("policy", "  ")]
        rows.append((rng.choice(["r1", "r2"]), i, f"d{rng.randint(0, 3)}", hooks))
    return rows + [("r1", None, "d0", [("theme", "t1")]), ("r1", 900, "d1", [])]


def test_hook_index(spark):
    rows = hook_rows()
    items = spark.createDataFrame(rows, "run_date string, item_id int, desk string, hooks array<struct<kind string, key string>>")
    index = H.postings(items, {"us": "united states"})
    held = defaultdict(set)
    for run, item, desk, hooks in rows:
        for kind, key in hooks:
            key = " ".join((key or "").lower().split())
            key = "united states" if key == "us" else key
            if key and item is not None:
                held[(run, f"{kind.lower()}:{key}")].add((item, desk))
    assert {(r.run_date, r.hook, r.item_id, r.desk) for r in index.collect()} == {(*k, *x) for k, v in held.items() for x in v}
    cap = 12
    stats = {(r.run_date, r.hook): (r["items"], r.desks, r.hub) for r in H.hook_stats(H.desk_counts(index), cap).collect()}
    assert stats == {k: (len(v), len({d for _, d in v}), len(v) > cap) for k, v in held.items()}
    assert any(s[2] for s in stats.values()) and not all(s[2] for s in stats.values())
    pairs, desks = Counter(), defaultdict(lambda: [0, 0, 0])
    for (run, hook), v in held.items():
        for (a, da), (b, db) in itertools.permutations(v, 2):
            if da < db:
                desks[(run, da, db)][1] += 1
                desks[(run, da, db)][2] += len(v) <= cap
            if a < b and da != db and len(v) <= cap:
                pairs[(run, a, b)] += 1
        for da, db in itertools.permutations({d for _, d in v}, 2):
            desks[(run, da, db)][0] += da < db
    got = {(r.run_date, r.item_a, r.item_b): r.hooks for r in H.candidates(index, cap).collect()}
    assert got == {k: n for k, n in pairs.items() if n >= 2} and got
    got = {(r.run_date, r.desk_a, r.desk_b): [r.hooks, r.item_pairs, r.plain_pairs] for r in H.desk_pairs(H.desk_counts(index), cap).collect()}
    assert got == {k: v for k, v in desks.items() if v[0]}


def asof_case():
    rng = random.Random(8)
    base = dt.datetime(2024, 1, 1)
    at = lambda: None if rng.random() < 0.05 else base + dt.timedelta(seconds=rng.randint(0, 400))
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(i, key(), at()) for i in range(300)]
    right = [(i, key(), at(), f"v{i}") for i in range(120)] + [(900, "alone", base, "z")]
    return left, right


@pytest.mark.parametrize(("strict", "stretches"), [(False, 64), (True, 4), (False, 1)])
def test_asof_rows(spark, strict, stretches):
    left, right = asof_case()
    a = spark.createDataFrame(left, "id int, k string, at timestamp")
    b = spark.createDataFrame(right, "rid int, k string, at timestamp, id string")
    b = b.withColumnRenamed("id", "value")
    got = {r.id: r.value for r in R.asof_rows(a, b, ["k"], "at", ["value"], ["rid"], strict, stretches).collect()}
    want = {}
    for i, k, t in left:
        before = [(u, n, v) for n, q, u, v in right if q == k and k and t and u and (u < t or (u == t and not strict))]
        want[i] = max(before)[2] if before else None
    assert got == want and len(got) == len(left)
    assert R.asof_rows(a.limit(0), b, ["k"], "at", ["value"]).count() == 0
    assert {r.value for r in R.asof_rows(a, b.limit(0), ["k"], "at", ["value"]).collect()} == {None}


def spans_case(seed, scale):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    span = lambda s: dt.timedelta(microseconds=int(s * scale))
    points = [(i, rng.choice(["hot", "hot", "a", None]), None if i % 40 == 7 else base + span(rng.random() * 1e6)) for i in range(250)]
    ranges = []
    for i in range(90):
        start = base + span(rng.random() * 1.2e6 - 1e5)
        end = start + span(rng.choice([0, 1, 1e3, 3e4, 4e5, -50]) * rng.random())
        ranges.append((i, rng.choice(["hot", "a", None]), None if i % 13 == 1 else start, None if i % 11 == 2 else end, f"t{i % 30}"))
    points += [(1_000 + r[0], r[1], r[2]) for r in ranges if r[2]] + [(2_000 + r[0], r[1], r[3]) for r in ranges if r[3]]
    return points, ranges


@pytest.mark.parametrize(("seed", "scale"), [(1, 1), (2, 1_000), (3, 86_400_000)])
def test_interval_pairs(spark, seed, scale):
    points, ranges = spans_case(seed, scale)
    p = spark.createDataFrame(points, "id int, k string, at timestamp")
    r = spark.createDataFrame(ranges, "rid int, k string, begins timestamp, ends timestamp, title string")
    inside = lambda t, q: t is not None and (q[2] is None or q[2] <= t) and (q[3] is None or t <= q[3])
    want = Counter((i, q[0]) for i, k, t in points for q in ranges if k is not None and k == q[1] and inside(t, q))
    got = Counter((x.id, x.rid) for x in R.interval_pairs(p, r, "at", "begins", "ends", ["k"]).collect())
    assert got == want and want
    free = Counter((i, q[0]) for i, k, t in points for q in ranges if inside(t, q))
    assert Counter((x.id, x.rid) for x in R.interval_pairs(p, r.drop("k"), "at", "begins", "ends").collect()) == free
    far = dt.datetime(2500, 1, 1)
    best = {}
    for i, _, t in points:
        held = [((q[2] is not None, q[2] or far), (q[3] is None, q[3] or far), q[4]) for q in ranges if inside(t, q)]
        best[i] = min(held)[2] if held else ""
    found = R.schedule_at(p, r.drop("k"), "id", "at", "begins", "ends", ["title"])
    assert {x.id: x.title for x in found.collect()} == best
    assert R.interval_pairs(p.limit(0), r, "at", "begins", "ends", ["k"]).count() == 0
    assert R.interval_pairs(p, r.limit(0), "at", "begins", "ends", ["k"]).count() == 0


def test_schedule_of_repeated_points_and_keys(spark):
    """Points of one id share their best range; null ids, keys and times find none."""
    points, ranges = spans_case(4, 1_000)
    points = [(None if i % 17 == 3 else i // 2, k, t) for i, k, t in points]
    p = spark.createDataFrame(points, "id int, k string, at timestamp")
    r = spark.createDataFrame(ranges + ranges[:20], "rid int, k string, begins timestamp, ends timestamp, title string")
    far = dt.datetime(2500, 1, 1)
    best = defaultdict(list)
    for i, k, t in points:
        for _, q, a, b, title in ranges:
            if k is not None and k == q and t and (a is None or a <= t) and (b is None or t <= b):
                best[i].append(((a is not None, a or far), (b is None, b or far), title))
    want = Counter((i, k, t, min(best[i])[2] if i is not None and best[i] else "") for i, k, t in points)
    got = R.schedule_at(p, r, "id", "at", "begins", "ends", ["title"], ["k"])
    assert Counter(map(tuple, got.collect())) == want


def test_open_ranges_meet_in_many_bins(spark):
    """Neither a look-up nor a join has a task for all points of an open range."""
    p = spark.range(0, 4_000, 1, 4).selectExpr("CAST(id AS int) AS id", "id * 1000 AS at")
    r = spark.range(400).selectExpr("CAST(id AS int) AS rid", "IF(id % 2 = 0, NULL, id * 10000) AS begins", "CAST(IF(id % 2 = 0, NULL, id * 10000 + 500) AS long) AS ends", "concat('t', id) AS title")
    met = R.interval_pairs(p, r, "at", "begins", "ends")
    assert met.count() == 4_000 * 200 + 200
    join = met._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in join
    found = R.schedule_at(p, r, "id", "at", "begins", "ends", ["title"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("_bin") == 0
    assert {x.title for x in found.select("title").distinct().collect()} == {"t0"}


@pytest.mark.parametrize("size", [1, 4, 512])
def test_points_meet_ranges_once(spark, size):
    """Pieces of any size give all pairs: far times, an instant of many points, long ranges, repeated rows."""
    rng = random.Random(size)
    points = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, 5, 5, 10**15, -(10**15), *range(40)])) for i in range(400)]
    points += points[:20] + [(900 + i, f"k{i}", i) for i in range(30)]
    ranges = [(i, rng.choice(["hot", "a", None]), rng.choice([None, 5, *range(50)]), rng.choice([None, 5, *range(50)])) for i in range(60)]
    ranges += ranges[:5] + [(900 + i, f"k{i}", i - 1, i + i % 3 - 1) for i in range(30)]
    p = spark.createDataFrame(points, "id int, k string, at long")
    r = spark.createDataFrame(ranges, "rid int, k string, begins long, ends long")
    holds = lambda t, a, b: t is not None and (a is None or a <= t) and (b is None or t <= b)
    want = Counter((i, q) for i, k, t in points for q, l, a, b in ranges if k is not None and k == l and holds(t, a, b))
    met = R.interval_pairs(p, r, "at", "begins", "ends", ["k"], size)
    assert Counter((x.id, x.rid) for x in met.collect()) == want and met.columns == ["k", "id", "at", "rid", "begins", "ends"]


def test_points_are_not_repeated_per_level(spark):
    """Only ranges are copied for the join; points meet them in one row each."""
    p = spark.range(0, 4_000, 1, 4).selectExpr("CAST(id AS int) AS id", "id * 1000 AS at")
    r = spark.range(400).selectExpr("CAST(id AS int) AS rid", "id * 10000 AS begins", "id * 10000 + IF(id % 9 = 0, 3000000, 500) AS ends")
    met = R.interval_pairs(p, r, "at", "begins", "ends")
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
