"""Caps, running totals, gates and skew handling against plain Python."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from newsloom.operators import joins as J
from newsloom.operators import ranking as R


def test_running_matches_sequential_sum(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), i, rng.randint(0, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, pos int, v int").repartition(7)
    out = R.running(df, ["g"], R.position_bucket("pos", 37), ["pos"], {"s": F.col("v"), "n": F.lit(1)})
    sums, counts, want = Counter(), Counter(), {}
    for g, pos, v in rows:
        sums[g] += v
        counts[g] += 1
        want[pos] = (sums[g], counts[g])
    assert {r.pos: (r.s, r.n) for r in out.collect()} == want


def test_share_cap(spark):
    rows = [("d", "x", i) for i in range(8)] + [("d", "y", 8), ("d", "", 9), ("d", "", 10)]
    df = spark.createDataFrame(rows, "desk string, category string, pos int").withColumn("run_date", F.lit("r"))
    kept = {r.pos for r in R.share_cap(df, shares=0.3, rows=2).where("kept").collect()}
    assert kept == {0, 1, 2, 3, 8, 9, 10}  # ceil(11 * 0.3) = 4 of x
    assert R.share_cap(df, shares=1.0).where("kept").count() == 11


def test_tiered_budget(spark):
    rows = [(t, p0, p2, i) for i, (t, p0, p2) in enumerate([("a", 3, 5), ("a", 0, 0), ("a", 1, 9), ("z", 0, 0)])]
    df = spark.createDataFrame(rows, "tier string, p0 int, p2 int, pos int").withColumns(
        {"run_date": F.lit("r"), "p1": F.lit(0), "priority_reason": F.lit("why")}
    )
    out = R.tiered_budget(df, F.lit(True), {"a": 2}, "skipped_fetch_cap")
    got = {r.pos: (r.allowed, r.reason) for r in out.withColumn("reason", R.budget_reason()).collect()}
    assert [p for p, (ok, _) in got.items() if ok] and got[1][0] and got[2][0] and not got[0][0] and not got[3][0]
    assert got[0][1] == "skipped fetch cap hit; tier=a; rank_reason=why; candidates=3; cap=2"
    stats = {r.tier: tuple(r)[2:] for r in R.tier_stats(out).collect()}
    assert stats == {"a": (3, 2, 1, 2), "z": (1, 0, 1, 0)}


def gate(rows, per_desk, total):
    """Walk desks in order, as a reader would."""
    taken, all_taken, out = Counter(), 0, {}
    for desk, idx, status in sorted(rows):
        if status == "selected":
            if taken[desk] >= per_desk:
                status = "rejected_per_desk_cap"
            elif all_taken >= total:
                status = "rejected_total_cap"
            else:
                taken[desk] += 1
                all_taken += 1
        out[(desk, idx)] = status
    return out


def test_request_gate(spark):
    rng = random.Random(2)
    for per_desk, total in ((1, 3), (2, 3), (3, 4), (0, 5), (2, 0)):
        rows = [(d, i, rng.choice(["selected", "selected", "rejected_unknown_url"])) for d in range(4) for i in range(5)]
        df = spark.createDataFrame(rows, "desk int, idx int, status string").withColumns(
            {"run_date": F.lit("r"), "desk_pos": F.col("desk")}
        )
        got = {(r.desk, r.idx): r.status for r in R.request_gate(df, per_desk, total, rows=2).collect()}
        assert got == gate(rows, per_desk, total)


def test_circuit_breaker(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice(["bad", "bad", "ok", "skip"])) for g in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "g string, pos int, k string")
    got = R.circuit_breaker(df, ["g"], F.col("k") == "bad", F.col("k") == "ok", 4, rows=7)
    want = set()
    for g in "ab":
        fails = 0
        for gg, pos, k in rows:
            if gg != g:
                continue
            if fails >= 4:
                break
            want.add((g, pos))
            fails = fails + 1 if k == "bad" else 0 if k == "ok" else fails
    assert {(r.g, r.pos) for r in got.collect()} == want


def test_confidence_cap_keeps_order_when_not_cut(spark):
    rows = [("r", 0, "low"), ("r", 1, "high"), ("s", 0, "low"), ("s", 1, "high"), ("s", 2, "medium")]
    df = spark.createDataFrame(rows, "run_date string, pos int, confidence string")
    got = [(r.run_date, r.pos) for r in R.confidence_cap(df, ["run_date"], 2).orderBy("run_date", "rank").collect()]
    assert got == [("r", 0), ("r", 1), ("s", 1), ("s", 2)]


def test_outlet_cap(spark):
    rows = [("r", i, o) for i, o in enumerate(["a", "a", "a", "", "", "b", None])]
    df = spark.createDataFrame(rows, "run_date string, pos int, outlet string")
    kept, dropped = R.outlet_cap(df, ["run_date"], "outlet", 2)
    assert {r.pos for r in kept.collect()} == {0, 1, 3, 4, 5, 6}
    assert {r.pos for r in dropped.collect()} == {2}


def test_hot_join_equals_plain_join(spark):
    rng = random.Random(4)
    left = spark.createDataFrame([(rng.choice(["hot"] * 8 + ["a", "b", None]), i) for i in range(400)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("c", 3)], "k string, v int")
    counts = J.key_counts(left, ["k"])
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        salted = J.hot_join(left, right, ["k"], how, counts, hot_rows=50, salts=8)
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, salted.collect())), how


def test_first_wins(spark):
    rows = [("r", 0, "b"), ("r", 1, "a"), ("r", 2, "a"), ("r", 3, "b")]
    from newsloom.operators.metrics import most_frequent

    df = spark.createDataFrame(rows, "run_date string, pos int, m string")
    assert most_frequent(df, ["run_date"], "m").first().m == "b"


def test_metrics_match_statistics(spark):
    import statistics

    from newsloom.operators.metrics import feed_metrics

    rng = random.Random(5)
    texts = defaultdict(list)
    for _ in range(300):
        texts[rng.choice("aaab")].append("x" * rng.choice([0, 1, 5, 80, 300]))
    df = spark.createDataFrame([(s, t) for s, ts in texts.items() for t in ts], "source string, summary string")
    for r in feed_metrics(df).collect():
        n = sorted(len(t) for t in texts[r.source])
        assert r["items"] == len(n)
        assert r.mean_chars == int(statistics.mean(n))
        assert r.median_chars == int(statistics.median(n))
        assert r.p10_chars == n[round(0.1 * (len(n) - 1))]
        assert r.empty_count == n.count(0)


def test_budget_of_one_large_group(spark):
    """A tier of very many lengths falls into few buckets and ranks exactly."""
    rows = spark.range(100_000).select(
        F.lit("r").alias("run_date"),
        F.lit("active").alias("tier"),
        F.lit(2).alias("p0"),
        F.lit(1).alias("p1"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**9))).alias("p2"),
        F.col("id").alias("pos"),
    )
    placed = R.quantile_buckets(rows, ["run_date", "tier", "p0", "p1"], "p2", rows=1_000)
    sizes = [r["count"] for r in placed.groupBy("_place", "_tie").count().collect()]
    assert len(sizes) <= 128 + 100 and max(sizes) <= 4_000
    out = R.tiered_budget(rows, F.lit(True), {"active": 10}, "skipped", rows=1_000).toPandas()
    want = out.sort_values(["p0", "p1", "p2", "pos"])["budget_rank"].tolist()
    assert want == list(range(1, 100_001)) and out["allowed"].sum() == 10
