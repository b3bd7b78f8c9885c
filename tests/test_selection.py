"""Greedy selections against direct walks, with heads forced to be short."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators.phrases import (
    cross_section_phrases,
    overlap_counts,
    overlap_downgrade,
    representative_phrases,
    shared_grams,
)
from newsloom.operators.selection import diverse_top, primary_coverage

DEPTH = {"widely-reported": 0, "corroborated": 1, "single-source": 2}
ITEM = "run_date string, pos int, tag string, source_depth string, cross_domain_note string, sources array<string>"


def walk(items, k, tags, share):
    """Pick topics first, then by rank under the outlet limit, then anyway."""
    if len(items) <= k:
        return [i[1] for i in items]
    limit = max(1, int(k * share))
    ranked = sorted(items, key=lambda i: (DEPTH.get(i[3], 3), not i[4], i[1]))
    used, chosen = {}, []

    def fits(item):
        return all(used.get(s, 0) < limit for s in item[5])

    def add(item):
        chosen.append(item)
        for s in item[5]:
            used[s] = used.get(s, 0) + 1

    for tag in tags:
        pool = [i for i in ranked if i[2] == tag and i not in chosen]
        if pool and len(chosen) < k:
            add(next((i for i in pool if fits(i)), pool[0]))
    for item in ranked:
        if len(chosen) < k and item not in chosen and fits(item):
            add(item)
    for item in ranked:
        if len(chosen) < k and item not in chosen:
            add(item)
    return [i[1] for i in ranked if i in chosen]


def test_diverse_top(spark):
    rng = random.Random(7)
    rows = []
    for run in range(12):
        for pos in range(rng.choice([3, 7, 9, 40])):
            rows.append(
                (
                    f"r{run}",
                    pos,
                    rng.choice(["war", "ai", "econ", "econ", "econ"]),
                    rng.choice([*DEPTH, ""]),
                    rng.choice([None, "", "note"]),
                    rng.sample(["s1", "s1b", "s2", "s3"], rng.randint(0, 2)),
                )
            )
    df = spark.createDataFrame(rows, ITEM)
    tags = ["war", "ai", "defense"]
    for k, chunk in ((7, 500), (5, 2), (3, 1)):
        got = {}
        for r in diverse_top(df, k, tags, 0.4, chunk=chunk).collect():
            got.setdefault(r.run_date, []).append((r.rank, r.pos))
        for run in {r[0] for r in rows}:
            want = walk([r for r in rows if r[0] == run], k, tags, 0.4)
            assert [p for _, p in sorted(got[run])] == want, (run, k, chunk)


def test_primary_coverage(spark):
    item = "run_date string, desk string, pos int, item_id string, headline string, deep_dive_candidate boolean, links array<struct<url:string>>"
    desk = spark.createDataFrame(
        [
            ("r", "geopolitics_events", 0, "d", "dive", True, []),
            ("r", "geopolitics_events", 1, "g", "war item", False, [("http://a",)]),
            ("r", "geopolitics", 0, "same", "x", False, []),
            ("r", "ai_tech", 0, "same", "x", False, []),
            ("r", "defense_space", 0, "def", "def", False, []),
            ("s", "ai_tech", 0, "in", "in", False, []),
        ],
        item,
    )
    glance = spark.createDataFrame(
        [("r", "defense", "o", "o", []), ("s", "war", "in", "in", [])],
        "run_date string, tag string, item_id string, headline string, links array<struct<url:string>>",
    )
    got = {(r.run_date, r.tag, r.item_id) for r in primary_coverage(glance, desk).collect()}
    assert got == {("r", "war", "g"), ("r", "ai", "same")}


def grams(text, n=10):
    words = "".join(c for c in text.lower() if c.isalnum() or c in "_ ").split()
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def texts(rng, n, shared):
    out = []
    for i in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(30)]
        if i % 2:
            at = rng.randint(0, 10)
            words[at : at + len(shared)] = shared
        out.append(" ".join(words))
    return out


def test_shared_grams(spark):
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(13)]
    a, b = texts(rng, 6, shared), texts(rng, 4, shared)
    left = spark.createDataFrame([("r", i, t) for i, t in enumerate(a)], "run_date string, pos int, text string")
    right = spark.createDataFrame([("r", i, t) for i, t in enumerate(b)] + [("q", 9, a[0])], "run_date string, pos int, text string")
    got = {r.pos: (r.overlap_count, r.sample_phrase) for r in overlap_counts(shared_grams(left, right, ["pos"], hot_rows=3), ["pos"]).collect()}
    pool = set().union(*(grams(t) for t in b))
    want = {i: (len(grams(t) & pool), min(grams(t) & pool)) for i, t in enumerate(a) if grams(t) & pool}
    assert want and got == want


def test_one_shared_phrase_is_not_enough(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    twelve = " ".join(f"w{i}" for i in range(12))
    glance = spark.createDataFrame([("r", 0, twelve)], "run_date string, pos int, text string")
    dives = spark.createDataFrame(
        [("r", 0, ten, "corroborated"), ("r", 1, twelve, "widely-reported"), ("r", 2, twelve, "")],
        "run_date string, pos int, text string, source_depth string",
    )
    got = {r.pos: r.source_depth for r in overlap_downgrade(dives, glance).collect()}
    assert got == {0: "corroborated", 1: "corroborated", 2: ""}


def test_repeated_phrases(spark):
    rng = random.Random(9)
    pools = [[f"p{j}x{i}" for i in range(14)] for j in range(5)]
    rows = []
    for run in ("r", "s"):
        for pos in range(8):
            words = [f"w{rng.randint(0, 900)}" for _ in range(20)]
            for pool in rng.sample(pools, 2):
                words += pool
            rows.append((run, rng.choice(["glance", "dives", "seams"]), pos, " ".join(words)))
    df = spark.createDataFrame(rows, "run_date string, section string, pos int, text string")
    found = cross_section_phrases(df, hot_rows=5)
    kept = {}
    for r in representative_phrases(found, most=4, chunk=2).collect():
        kept.setdefault(r.run_date, []).append((r["rank"], r.pos_a, r.pos_b, r.phrase, r.suppressed))
    for run in ("r", "s"):
        items = [(s, p, grams(t)) for rr, s, p, t in rows if rr == run]
        seen, reps = set(), []
        for i, (sa, pa, ga) in enumerate(items):
            for sb, pb, gb in items[i + 1 :]:
                if sa == sb:
                    continue
                for phrase in sorted(ga & gb):
                    if phrase in seen:
                        continue
                    seen.add(phrase)
                    alike = any(len(set(phrase.split()) & set(x[2].split())) >= 8 for x in reps)
                    if not alike and len(reps) < 4:
                        reps.append((pa, pb, phrase))
        got = [(a, b, p) for _, a, b, p, _ in sorted(kept.get(run, []))]
        assert got == reps
        if reps:
            assert {x[4] for x in kept[run]} == {len(seen) - len(reps)}


@pytest.mark.parametrize("most_bits", [0, 1 << 23])
def test_phrases_with_and_without_a_filter(spark, most_bits):
    """One long section and short ones, odd keys and repeated texts: the phrases are those of all windows."""
    rng = random.Random(12)
    pools = [[f"p{j}x{i}" for i in range(12)] for j in range(6)]
    rows = []
    for pos in range(60):
        words = [f"W{rng.randint(0, 900)}," for _ in range(40)]
        for pool in rng.sample(pools, 2):
            at = rng.randint(0, len(words))
            words[at:at] = pool
        section = rng.choice(["dives"] * 8 + ["glance", "seams", None])
        rows.append((rng.choice(["r", "r", "s", None]), section, rng.choice([pos, pos, None]), " ".join(words)))
    rows += [(run, section, pos, "few words") for run, section, pos, _ in rows[:3]] + [("r", "dives", 99, None)] + rows[:4]
    df = spark.createDataFrame(rows, "run_date string, section string, pos int, text string")
    places = {}
    for run, section, pos, text in rows:
        if None not in (run, section, pos, text):
            for phrase in grams(text):
                at = places.setdefault((run, phrase), {})
                at[section] = min(pos, at.get(section, pos))
    want = {}
    for key, found in places.items():
        if len(found) > 1:
            (a, first), (b, second) = sorted((pos, section) for section, pos in found.items())[:2]
            want[key] = (a, first, b, second)
    got = {(r.run_date, r.phrase): (r.pos_a, r.section_a, r.pos_b, r.section_b) for r in cross_section_phrases(df, hot_rows=5, most_bits=most_bits).collect()}
    assert got == want and want
    assert cross_section_phrases(df.limit(0), most_bits=most_bits).count() == 0
    assert cross_section_phrases(df.where("section = 'dives'"), most_bits=most_bits).count() == 0


def test_windows_are_made_once_for_all_rounds(spark):
    """Rounds and report read the written phrases, not the texts again."""
    shared = " ".join(f"w{i}" for i in range(14))
    df = spark.createDataFrame([("r", "glance", 0, shared), ("r", "dives", 1, shared)], "run_date string, section string, pos int, text string")
    kept = representative_phrases(cross_section_phrases(df))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan and kept.count() == 2
