"""Operators on vectors against brute force: codes and nearest neighbours."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<double>, label int, id string, vector int, codes double"


def rows(n=300, width=32, seed=1):
    """Gaussian rows, a crowded cluster, copies, and every awkward vector."""
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0, 0.3) for _ in range(width)], i % 3) for i in range(n)]
    centre = [rng.gauss(0, 1) for _ in range(width)]
    out += [(1_000 + i, [c + rng.gauss(0, 0.01) for c in centre], None) for i in range(120)]
    out += [(2_000 + i, [0.5] * width, 7) for i in range(60)]
    out += [(2_100, [0.0] * width, 7), (2_150, [], 7), (2_200, [1.0], 8), (2_250, None, 8), (2_300, [None] + [0.1] * (width - 1), 8)]
    out += [(2_350, [float("nan")] * width, 8), (2_400, [float("-inf")] + [0.0] * (width - 1), 8), (None, [0.2] * width, None)]
    out += [(50, [0.1] * width, 9), (50, [0.1] * width, 9), (3_000, [2.0 * c for c in centre], 9)]
    return [(*r, "x", 1, 0.5) for r in out]


def usable(given):
    return [r for r in given if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def brute_codes(given, parts=16, entries=64, rounds=2):
    kept = usable(given)
    longest = max((len(r[1]) for r in kept), default=0)
    width = max(1, -(-longest // parts))
    whole = [[math.floor(256 * x) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(whole[i], p) for i in first] for p in range(parts)]

    def nearest(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for v in whole:
                held[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(held[i]) for c in zip(*held[i], strict=True)] if i in held else e for i, e in enumerate(books[p])]
    found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for v in whole]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] += e
    return Counter((r[0], tuple(i for _, i in f), e, by_label[r[2]]) for r, f, e in zip(kept, found, errors, strict=True)), books


@pytest.mark.parametrize(("given", "step"), [(rows(), 8_192), (rows(n=40), 5), ([], 7)])
def test_codes(spark, monkeypatch, given, step):
    from newsloom.llm import codes as c

    monkeypatch.setattr(c, "LEAVES", step)
    monkeypatch.setattr(c.walk, "__defaults__", (step,))
    monkeypatch.setattr(c, "HOT", 4 if step == 5 else 1_000)
    out, books = c.compress(spark.createDataFrame(given, SCHEMA).repartition(3))
    got = Counter((r.id, tuple(r.codes), r.error, r.label_error) for r in out.collect())
    want, expected = brute_codes(given)
    assert got == want
    if given:
        assert books.tolist() == expected
        listed = ",".join(str(x) for book in expected for e in book for x in e)
        assert c.digest(books) == hashlib.sha256(listed.encode()).hexdigest()


def test_codes_of_large_components(spark):
    """Distances beyond int64 sums are exact, and what a long can't hold is an error."""
    from newsloom.llm.codes import compress

    rng = random.Random(2)
    near = [(i, [1e6 + rng.random() for _ in range(16)], 0) for i in range(80)]
    near += [(100 + i, [1e15 + 16 * rng.randint(0, 9) for _ in range(16)], 1) for i in range(80)]
    given = [(*r, "x", 1, 0.5) for r in near[:64] if r[0] < 30] + [(*r, "x", 1, 0.5) for r in near if r[0] >= 100]
    got = Counter((r.id, tuple(r.codes), r.error, r.label_error) for r in compress(spark.createDataFrame(given, SCHEMA))[0].collect())
    assert got == brute_codes(given)[0]
    far = [(i, [float(i)] * 16, 0, "x", 1, 0.5) for i in range(64)] + [(100, [1e30] * 16, 0, "x", 1, 0.5), (101, [3e30] * 16, 0, "x", 1, 0.5)]
    with pytest.raises(Exception, match="Overflow|too large|out of"):
        compress(spark.createDataFrame(far, SCHEMA))[0].collect()


def test_trie_walk():
    from newsloom.llm.codes import distinct, walk

    rng = np.random.default_rng(1)
    for width, step in ((1, 3), (4, 8), (3, 100)):
        parts = rng.integers(-4, 4, (200, width))
        entries = rng.integers(-4, 4, (9, width))
        leaves, times, leaf = distinct(parts)
        assert leaves.tolist() == [list(x) for x in sorted(set(map(tuple, parts.tolist())))]
        assert (leaves[leaf] == parts).all() and times.sum() == 200
        nearest, error = walk(leaves, entries, step)
        all_errors = ((leaves[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (nearest == all_errors.argmin(axis=1)).all() and (error == all_errors.min(axis=1)).all()


def cosines(given):
    """Usable rows, padded, with the matrix of their cosines."""
    kept = [r for r in usable(given) if r[0] is not None and any(r[1])]
    width = max(len(r[1]) for r in kept)
    x = np.array([r[1] + [0.0] * (width - len(r[1])) for r in kept])
    n = np.sqrt((x * x).sum(axis=1))
    return kept, np.array([(x * v).sum(axis=1) / (n * m) for v, m in zip(x, n, strict=True)])


def brute_nearest(given, asked, k=5):
    kept, scores = cosines(given)
    out = Counter()
    for i, r in enumerate(kept):
        if asked(r[0]):
            best = sorted((-scores[i, j], c[0]) for j, c in enumerate(kept) if c[0] != r[0])[:k]
            out.update((r[0], n, j, round(-s, 12)) for n, (s, j) in enumerate(best, 1))
    return out


@pytest.mark.parametrize(("shard", "leaf"), [(8_192, 64), (60, 5)])
def test_vantage_trees(spark, monkeypatch, shard, leaf):
    from pyspark.sql import functions as F

    from newsloom.llm import vptree as v

    monkeypatch.setattr(v, "ROWS", shard)
    monkeypatch.setattr(v, "LEAF", leaf)
    given = rows() + [(4_000, [1e-200] * 32, 1, "x", 1, 0.5), (4_050, [1e200] * 32, 1, "x", 1, 0.5)]
    table = spark.createDataFrame(given, SCHEMA).repartition(3)
    found = v.nearest(table, F.col("vec_id") % 50 == 0).collect()
    got = Counter((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in found)
    tiny = [(i, [math.ldexp(x, 600 if i == 4_000 else -600) for x in e] if i in (4_000, 4_050) else e, *rest) for i, e, *rest in given]
    assert got == brute_nearest(tiny, lambda i: i % 50 == 0)
    assert v.nearest(table.limit(0), F.lit(True)).count() == 0
    assert v.nearest(table.where("vec_id = 7"), F.lit(True)).count() == 0


def test_relaxed_pruning():
    """Smaller factors visit fewer leaves; recall falls slowly; factor one is exact."""
    from newsloom.llm import vptree as v

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(12, 8))[rng.integers(0, 12, 4_000)] + rng.normal(0, 0.25, (4_000, 8)), rng.normal(size=(500, 8))])
    u = x / v.norms(x)[:, None]
    tree = v.Tree.grow(u, 32)
    shard = v.Shard(tree.order, x[tree.order], tree)
    asked = np.arange(0, len(x), 50)
    best = np.argsort(-np.where(np.arange(len(x))[None] == asked[:, None], -9, u[asked] @ u.T), axis=1)[:, :5]
    visits, recall = [], []
    for factor in (1.0, 0.7, 0.4):
        held = v.Best(asked, x[asked], 5)
        visits.append(shard.search(held, factor))
        recall.append(np.mean([len({i for _, i in f} & set(b)) / 5 for f, b in zip(held.found, best, strict=True)]))
    assert visits[0] > visits[1] > visits[2] and visits[0] < 0.6 * len(asked) * (len(tree.spans) // 2 + 1)
    assert recall[0] == 1 and recall[1] >= 0.9 and recall[0] >= recall[1] >= recall[2]


def test_sample_reaches_the_driver_once(spark):
    """Partitions don't each send a sample, packed blocks are never broadcast; copies too fill the sample."""
    from newsloom.llm.store import lowest_hashes
    from pyspark.sql import functions as F

    table = spark.range(0, 4_000, 1, 40).selectExpr("id % 1000 AS id", "array(CAST(id % 1000 AS double), 0.5D) AS vector")
    order = [F.xxhash64("id", "vector"), "id", "vector"]
    for rows in (8, 100, 3_000, 5_000):
        want = [tuple(r) for r in table.orderBy(*order).limit(rows).collect()]
        assert [tuple(r) for r in lowest_hashes(table, 4_000, rows)] == want
    alike = table.withColumns({"id": F.lit(1), "vector": F.array(F.lit(1.0))})
    assert len(lowest_hashes(alike, 4_000, 8)) == 8


@pytest.mark.parametrize("name", ["nearest", "vptree"])
def test_blocks_are_not_broadcast(spark, name):
    import importlib

    from pyspark.sql import functions as F

    found = importlib.import_module(f"newsloom.llm.{name}").nearest(spark.createDataFrame(rows(), SCHEMA), F.col("vec_id") % 50 == 0)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
