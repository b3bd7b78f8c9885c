"""Operators on tables: archives, vectors, shards, mixes, models, the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# WARC


def pages():
    big = "<p>" + "grüße " * 300
    rows = [(i, f"http://a/{i}", f"<p>{i}" * (i % 7)) for i in range(40)]
    rows += [(100 + i, "http://b/\r\nx y", big) for i in range(9)]
    rows += [(300, "http://c", big + "z"), (300, "http://c", big + "z"), (300, None, big + "z"), (None, "n", big), (None, None, None)]
    return rows


def expected_records(rows):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out = Counter()
    for html, ids in groups.items():
        data = html.encode()
        digest = hashlib.sha1(data).hexdigest()
        top = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: x != top):
            plain = len(data) < 1000 or (i == top and first)
            first = False
            out[(i, len(data), digest, "response" if plain else "revisit", None if plain else top)] += 1
    return out


@pytest.mark.parametrize("limits", [(4 << 20, 16 << 20), (3_000, 600)])
def test_archives(spark, tmp_path, limits):
    from newsloom.llm.warc import read_archives, write_archives

    table = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("shard", F.lit("x"))
    names = []
    for k in range(2):
        folder = f"file://{tmp_path}/{k}"
        manifest = write_archives(table.repartition(3 + k), folder, *limits)
        back = read_archives(spark, folder, payload=True)
        got = Counter(tuple(r) for r in back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
        assert got == expected_records(pages())
        for r in back.where("record_type = 'response'").collect():
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest
        rows = {r.file: r.bytes for r in manifest.collect()}
        # Files are spread over the reading tasks, however small the manifest is.
        tasks = back.select(F.spark_partition_id().alias("task")).distinct().count()
        assert tasks == min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
        names.append({f: hashlib.sha256((tmp_path / str(k) / f).read_bytes()).hexdigest() for f in rows})
        assert all((tmp_path / str(k) / f).stat().st_size == n for f, n in rows.items())
    # Equal input, however it is partitioned, gives equal files.
    assert names[0] == names[1] and (len(names[0]) > 2 or limits[0] > 10_000)


def test_archives_of_nothing_and_damage(spark, tmp_path):
    from newsloom.llm.warc import page_record, parse_record, read_archives, write_archives

    table = spark.createDataFrame([], "page_id long, url string, html string")
    write_archives(table, f"file://{tmp_path}/none")
    assert read_archives(spark, f"file://{tmp_path}/none").count() == 0
    record = page_record(1, "http://a", b"payload", hashlib.sha1(b"payload").hexdigest(), None, 0)
    assert parse_record(record)[0] == "response"
    with pytest.raises(ValueError):
        parse_record(record.replace(b"payload\r\n", b"paYload\r\n"))


# Top k


def vectors(n=300, same=40):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)], "x") for i in range(n)]
    rows += [(1_000 + i, [0.5] * 6, "x") for i in range(same)]
    rows += [(2_000, None, "x"), (2_050, [0.1, None, 0.0, 0.0, 0.0, 0.0], "x"), (2_100, [float("nan")] + [0.0] * 5, "x"), (2_150, [float("inf")] * 6, "x"), (None, [0.1] * 6, "x"), (2_200, [], "x"), (2_250, [1.0], "x")]
    return rows


@pytest.mark.parametrize("sizes", [(1_024, 16_384), (3, 50)])
def test_top_k(spark, monkeypatch, sizes):
    from newsloom.llm import nearest as n

    monkeypatch.setattr(n, "QUERY_ROWS", sizes[0])
    monkeypatch.setattr(n, "ROWS", sizes[1])
    table = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, block string")
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in vectors() if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in usable:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in usable if i != q)[:5]
            want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    got = [tuple(r) for r in n.nearest(table, F.col("vec_id") % 50 == 0).collect()]
    assert len(got) == len(want) and set(got) == want
    assert n.nearest(table.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("scale", [2.0**26, 1e8, 1e30])
def test_top_k_of_large_components(spark, scale):
    """Scores beyond 2^53 and 2^63 are compared exactly; what a long can't hold is an error."""
    from newsloom.llm import nearest as n

    rows = [(0, [scale, 1.0]), (1, [scale, 2.0]), (2, [1.0, 1.0]), (3, [scale, 2.0]), (50, [-scale, 0.5]), (51, [0.25 / scale, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * int(x)) if abs(x) >= 1 else math.floor(256 * x) for x in v] for i, v in rows}
    want = {}
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in whole.items() if i != q)
        want |= {(q, r): (i, -s) for r, (s, i) in enumerate(best[:2], 1)}
    asked = n.nearest(table, F.col("vec_id") % 50 == 0, 2)
    if all(abs(s) < 2**63 for _, s in want.values()):
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in asked.collect()} == want
    else:
        with pytest.raises(Exception, match="Overflow|too large|out of"):
            asked.collect()


def test_cells_are_eliminated():
    """Queries skip cells that can't hold a better row, and few rows are evaluated."""
    import numpy as np

    from newsloom.llm import nearest as n

    rng = np.random.default_rng(3)
    centres = rng.integers(-4_000, 4_000, (40, 16))
    vectors = (centres[rng.integers(0, 40, 6_000)] + rng.integers(-40, 40, (6_000, 16))).astype(np.int64)
    pivots = np.concatenate([np.zeros((1, 16)), vectors[:32].astype(float)])
    far = n.distances(vectors.astype(float), pivots)
    cell = far.argmin(axis=1)
    ranges = np.array([[far[cell == c].min(axis=0), far[cell == c].max(axis=0)] if (cell == c).any() else np.zeros((2, 33)) for c in range(33)]).transpose(0, 2, 1)
    asked = np.arange(0, 6_000, 60)
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -(2**62)
    reach = np.sort(scores, axis=1)[:, -5]
    stays = n.survivors(far[asked], reach.tolist(), ranges)
    best = np.argsort(-scores, axis=1)[:, :5]
    assert all(stays[cell[b], i].all() for i, b in enumerate(best))
    assert stays.mean() < 0.6
    ids, looked = np.arange(len(vectors)), 0
    for i, q in enumerate(asked[:30]):
        f = n.Found(int(q), vectors[q], far[q], 5, None)
        looked += f.look(ids, vectors, far)
        assert [-s for s, _ in f.best] == np.sort(scores[i])[::-1][:5].tolist()
    assert looked < 0.5 * 30 * len(vectors)


# Bin packing


def test_best_fit_decreasing():
    from newsloom.llm.packing import best_fit_decreasing, fewest_capacity

    rng = random.Random(1)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(1, 200))), reverse=True)
        room = []
        want = []
        for s in sizes:
            open_bins = [(r, i) for i, r in enumerate(room) if r >= s]
            if open_bins:
                i = min(open_bins)[1]
            else:
                i = len(room)
                room.append(64)
            room[i] -= s
            want.append(i)
        assert best_fit_decreasing(sizes, 64) == (want, len(room))
        load = Counter()
        for s, b in zip(sizes, fewest_capacity(sizes, 4), strict=True):
            load[b] += s
        assert max(load) < 4 and max(load.values()) <= sum(sizes) / 4 + sizes[0]


@pytest.mark.parametrize("chunks", [4_096, 1])
def test_shards(docs, monkeypatch, chunks):
    from newsloom.llm import packing

    monkeypatch.setattr(packing, "CHUNKS", chunks)
    monkeypatch.setattr(packing, "PACK_GROUPS", 7)
    rows = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    found = packing.shard_by_bytes(docs.where("doc_id is null or doc_id <> 10"), 3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(r for r in rows if r[0] != 10)
    homes, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in found:
        homes[(r.size, r.text_crc32)].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values())


# Mixing


def expected_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while True:
        share = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / share > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / share for s in open_}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over


def test_mix(docs):
    from newsloom.llm.mixing import mix

    rows = [(r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    sizes = Counter()
    for s, n in rows:
        sizes[s] += n
    got = mix(docs).collect()
    assert Counter((r.source, r.size) for r in got) == Counter(rows)
    target = expected_targets(sizes, (5, 2, 1), 3)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    again = mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_pareto_sample_is_fair(spark):
    """Inclusion follows the missing words, whatever the size."""
    from newsloom.llm.mixing import mix

    rows = [(i, "w " * (1 + i % 9), "a" if i < 4_000 else "b") for i in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(docs, weights=(1.0, 1.0), most=3.0).where("source = 'a'").toPandas()
    want = out["target"].iloc[0] / out["source_size"].iloc[0]
    assert out["taken"].sum() == pytest.approx(out["target"].iloc[0], abs=9)
    for size, part in out.groupby("size"):
        assert part["copies"].mean() == pytest.approx(want, abs=0.08), size


# Models


def test_chain_against_enumeration():
    import itertools

    import numpy as np

    from newsloom.llm.crf import Chain

    rng = np.random.default_rng(0)
    chain = Chain(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    counts = np.array([4, 1, 6, 2])
    x = rng.normal(size=(counts.sum(), 3))
    first = np.zeros(len(x), dtype=bool)
    first[np.cumsum(counts) - counts] = True
    node, pair = chain.marginals(x, first)
    best = chain.best(x, counts)
    for begin, n in zip(np.cumsum(counts) - counts, counts, strict=True):
        unary = x[begin : begin + n] @ chain.weights
        scores = {}
        for labels in itertools.product((0, 1), repeat=int(n)):
            s = chain.start[labels[0]] + sum(unary[i, y] for i, y in enumerate(labels))
            scores[labels] = s + sum(chain.transitions[a, b] for a, b in zip(labels, labels[1:], strict=False))
        z = sum(math.exp(s) for s in scores.values())
        for i in range(n):
            p = sum(math.exp(s) for y, s in scores.items() if y[i] == 1) / z
            assert node[begin + i, 1] == pytest.approx(p)
            if i:
                both = sum(math.exp(s) for y, s in scores.items() if y[i - 1] == 1 and y[i] == 0) / z
                assert pair[begin + i, 1, 0] == pytest.approx(both)
        assert tuple(best[begin : begin + n]) == max(scores, key=scores.get)


def toxic_rows(n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [f"v{rng.randint(0, 900)}" for _ in range(30)]
        if bad:
            for _ in range(3):
                w[rng.randrange(30)] = rng.choice(["grumble", "snarlish", "Vexing"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows + [(n, None), (n + 1, ""), (n + 1, "")], labels


def test_toxicity_held_out(spark):
    from newsloom.llm.toxicity import toxicity

    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    found = toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = found.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    truth, text = dict(labels), dict(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        for s in r.spans:
            assert text[r.doc_id][s.start : s.end].split(" ")[0].lower() in ("grumble", "snarlish", "vexing")
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_quality_counts_and_verdicts(spark, docs):
    from newsloom.llm.quality import quality

    clean = [(i, "\n".join(" ".join(f"q{i * 100 + j * 13 + k}" for k in range(12)) for j in range(5)), 1) for i in range(0, 200, 2)]
    junk = [(i, "\n".join(" ".join(f"Q{i * 100 + j * 13 + k}!!|%%%" for k in range(12)) for j in range(5)), 0) for i in range(1, 201, 2)]
    rows = [(10_000 + i, t, q) for i, t, q in clean + junk]
    extra = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    both = docs.select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    found = quality(both, extra.select("doc_id", "quality")).collect()
    want = Counter()
    for i, t in [(r.doc_id, r.text or "") for r in both.collect()]:
        w = WORD.findall(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {x for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed)] += 1
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[n] for n in names) for r in found) == want
    assert not any(r.kept and r.base_failed for r in found)
    kept = {r.doc_id: r.kept for r in found}
    assert sum(kept[i] == bool(q) for i, _, q in rows) >= 0.98 * len(rows)


# The pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as p

    rows, labels = toxic_rows()
    toxic = [(5_000 + i, t, "en", "a", len(t or "")) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    both = spark.createDataFrame(toxic, schema).unionByName(docs.select(*p.COLUMNS))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5_000 + i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == p.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        seen.append(now.collect())
        now = spark.read.parquet(f"{tmp_path}/{k}")
    last = now.collect()
    bad = {5_000 + i for i, t in labels if t}
    kept = {r.doc_id for r in seen[1]}
    assert len(bad & kept) <= 0.02 * len(bad) and len(kept - bad) >= 0.98 * len({r.doc_id for r in seen[0]} - bad)
    # One document of each class of near duplicates.
    stayed = Counter(r.doc_id for r in seen[2])
    assert sum(stayed[100 + i] for i in range(12)) == sum(stayed[200 + i] for i in range(8)) == stayed[14] + stayed[1] == 1
    assert all(stayed[300 + i] == 1 for i in range(30))
    secret = {r.doc_id: r for r in seen[3]}
    assert secret[12].text.count("[SECRET]") == 3 and "deadbeef" not in secret[12].text and secret[12].n_chars == len(secret[12].text)
    # The mix repeats or leaves out whole documents.
    before, after = {r.doc_id: r.text for r in seen[3]}, Counter((r.doc_id, r.text) for r in seen[4])
    assert all(before[i] == t and 1 <= n <= 3 for (i, t), n in after.items())
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in seen[4])
    digest = {r.doc_id: r.decoded_sha256 for r in last}
    assert all(digest[i] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in after)
    rerun = Counter(tuple(r) for r in p.run(spark, str(tmp_path)).collect())
    assert rerun == Counter(tuple(r) for r in last)


def test_pipeline_of_nothing(spark, nothing, tmp_path):
    import corpus_pipeline as p

    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_tagger_does_not_hang_on_partitions(spark):
    """Equal texts under several ids, in other partitions: the same model."""
    from newsloom.llm import toxicity as t

    rows, labels = toxic_rows()
    rows += [(10_000 + i, x) for i, x in rows[:200]]
    labels += [(10_000 + i, b) for i, b in labels[:200]]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    one, two = (t.fit(docs.repartition(n), marks.repartition(n).where(~t.fold())) for n in (1, 23))
    assert one.features.tolist() == two.features.tolist() and one.odds.tolist() == two.odds.tolist()
    assert (one.slope, one.shift) == (two.slope, two.shift)
    assert (one.chain.weights == two.chain.weights).all() and (one.chain.transitions == two.chain.transitions).all()
