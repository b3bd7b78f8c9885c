"""Operators on whole texts against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Substrings


def expected_windows(rows, window):
    lists = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[j : j + window]) for _, w in lists for j in range(len(w) - window + 1))
    out = Counter()
    for i, w in lists:
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        out[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


@pytest.mark.parametrize("window", [35, 6])
def test_substrings(docs, window):
    from newsloom.llm.substrings import remove_repeats

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = rows_of(remove_repeats(docs, window), "doc_id", "n_words", "n_removed", "kept")
    assert got == expected_windows(rows, window)
    digests = rows_of(remove_repeats(docs, window, digest=True), "doc_id", "kept")
    assert digests == Counter({(i, sha(t)): n for (i, _, _, t), n in got.items()})


@pytest.mark.parametrize("name", ["CROWD", "AUTOMATON"])
def test_substrings_of_crowded_anchors(docs, monkeypatch, name):
    from newsloom.llm import substrings

    monkeypatch.setattr(substrings, name, 1)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = rows_of(substrings.remove_repeats(docs, 20), "doc_id", "n_words", "n_removed", "kept")
    assert got == expected_windows(rows, 20)


def test_counts_agree_with_the_automaton():
    import random

    from newsloom.llm.substrings import by_automaton, by_count

    rng = random.Random(4)
    for size in (2, 3, 5):
        group = [(bytes([i]), rng.choice([1, 1, 2]), b" ".join(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(size, 20)))) for i in range(12)]
        assert list(by_automaton(group, size)) == list(by_count(group, size))


def test_automaton_counts_occurrences():
    from newsloom.llm.substrings import SuffixAutomaton

    a = SuffixAutomaton()
    texts = [list("abcabx"), list("zabcy"), list("aaaa")]
    for t in texts:
        a.add(t, 1)
    a.close()
    for size in (1, 2, 3):
        every = Counter("".join(t[i : i + size]) for t in texts for i in range(len(t) - size + 1))
        for t in texts:
            want = [i for i in range(len(t) - size + 1) if every["".join(t[i : i + size])] > 1]
            assert a.repeated(t, size) == want


# Near duplicates


def expected_classes(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall(t or "")
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else None))
    n = len(sets)
    near = defaultdict(set)
    for a in range(n):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                near[a].add(b)
                near[b].add(a)
    out = Counter()
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[(sets[a][0], min((sets[b][0] for b in seen if sets[b][0] is not None), default=None), len(near[a]))] += 1
    return out


@pytest.mark.parametrize("limit", [None, 4])
def test_near_duplicates(docs, limit):
    from newsloom.llm import jaccard

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = jaccard.near_duplicates(docs, limit or jaccard.BUCKET)
    assert rows_of(found, "doc_id", "class_id", "n_links") == expected_classes(rows)
    leads = rows_of(found.where("leads and class_id is not null").distinct(), "class_id")
    assert set(leads.values()) == {1} or limit


def test_split_buckets_lose_no_pair(spark):
    from newsloom.llm import jaccard

    # One word in the middle of 49 differs: 40 of 50 shingles are shared, the threshold.
    n, rng = 3_000, random.Random(5)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(10**9)}" for _ in range(49)]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join([*words[:24], "x", *words[25:]])))
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), limit=1)
    assert found.where("n_links = 1").count() == 2 * n


def test_tiles(docs, monkeypatch):
    from newsloom.llm import jaccard

    monkeypatch.setattr(jaccard, "TILE", 3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(jaccard.near_duplicates(docs), "doc_id", "class_id", "n_links") == expected_classes(rows)


def test_labels_along_a_chain(spark):
    from newsloom.llm.jaccard import connected

    edges = spark.createDataFrame([(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(40)], "name binary, other binary")
    assert {bytes(r.label) for r in connected(edges).collect()} == {b"000"}


# Byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as p
    import tiktoken

    from newsloom.llm.bpe import load_ranks

    ranks = load_ranks(p.path("byte_bpe_50k.tiktoken"))
    return ranks, p.PATTERN, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, tokenizer):
    from newsloom.llm.bpe import decode, encode, round_trip

    ranks, pattern, known = tokenizer
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    encoded = encode(docs, ranks, pattern)
    want = Counter((i, tuple(known.encode_ordinary(t or ""))) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == want
    back = Counter((r.doc_id, bytes(r.data)) for r in decode(encoded, ranks).collect())
    assert back == Counter((i, (t or "").encode()) for i, t in rows)
    got = rows_of(round_trip(docs, ranks, pattern), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == Counter((i, len(x), sha(" ".join(map(str, x))), sha(t or "")) for (i, x), t in zip(((i, known.encode_ordinary(t or "")) for i, t in rows), (t for _, t in rows), strict=True))


def test_bpe_of_long_pieces(tokenizer):
    from newsloom.llm.bpe import encode_piece

    ranks, _, known = tokenizer
    for piece in ("a" * 5_000, "ab" * 3_000, "Donaudampfschifffahrt" * 50, "   " * 99, "é" * 700):
        assert encode_piece(piece.encode(), ranks) == known.encode_ordinary(piece)


# Secrets


def expected_secrets(text):
    kinds = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    found = []
    for k, (kind, pattern, good) in enumerate(kinds):
        flags = re.I | re.A if kind == "assign" else re.A
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text, flags) if good(m)]
    return sorted(found)


def test_secrets(docs):
    from newsloom.llm import secrets as s

    found = s.scan(docs).withColumn("spelled", s.spelled(F.col("base")))
    for r in found.collect():
        want = expected_secrets(r.text or "")
        assert r.spelled == ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert [x.kind for x in r.base] == [x[1] for x in want]


def test_entropy(spark):
    from newsloom.llm import secrets as s

    random = "kD8fQ2zLp0XvR7mWb3TnY5cJ"
    texts = [
        f"key {random} end",
        "key aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 end",
        "id 123e4567-e89b-12d3-a456-426614174000 end",
        "an example_" + random,
        "thisisjustaverylongwordwithoutdigits",
        f"token = {random}",
        None,
    ]
    df = s.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"))
    rows = {r.doc_id: r for r in df.collect()}
    assert [len(rows[i].added) for i in range(7)] == [1, 0, 0, 0, 0, 0, 0]
    one = rows[0].added[0]
    assert texts[0][one.start : one.end] == random
    clean = df.select("doc_id", s.redact(F.col("text"), F.array_sort(F.concat("base", "added"))).alias("t")).collect()
    assert {r.doc_id: r.t for r in clean}[0] == "key [SECRET] end"
    assert {r.doc_id: r.t for r in clean}[5] == "[SECRET]"
    assert {r.doc_id: r.t for r in clean}[6] is None


def test_entropy_of_windows(spark):
    import math

    from newsloom.llm import secrets as s

    value = "a1B2c3D4e5F6a1B2c3D4e5F6g7H8i9J0kkkkkkkkkkkkkkkkkkkkkk1"
    windows = [value[i : i + s.WINDOW] for i in range(len(value) - s.WINDOW + 1)]
    entropy = [-sum(n / s.WINDOW * math.log2(n / s.WINDOW) for n in Counter(w).values()) for w in windows]
    for limit in (1.0, 3.0, 3.7, 4.0, 4.4):
        hit = [i for i, e in enumerate(entropy) if e >= limit]
        want = (hit[0], hit[-1] + s.WINDOW) if hit else (None, None)
        got = spark.range(1).select(s.entropy_range(F.lit(value), F.lit(limit)).alias("r")).first().r
        assert (got.first, got.end) == want


# Empty tables


def test_empty_tables(spark, nothing, tokenizer):
    from newsloom.llm import bpe, jaccard, quality, secrets, substrings, toxicity
    from newsloom.llm.mixing import mix
    from newsloom.llm.packing import shard_by_bytes

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [
        substrings.remove_repeats(nothing),
        jaccard.near_duplicates(nothing),
        bpe.round_trip(nothing, *tokenizer[:2]),
        secrets.scan(nothing),
        toxicity.toxicity(nothing, labels),
        quality.quality(nothing, labels),
        mix(nothing),
        shard_by_bytes(nothing),
    ]
    assert [df.count() for df in made] == [0] * len(made)


# Sequences that collide under polynomial hashes modulo 2^64


def thue_morse(n, flip=0):
    return [(bin(i).count("1") + flip) % 2 for i in range(n)]


def colliding(a="a", b="b", n=2_048, sep=""):
    return tuple(sep.join((a, b)[x] for x in thue_morse(n, flip)) for flip in (0, 1))


def test_colliding_sequences_are_told_apart(spark):
    import numpy as np

    from newsloom.llm.jaccard import near_duplicates
    from newsloom.llm.quality import Lines
    from newsloom.llm.substrings import by_automaton, by_count, remove_repeats

    def raw(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return data, np.array([0, len(data)])

    one, two = colliding()
    lines = Lines(*raw(f"{one}\n{two}\n{one}"))
    assert lines.n_dup_lines.tolist() == [1]
    words = [f"p{i}" for i in range(60)]
    lines = Lines(*raw(" ".join([*words[:4], one, *words[4:40], *words[:4], two, *words[40:]])))
    assert lines.n_repeat_words.tolist() == [0]
    # Windows that differ in one colliding word, and texts that do.
    apart = [" ".join([*words[:20], w, *words[20:40]]) for w in (one, two)]
    group = [(bytes([i]), 1, t.encode()) for i, t in enumerate(apart)]
    assert list(by_automaton(group, 35)) == list(by_count(group, 35)) == [(b"\0", []), (b"\1", [])]
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(list(enumerate(apart)) + [(7, apart[0])], schema)
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()} == {0: 41, 1: 0, 7: 41}
    other = colliding("xx", "yy", sep=" ")
    docs = spark.createDataFrame([(0, one), (1, two), (2, f"{one} z"), (3, f"{two} z"), (4, one), (5, other[0][:300]), (6, other[1][:300])], schema)
    found = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert found[0] == found[4] and len({found[i] for i in (0, 1, 2, 3)}) == 4


def test_sorted_windows_agree_with_automata():
    from newsloom.llm.substrings import by_automaton, by_count

    rng = random.Random(9)
    for _ in range(25):
        group = []
        for i in range(rng.randint(1, 6)):
            text = " ".join(rng.choice("abc") for _ in range(rng.randint(5, 60)))
            group.append((bytes([i]), rng.choice([1, 1, 2]), text.encode()))
        assert list(by_automaton(group, 5)) == [(k, list(s)) for k, s in by_count(group, 5)]


def test_window_names():
    import numpy as np

    from newsloom.llm.arrays import window_names

    ids = np.random.default_rng(1).integers(0, 3, 300)
    for k in (1, 2, 3, 5, 8, 35):
        names = window_names(ids, k)
        cut = [tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1)]
        assert len(names) == len(cut) and len(set(zip(names.tolist(), cut, strict=True))) == len(set(cut)) == len(set(names.tolist()))
    assert len(window_names(ids[:3], 4)) == 0


def brute_entropy(value, limit, size=20):
    import math

    above = []
    for i in range(len(value) - size + 1):
        counts = Counter(value[i : i + size])
        # The sum of n log2 n in whole units, as the operator keeps it.
        total = sum(round(n * math.log2(n) * 2**32) for n in counts.values())
        if total <= math.floor((math.log2(size) - limit) * size * 2**32):
            above.append(i)
    return (above[0], above[-1] + size) if above else None


def test_entropy_of_long_candidates(spark):
    """Random candidates of thousands of characters, and one of a million in linear time."""
    import time

    from newsloom.llm import secrets as s

    rng = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    values = []
    for i in range(25):
        few = "".join(rng.sample(alphabet, rng.randint(3, 12)))
        parts = [few * 4] if i < 5 else [rng.choice([few * 4, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))]) for _ in range(rng.randint(1, 60))]
        values.append("q9Z" + "".join(parts))
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    found = docs.select("doc_id", s.entropy_range(F.col("text"), F.lit(3.8)).alias("r")).collect()
    want = {i: brute_entropy(v, 3.8) for i, v in enumerate(values) if len(v) >= 20}
    assert {r.doc_id: (r.r.first, r.r.end) if r.r.first is not None else None for r in found if r.doc_id in want} == want
    assert any(want.values()) and not all(want.values())
    # Without the letter that the allow list takes four of for a sample.
    plain = alphabet.replace("x", "").replace("X", "")
    long = "x " + "".join(rng.choice(plain) for _ in range(1_000_000)) + " token=abcdef123 " * 2_000
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    began = time.perf_counter()
    row = s.scan(docs).select("base", "added").first()
    assert time.perf_counter() - began < 30
    assert len(row.base) == 2_000 and len(row.added) == 1 and row.added[0].end - row.added[0].start > 999_000
