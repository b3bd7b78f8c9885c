"""Phrase collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import SCHEMA, documents, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    """Skewed words over languages, marks between pieces, copies, awkward rows."""
    rng = random.Random(4)
    rows = [(i, t, lang, s, n, 0, "x", 1.0) for i, t, lang, s, n, *_ in documents() if i not in (10, 14)]
    for i in range(240):
        lang = ["en", "en", "de", None, "und", ""][i % 6]
        out = []
        for _ in range(rng.randint(0, 120)):
            word = f"W{min(rng.randint(1, 30), rng.randint(1, 30), rng.randint(1, 30))}"
            out.append(rng.choice([word, word, word.lower(), "Ünd ÄB", "new York city", "New york City hall"]))
            out.append(rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "\x1c"]))
        rows.append((1_000 + i, "".join(out), lang, "a", 0, 0, "x", 1.0))
    return rows


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        cover = Counter()
        for p, a in held.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    cover[p[i : i + k]] = max(cover[p[i : i + k]], a)
        ranked = []
        for p, a in held.items():
            if not cover[p] or 100 * cover[p] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), a, left, right))
        for i, (s, _, p, a, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, i, p.decode(), a, left, right, n[lang], -s))
    return out


@pytest.mark.parametrize(("shard", "parts", "least", "top"), [(2_000_000, 1, 30, 2_000), (300, 5, 6, 25)])
def test_collocations(spark, monkeypatch, shard, parts, least, top):
    from newsloom.llm import phrases as p

    monkeypatch.setattr(p, "SHARD_WORDS", shard)
    monkeypatch.setattr(p, "SLICE_BYTES", 2_000 if shard == 300 else 8 << 20)
    monkeypatch.setattr(p, "OUT_ROWS", 100)
    rows = texts()
    table = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = [tuple(r) for r in p.collocations(table, least, top).collect()]
    want = brute(rows, least, top)
    assert len(got) == len(want) > 20 and set(got) == want


def test_nothing_and_large_products(spark, nothing):
    from newsloom.llm import phrases as p

    assert p.collocations(nothing).count() == 0
    assert p.collocations(frame(spark, [(1, None, None, "s", 0, 0, "x", 1.0), (2, " .,", "en", "s", 0, 0, "x", 1.0)])).count() == 0
    big = 9_000_000_000_000_000
    rows = [("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 3), ("en", "a b a", 3, big - 9)]
    found = p.scored(spark.createDataFrame(rows, "lang string, phrase string, length int, f long")).collect()
    assert [tuple(r) for r in found] == [("en", "a b a", big - 9, big - 3, big, 2_000_000 * (big - 9) // (2 * big - 3))]


def test_intervals_against_counting():
    from newsloom.llm.phrases import FmIndex, transform

    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 5, 400), [0]]).astype(np.int32)
    index = FmIndex(transform(ids))
    level, spelled = index.words(), None
    for length in range(1, 5):
        if length > 1:
            tails = spelled
            level = index.extend(level)
            spelled = [(w, *tails[t]) for w, t in zip(level.word.tolist(), level.tail.tolist(), strict=True)]
            assert [tails[h] for h in level.head.tolist()] == [s[:-1] for s in spelled]
        else:
            spelled = [(w,) for w in level.word.tolist()]
        want = Counter(tuple(ids[i : i + length].tolist()) for i in range(len(ids) - length + 1) if ids[i : i + length].all())
        assert dict(zip(spelled, level.counts.tolist(), strict=True)) == want
