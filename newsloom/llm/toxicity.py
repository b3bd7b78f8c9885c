"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are of documents. Token labels come from them: words and word openings
whose documents are toxic far more often than chance are called toxic in toxic
documents. The chain is trained on those labelled tokens; forward-backward
marginals then give offending spans and, combined, the score of a document.

Empty and null texts have no token and get the score of a document without any
toxic token. Repeated rows give repeated results. With no labelled document of
either class nothing is learnt, and every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import crf
from newsloom.llm.arrays import SpanHasher, slices
from newsloom.llm.store import written

# Bounds of the sample that the classifier is fitted on, in labelled documents per class.
SAMPLE = 8_000
CHAIN_SAMPLE = 250
# Words of the chain's sample; a document that no longer fits is left out.
CHAIN_TOKENS = 2_000_000
# Size of the learnt lexicon.
LEXICON = 4_096
# A feature stays if it is among the strongest TOP of so many sampled documents.
TOP, SUPPORT = 3, 3
# A word opening is toxic from this evidence (nats) and precision on.
EVIDENCE, PRECISION = 12.0, 0.85
OPENINGS = (3, 4, 5, 6, 8)

_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points belong to words, and their lower-case forms."""
    if not _TABLES:
        chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000)]
        _TABLES.append(np.array([c.isalnum() for c in chars]))
        lower = (c.lower() for c in chars)
        _TABLES.append(np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(lower)], dtype=np.uint32))
    return _TABLES[0], _TABLES[1]


class Tokens:
    """Runs of letters and digits of a slice, with hashes of their openings."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        word, lower = _tables()
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        # Code point offset of each document: bytes that do not continue a character.
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.offsets = lead[offsets]
        n = len(codes)
        solid = word[codes]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        before[1:] = solid[:-1]
        after[:-1] = solid[1:]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        hasher = SpanHasher(lower[codes])
        size = self.ends - self.starts
        parts = [hasher(self.starts, self.ends)]
        for k in OPENINGS:
            h = hasher(self.starts, np.minimum(self.starts + k, self.ends)) ^ np.uint64(0x5851F42D4C957F2D * k % 2**64)
            parts.append(np.where(size > k, h, parts[0]))
        self.hashes = np.stack(parts, axis=1).astype(np.int64)

    def begins(self) -> np.ndarray:
        out = np.zeros(len(self.starts), dtype=bool)
        out[self.first[:-1][self.counts > 0]] = True
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class per feature; feature 0 counts documents."""
    for batch in batches:
        toxic = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False), dtype=np.int64)
        for a, b, data, offsets in slices(batch.column("text")):
            t = Tokens(data, offsets)
            doc = np.repeat(np.repeat(np.arange(b - a), t.counts), t.hashes.shape[1])
            pairs = np.unique(np.stack([t.hashes.ravel(), doc]), axis=1)
            feature, at = np.unique(pairs[0], return_inverse=True)
            bad = np.bincount(at, weights=toxic[a:b][pairs[1]], minlength=len(feature)).astype(np.int64)
            every = np.bincount(at, minlength=len(feature)).astype(np.int64)
            feature = np.append(feature, 0)
            bad, every = np.append(bad, toxic[a:b].sum()), np.append(every, b - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(feature), pa.array(bad), pa.array(every)], ["feature", "bad", "every"]
            )


@dataclass
class Model:
    """Lexicon (sorted hashes and log odds), chain, and doc calibration."""

    features: np.ndarray
    odds: np.ndarray
    chain: crf.Chain | None = None
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[self.features & 0xFFFF] = True

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """Highest log odds among the features of each token, 0 without any."""
        out = np.zeros(len(hashes))
        if not len(self.features):
            return out
        for k in range(hashes.shape[1]):
            at = np.flatnonzero(self.maybe[hashes[:, k] & 0xFFFF])
            h = hashes[at, k]
            where = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
            hit = self.features[where] == h
            np.maximum.at(out, at[hit], self.odds[where[hit]])
        return out

    def strongest(self, t: Tokens) -> list[list[int]]:
        """The TOP features of each document, by rank in ``odds`` (here: evidence)."""
        v = self.values(t.hashes)
        name = np.zeros(len(v), dtype=np.int64)
        for k in range(t.hashes.shape[1]):
            where = np.minimum(np.searchsorted(self.features, t.hashes[:, k]), len(self.features) - 1)
            hit = (self.features[where] == t.hashes[:, k]) & (self.odds[where] == v)
            name = np.where(hit, t.hashes[:, k], name)
        out = []
        for i, j in zip(t.first[:-1], t.first[1:], strict=True):
            best = sorted({(-a, b) for a, b in zip(v[i:j].tolist(), name[i:j].tolist(), strict=True) if a > 0})
            out.append([b for _, b in best[:TOP]])
        return out

    def marginals(self, values: np.ndarray, begins: np.ndarray) -> np.ndarray:
        node, _ = self.chain.marginals(inputs(values), begins)
        return np.clip(node[:, 1], 1e-9, 1 - 1e-9)

    def evidence(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds that any token of a document is toxic."""
        total = np.concatenate([[0.0], np.cumsum(-np.log1p(-p))])
        none = total[first[1:]] - total[first[:-1]]
        return np.clip(np.log(np.maximum(np.expm1(np.minimum(none, 50)), 1e-12)), -12, 30)

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(p, first) + self.shift, -30, 30)))


def inputs(values: np.ndarray) -> np.ndarray:
    """Features of a token: constant, log odds, whether it is in the lexicon."""
    return np.stack([np.ones(len(values)), values / 4, (values > 0).astype(float)], axis=1)


def _sample(labels: DataFrame, n: int) -> DataFrame:
    """At most n labelled documents per class, chosen by a hash of the id."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    parts = [
        usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def _evidence(bad, every, all_bad, all_every):
    """Evidence against the base rate in nats, by the Kullback-Leibler bound."""
    p, q = bad / every, all_bad / all_every
    part = F.when(bad > 0, bad * F.log(p / q)).otherwise(0.0)
    rest = F.when(bad < every, (every - bad) * F.log((1 - p) / (1 - q))).otherwise(0.0)
    return F.when(p > q, part + rest).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from a bounded sample of ``labels`` (doc_id, toxic)."""
    chosen = _sample(labels, SAMPLE)
    sample = written(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        # Of equal texts the smallest id, so that the sample does not hang on task order.
        .groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", "toxic"),
        "toxicity-sample",
    )
    counts = (
        sample.mapInArrow(_count, "feature long, bad long, every long")
        .groupBy("feature")
        .agg(F.sum("bad").alias("bad"), F.sum("every").alias("every"))
    )
    counts = written(counts.where((F.col("bad") > 0) | (F.col("feature") == 0)), "toxicity-features")
    sizes = counts.where("feature = 0").first()
    if sizes is None or not 0 < sizes["bad"] < sizes["every"]:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0))
    bad, every = F.col("bad"), F.col("every")
    odds = F.log((bad + 0.5) / (sizes["bad"] + 1)) - F.log((every - bad + 0.5) / (sizes["every"] - sizes["bad"] + 1))
    best = (
        counts.where("feature <> 0")
        .withColumn("evidence", _evidence(bad, every, F.lit(sizes["bad"]), F.lit(sizes["every"])))
        .where((F.col("evidence") >= EVIDENCE) & (bad / every >= PRECISION))
        .select("feature", odds.alias("odds"), "evidence")
        .orderBy(F.desc("evidence"), "feature")
        .limit(LEXICON)
        .toPandas()
        .sort_values("feature")
    )
    if not len(best):
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0))
    # Words that only keep company with stronger ones (as in copies of one document) go.
    ranked = Model(best["feature"].to_numpy(np.int64), best["evidence"].to_numpy(float))

    def support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for a, b, data, offsets in slices(batch.column("text")):
                tops = ranked.strongest(Tokens(data, offsets))
                names = [f for fs in tops for f in fs]
                marks = [x for x, fs in zip(toxic[a:b], tops, strict=True) for _ in fs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(marks, pa.int64())], ["feature", "bad"]
                )

    backed = (
        sample.mapInArrow(support, "feature long, bad long")
        .groupBy("feature")
        .agg(F.sum("bad").alias("bad"), F.count("bad").alias("every"))
        .where((F.col("bad") >= SUPPORT) & (F.col("bad") / F.col("every") >= PRECISION))
        .select("feature")
        .toPandas()["feature"]
    )
    best = best[best["feature"].isin(set(backed))]
    model = Model(best["feature"].to_numpy(np.int64), best["odds"].to_numpy(float))
    if not len(best):
        return model

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                t = Tokens(data, offsets)
                v = model.values(t.hashes)
                hit = [np.flatnonzero(v[i:j] > 0) for i, j in zip(t.first[:-1], t.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("toxic").slice(a, b - a),
                        pa.array(t.counts.astype(np.int64)),
                        pa.array([x.tolist() for x in hit], pa.list_(pa.int64())),
                        pa.array([v[i:j][x].tolist() for i, j, x in zip(t.first, t.first[1:], hit, strict=False)], pa.list_(pa.float64())),
                    ],
                    ["toxic", "n", "at", "value"],
                )

    few = sample.join(F.broadcast(_sample(labels, CHAIN_SAMPLE)), ["doc_id", "toxic"], "left_semi").orderBy("doc_id")
    rows = few.mapInArrow(values, "toxic int, n long, at array<long>, value array<double>").collect()
    rows, left = [r for r in rows if r["n"]], CHAIN_TOKENS
    rows = [r for r in rows if r["n"] <= left and (left := left - r["n"]) >= 0]
    v = np.zeros(sum(r["n"] for r in rows))
    y = np.zeros(len(v), dtype=np.int64)
    first = np.concatenate([[0], np.cumsum([r["n"] for r in rows])])
    for r, i in zip(rows, first, strict=False):
        v[i + np.array(r["at"], dtype=np.int64)] = r["value"]
        y[i + np.array(r["at"], dtype=np.int64)] = r["toxic"]
    begins = np.zeros(len(v), dtype=bool)
    begins[first[:-1]] = True
    model.chain = crf.fit(inputs(v), y, begins, rounds=80, rate=0.2)
    truth = np.array([r["toxic"] for r in rows], dtype=float)
    model.slope, model.shift = crf.logistic(model.evidence(model.marginals(v, begins), first), truth)
    return model


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, n_tokens, spans) for every row of ``docs``.

    ``spans`` are offending stretches in code points, with their probability.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                t = Tokens(data, offsets)
                if model.chain is None:
                    score, spans = np.zeros(b - a), [[]] * (b - a)
                else:
                    p = model.marginals(model.values(t.hashes), t.begins())
                    score, spans = model.score(p, t.first), [[] for _ in range(b - a)]
                    hits = np.flatnonzero(p >= 0.5)
                    doc = np.searchsorted(t.first, hits, side="right") - 1
                    last = None
                    for h, d in zip(hits.tolist(), doc.tolist(), strict=True):
                        s, e = int(t.starts[h] - t.offsets[d]), int(t.ends[h] - t.offsets[d])
                        if last == (h - 1, d):
                            spans[d][-1]["end"] = e
                            spans[d][-1]["p"] = max(spans[d][-1]["p"], float(p[h]))
                        else:
                            spans[d].append({"start": s, "end": e, "p": float(p[h])})
                        last = (h, d)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(score),
                        pa.array((score >= 0.5).astype(np.int32)),
                        pa.array(t.counts.astype(np.int64)),
                        pa.array(spans, kind),
                    ],
                    ["doc_id", "score", "predicted", "n_tokens", "spans"],
                )

    given = docs.select(F.col("doc_id").cast("long"), "text")
    return given.mapInArrow(
        run, "doc_id long, score double, predicted int, n_tokens long, spans array<struct<start:long,end:long,p:double>>"
    )


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all columns."""
    if model.chain is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                t = Tokens(data, offsets)
                p = model.marginals(model.values(t.hashes), t.begins())
                yield batch.slice(a, b - a).filter(pa.array(model.score(p, t.first) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def fold() -> Column:
    """Whether a document is held out of all learning."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents that are not held out, tag all."""
    model = fit(docs, labels.where(~fold()))
    return tag(docs, model).withColumn("held_out", fold())
