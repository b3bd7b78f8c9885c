"""Quality rules by line sequence labelling.

Each line of a document gets features; Viterbi decoding of a linear-chain
conditional random field marks it as content or boilerplate, and the share of
words in content lines decides whether the document stays. Line labels for
training start from document labels (all lines of a poor document are
boilerplate) and are decoded again once, so that clean lines of poor documents
count as content.

Null texts count as empty. A document without words fails the base rules. With
no labelled document of both classes every line is content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import crf
from newsloom.llm.arrays import Words, covered, slices, spans_coded, window_names

# Bound of the training sample, in labelled documents per class; only documents of
# at most so many lines are trained on.
SAMPLE, SAMPLE_LINES = 1_500, 2_000
# Share of words in content lines from which a document stays.
CONTENT = 0.5
WINDOW = 5
FEATURES = 8

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[list(range(65, 91))] = True
_LETTER = _UPPER.copy()
_LETTER[list(range(97, 123))] = True
_LETTER[list(range(0xC3, 0xE0))] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?=~^_{}[]\\/")] = True


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[ends] - total[starts]


class Lines:
    """Lines with a word of the documents of a slice, their features and counts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets)
        n = len(offsets) - 1
        self.n_words = w.counts
        lead = (data & 0xC0) != 0x80
        chars = _sums(lead, w.starts, w.ends)
        self.word_chars = np.bincount(w.doc, weights=chars, minlength=n).astype(np.int64)
        self.n_symbols = _sums(_SYMBOL[data], offsets[:-1], offsets[1:])
        repeated = self._repeats(w)
        self.n_repeat_words = np.bincount(w.doc[repeated], minlength=n)
        # Line of each word: newlines before it, counted anew in each document.
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, w.starts) + w.doc
        head = np.flatnonzero(np.diff(line, prepend=-1) != 0)
        size = np.diff(np.append(head, len(line)))
        doc = w.doc[head]
        begin = np.maximum(offsets[doc], np.append(breaks, 0)[np.searchsorted(breaks, w.starts[head]) - 1] + 1)
        begin = np.where(np.searchsorted(breaks, w.starts[head]) > 0, begin, offsets[doc])
        end = np.minimum(offsets[doc + 1], np.append(breaks, len(data))[np.searchsorted(breaks, w.starts[head])])
        dup = self._earlier(spans_coded(data, begin, end).indices.to_numpy(), doc)
        self.n_dup_lines = np.bincount(doc[dup], minlength=n)
        self.doc, self.words = doc, size
        self.counts = np.bincount(doc, minlength=n)
        area = np.maximum(_sums(lead, begin, end), 1)
        letters = np.maximum(_sums(_LETTER[data], begin, end), 1)
        self.x = np.stack(
            [
                np.ones(len(head)),
                np.minimum(4 * _sums(_SYMBOL[data], begin, end) / size, 4),
                4 * _sums(_UPPER[data], begin, end) / letters,
                np.minimum(4 * _sums(_MARK[data], begin, end) / size, 4),
                4 * np.add.reduceat(repeated, head) / size if len(head) else np.zeros(0),
                2.0 * dup,
                np.log1p(size) / 3,
                np.minimum(area / size, 30) / 10,
            ],
            axis=1,
        ) if len(head) else np.zeros((0, FEATURES))

    @staticmethod
    def _repeats(w: Words) -> np.ndarray:
        """Words that lie in a window found more than once in their document."""
        inside = w.inside(WINDOW)
        if not inside.any():
            return np.zeros(len(w.starts), dtype=bool)
        at = np.flatnonzero(inside)
        key = window_names(w.ids(), WINDOW)[at]
        order = np.lexsort((key, w.doc[at]))
        k, d = key[order], w.doc[at][order]
        same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        return covered(len(w.starts), at[twice], at[twice] + WINDOW)

    @staticmethod
    def _earlier(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Lines equal to an earlier one of their document."""
        order = np.lexsort((np.arange(len(key)), key, doc))
        k, d = key[order], doc[order]
        out = np.zeros(len(key), dtype=bool)
        out[order[1:][(k[1:] == k[:-1]) & (d[1:] == d[:-1])]] = True
        return out


def fit(docs: DataFrame, labels: DataFrame) -> crf.Chain | None:
    """Learn from a bounded sample of ``labels`` (doc_id, quality)."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
    parts = [usable.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                lines = Lines(data, offsets)
                ends = np.cumsum(lines.counts)
                short = lines.counts <= SAMPLE_LINES
                x = [lines.x[e - c : e].tobytes() if s else b"" for c, e, s in zip(lines.counts, ends, short, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("quality").slice(a, b - a),
                        pa.array(x, pa.binary()),
                    ],
                    ["doc_id", "quality", "x"],
                )

    given = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int"))
    rows = given.mapInArrow(run, "doc_id long, quality int, x binary").collect()
    rows = sorted((r for r in rows if r["x"]), key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    if len({r["quality"] for r in rows}) < 2:
        return None
    held = [np.frombuffer(r["x"]).reshape(-1, FEATURES) for r in rows]
    x, counts = np.concatenate(held), np.array([len(h) for h in held])
    poor = np.repeat([1 - r["quality"] for r in rows], counts).astype(bool)
    first = np.zeros(len(x), dtype=bool)
    first[np.concatenate([[0], np.cumsum(counts)[:-1]])] = True
    y = poor.astype(np.int64)
    for _ in range(2):
        chain = crf.fit(x, y, first, rounds=100)
        y = np.where(poor, chain.best(x, counts), 0).astype(np.int64)
    return crf.fit(x, y, first, rounds=150)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, base rules, content share, verdict."""
    chain = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                lines = Lines(data, offsets)
                bad = chain.best(lines.x, lines.counts) if chain is not None else np.zeros(len(lines.doc), dtype=np.int8)
                content = np.bincount(lines.doc, weights=lines.words * (bad == 0), minlength=b - a)
                n = lines.n_words
                share = np.where(n > 0, content / np.maximum(n, 1), 0.0)
                failed = (n < 10) | (100 * lines.n_repeat_words > 20 * n)
                longs = (n, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words)
                columns = [batch.column("doc_id").slice(a, b - a), *(pa.array(v.astype(np.int64)) for v in longs)]
                columns += [pa.array(failed), pa.array(share), pa.array(~failed & (share >= CONTENT))]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names += ["base_failed", "content_share", "kept"]
    schema = ", ".join(f"{c} long" for c in names[:6]) + ", base_failed boolean, content_share double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
