"""Phrase collocations through an FM-index per shard over word ids.

Texts are cut into pieces and words; a shard holds some of a task's texts of one
language, as the Burrows-Wheeler transform of their word ids with a mark between
pieces. Rows are ordered by their next ``DEPTH`` words, which is as deep as phrases
go. All phrases of a length are disjoint intervals of rows. The last-to-first
mapping extends every interval to the left by each word that precedes it; since
rows are sorted, the same rows also tell the interval that the new phrase extends
to the right. So each phrase comes with its count and with both phrases that are
one word shorter.

A phrase is frequent only if all its parts are. First the shards' words and word
pairs are summed across shards by 64-bit keys, one row per shard and key, and each
shard gets back its frequent keys; two phrases with one key only make a superset.
Then the shards spell out words, pairs, and those longer phrases all of whose pairs
are frequent, and their counts are summed by text, so results are exact. Cuts,
scores and containment are joins of the frequent phrases with themselves.

Null texts count as empty, a null language as ``und``. Repeated rows count again.
Only the columns for text and language are read. An empty table has no phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.arrays import mix, slices
from newsloom.llm.store import written

DEPTH = 4
LEAST, TOP, SCALE, COVER = 30, 2_000, 2_000_000, 80
# Words of a shard, or of one text if that is longer.
SHARD_WORDS = 2_000_000
SLICE_BYTES = 8 << 20
OUT_ROWS = 1 << 16

# Bytes that end a piece, and bytes between words.
_CUT = np.zeros(256, dtype=bool)
_CUT[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_GAP = _CUT.copy()
_GAP[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words in order, whether a word starts a piece, document of each word)."""
    data = _LOWER[data]
    n = len(data)
    solid = ~_GAP[data]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | border[1:n]
    ends[:-1] &= ~solid[1:] | border[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    cuts = np.concatenate([[0], np.cumsum(_CUT[data])])[starts] if len(starts) else starts
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (cuts[1:] != cuts[:-1]) | (doc[1:] != doc[:-1])
    place = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    buffers = [None, pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(data[solid]))]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers), fresh, doc


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks from 0."""
    order = np.argsort(key, kind="stable")
    fresh = np.diff(key[order], prepend=key[order[:1]] - 1) != 0
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.cumsum(fresh) - 1
    return out


def transform(ids: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform, rows ordered by the next DEPTH symbols.

    ``ids`` has a 0 before every piece and at the end. Ties keep text order.
    """
    rank, reach = _ranks(ids.astype(np.int64)), 1
    while reach < DEPTH:
        after = np.concatenate([rank[reach:], np.zeros(min(reach, len(rank)), dtype=np.int64)])
        rank, reach = _ranks((rank << 32) | after[: len(rank)]), reach * 2
    return ids[np.argsort(rank, kind="stable") - 1]


class Level:
    """Phrases of one length: intervals of rows, and what they extend."""

    def __init__(self, length: int, low: np.ndarray, high: np.ndarray, word: np.ndarray, tail: np.ndarray, head: np.ndarray):
        self.length, self.low, self.high = length, low, high
        # First word; phrases of the level before without the first or the last word.
        self.word, self.tail, self.head = word, tail, head

    @property
    def counts(self) -> np.ndarray:
        return self.high - self.low

    def kept(self, chosen: np.ndarray) -> Level:
        return Level(self.length, *(a[chosen] for a in (self.low, self.high, self.word, self.tail, self.head)))


class FmIndex:
    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        # Rows by the word before them: the last-to-first mapping, inverted.
        self.rows = np.argsort(bwt, kind="stable")

    def words(self) -> Level:
        """Single words; a row starts with the word that its place in ``rows`` has."""
        first = self.bwt[self.rows]
        low = np.flatnonzero(np.diff(first, prepend=-1))
        high = np.append(low[1:], len(first))
        some = first[low] > 0
        none = np.zeros(int(some.sum()), dtype=np.int64)
        return Level(1, low[some], high[some], first[low][some].astype(np.int64), none, none)

    def labels(self, level: Level) -> np.ndarray:
        """Phrase of each row, or -1."""
        out = np.full(len(self.bwt), -1, dtype=np.int64)
        inside = np.repeat(level.low - np.concatenate([[0], np.cumsum(level.counts)[:-1]]), level.counts) + np.arange(level.counts.sum())
        out[inside] = np.repeat(np.arange(len(level.low)), level.counts)
        return out

    def extend(self, level: Level) -> Level:
        """Every phrase of the level with every word before it."""
        label = self.labels(level)
        before, tail = self.bwt[self.rows], label[self.rows]
        edge = np.ones(len(before), dtype=bool)
        edge[1:] = (before[1:] != before[:-1]) | (tail[1:] != tail[:-1])
        low = np.flatnonzero(edge)
        high = np.append(low[1:], len(before))
        some = (before[low] > 0) & (tail[low] >= 0)
        low, high = low[some], high[some]
        return Level(level.length + 1, low, high, before[low].astype(np.int64), tail[low], label[low])


def _word_keys(words: list[bytes], lang: str) -> np.ndarray:
    seed = hashlib.blake2b(lang.encode(), digest_size=16).digest()
    raw = b"".join(hashlib.blake2b(w, digest_size=8, key=seed).digest() for w in words)
    return np.frombuffer(raw, dtype=np.uint64)


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) * np.uint64(0x9E3779B97F4A7C15) + second)


_SHARD = "shard long, lang string, n long, words binary, bwt binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a task's texts: distinct words and the transform of their ids."""
    number = TaskContext.get().partitionId() << 32
    # Per language: distinct words, and id sequences of the parts read so far.
    known: dict[str, dict[bytes, int]] = {}
    parts: dict[str, list[np.ndarray]] = {}

    def close(lang: str) -> pa.RecordBatch:
        nonlocal number
        words = sorted(known[lang])
        ids = np.concatenate([*parts.pop(lang), np.zeros(1, dtype=np.int64)])
        rank = np.zeros(len(words) + 1, dtype=np.int32)
        seen = known.pop(lang)
        rank[[seen[w] for w in words]] = np.arange(1, len(words) + 1)
        ids = rank[ids]
        row = [number, lang, int((ids > 0).sum()), b" ".join(words), transform(ids).tobytes()]
        number += 1
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["shard", "lang", "n", "words", "bwt"])

    held = 0
    for batch in batches:
        langs = np.array([v if v is not None else "und" for v in batch.column("lang").to_pylist()], dtype=object)
        for a, b, data, offsets in slices(batch.column("text"), SLICE_BYTES):
            words, fresh, doc = words_of(data, offsets)
            coded = words.dictionary_encode()
            codes, listed = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
            own = langs[a:b]
            for lang in dict.fromkeys(own.tolist()):
                at = np.flatnonzero((own == lang)[doc]) if len(doc) else doc
                if not len(at):
                    continue
                seen = known.setdefault(lang, {})
                place = np.zeros(len(listed), dtype=np.int64)
                for c in np.unique(codes[at]).tolist():
                    place[c] = seen.setdefault(listed[c], len(seen) + 1)
                # A 0 stands before the first word of each piece.
                mine = place[codes[at]]
                parts.setdefault(lang, []).append(np.insert(mine, np.flatnonzero(fresh[at]), 0))
                held += len(at)
            if held >= SHARD_WORDS:
                for lang in list(parts):
                    yield close(lang)
                held = 0
    for lang in list(parts):
        yield close(lang)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes], FmIndex]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            words = row["words"].as_py().split(b" ")
            yield row, words, FmIndex(np.frombuffer(row["bwt"].as_buffer(), dtype=np.int32))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, shard, n) of a shard's words and word pairs."""
    for row, words, index in _shards(batches):
        one = index.words()
        two = index.extend(one)
        names = _word_keys(words, row["lang"].as_py())[one.word - 1]
        keys = np.concatenate([names, _pair_keys(names[two.head], names[two.tail])]).view(np.int64)
        counts = np.concatenate([one.counts, two.counts])
        for a in range(0, len(keys), OUT_ROWS):
            some = keys[a : a + OUT_ROWS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(np.full(len(some), row["shard"].as_py())), pa.array(counts[a : a + OUT_ROWS])], ["key", "shard", "n"]
            )


def _spelled(words: np.ndarray, firsts: list[np.ndarray]) -> pa.Array:
    texts = [pa.array(words[f], pa.string()) for f in firsts]
    return pc.binary_join_element_wise(*texts, " ") if len(texts) > 1 else texts[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, length, n) of a shard's phrases all of whose pairs are frequent."""
    for row, listed, index in _shards(batches):
        lang = row["lang"].as_py()
        frequent = row["keys"].values.to_numpy()
        one = index.words()
        names = _word_keys(listed, lang)[one.word - 1]
        words = np.array([w.decode() for w in listed], dtype=object)
        level, spelled = one, [one.word - 1]
        for length in range(1, DEPTH + 1):
            at = np.flatnonzero(np.isin(names.view(np.int64), frequent)) if length == 1 else np.arange(len(level.low))
            for a in range(0, len(at), OUT_ROWS):
                some = at[a : a + OUT_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(some), pa.string()),
                        _spelled(words, [s[some] for s in spelled]),
                        pa.array(np.full(len(some), length, dtype=np.int32)),
                        pa.array(level.counts[some]),
                    ],
                    ["lang", "phrase", "length", "n"],
                )
            if length == DEPTH:
                break
            longer = index.extend(level)
            if length == 1:
                chosen = np.isin(_pair_keys(names[longer.head], names[longer.tail]).view(np.int64), frequent)
            else:
                # The phrase without the first word was kept, as it is extended here.
                chosen = longer.head >= 0
            level = longer.kept(chosen)
            spelled = [level.word - 1, *(s[level.tail] for s in spelled)]


def shards_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per shard: language, words in all, distinct words, transform."""
    texts = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return written(texts.mapInArrow(_index, _SHARD), "phrase-shards")


def frequent_phrases(shards: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, length, f) of all phrases that occur ``least`` times."""
    keys = shards.select("shard", "lang", "words", "bwt").mapInArrow(_keys, "key long, shard long, n long")
    total = F.sum("n").over(Window.partitionBy("key"))
    # A key has one row per shard.
    back = keys.withColumn("f", total).where(F.col("f") >= least).groupBy("shard").agg(F.collect_list("key").alias("keys"))
    given = shards.select("shard", "lang", "words", "bwt").join(back, "shard")
    found = given.mapInArrow(_counted, "lang string, phrase string, length int, n long")
    found = found.groupBy("lang", "phrase", "length").agg(F.sum("n").alias("f"))
    return written(found.where(F.col("f") >= least), "phrases")


def _part(first: str, length: str) -> Column:
    return F.expr(f"array_join(slice(words, {first}, {length}), ' ')")


def scored(phrases: DataFrame, cover: int = COVER, scale: int = SCALE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of candidates that no longer one covers."""
    known = phrases.select("lang", "phrase", "length", "f")
    longer = known.where("length > 1").withColumn("words", F.split("phrase", " "))
    cuts = longer.withColumn("k", F.explode(F.expr("sequence(1, length - 1)")))
    cuts = cuts.select(
        "lang", "phrase", F.col("f").alias("a"), "k", _part("1", "k").alias("left"), _part("k + 1", "length - k").alias("right")
    )
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = "cast(a as decimal(20, 0))"
    cuts = cuts.withColumn("score", F.expr(f"({wide} * {scale}BD) div (cast(l as decimal(20, 0)) + r)"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = cuts.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = longer.where("length > 2").withColumn("size", F.explode(F.expr("sequence(2, length - 1)")))
    inner = inner.withColumn("at", F.explode(F.expr("sequence(1, length - size + 1)")))
    inner = inner.groupBy("lang", _part("at", "size").alias("phrase")).agg(F.max("f").alias("outer"))
    covered = F.expr(f"100BD * cast(outer as decimal(20, 0)) >= {cover}BD * {wide}")
    return best.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).drop("outer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` of each language."""
    shards = shards_of(docs)
    sizes = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(frequent_phrases(shards, least)).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
