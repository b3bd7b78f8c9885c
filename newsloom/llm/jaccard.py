"""Near-duplicate join on word shingles by chosen paths.

Documents are sets of 5-word shingles. A set is embedded as minhash tokens, and
each run splits the sets on sampled tokens: sets that share the run's first
``FIRST`` tokens form a bucket, and a bucket that is too large is split again on
two further tokens. Those are minhashes of functions seeded by the bucket's path,
so no two splits share a token and their misses are independent. Buckets that are
small enough are compared by brute force on the full shingle sets, so every
reported link is exact. Runs repeat until a pair at the threshold is missed with
a probability below ``1 - RECALL``, even if all its buckets are split ``DEPTH``
times.

Equal sets are joined first and count as one with a weight. A pair that meets in
several buckets is counted in the lowest of them, which both sides know from
their lists of buckets; so no pair is ever emitted, and a bucket whose members
all meet in a lower one is dropped unseen. Tasks return a row per set with the
weight of its links and one member of its component; components are then joined
by label propagation over those rows.

A document with one to four words has one shingle, all its words. A document
without words (null or empty text included) links to nothing and is a class of
its own. Repeated rows are copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrays import Words, folded, keyed, mix, on_row, slices
from newsloom.llm.store import written

SHINGLE = 5
# Jaccard threshold as a fraction, compared in whole numbers.
SIMILAR = (4, 5)
FIRST = 2
RECALL = 0.99999
# Sets of a bucket beyond which it is split, split how often at most, and on how many tokens.
BUCKET, DEPTH, WAYS = 16_384, 4, 2


def meeting(depth: int) -> float:
    """Probability that a pair at the threshold shares a bucket of a run after ``depth`` splits."""
    same = SIMILAR[0] / SIMILAR[1]
    stay = 1.0
    for _ in range(depth):
        stay = 1 - (1 - same * stay) ** WAYS
    return same**FIRST * stay


RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - meeting(DEPTH)))
TOKENS = RUNS * FIRST
# Sets that are compared with as many others at once.
TILE = 512

_SEEDS = mix(np.arange(1, 2 * TOKENS + 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class ShingleSets:
    """Distinct shingles of the documents of a slice, in order within each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets)
        n = len(offsets) - 1
        inside = w.inside(SHINGLE)
        at = np.flatnonzero(inside)
        lanes = w.lanes()
        docs, keys = [w.doc[at]], [[folded(v, SHINGLE)[at]] for v in lanes]
        # A text of fewer words is one shingle.
        for k in range(1, SHINGLE):
            short = np.flatnonzero(w.counts == k)
            if len(short):
                docs.append(short)
                for held, v in zip(keys, lanes, strict=True):
                    held.append(folded(v, k)[w.first[short]])
        doc = np.concatenate(docs)
        key, second = (np.concatenate(held) for held in keys)
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        fresh = np.ones(len(doc), dtype=bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        self.doc, self.key, self.second = doc[fresh], key[fresh], second[order][fresh]
        self.counts = np.bincount(self.doc, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.full = np.flatnonzero(self.counts)

    def names(self) -> np.ndarray:
        """128-bit name of each set (rows of zeros for empty ones)."""
        out = np.zeros((len(self.counts), 2), dtype=np.uint64)
        if len(self.full):
            for i, key in enumerate((self.key, self.second)):
                out[self.full, i] = np.add.reduceat(mix(key ^ _SEEDS[-1 - i]), self.first[self.full])
        return out

    def tokens(self) -> np.ndarray:
        """Minhash tokens, documents x TOKENS."""
        out = np.zeros((len(self.counts), TOKENS), dtype=np.uint32)
        if len(self.full):
            starts = self.first[self.full]
            for k in range(TOKENS):
                h = ((self.key ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | np.uint64(1))) >> np.uint64(32)
                out[self.full, k] = np.minimum.reduceat(h, starts)
        return out


def _bytes_of(values: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as byte strings."""
    raw = np.ascontiguousarray(values)
    width = raw.shape[1] * raw.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text")):
            sets = ShingleSets(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    batch.column("_row").slice(a, b - a),
                    _bytes_of(sets.names()),
                    pa.array(sets.counts.astype(np.int32)),
                    _bytes_of(sets.tokens()),
                ],
                ["doc_id", "_row", "name", "n", "tokens"],
            )


def _fold(path: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(path ^ mix(token.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))


def _table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First path of every set in every run."""
    for batch in batches:
        t = _table(batch.column("tokens"))
        paths = np.empty((len(t), RUNS), dtype=np.uint64)
        for r in range(RUNS):
            p = np.full(len(t), np.uint64(r + 1))
            for k in range(FIRST):
                p = _fold(p, t[:, r * FIRST + k])
            paths[:, r] = p
        rows = np.repeat(np.arange(len(t)), RUNS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths.ravel().astype(np.int64)), batch.column("name").take(pa.array(rows))], ["path", "name"]
        )


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of a set that go on by tokens of their own."""
    ways = np.arange(1, WAYS + 1, dtype=np.uint64)
    for batch in batches:
        names, paths = batch.column("name"), batch.column("paths").to_pylist()
        for a, b, data, offsets in slices(batch.column("text")):
            sets = ShingleSets(data, offsets)
            new = []
            for i in range(b - a):
                keys = sets.key[sets.first[i] : sets.first[i + 1]]
                path = np.array(paths[a + i], dtype=np.int64).astype(np.uint64)
                seeds = mix(path[:, None] ^ mix(ways)).ravel()
                tokens = np.array([mix(keys ^ seed).min() >> np.uint64(32) for seed in seeds], dtype=np.uint64)
                new.append(_fold((path[:, None] + ways).ravel(), tokens).astype(np.int64))
            rows = np.repeat(np.arange(a, b), [len(x) for x in new])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(new)), names.take(pa.array(rows))], ["path", "name"]
            )


def buckets(sets: DataFrame, rows: DataFrame, limit: int = BUCKET) -> DataFrame:
    """(path, name, size): members of every bucket of two sets or more.

    ``rows`` are the documents, read again for the sets of crowded buckets.
    """
    paths = sets.select("tokens", "name").mapInArrow(_start, "path long, name binary")
    out = None
    for depth in range(DEPTH + 1):
        sizes = written(paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "jaccard-sizes")
        small = sizes if depth == DEPTH else sizes.where(F.col("size") <= limit)
        part = paths.join(small, "path")
        out = part if out is None else out.unionByName(part)
        large = sizes.where(F.col("size") > limit)
        if depth == DEPTH or large.isEmpty():
            break
        crowded = paths.join(large, "path", "left_semi").groupBy("name").agg(F.collect_list("path").alias("paths"))
        crowded = crowded.join(sets.select("name", "sample"), "name").select("sample.doc_id", "sample._row", "name", "paths")
        texts = on_row(rows, crowded, "inner").select("text", "name", "paths")
        paths = written(texts.mapInArrow(_split, "path long, name binary").distinct(), "jaccard-paths")
    return written(out.select("path", "name", "size"), "jaccard-buckets")


def useful(members: DataFrame) -> DataFrame:
    """(name, paths, leaves): all buckets of a set, and those that it must visit.

    A bucket whose members all meet in one lower bucket has nothing to add.
    """
    lists = members.groupBy("name").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    pairs = lists.select(F.explode("paths").alias("path"), "paths").select(
        "path", F.explode(F.filter("paths", lambda q: q < F.col("path"))).alias("lower")
    )
    sizes = members.select("path", "size").distinct()
    covered = (
        pairs.groupBy("path", "lower")
        .agg(F.count(F.lit(1)).alias("both"))
        .join(sizes, "path")
        .where("both = size")
        .select("path")
        .distinct()
    )
    leaves = members.join(covered, "path", "left_anti").groupBy("name").agg(
        F.collect_list(F.struct("path", "size")).alias("leaves")
    )
    return lists.join(leaves, "name")


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Send each set to the tiles of its buckets, with all its shingles."""
    for batch in batches:
        want, weight = batch.column("name").to_pylist(), batch.column("weight").to_pylist()
        paths, leaves = batch.column("paths").to_pylist(), batch.column("leaves").to_pylist()
        for a, _, data, offsets in slices(batch.column("text")):
            sets = ShingleSets(data, offsets)
            names = sets.names()
            rows = []
            for i in range(len(names)):
                name = names[i].tobytes()
                if name != want[a + i]:
                    raise ValueError("a document changed between two readings")
                shingles = sets.key[sets.first[i] : sets.first[i + 1]].tobytes()
                for leaf in leaves[a + i]:
                    tiles = -(-leaf["size"] // TILE)
                    own = int(names[i, 0] % np.uint64(tiles))
                    for other in range(tiles):
                        rows.append((leaf["path"], min(own, other), max(own, other), own, name, weight[a + i], paths[a + i], shingles))
                if len(rows) > 500:
                    yield _visit_batch(rows)
                    rows = []
            yield _visit_batch(rows)


_VISIT = "path long, a int, b int, own int, name binary, weight long, paths array<long>, shingles binary"


def _visit_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    names = ["path", "a", "b", "own", "name", "weight", "paths", "shingles"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def common(lists: list[np.ndarray]) -> np.ndarray:
    """Number of shared values for every pair of lists of distinct values."""
    m = len(lists)
    if m == 2:
        shared = len(np.intersect1d(lists[0], lists[1], assume_unique=True))
        return np.array([[len(lists[0]), shared], [shared, len(lists[1])]])
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(m), [len(x) for x in lists])
    _, value, count = np.unique(flat, return_inverse=True, return_counts=True)
    # Values of one list only add nothing to a pair.
    rank = np.cumsum(count > 1) - 1
    kept = count[value] > 1
    column, owner = rank[value[kept]], owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((m, m), dtype=np.float64)
    width = 4_096
    for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        i, j = np.searchsorted(column, [low, low + width])
        part = np.zeros((m, width), dtype=np.float32)
        part[owner[i:j], column[i:j] - low] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def components(linked: np.ndarray) -> np.ndarray:
    """Lowest member of the component of each node of a symmetric relation."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(path: int, rows: list[tuple]) -> list[tuple[bytes, int, bytes]]:
    """(name, weight of links, member of the component) for the linked sets of a tile pair."""
    held = {r[1]: r for r in rows}
    rows = [held[k] for k in sorted(held)]
    if len(rows) < 2:
        return []
    own = np.array([r[0] for r in rows])
    weight = np.array([r[2] for r in rows])
    sets = [np.frombuffer(r[4], dtype=np.uint64) for r in rows]
    size = np.array([len(s) for s in sets])
    both = common(sets)
    top, bottom = SIMILAR
    linked = bottom * both >= top * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, False)
    if not linked.any():
        return []
    # Two tiles meet across; inside one tile every pair meets.
    if own.min() != own.max():
        linked &= own[:, None] != own[None, :]
    lower = [np.array([p for p in r[3] if p < path], dtype=np.int64) for r in rows]
    if any(map(len, lower)):
        linked &= common(lower) == 0
    label = components(linked)
    links = linked @ weight
    return [(rows[i][1], int(links[i]), rows[label[i]][1]) for i in np.flatnonzero(linked.any(axis=1))]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, group, out = None, [], []

    def flush() -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.binary()]
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["name", "links", "other"])
        out.clear()
        return batch

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("path", "a", "b", "own", "name", "weight", "paths", "shingles"))
        for path, a, b, *row in zip(*columns, strict=True):
            if (path, a, b) != now and group:
                out += compare(now[0], group)
                group = []
            now = (path, a, b)
            group.append(tuple(row))
        if len(out) > 10_000:
            yield flush()
    if group:
        out += compare(now[0], group)
    yield flush()


def connected(edges: DataFrame) -> DataFrame:
    """(name, label): the lowest name of each component of (name, other).

    Labels spread along edges and are then followed once, so the number of
    rounds grows with the logarithm of the longest chain.
    """
    both = edges.where("name <> other")
    both = written(both.unionByName(both.select(F.col("other").alias("name"), F.col("name").alias("other"))).distinct(), "jaccard-edges")
    labels = written(both.groupBy("name").agg(F.least(F.first("name"), F.min("other")).alias("label")), "jaccard-labels")
    while True:
        near = (
            both.join(labels.select(F.col("name").alias("other"), "label"), "other").groupBy("name").agg(F.min("label").alias("near"))
        )
        met = labels.join(near, "name").select("name", "label", F.least("label", "near").alias("new"))
        step = met.join(labels.select(F.col("name").alias("new"), F.col("label").alias("after")), "new")
        step = written(step.select("name", "label", F.least("new", "after").alias("new")), "jaccard-labels")
        changed = not step.where("new <> label").isEmpty()
        labels = step.select("name", F.col("new").alias("label"))
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, limit: int = BUCKET) -> DataFrame:
    """(doc_id, _row, class_id, n_links, leads) for every row of ``docs``.

    ``class_id`` is the smallest id of the documents that links connect, and
    ``n_links`` the number of rows with a similarity at the threshold or above.
    ``leads`` marks the row that stands for its class (and rows equal to it), the
    one with the smallest id. ``_row`` is the key of ``arrays.keyed``.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long"), "text"))
    features = written(
        rows.mapInArrow(_features, "doc_id long, _row long, name binary, n int, tokens binary"), "jaccard-features"
    )
    sets = written(
        features.where("n > 0")
        .groupBy("name")
        .agg(
            F.count(F.lit(1)).alias("weight"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("sample"),
            F.any_value("tokens").alias("tokens"),
        ),
        "jaccard-sets",
    )
    asked = useful(buckets(sets, rows, limit)).join(sets.select("name", "weight", "sample"), "name")
    asked = written(asked.select(F.col("sample.doc_id"), F.col("sample._row"), "name", "weight", "paths", "leaves"), "jaccard-asked")
    # One row of each sampled document; rows that repeat it are dropped in the tile.
    texts = on_row(rows, asked, "inner").select("text", "name", "weight", "paths", "leaves")
    found = written(
        texts.mapInArrow(_visits, _VISIT)
        .repartition("path", "a", "b")
        .sortWithinPartitions("path", "a", "b")
        .mapInArrow(_compare, "name binary, links long, other binary"),
        "jaccard-links",
    )
    links = found.groupBy("name").agg(F.sum("links").alias("links"))
    labels = connected(found.select("name", "other").distinct())
    classes = sets.select("name", "weight", "sample").join(links, "name", "left").join(labels, "name", "left")
    classes = written(classes.withColumn("label", F.coalesce("label", "name")), "jaccard-classes")
    lowest = classes.groupBy("label").agg(F.min("sample").alias("first"))
    told = classes.join(lowest, "label").select(
        "name", "first", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    full = features.where("n > 0").select("doc_id", "_row", "name").join(told, "name")
    leads = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_row") == F.col("first._row"))
    full = full.select("doc_id", "_row", F.col("first.doc_id").alias("class_id"), "n_links", leads.alias("leads"))
    empty = features.where("n = 0").select(
        "doc_id", "_row", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("leads")
    )
    return full.unionByName(empty)
