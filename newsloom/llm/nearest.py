"""Exact top-k inner products by pivot-table elimination.

Vectors become integers, floor(256 x). Every vector carries its distances to many
pivots, the origin among them. By the triangle inequality each pivot bounds the
distance of a query and a candidate from below; the largest bound limits their
inner product from above. Candidates are evaluated in the order of that limit until
no later one can enter the top k, ties included, so results are exact whatever the
pivots are.

Rows are dealt to cells by their nearest pivot, and cells to blocks of bounded
size. A query first meets one block of its own cell, which gives it a k-th score.
With it, whole cells are eliminated by the ranges of their distances to the
pivots; queries travel, packed, to the blocks of the cells that are left. Blocks
report only rows that reach the k-th score.

Arithmetic is exact: in float64 or int64 where no score can leave them, else in
Python integers; a score in the result that a long can't hold is an error. Bounds
are rounded, and widened by more than their error.

Vectors that are null or hold a null or non-finite component take no part, nor
do rows without id. Shorter vectors count as padded with zeros. Candidates of a
query are the rows of other ids; equal query rows are one query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.store import lowest_hashes, written
from newsloom.llm.vectors import finite, floors, matrix

SCALE = 256
PIVOTS = 32
# Vectors that the pivots are chosen from (lowest hashes).
SAMPLE = 1_024
QUERY_ROWS, ROWS = 512, 8_192
# Share by which a bound on an inner product is widened; float64 errs by far less.
SLACK = 1e-9


def pivots_of(vectors: DataFrame, width: int, count: int) -> np.ndarray:
    """Far-apart vectors of a bounded sample, the origin first."""
    rows = lowest_hashes(vectors, count, SAMPLE)
    sample = matrix(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), width) * SCALE
    chosen = [np.zeros(width)]
    near = np.sqrt(((sample - chosen[0]) ** 2).sum(axis=1)) if len(rows) else np.zeros(1)
    while len(chosen) <= PIVOTS and near.max() > 0:
        chosen.append(sample[int(near.argmax())])
        near = np.minimum(near, np.sqrt(((sample - chosen[-1]) ** 2).sum(axis=1)))
    return np.stack(chosen)


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots, rows x pivots; each difference is squared, so none cancels."""
    out = np.empty((len(vectors), len(pivots)))
    for i, p in enumerate(pivots):
        gap = vectors - p
        most = max(float(np.abs(gap).max(initial=0)), 1.0)
        out[:, i] = np.sqrt(((gap / most) ** 2).sum(axis=1)) * most
    return out


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def packed(vectors: np.ndarray) -> bytes:
    """Integers as int16 or int64 behind a letter, larger ones pickled."""
    if vectors.dtype == object:
        return b"o" + pickle.dumps(vectors.tolist())
    small = np.abs(vectors).max(initial=0) < 2**15
    return (b"h" if small else b"q") + _bytes(vectors.astype(np.int16 if small else np.int64))


def unpacked(raw: bytes, width: int) -> np.ndarray:
    if raw[:1] == b"o":
        out = np.array(pickle.loads(raw[1:]), dtype=object)
        return out.reshape(-1, width)
    kind = np.int16 if raw[:1] == b"h" else np.int64
    return np.frombuffer(raw, dtype=kind, offset=1).astype(np.int64).reshape(-1, width)


def products(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: int64, or Python integers where one could leave it."""
    most = len(q) * max(int(abs(q).max(initial=0)), 1) * max((int(abs(vectors).max()) if vectors.size else 0), 1)
    if most < 2**53:
        return np.rint(vectors.astype(float) @ q.astype(float)).astype(np.int64)
    if most < 2**63:
        return vectors.astype(np.int64) @ q.astype(np.int64)
    return vectors.astype(object) @ q.astype(object)


class Found:
    """The k best (score, id) of a query so far, and the score to reach."""

    def __init__(self, own: int, q: np.ndarray, far: np.ndarray, k: int, reach: int | None):
        self.own, self.q, self.far, self.k, self.reach = own, q, far, k, reach
        self.best: list[tuple[int, int]] = []

    def look(self, ids: np.ndarray, vectors: np.ndarray, far: np.ndarray) -> int:
        """Evaluate a block in the order of bounds until no later row can enter; rows evaluated."""
        gap = np.abs(far - self.far[None]).max(axis=1)
        length, lengths = self.far[0], far[:, 0]
        # (|q|^2 + |v|^2 - d^2) / 2, as products of sums and differences.
        limit = (length * length + (lengths - gap) * (lengths + gap)) / 2
        limit = np.minimum(limit, length * lengths) + SLACK * (length + lengths) ** 2 + 1
        limit = np.where(ids == self.own, -np.inf, limit)
        order = np.argsort(-limit, kind="stable")
        at, step = 0, 256
        while at < len(order):
            if limit[order[at]] == -np.inf or (self.reach is not None and limit[order[at]] < self.reach):
                break
            part = order[at : at + step]
            part = part[ids[part] != self.own]
            scores = products(vectors[part], self.q)
            if self.reach is not None:
                hit = np.flatnonzero((scores >= self.reach).astype(bool))
                part, scores = part[hit], scores[hit]
            new = sorted((-int(s), int(i)) for s, i in zip(scores.tolist(), ids[part].tolist(), strict=True))[: self.k]
            self.best = sorted(self.best + new)[: self.k]
            if len(self.best) == self.k:
                self.reach = -self.best[-1][0]
            at, step = at + step, step * 2
        return min(at, len(order))


def _one(values: dict, schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values[n]], t) for n, t in schema], [n for n, _ in schema])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


_BLOCK = "block int, ids binary, vectors binary, far binary"
_QUERIES = "block int, q_ids binary, q_names binary, q_vectors binary, q_far binary, q_reach binary"
_Q = [(c.split()[0], pa.int32() if "int" in c else pa.binary()) for c in _QUERIES.split(", ")]
_HIT = [("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]


def _pack(width: int, pivots: np.ndarray):
    """One row per block: ids, integers and pivot distances."""

    def pack(table: pa.Table) -> pa.Table:
        vectors = floors(matrix(table.column("vector"), width), SCALE)
        ids = table.column("id").to_numpy().astype(np.int64)
        row = {"block": table.column("block")[0].as_py(), "ids": _bytes(ids), "vectors": packed(vectors)}
        row["far"] = _bytes(distances(vectors.astype(float), pivots))
        kinds = [("block", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("far", pa.binary())]
        return pa.Table.from_batches([_one(row, kinds)])

    return pack


def _pack_queries(width: int, pivots: np.ndarray):
    def pack(table: pa.Table) -> pa.Table:
        vectors = floors(matrix(table.column("vector"), width), SCALE)
        ids, names = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "name"))
        row = {"block": table.column("block")[0].as_py(), "q_ids": _bytes(ids), "q_names": _bytes(names), "q_vectors": packed(vectors)}
        row |= {"q_far": _bytes(distances(vectors.astype(float), pivots)), "q_reach": pickle.dumps([None] * len(ids))}
        return pa.Table.from_batches([_one(row, _Q)])

    return pack


def _answer(width: int, pivots: int, k: int):
    """Queries of a row against its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, vectors = np.frombuffer(row["ids"], dtype=np.int64), unpacked(row["vectors"], width)
            far = np.frombuffer(row["far"]).reshape(-1, pivots)
            names = np.frombuffer(row["q_names"], dtype=np.int64)
            found = _queries(row, width, pivots, k)
            for f in found:
                f.look(ids, vectors, far)
            hits = [(f.own, int(n), i, -s) for f, n in zip(found, names, strict=True) for s, i in f.best]
            lists = [pa.array([[h[c] for h in hits]], pa.list_(t)) for c, (_, t) in enumerate(_HIT)]
            reach = pickle.dumps([f.reach for f in found])
            own = [pa.array([reach if n == "q_reach" else row[n]], t) for n, t in _Q]
            yield pa.RecordBatch.from_arrays([*own, *lists], [n for n, _ in [*_Q, *_HIT]])

    return run, f"{_QUERIES}, " + ", ".join(f"{n} array<long>" for n, _ in _HIT)


def _queries(row: dict, width: int, pivots: int, k: int) -> list[Found]:
    ids, vectors = np.frombuffer(row["q_ids"], dtype=np.int64), unpacked(row["q_vectors"], width)
    far = np.frombuffer(row["q_far"]).reshape(-1, pivots)
    return [Found(int(i), v, d, k, r) for i, v, d, r in zip(ids, vectors, far, pickle.loads(row["q_reach"]), strict=True)]


def survivors(far: np.ndarray, reach: list, ranges: np.ndarray) -> np.ndarray:
    """Cells x queries: whether a cell can hold a row that reaches the query's score.

    ``ranges``: cells x pivots x (least, largest) distance of a cell's rows.
    """
    gap = np.maximum(ranges[:, None, :, 0] - far[None], far[None] - ranges[:, None, :, 1]).max(axis=2)
    gap = np.maximum(gap, 0)
    length, longest = far[None, :, 0], ranges[:, None, 0, 1]
    limit = (length * length + (longest - gap) * (longest + gap)) / 2
    limit = np.minimum(limit, length * longest) + SLACK * (length + longest) ** 2 + 1
    return limit >= np.array([-np.inf if r is None else float(r) for r in reach])[None] * (1 - 1e-12) - 1


def _travel(width: int, pivots: int, ranges: np.ndarray, blocks: list[list[int]]):
    """Queries go to the other blocks of every cell that is not eliminated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, names = (np.frombuffer(row[c], dtype=np.int64) for c in ("q_ids", "q_names"))
            vectors, reach = unpacked(row["q_vectors"], width), pickle.loads(row["q_reach"])
            far = np.frombuffer(row["q_far"]).reshape(-1, pivots)
            for cell, stays in enumerate(survivors(far, reach, ranges)):
                go, homes = np.flatnonzero(stays), [b for b in blocks[cell] if b != row["block"]]
                if len(go) and homes:
                    values = [_bytes(ids[go]), _bytes(names[go]), packed(vectors[go]), _bytes(far[go]), pickle.dumps([reach[i] for i in go])]
                    columns = [pa.array(homes, pa.int32()), *(pa.array([v] * len(homes), pa.binary()) for v in values)]
                    yield pa.RecordBatch.from_arrays(columns, [n for n, _ in _Q])

    return run


def _place(width: int, pivots: np.ndarray):
    """Cell (nearest pivot) of every row, with a number that stays once written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            cell = distances(matrix(batch.column("vector"), width) * SCALE, pivots).argmin(axis=1)
            numbers = pa.array(first + n + np.arange(batch.num_rows), pa.int64())
            columns = [batch.column(c) for c in ("id", "vector", "asked")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cell.astype(np.int32)), numbers], ["id", "vector", "asked", "cell", "number"])
            n += batch.num_rows

    return run


def _measure(width: int, pivots: np.ndarray):
    """Per task and cell: rows, and the range of distances to every pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(pivots)
        low, high, rows = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.zeros(n, dtype=np.int64)
        for batch in batches:
            far = distances(floors(matrix(batch.column("vector"), width), SCALE).astype(float), pivots)
            cell = batch.column("cell").to_numpy()
            np.minimum.at(low, cell, far)
            np.maximum.at(high, cell, far)
            rows += np.bincount(cell, minlength=n)
        for c in np.flatnonzero(rows):
            ints = [pa.array(np.full(n, c), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, rows[c]), pa.int64())]
            yield pa.RecordBatch.from_arrays([*ints, pa.array(low[c]), pa.array(high[c])], ["cell", "pivot", "rows", "low", "high"])

    return run


def _dealt(counts: dict[int, int], cells: int, rows: int) -> list[list[int]]:
    """Numbers of the blocks of each cell."""
    out, n = [], 0
    for c in range(cells):
        parts = -(-counts.get(c, 0) // rows)
        out.append(list(range(n, n + parts)))
        n += parts
    return out


def _block(blocks: list[list[int]], key: Column) -> Column:
    """A block of the row's cell, by the hash of a key."""
    first = F.array(*[F.lit(b[0] if b else 0) for b in blocks])
    parts = F.array(*[F.lit(max(len(b), 1)) for b in blocks])
    return F.get(first, F.col("cell")) + F.pmod(key, F.get(parts, F.col("cell"))).cast("int")


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every row where ``queries``."""
    vector = F.col(column)
    table = vectors.where(F.col(id_column).isNotNull() & finite(vector)).select(
        F.col(id_column).cast("long").alias("id"), vector.cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked")
    )
    count, width = table.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    width = width or 1
    pivots = pivots_of(table, width, count)
    n = len(pivots)
    placed = written(table.mapInArrow(_place(width, pivots), "id long, vector array<double>, asked boolean, cell int, number long"), "nearest-rows")
    spread = placed.select("vector", "cell").mapInArrow(_measure(width, pivots), "cell int, pivot int, rows long, low double, high double")
    spread = spread.groupBy("cell", "pivot").agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    # At most one row per cell and pivot.
    ranges, counts = np.zeros((n, n, 2)), {}
    for r in spread:
        ranges[r["cell"], r["pivot"]] = r["low"], r["high"]
        counts[r["cell"]] = r["rows"]
    blocks = _dealt(counts, n, ROWS)
    held = placed.select("id", "vector", _block(blocks, F.xxhash64("number")).alias("block"))
    held = written(held.groupBy("block").applyInArrow(_pack(width, pivots), _BLOCK), "nearest-blocks")
    asked = placed.where("asked").select("id", "vector", "cell").distinct().withColumn("name", F.xxhash64("vector"))
    asked = written(asked, "nearest-queries")
    # Queries of a cell go to its blocks, in parts of bounded size.
    asked_in = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
    parts = F.array(*[F.lit(max(1, -(-asked_in.get(c, 0) // (QUERY_ROWS * max(len(blocks[c]), 1))))) for c in range(n)])
    at = F.xxhash64("id", "name")
    asked = asked.withColumn("block", _block(blocks, at)).withColumn("part", F.pmod(F.xxhash64(at), F.get(parts, F.col("cell"))))
    homes = asked.select("id", "name", "vector", "block", "part").groupBy("block", "part").applyInArrow(_pack_queries(width, pivots), _QUERIES)
    run, schema = _answer(width, n, k)
    # Packed rows compress well, so their size as files or shuffled must not make them a broadcast.
    held = held.hint("merge")
    first = written(homes.join(held, "block").mapInArrow(run, schema), "nearest-first")
    going = first.select(*[c for c, _ in _Q]).mapInArrow(_travel(width, n, ranges, blocks), _QUERIES)
    second = going.join(held, "block").mapInArrow(run, schema)
    hits = F.inline(F.arrays_zip(*[c for c, _ in _HIT]))
    found = first.select(hits).unionByName(second.select(hits))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
