"""Nearest neighbours by cosine through vantage-point trees.

A small vantage-point tree over a bounded sample cuts the space into cells; a cell
with many rows has several shards. Each shard builds a vantage-point tree of all
its rows. On unit vectors the Euclidean distance falls as the cosine grows, and
it obeys the triangle inequality: a subtree whose rows lie between two distances
from its vantage point can't hold a row nearer to a query than the gap to that
ring. A subtree is skipped where this bound exceeds ``factor`` times the distance
of the query's k-th best so far. Factor one is exact search; smaller factors skip
more and may miss neighbours.

A shard first answers its own queries, which gives each a k-th distance. With it,
the cells' rings are tested, and a query travels only to the shards of cells that
it can't skip, packed with the other queries of its shard. Those shards report
rows at least as near as the k-th, so results stay small.

Scores are computed from the original vectors in double precision, by the same sum
for every pair, so equal vectors score alike; ties go to the smaller id. Vectors
that are null, zero or hold a null or non-finite component take no part, nor do
rows without id. Shorter vectors count as padded with zeros. Every row is a query
of its own, also a repeated one; its candidates are the rows of other ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.store import lowest_hashes, written
from newsloom.llm.vectors import finite, matrix

# Rows of a shard and of a leaf; cells at most; rows that cells are fitted on
# (lowest hashes); candidates for a vantage point.
ROWS, LEAF, CELLS, SAMPLE, TRIES = 8_192, 64, 256, 4_096, 12
FACTOR = 1.0
# Rounding of distances and of scores computed by matrix products.
GAP, CLOSE = 1e-6, 1e-9


def levelled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -exponent[:, None])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _distance(similarity: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * similarity, 0))


def _vantage(u: np.ndarray) -> int:
    """Of a few rows the one whose distances to others vary most."""
    tries = np.linspace(0, len(u) - 1, min(TRIES, len(u))).astype(int)
    some = u[np.linspace(0, len(u) - 1, min(256, len(u))).astype(int)]
    return int(tries[_distance(u[tries] @ some.T).var(axis=1).argmax()])


class Tree:
    """Vantage-point tree: inner nodes hold a vantage point and two rings.

    ``order`` lists the rows so that every node's are consecutive; ``spans`` has
    (begin, end, first child or -1), the second child follows the first, and
    ``rings`` the least and largest distance of either child's rows.
    """

    def __init__(self, points: np.ndarray, spans: np.ndarray, rings: np.ndarray, order: np.ndarray):
        self.points, self.spans, self.rings, self.order = points, spans, rings, order

    @classmethod
    def grow(cls, u: np.ndarray, leaf: int) -> Tree:
        order = np.arange(len(u))
        spans, rings, points = [[0, len(u), -1]], [[0.0] * 4], [np.zeros(u.shape[1])]
        at = 0
        while at < len(spans):
            a, b, _ = spans[at]
            if b - a > leaf:
                inside = order[a:b]
                points[at] = u[inside[_vantage(u[inside])]]
                far = _distance(u[inside] @ points[at])
                by = np.argsort(far, kind="stable")
                order[a:b], far = inside[by], far[by]
                half = (b - a) // 2
                rings[at] = [far[0], far[half - 1], far[half], far[-1]]
                spans[at][2] = len(spans)
                spans += [[a, a + half, -1], [a + half, b, -1]]
                rings += [[0.0] * 4, [0.0] * 4]
                points += [np.zeros(u.shape[1])] * 2
            at += 1
        return cls(np.array(points), np.array(spans, dtype=np.int64), np.array(rings), order)

    def place(self, u: np.ndarray) -> np.ndarray:
        """Leaf (as a node) that each row falls into."""
        node = np.zeros(len(u), dtype=np.int64)
        while (inner := np.flatnonzero(self.spans[node, 2] >= 0)).size:
            at = node[inner]
            far = _distance((u[inner] * self.points[at]).sum(axis=1))
            right = far > (self.rings[at, 1] + self.rings[at, 2]) / 2
            node[inner] = self.spans[at, 2] + right
        return node


class Best:
    """The k best candidates of each query, and the scores they must reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, reach: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = norms(vectors)
        self.units = vectors / self.norms[:, None]
        self.reach = np.full(len(ids), -np.inf) if reach is None else reach.copy()
        self.far = _distance(self.reach)
        self.found: list[list[tuple[float, int]]] = [[] for _ in ids]

    def offer(self, active: np.ndarray, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, units: np.ndarray) -> None:
        near = self.units[active] @ units.T >= self.reach[active][:, None] - CLOSE
        near &= self.ids[active][:, None] != ids[None]
        for i in np.flatnonzero(near.any(axis=1)):
            q, some = active[i], np.flatnonzero(near[i])
            scores = (vectors[some] * self.vectors[q]).sum(axis=1) / (lengths[some] * self.norms[q])
            some, scores = some[scores >= self.reach[q]], scores[scores >= self.reach[q]]
            lead = np.lexsort((ids[some], -scores))[: self.k]
            new = [(-float(scores[j]), int(ids[some[j]])) for j in lead]
            self.found[q] = sorted(self.found[q] + new)[: self.k]
            if len(self.found[q]) == self.k:
                self.reach[q] = -self.found[q][-1][0]
                self.far[q] = _distance(self.reach[q])


class Shard:
    """Rows of a shard in the order of its tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, tree: Tree):
        self.ids, self.vectors, self.tree = ids, vectors, tree
        self.norms = norms(vectors)
        self.units = vectors / self.norms[:, None]

    def search(self, best: Best, factor: float) -> int:
        """Offer what can't be skipped, nearer subtrees first; leaves visited."""
        tree, visited = self.tree, 0
        everyone = np.arange(len(best.ids))
        stack = [(0, everyone, np.zeros(len(everyone)))]
        while stack:
            node, active, bound = stack.pop()
            active = active[bound <= factor * best.far[active] + GAP]
            if not len(active):
                continue
            a, b, child = tree.spans[node]
            if child < 0:
                visited += len(active)
                best.offer(active, self.ids[a:b], self.vectors[a:b], self.norms[a:b], self.units[a:b])
                continue
            far = _distance(best.units[active] @ tree.points[node])
            rings = tree.rings[node]
            left = far <= (rings[1] + rings[2]) / 2
            bounds = [np.maximum(np.maximum(rings[2 * s] - far, far - rings[2 * s + 1]), 0) for s in (0, 1)]
            for side, chosen in ((0, ~left), (1, left), (1, ~left), (0, left)):
                if chosen.any():
                    stack.append((child + side, active[chosen], bounds[side][chosen]))
        return visited


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _packed(x: np.ndarray) -> bytes:
    """Vectors as float32 where that loses nothing (half the bytes), else float64."""
    small = x.astype(np.float32)
    return _bytes(small) if (small == x).all() else _bytes(x)


def _vectors(raw: bytes, n: int, width: int) -> np.ndarray:
    kind = np.float32 if len(raw) == 4 * n * width else np.float64
    return np.frombuffer(raw, dtype=kind).astype(np.float64).reshape(n, width)


_INDEX = "shard int, cell int, ids binary, vectors binary, asked binary, points binary, spans binary, rings binary"


def _grow(width: int, cells: np.ndarray):
    """One row per shard: its rows in tree order and the tree."""

    def run(table: pa.Table) -> pa.Table:
        x = levelled(matrix(table.column("vector"), width))
        tree = Tree.grow(x / norms(x)[:, None], LEAF)
        order = tree.order
        shard = table.column("shard")[0].as_py()
        values = [
            _bytes(table.column("id").to_numpy().astype(np.int64)[order]),
            _packed(x[order]),
            _bytes(table.column("asked").to_numpy(zero_copy_only=False).astype(bool)[order]),
            _bytes(tree.points),
            _bytes(tree.spans),
            _bytes(tree.rings),
        ]
        columns = [pa.array([shard], pa.int32()), pa.array([int(cells[shard])], pa.int32())]
        return pa.table(
            [*columns, *(pa.array([v], pa.binary()) for v in values)],
            names=["shard", "cell", "ids", "vectors", "asked", "points", "spans", "rings"],
        )

    return run


def _shard(row: dict, width: int) -> Shard:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    spans = np.frombuffer(row["spans"], dtype=np.int64).reshape(-1, 3)
    rings = np.frombuffer(row["rings"], dtype=np.float64).reshape(-1, 4)
    points = np.frombuffer(row["points"], dtype=np.float64).reshape(-1, width)
    return Shard(ids, _vectors(row["vectors"], len(ids), width), Tree(points, spans, rings, np.arange(len(ids))))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


_OWN = "shard int, cell int, q_keys binary, q_ids binary, q_vectors binary, q_reach binary"
_FOUND = "query_id long, query long, vec_id long, score double"


def _listed(best: Best, keys: np.ndarray) -> list[pa.Array]:
    hits = [(q, i, -s) for q, found in enumerate(best.found) for s, i in found]
    at = np.array([h[0] for h in hits], dtype=np.int64)
    return [
        pa.array(best.ids[at], pa.int64()),
        pa.array(keys[at], pa.int64()),
        pa.array([h[1] for h in hits], pa.int64()),
        pa.array([h[2] for h in hits], pa.float64()),
    ]


def _answer_own(width: int, k: int, factor: float):
    """A shard's own queries: their places, vectors, k-th scores, and the rows found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            shard = _shard(row, width)
            asked = np.flatnonzero(np.frombuffer(row["asked"], dtype=bool))
            if not len(asked):
                continue
            keys = (np.int64(row["shard"]) << 32) | asked
            best = Best(shard.ids[asked], shard.vectors[asked], k)
            shard.search(best, factor)
            packed = [_bytes(keys), _bytes(best.ids), _packed(best.vectors), _bytes(best.reach)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in _listed(best, keys)]
            columns = [pa.array([row["shard"]], pa.int32()), pa.array([row["cell"]], pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array([v], pa.binary()) for v in packed), *lists],
                ["shard", "cell", "q_keys", "q_ids", "q_vectors", "q_reach", "query_id", "query", "vec_id", "score"],
            )

    lists = "query_id array<long>, query array<long>, vec_id array<long>, score array<double>"
    return run, f"{_OWN}, {lists}"


def _travel(width: int, factor: float, points: np.ndarray, rings: np.ndarray, shards: list[list[int]]):
    """Queries go to the other shards of every cell that their bound can't skip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids = np.frombuffer(row["q_ids"], dtype=np.int64)
            keys, reach = np.frombuffer(row["q_keys"], dtype=np.int64), np.frombuffer(row["q_reach"], dtype=np.float64)
            vectors = _vectors(row["q_vectors"], len(ids), width)
            far = _distance(vectors / norms(vectors)[:, None] @ points.T)
            limit = factor * _distance(reach) + GAP
            for cell, homes in enumerate(shards):
                bound = np.maximum(rings[cell, :, 0] - far, far - rings[cell, :, 1]).max(axis=1, initial=0)
                go = np.flatnonzero(bound <= limit)
                homes = [s for s in homes if s != row["shard"]]
                if len(go) and homes:
                    packed = [_bytes(keys[go]), _bytes(ids[go]), _packed(vectors[go]), _bytes(reach[go])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(homes, pa.int32()), *(pa.array([v] * len(homes), pa.binary()) for v in packed)],
                        ["shard", "q_keys", "q_ids", "q_vectors", "q_reach"],
                    )

    return run, _OWN.replace(" cell int,", "")


def _answer(width: int, k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids = np.frombuffer(row["q_ids"], dtype=np.int64)
            reach = np.frombuffer(row["q_reach"], dtype=np.float64)
            best = Best(ids, _vectors(row["q_vectors"], len(ids), width), k, reach)
            _shard(row, width).search(best, factor)
            keys = np.frombuffer(row["q_keys"], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(_listed(best, keys), ["query_id", "query", "vec_id", "score"])

    return run


class Index:
    """Trees of all usable rows: the table of shards, and what routes queries."""

    def __init__(self, table: DataFrame):
        """``table``: (id, vector, asked) of usable rows."""
        rows, width = table.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        self.width = width or 1
        sample = lowest_hashes(table, rows, SAMPLE)
        x = levelled(matrix(pa.array([r["vector"] for r in sample], pa.list_(pa.float64())), self.width))
        cells = min(CELLS, max(1, rows // ROWS))
        top = Tree.grow(x / np.maximum(norms(x), 1e-300)[:, None], max(LEAF // 2, -(-len(sample) // cells)))
        leaves = np.flatnonzero(top.spans[:, 2] < 0)
        cell_of = np.zeros(len(top.spans), dtype=np.int32)
        cell_of[leaves] = np.arange(len(leaves))
        self.points = top.points[top.spans[:, 2] >= 0]
        points, width = self.points, self.width

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, n = TaskContext.get().partitionId() << 40, 0
            for batch in batches:
                x = levelled(matrix(batch.column("vector"), width))
                u = x / norms(x)[:, None]
                columns = [batch.column(c) for c in ("id", "vector", "asked")]
                numbers = pa.array(first + n + np.arange(len(x)), pa.int64())
                cell = pa.array(cell_of[top.place(u)], pa.int32())
                yield pa.RecordBatch.from_arrays([*columns, cell, numbers], ["id", "vector", "asked", "cell", "number"])
                n += len(x)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = (np.full((len(leaves), len(points)), v) for v in (np.inf, -np.inf))
            rows = np.zeros(len(leaves), dtype=np.int64)
            for batch in batches:
                x = levelled(matrix(batch.column("vector"), width))
                far, cell = _distance(x / norms(x)[:, None] @ points.T), batch.column("cell").to_numpy()
                np.minimum.at(low, cell, far)
                np.maximum.at(high, cell, far)
                rows += np.bincount(cell, minlength=len(rows))
            # A point for every cell, so that cells without vantage points count too.
            for c in np.flatnonzero(rows):
                n = max(len(points), 1)
                ends = [pa.array(a[c] if len(points) else [0.0], pa.float64()) for a in (low, high)]
                ints = [pa.array(np.full(n, c), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, rows[c]), pa.int64())]
                yield pa.RecordBatch.from_arrays([*ints, *ends], ["cell", "point", "rows", "low", "high"])

        schema = "id long, vector array<double>, asked boolean, cell int, number long"
        placed = written(table.mapInArrow(place, schema), "vptree-rows")
        # Rings of the cells around every vantage point: at most CELLS x CELLS rows.
        rings = placed.select("vector", "cell").mapInArrow(measure, "cell int, point int, rows long, low double, high double")
        rings = rings.groupBy("cell", "point").agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
        self.rings = np.zeros((len(leaves), len(points), 2))
        self.shards: list[list[int]] = [[] for _ in leaves]
        count = 0
        for r in sorted(rings.collect(), key=lambda r: (r["cell"], r["point"])):
            if len(points):
                self.rings[r["cell"], r["point"]] = r["low"], r["high"]
            if not r["point"]:
                parts = -(-r["rows"] // ROWS)
                self.shards[r["cell"]] = list(range(count, count + parts))
                count += parts
        cells = np.zeros(max(count, 1), dtype=np.int32)
        for cell, homes in enumerate(self.shards):
            cells[homes] = cell
        begin = F.array(*[F.lit(h[0] if h else 0) for h in self.shards])
        parts = F.array(*[F.lit(max(len(h), 1)) for h in self.shards])
        shard = F.get(begin, F.col("cell")) + F.pmod(F.xxhash64("number"), F.get(parts, F.col("cell"))).cast("int")
        held = placed.select("id", "vector", "asked", shard.alias("shard"))
        self.table = written(held.groupBy("shard").applyInArrow(_grow(self.width, cells), _INDEX), "vptree-index")

    def nearest(self, k: int, factor: float) -> DataFrame:
        """(query_id, query, vec_id, score): candidates that hold the k best of each asked row."""
        run, schema = _answer_own(self.width, k, factor)
        own = written(self.table.mapInArrow(run, schema), "vptree-queries")
        names = ["query_id", "query", "vec_id", "score"]
        first = own.select(F.inline(F.arrays_zip(*names)))
        run, schema = _travel(self.width, factor, self.points, self.rings, self.shards)
        going = own.select("shard", "q_keys", "q_ids", "q_vectors", "q_reach").mapInArrow(run, schema)
        # Packed rows compress well, so their size as files or shuffled must not make them a broadcast.
        tiles = going.join(self.table.drop("cell", "asked").hint("merge"), "shard")
        return first.unionByName(tiles.mapInArrow(_answer(self.width, k, factor), _FOUND))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, factor: float = FACTOR, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row where ``queries``."""
    vector = F.col(column)
    usable = F.col(id_column).isNotNull() & finite(vector) & F.exists(vector, lambda x: x != 0)
    table = vectors.where(usable).select(
        F.col(id_column).cast("long").alias("id"), vector.cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked")
    )
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    found = Index(table).nearest(k, factor).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
