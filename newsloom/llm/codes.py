"""Vector codes: parts assigned to codebooks through a trie of distinct parts.

A vector's components become integers, floor(scale x), and the vector is cut into
equal consecutive parts. Per part position a codebook of entries is refined:
every part goes to its nearest entry (squared Euclidean distance, ties to the
lower index), then each entry becomes the componentwise floor of its parts' mean;
unused entries stay.

Inside a task the distinct parts of a position, in lexicographic order, are the
leaves of a trie with one level per component. It is walked depth first, a stretch
of leaves at a time: the distances of a prefix to all entries are accumulated once
and shared by every leaf under it; a leaf takes the argmin, and counts for its
entry with the number of parts that it stands for. A round is one pass over the
table; tasks return sums per entry and component (at most parts x entries x
components rows each), never vectors, so nothing but the codebooks, whose size
does not depend on the table, reaches the driver.

All arithmetic is exact. Distances leave int64 for Python integers where they
must; a sum beyond 38 digits or a distance beyond a long is an error.

Rows whose vector is null or holds a null or non-finite component are dropped.
Shorter vectors count as padded with zeros up to the longest, and all of them up
to a multiple of the parts. Rows without id are coded like others and come last
where the first ids start the codebooks; rows of one id follow the order of their
vectors. An empty table gives an empty result.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.store import written
from newsloom.llm.vectors import finite, floors, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Leaves whose distances are held at once: this many times the entries.
LEAVES = 8_192
# A label with more than this share of the rows is joined by broadcast.
HOT = 1_000


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaves in lexicographic order, rows of each, leaf of each row)."""
    n, width = parts.shape
    if parts.dtype == object:
        rows = [tuple(r) for r in parts.tolist()]
        order = np.array(sorted(range(n), key=rows.__getitem__), dtype=np.int64)
    else:
        order = np.lexsort([parts[:, d] for d in reversed(range(width))])
    ordered = parts[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    head = np.flatnonzero(fresh)
    leaf = np.empty(n, dtype=np.int64)
    leaf[order] = np.cumsum(fresh) - 1
    return ordered[head], np.diff(np.append(head, n)), leaf


def walk(leaves: np.ndarray, entries: np.ndarray, step: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each leaf and its squared distance.

    ``step`` leaves are finished before the next ones are opened, so memory holds
    the prefixes of one stretch of the trie.
    """
    nearest = np.zeros(len(leaves), dtype=np.int64)
    error = np.zeros(len(leaves), dtype=entries.dtype)
    for at in range(0, len(leaves), step):
        some = leaves[at : at + step]
        fresh = np.zeros(len(some), dtype=bool)
        fresh[0] = True
        above = np.zeros((1, len(entries)), dtype=entries.dtype)
        node = np.zeros(len(some), dtype=np.int64)
        for d in range(some.shape[1]):
            fresh[1:] |= (some[1:, d] != some[:-1, d]).astype(bool)
            head = np.flatnonzero(fresh)
            gap = some[head, d][:, None] - entries[None, :, d]
            above = above[node[head]] + gap * gap
            node = np.cumsum(fresh) - 1
        best = above.argmin(axis=1)
        nearest[at : at + step] = best
        error[at : at + step] = above[np.arange(len(some)), best]
    return nearest, error


def _matching(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 if no distance can leave it, else as Python integers."""
    most = max((int(abs(a).max()) for a in (parts, entries) if a.size), default=0)
    if parts.shape[1] * (2 * most) ** 2 < 2**62:
        return parts.astype(np.int64), entries.astype(np.int64)
    return parts.astype(object), entries.astype(object)


def assign(vectors: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per part position: leaves, rows of each, leaf of each row, entry and error of each leaf."""
    width = books.shape[2]
    for p in range(len(books)):
        parts, entries = _matching(vectors[:, p * width : (p + 1) * width], books[p])
        leaves, times, leaf = distinct(parts)
        nearest, error = walk(leaves, entries)
        yield p, leaves, times, leaf, nearest, error


def entry_sums(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the parts that go to each entry."""
    sums = np.zeros(books.shape, dtype=object)
    counts = np.zeros(books.shape[:2], dtype=np.int64)
    for p, leaves, times, _, nearest, _ in assign(vectors, books):
        order = np.argsort(nearest, kind="stable")
        head = np.flatnonzero(np.diff(nearest[order], prepend=-1))
        used = nearest[order][head]
        sums[p, used] = np.add.reduceat((leaves * times[:, None])[order], head, axis=0).astype(object)
        counts[p, used] = np.add.reduceat(times[order], head)
    return sums, counts


def _refined(table: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, dtype=object), np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                more, n = entry_sums(floors(matrix(batch.column("vector"), parts * width), scale), books)
                sums, counts = sums + more, counts + n
        p, e = np.nonzero(counts)
        for d in range(width):
            values = pa.array([decimal.Decimal(int(v)) for v in sums[p, e, d]], pa.decimal128(38, 0))
            columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(np.full(len(p), d), pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, values, pa.array(counts[p, e])], ["part", "entry", "d", "total", "n"])

    schema = "part int, entry int, d int, total decimal(38,0), n long"
    rows = table.select("vector").mapInArrow(run, schema).groupBy("part", "entry", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.astype(object)
    for r in rows.collect():
        out[r["part"], r["entry"], r["d"]] = int(r["total"]) // r["n"]
    return out


def codebooks(table: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray | None:
    """Entries as Python integers, parts x entries x components; None for no rows.

    ``table`` has the columns id and vector; vectors are usable.
    """
    longest = table.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    first = table.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = matrix(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), parts * width)
    books = floors(start, scale).astype(object).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _refined(table, books, scale)
    return books


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    values = [] if books is None else books.ravel().tolist()
    return hashlib.sha256(",".join(str(int(v)) for v in values).encode()).hexdigest()


def encode(table: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(id, label, codes, error) of rows (id, label, vector)."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            codes, total = np.zeros((n, parts), dtype=np.int32), np.zeros(n, dtype=object)
            if n:
                for p, _, _, leaf, nearest, error in assign(floors(matrix(batch.column("vector"), parts * width), scale), books):
                    codes[:, p] = nearest[leaf]
                    total = total + error[leaf].astype(object)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * parts, pa.int32()), pa.array(codes.ravel()))
            columns = [batch.column("id"), batch.column("label"), lists, pa.array(total.tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "codes", "error"])

    label = table.schema["label"].dataType.simpleString()
    return table.select("id", "label", "vector").mapInArrow(run, f"id long, label {label}, codes array<int>, error long")


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over equal labels.

    Labels with many rows, of which there are at most ``HOT``, are looked up by
    broadcast, so no task holds a label's rows; the others meet by shuffle.
    """
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    rows = coded.count()
    hot = F.broadcast(totals.where(F.col("_n") * HOT > rows).drop("_n"))
    same = coded["label"].eqNullSafe(F.col("_label"))
    often = coded.join(hot, same).drop("_label")
    seldom = coded.join(hot, same, "left_anti").join(totals.where(F.col("_n") * HOT <= rows).drop("_n"), same).drop("_label")
    return often.unionByName(seldom)


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_column: str = "vec_id",
    column: str = "embedding",
    label_column: str = "label",
) -> tuple[DataFrame, np.ndarray | None]:
    """((id, label, codes, error, label_error), codebooks) of all usable rows."""
    table = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(column).alias("vector"))
    table = table.where(finite(F.col("vector"))).withColumn("vector", F.col("vector").cast("array<double>"))
    books = codebooks(table, parts, entries, rounds, scale)
    used = np.zeros((parts, 1, 1), dtype=object) if books is None else books
    return label_errors(written(encode(table, used, scale), "vector-codes")), books


def hex_code(codes: Column) -> Column:
    """Indexes in part order, two lower-case hex digits each."""
    return F.concat_ws("", F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
