"""Sharding of documents by best-fit-decreasing bin packing.

Rows of equal text are one indivisible group. Groups are packed twice by best
fit decreasing: within each of at most ``PACKS`` packs (a pack is one task) into
crates of a fixed capacity, then the crates, whose number is bounded by that
capacity and the number of packs, into the shards. Groups larger than a crate
are crates of their own. The shards' capacity is the smallest that the packing
meets with the given number of shards.

A group however large is only ever a row of counts; slots inside a shard come
from counts per crate and chunk, so no task numbers a whole shard or group.

Null texts count as empty and are one group with them. Repeated rows each get a
slot. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.store import written

PACKS = 2_048
PACK_GROUPS = 4_096
# Crates that a shard is made of at least, and rows numbered together.
CRATES = 512
CHUNKS = 4_096


class _Node:
    __slots__ = ("key", "high", "left", "right")

    def __init__(self, key: tuple[int, int]):
        self.key, self.high, self.left, self.right = key, 1, None, None


def _high(n: _Node | None) -> int:
    return n.high if n else 0


def _fix(n: _Node) -> None:
    n.high = 1 + max(_high(n.left), _high(n.right))


def _turn_right(n: _Node) -> _Node:
    up = n.left
    n.left, up.right = up.right, n
    _fix(n)
    _fix(up)
    return up


def _turn_left(n: _Node) -> _Node:
    up = n.right
    n.right, up.left = up.left, n
    _fix(n)
    _fix(up)
    return up


def _balance(n: _Node) -> _Node:
    _fix(n)
    lean = _high(n.left) - _high(n.right)
    if lean > 1:
        if _high(n.left.left) < _high(n.left.right):
            n.left = _turn_left(n.left)
        return _turn_right(n)
    if lean < -1:
        if _high(n.right.right) < _high(n.right.left):
            n.right = _turn_right(n.right)
        return _turn_left(n)
    return n


def _insert(n: _Node | None, key: tuple[int, int]) -> _Node:
    if n is None:
        return _Node(key)
    if key < n.key:
        n.left = _insert(n.left, key)
    else:
        n.right = _insert(n.right, key)
    return _balance(n)


def _remove(n: _Node, key: tuple[int, int]) -> _Node | None:
    if key < n.key:
        n.left = _remove(n.left, key)
    elif key > n.key:
        n.right = _remove(n.right, key)
    elif n.left and n.right:
        low = n.right
        while low.left:
            low = low.left
        n.key = low.key
        n.right = _remove(n.right, low.key)
    else:
        return n.left or n.right
    return _balance(n)


class Bins:
    """Open bins in a balanced tree by remaining capacity, then number."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.root = capacity, 0, None

    def put(self, size: int) -> int:
        """Number of the tightest bin with room for the size; a new one if none."""
        best, n = None, self.root
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        if best is None:
            room, number = self.capacity, self.count
            self.count += 1
        else:
            room, number = best
            self.root = _remove(self.root, best)
        # A size beyond the capacity fills a bin of its own.
        self.root = _insert(self.root, (max(room - size, 0), number))
        return number


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Bin of each size (given in decreasing order) and the number of bins."""
    bins = Bins(capacity)
    return [bins.put(s) for s in sizes], bins.count


def fewest_capacity(sizes: list[int], shards: int) -> list[int]:
    """Bins of the smallest capacity that packs the sizes into the shards."""
    if not sizes:
        return []
    low = max(math.ceil(sum(sizes) / shards), sizes[0])
    # Any best fit packing stays within this capacity.
    high = low + sizes[0]
    best, count = best_fit_decreasing(sizes, low)
    if count <= shards:
        return best
    best, _ = best_fit_decreasing(sizes, high)
    while low + 1 < high:
        middle = (low + high) // 2
        bins, count = best_fit_decreasing(sizes, middle)
        if count <= shards:
            best, high = bins, middle
        else:
            low = middle
    return best


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): near equal bytes per shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = written(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("_group"),
        ),
        "packing-rows",
    )
    keys = ["_group", "text_crc32"]
    groups = written(slim.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "packing-groups")
    size = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    packs = max(1, min(PACKS, math.ceil(size["n"] / PACK_GROUPS)))
    crate = max(1, math.ceil((size["bytes"] or 0) / (shards * CRATES)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bytes", "descending"), ("_group", "ascending"), ("text_crc32", "ascending")])
        bins, _ = best_fit_decreasing(table.column("bytes").to_pylist(), crate)
        name = [(p << 32) | b for p, b in zip(table.column("pack").to_pylist(), bins, strict=True)]
        return table.select(["_group", "text_crc32", "bytes", "rows"]).append_column("crate", pa.array(name, pa.int64()))

    packed = written(
        groups.withColumn("pack", F.pmod(F.xxhash64("_group"), F.lit(packs)))
        .groupBy("pack")
        .applyInArrow(pack, "_group binary, text_crc32 long, bytes long, rows long, crate long"),
        "packing-crates",
    )
    crates = packed.groupBy("crate").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat([*parts, pd.DataFrame({"crate": [], "bytes": [], "rows": []})]).astype("int64")
        every = every.sort_values(["bytes", "crate"], ascending=[False, True])
        every["shard"] = fewest_capacity(every["bytes"].tolist(), shards)
        yield every[["crate", "rows", "shard"]]

    # Bounded: two crates per crate capacity and one per pack at most, beside the large groups.
    placed = written(crates.coalesce(1).mapInPandas(fill, "crate long, rows long, shard int"), "packing-shards")
    unit = max(1_000, (size["rows"] or 0) // CHUNKS)
    chunks = F.ceil(F.col("rows") / F.lit(unit)).cast("long")
    where = packed.select(*keys, "crate").join(placed.select("crate", "shard", chunks.alias("_chunks")), "crate")
    rows = slim.join(where, keys).withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "_group"), F.col("_chunks")))
    counts = rows.groupBy("shard", "crate", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("crate", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("crate", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("crate", "_chunk").orderBy("doc_id", "_group")
    return rows.join(offsets, ["crate", "_chunk"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_offset") + F.row_number().over(inside) - 1).alias("slot")
    )
