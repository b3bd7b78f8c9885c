"""Byte-level byte-pair encoding and decoding of whole corpora.

Texts are split into pieces by the tokenizer's pattern. A block of documents
keeps its sequence of pieces as packed positions into the list of its distinct
pieces. Only that list is shuffled: its pieces travel with their positions to
the part of the corpus vocabulary that their hash names, packed per block and
part, so a piece is one entry per block however often it occurs. Each part
encodes its distinct pieces once; the ids return to the blocks packed, and the
documents are put together by position. Decoding looks ids up in the token-byte
table, which the vocabulary bounds.

Null texts count as empty and have no ids. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import secrets
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.store import bucketed

# Characters of text whose documents form a block.
BLOCK_CHARS = 32 << 20
# Parts of the vocabulary per shuffle partition.
PARTS = 4


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines)}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the lowest-ranked adjacent pair until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        # Stale when either part has been merged meanwhile.
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            r = ranks.get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = before[i]
        if p >= 0:
            r = ranks.get(piece[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as byte planes, which compress well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    """The first n numbers, and the bytes after them."""
    planes = np.frombuffer(data[: 4 * n], dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64), data[4 * n :]


def _pack(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Columns of numbers, each after its length, and further bytes, compressed."""
    parts = [x for c in columns for x in (_planes(np.array([len(c)])), _planes(c))]
    return zstandard.compress(b"".join([*parts, tail]), 3)


def _unpack(packed: bytes, columns: int) -> tuple[list[np.ndarray], memoryview]:
    rest = memoryview(zstandard.decompress(packed))
    out = []
    for _ in range(columns):
        n, rest = _numbers(rest, 1)
        values, rest = _numbers(rest, int(n[0]))
        out.append(values)
    return out, rest


_BLOCKS = "block long, n_pieces int, parts array<binary>, doc_ids array<long>, sizes array<int>, codes binary"


def _blocks(pattern: str, parts: int):
    """Group documents into blocks of distinct pieces and packed positions."""

    def row(vocabulary: dict[str, int], ids: list, sizes: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(codes)
        # Frequent pieces get small positions, which pack better.
        order = np.argsort(-np.bincount(flat, minlength=len(vocabulary)), kind="stable")
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order))
        names = list(vocabulary)
        pieces = [names[i].encode() for i in order.tolist()]
        home = np.array([zlib.crc32(x) % parts for x in pieces], dtype=np.int64)
        at = np.argsort(home, kind="stable")
        sent = []
        for places in np.split(at, np.searchsorted(home[at], np.arange(1, parts))):
            mine = [pieces[i] for i in places.tolist()]
            # Positions rise, so their differences are small.
            sent.append(_pack(np.diff(places, prepend=0), np.array([len(x) for x in mine]), tail=b"".join(mine)) if mine else None)
        return pa.RecordBatch.from_arrays(
            [
                # The name is fixed once the table of blocks has been written.
                pa.array([secrets.randbits(63)], pa.int64()),
                pa.array([len(pieces)], pa.int32()),
                pa.array([sent], pa.list_(pa.binary())),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int32())),
                pa.array([_pack(place[flat])], pa.binary()),
            ],
            ["block", "n_pieces", "parts", "doc_ids", "sizes", "codes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        vocabulary, ids, sizes, codes, held = {}, [], [], [], 0
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for i, doc in enumerate(docs):
                text = texts[i].as_py() or ""
                found = [vocabulary.setdefault(p, len(vocabulary)) for p in split(text)]
                ids.append(doc)
                sizes.append(len(found))
                codes.append(np.array(found, dtype=np.uint32))
                held += len(text) + 64
                if held >= BLOCK_CHARS:
                    yield row(vocabulary, ids, sizes, codes)
                    vocabulary, ids, sizes, codes, held = {}, [], [], [], 0
        if ids:
            yield row(vocabulary, ids, sizes, codes)

    return run


def _encode(ranks):
    """Ids of the pieces of each block; rows come sorted by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        now, known = None, {}
        for batch in batches:
            packed = []
            for part, sent in zip(batch.column("part").to_pylist(), batch.column("sent").to_pylist(), strict=True):
                if part != now:
                    now, known = part, {}
                (step, size), data = _unpack(sent, 2)
                data, ends = bytes(data), np.cumsum(size).tolist()
                found, start = [], 0
                for end in ends:
                    piece, start = data[start:end], end
                    ids = known.get(piece)
                    if ids is None:
                        ids = known[piece] = encode_piece(piece, table)
                    found.append(ids)
                packed.append(_pack(step, np.array([len(x) for x in found]), np.array([i for x in found for i in x])))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packed, pa.binary())], ["block", "ids"])

    return run


def _lookup(packed: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the n pieces of a block, flat, and where each piece's begin."""
    sizes = np.zeros(n + 1, dtype=np.int64)
    held = []
    for p in packed:
        (step, size, flat), _ = _unpack(p, 3)
        at = np.cumsum(step)
        sizes[at + 1] = size
        held.append((at, size, flat))
    begin = np.cumsum(sizes)
    out = np.zeros(int(begin[-1]), dtype=np.int64)
    for at, size, flat in held:
        local = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin[at], size) + local] = flat
    return out, begin


def _assemble(finish, schema_names: list[str], kinds: list[pa.DataType]):
    """Put the ids of each document together by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = finish()
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, sizes, n = (batch.column(c)[i].as_py() for c in ("doc_ids", "sizes", "n_pieces"))
                flat, begin = _lookup(batch.column("ids")[i].as_py() or [], n)
                (codes,), _ = _unpack(batch.column("codes")[i].as_py(), 1)
                lengths = (begin[1:] - begin[:-1])[codes]
                ends = np.cumsum(sizes)
                rows, held = [], 0
                for doc, end, size in zip(doc_ids, ends.tolist(), sizes, strict=True):
                    c, count = codes[end - size : end], lengths[end - size : end]
                    local = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    rows.append((doc, *make(flat[np.repeat(begin[c], count) + local])))
                    held += size
                    if held > 200_000:
                        yield _rows(rows, schema_names, kinds)
                        rows, held = [], 0
                yield _rows(rows, schema_names, kinds)

    return run


def _rows(rows: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Blocks with the ids of their distinct pieces (column ``ids``)."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(ranks)
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The packed sequences stay where they are written; only pieces and ids move.
    blocks = bucketed(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks(pattern, parts), _BLOCKS), "bpe-blocks", "block"
    )
    sent = blocks.select("block", F.posexplode("parts").alias("part", "sent")).where(F.col("sent").isNotNull())
    ids = (
        sent.repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(_encode(table), "block long, ids binary")
        .groupBy("block")
        .agg(F.collect_list("ids").alias("ids"))
    )
    # The ids grow with the corpus, so they are never broadcast.
    slim = blocks.select("block", "n_pieces", "doc_ids", "sizes", "codes")
    return slim.join(ids.hint("merge"), "block", "left")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs``."""

    def finish():
        return lambda ids: (ids.tolist(),)

    kinds = [pa.int64(), pa.list_(pa.int32())]
    return _encoded(docs, ranks, pattern).mapInArrow(
        _assemble(finish, ["doc_id", "ids"], kinds), "doc_id long, ids array<int>"
    )


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, data) for every row of (doc_id, ids): joined token bytes."""
    table = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = table.value
        for batch in batches:
            data = [b"".join([token[i] for i in ids or []]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of ids and bytes.

    The same as ``encode`` followed by ``decode``, without carrying either.
    """
    spark = docs.sparkSession
    tokens = spark.sparkContext.broadcast(sorted((i, t) for t, i in ranks.items()))

    def finish():
        size = tokens.value[-1][0] + 1 if tokens.value else 0
        data, text = [b""] * size, [str(i).encode() for i in range(size)]
        for i, t in tokens.value:
            data[i] = t

        def make(ids: np.ndarray) -> tuple[int, str, str]:
            found = ids.tolist()
            spelled = hashlib.sha256(b" ".join([text[i] for i in found])).hexdigest()
            return len(found), spelled, hashlib.sha256(b"".join([data[i] for i in found])).hexdigest()

        return make

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _encoded(docs, ranks, pattern).mapInArrow(
        _assemble(finish, names, kinds), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
