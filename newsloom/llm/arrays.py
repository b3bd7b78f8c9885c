"""Words, hashes and runs of whole Arrow batches as numpy arrays.

Everything here works on one slice of a batch at a time, so memory follows the
slice (``SLICE_BYTES``, or one document if that is longer), not the partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

# The bytes between words, \x20 and \x09 to \x0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

# Odd multipliers, so that they have inverses modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, from 0 to n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b), dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class SpanHasher:
    """Hash of values[start:end] for any spans; equal sequences hash alike.

    Cheap, and not safe against sequences made to collide: it may decide which
    rows meet, not which are equal.
    """

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values))
        self.total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.total[ends] - self.total[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHasher(values)(starts, ends)


def ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks from 0, equal for equal values."""
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.cumsum(fresh) - 1
    return out


def window_names(ids: np.ndarray, k: int) -> np.ndarray:
    """A number per window of k ids that equal windows share, and only those.

    Windows of twice the length are ranked by their halves, as in a suffix array.
    """
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out, done, part, reach = None, 0, ids.astype(np.int64), 1
    while True:
        if k & reach:
            piece = part[done : done + n]
            out = piece if out is None else ranks((out << 32) | piece)
            done += reach
        if reach * 2 > k:
            return out
        part, reach = ranks((part[:-reach] << 32) | part[reach:]), reach * 2


def spans_coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The byte strings of consecutive spans that don't overlap, each distinct one once."""
    change = np.zeros(len(data) + 1, dtype=np.int8)
    full = ends > starts
    np.add.at(change, starts[full], 1)
    np.add.at(change, ends[full], -1)
    inside = np.cumsum(change[:-1], dtype=np.int8) > 0
    place = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    buffers = [None, pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()


# Digests of words seen by this worker; most words of a slice were in earlier ones.
_DIGESTS: dict[bytes, bytes] = {}
DIGESTS = 1 << 18


def _digest(word: bytes) -> bytes:
    out = hashlib.blake2b(word, digest_size=16).digest()
    if len(word) <= 64:
        if len(_DIGESTS) >= DIGESTS:
            _DIGESTS.clear()
        _DIGESTS[word] = out
    return out


class Words:
    """Words of consecutive documents in one byte buffer.

    ``doc`` is the document of each word, ``first`` the index of the first word
    of each document (one entry more than documents).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~BLANK[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets[offsets <= n]] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = solid[:-1]
            after[:-1] = solid[1:]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.hashes = span_hashes(data, self.starts, self.ends)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each position (the last k - 1 left out)."""
        m = len(self.starts) - k + 1
        at = np.arange(max(m, 0))
        return span_hashes(self.hashes, at, at + k)

    def ids(self) -> np.ndarray:
        """A number per word that equal words of the buffer share, and only those."""
        return spans_coded(self.data, self.starts, self.ends).indices.to_numpy().astype(np.int64)

    def lanes(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of BLAKE2 per word, as two arrays; the same in every buffer."""
        coded = spans_coded(self.data, self.starts, self.ends)
        raw = b"".join([_DIGESTS.get(w) or _digest(w) for w in coded.dictionary.to_pylist()])
        table, at = np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2), coded.indices.to_numpy()
        return table[at, 0], table[at, 1]

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each position are of one document."""
        m = len(self.starts) - k + 1
        if m <= 0:
            return np.zeros(0, dtype=bool)
        return self.doc[:m] == self.doc[k - 1 :]


def folded(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position, taken in one after the other."""
    n = max(len(values) - k + 1, 0)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mix(out * np.uint64(_BASE) + values[i : i + n])
    return out


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of the spans."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive parts of a text column.

    Null texts count as empty. A part holds about ``limit`` bytes, or one row.
    """
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text, _row): ``_row`` tells rows of one doc_id apart by content.

    Rows that agree in both share their key, and so every result.
    """
    return docs.select("doc_id", text, F.xxhash64("doc_id", text).alias("_row"))


def on_row(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join per-row results back by the key of ``keyed``."""
    marks = right.withColumnsRenamed({"doc_id": "_doc", "_row": "_key"})
    on = left["doc_id"].eqNullSafe(marks["_doc"]) & (left["_row"] == marks["_key"])
    return left.join(marks, on, how).drop("_doc", "_key")


def string_list(values: list[str]) -> pa.Array:
    return pa.array(values, type=pa.string())
