"""Removal of word sequences that occur more than once in a corpus.

Every window of ``window`` consecutive words that also starts elsewhere is
removed. Stretches that can repeat are dealt to reference shards by content: a
window's anchor is the smallest hash among its k-word grams, so equal windows
have equal anchors, and consecutive windows with one anchor form a run. Runs
whose anchor occurs once cannot repeat. The others are put into a suffix
automaton per anchor; each run is streamed through it, and its matching
statistics tell which windows another run holds too (a run that itself occurs
twice needs none: all its windows do). Words are compared, so hashes only decide
who meets whom.

Equal runs meet as one row with a count, so copies never pile up in a task.
Where the different runs of an anchor are too many words for an automaton
(``AUTOMATON`` bytes), the task sorts their windows instead, ranked by their
words as in a suffix array. Beyond ``CROWD`` bytes they are dealt out: runs fall
into parts by a second anchor, parts that occur once cannot repeat, and the
windows of the others are counted by MD5 in a shuffle. All three ways give the
same result, and no run is left out. The corpus is its own reference, without a
size bound, so shards travel by shuffle and not by broadcast.

Null texts count as empty and keep nothing. Rows that repeat a document count
as occurrences of their own; a null doc_id is a value like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrays import Words, covered, keyed, mix, on_row, ranks, slices, window_names
from newsloom.llm.store import written

WINDOW = 35
GRAM = 8
# Bytes of an anchor's runs that one automaton takes, and that one task takes.
AUTOMATON, CROWD = 128 << 10, 32 << 20
# Seed of the second anchor.
SECOND = 0x5851F42D4C957F2D


class Runs:
    """Runs of windows with one anchor: document, first window, windows, anchor.

    ``places`` is the number of positions at which the anchor stands in a run;
    with more than one, windows of the run itself can be equal.
    """

    def __init__(self, words: Words, window: int, seed: int = 0):
        k = min(GRAM, window)
        grams, reach = mix(words.grams(k) ^ np.uint64(seed)), window - k + 1
        whole = np.flatnonzero(words.inside(window))
        if not len(whole):
            self.doc = self.start = self.windows = self.places = np.zeros(0, dtype=np.int64)
            self.anchor = np.zeros(0, dtype=np.int64)
            return
        least = np.lib.stride_tricks.sliding_window_view(grams, reach)[: len(words.starts) - window + 1]
        at = whole + least.argmin(axis=1)[whole]
        doc, anchor = words.doc[whole], grams[at]
        moved = np.diff(at, prepend=-1) != 0
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(fresh)
        self.doc = doc[head]
        self.start = whole[head] - words.first[self.doc]
        self.windows = np.diff(np.append(head, len(whole)))
        self.places = np.add.reduceat((moved | fresh).astype(np.int64), head)
        self.anchor = anchor[head].astype(np.int64)


class SuffixAutomaton:
    """Suffix automaton of several texts with the occurrences of each substring."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.times = [0]

    def add(self, text: list, times: int) -> None:
        """Take in a text that occurs so many times."""
        last = 0
        for c in text:
            last = self._extend(last, c)
            self.times[last] += times

    def close(self) -> None:
        """Pass occurrences on to shorter substrings; no text can follow."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.times[self.link[s]] += self.times[s]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.times.append(0)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        """State for the substrings of q that also end after p and c."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, c) -> int:
        q = self.next[p].get(c)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        new = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def repeated(self, text: list, size: int) -> list[int]:
        """Starts of the substrings of a size that occur at least twice.

        The text is streamed through; its matching statistics are cut to the size.
        """
        out, state, match = [], 0, 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                match = self.length[state]
            if c in self.next[state]:
                state, match = self.next[state][c], match + 1
            while self.link[state] >= 0 and self.length[self.link[state]] >= size:
                state = self.link[state]
                match = self.length[state]
            if match >= size and self.times[state] >= 2:
                out.append(i - size + 1)
        return out


def _spans(starts: list[int]) -> list[int]:
    """Consecutive starts as flat (first, end) pairs."""
    out: list[int] = []
    for s in starts:
        if out and out[-1] == s:
            out[-1] = s + 1
        else:
            out += [s, s + 1]
    return out


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                runs = Runs(Words(data, offsets), window)
                yield pa.RecordBatch.from_arrays([pa.array(runs.anchor), pa.array(runs.places)], ["anchor", "places"])

    return run


def _places(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in slices(batch.column("text")):
                runs = Runs(Words(data, offsets), window)
                row = pa.array(runs.doc + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(runs.anchor),
                        batch.column("doc_id").take(row),
                        batch.column("_row").take(row),
                        pa.array(runs.start.astype(np.int32)),
                    ],
                    ["anchor", "doc_id", "_row", "start"],
                )

    return run


def _kept(words: list[bytes], gone: np.ndarray, digest: bool) -> str:
    text = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
    return hashlib.sha256(text).hexdigest() if digest else text.decode()


def _settle(digest: bool):
    """Finish documents without a suspect run; keep the text of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            suspect = batch.column("starts").is_valid().to_numpy(zero_copy_only=False)
            for a, b, data, offsets in slices(batch.column("text")):
                raw = data.tobytes()
                n, kept = [], []
                for i in range(b - a):
                    words = raw[offsets[i] : offsets[i + 1]].split()
                    n.append(len(words))
                    kept.append(None if suspect[a + i] else _kept(words, np.zeros(len(words), dtype=bool), digest))
                column = batch.column("text").slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("_row").slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(kept, pa.string()),
                        pa.array(np.where(suspect[a:b], column.to_numpy(zero_copy_only=False), None), pa.string()),
                        batch.column("starts").slice(a, b - a),
                    ],
                    ["doc_id", "_row", "n_words", "kept", "text", "starts"],
                )

    return run


def _suspects(window: int, content: bool):
    """Suspect runs of the documents, with their words or without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("starts")
            for a, b, data, offsets in slices(batch.column("text")):
                runs = Runs(Words(data, offsets), window)
                part = lists.slice(a, b - a)
                owner = np.repeat(np.arange(b - a), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                wanted = (owner << 32) | part.flatten().to_numpy().astype(np.int64)
                pick = np.flatnonzero(np.isin((runs.doc << 32) | runs.start, wanted))
                raw, last, words = data.tobytes(), -1, []
                texts, keys = [], []
                for d, s, n in zip(runs.doc[pick].tolist(), runs.start[pick].tolist(), runs.windows[pick].tolist(), strict=True):
                    if d != last:
                        words, last = raw[offsets[d] : offsets[d + 1]].split(), d
                    text = b" ".join(words[s : s + n + window - 1])
                    keys.append(hashlib.md5(text).digest())
                    if content:
                        texts.append(text)
                row = pa.array(runs.doc[pick] + a)
                columns = [pa.array(runs.anchor[pick]), pa.array(keys, pa.binary())]
                names = ["anchor", "run"]
                if content:
                    columns, names = [*columns, pa.array(texts, pa.binary())], [*names, "words"]
                else:
                    columns += [batch.column("doc_id").take(row), batch.column("_row").take(row), pa.array(runs.start[pick].astype(np.int32))]
                    names += ["doc_id", "_row", "start"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def by_automaton(group: list[tuple[bytes, int, bytes]], window: int) -> Iterator[tuple[bytes, list[int]]]:
    """Starts of the repeated windows of each run (key, count, words)."""
    texts = [words.split(b" ") for _, _, words in group]
    automaton = None
    if any(n == 1 for _, n, _ in group):
        automaton = SuffixAutomaton()
        for (_, n, _), t in zip(group, texts, strict=True):
            automaton.add(t, n)
        automaton.close()
    for (key, n, _), t in zip(group, texts, strict=True):
        # All windows of a run that occurs twice do so too.
        yield key, list(range(len(t) - window + 1)) if n > 1 else automaton.repeated(t, window)


def by_count(group: list[tuple[bytes, int, bytes]], window: int) -> Iterator[tuple[bytes, list[int]]]:
    """The same by sorting: windows are named by ranks of their words, not by hashes."""
    offsets = np.cumsum([0, *(len(words) for _, _, words in group)])
    w = Words(np.frombuffer(b"".join(words for _, _, words in group), dtype=np.uint8), offsets)
    at = np.flatnonzero(w.inside(window))
    name = ranks(window_names(w.ids(), window)[at])
    times = np.array([n for _, n, _ in group])[w.doc[at]]
    hit = at[(np.bincount(name, weights=times) >= 2)[name]]
    ends = np.searchsorted(hit, w.first)
    for i, (key, _, _) in enumerate(group):
        yield key, (hit[ends[i] : ends[i + 1]] - w.first[i]).tolist()


def _match(window: int):
    """Repeated windows per run; rows come sorted by anchor."""

    def verdicts(group: list[tuple[bytes, int, bytes]]) -> Iterator[tuple[bytes, list[int]]]:
        way = by_automaton if sum(len(words) for _, _, words in group) <= AUTOMATON else by_count
        for key, starts in way(group, window):
            if starts:
                yield key, _spans(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.binary()),
                    pa.array([x[2] for x in out], pa.list_(pa.int32())),
                ],
                ["anchor", "run", "spans"],
            )
            out.clear()
            return batch

        for batch in batches:
            for anchor, key, n, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "run", "n", "words")), strict=True):
                if anchor != now and group:
                    out += [(now, *v) for v in verdicts(group)]
                    group = []
                now = anchor
                group.append((key, n, words))
            if len(out) > 10_000:
                yield flush()
        if group:
            out += [(now, *v) for v in verdicts(group)]
        yield flush()

    return run


def _parts(window: int):
    """Parts of runs by a second anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in slices(batch.column("words")):
                parts = Runs(Words(data, offsets), window, SECOND)
                row = pa.array(parts.doc + a)
                n = batch.column("n").take(row).to_numpy() * parts.places
                columns = [batch.column(c).take(row) for c in ("anchor", "run")]
                columns += [pa.array(v) for v in (n, parts.anchor, parts.start, parts.windows)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "run", "n", "second", "start", "windows"])

    return run


def _windows(window: int):
    """Distinct windows in the given parts of runs, with their places."""

    def flush(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "run", "n", "at", "window"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, key, n, text, parts in zip(*(batch.column(c).to_pylist() for c in ("anchor", "run", "n", "words", "parts")), strict=True):
                words, found = text.split(b" "), {}
                for part in parts:
                    for i in range(part["start"], part["start"] + part["windows"]):
                        found.setdefault(hashlib.md5(b" ".join(words[i : i + window])).digest(), []).append(i)
                rows += [(anchor, key, n * len(at), at, digest) for digest, at in found.items()]
                if len(rows) > 20_000:
                    yield flush(rows)
                    rows = []
            yield flush(rows)

    return run


def repeated_windows(runs: DataFrame, window: int) -> DataFrame:
    """(anchor, run, spans): windows of each run that occur elsewhere too.

    ``runs`` has one row per (anchor, run) with its words and its count ``n``.
    """
    wide = runs.groupBy("anchor").agg(F.sum(F.octet_length("words")).alias("bytes")).where(F.col("bytes") > CROWD).select("anchor")
    narrow = (
        runs.join(wide, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "run")
    )
    matched = narrow.mapInArrow(_match(window), "anchor long, run binary, spans array<int>")
    crowded = runs.join(wide, "anchor", "left_semi")
    parts = crowded.select("anchor", "run", "n", "words").mapInArrow(
        _parts(window), "anchor long, run binary, n long, second long, start long, windows long"
    )
    twice = parts.groupBy("anchor", "second").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "second")
    suspect = (
        parts.join(twice, ["anchor", "second"], "left_semi")
        .groupBy("anchor", "run")
        .agg(F.collect_list(F.struct("start", "windows")).alias("parts"))
    )
    single = crowded.join(suspect, ["anchor", "run"]).select("anchor", "run", "n", "words", "parts").mapInArrow(
        _windows(window), "anchor long, run binary, n long, at array<int>, window binary"
    )
    often = single.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window")
    counted = (
        single.join(often, "window", "left_semi")
        .groupBy("anchor", "run")
        .agg(F.flatten(F.transform(F.array_sort(F.flatten(F.collect_list("at"))), lambda i: F.array(i, i + 1))).alias("spans"))
    )
    return matched.unionByName(counted)


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row; ``kept`` are the words left.

    Kept words are joined by one space; with ``digest`` only the SHA-256 of that
    text is carried.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long"), "text"))
    often = (
        rows.select("text")
        .mapInArrow(_anchors(window), "anchor long, places long")
        .groupBy("anchor")
        .agg(F.sum("places").alias("places"))
        .where("places > 1")
        .select("anchor")
    )
    starts = (
        rows.mapInArrow(_places(window), "anchor long, doc_id long, _row long, start int")
        .join(often, "anchor", "left_semi")
        .groupBy("doc_id", "_row")
        .agg(F.collect_set("start").alias("starts"))
    )
    settled = written(
        on_row(rows, starts).mapInArrow(
            _settle(digest), "doc_id long, _row long, n_words long, kept string, text string, starts array<int>"
        ),
        "substring-documents",
    )
    open_docs = settled.where(F.col("starts").isNotNull()).select("doc_id", "_row", "text", "starts")
    runs = written(
        open_docs.mapInArrow(_suspects(window, True), "anchor long, run binary, words binary")
        .groupBy("anchor", "run")
        .agg(F.count(F.lit(1)).alias("n"), F.any_value("words").alias("words")),
        "substring-runs",
    )
    hits = repeated_windows(runs, window)
    gone = (
        open_docs.mapInArrow(_suspects(window, False), "anchor long, run binary, doc_id long, _row long, start int")
        .join(hits, ["anchor", "run"])
        .groupBy("doc_id", "_row")
        .agg(F.flatten(F.collect_set(F.transform("spans", lambda s: s + F.col("start")))).alias("gone"))
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, kept, n, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "kept", "n_words", "gone")), strict=True):
                if kept is None:
                    words = (text or "").encode().split()
                    pairs = np.array(spans or [], dtype=np.int64).reshape(-1, 2)
                    removed = covered(len(words), pairs[:, 0], pairs[:, 1] + window - 1)
                    out.append((doc, n, int(removed.sum()), _kept(words, removed, digest)))
                else:
                    out.append((doc, n, 0, kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "n_words", "n_removed", "kept"]
            )

    result = "doc_id long, n_words long, n_removed long, kept string"
    closed = settled.where(F.col("starts").isNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    opened = on_row(settled.where(F.col("starts").isNotNull()), gone).select("doc_id", "text", "kept", "n_words", "gone")
    return closed.unionByName(opened.mapInArrow(finish, result))
