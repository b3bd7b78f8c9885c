"""Landed payload archives as a data source, for batches and streams.

``spark.read.format("payload_archive").load(folder)`` reads files of JSON lines,
plain or gzipped (``.gz``); plain files are read in stretches of ``stretch`` bytes,
each line by the stretch that it begins in. A line is a row if it is an object with
the columns of the given schema; else it is an issue row, whose ``issue`` says why
and whose ``payload`` is the line. A gzipped file that breaks off gives the rows
before the break and one issue row; lines of blanks are none. ``file`` and ``line_at`` (the byte where the line
begins, uncompressed) tell where a row is from.

As a stream, files are taken in the order of their names, so a file must have a
name above all earlier ones and appear whole, by a rename. Names that begin with a
dot or an underscore are passed over. The offset is a name: a restart goes on after
the last file of the last finished batch, and reads a batch that was cut off again.
With the ``availableNow`` trigger Spark runs one batch of such a source at a time: a
run after a failure repeats the failed batch, the run after that takes newer files.

Register it once per session: ``spark.dataSource.register(PayloadArchive)``.
"""

from __future__ import annotations

import datetime as dt
import gzip
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "run_date date, source string, payload string, issue string, file string, line_at bigint"
_OWN = ("issue", "file", "line_at")
STRETCH = 32 << 20
# Rows and bytes of a batch handed to Spark.
BATCH_ROWS, BATCH_BYTES = 4_096, 16 << 20


class Stretch(InputPartition):
    def __init__(self, path: str, begin: int, end: int | None):
        self.path, self.begin, self.end = path, begin, end


def _lines(f, begin: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [begin, end)."""
    at = begin
    if begin:
        # The line that runs into this stretch belongs to the one before.
        f.seek(begin - 1)
        at = begin - 1 + len(f.readline())
    while end is None or at < end:
        line = f.readline()
        if not line:
            return
        yield at, line
        at += len(line)


def _as_date(value) -> dt.date | None:
    try:
        return None if value is None else dt.date.fromisoformat(value)
    except (TypeError, ValueError):
        raise TypeError("not a date") from None


def _as_text(value) -> str | None:
    if value is not None and not isinstance(value, str):
        raise TypeError("not a text")
    # Half of a surrogate pair has no UTF-8 form; it becomes a question mark.
    return None if value is None else value.encode("utf-8", "replace").decode()


def _as_whole(value) -> int | None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or not -(2**63) <= value < 2**63):
        raise TypeError("not a whole number")
    return value


def _as_number(value) -> float | None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float))):
        raise TypeError("not a number")
    try:
        return None if value is None else float(value)
    except OverflowError:
        raise TypeError("not a number") from None


# Types that a column of an archive may have.
_KINDS = {
    "string": (pa.string(), _as_text),
    "date": (pa.date32(), _as_date),
    "bigint": (pa.int64(), _as_whole),
    "double": (pa.float64(), _as_number),
}


class _Files:
    """What batch and stream have in common."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        odd = [f"{n} {k}" for n, k in self.columns if k not in _KINDS]
        if odd:
            raise ValueError(f"an archive has no columns of the type of {', '.join(odd)}")
        self.folder = options["path"].rstrip("/")
        self.stretch = int(options.get("stretch", STRETCH))

    def _system(self) -> tuple[pyarrow.fs.FileSystem, str]:
        if ":" not in self.folder:
            return pyarrow.fs.LocalFileSystem(), self.folder
        # Spark also writes file:/a/b, with one slash.
        head, rest = self.folder.split(":", 1)
        return pyarrow.fs.FileSystem.from_uri(self.folder if rest.startswith("//") else f"{head}://{rest}")

    def _landed(self) -> list[pyarrow.fs.FileInfo]:
        fs, root = self._system()
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
        files = [x for x in found if x.is_file and x.size and x.base_name[0] not in "._"]
        return sorted(files, key=lambda x: x.base_name)

    def _stretches(self, files) -> list[Stretch]:
        out = []
        for x in files:
            if x.base_name.endswith(".gz"):
                out.append(Stretch(x.path, 0, None))
            else:
                out += [Stretch(x.path, b, min(b + self.stretch, x.size)) for b in range(0, x.size, self.stretch)]
        return out

    def _row(self, at: int, line: bytes, name: str) -> tuple:
        where = {"file": name, "line_at": at}
        try:
            doc = json.loads(line)
            if not isinstance(doc, dict):
                raise TypeError("not an object")
            return tuple(where.get(n) if n in _OWN else _KINDS[k][1](doc.get(n)) for n, k in self.columns)
        except UnicodeDecodeError:
            issue = "not UTF-8"
        except TypeError as e:
            issue = str(e)
        except (ValueError, RecursionError):
            issue = "corrupt_json"
        where |= {"issue": issue, "payload": line.decode("utf-8", "replace").rstrip("\r\n")}
        return tuple(where.get(n) for n, _ in self.columns)

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            # Spark's one partition of a folder without files.
            return
        fs, _ = self._system()
        name = partition.path.rsplit("/", 1)[-1]
        kinds = pa.schema([(n, _KINDS[k][0]) for n, k in self.columns])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

        with fs.open_input_file(partition.path) as raw:
            f = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
            rows, size = [], 0
            try:
                for at, line in _lines(f, partition.begin, partition.end):
                    if line.strip():
                        rows.append(self._row(at, line, name))
                        size += len(line)
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
            except (EOFError, zlib.error, gzip.BadGzipFile):
                damage = {"issue": "damaged file", "file": name}
                rows.append(tuple(damage.get(n) for n, _ in self.columns))
            if rows:
                yield batch(rows)


class ArchiveReader(_Files, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        return self._stretches(self._landed())


class ArchiveStream(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        files = self._landed()
        return {"file": files[-1].base_name if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return self._stretches(x for x in self._landed() if start["file"] < x.base_name <= end["file"])

    def commit(self, end: dict) -> None:
        """Files stay; clearing them is up to the owner of the folder."""


class PayloadArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payload_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, self.options)

    def streamReader(self, schema: StructType) -> ArchiveStream:
        return ArchiveStream(schema, self.options)
