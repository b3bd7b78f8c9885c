"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page id into shards, shards are written as files
that roll at a compressed size, and headers, record ids and digests are made
anew from the rows, so equal input gives equal files. A file is written under a
temporary name and moved to its final one when complete; a manifest, committed
by Spark last, names the files that count. A task that runs again replaces its
files by equal ones.

Of records with equal payloads of at least ``REVISIT_BYTES``, the one with the
largest page id is the response and the others are revisits without payload.
Payloads cross the network once: who revisits whom is found on ids and digests,
and joins the payload in the writer by sort order.

A null html is an empty payload, a null url an empty target. A null page id
sorts first and counts as smaller than any; if several rows share page id and
payload, the first is written in full. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 1_000
# Bytes of payload per shard, and of a compressed file; files a reading task takes.
SHARD_BYTES = 64 << 20
FILE_BYTES = 8 << 20
READ_FILES = 16
# Ids sampled for the range boundaries, and shards at most.
SAMPLE, SHARDS = 8_192, 4_096
DATE = "2024-01-01T00:00:00Z"

# Names of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.NAMESPACE_URL


def boundaries(pages: DataFrame, shards: int, rows: int) -> list[int]:
    """Page ids that start shards 1, 2, ...: quantiles of a fixed sample.

    The sample is the ids with the lowest hashes. Of a large table only a share
    with about four times as many competes, so tasks send few ids to the driver.
    """
    if shards <= 1:
        return []
    h = F.xxhash64("page_id")
    share = max(1, rows // (4 * SAMPLE))
    ids = pages.where(F.col("page_id").isNotNull() & (F.pmod(h, F.lit(share)) == 0)).select("page_id").orderBy(h, "page_id").limit(SAMPLE)
    held = sorted(r[0] for r in ids.collect())
    return sorted({held[len(held) * k // shards] for k in range(1, shards)}) if held else []


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ':'.join(map(str, parts)))}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def page_record(page_id, url: str, payload: bytes, digest: str, refers: tuple | None, ordinal: int) -> bytes:
    """Response, or revisit of the page in ``refers``."""
    shown = "" if page_id is None else str(page_id)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers is None else head
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    name = _urn(shown, digest) if refers is None else _urn(shown, digest, "revisit", ordinal)
    fields = [
        ("WARC-Record-ID", name),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Block-Digest", _sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", shown),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers is not None:
        owner = "" if refers[0] is None else str(refers[0])
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(owner, digest)), ("X-Refers-To-Page", owner)]
    return _record("response" if refers is None else "revisit", fields, block)


class _Roll:
    """Files of one shard, each under a temporary name until it is complete."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.shard, self.limit, self.number = shard, limit, 0
        self.out = None

    def _open(self) -> None:
        self.name = f"part-{self.shard:05d}-{self.number:04d}.warc.gz"
        self.draft = f"{self.root}/_drafts/{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.root}/_drafts", recursive=True)
        self.out = self.fs.open_output_stream(self.draft)
        self.size = self.records = 0
        info = [("WARC-Record-ID", _urn("info", self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self._put(_member(_record("warcinfo", info, b"format: WARC File Format 1.1\r\n")))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def write(self, record: bytes) -> tuple | None:
        """Append; the finished file if this filled one."""
        if self.out is None:
            self._open()
        self._put(_member(record))
        self.records += 1
        return self.close() if self.size >= self.limit else None

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self.draft, f"{self.root}/{self.name}")
        self.out, self.number = None, self.number + 1
        return self.name, self.shard, self.records, self.size


_MANIFEST = "file string, shard int, records long, bytes long"


def _writer(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, done = None, []
        told, owner, wrote, ordinal = None, None, None, 0
        for batch in batches:
            columns = (batch.column(c) for c in ("shard", "page_id", "digest", "kind", "owner", "url", "html"))
            for shard, page, digest, kind, whose, url, html in zip(*columns, strict=True):
                shard, page, digest = shard.as_py(), page.as_py(), digest.as_py()
                if roll is None or roll.shard != shard:
                    done += [roll.close()] if roll else []
                    roll = _Roll(folder, shard, limit)
                if kind.as_py() == 0:
                    told, owner = (page, digest), whose.as_py()
                    continue
                payload = (html.as_py() or "").encode()
                refers = None
                if (page, digest) == told:
                    refers = (owner,)
                elif (page, digest) == wrote and len(payload) >= REVISIT_BYTES:
                    refers = (page,)
                ordinal = ordinal + 1 if (page, digest) == wrote else 0
                wrote = (page, digest)
                done.append(roll.write(page_record(page, url.as_py() or "", payload, digest, refers, ordinal)))
        done += [roll.close()] if roll else []
        rows = [d for d in done if d]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "shard", "records", "bytes"]
        )

    return run


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row (page_id, url, html); the manifest.

    ``folder`` is a URI that every executor reaches.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("digest", F.sha1(html))
    slim = rows.select("page_id", "digest", F.octet_length(html).alias("size"))
    sums = slim.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    shards = min(SHARDS, -(-(sums["bytes"] or 0) // shard_bytes))
    starts = np.array(boundaries(rows, shards, sums["rows"]), dtype=np.int64)

    @F.pandas_udf("int")
    def shard(page_id):
        known = page_id.fillna(np.iinfo(np.int64).min).to_numpy().astype(np.int64)
        return page_id.__class__(np.searchsorted(starts, known, side="right").astype(np.int32))

    large = slim.where(F.col("size") >= REVISIT_BYTES)
    owners = large.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = (
        large.join(owners, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("owner")))
        .select("page_id", "digest", F.lit(0).alias("kind"), "owner", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
        .distinct()
    )
    records = rows.select("page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("owner"), "url", "html")
    manifest = (
        records.unionByName(revisits)
        .withColumn("shard", shard("page_id"))
        .repartition(max(len(starts) + 1, 1), "shard")
        .sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
        .mapInArrow(_writer(folder, file_bytes), _MANIFEST)
    )
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _members(source) -> Iterator[bytes]:
    """Records of a file, one gzip member each, without reading it whole."""
    squeeze, out = zlib.decompressobj(31), []
    rest = b""
    while True:
        data = rest or source.read(1 << 20)
        rest = b""
        if not data:
            break
        out.append(squeeze.decompress(data))
        if squeeze.eof:
            yield b"".join(out)
            rest, out, squeeze = squeeze.unused_data, [], zlib.decompressobj(31)
    if out:
        raise ValueError("archive ends inside a record")


def parse_record(record: bytes) -> tuple[str, dict[str, str], bytes]:
    """(type, fields, block) of one record; its block digest is checked."""
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = body[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or fields.get("WARC-Block-Digest", _sha1(block)) != _sha1(block):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields["WARC-Type"], fields, block


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """Page records of the files in the manifest; payloads only on request.

    Both digests of every record are checked against what it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for record in _members(source):
                        kind, f, block = parse_record(record)
                        if kind not in ("response", "revisit"):
                            continue
                        content = block.partition(b"\r\n\r\n")[2]
                        digest = base64.b32decode(f["WARC-Payload-Digest"][5:]).hex()
                        if kind == "response" and hashlib.sha1(content).hexdigest() != digest:
                            raise ValueError(f"damaged payload {f['WARC-Record-ID']}")
                        page, refers = f["X-Page-Id"], f.get("X-Refers-To-Page", "")
                        rows.append(
                            (
                                int(page) if page else None,
                                f["WARC-Target-URI"],
                                int(f["X-Payload-Length"]),
                                digest,
                                kind,
                                int(refers) if refers else None,
                                content if payload and kind == "response" else None,
                            )
                        )
                        if len(rows) == 1_000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("file")
    # The manifest is tiny, so the number of tasks is stated: no task takes many files.
    count = files.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // READ_FILES))
    return files.repartitionByRange(max(min(count, tasks), 1), "file").mapInArrow(run, _READ)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
