"""Article cache as a log of runs, so that a batch costs its own size.

A batch is appended as one run: its newest entry per URL, in hash buckets, beside
removals. Runs are folded together once the newer ones hold as many rows as an
older one, so there are about log2 of the batches of them, and a row is rewritten
that often at most. A manifest version lists the live runs; it is one small file
that appears by a rename after its runs are complete, so readers see the cache
before or after a batch, never between. A batch that is replayed after a failure
is recognised by its number and changes nothing.

A removal stays as a row, so that an older entry that arrives late stays removed. A
fold that includes the oldest run drops entries and removals before a given limit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.ranking import top_per_group

BUCKETS = 8
_MANIFEST = "run string, first long, last long, rows long"
_OWN = [T.StructField("_batch", T.LongType()), T.StructField("_removed", T.BooleanType())]


def newest_by(key: str, order: str) -> Callable[[DataFrame], DataFrame]:
    """The newest row per key; of equal times the one of the later batch."""
    return lambda rows: top_per_group(rows, [key], [F.desc(order), F.desc("_batch"), F.desc("_removed")], 1)


class CacheLog:
    """Entries by ``key`` in a folder that all executors share."""

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, key: str = "url", order: str = "fetched_at"):
        self.spark, self.base, self.key, self.order = spark, base.rstrip("/"), key, order
        self.schema = schema
        self._stored = T.StructType([*schema.fields, *_OWN, T.StructField("bucket", T.IntegerType())])
        self._newest = newest_by(key, order)
        # Versions never change, so each is read once.
        self._read: dict[int, list[dict]] = {}

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._files(f"{self.base}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def runs(self, version: int | None = None) -> list[dict]:
        """Live runs of a version (the newest by default), the oldest first."""
        known = self.versions()
        if not known:
            return []
        at = known[-1] if version is None else version
        if at not in self._read:
            rows = self.spark.read.schema(_MANIFEST).json(f"{self.base}/manifest/v{at}.json").collect()
            self._read[at] = sorted((r.asDict() for r in rows), key=lambda r: r["first"])
        return list(self._read[at])

    def _publish(self, runs: list[dict], version: int) -> None:
        """A new version, by renaming a whole file; of two writers one fails."""
        draft, fs = self._files(f"{self.base}/manifest/draft-{uuid.uuid4().hex}")
        final, _ = self._files(f"{self.base}/manifest/v{version}.json")
        out = fs.create(draft)
        out.write(bytearray("".join(json.dumps(r) + "\n" for r in runs).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.base} was published by another writer")
        self._read[version] = runs

    def _write(self, rows: DataFrame, first: int, last: int) -> dict:
        run = f"run-{first}-{last}-{uuid.uuid4().hex[:8]}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int")
        written = Observation()
        dealt = rows.withColumn("bucket", bucket).repartition("bucket").observe(written, F.count(F.lit(1)).alias("rows"))
        dealt.write.partitionBy("bucket").parquet(f"{self.base}/{run}")
        return {"run": run, "first": first, "last": last, "rows": written.get["rows"]}

    def _rows(self, runs: list[str]) -> DataFrame:
        parts = [self.spark.read.schema(self._stored).parquet(f"{self.base}/{r}") for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def append(self, batch: DataFrame, number: int, removed: DataFrame | None = None, oldest=None) -> list[dict]:
        """Take in a batch of entries and removals (key, order); live runs after it.

        ``oldest`` is the time before which rows are dropped when a fold reaches the
        oldest run; readers filter by their own limit (``cache_prune``).
        """
        runs, known = self.runs(), self.versions()
        if runs and runs[-1]["last"] >= number:
            return runs
        fresh = batch.select(*self.schema.names).withColumns({"_batch": F.lit(number).cast("long"), "_removed": F.lit(False)})
        if removed is not None:
            gone = removed.select(self.key, self.order).withColumns({"_batch": F.lit(number).cast("long"), "_removed": F.lit(True)})
            fresh = fresh.unionByName(gone, allowMissingColumns=True)
        runs = [*runs, self._write(self._newest(fresh), number, number)]
        fold = next((i for i in range(len(runs) - 1) if runs[i]["rows"] < sum(r["rows"] for r in runs[i + 1 :])), None)
        if fold is not None:
            rows = self._newest(self._rows([r["run"] for r in runs[fold:]]).drop("bucket"))
            if fold == 0 and oldest is not None:
                rows = rows.where(F.col(self.order) >= F.lit(oldest))
            runs = [*runs[:fold], self._write(rows, runs[fold]["first"], number)]
        self._publish(runs, known[-1] + 1 if known else 0)
        return runs

    def read(self, version: int | None = None) -> DataFrame:
        """Newest entry per key, as of a version (the newest by default)."""
        runs = self.runs(version)
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        rows = self._newest(self._rows([r["run"] for r in runs]))
        return rows.where(~F.col("_removed")).select(*self.schema.names)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Newest entries of a set of keys; only their buckets are read."""
        asked = keys.select(self.key).distinct().withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int"))
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        held = self._rows([r["run"] for r in runs]).join(asked, ["bucket", self.key], "left_semi")
        return self._newest(held).where(~F.col("_removed")).select(*self.schema.names)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the newest versions and the runs that only they had; folders deleted.

        Readers of a version that is deleted fail; keep as many as are in use.
        """
        known = self.versions()
        live = {r["run"] for v in known[-keep:] for r in self.runs(v)}
        path, fs = self._files(self.base)
        if not known:
            return 0
        newest = max(r["last"] for r in self.runs())
        dead = [self._files(f"{self.base}/manifest/v{v}.json")[0] for v in known[:-keep]]
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            # A run of a later batch may belong to a version about to appear.
            if name.startswith("run-") and name not in live and int(name.split("-")[2]) <= newest:
                dead.append(s.getPath())
        for p in dead:
            fs.delete(p, True)
        return len(dead)
