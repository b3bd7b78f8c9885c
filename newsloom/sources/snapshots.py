"""Saved runs as snapshots: a save appears whole or not at all.

A save writes its rows into a folder of its own, then publishes a manifest version
that names, for every live run, the folder that holds it. Earlier versions stay
readable until they are vacuumed. A manifest has one row per live run, so its size
follows the calendar. Two saves at once both succeed: the later one to publish
builds on the other's version and replaces only its own runs.

The folder must be on a file system that all executors share and whose rename does
not replace a file (HDFS), or on a local or network disk, where a hard link claims
the version; object stores offer neither.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "run date, save string"
# A save that loses so many races in a row gives up.
TRIES = 50


class Snapshots:
    """Runs of one table. ``schema`` includes the run column, a date."""

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, run: str = "run_date"):
        self.spark, self.base, self.run = spark, base.rstrip("/"), run
        self.schema = schema
        if "save" in schema.names or run not in schema.names:
            raise ValueError(f"the table needs a column {run}, and none named save")
        own = [f for f in schema.fields if f.name != run]
        self._stored = T.StructType([*own, T.StructField("save", T.StringType()), T.StructField(run, T.DateType())])

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._files(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        names = self._names(f"{self.base}/manifest")
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[dt.date, str]:
        """Save that holds each live run, as of a version (the newest by default)."""
        known = self.versions()
        if version is None and not known:
            return {}
        at = known[-1] if version is None else version
        if at not in known:
            raise ValueError(f"version {at} of {self.base} does not exist")
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.base}/manifest/v{at}.json").collect()
        return {r.run: r.save for r in rows}

    def _claim(self, runs: dict[dt.date, str], version: int) -> bool:
        """Publish a version unless another writer has."""
        draft, fs = self._files(f"{self.base}/manifest/draft-{uuid.uuid4().hex}")
        final, _ = self._files(f"{self.base}/manifest/v{version}.json")
        out = fs.create(draft)
        out.write(bytearray("".join(json.dumps({"run": str(r), "save": s}) + "\n" for r, s in sorted(runs.items())).encode()))
        out.close()
        if fs.getScheme() != "file":
            done = not fs.exists(final) and fs.rename(draft, final)
        else:
            # A rename on a disk replaces; a link does not.
            try:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
        if fs.exists(draft):
            fs.delete(draft, False)
        return done

    def _publish(self, change: Callable[[dict[dt.date, str]], dict[dt.date, str]]) -> int:
        for _ in range(TRIES):
            known = self.versions()
            before = self.manifest(known[-1]) if known else {}
            version = known[-1] + 1 if known else 0
            if self._claim(change(before), version):
                return version
        raise RuntimeError(f"{self.base}: other writers published {TRIES} times in between")

    def save(self, rows: DataFrame) -> int:
        """Replace the runs that ``rows`` holds, all at once; the version that shows them.

        Rows without a run date are an error, and nothing is published. A table
        without rows publishes a version that changes nothing.
        """
        token = uuid.uuid4().hex
        folder = f"{self.base}/data/save={token}"
        kept = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        # Rebalancing gives a run few files, and a large run more than one task.
        kept.hint("rebalance", F.col(self.run)).write.partitionBy(self.run).parquet(folder)
        saved = [n.split("=", 1)[1] for n in self._names(folder) if n.startswith(f"{self.run}=")]
        if "__HIVE_DEFAULT_PARTITION__" in saved:
            raise ValueError(f"rows without {self.run}")
        fresh = {dt.date.fromisoformat(s): token for s in saved}
        return self._publish(lambda before: before | fresh)

    def retire(self, oldest: dt.date) -> int:
        """A version without the runs before a date; their rows stay until a vacuum."""
        return self._publish(lambda before: {r: s for r, s in before.items() if r >= oldest})

    def _rows(self, runs: dict[dt.date, str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.base}/data/save={s}/{self.run}={r}" for r, s in sorted(runs.items())]
        held = self.spark.read.schema(self._stored).option("basePath", f"{self.base}/data").parquet(*paths)
        return held.select(*self.schema.names)

    def read(self, version: int | None = None, where: Callable[[dt.date], bool] = lambda _: True) -> DataFrame:
        """Rows of the live runs, of those that pass ``where``; other runs are not even listed."""
        return self._rows({r: s for r, s in self.manifest(version).items() if where(r)})

    def before(self, date: dt.date, version: int | None = None) -> DataFrame:
        """Rows of the newest run strictly before a date."""
        earlier = [r for r in self.manifest(version) if r < date]
        return self.read(version, lambda r: r == max(earlier)) if earlier else self._rows({})

    def history(self) -> DataFrame:
        """(version, run, save) of every version there is."""
        path = F.input_file_name()
        version: Column = F.regexp_extract(path, r"v(\d+)\.json$", 1).cast("long")
        if not self.versions():
            return self.spark.createDataFrame([], f"version long, {_MANIFEST}")
        files = [f"{self.base}/manifest/v{v}.json" for v in self.versions()]
        return self.spark.read.schema(_MANIFEST).json(files).select(version.alias("version"), "run", "save")

    def vacuum(self, keep: int = 1, age_hours: float = 24.0) -> int:
        """Delete all but the newest versions, then runs that no version names; runs deleted.

        Folders younger than ``age_hours`` may belong to a save about to publish and
        stay. Readers of a deleted version fail; keep as many as are in use.
        """
        known = self.versions()
        live = {(s, r) for v in known[-keep:] for r, s in self.manifest(v).items()}
        for v in known[:-keep]:
            path, fs = self._files(f"{self.base}/manifest/v{v}.json")
            fs.delete(path, False)
        root, fs = self._files(f"{self.base}/data")
        limit = dt.datetime.now().timestamp() * 1000 - age_hours * 3_600_000
        gone = 0
        for save in fs.listStatus(root) if fs.exists(root) else ():
            if save.getModificationTime() > limit:
                continue
            token, runs = save.getPath().getName().split("=", 1)[1], 0
            for s in fs.listStatus(save.getPath()):
                name = s.getPath().getName()
                if name.startswith(f"{self.run}="):
                    if (token, dt.date.fromisoformat(name.split("=", 1)[1])) in live:
                        runs += 1
                    else:
                        fs.delete(s.getPath(), True)
                        gone += 1
            if not runs:
                fs.delete(save.getPath(), True)
        return gone
