"""Written tables between steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder in ``spark.checkpoint.dir``; a temporary one only where unset.

    The temporary folder serves tests on one machine; on a cluster the setting
    must name a folder that all executors reach.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="newsloom-shared-"))
    return spark.sparkContext.getCheckpointDir()


def fresh(spark: SparkSession, what: str) -> str:
    """New path in the shared folder."""
    return f"{shared_dir(spark)}/newsloom/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows, written once as Parquet and read again.

    It cuts the lineage, survives lost executors, and is computed once however
    often it is read. Clearing the folder is up to its owner.
    """
    spark = df.sparkSession
    path = fresh(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lowest_hashes(table: DataFrame, count: int, rows: int) -> list[Row]:
    """(id, vector) of the ``rows`` rows with the lowest hashes; ``count``: rows of the table.

    A limit on the hash first leaves a few times ``rows``, and the rows are chosen
    by a task, so that the driver gets no more than ``rows`` however many partitions
    there are. Where copies share few hashes, the whole table is looked at.
    """
    order = [F.xxhash64("id", "vector"), "id", "vector"]

    def pick(some: DataFrame) -> list[Row]:
        return written(some.orderBy(*order).limit(rows), "lowest-hashes").orderBy(*order).collect()

    table = table.select("id", "vector")
    share = 4 * rows / max(count, 1)
    if share < 1:
        found = pick(table.where(order[0] < F.lit(min(int(2.0**64 * share) - 2**63, 2**63 - 1))))
        if len(found) == rows:
            return found
    return pick(table)


def bucketed(df: DataFrame, what: str, column: str) -> DataFrame:
    """The rows, written once in buckets of a column.

    There are as many buckets as shuffle partitions, so that a join on the column
    reads them in place while only the other side is shuffled.
    """
    spark = df.sparkSession
    name = f"newsloom_{uuid.uuid4().hex}"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").option("path", fresh(spark, what))
    writer.bucketBy(count, column).saveAsTable(name)
    return spark.table(name)
