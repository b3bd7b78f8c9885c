"""Dated tables: loading windows of runs, saving, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}")


def read_landed_json(
    spark: SparkSession, path: str, schema: T.StructType, whole_files: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(good rows, issue rows) of landed JSON; a broken document loads as nothing.

    One document per line, or one per file.
    """
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path, wholetext=whole_files).select("value", F.input_file_name().alias("path"))
    parsed = lines.where(F.trim("value") != "").withColumn(
        "_doc", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    )
    broken = F.col("_doc._corrupt_record").isNotNull()
    good = parsed.where(~broken).select(*[F.col(f"_doc.{f.name}").alias(f.name) for f in schema.fields])
    bad = parsed.where(broken).select("path", F.lit("corrupt_json").alias("kind"), F.col("value").alias("detail"))
    return good, bad


def window_of(df: DataFrame, today: str | Column, days: int, run: str = "run_date") -> DataFrame:
    """Runs of the last ``days`` days; the filter prunes partitions."""
    day = F.lit(today).cast("date") if isinstance(today, str) else today
    return df.where(F.col(run) >= F.date_sub(day, days))


def latest_run(df: DataFrame, run: str = "run_date") -> DataFrame:
    """Rows of the newest run only."""
    newest = df.agg(F.max(run).alias(run))
    return df.join(F.broadcast(newest), run, "left_semi")


def run_before(df: DataFrame, date: str, run: str = "run_date") -> DataFrame:
    """Rows of the newest run strictly before a date."""
    return latest_run(df.where(F.col(run) < F.lit(date).cast("date")), run)


def save_runs(df: DataFrame, base: str, name: str, run: str = "run_date") -> None:
    """Write each run to its own partition, replacing that run only."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(run)
        .parquet(f"{base}/{name}")
    )


def retention(df: DataFrame, today: str | Column, keep_days: int = 30, run: str = "run_date") -> tuple[DataFrame, DataFrame]:
    """(rows to keep, dates to drop): runs older than the limit are dropped."""
    day = F.lit(today).cast("date") if isinstance(today, str) else today
    old = F.col(run) < F.date_sub(day, keep_days)
    return df.where(~old), df.where(old).select(run).distinct()


def dump_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
