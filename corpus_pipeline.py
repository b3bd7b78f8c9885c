"""From documents to tokens in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
``run`` writes a stage's rows as Parquet and reads them again as the next one's
documents. All stages but the last return the columns of documents.

Columns beside those of documents are not carried along. Of rows that agree in id
and text one stays where one is to stay. A null text is an empty one: it is not
toxic, has no near duplicate, secret or word, and so leaves with the mixing, as
all documents without words do when their source takes no whole copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import bpe, jaccard, mixing, secrets, toxicity
from newsloom.llm.store import fresh

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY = ["_id", "_none", "_row"]


def _keyed(df: DataFrame) -> DataFrame:
    """Plain join columns for a row key with a nullable id."""
    return df.withColumns({"_id": F.coalesce("doc_id", F.lit(0)).cast("long"), "_none": F.col("doc_id").isNull()})


def _first_of(rows: DataFrame) -> DataFrame:
    """One row per key; the join before has brought a key's rows together."""
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy(*KEY))
    return rows.withColumn("_n", number).where("_n = 1").drop("_n")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger predicts toxic go."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels.where(~toxicity.fold())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    kept = _keyed(jaccard.near_duplicates(docs).where("leads")).select(*KEY).distinct()
    rows = _keyed(docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_row")))
    return _first_of(rows.join(kept, KEY, "left_semi")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark."""
    found = secrets.scan(docs.select(*COLUMNS))
    marks = F.array_sort(F.concat("base", "added"))
    clean = found.withColumn("text", secrets.redact(F.col("text"), marks))
    return clean.withColumn(
        "n_chars", F.when(F.size(marks) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources reach their weights."""
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_row"))
    mixed = mixing.mix(keyed, keep=["_row"]).where("copies > 0")
    copies = _keyed(mixed).groupBy(*KEY).agg(F.sum("copies").alias("_copies"))
    rows = _first_of(_keyed(keyed).join(copies, KEY))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("source mix", mix_sources),
    ("byte-level BPE", encode_texts),
]

# The stages are models, minhash joins and hash sampling, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
