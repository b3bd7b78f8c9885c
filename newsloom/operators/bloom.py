"""Bloom filters as tables, to keep unknown keys out of a join.

A filter is rows (block, words): a key sets its bits in one block, so filters are
built by a grouped aggregation, combined per task, and filters of several runs are
merged block by block. Probing looks up one block per key. A filter that fits
``LIMIT`` bytes is broadcast, so the probing rows are not shuffled; there is no
larger one, callers then join without.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.urls import canonical_url
from newsloom.operators.joins import known_index, mark_known
from newsloom.session import cut

# Bits of a block (as Spark's bitmap functions have them), bits per key, hashes.
BLOCK, PER_KEY, HASHES = 32_768, 16, 6
LIMIT = 64 << 20


def blocks_for(keys: int) -> int:
    return max(1, -(-keys * PER_KEY // BLOCK))


def fits(keys: int) -> bool:
    return blocks_for(keys) * BLOCK // 8 <= LIMIT


def _places(key: Sequence[Column], blocks: int) -> tuple[Column, Column]:
    """(block, bit positions) of a key; the positions step through the block."""
    first, second = F.xxhash64(*key), F.xxhash64(*key, F.lit("step"))
    step = second.bitwiseOR(F.lit(1))
    bits = [F.pmod(F.shiftright(first, 20) + F.lit(i) * F.shiftright(step, 16), F.lit(BLOCK)) for i in range(HASHES)]
    return F.pmod(second, F.lit(blocks)).cast("int"), F.array(*bits)


def build(keys: DataFrame, key: Sequence[Column], blocks: int) -> DataFrame:
    """(block, bits) of the keys; null keys are like any other."""
    block, bits = _places(key, blocks)
    return keys.select(block.alias("block"), F.explode(bits).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merge(filters: Sequence[DataFrame]) -> DataFrame:
    """One filter for the keys of all; all have the same number of blocks."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def _words(bits: Column) -> Column:
    """The bitmap as longs, so that a bit is found without copying bytes."""
    word = lambda i: F.conv(F.hex(F.substring(bits, i * 8 + 1, 8)), 16, -10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)), word)


def probe(df: DataFrame, bits: DataFrame, key: Sequence[Column], blocks: int, name: str) -> DataFrame:
    """``df`` with ``name``: false only if the key is in none of the filter's runs."""
    block, places = _places(key, blocks)
    table = F.broadcast(bits.select(F.col("block").alias("_block"), _words(F.col("bits")).alias("_words")))

    def is_set(p: Column) -> Column:
        byte = F.shiftright(p, 3)
        shift = (7 - byte % 8) * 8 + p % 8
        word = F.get(F.col("_words"), F.shiftright(byte, 3).cast("int"))
        return F.call_function("shiftright", word, shift.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    hit = F.col("_words").isNotNull() & F.forall(places, is_set)
    return df.withColumn("_block", block).join(table, "_block", "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop("_block", "_words")


def known_filter(index: DataFrame, blocks: int, key: str = "run_date") -> DataFrame:
    """Filter over (run, URL) and (run, comparison form) of a ``known_index``."""
    forms = index.select(key, F.explode(F.array("url", "canonical")).alias("form")).where("form <> ''")
    return build(forms, [F.col(key), F.col("form")], blocks)


def mark_known_filtered(links: DataFrame, known: DataFrame, key: str = "run_date", **options) -> DataFrame:
    """``mark_known``, but links that the filter rules out are neither shuffled nor joined.

    A link that the filter lets through goes to the exact join, so false
    positives only cost time. Too many known URLs for a filter that may be
    broadcast go without one.
    """
    index = known if "canonical" in known.columns else known_index(known, key)
    rows = 2 * index.count()
    if not fits(rows):
        return mark_known(links, index, key, **options)
    blocks = blocks_for(rows)
    bits = known_filter(index, blocks, key)
    spelled = links.withColumn("_canonical", canonical_url(F.col("url")))
    exact = probe(spelled, bits, [F.col(key), F.col("url")], blocks, "_exact")
    both = probe(exact, bits, [F.col(key), F.col("_canonical")], blocks, "_same")
    blank = F.coalesce(F.col("url"), F.lit("")) == ""
    maybe = F.col("_exact") | (F.col("_same") & (F.coalesce("_canonical", F.lit("")) != ""))
    # Written once: spelling and probing the links costs most, and three passes would need them.
    both = cut(both.select(*links.columns, "_canonical", (blank | maybe).alias("_maybe")))
    unknown = both.where(~F.col("_maybe")).withColumn("known", F.lit(False))
    # As in the exact join, a link without a run has no comparison form.
    form = F.when(F.col(key).isNotNull(), F.col("_canonical"))
    unknown = unknown.withColumn("canonical_url", F.coalesce(form, F.lit("")))
    checked = mark_known(both.where("_maybe").select(*links.columns), index, key, **options)
    return checked.unionByName(unknown.select(*checked.columns))
