"""Mixing of sources to target weights by Pareto order sampling.

Sizes are words. Targets share all words by weight and stop at ``most`` times
their source's size; what is cut off is shared again by weight, which ends at one
level for all sources that are not cut off. Each document gets its whole copies
for certain. For the fraction left, documents are ranked by Pareto's ratio, the
odds of a random number over the odds of their inclusion, and the leading ones
are taken until the words missing to the target are reached.

Everything is SQL expressions. A source is never ranked in one task: ratios fall
into buckets, sums per bucket show in which bucket the cut lies, and only that
one is sorted. The random number is a hash of the document, so runs agree.

Null texts have size 0; a null source is a source of its own, listed last. Of
rows that repeat a document each counts for itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20_240


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size, rows, target) from (source, source_size, rows).

    One row per source: the windows here are over the list of sources.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    listed = sources.withColumn("_w", F.get(w, F.pmod(F.row_number().over(place) - 1, F.lit(len(weights)))))
    listed = listed.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    leveled = listed.withColumns({"_level": level, "_at": F.row_number().over(order)})
    # The first source that its share leaves below its cap fixes the level for all after it.
    fits = F.col("_cap") / F.col("_w") >= F.col("_level")
    common = F.min(F.when(fits, F.struct("_at", "_level"))).over(every)
    done = leveled.withColumn("_common", common["_level"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_common"), F.col("_cap")))
    return done.select("source", "source_size", "rows", target.alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """Number in (0, 1) fixed by a key."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11)
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def pareto_order(u: Column, inclusion: Column) -> Column:
    """Odds of the random number over the odds of inclusion; small is first."""
    return (u / (1 - u)) / (inclusion / (1 - inclusion))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = SEED, keep: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row.

    ``keep`` names further columns of ``docs`` to carry along.
    """
    rows = docs.select(
        F.col("doc_id"), "source", *keep, word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("_key")
    )
    sized = written(rows, "mixing-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    plan = written(targets(sources, weights, most), "mixing-targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(share)
    # Buckets follow the expected ranks, so they hold about the root of a source's rows each.
    plan = plan.withColumns(
        {
            "_whole": whole.cast("long"),
            "_part": share - whole,
            "_missing": F.col("target") - whole * F.col("source_size"),
            "_buckets": F.ceil(F.sqrt(F.col("rows"))),
        }
    )
    names = plan.withColumnRenamed("source", "_source").drop("rows")
    ranked = sized.join(names, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    q = pareto_order(uniform(F.col("_key"), seed), F.col("_part"))
    ranked = ranked.withColumn("_q", F.when(F.col("_part") > 0, q).otherwise(F.lit(float("inf"))))
    even = F.col("_q") * F.col("_part")
    even = F.when(F.col("_part") > 0, even / (1 - F.col("_part") + even)).otherwise(F.lit(0.0))
    ranked = ranked.withColumn("_bucket", F.least(F.floor(even * F.col("_buckets")), F.col("_buckets") - 1).cast("long"))
    sums = ranked.where("_part > 0").groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"), F.max("_missing").alias("_missing"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .where(F.col("_before") <= F.col("_missing"))
        .groupBy(F.col("source").alias("_source"))
        .agg(F.max_by("_before", "_bucket").alias("_before"), F.max("_bucket").alias("_edge"))
    )
    placed = ranked.join(edges, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    at_edge = F.col("_bucket") == F.coalesce(F.col("_edge"), F.lit(-1))
    inside = Window.partitionBy("source").orderBy("_q", "_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    # The last document is taken if that brings the words nearer to the target.
    edge = placed.where(at_edge).withColumn("_extra", (ahead + F.col("size") / 2 <= F.col("_missing")).cast("long"))
    rest = placed.where(~at_edge).withColumn("_extra", F.coalesce((F.col("_bucket") < F.col("_edge")).cast("long"), F.lit(0)))
    out = rest.unionByName(edge).withColumn("copies", F.col("_whole") + F.col("_extra"))
    return out.select(
        "doc_id", "source", *keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
