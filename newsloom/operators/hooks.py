"""Connection hooks as an inverted index: keys, desk pairs, candidate item pairs.

Items of several desks carry hooks (an entity, a theme, a policy, a region). Keys
are brought to one form, counted per run, and keys on more than ``cap`` items are
hubs: they still count in totals, which are computed from counts per desk and never
from pairs, but they form no candidates. Candidates are pairs of items of different
desks that share at least so many other hooks; a key gives at most cap x cap / 2.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAP = 50


def hook_key(kind: Column, key: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """kind:key in lower case without outer or repeated blanks, aliases replaced."""
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(key, F.lit("")), r"\s+", " ")))
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        plain = F.coalesce(table[plain], plain)
    return F.when(plain != "", F.concat(F.lower(kind), F.lit(":"), plain))


def postings(items: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Distinct (run_date, hook, desk, item_id) of items with ``hooks`` (kind, key)."""
    rows = items.select("run_date", "item_id", "desk", F.explode("hooks").alias("h"))
    rows = rows.select("run_date", hook_key(F.col("h.kind"), F.col("h.key"), aliases).alias("hook"), "desk", "item_id")
    return rows.where(F.col("hook").isNotNull() & F.col("item_id").isNotNull()).distinct()


def desk_counts(index: DataFrame) -> DataFrame:
    """(run_date, hook, desk, items) of ``postings``; small, as desks are few."""
    return index.groupBy("run_date", "hook", "desk").agg(F.count(F.lit(1)).alias("items"))


def hook_stats(counts: DataFrame, cap: int = CAP) -> DataFrame:
    """(run_date, hook, items, desks, hub) from ``desk_counts``."""
    out = counts.groupBy("run_date", "hook").agg(F.sum("items").alias("items"), F.count(F.lit(1)).alias("desks"))
    return out.withColumn("hub", F.col("items") > cap)


def desk_pairs(counts: DataFrame, cap: int = CAP) -> DataFrame:
    """(run_date, desk_a, desk_b, hooks, item_pairs, plain_pairs).

    ``item_pairs`` sums the products of the desks' items over shared hooks,
    ``plain_pairs`` only over those that are no hubs.
    """
    hubs = hook_stats(counts, cap).select("run_date", "hook", "hub")
    left = counts.join(hubs, ["run_date", "hook"]).withColumnsRenamed({"desk": "desk_a", "items": "_a"})
    right = counts.withColumnsRenamed({"desk": "desk_b", "items": "_b"})
    both = left.join(right, ["run_date", "hook"]).where("desk_a < desk_b")
    product = F.col("_a") * F.col("_b")
    return both.groupBy("run_date", "desk_a", "desk_b").agg(
        F.count(F.lit(1)).alias("hooks"),
        F.sum(product).alias("item_pairs"),
        F.coalesce(F.sum(F.when(~F.col("hub"), product)), F.lit(0)).cast("long").alias("plain_pairs"),
    )


def candidates(index: DataFrame, cap: int = CAP, shared: int = 2) -> DataFrame:
    """(run_date, item_a, item_b, hooks): items of two desks with enough common hooks."""
    plain = hook_stats(desk_counts(index), cap).where("not hub and desks > 1").select("run_date", "hook")
    rows = index.join(plain, ["run_date", "hook"], "left_semi")
    left = rows.withColumnsRenamed({"item_id": "item_a", "desk": "_a"})
    right = rows.withColumnsRenamed({"item_id": "item_b", "desk": "_b"})
    pairs = left.join(right, ["run_date", "hook"]).where("_a <> _b and item_a < item_b")
    pairs = pairs.groupBy("run_date", "item_a", "item_b").agg(F.countDistinct("hook").alias("hooks"))
    return pairs.where(F.col("hooks") >= shared)
