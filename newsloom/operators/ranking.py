"""First rows, caps and running totals per group.

Two plans are used. A cap known to be small (a literal) is a filtered
``row_number``: Spark then trims every map task to the cap before the shuffle,
so a hot group costs at most ``tasks * cap`` rows. Where the position inside a
group is unbounded, ``running`` splits each group into buckets that follow the
order, so no task ever holds a whole hot group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ColumnLike = Column | str

# Rows of one group that a single task may sort.
BUCKET_ROWS = 100_000


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def top_per_group(
    df: DataFrame, group: Sequence[ColumnLike], order: Sequence[ColumnLike], k: int, rank: str | None = None
) -> DataFrame:
    """The first ``k`` rows of every group; ``rank`` keeps their position."""
    w = Window.partitionBy(*[_col(g) for g in group]).orderBy(*[_col(o) for o in order])
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, key: Sequence[ColumnLike], order: Sequence[ColumnLike]) -> DataFrame:
    """One row per key: the first in order."""
    return top_per_group(df, key, order, 1)


def dedup_by_url(df: DataFrame, order: Sequence[ColumnLike] = ("pos",), url: str = "url") -> DataFrame:
    """First item per run and URL; items without URL are not kept."""
    known = df.where(F.coalesce(F.col(url), F.lit("")) != "")
    return first_per_key(known, ["run_date", url], order)


def cap_lookup(caps: Mapping[str, int], key: Column, default: int) -> Column:
    """Cap of a key from a small configured mapping."""
    if not caps:
        return F.lit(default)
    pairs = [F.lit(x) for kv in caps.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def cap_per_key(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    order: Sequence[ColumnLike],
    caps: Mapping[str, int],
    default: int,
) -> DataFrame:
    """First rows of each group, with a configured cap per key."""
    highest = max([default, *caps.values()])
    w = Window.partitionBy(*group, key).orderBy(*[_col(o) for o in order])
    ranked = df.withColumn("_rank", F.row_number().over(w))
    # The literal bound lets Spark trim map tasks; the configured cap decides.
    return (
        ranked.where(F.col("_rank") <= highest)
        .where(F.col("_rank") <= cap_lookup(caps, F.col(key), default))
        .drop("_rank")
    )


def running(
    df: DataFrame,
    group: Sequence[str],
    buckets: Mapping[str, Column],
    order: Sequence[ColumnLike],
    totals: Mapping[str, Column],
) -> DataFrame:
    """Add running totals per group, exact at any group size.

    ``buckets`` are coarsened leading parts of ``order``: rows of an earlier
    bucket come before all rows of a later one. Totals of earlier buckets come
    from a partial aggregation; only rows of one bucket are sorted together.
    Buckets must be few per group, as ``position_bucket`` and ``quantile_buckets``
    make them: their totals are added up group by group.
    """
    work = df.withColumns(dict(buckets))
    names = list(buckets)
    per_bucket = work.groupBy(*group, *names).agg(
        *[F.sum(v).alias(f"_b_{n}") for n, v in totals.items()]
    )
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *[F.col(c).alias(f"_k_{c}") for c in (*group, *names)],
        *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals],
    )
    on = None
    for c in (*group, *names):
        part = work[c].eqNullSafe(offsets[f"_k_{c}"])
        on = part if on is None else on & part
    joined = work.join(offsets, on, "inner").drop(*[f"_k_{c}" for c in (*group, *names)])
    inside = (
        Window.partitionBy(*group, *names)
        .orderBy(*[_col(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = joined.withColumns({n: F.sum(v).over(inside) + F.col(f"_o_{n}") for n, v in totals.items()})
    return out.drop(*names, *[f"_o_{n}" for n in totals])


def position_bucket(pos: str = "pos", rows: int = BUCKET_ROWS) -> dict[str, Column]:
    """Bucket of a dense position column."""
    return {"_bucket": F.floor(F.col(pos) / F.lit(rows))}


def quantile_buckets(
    df: DataFrame, group: Sequence[str], value: str, pos: str = "pos", rows: int = BUCKET_ROWS, parts: int = 64
) -> DataFrame:
    """``df`` with buckets (``_place``, ``_tie``) along a number, then a position.

    Bounds are approximate quantiles of each group, from partial aggregates. A
    place is either between two bounds or at one, where all rows tie and the
    position goes on. A group of no more than ``rows`` rows is one bucket; a
    larger one has ``2 * parts`` places at most.
    """
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(F.col(value), shares, 1_000).alias("_bounds"))
    on = [F.col(f"d.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    out = df.alias("d").join(sizes.alias("s"), on, "inner").select("d.*", "s._n", F.array_distinct("s._bounds").alias("_bounds"))
    below = F.size(F.filter("_bounds", lambda q: q < F.col(value)))
    at = F.array_contains("_bounds", F.col(value))
    place = F.when(F.col("_n") <= rows, 0).otherwise(2 * below + at.cast("int"))
    tie = F.when((F.col("_n") > rows) & at, F.floor(F.col(pos) / F.lit(rows))).otherwise(0)
    return out.withColumns({"_place": place, "_tie": tie}).drop("_n", "_bounds")


def position_in_group(
    df: DataFrame, group: Sequence[str], pos: str = "pos", rows: int = BUCKET_ROWS, out: str = "rank"
) -> DataFrame:
    """``row_number`` by a dense position, without sorting a group in one task."""
    return running(df, group, position_bucket(pos, rows), [pos], {out: F.lit(1)})


def share_cap(
    df: DataFrame,
    desk: Sequence[str] = ("run_date", "desk"),
    category: str = "category",
    shares: Mapping[str, float] | float = 0.7,
    desk_key: str = "desk",
    pos: str = "pos",
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Mark items beyond a category's share of its desk (column ``kept``).

    The cap is ``max(1, ceil(desk items * share))`` per category. Items with a
    blank category are kept, and shares outside (0, 1) switch the cap off.
    """
    share = F.lit(float(shares)) if isinstance(shares, (int, float)) else cap_lookup(
        {k: float(v) for k, v in shares.items()}, F.col(desk_key), 1.0
    )
    sizes = df.groupBy(*desk).agg(F.count(F.lit(1)).alias("_desk_items"))
    keys = [F.col(f"i.{d}").eqNullSafe(F.col(f"s.{d}")) for d in desk]
    sized = df.alias("i").join(sizes.alias("s"), keys, "inner").select("i.*", "s._desk_items")
    ranked = position_in_group(sized, [*desk, category], pos, rows, "_rank")
    active = (share > 0) & (share < 1)
    cap = F.greatest(F.lit(1), F.ceil(F.col("_desk_items") * share))
    blank = F.coalesce(F.col(category), F.lit("")) == ""
    kept = ~active | blank | (F.col("_rank") <= cap)
    return ranked.withColumn("kept", kept).drop("_rank", "_desk_items")


# Order of the confidence labels.
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}


def confidence_rank(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low == "high", 3).when(low == "medium", 2).when(low == "low", 1).otherwise(0)


def confidence_cap(
    df: DataFrame, group: Sequence[str], most: int, confidence: str = "confidence", pos: str = "pos"
) -> DataFrame:
    """At most ``most`` rows per group; the best confidence first when cut.

    The output column ``rank`` follows confidence only in groups over the cap.
    """
    best = top_per_group(df, group, [F.desc(confidence_rank(F.col(confidence))), pos], most, "_by_conf")
    # One row more than the cap is enough to know whether the group is over it.
    head = top_per_group(df.select(*group, pos), group, [pos], most + 1)
    sizes = head.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    keys = [F.col(f"b.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    both = best.alias("b").join(sizes.alias("s"), keys, "inner").select("b.*", "s._n")
    w = Window.partitionBy(*group).orderBy(
        F.when(F.col("_n") > most, F.col("_by_conf")), F.col(pos)
    )
    return both.withColumn("rank", F.row_number().over(w)).drop("_by_conf", "_n")


def useful_first(df: DataFrame, group: Sequence[str], useful: Column, k: int = 4, pos: str = "pos") -> DataFrame:
    """Useful items before thin ones, each in order, at most ``k`` per group."""
    return top_per_group(df, group, [F.when(useful, 0).otherwise(1), pos], k, "rank")


def newest_first(df: DataFrame, published: str = "published") -> DataFrame:
    """Items by date, newest first, undated last."""
    return df.orderBy(F.col(published).desc_nulls_last())


def outlet_cap(
    df: DataFrame, group: Sequence[str], outlet: str, most: int, pos: str = "pos"
) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) under a cap per outlet; items without outlet are kept."""
    named = df.where(F.coalesce(F.col(outlet), F.lit("")) != "")
    unnamed = df.where(F.coalesce(F.col(outlet), F.lit("")) == "")
    kept = top_per_group(named, [*group, outlet], [pos], most)
    dropped = position_in_group(named, [*group, outlet], pos, out="_rank")
    dropped = dropped.where(F.col("_rank") > most).drop("_rank")
    return kept.unionByName(unnamed), dropped


def tiered_budget(
    df: DataFrame,
    needed: Column,
    caps: Mapping[str, int],
    status: str,
    group: Sequence[str] = ("run_date",),
    tier: str = "tier",
    priority: Sequence[str] = ("p0", "p1", "p2"),
    pos: str = "pos",
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Rank candidates that need a fetch inside their tier and mark the allowed.

    Adds ``budget_rank``, ``tier_needed``, ``cap``, ``allowed`` and the status
    and reason of those beyond the cap. Tiers without a cap get none.
    """
    wanted = df.where(needed)
    keys = [*group, tier]
    *lead, last = priority
    placed = quantile_buckets(wanted, [*keys, *lead], last, pos, rows)
    buckets = {f"_{p}": F.col(p) for p in lead} | {"_at": F.col("_place"), "_bucket": F.col("_tie")}
    ranked = running(placed, keys, buckets, [*priority, pos], {"budget_rank": F.lit(1)}).drop("_place", "_tie")
    sizes = wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("tier_needed"))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    out = ranked.alias("r").join(sizes.alias("s"), on, "inner").select("r.*", "s.tier_needed")
    cap = F.greatest(F.lit(0), cap_lookup(caps, F.col(tier), 0))
    out = out.withColumn("cap", cap).withColumn("allowed", F.col("budget_rank") <= F.col("cap"))
    return out.withColumn("budget_status", F.when(~F.col("allowed"), F.lit(status)))


def budget_reason(reason: str = "priority_reason", tier: str = "tier") -> Column:
    """Text stored with a skipped candidate."""
    return F.format_string(
        "%s hit; tier=%s; rank_reason=%s; candidates=%d; cap=%d",
        F.replace(F.col("budget_status"), F.lit("_"), F.lit(" ")),
        F.col(tier),
        F.col(reason),
        F.col("tier_needed"),
        F.col("cap"),
    )


def tier_stats(budget: DataFrame, group: Sequence[str] = ("run_date",), tier: str = "tier") -> DataFrame:
    """Needed, allowed and skipped candidates per tier."""
    return budget.groupBy(*group, tier).agg(
        F.count(F.lit(1)).alias("needed"),
        F.count_if(F.col("allowed")).alias("allowed"),
        F.count_if(~F.col("allowed")).alias("skipped_by_cap"),
        F.max("cap").cast(T.LongType()).alias("cap"),
    )


def request_gate(
    df: DataFrame,
    per_desk: int,
    total: int,
    group: Sequence[str] = ("run_date",),
    desk: str = "desk",
    desk_pos: str = "desk_pos",
    pos: str = "idx",
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Accept eligible requests under a cap per desk and a cap per run.

    ``status`` of the input is ``selected`` or a rejection. Desks are served
    in order. A desk accepts its first ``per_desk`` eligible requests while the
    run has room, so the accepted of a desk are a prefix of its eligible ones,
    and whatever comes later in the desk is rejected by the cap that fired.
    """
    eligible = df.where(F.col("status") == "selected")
    # Only the first per_desk eligible requests of a desk can be accepted.
    heads = top_per_group(eligible.select(*group, desk, desk_pos, pos), [*group, desk], [pos], per_desk, "_rank")
    by_desk = heads.groupBy(*group, desk, desk_pos).agg(F.count(F.lit(1)).alias("_can"))
    before = Window.partitionBy(*group).orderBy(desk_pos).rowsBetween(Window.unboundedPreceding, -1)
    room = by_desk.withColumn(
        "_take",
        F.greatest(
            F.lit(0),
            F.least(F.col("_can"), F.lit(total) - F.coalesce(F.sum("_can").over(before), F.lit(0))),
        ),
    ).select(*group, desk, "_take")
    ranked = position_in_group(eligible, [*group, desk], pos, rows, "_rank")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in (*group, desk)]
    judged = (
        ranked.alias("r")
        .join(room.alias("t"), on, "left")
        .select("r.*", F.coalesce(F.col("t._take"), F.lit(0)).alias("_take"))
    )
    verdict = (
        F.when(F.col("_rank") <= F.col("_take"), "selected")
        .when(F.col("_take") >= per_desk, "rejected_per_desk_cap")
        .otherwise("rejected_total_cap")
    )
    judged = judged.withColumn("status", verdict).drop("_rank", "_take")
    return judged.unionByName(df.where(F.col("status") != "selected"))


def breach_positions(
    df: DataFrame,
    group: Sequence[str],
    failed: Column,
    succeeded: Column,
    limit: int,
    pos: str = "pos",
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Position at which ``limit`` failures in a row are reached, per group.

    Rows which neither fail nor succeed are looked through.
    """
    marks = df.withColumns({"_fail": F.when(failed, 1).otherwise(0), "_ok": F.when(succeeded, 1).otherwise(0)})
    seq = running(
        marks,
        group,
        position_bucket(pos, rows),
        [pos],
        {"_fails": F.col("_fail"), "_oks": F.col("_ok")},
    )
    # Failures in a row = failures so far minus failures before this island, so
    # the breaching row of an island is known by its number: a unique key.
    start = (
        seq.where(F.col("_fail") == 1)
        .groupBy(*group, "_oks")
        .agg((F.min("_fails") + F.lit(limit - 1)).alias("_fails"))
    )
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*group, "_oks", "_fails")]
    reached = seq.where(F.col("_fail") == 1).alias("a").join(start.alias("b"), on, "inner")
    cols = [F.col(f"a.{g}").alias(g) for g in group]
    return reached.groupBy(*cols).agg(F.min(F.col(f"a.{pos}")).alias("breach_pos"))


def circuit_breaker(
    df: DataFrame,
    group: Sequence[str],
    failed: Column,
    succeeded: Column,
    limit: int = 5,
    pos: str = "pos",
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Rows processed before the breaker opens (the breaching row included)."""
    stop = breach_positions(df, group, failed, succeeded, limit, pos, rows)
    on = [F.col(f"d.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    return (
        df.alias("d")
        .join(F.broadcast(stop).alias("s") if not group else stop.alias("s"), on or F.lit(True), "left")
        .where(F.col("s.breach_pos").isNull() | (F.col(f"d.{pos}") <= F.col("s.breach_pos")))
        .select("d.*")
    )
