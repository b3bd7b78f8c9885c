"""Diversity-aware selection of edition items.

The selection is greedy over a ranked list, so it cannot be a window. It only
ever looks as far down the list as it must, hence it runs in rounds over a
bounded head of each list: a group reaches Python with at most
``(tags + 1) * chunk + 2 * k`` rows however large it is. A list that needs to
be read further is continued in the next round, without the items that can no
longer be chosen; each round chooses at least one item, so there are at most
``k + tags + 1`` rounds and in practice one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import py_strip
from newsloom.operators.ranking import top_per_group
from newsloom.operators.tags import PRIMARY_DESKS, PRIMARY_TAGS, tag_label
from newsloom.session import cut

# Rank of the corroboration labels.
DEPTH_RANK = {"widely-reported": 0, "corroborated": 1, "single-source": 2}

CHUNK = 500


def _rank_columns(items: DataFrame) -> DataFrame:
    depth = F.col("source_depth")
    rank = F.when(depth == "widely-reported", 0).when(depth == "corroborated", 1).when(depth == "single-source", 2)
    return items.withColumns(
        {
            "_depth": rank.otherwise(3),
            "_note": F.when(F.coalesce(F.col("cross_domain_note"), F.lit("")) != "", 0).otherwise(1),
            "_tag": F.coalesce(F.col("tag"), F.lit("")),
        }
    )


_ORDER = ["_depth", "_note", "pos"]


def _choose(
    rows: pd.DataFrame, picked: list, counts: dict, tag_at: int, k: int, cap: int, tags: Sequence[str], chunk: int
) -> tuple[list, dict, int, bool]:
    """Continue a selection over the rows at hand; the flag tells it is done."""
    rows = rows.sort_values(_ORDER)
    taken = set(picked)

    def blocked(sources) -> bool:
        return any(counts.get(s, 0) >= cap for s in sources)

    def take(row) -> None:
        picked.append(int(row.pos))
        taken.add(int(row.pos))
        for s in row.sources:
            counts[s] = counts.get(s, 0) + 1

    def stream(name: str) -> list:
        return [r for r in rows[rows["_stream"] == name].itertuples() if int(r.pos) not in taken]

    while tag_at < len(tags):
        if len(picked) >= k:
            tag_at = len(tags)
            break
        tag = tags[tag_at]
        free = stream(f"tag:{tag}")
        hit = next((r for r in free if not blocked(r.sources)), None)
        if hit is None and int((rows["_stream"] == f"tag:{tag}").sum()) >= chunk:
            return picked, counts, tag_at, False
        if hit is None:
            # No item of the tag fits the outlet cap: take its best anyway.
            hit = next(iter(stream(f"best:{tag}")), None)
        if hit is not None:
            take(hit)
        tag_at += 1

    for row in stream("all"):
        if len(picked) >= k:
            break
        if not blocked(row.sources):
            take(row)
    if len(picked) < k and int((rows["_stream"] == "all").sum()) >= chunk:
        return picked, counts, tag_at, False
    for row in stream("head"):
        if len(picked) >= k:
            break
        take(row)
    return picked, counts, tag_at, True


def diverse_top(
    items: DataFrame,
    k: int,
    tags: Sequence[str] = tuple(PRIMARY_TAGS),
    max_source_share: float = 0.4,
    run: str = "run_date",
    chunk: int = CHUNK,
) -> DataFrame:
    """At most ``k`` items per run, keeping topics and outlets diverse.

    ``items`` needs ``pos``, ``tag``, ``source_depth``, ``cross_domain_note``
    and ``sources`` (outlet names). Runs within the limit stay as they are, in
    their order; cut runs come in rank order (column ``rank``).
    """
    cap = max(1, int(k * max_source_share))
    ranked = _rank_columns(items)
    slim = ranked.select(run, "pos", "_tag", *_ORDER[:2], F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
    sizes = top_per_group(slim, [run], ["pos"], k + 1).groupBy(run).agg(F.count(F.lit(1)).alias("_n"))
    over = sizes.where(F.col("_n") > k).select(run)
    large = slim.join(over, run, "left_semi")

    # Streams that never change: the head of the list, and each tag's best.
    head = top_per_group(large, [run], _ORDER, 2 * k).withColumn("_stream", F.lit("head"))
    best = top_per_group(large.where(F.col("_tag").isin(list(tags))), [run, "_tag"], _ORDER, k).withColumn(
        "_stream", F.concat(F.lit("best:"), F.col("_tag"))
    )
    fixed = head.unionByName(best)

    schema = T.StructType(
        [
            items.schema[run],
            T.StructField("picked", T.ArrayType(T.LongType())),
            T.StructField("counts", T.MapType(T.StringType(), T.LongType())),
            T.StructField("tag_at", T.IntegerType()),
            T.StructField("done", T.BooleanType()),
        ]
    )
    names = list(tags)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        picked = [int(x) for x in (first["picked"] if first["picked"] is not None else [])]
        raw = first["counts"]
        counts = dict(raw) if raw is not None else {}
        got, seen, at, done = _choose(pdf, picked, counts, int(first["tag_at"]), k, cap, names, chunk)
        return pd.DataFrame(
            {run: [first[run]], "picked": [got], "counts": [seen], "tag_at": [at], "done": [done]}
        )

    state = over.select(
        run,
        F.array().cast("array<bigint>").alias("picked"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")).alias("counts"),
        F.lit(0).alias("tag_at"),
        F.lit(False).alias("done"),
    )
    finished = None
    for _ in range(k + len(names) + 1):
        # Items that can still be chosen, best first, a bounded number each.
        full = F.map_keys(F.map_filter("counts", lambda _, n: n >= cap))
        # One state row per run: small enough to broadcast at runtime.
        open_items = large.join(state.withColumn("_full", full).drop("counts"), run, "inner").where(
            ~F.array_contains("picked", F.col("pos")) & ~F.arrays_overlap("sources", "_full")
        ).select(*large.columns)
        by_tag = top_per_group(
            open_items.where(F.col("_tag").isin(names)), [run, "_tag"], _ORDER, chunk
        ).withColumn("_stream", F.concat(F.lit("tag:"), F.col("_tag")))
        overall = top_per_group(open_items, [run], _ORDER, chunk).withColumn("_stream", F.lit("all"))
        rows = by_tag.unionByName(overall).unionByName(fixed)
        state = cut(rows.join(state, run, "inner").groupBy(run).applyInPandas(step, schema))
        closed = state.where("done").select(run, "picked")
        finished = closed if finished is None else finished.unionByName(closed)
        state = state.where("not done")
        if state.isEmpty():
            break
    chosen = finished.select(run, F.explode("picked").alias("pos"))
    cut_runs = ranked.join(chosen, [run, "pos"], "left_semi").withColumn("_key", F.struct(*_ORDER))
    small = ranked.join(over, run, "left_anti").withColumn(
        "_key", F.struct(F.lit(0).alias("_depth"), F.lit(0).alias("_note"), F.col("pos"))
    )
    out = top_per_group(cut_runs.unionByName(small), [run], ["_key"], k, "rank")
    return out.drop("_key", "_tag", "_depth", "_note")


def item_signature(links: str = "links") -> Column:
    """What makes two edition items the same: id, sorted URLs, headline."""
    urls = F.array_sort(
        F.transform(
            F.filter(links, lambda x: F.coalesce(x["url"], F.lit("")) != ""), lambda x: py_strip(x["url"])
        )
    )
    return F.struct(
        F.coalesce(F.col("item_id"), F.lit("")).alias("item_id"),
        F.coalesce(urls, F.array().cast("array<string>")).alias("urls"),
        F.coalesce(F.col("headline"), F.lit("")).alias("headline"),
    )


def primary_coverage(
    glance: DataFrame,
    desk_items: DataFrame,
    desks: Mapping[str, str] = PRIMARY_DESKS,
    run: str = "run_date",
) -> DataFrame:
    """Items to append so that each primary tag is present.

    Per missing tag, the first item of its desk that is not a deep-dive
    candidate. A desk whose first item is in the edition already adds nothing.
    When two desks serve one tag, the first in order that adds an item does.
    """
    order = {d: i for i, d in enumerate(desks)}
    tag_of = F.create_map(*[F.lit(x) for kv in desks.items() for x in kv])
    order_of = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    own = desk_items.where(
        F.col("desk").isin(list(desks)) & ~F.coalesce(F.col("deep_dive_candidate"), F.lit(False))
    )
    first = top_per_group(own, [run, "desk"], ["pos"], 1).withColumn("tag", tag_of[F.col("desk")])
    first = first.withColumn("_desk_order", order_of[F.col("desk")])
    present = glance.select(run, "tag").distinct()
    missing = first.join(present, [run, "tag"], "left_anti").withColumn("_sig", item_signature())
    # A few rows a run are left, and are read twice: written, they let the short items be looked through in place.
    missing = cut(missing)
    signs = glance.select(run, item_signature().alias("_sig"))
    same = signs.join(missing.select(run, "_sig"), [run, "_sig"], "left_semi").distinct()
    fresh = missing.join(same, [run, "_sig"], "left_anti")
    # At most one row per configured desk is left of a run: walk them in order.
    walked = fresh.groupBy(run).agg(
        F.array_sort(F.collect_list(F.struct("_desk_order", "desk", "tag", "_sig"))).alias("_rows")
    )
    kind = walked.schema["_rows"].dataType.simpleString()
    taken = F.aggregate(
        "_rows",
        F.array().cast(kind),
        lambda acc, x: F.when(
            F.exists(acc, lambda y: (y["tag"] == x["tag"]) | (y["_sig"] == x["_sig"])), acc
        ).otherwise(F.array_append(acc, x)),
    )
    winners = walked.select(run, F.explode(taken["desk"]).alias("desk"))
    fresh = fresh.join(winners, [run, "desk"], "left_semi")
    return (
        fresh.withColumn("tag_label", tag_label(F.col("tag")))
        .withColumn("headline", py_strip(F.coalesce(F.col("headline"), F.lit(""))))
        .withColumn("cross_domain_note", F.lit(None).cast("string"))
        .drop("_sig")
    )
