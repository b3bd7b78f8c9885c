"""Phrase reuse between texts of a run.

Ten-word windows are compared by a 64-bit hash first: only hashes seen on
both sides are followed up with the words themselves, so what is shuffled for
the bulk of the text is two numbers per word, and a hash collision can never
produce a match. A window's hash is made of those of its words, which are taken
once each; only windows at places with a common hash are spelled. Where all
sections but the largest are short, a filter of their hashes goes to the tasks, and
of the largest section only windows that it lets through leave them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import filter_places, gram_hashes, gram_hits, grams_at
from newsloom.operators.joins import HOT_ROWS, hot_join, key_counts
from newsloom.operators.links import step_down
from newsloom.operators.ranking import top_per_group
from newsloom.session import cut


# Bits of a block of a filter (as Spark's bitmap functions have them); bits of a filter at least and at most.
BLOCK, LEAST_BITS, MOST_BITS = 32_768, 1 << 23, 1 << 27


def hash_rows(texts: DataFrame, key: Sequence[str], run: Sequence[str], window: int = 10) -> DataFrame:
    """One row per window of each text: its place, and its hash with that of the run."""
    rows = texts.select(*key, F.posexplode(gram_hashes(F.col("text"), window)).alias("at", "_h"))
    return rows.select(*key, "at", F.xxhash64(*run, "_h").alias("gram_hash"))


def _filter(texts: DataFrame, window: int, bits: int) -> np.ndarray:
    """Bytes with the places of all window hashes set, built per block by partial aggregation."""
    hashes = texts.select(F.explode(gram_hashes(F.col("text"), window)).alias("_h"))
    places = hashes.select(F.explode(F.array(*filter_places(F.col("_h"), bits))).alias("_p"))
    blocks = places.groupBy(F.floor(F.col("_p") / BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.col("_p") % BLOCK).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for block, some in blocks.collect():
        out[block * (BLOCK // 8) :][: BLOCK // 8] = np.frombuffer(some, np.uint8)
    return out


def _spelled(
    texts: DataFrame,
    rows: DataFrame,
    common: DataFrame,
    counts: DataFrame,
    key: Sequence[str],
    window: int,
    hot_rows: int,
) -> DataFrame:
    """The words of the windows whose hash is common, from texts that have one.

    ``rows`` are the ``hash_rows`` of the texts. ``common`` is a written table, so where it is small Spark broadcasts it and
    the hashes of the bulk of the text are not shuffled again. Texts of the same
    key exchange places; what is spelled there are windows of theirs all the same.
    """
    hits = hot_join(rows, common, ["gram_hash"], "left_semi", counts, hot_rows)
    places = hits.groupBy(*key).agg(F.collect_set("at").alias("_at"))
    rows = texts.join(places, list(key)).select(*key, F.explode(grams_at(F.col("text"), F.col("_at"), window)).alias("gram"))
    return rows.distinct()


def shared_grams(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    run: Sequence[str] = ("run_date",),
    window: int = 10,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Windows of each left text that occur in any right text of its run.

    ``key`` identifies a text in a run on both sides.
    """
    k, h = [*run, *key], "gram_hash"
    a = hash_rows(left, k, run, window).select(h, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    b = hash_rows(right, k, run, window).select(h, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    # Both sides in one aggregation: a window is common when both have it.
    sides = a.unionByName(b).groupBy(h).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    common = cut(sides.where((F.col("_l") > 0) & (F.col("_r") > 0)))
    ours = common.select(h, F.col("_l").alias("rows"))
    theirs = common.select(h, F.col("_r").alias("rows"))
    keys = common.select(h)
    spelled = lambda texts, rows: _spelled(texts, hash_rows(texts, k, run, window), keys, rows, k, window, hot_rows)
    words = spelled(right, theirs).select(*run, "gram").distinct()
    candidates = spelled(left, ours)
    on = [*run, "gram"]
    return hot_join(candidates, words, on, "left_semi", key_counts(candidates, on), hot_rows)


def overlap_counts(shared: DataFrame, key: Sequence[str], run: Sequence[str] = ("run_date",)) -> DataFrame:
    """Distinct shared windows per text, with the first in order as sample."""
    return shared.groupBy(*run, *key).agg(
        F.count(F.lit(1)).alias("overlap_count"), F.min("gram").alias("sample_phrase")
    )


def overlap_downgrade(
    dives: DataFrame, glance: DataFrame, key: str = "pos", least: int = 3, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Lower the depth of long reads that reuse the short items' wording.

    Both inputs carry ``run_date`` and ``text``. Adds ``overlap_count`` and
    ``sample_phrase`` to dives and keeps the label before in ``original_depth``.
    """
    counts = overlap_counts(
        shared_grams(dives.select("run_date", key, "text"), glance, [key], hot_rows=hot_rows), [key]
    ).where(F.col("overlap_count") >= least)
    out = dives.join(counts, ["run_date", key], "left").withColumn("original_depth", F.col("source_depth"))
    lowered = F.col("overlap_count").isNotNull() & (F.coalesce(F.col("source_depth"), F.lit("")) != "")
    return out.withColumn(
        "source_depth", F.when(lowered, step_down(F.col("source_depth"))).otherwise(F.col("source_depth"))
    )


def cross_section_phrases(
    texts: DataFrame, window: int = 10, run: Sequence[str] = ("run_date",), hot_rows: int = HOT_ROWS, most_bits: int = MOST_BITS
) -> DataFrame:
    """Windows that occur in more than one section of a run.

    ``texts`` has run, section, pos (place in reading order), item_id, text.
    Each phrase comes with the first pair of items of different sections that
    share it: its first item, and its first item outside that one's section.
    Groups are folded by partial aggregation; no pairs are enumerated.
    """
    k = [*run, "section", "pos"]
    # Texts without a section or place are in no pair.
    for c in k:
        texts = texts.where(F.col(c).isNotNull())
    sizes = texts.groupBy("section").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("_n"))
    largest, others = sizes.agg(F.max_by("section", "_n"), F.sum("_n") - F.max("_n")).first()
    # 16 bits a window of four bytes; shorter ones only let more of the largest section through.
    bits = max(LEAST_BITS, 1 << (4 * (others or 0)).bit_length())
    if bits <= most_bits:
        short = texts.where(F.col("section") != F.lit(largest))
        filled = texts.sparkSession.sparkContext.broadcast(_filter(short, window, bits))
        bulk = texts.where(F.col("section") == F.lit(largest)).select(*k, F.explode(gram_hits(F.col("text"), filled, window)).alias("_w"))
        bulk = cut(bulk.select(*k, "_w.at", F.xxhash64(*run, "_w.h").alias("gram_hash"), "_w.gram"))
        rows = hash_rows(short, k, run, window)
        both = rows.unionByName(bulk.drop("gram"))
    else:
        short, bulk = texts, None
        both = rows = hash_rows(texts, k, run, window)
    # Numbers for the sections: the least and greatest string would need a sort of all windows.
    spread = both.select("gram_hash", F.xxhash64("section").alias("_number")).groupBy("gram_hash").agg(
        F.min("_number").alias("_a"), F.max("_number").alias("_b"), F.count(F.lit(1)).alias("rows")
    )
    common = cut(spread.where(F.col("_a") != F.col("_b")).select("gram_hash", "rows"))
    survivors = _spelled(short, rows, common.select("gram_hash"), common, k, window, hot_rows)
    if bulk is not None:
        hits = hot_join(bulk, common.select("gram_hash"), ["gram_hash"], "left_semi", common, hot_rows)
        survivors = survivors.unionByName(hits.select(*k, "gram").distinct())
    g = [*run, "gram"]
    per_section = survivors.groupBy(*g, "section").agg(F.min("pos").alias("pos"))
    # One row per section is left, so a phrase gathers no more than sections.
    firsts = per_section.groupBy(*g).agg(
        F.slice(F.array_sort(F.collect_list(F.struct("pos", "section"))), 1, 2).alias("_firsts")
    )
    return firsts.where(F.size("_firsts") > 1).select(
        *run,
        F.col("gram").alias("phrase"),
        F.col("_firsts")[0]["pos"].alias("pos_a"),
        F.col("_firsts")[0]["section"].alias("section_a"),
        F.col("_firsts")[1]["pos"].alias("pos_b"),
        F.col("_firsts")[1]["section"].alias("section_b"),
    )


def representative_phrases(
    phrases: DataFrame, most: int = 6, like: int = 8, run: str = "run_date", chunk: int = 500
) -> DataFrame:
    """First phrases of a run that are not much like an earlier one.

    Two phrases are alike when they share ``like`` words or more. At most
    ``most`` are kept, in the order of their first pair; ``suppressed`` counts
    the others. Python sees a bounded head of the list per round; phrases
    alike to a kept one are dropped before the next round.
    """
    order = ["pos_a", "pos_b", "phrase"]
    # Written, as each round reads them.
    phrases = cut(phrases)
    base = phrases.select(run, *order)
    schema = T.StructType(
        [
            phrases.schema[run],
            T.StructField("kept", T.ArrayType(T.StringType())),
            T.StructField("done", T.BooleanType()),
        ]
    )

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = [str(x) for x in pdf.iloc[0]["kept"]]
        sets = [set(x.split()) for x in kept]
        for phrase in pdf.sort_values(order)["phrase"]:
            if len(kept) >= most:
                break
            words = set(phrase.split())
            if all(len(words & other) < like for other in sets):
                kept.append(phrase)
                sets.append(words)
        done = len(kept) >= most or len(pdf) < chunk
        return pd.DataFrame({run: [pdf.iloc[0][run]], "kept": [kept], "done": [done]})

    state = base.select(run).distinct().select(
        run, F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done")
    )
    finished = None
    for _ in range(most + 1):
        tokens = F.array_distinct(F.split("phrase", " "))
        open_rows = base.join(state, run, "inner").where(
            ~F.exists(
                "kept", lambda x: F.size(F.array_intersect(tokens, F.split(x, " "))) >= like
            )
        )
        # A run with nothing left to look at keeps its state.
        rows = top_per_group(open_rows, [run], order, chunk)
        moved = cut(rows.groupBy(run).applyInPandas(step, schema))
        idle = state.join(moved, run, "left_anti").withColumn("done", F.lit(True))
        both = moved.unionByName(idle)
        closed = both.where("done").select(run, "kept")
        finished = closed if finished is None else finished.unionByName(closed)
        state = both.where("not done")
        if state.isEmpty():
            break
    totals = base.groupBy(run).agg(F.count(F.lit(1)).alias("_all"))
    kept = finished.join(totals, run, "inner").select(
        run,
        F.posexplode("kept").alias("_at", "phrase"),
        (F.col("_all") - F.size("kept")).alias("suppressed"),
    )
    return (
        phrases.join(kept, [run, "phrase"], "inner")
        .withColumn("rank", F.col("_at") + 1)
        .drop("_at")
    )
