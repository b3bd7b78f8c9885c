"""Landed transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_snippets(snippets: DataFrame, video: Sequence[str], pos: str, text: str) -> DataFrame:
    """One text per video: its snippets joined by a blank, in order.

    The result is one value per video by its meaning, so a video's snippets
    come together once; videos are bounded by their playing time.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return snippets.groupBy(*video).agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("transcript")
    )
