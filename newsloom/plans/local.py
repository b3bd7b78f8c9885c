"""Local and regional news."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import has_useful_summary, is_press_release
from newsloom.operators.ranking import useful_first


def local_selection(local_news: DataFrame, most: int = 4) -> DataFrame:
    """Local items without press releases, useful ones first."""
    own = local_news.where(~is_press_release(F.col("url"), F.col("summary")))
    return useful_first(own, ["run_date"], has_useful_summary(F.col("summary"), F.col("rss_body")), most)


def regional_selection(items: DataFrame, category: str = "regional-west", most: int = 4) -> DataFrame:
    """Feed items of the regional category, useful ones first."""
    own = items.where(F.col("category") == category)
    return useful_first(own, ["run_date"], has_useful_summary(F.col("summary"), F.col("rss_body")), most)
