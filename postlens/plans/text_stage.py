"""Posts joined to their counters, filtered, with targets: one lazy plan and one shuffle pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.filters import funnel, min_impressions, quality_filter, sound_counters
from postlens.operators.joins import join_stats
from postlens.operators.targets import add_targets


def text_stage(info: DataFrame, stats: DataFrame, min_imp: int = 500) -> DataFrame:
    """J2, P1, P3. Counter filters go before the join, so they reach the counter scan and shrink the shuffle."""
    return join_stats(info, quality_filter(min_impressions(stats, min_imp)))


def text_stage_targets(info: DataFrame, stats: DataFrame, min_imp: int = 500, **forms: str) -> DataFrame:
    return add_targets(text_stage(info, stats, min_imp), **forms)


def text_stage_funnel(info: DataFrame, stats: DataFrame, min_imp: int = 500) -> DataFrame:
    """A33 for the text stage, counted in one pass over the joined rows."""
    joined = join_stats(info.select("note_id"), stats.select("note_id", "imp_num", "click_num"))
    return funnel(joined, [("min_impressions", F.col("imp_num") >= min_imp), ("quality", sound_counters())])
