"""Rates and scores from counters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.numeric import clip
from postlens.settings import CES_WEIGHTS, IMPRESSION_CEILING


def per_impression(count: Column, impressions: Column) -> Column:
    """0 without impressions; a NULL count over positive impressions stays NULL."""
    return F.when(impressions > 0, count / impressions).otherwise(F.lit(0.0))


def per_click(count: Column, clicks: Column) -> Column:
    """Alternative denominator: clicks, at least one."""
    return count / F.when(clicks.isNotNull(), F.greatest(clicks, F.lit(1)))


def interactions(columns: Sequence[str]) -> Column:
    """sum of the counters given, NULL counting 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def engagement(columns: Sequence[str]) -> Column:
    """weighted sum over the counters given."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) * CES_WEIGHTS[c] for c in columns])


def impression_log(impressions: Column, form: str = "clip") -> Column:
    """ln of impressions clipped to [1, 1e7], or log1p."""
    if form == "log1p":
        return F.log1p(impressions)
    return F.ln(clip(impressions, 1, IMPRESSION_CEILING))
