"""Targets from counters (F1-F8)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions import rates
from postlens.operators.ordering import median
from postlens.settings import CES_WEIGHTS, CTR_PAIRS, RATE_COUNTERS, TASK_COLUMNS


def add_targets(df: DataFrame, denominator: str = "impressions", impression_form: str = "clip") -> DataFrame:
    """F1, F3-F6 in one projection: only what the counters allow, and never over a target that exists."""
    has, imp = set(df.columns), F.col("imp_num")
    if "imp_num" not in has:
        return df
    if denominator not in ("impressions", "clicks"):
        raise ValueError(f"unknown denominator {denominator}")
    if denominator == "clicks":
        def rate(count):
            return rates.per_click(count, F.col("click_num"))
    else:
        def rate(count):
            return rates.per_impression(count, imp)

    new = {}
    if "click_num" in has:
        new["ctr"] = rates.per_impression(F.col("click_num"), imp)
    for target, counter in RATE_COUNTERS.items():
        if counter in has:
            new[target] = rate(F.col(counter))
    counters = [c for c in CES_WEIGHTS if c in has]
    if counters:
        new["interaction_rate"] = rate(rates.interactions(counters))
        new["ces_rate"] = rate(rates.engagement(counters))
        if "interaction_rate" not in has:
            new["total_interactions"] = rates.interactions(counters)
    new["impression_log"] = rates.impression_log(imp, impression_form)
    return df.withColumns({name: value for name, value in new.items() if name not in has})


def derive_ctr(df: DataFrame) -> DataFrame:
    """from the first pair of columns present; with none there is no label and that is an error."""
    if "ctr" in df.columns:
        return df
    for impressions, clicks in CTR_PAIRS:
        if impressions in df.columns and clicks in df.columns:
            return df.withColumn("ctr", rates.per_impression(F.col(clicks), F.col(impressions)))
    raise ValueError(f"no click rate can be derived from {df.columns}")


def fill_with_median(df: DataFrame, column: str = "sort_score2") -> DataFrame:
    """NULL becomes the exact median, read once through a scalar subquery."""
    middle = median(df.select(column), column)
    return df.withColumn("_median", middle.scalar()).withColumn(
        column, F.coalesce(F.col(column), F.col("_median"))
    ).drop("_median")


def task_columns(tasks: Iterable[str] | None = None) -> dict[str, str]:
    """F8: task -> column; an unknown task is an error."""
    if tasks is None:
        return dict(TASK_COLUMNS)
    unknown = [t for t in tasks if t not in TASK_COLUMNS]
    if unknown:
        raise ValueError(f"unknown tasks {unknown}; known are {list(TASK_COLUMNS)}")
    return {t: TASK_COLUMNS[t] for t in tasks}


def to_long(df: DataFrame, tasks: Iterable[str] | None = None, keys: Iterable[str] = ()) -> DataFrame:
    """One row per key and task, columns keys, task, value; NULLs stay, absent targets give no rows."""
    present = {t: c for t, c in task_columns(tasks).items() if c in df.columns}
    pairs = F.array(*[
        F.struct(F.lit(t).alias("task"), F.col(c).cast("double").alias("value")) for t, c in present.items()
    ])
    return df.select(*keys, F.inline(pairs))


def to_wide(long: DataFrame, key: str, tasks: Iterable[str], value: str = "value") -> DataFrame:
    """E8 back: one column per task in the order given; a task that is absent gives zeros."""
    tasks = list(tasks)
    wide = long.groupBy(key).pivot("task", tasks).agg(F.first(value))
    return wide.select(key, *[F.coalesce(F.col(t), F.lit(0.0)).cast("float").alias(t) for t in tasks])


def prepare_targets(df: DataFrame, tasks: Iterable[str] | None = None) -> DataFrame:
    """NULL -> 0, float."""
    present = [c for c in task_columns(tasks).values() if c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("float") for c in present})
