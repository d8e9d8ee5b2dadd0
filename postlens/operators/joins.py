"""Joins between posts, counters, features and small tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def posts_with_stats(info: DataFrame, stats: DataFrame, key: str = "note_id") -> DataFrame:
    """Posts that have counters. Redundant before `join_stats`, which does the same work once."""
    return info.join(stats.select(key), key, "left_semi")


def join_stats(info: DataFrame, stats: DataFrame, key: str = "note_id") -> DataFrame:
    """Inner join, duplicate keys multiply. The strategy is left to adaptive execution, which also splits hot keys."""
    for side, name in ((info, "info"), (stats, "stats")):
        if key not in side.columns:
            raise ValueError(f"{name} has no column {key}")
    return info.join(stats, key)


def attach_features(posts: DataFrame, features: DataFrame, key: str = "note_id") -> DataFrame:
    """J3 for features held in another table; posts without features stay."""
    return posts.join(features, key, "left")


def keep_or_default(kept: Column, values: Mapping[str, Column], defaults: Mapping[str, Column]) -> dict[str, Column]:
    """Computed value where the row was kept, the default elsewhere; no join and no second pass."""
    return {
        name: F.when(kept, F.coalesce(value, defaults[name])).otherwise(defaults[name])
        for name, value in values.items()
    }


def attach_scalars(df: DataFrame, stats: DataFrame, name: str = "stats") -> DataFrame:
    """A one-row table becomes a struct column through a scalar subquery."""
    return df.withColumn(name, stats.select(F.struct(*stats.columns)).scalar())


def small_map(table: DataFrame, key: str, *values: str) -> DataFrame:
    """One row, one map key -> struct(values). For tables with a row per task, feature or model cluster only."""
    entry = F.struct(F.col(key), F.struct(*values))
    return table.agg(F.map_from_entries(F.collect_list(entry)))


def lookup_codes(df: DataFrame, vocabulary: DataFrame, column: str, name: str, unseen: Column) -> DataFrame:
    """`vocabulary` has columns value, code; unseen and NULL values get `unseen`."""
    codes = vocabulary.select(F.col("value").alias(column), F.col("code").alias("_code"))
    joined = df.join(codes, column, "left")
    return joined.withColumn(name, F.coalesce(F.col("_code"), unseen)).drop("_code")


def task_coverage(predictions: DataFrame, fitted: DataFrame) -> DataFrame:
    """Tasks on one side only, with columns task, issue."""
    predicted, known = predictions.select("task").distinct(), fitted.select("task").distinct()
    missing = predicted.join(known, "task", "left_anti").withColumn("issue", F.lit("not_fitted"))
    extra = known.join(predicted, "task", "left_anti").withColumn("issue", F.lit("not_predicted"))
    return missing.unionByName(extra)
