"""Tag vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.text import strip
from postlens.operators.ordering import dense_positions
from postlens.settings import DEFAULT_TAG_WORDS, TAG_COLUMNS


def tag_values(df: DataFrame, columns: Sequence[str] = TAG_COLUMNS, drop_defaults: bool = True) -> DataFrame:
    """Long form `column`, `value` of the tag columns that exist: trimmed, without NULLs and default words."""
    present = [c for c in columns if c in df.columns]
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), strip(F.col(c).cast("string")).alias("value")) for c in present])
    long = df.select(F.inline(cells)).where(F.col("value").isNotNull())
    return long.where(~F.col("value").isin(DEFAULT_TAG_WORDS)) if drop_defaults else long


def tag_counts(df: DataFrame, columns: Sequence[str] = TAG_COLUMNS) -> DataFrame:
    """Distinct values with their row counts `n`."""
    return tag_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_per_group(df: DataFrame, groups: Sequence[str], most: int, *order: Column) -> DataFrame:
    """The first `most` rows of every group; each task cuts its share before the shuffle. Adds `place`."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("place") <= most)


def top_tags(df: DataFrame, columns: Sequence[str] = TAG_COLUMNS, most: int = 20) -> DataFrame:
    """Ties go to the smaller value."""
    return top_per_group(tag_counts(df, columns), ["column"], most, F.desc("n"), F.asc("value"))


def ragged_tags(df: DataFrame, columns: Sequence[str] = TAG_COLUMNS) -> DataFrame:
    """Sorted distinct values side by side, NULL below the end of a short column; `position` from 0."""
    placed = dense_positions(tag_values(df, columns), ["column"], "value")
    return placed.groupBy("position").pivot("column", list(columns)).agg(F.first("value"))


def taxonomy_report(df: DataFrame, columns: Sequence[str] = TAG_COLUMNS, most: int = 20) -> DataFrame:
    """Per column its distinct count and its top values in order."""
    counts = tag_counts(df, columns)
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("rows"))
    top = top_per_group(counts, ["column"], most, F.desc("n"), F.asc("value"))
    return top.join(sizes, "column").select("column", "distinct_values", "rows", "place", "value", "n")
