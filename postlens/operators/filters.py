"""Row filters and the one-pass funnel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.vectors import any_nonzero
from postlens.settings import LEGACY_PREFIXES


def min_impressions(df: DataFrame, threshold: int, column: str = "imp_num") -> DataFrame:
    """NULL counts as too few; a threshold of 0 or less turns the filter off."""
    return df.where(F.col(column) >= threshold) if threshold > 0 else df


def min_impressions_any(df: DataFrame, threshold: int, names: Sequence[str] = ("imp_num", "impression")) -> DataFrame:
    """On the first of `names` that exists; without one nothing is filtered."""
    column = next((n for n in names if n in df.columns), None)
    return min_impressions(df, threshold, column) if column else df


def sound_counters() -> Column:
    """P3 as one predicate: an id, no negative counter, no more clicks than impressions."""
    return (
        F.col("note_id").isNotNull() & (F.col("note_id") != "")
        & (F.col("imp_num") >= 0) & (F.col("click_num") >= 0)
        & (F.col("click_num") <= F.col("imp_num"))
    )


def quality_filter(df: DataFrame) -> DataFrame:
    """P3."""
    return df.where(sound_counters())


def drop_missing(df: DataFrame, required: Sequence[str] = ("imp_num", "click_num")) -> DataFrame:
    """Over the required columns that exist."""
    present = [c for c in required if c in df.columns]
    return df.dropna(subset=present) if present else df


def nonzero_in_any(vectors: Sequence[str]) -> Column:
    """Some vector of the row has a non-zero element."""
    return reduce(lambda a, b: a | b, [any_nonzero(F.col(v)) for v in vectors])


def drop_zero_vectors(df: DataFrame, vectors: Sequence[str]) -> DataFrame:
    """Over the vector columns that exist; with none nothing is filtered."""
    present = [v for v in vectors if v in df.columns]
    return df.where(nonzero_in_any(present)) if present else df


def valid_labels(df: DataFrame, column: str = "ctr") -> DataFrame:
    """P7."""
    return df.where(F.col(column).between(0, 1))


def rename_vectors(df: DataFrame, prefixes: Mapping[str, str] = LEGACY_PREFIXES) -> DataFrame:
    """One projection over `{old}{i}` columns."""
    renames = {}
    for c in df.columns:
        for old, new in prefixes.items():
            if c.startswith(old) and c[len(old):].isdigit():
                renames[c] = new + c[len(old):]
    return df.withColumnsRenamed(renames) if renames else df


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows dropped by each step in order, from one pass over `df`.

    Columns: step_no, step, rows_in, dropped, rows_out, retained_pct (of the start), few_rows.
    """
    passed = [F.lit(True)]
    for _, predicate in steps:
        passed.append(passed[-1] & F.coalesce(predicate, F.lit(False)))
    counts = df.agg(*[F.count_if(p).alias(f"_c{i}") for i, p in enumerate(passed)])
    lines = [
        F.struct(
            F.lit(i + 1).cast("int").alias("step_no"),
            F.lit(name).alias("step"),
            F.col(f"_c{i}").alias("rows_in"),
            (F.col(f"_c{i}") - F.col(f"_c{i + 1}")).alias("dropped"),
            F.col(f"_c{i + 1}").alias("rows_out"),
            F.when(F.col("_c0") > 0, F.col(f"_c{i + 1}") * 100.0 / F.col("_c0")).otherwise(0.0).alias("retained_pct"),
            (F.col(f"_c{i + 1}") < 100).alias("few_rows"),
        )
        for i, (name, _) in enumerate(steps)
    ]
    return counts.select(F.inline(F.array(*lines)))
