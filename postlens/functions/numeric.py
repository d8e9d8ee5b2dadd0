"""Null, NaN and number handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; Spark aggregates skip NULL but carry NaN on."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df


def fill_category(col: Column | str, fill: str = "missing") -> Column:
    """Text of a category with NULL replaced."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(fill))


def to_number(col: Column | str) -> Column:
    """Unparsable, NULL and NaN become 0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.nanvl(col.try_cast("double"), F.lit(None)), F.lit(0.0))


def clip(col: Column, low: float, high: float) -> Column:
    """Clip that keeps NULL (greatest/least alone would skip it)."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def is_rate_task(task: Column) -> Column:
    return task.contains("rate") | (task == F.lit("ctr"))


def clip_rate(task: Column, value: Column) -> Column:
    """rate tasks and ctr are kept in [0, 1]."""
    return F.when(is_rate_task(task), clip(value, 0.0, 1.0)).otherwise(value)


def impression_count(log_value: Column, single: bool = False) -> Column:
    """back from logs; the single-post form answers 1000 for a non-positive log."""
    if single:
        return F.when(log_value > 0, F.exp(log_value)).when(log_value.isNotNull(), F.lit(1000.0))
    return F.exp(log_value)


def confidence_tier(ctr: Column) -> Column:
    """F20."""
    return F.when(ctr > 0.1, "high").when(ctr > 0.05, "medium").otherwise("low")
