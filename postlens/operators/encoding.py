"""Category codes, scalers and label normalisers as small tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from postlens.functions.numeric import fill_category, to_number
from postlens.operators.joins import lookup_codes, small_map
from postlens.operators.ordering import dense_positions, exact_quantiles
from postlens.operators.profile import wide_aggregate
from postlens.operators.targets import to_long


def fit_vocabulary(df: DataFrame, columns: Sequence[str], fill: str = "missing") -> DataFrame:
    """Feature, value, code; codes count from 0 in the order of the values. One plan for all columns."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), fill_category(c, fill).alias("value")) for c in columns])
    return dense_positions(df.select(F.inline(cells)), ["feature"], "value", "code")


def vocabulary_sizes(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.groupBy("feature").agg(F.count(F.lit(1)).alias("size"))


def encode(
    df: DataFrame, vocabulary: DataFrame, columns: Sequence[str], fill: str = "missing", unseen: str = "zero",
    suffix: str = "_code",
) -> DataFrame:
    """Adds one code column per category. unseen="zero" shares code 0, "reserve" takes the code after the last."""
    if unseen not in ("zero", "reserve"):
        raise ValueError(f"unknown policy {unseen}")
    for c in columns:
        own = vocabulary.where(F.col("feature") == c)
        df = df.withColumn(c, fill_category(c, fill))
        if unseen == "reserve":
            size = own.agg(F.count(F.lit(1)).alias("n"))
            df = df.withColumn("_size", size.scalar())
            df = lookup_codes(df, own, c, c + suffix, F.col("_size")).drop("_size")
        else:
            df = lookup_codes(df, own, c, c + suffix, F.lit(0).cast("bigint"))
    return df


def _nonzero(scale: Column) -> Column:
    return F.when(scale == 0, F.lit(1.0)).otherwise(scale)


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature, center, scale with the population deviation; a constant column is divided by 1."""
    stats = wide_aggregate(df, {c: to_number(c) for c in columns}, {"center": F.avg, "std": F.stddev_pop}, "feature")
    return stats.select("feature", "center", _nonzero(F.col("std")).alias("scale"))


def _fitted(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_fit", small_map(stats, key, "center", "scale").scalar())


def scale(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """E3 applied in place, as float; a column that was not fitted is an error at fit time, so it is left as it is."""
    fitted = _fitted(df, scaler, "feature")
    out = {}
    for c in columns:
        cell = F.col("_fit")[c]
        out[c] = F.coalesce((to_number(c) - cell["center"]) / cell["scale"], to_number(c)).cast("float")
    return fitted.withColumns(out).drop("_fit")


def fit_vector_scaler(df: DataFrame, vector: str) -> DataFrame:
    """E3 for an array column: one row with arrays center and scale (population deviation)."""
    summary = df.where(F.col(vector).isNotNull()).agg(
        Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(vector)).alias("s"))
    n = F.col("s.count").cast("double")
    return summary.select(
        vector_to_array("s.mean").alias("center"),
        F.transform(vector_to_array("s.variance"), lambda v: _nonzero(F.sqrt(v * (n - 1) / n))).alias("scale"),
    )


def scale_vector(df: DataFrame, scaler: DataFrame, vector: str, name: str) -> DataFrame:
    fit = scaler.select(F.struct("center", "scale"))
    centred = F.zip_with(vector, "_fit.center", lambda x, m: x.cast("double") - m)
    return df.withColumn("_fit", fit.scalar()).withColumn(
        name, F.zip_with(centred, "_fit.scale", lambda x, s: x / s)).drop("_fit")


def fit_labels(df: DataFrame, tasks: Mapping[str, str], method: str = "standard") -> DataFrame:
    """E5: task, method, center, scale over the rows given (the training rows)."""
    present = {t: F.col(c).cast("double") for t, c in tasks.items() if c in df.columns}
    if method == "standard":
        s = wide_aggregate(df, present, {"center": F.avg, "width": F.stddev_pop}, "task")
    elif method == "minmax":
        s = wide_aggregate(df, present, {"center": F.min, "width": lambda c: F.max(c) - F.min(c)}, "task")
    elif method == "robust":
        q = exact_quantiles(to_long(df, list(present)), ["task"], "value", [0.25, 0.5, 0.75])
        values = F.col("quantiles")
        s = q.select("task", values[1].alias("center"), (values[2] - values[0]).alias("width"))
    else:
        raise ValueError(f"unknown normalisation {method}")
    return s.select("task", F.lit(method).alias("method"), "center", _nonzero(F.col("width")).alias("scale"))


def normalise_labels(df: DataFrame, stats: DataFrame, tasks: Mapping[str, str]) -> DataFrame:
    """E5: adds `{task}_norm`; an absent target gives 0, an unfitted task keeps its value."""
    fitted = _fitted(df, stats, "task")
    out = {}
    for task, c in tasks.items():
        if c not in df.columns:
            out[f"{task}_norm"] = F.lit(0.0)
            continue
        cell, value = F.col("_fit")[task], F.col(c).cast("double")
        out[f"{task}_norm"] = F.when(cell.isNull(), value).otherwise((value - cell["center"]) / cell["scale"])
    return fitted.withColumns(out).drop("_fit")


def denormalise(long: DataFrame, stats: DataFrame, value: str = "y_pred", name: str | None = None) -> DataFrame:
    """E6 on a long table with a `task` column; an unfitted task passes through."""
    fitted = _fitted(long, stats, "task")
    cell = F.try_element_at(F.col("_fit"), F.col("task"))
    back = F.when(cell.isNull(), F.col(value)).otherwise(F.col(value) * cell["scale"] + cell["center"])
    return fitted.withColumn(name or value, back).drop("_fit")


def label_report(stats: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """The fitted statistics of every task asked for, `missing` where there are none."""
    known = stats.select(
        "task", F.lit("fitted").alias("status"), "method",
        F.when(F.col("method") == "standard", F.col("center")).alias("mean"),
        F.when(F.col("method") == "standard", F.col("scale")).alias("std"),
        F.when(F.col("method") == "minmax", F.col("center")).alias("min"),
        F.when(F.col("method") == "minmax", F.col("center") + F.col("scale")).alias("max"),
    )
    wanted = stats.sparkSession.createDataFrame([(t,) for t in tasks], "task string")
    return wanted.join(known, "task", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
