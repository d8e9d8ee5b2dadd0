"""Column and target profiles (A1-A8, A31, A34, A37, A39, A40). Each profile reads the rows once, plus one pass for quantiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.operators.ordering import exact_quantiles
from postlens.operators.targets import task_columns, to_long
from postlens.settings import PROFILE_PERCENTILES, VECTOR_PREFIXES

NUMERIC = (T.NumericType,)


def wide_aggregate(
    df: DataFrame, columns: Mapping[str, Column], measures: Mapping[str, Callable[[Column], Column]], label: str
) -> DataFrame:
    """One aggregation over all `columns`, turned to one row per column: label, then the measures."""
    cells = [f(c).alias(f"{i}_{m}") for i, c in enumerate(columns.values()) for m, f in measures.items()]
    lines = [
        F.struct(F.lit(name).alias(label), *[F.col(f"{i}_{m}").alias(m) for m in measures])
        for i, name in enumerate(columns)
    ]
    return df.agg(*cells).select(F.inline(F.array(*lines)))


def _moments(ddof: int) -> dict[str, Callable[[Column], Column]]:
    std, var = (F.stddev_samp, F.var_samp) if ddof else (F.stddev_pop, F.var_pop)
    return {"mean": F.avg, "std": std, "variance": var, "min": F.min, "max": F.max}


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def _present(df: DataFrame, tasks: Sequence[str] | None) -> dict[str, str]:
    return {t: c for t, c in task_columns(tasks).items() if c in df.columns}


def distinct_counts(long: DataFrame, group: str, value: str) -> DataFrame:
    """Distinct values per group; they fold into (group, value) pairs first, so no group meets in one task."""
    return long.select(group, value).distinct().groupBy(group).agg(F.count(value).alias("distinct_values"))


def target_profile(df: DataFrame, tasks: Sequence[str] | None = None) -> DataFrame:
    """A1: NULLs are counted, then count as 0. Sample variance, exact median."""
    present = _present(df, tasks)
    measures = {
        "rows": lambda c: F.count(c),
        **_moments(1),
        "zeros": lambda c: F.count_if(c == 0),
    }
    stats = wide_aggregate(df, {t: _filled(c) for t, c in present.items()}, measures, "task")
    nulls = wide_aggregate(
        df, {t: F.col(c) for t, c in present.items()}, {"nulls": lambda c: F.count_if(c.isNull())}, "task")
    long = to_long(df, list(present)).withColumn("value", F.coalesce("value", F.lit(0.0)))
    middle = exact_quantiles(long, ["task"], "value", [0.5]).select("task", F.col("quantiles")[0].alias("median"))
    return (
        stats.join(nulls, "task").join(middle, "task", "left")
        .join(distinct_counts(long, "task", "value"), "task", "left")
    )


def target_quantiles(
    df: DataFrame, tasks: Sequence[str] | None = None, probs: Sequence[float] = PROFILE_PERCENTILES
) -> DataFrame:
    """A2: one column p<percent> each, for targets with more than one value (NULL counts as 0)."""
    long = to_long(df, list(_present(df, tasks))).withColumn("value", F.coalesce("value", F.lit(0.0)))
    picked = exact_quantiles(long, ["task"], "value", [0.0, *probs, 1.0])
    q = F.col("quantiles")
    return picked.where(q[0] < q[len(probs) + 1]).select(
        "task", *[q[i + 1].alias(f"p{round(p * 100):d}") for i, p in enumerate(probs)])


def flag_targets(profile: DataFrame) -> DataFrame:
    """A3: constant, near_constant, limited or ok."""
    flag = (
        F.when(F.col("distinct_values") <= 1, "constant")
        .when(F.col("variance") < 1e-8, "near_constant")
        .when(F.col("distinct_values") < 10, "limited")
        .otherwise("ok")
    )
    return profile.withColumn("flag", flag)


def target_report(df: DataFrame, tasks: Sequence[str] | None = None) -> DataFrame:
    """A4: every requested task with its status: missing, constant, near_constant, limited or ok."""
    wanted = task_columns(tasks)
    flags = flag_targets(target_profile(df, tasks)).select("task", "flag", "rows")
    absent = [t for t, c in wanted.items() if c not in df.columns]
    spark, width = df.sparkSession, len(df.columns)
    if absent:
        total = df.agg(F.count(F.lit(1)).alias("rows"))
        gone = total.select(F.explode(F.lit(absent)).alias("task"), F.lit("missing").alias("flag"), "rows")
        flags = flags.unionByName(gone)
    return flags.withColumn("columns", F.lit(width).cast("int"))


def null_report(df: DataFrame) -> DataFrame:
    """A5: column, type, NULL count and share, for every column in one aggregation."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    counts = wide_aggregate(
        df, {c: F.col(f"`{c}`") for c in df.columns},
        {"nulls": lambda c: F.count_if(c.isNull()), "rows": lambda c: F.count(F.lit(1))}, "column")
    kinds = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return counts.select(
        "column", kinds[F.col("column")].alias("type"), "nulls", "rows",
        F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(0.0).alias("null_share"))


def table_issues(df: DataFrame, label: str = "ctr", vectors: Sequence[str] = ()) -> DataFrame:
    """A5: issues of the table as a whole: empty, label absent or NULL, no vector column."""
    has_label, has_vector = label in df.columns, any(v in df.columns for v in vectors)
    nulls = F.count_if(F.col(label).isNull()) if has_label else F.lit(0)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), nulls.cast("bigint").alias("label_nulls"))
    checks = [
        ("empty_table", F.col("rows") == 0),
        ("label_absent", F.lit(not has_label)),
        ("label_has_nulls", F.col("label_nulls") > 0),
        ("no_vectors", F.lit(not has_vector)),
    ]
    lines = F.array(*[F.struct(F.lit(n).alias("issue"), c.alias("found")) for n, c in checks])
    return counts.select(F.inline(lines))


def label_check(df: DataFrame, label: str = "ctr") -> DataFrame:
    """One row of counts and flags."""
    c = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(c.isNull()).alias("nulls"),
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.count_if(c < 0).alias("negatives"),
        F.count_if(c > 1).alias("above_one"),
    ).withColumn("constant", F.coalesce(F.col("std") < 1e-8, F.lit(True)))


def value_quality(long: DataFrame, group: str, value: str) -> DataFrame:
    """Population moments, distinct, missing and zero counts of a long table, with flags."""
    v = F.col(value)
    stats = long.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count_if(v.isNull()).alias("missing"), F.count_if(v == 0).alias("zeros"),
    )
    joined = stats.join(distinct_counts(long, group, value), group, "left")
    rows, distinct = F.col("rows"), F.coalesce("distinct_values", F.lit(0))
    return joined.withColumns({
        "distinct_values": distinct,
        "missing_ratio": F.col("missing") / rows,
        "zero_ratio": F.col("zeros") / rows,
        "is_constant": F.coalesce(F.col("std") < 1e-8, F.lit(True)),
        "is_sparse": F.col("missing") / rows > 0.1,
        "is_limited": distinct < 10,
    })


def prediction_quality(long: DataFrame, group: str = "task", value: str = "y_pred") -> DataFrame:
    """Constant predictions, else fewer than 5 distinct ones."""
    quality = value_quality(long, group, value)
    flag = F.when(F.col("is_constant"), "constant").when(F.col("distinct_values") < 5, "limited").otherwise("ok")
    return quality.select(group, "rows", "mean", "std", "min", "max", "distinct_values", flag.alias("flag"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per column."""
    cast = {c: F.col(c).cast("double") for c in columns}
    stats = wide_aggregate(
        df, cast, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}, "column")
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("column"), c.alias("value")) for n, c in cast.items()])))
    q = exact_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75])
    quartiles = q.select(
        "column", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))])
    return stats.join(quartiles, "column", "left")


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column present (else status missing): constant when min = max or all is NULL."""
    present = [c for c in columns if c in df.columns]
    absent = [c for c in columns if c not in df.columns]
    ends = wide_aggregate(
        df, {c: F.col(c) for c in present},
        {"constant": lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True))}, "column")
    status = ends.select("column", F.when(F.col("constant"), "constant").otherwise("ok").alias("status"))
    if absent:
        status = status.unionByName(
            df.sparkSession.createDataFrame([(c, "missing") for c in absent], "column string, status string"))
    return status


def column_profile(df: DataFrame, id_columns: Sequence[str] = ("note_id", "user_id", "title", "nickname",
                                                               "file_url_list", "first_file_id", "content", "tag_info")) -> DataFrame:
    """Role (meta, vector, other), type, rows that hold a value, mean of numeric columns."""
    def role(field):
        if field.name in id_columns:
            return "meta"
        if isinstance(field.dataType, T.ArrayType) or field.name.startswith(tuple(VECTOR_PREFIXES.values())):
            return "vector"
        return "other"

    counted = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"n{i}") for i, f in enumerate(df.schema.fields)], *[
        F.avg(F.col(f"`{f.name}`")).alias(f"m{i}")
        for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, NUMERIC)])
    lines = [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(role(f)).alias("role"),
            F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n{i}").alias("non_null"),
            (F.col(f"m{i}") if isinstance(f.dataType, NUMERIC) else F.lit(None)).cast("double").alias("mean"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counted.select(F.inline(F.array(*lines)))


def auxiliary_audit(df: DataFrame) -> DataFrame:
    """Image counts, share of rows with recognised text, confidence over positive values."""
    n, text, conf = F.col("num_images"), F.col("ocr_text"), F.col("ocr_confidence")
    positive = F.when(conf > 0, conf)
    return df.agg(
        F.avg(n).alias("images_mean"), F.stddev_samp(n).alias("images_std"),
        F.min(n).alias("images_min"), F.max(n).alias("images_max"), F.count_if(n == 0).alias("images_zero"),
        F.count_if(text.isNotNull() & (text != "")).alias("texts"),
        (F.count_if(text.isNotNull() & (text != "")) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("text_pct"),
        F.coalesce(F.avg(positive), F.lit(0.0)).alias("confidence_mean"),
        F.coalesce(F.stddev_samp(positive), F.lit(0.0)).alias("confidence_std"),
        F.count(positive).alias("confident_rows"),
    )
