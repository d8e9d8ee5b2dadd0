"""Regression, rank and loss metrics on a long prediction table: task, y_true, y_pred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.special import t_two_sided
from postlens.operators.joins import small_map
from postlens.operators.ordering import exact_quantiles, running_weight, weighted_ranks
from postlens.operators.targets import task_columns
from postlens.settings import TASK_WEIGHTS


def _scored(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())


def regression_metrics(predictions: DataFrame, *groups: str) -> DataFrame:
    """MSE, MAE, RMSE, R2 and rows per group, over rows that have both values."""
    groups = groups or ("task",)
    err = F.col("y_true") - F.col("y_pred")
    sums = _scored(predictions).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("valid_samples"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.var_pop("y_true").alias("_var"),
    )
    mse, var = F.col("mse"), F.col("_var")
    return sums.select(
        *groups, "valid_samples", "mse", "mae", F.sqrt("mse").alias("rmse"),
        F.when(var > 0, 1 - mse / F.when(var > 0, var)).otherwise(F.when(mse == 0, 1.0).otherwise(0.0)).alias("r2"),
    )


def spearman(predictions: DataFrame, with_p: bool = True) -> DataFrame:
    """Rank correlation with average ranks and its two-sided p value.

    Equal (y_true, y_pred) pairs fold first; a value held by many rows is one row of the rank table, and the
    rank joins are ordinary equi-joins whose hot keys adaptive execution splits.
    """
    pairs = _scored(predictions).groupBy("task", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    true_rank = weighted_ranks(pairs, ["task"], "y_true", "n", "rx")
    pred_rank = weighted_ranks(pairs, ["task"], "y_pred", "n", "ry").drop("total")
    n, total = F.col("n"), F.col("total")
    # Average ranks have the mean (total + 1) / 2, so the sums are centred without another pass.
    rx, ry = F.col("rx") - (total + 1) / 2, F.col("ry") - (total + 1) / 2
    sums = pairs.join(true_rank, ["task", "y_true"]).join(pred_rank, ["task", "y_pred"]).groupBy("task").agg(
        F.max(total).alias("valid_samples"),
        F.sum(n * rx * ry).alias("_xy"), F.sum(n * rx * rx).alias("_xx"), F.sum(n * ry * ry).alias("_yy"),
    )
    scale = F.sqrt(F.col("_xx") * F.col("_yy"))
    out = sums.select("task", "valid_samples", F.when(scale > 0, F.col("_xy") / scale).alias("spearman"))
    if not with_p:
        return out
    rho, dof = F.col("spearman"), F.col("valid_samples") - 2
    t = rho * F.sqrt(dof / F.greatest(1 - rho * rho, F.lit(1e-300)))
    return out.withColumn("spearman_p", F.when(dof > 0, t_two_sided(F.coalesce(t, F.lit(0.0)), dof.cast("double"))))


def median_labels(predictions: DataFrame, value: str = "y_true", group: str = "task") -> DataFrame:
    """Adds `label`, 1 above the median of the group and 0 otherwise; rows without a value are left out."""
    rows = predictions.where(F.col(value).isNotNull())
    middle = exact_quantiles(rows, [group], value, [0.5]).select(group, F.col("quantiles")[0].alias("median"))
    return rows.withColumn("_m", small_map(middle, group, "median").scalar()).withColumn(
        "label", (F.col(value) > F.try_element_at(F.col("_m"), F.col(group))["median"]).cast("int")).drop("_m")


def auc(predictions: DataFrame, label: str = "label", score: str = "y_pred", group: str = "task") -> DataFrame:
    """Rank-sum form, exact with ties. Needs no join: each distinct score carries its positives."""
    counts = predictions.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(group, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    placed = running_weight(counts, [group], [score], F.col("n"))
    rank = F.col("before") + (F.col("n") + 1) / 2
    sums = placed.groupBy(group).agg(
        F.sum(F.col("positives") * rank).alias("_r"),
        F.sum("positives").alias("positives"), F.sum(F.col("n") - F.col("positives")).alias("negatives"))
    pos, neg = F.col("positives").cast("double"), F.col("negatives").cast("double")
    area = F.when((pos > 0) & (neg > 0), (F.col("_r") - pos * (pos + 1) / 2) / F.when(pos * neg > 0, pos * neg))
    return sums.select(group, "positives", "negatives", area.alias("auc"))


def shape(predictions: DataFrame) -> DataFrame:
    """Mean, population std, min, max, population skewness, excess kurtosis of both columns, with labels."""
    cells, out = [], ["task"]
    for name in ("y_pred", "y_true"):
        c = F.col(name)
        cells += [
            F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"),
            F.max(c).alias(f"{name}_max"), F.skewness(c).alias(f"{name}_skew"), F.kurtosis(c).alias(f"{name}_kurt"),
        ]
    moments = _scored(predictions).groupBy("task").agg(*cells)
    for name in ("y_pred", "y_true"):
        s, k = F.col(f"{name}_skew"), F.col(f"{name}_kurt")
        moments = moments.withColumns({
            f"{name}_skew_label": F.when(s > 0.5, "right").when(s < -0.5, "left").otherwise("symmetric"),
            f"{name}_kurt_label": F.when(k > 1, "heavy").when(k < -1, "light").otherwise("normal"),
        })
    return moments


def compare_shapes(predictions: DataFrame) -> DataFrame:
    """A10: differences of prediction and target distribution and whether their shapes are alike."""
    def pct(diff: Column, base: Column) -> Column:
        return F.when(base != 0, diff / F.when(base != 0, base) * 100).otherwise(0.0)

    m = shape(predictions)
    mean_diff = F.col("y_pred_mean") - F.col("y_true_mean")
    std_diff = F.col("y_pred_std") - F.col("y_true_std")
    skew_like = F.abs(F.col("y_pred_skew") - F.col("y_true_skew")) < 0.5
    kurt_like = F.abs(F.col("y_pred_kurt") - F.col("y_true_kurt")) < 1.0
    return m.withColumns({
        "mean_diff": mean_diff, "mean_diff_pct": pct(mean_diff, F.col("y_true_mean")),
        "std_diff": std_diff, "std_diff_pct": pct(std_diff, F.col("y_true_std")),
        "skew_similar": skew_like, "kurt_similar": kurt_like, "shape_similar": skew_like & kurt_like,
    })


def masked_mse(predictions: DataFrame) -> DataFrame:
    """Over rows with a target; a task without any loses nothing."""
    err = F.col("y_true") - F.col("y_pred")
    valid = F.count("y_true")
    return predictions.groupBy("task").agg(
        valid.alias("valid"),
        (F.coalesce(F.sum(err * err), F.lit(0.0)) / F.greatest(valid, F.lit(1))).alias("masked_mse"))


def task_losses(
    predictions: DataFrame, weights: Mapping[str, float] = TASK_WEIGHTS, masked: Sequence[str] = (),
    reduction: str = "mean",
) -> DataFrame:
    """A15 per task: weight, loss, weighted. Tasks in `masked` skip missing targets, the others read them as 0."""
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction {reduction}")
    is_masked = F.col("task").isin(list(masked)) if masked else F.lit(False)
    target = F.when(is_masked, F.col("y_true")).otherwise(F.coalesce("y_true", F.lit(0.0)))
    err = target - F.col("y_pred")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    weight = F.coalesce(F.try_element_at(table, F.col("task")), F.lit(1.0)) if weights else F.lit(1.0)
    total = F.coalesce(F.sum(err * err), F.lit(0.0))
    loss = total if reduction == "sum" else total / F.greatest(F.count(err), F.lit(1))
    return predictions.groupBy("task").agg(loss.alias("loss")).select(
        "task", weight.alias("weight"), "loss", (weight * F.col("loss")).alias("weighted"))


def multitask_loss(predictions: DataFrame, **options) -> DataFrame:
    """The weighted sum over tasks."""
    return task_losses(predictions, **options).agg(F.sum("weighted").alias("loss"))


def variance_weights(df: DataFrame, tasks: Sequence[str], epsilon: float = 1e-8) -> DataFrame:
    """Inverse-variance weights that sum to the number of tasks; an absent task has variance epsilon."""
    columns = task_columns(tasks)
    absent = F.lit(0.0)
    cells = [
        (F.coalesce(F.var_pop(c), absent) if c in df.columns else absent).alias(f"v{i}")
        for i, c in enumerate(columns.values())
    ]
    row = df.agg(F.count(F.lit(1)), *cells)
    inverse = [1.0 / (F.col(f"v{i}") + epsilon) for i in range(len(columns))]
    total = sum(inverse[1:], inverse[0])
    lines = F.array(*[
        F.struct(F.lit(t).alias("task"), (inv / total * len(columns)).alias("weight"))
        for t, inv in zip(columns, inverse)])
    return row.select(F.inline(lines))


def missing_tasks(predictions: DataFrame, threshold: float = 0.01, value: str = "y_true") -> DataFrame:
    """Tasks whose share of missing targets is above the threshold."""
    share = F.count_if(F.col(value).isNull()) / F.count(F.lit(1))
    return predictions.groupBy("task").agg(share.alias("missing_ratio")).where(F.col("missing_ratio") > threshold)


def split_profile(long: DataFrame, value: str = "value") -> DataFrame:
    """Per split and task: rows, mean, population std, distinct values, constant flag."""
    keys = ["split", "task"]
    stats = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    distinct = long.select(*keys, value).distinct().groupBy(*keys).agg(F.count(value).alias("distinct_values"))
    return stats.join(distinct, keys).withColumn("constant", F.coalesce(F.col("std") < 1e-8, F.lit(True)))
