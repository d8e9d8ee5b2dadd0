"""Runs over time: throughput, loss curves, model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.operators.taxonomy import top_per_group


def throughput_trend(batches: DataFrame, block: int = 4096) -> DataFrame:
    """W6 after every batch of a run (run_id, batch from 1 without gaps, seconds).

    mean_last10, mean_last3, mean_before3 and trend from the fifth batch on: slowing when the last three
    took over 1.2 times the three before, speeding under 0.8. Windows look back nine batches, so a long
    run is cut into blocks that carry the nine rows before them.
    """
    reach = 9
    own = F.floor((F.col("batch") - 1) / block)
    halo = F.when(F.floor((F.col("batch") - 1 + reach) / block) > own, F.array(own, own + 1)).otherwise(F.array(own))
    spread = batches.select("*", F.explode(halo).alias("_block"), own.alias("_own"))
    w = Window.partitionBy("run_id", "_block").orderBy("batch")
    seconds = F.col("seconds")
    out = spread.withColumns({
        "mean_last10": F.avg(seconds).over(w.rowsBetween(-reach, 0)),
        "mean_last3": F.avg(seconds).over(w.rowsBetween(-2, 0)),
        "mean_before3": F.avg(seconds).over(w.rowsBetween(-5, -3)),
    }).where(F.col("_block") == F.col("_own"))
    ratio_up = F.col("mean_last3") > F.col("mean_before3") * 1.2
    ratio_down = F.col("mean_last3") < F.col("mean_before3") * 0.8
    trend = F.when(F.col("batch") < 5, "unknown").when(ratio_up, "slowing").when(ratio_down, "speeding").otherwise("steady")
    return out.select("run_id", "batch", "seconds", "mean_last10", "mean_last3", "mean_before3", trend.alias("trend"))


def convergence(history: DataFrame) -> DataFrame:
    """Unconverged when a run has more than five epochs and its last five losses range over 0.01."""
    last = top_per_group(history, ["run_id"], 5, F.desc("epoch")).groupBy("run_id").agg(
        (F.max("loss") - F.min("loss")).alias("last5_range"))
    epochs = history.groupBy("run_id").agg(F.count(F.lit(1)).alias("epochs"))
    return epochs.join(last, "run_id").withColumn(
        "unconverged", (F.col("epochs") > 5) & (F.col("last5_range") > 0.01))


def loss_curve(history: DataFrame) -> DataFrame:
    """First and last losses of a run, reduction in percent, over- and underfitting, good generalisation."""
    ends = history.groupBy("run_id").agg(
        F.min_by("loss", "epoch").alias("first_loss"), F.max_by("loss", "epoch").alias("final_loss"),
        F.min_by("val_loss", "epoch").alias("first_val_loss"), F.max_by("val_loss", "epoch").alias("final_val_loss"),
    )
    first, train, val = F.col("first_loss"), F.col("final_loss"), F.col("final_val_loss")
    over = val > train * 1.5
    return ends.withColumns({
        "reduction_pct": F.when(first != 0, (first - train) / F.when(first != 0, first) * 100).otherwise(0.0),
        "overfitting": over,
        "underfitting": ~over & (val > 0.1) & (train > 0.1),
        "generalises": val < train * 0.8,
    })


def training_quality(history: DataFrame) -> DataFrame:
    """W7 and W8 side by side; joined on the run after each side has one row per run."""
    return convergence(history).join(loss_curve(history), "run_id")


# Criterion -> (metric column, whether the highest value wins).
CRITERIA = {
    "best_fit": ("mse", False),
    "best_r2": ("r2", True),
    "best_ranking": ("spearman", True),
    "fastest": ("seconds", False),
}


def model_ranking(scores: DataFrame, by_abs: bool = True, groups: Sequence[str] = ()) -> DataFrame:
    """The winner per criterion, by absolute value unless by_abs is off; ties go to the smaller name."""
    lines = []
    for name, (metric, high) in CRITERIA.items():
        value = F.coalesce(F.col(metric).cast("double"), F.lit(0.0))
        key = F.abs(value) if by_abs else value
        lines.append(F.struct(
            F.lit(name).alias("criterion"), F.col("model"), value.alias("value"), (-key if high else key).alias("_key")))
    long = scores.select(*groups, F.inline(F.array(*lines)))
    best = top_per_group(long, [*groups, "criterion"], 1, F.col("_key"), F.col("model"))
    return best.select(*groups, "criterion", "model", "value")


def running_share(spectrum: DataFrame, order: str = "component", share: str = "ratio") -> DataFrame:
    """Cumulative share over a table with one row per dimension."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return spectrum.withColumn("cumulative", F.sum(share).over(w))
