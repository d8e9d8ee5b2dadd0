"""How much vectors help to predict the click rate (M2-M6)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.literals import literal_rows
from postlens.functions.text import has_text
from postlens.operators import encoding, metrics
from postlens.operators.ordering import median
from postlens.operators.sampling import bucket, folds
from postlens.plans.training import score_table
from postlens.session import cut_lineage

CATEGORIES = ["type", "taxonomy1", "taxonomy2", "taxonomy3", "intention_lv1"]
NUMBERS = ["question_marks", "exclamation_marks"]
SIGNIFICANT = 0.01


def forest(trees: int = 50, depth: int = 5, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")


def _dim(df: DataFrame, column: str) -> int:
    line = df.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).head()
    return line["n"] if line else 0


def assemble(df: DataFrame, key: str, image: str, text: str, label: str = "ctr") -> tuple[DataFrame, dict[str, list[int]]]:
    """One frame for every feature set: key, label, features; and where other, image and text features sit in it."""
    cats = [c for c in CATEGORIES if c in df.columns]
    nums = [c for c in NUMBERS if c in df.columns]
    rows = df
    if cats:
        rows = encoding.encode(rows, encoding.fit_vocabulary(df, cats, "unknown"), cats, "unknown")
    others = [F.col(f"{c}_code") for c in cats] + [F.coalesce(F.col(c), F.lit(0)) for c in nums]
    if "ocr_text" in df.columns:
        others.append(has_text(F.col("ocr_text")))
    others = others or [F.lit(0.0)]
    head = F.array(*[c.cast("double") for c in others])
    wide = F.concat(head, F.transform(image, lambda x: x.cast("double")), F.transform(text, lambda x: x.cast("double")))
    prepared = rows.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"), array_to_vector(wide).alias("all"))
    a, b = len(others), len(others) + _dim(df, image)
    return prepared, {"other": list(range(a)), "image": list(range(a, b)), "text": list(range(b, b + _dim(df, text)))}


FEATURE_SETS = {
    "baseline_all": ("other", "image", "text"),
    "no_image": ("other", "text"),
    "no_text": ("other", "image"),
    "no_clip": ("other",),
    "only_image": ("image",),
    "only_text": ("text",),
    "only_clip": ("image", "text"),
}


def ablation(
    df: DataFrame, key: str = "note_id", image: str = "image_vec", text: str = "text_vec", label: str = "ctr",
    trees: int = 50, depth: int = 5, k: int = 5, threads: int = 4, only: Sequence[str] | None = None,
) -> DataFrame:
    """M5: per feature set: features, test mse, r2, spearman, and mean and std (ddof 0) of r2 over k folds, NULL without folds.

    The rows are assembled once, into the checkpoint folder; each set is a slice of the vector. Sets are fitted side by side,
    each fit being a Spark job over all training rows; the metrics of all sets come from one table of predictions. `only`
    names the sets that are wanted, each as it is among all of them.
    """
    prepared, places = assemble(df, key, image, text, label)
    marked = folds(prepared, "key", max(k, 1)).withColumn("test", bucket("key", "42") < 2000)
    kept = cut_lineage(marked.select("label", "all", "fold", "test")).persist()
    spark = df.sparkSession

    def run(item: tuple[str, tuple[str, ...]]) -> tuple:
        name, parts = item
        indices = [i for p in parts for i in places[p]]
        sliced = VectorSlicer(inputCol="all", outputCol="features", indices=indices).transform(kept)
        train, test = sliced.where(~F.col("test")), sliced.where("test")
        r2 = RegressionEvaluator(metricName="r2", labelCol="label")
        held = [
            r2.evaluate(forest(trees, depth).fit(train.where(F.col("fold") != i)).transform(train.where(F.col("fold") == i)))
            for i in range(k)
        ]
        predictions = cut_lineage(score_table(forest(trees, depth).fit(train).transform(test), "label", task=name))
        return name, len(indices), predictions, *((float(np.mean(held)), float(np.std(held))) if held else (None, None))

    sets = [(n, p) for n, p in FEATURE_SETS.items() if any(places[x] for x in p) and (only is None or n in only)]
    with ThreadPool(threads) as pool:
        fitted = pool.map(run, sets, chunksize=1)
    predictions = reduce(DataFrame.unionByName, [f[2] for f in fitted])
    table = metrics.regression_metrics(predictions).join(metrics.spearman(predictions, with_p=False).select("task", "spearman"), "task")
    lines = {r["task"]: r.asDict() for r in table.collect()}
    rows = [(name, width, *[lines.get(name, {}).get(c) for c in ("mse", "r2", "spearman")], *cv) for name, width, _, *cv in fitted]
    kept.unpersist()
    return literal_rows(
        spark, rows,
        "feature_set string, features int, mse double, r2 double, spearman double, cv_r2_mean double, cv_r2_std double")


CONTRIBUTION_SETS = ("baseline_all", "no_image", "no_text")


def contributions(results: DataFrame) -> DataFrame:
    """M6 over an ablation table (of CONTRIBUTION_SETS at least, folds are not read): what dropping each vector group costs, and the advice that follows."""
    def r2(name: str):
        return F.max(F.when(F.col("feature_set") == name, F.col("r2")))

    row = results.agg(*[r2(s).alias(c) for s, c in zip(CONTRIBUTION_SETS, ("all", "image", "text"), strict=True)])
    lines = F.array(*[
        F.struct(F.lit(f"{g}_features").alias("feature_group"), (F.col("all") - F.col(g)).alias("r2_contribution"))
        for g in ("image", "text")])
    diff = F.col("r2_contribution")
    return row.select("all", F.inline(lines)).select(
        "feature_group", "r2_contribution",
        (diff / F.greatest("all", F.lit(0.001)) * 100).alias("relative_pct"),
        (diff > 0).alias("is_positive"), (F.abs(diff) > SIGNIFICANT).alias("is_significant"),
        F.when(~(diff > 0), "remove").when(F.abs(diff) > SIGNIFICANT, "keep").otherwise("optional").alias("advice"),
    ).where(diff.isNotNull())


def set_advice(results: DataFrame) -> DataFrame:
    """M6: vectors alone against the other features alone."""
    clip = F.max(F.when(F.col("feature_set") == "only_clip", F.col("r2")))
    other = F.max(F.when(F.col("feature_set") == "no_clip", F.col("r2")))
    c, o = F.col("clip_r2"), F.col("other_r2")
    advice = F.when((c < 0.01) & (o > 0.02), "improve_other_features").when(c > o * 2, "tune_vectors").otherwise("none")
    return results.agg(clip.alias("clip_r2"), other.alias("other_r2")).withColumn("advice", advice)


def click_prediction(
    df: DataFrame, key: str = "note_id", image: str = "image_vec", text: str = "text_vec", label: str = "ctr",
    trees: int = 50, depth: int = 5,
) -> DataFrame:
    """M2, M3: logistic AUC on labels above the median, forest MSE, R2 and Spearman, on a 20 % test split."""
    middle = median(df.select(label), label)
    wide = F.concat(F.transform(image, lambda x: x.cast("double")), F.transform(text, lambda x: x.cast("double")))
    rows = df.select(
        F.col(label).cast("double").alias("label"), array_to_vector(wide).alias("features"),
        (bucket(key, "42") < 2000).alias("test"),
    ).withColumn("median", middle.scalar()).withColumn("high", (F.col("label") > F.col("median")).cast("double"))
    rows = cut_lineage(rows).persist()
    train, test = rows.where(~F.col("test")), rows.where("test")
    n = train.count()
    logistic = LogisticRegression(
        maxIter=100, standardization=False, regParam=1.0 / max(n, 1), featuresCol="features", labelCol="high").fit(train)
    ranked = logistic.transform(test).select(
        F.lit("ctr").alias("task"), "high", vector_to_array("probability")[1].alias("p"))
    area = metrics.auc(ranked, "high", "p").head()
    predictions = cut_lineage(score_table(forest(trees, depth).fit(train).transform(test), "label"))
    line, rho = metrics.regression_metrics(predictions).head(), metrics.spearman(predictions, with_p=False).head()
    middle_value = rows.select("median").head()["median"]
    rows.unpersist()
    return literal_rows(
        df.sparkSession, [(area["auc"], line["mse"], line["r2"], rho["spearman"], middle_value)],
        "logistic_auc double, rf_mse double, rf_r2 double, spearman double, median_ctr double")


def importance(
    df: DataFrame, key: str = "note_id", image: str = "image_vec", text: str = "text_vec", label: str = "ctr",
    trees: int = 50, depth: int = 5, most: int = 10,
) -> DataFrame:
    """M4: per vector group: mean and largest forest importance and the `most` strongest dimensions."""
    wide = F.concat(F.transform(image, lambda x: x.cast("double")), F.transform(text, lambda x: x.cast("double")))
    rows = df.select(F.col(label).cast("double").alias("label"), array_to_vector(wide).alias("features"))
    weights = forest(trees, depth).fit(rows).featureImportances.toArray()
    dims = {"image": _dim(df, image)}
    parts = {"image": weights[:dims["image"]], "text": weights[dims["image"]:]}
    lines = [
        (g, float(w.mean()), float(w.max()), [int(i) for i in sorted(range(len(w)), key=lambda i: (-w[i], i))[:most]])
        for g, w in parts.items() if len(w)
    ]
    return literal_rows(
        df.sparkSession, lines,
        "feature_group string, mean_importance double, max_importance double, top_dims array<int>")
