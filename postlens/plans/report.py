"""Evaluation of vectors as one metric table, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions.literals import literal_rows
from postlens.operators import clustering, embedding
from postlens.operators.filters import drop_zero_vectors, funnel, min_impressions, nonzero_in_any, valid_labels
from postlens.operators.sampling import hash_sample
from postlens.plans.ablation import ablation, click_prediction, contributions, importance
from postlens.session import cut_lineage
from postlens.settings import METRIC_GRADES

CATEGORIES = ["taxonomy1", "taxonomy2", "intention_lv1"]
SCHEMA = "layer string, metric string, feature_group string, value double"

# Rule -> (metric, direction, bound, severity). Direction < fires below the bound, > above it.
DIAGNOSIS = [
    ("clusters_mediocre", "silhouette", "<", 0.6, "problem"),
    ("clusters_too_good", "silhouette", ">", 0.9, "warning"),
    ("category_purity_low", "purity", "<", 0.5, "problem"),
    ("alignment_weak", "cohens_d", "<", 0.5, "severe"),
    ("variance_low", "low_variance_pct", ">", 90.0, "severe"),
    ("variance_zero", "zero_variance_pct", ">", 10.0, "warning"),
    ("compressible", "pca_reduction", ">", 0.4, "advice"),
    ("label_unrelated", "max_label_correlation", "<", 0.1, "severe"),
    ("prediction_weak", "auc", "<", 0.65, "warning"),
]
RECOMMENDATIONS = [
    ("drop_dead_dimensions", "zero_variance_pct", ">", 20.0, "act"),
    ("reduce_dimensions", "pca_share_95", "<", 0.7, "keep"),
    ("tune_alignment", "cohens_d", "<", 0.5, "act"),
    ("alignment_strong", "cohens_d", ">", 1.0, "keep"),
    ("features_insufficient", "auc", "<", 0.6, "act"),
    ("features_sufficient", "auc", ">", 0.75, "keep"),
]


# Rows that splits and folds of the task layer need; with fewer, a line says how many there are.
LEAST_LABELS = 100


def _long(df: DataFrame, layer: str, group: str | None, names: Sequence[str], group_column: str | None = None) -> DataFrame:
    owner = F.col(group_column) if group_column else F.lit(group)
    lines = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.lit(layer).alias("layer"), owner.cast("string").alias("feature_group"), F.inline(lines)).select(
        "layer", "metric", "feature_group", "value")


def filter_rows(df: DataFrame, min_imp: int, vectors: Sequence[str], filter_zeros: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows that are evaluated, and the funnel as metrics."""
    rows = min_impressions(df, min_imp) if "imp_num" in df.columns else df
    steps = [("impressions", F.col("imp_num") >= min_imp if "imp_num" in df.columns and min_imp > 0 else F.lit(True))]
    if filter_zeros:
        rows = drop_zero_vectors(rows, vectors)
        steps.append(("zero_vectors", nonzero_in_any(vectors)))
    counts = funnel(df, steps)
    return rows, _long(counts, "filter", None, ["rows_in", "dropped", "rows_out", "retained_pct"], "step")


def embedding_report(
    df: DataFrame, key: str = "note_id", image: str = "image_vec", text: str = "text_vec", label: str = "ctr",
    min_imp: int = 5000, filter_zeros: bool = True, max_rows: int | None = None, counts: Sequence[int] = (10, 20, 30, 50),
    trees: int = 50, depth: int = 5,
) -> DataFrame:
    """Layer, metric, feature_group, value over filter, understanding, quality and task layers.

    max_rows is the caller's sample size, taken after the filters; None evaluates every row.
    """
    vectors = {"image": image, "text": text}
    rows, parts = filter_rows(df, min_imp, list(vectors.values()), filter_zeros)
    parts = [parts]
    if max_rows:
        rows = hash_sample(rows, key, max_rows)
    rows = cut_lineage(rows).persist()

    sweep, best = clustering.cluster_sweep(rows, key, image, counts)
    found = sweep.orderBy(F.desc("silhouette")).limit(1)
    parts.append(_long(found.withColumnRenamed("k", "best_k"), "understanding", "image",
                       ["best_k", "silhouette", "davies_bouldin"]))
    if best is not None and any(c in best.columns for c in CATEGORIES):
        parts.append(_long(clustering.purity(best, CATEGORIES), "understanding", None, ["purity"], "category"))
    similarities = embedding.pair_similarities(rows, key, image, text)
    parts.append(_long(embedding.alignment(similarities).withColumnsRenamed(
        {"mean": "similarity_mean", "std": "similarity_std", "n": "similarity_n"}),
        "understanding", None, ["similarity_mean", "similarity_std", "similarity_n"], "kind"))
    sides = similarities.agg(
        (F.avg(F.when(F.col("kind") == "same", F.col("similarity")))
         - F.avg(F.when(F.col("kind") == "random", F.col("similarity")))).alias("similarity_gap"))
    parts.append(_long(sides, "understanding", None, ["similarity_gap"]))
    parts.append(_long(embedding.cohens_d(similarities), "understanding", None, ["cohens_d"]))
    parts.append(_long(embedding.t_test(similarities), "understanding", None, ["t_statistic", "p_value"]))

    for group, vector in vectors.items():
        dims = embedding.variance_summary(embedding.dimension_variance(rows, vector))
        shares = dims.withColumns({
            "zero_variance_pct": F.col("zero_dims") * 100.0 / F.col("dims"),
            "low_variance_pct": F.col("low_dims") * 100.0 / F.col("dims")})
        parts.append(_long(shares, "quality", group, [
            "dims", "zero_dims", "low_dims", "medium_dims", "high_dims", "effective_dims", "mean_variance",
            "median_variance", "zero_variance_pct", "low_variance_pct"]))
        pairs = embedding.pair_summary(embedding.dimension_pairs(rows, vector))
        parts.append(_long(pairs, "quality", group, ["mean_correlation", "max_correlation", "high_pairs", "pairs"]))
        spectrum = embedding.pca_dims(embedding.explained_variance(rows, vector)).where(F.col("dims") > 0)
        shares = spectrum.withColumn("pca_share_95", F.col("dims_95") / F.col("dims")).withColumn(
            "pca_reduction", 1 - F.col("pca_share_95"))
        parts.append(_long(shares, "quality", group, ["dims_95", "dims_99", "dims_999", "pca_share_95", "pca_reduction"]))

    if label in df.columns:
        labelled = valid_labels(rows, label)
        enough = labelled.limit(LEAST_LABELS).count()
        if enough < LEAST_LABELS:
            parts.append(_long(labelled.agg(F.count(F.lit(1)).alias("too_few_labelled_rows")), "task", None, ["too_few_labelled_rows"]))
        else:
            for group, vector in vectors.items():
                r = embedding.label_correlation_summary(embedding.label_correlation(labelled, vector, label))
                parts.append(_long(r.withColumnsRenamed(
                    {"max_correlation": "max_label_correlation", "mean_correlation": "mean_label_correlation",
                     "significant_dims": "significant_label_dims"}), "task", group,
                    ["max_label_correlation", "mean_label_correlation", "significant_label_dims"]))
            scores = click_prediction(labelled, key, image, text, label, trees, depth)
            parts.append(_long(scores.withColumnRenamed("logistic_auc", "auc"), "task", None,
                               ["auc", "rf_mse", "rf_r2", "spearman", "median_ctr"]))
            weights = importance(labelled, key, image, text, label, trees, depth)
            parts.append(_long(weights, "task", None, ["mean_importance", "max_importance"], "feature_group"))
            sets = ablation(labelled, key, image, text, label, trees, depth)
            parts.append(_long(sets.withColumnsRenamed({"r2": "set_r2", "mse": "set_mse", "spearman": "set_spearman"}),
                               "task", None, ["set_r2", "set_mse", "set_spearman", "cv_r2_mean", "cv_r2_std"], "feature_set"))
            parts.append(_long(contributions(sets), "task", None, ["r2_contribution", "relative_pct"], "feature_group"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    # The table is a few hundred numbers; taking them now frees the rows and keeps later readings cheap.
    values = [tuple(r) for r in report.collect()]
    rows.unpersist()
    return literal_rows(df.sparkSession, values, SCHEMA)


def _fired(report: DataFrame, rules: Sequence[tuple], name: str) -> DataFrame:
    table = literal_rows(
        report.sparkSession, rules, f"{name} string, metric string, direction string, bound double, severity string")
    hit = F.when(F.col("direction") == "<", F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    message = F.concat_ws(
        " ", F.col("metric"), F.coalesce(F.col("feature_group"), F.lit("all")), F.lit("is"),
        F.format_number("value", 4), F.lit("which is"), F.when(F.col("direction") == "<", "below").otherwise("above"),
        F.format_number("bound", 2))
    return report.join(F.broadcast(table), "metric").where(hit).select(
        name, "metric", "feature_group", "value", "severity", message.alias("message"))


def diagnose(report: DataFrame) -> DataFrame:
    """R2: the rules that fire on a report."""
    return _fired(report, DIAGNOSIS, "rule")


def recommend(report: DataFrame) -> DataFrame:
    """R3."""
    return _fired(report, RECOMMENDATIONS, "recommendation")


def save_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def diagnose_saved(spark: SparkSession, path: str) -> DataFrame:
    """Without evaluating again."""
    return diagnose(spark.read.schema(SCHEMA).json(path))


def grade_metrics(report: DataFrame) -> DataFrame:
    """good, warning or bad for the metrics that have thresholds."""
    rows = [(m, d, g, w) for m, (d, g, w) in METRIC_GRADES.items()]
    table = literal_rows(report.sparkSession, rows, "metric string, direction int, good double, warn double")
    v, up = F.col("value"), F.col("direction") > 0
    grade = (
        F.when(up & (v > F.col("good")), "good").when(up & (v > F.col("warn")), "warning")
        .when(~up & (v > F.col("warn")), "bad").when(~up & (v > F.col("good")), "warning")
        .when(up, "bad").otherwise("good"))
    return report.join(F.broadcast(table), "metric").select("metric", "feature_group", "value", grade.alias("grade"))
