"""Clusters of vectors and their quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.vectors import any_nonzero, squared_distance
from postlens.operators import sweep
from postlens.operators.encoding import fit_vector_scaler, scale_vector
from postlens.operators.joins import small_map
from postlens.operators.sampling import hash_sample
from postlens.session import cut_lineage
from postlens.settings import CLUSTER_COUNTS


def purity(df: DataFrame, categories: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Category, purity; NULL is no category but stays in the cluster's size. Absent columns are skipped."""
    present = [c for c in categories if c in df.columns]
    cells = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in present])
    counts = df.select(cluster, F.inline(cells)).groupBy("category", cluster, "value").agg(F.count(F.lit(1)).alias("n"))
    per_cluster = counts.groupBy("category", cluster).agg(
        (F.coalesce(F.max(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("p"),
        F.count("value").alias("seen"))
    return per_cluster.groupBy("category").agg(F.avg("p").alias("purity"), F.sum("seen").alias("_seen")).where(
        F.col("_seen") > 0).drop("_seen")


def centroids(df: DataFrame, vector: str, cluster: str = "cluster") -> DataFrame:
    """cluster, center (mean vector), size; vectors fold per task."""
    v = array_to_vector(vector)
    return df.groupBy(cluster).agg(
        vector_to_array(Summarizer.mean(v)).alias("center"), F.count(F.lit(1)).alias("size"))


def davies_bouldin(df: DataFrame, vector: str, cluster: str = "cluster") -> DataFrame:
    """A28. The table of centroids (one row per cluster of a model) travels to the rows, the rows do not move."""
    table = small_map(centroids(df, vector, cluster), cluster, "center")
    near = df.withColumn("_c", table.scalar())
    distance = F.sqrt(squared_distance(F.col(vector), F.try_element_at(F.col("_c"), F.col(cluster))["center"]))
    spread = near.groupBy(cluster).agg(F.avg(distance).alias("spread"))
    joined = spread.join(centroids(df, vector, cluster), cluster)
    everyone = joined.agg(F.collect_list(F.struct(F.col(cluster).alias("k"), "spread", "center")).alias("all"))
    one = everyone.select(F.explode("all").alias("c"), "all")

    def likeness(o):
        gap = F.sqrt(squared_distance(F.col("c.center"), o["center"]))
        return F.when((o["k"] != F.col("c.k")) & (gap > 0), (F.col("c.spread") + o["spread"]) / F.when(gap > 0, gap))

    worst = F.array_max(F.transform("all", likeness))
    return one.agg(F.avg(F.coalesce(worst, F.lit(0.0))).alias("davies_bouldin"))


def silhouette_squared(df: DataFrame, vector: str, cluster: str = "cluster") -> float:
    """A27, scalable form: squared Euclidean distances, one pass with cluster sums. Not the Euclidean score."""
    rows = df.select(array_to_vector(vector).alias("features"), F.col(cluster).cast("double").alias("prediction"))
    return ClusteringEvaluator(
        featuresCol="features", predictionCol="prediction", metricName="silhouette", distanceMeasure="squaredEuclidean"
    ).evaluate(rows)


def silhouette_euclidean(df: DataFrame, key: str, vector: str, cluster: str = "cluster", most: int = 1000) -> DataFrame:
    """A27, exact Euclidean score of a keyed-hash sample of at most `most` rows.

    The score of a sample is what it is for; `most` bounds the rows every sampled row is measured against.
    """
    rows = hash_sample(df.select(key, cluster, vector), key, most)
    member = F.struct(F.col(key).alias("id"), F.col(vector).alias("v"))
    groups = rows.groupBy(cluster).agg(F.collect_list(member).alias("members")).agg(
        F.collect_list(F.struct(F.col(cluster).alias("k"), "members")))

    def reach(group):
        far = F.aggregate(
            group["members"], F.lit(0.0), lambda a, o: a + F.sqrt(squared_distance(F.col(vector), o["v"])))
        return F.struct(group["k"].alias("k"), far.alias("d"), F.size(group["members"]).alias("n"))

    measured = rows.repartition(F.col(key)).withColumn("_g", groups.scalar()).select(
        F.col(cluster).alias("k"), F.transform("_g", reach).alias("g"))
    own = F.filter("g", lambda c: c["k"] == F.col("k"))[0]
    a = F.when(own["n"] > 1, own["d"] / F.when(own["n"] > 1, own["n"] - 1))
    b = F.array_min(F.transform(F.filter("g", lambda c: c["k"] != F.col("k")), lambda c: c["d"] / c["n"]))
    sides = measured.select(a.alias("a"), b.alias("b"))
    top = F.greatest("a", "b")
    score = F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return sides.agg(F.avg(score).alias("silhouette"))


def standardised(df: DataFrame, vector: str, name: str = "scaled") -> DataFrame:
    """Non-zero vectors, scaled with population deviations."""
    rows = df.where(any_nonzero(F.col(vector)))
    return scale_vector(rows, fit_vector_scaler(rows, vector), vector, name)


def cluster_sweep(
    df: DataFrame, key: str, vector: str, counts: Sequence[int] = CLUSTER_COUNTS, seed: int = 42, starts: int = sweep.STARTS,
    most: int = 2000,
) -> tuple[DataFrame, DataFrame | None]:
    """M1: (k, silhouette, silhouette_sq, davies_bouldin, cost) for every k below the number of rows, and the rows with the
    clusters of the best k; an older `cluster` column is replaced.

    All k and starts are trained together. The best k has the highest `silhouette`, the Euclidean one of a keyed-hash sample
    of at most `most` rows; the other two scores are of all rows. A k whose rows all lie in one cluster has no line. The scaled
    rows are written once to the checkpoint folder."""
    spark = df.sparkSession
    some = not df.where(any_nonzero(F.col(vector))).isEmpty()
    scaled = cut_lineage(standardised(df.drop("cluster"), vector)) if some else None
    models = [] if scaled is None else sweep.train_sweep(scaled, key, vector="scaled", counts=counts, starts=starts, seed=seed)
    found = []
    if models:
        sample = np.array([r["scaled"] for r in hash_sample(scaled.select(key, "scaled"), key, most).collect()])
        labelled = cut_lineage(sweep.assign(scaled.select("scaled"), "scaled", models))
        for i, (model, silhouette) in enumerate(zip(models, sweep.sample_silhouettes(sample, models), strict=True)):
            rows = labelled.select("scaled", F.col("clusters")[i].alias("cluster"))
            if silhouette is None or rows.select("cluster").distinct().limit(2).count() < 2:
                continue
            found.append((model.k, silhouette, float(silhouette_squared(rows, "scaled")), float(davies_bouldin(rows, "scaled").head()[0]), model.cost, model))
    table = spark.createDataFrame([f[:5] for f in found], "k int, silhouette double, silhouette_sq double, davies_bouldin double, cost double")
    if not found:
        return table, None
    best = max(found, key=lambda f: f[1])[5]
    return table, sweep.assign(scaled, "scaled", [best]).withColumn("cluster", F.col("clusters")[0]).drop("clusters", "scaled")
