"""Quality of vector columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.special import t_two_sided
from postlens.functions.vectors import any_nonzero, cosine, l2_norm
from postlens.operators.history import running_share
from postlens.operators.ordering import number_rows
from postlens.operators.sampling import keyed_hash


def dimension_variance(df: DataFrame, vector: str) -> DataFrame:
    """Dim, variance (population), level and whether the dimension is effective (std > 1e-6).

    One pass with partial sums per task; nothing is exploded before the summary.
    """
    s = df.where(F.col(vector).isNotNull()).agg(
        Summarizer.metrics("variance", "count").summary(array_to_vector(vector)).alias("s"))
    n = F.col("s.count").cast("double")
    population = F.transform(vector_to_array("s.variance"), lambda v: v * (n - 1) / n)
    dims = s.select(F.posexplode(population).alias("dim", "variance"))
    v = F.col("variance")
    level = F.when(v < 1e-6, "zero").when(v < 0.01, "low").when(v < 0.1, "medium").otherwise("high")
    return dims.select("dim", "variance", level.alias("level"), (F.sqrt(v) > 1e-6).alias("effective"))


def variance_summary(dims: DataFrame) -> DataFrame:
    """Dimensions per level, mean and median variance, effective dimensions and the warning below ten."""
    v = F.col("variance")
    levels = [F.count_if(F.col("level") == x).alias(f"{x}_dims") for x in ("zero", "low", "medium", "high")]
    return dims.agg(
        *levels, F.count(F.lit(1)).alias("dims"), F.avg(v).alias("mean_variance"),
        # At most one row per dimension meets here, so the plain median is bounded.
        F.median(v).alias("median_variance"), F.count_if("effective").alias("effective_dims"),
    ).withColumn("few_effective", F.col("effective_dims") < 10)


def dimension_pairs(df: DataFrame, vector: str) -> DataFrame:
    """Pearson r of every pair of dimensions (i < j) over all rows.

    The rows meet only as a distributed d x d Gram matrix; the driver holds that matrix. Pairs with a
    constant dimension, and exact zeros, are left out.
    """
    rows = df.where(F.col(vector).isNotNull()).select(array_to_vector(vector).alias("v"))
    matrix = Correlation.corr(rows, "v").head()[0].toArray()
    pairs = [
        (i, j, float(matrix[i, j]))
        for i in range(matrix.shape[0]) for j in range(i + 1, matrix.shape[1])
        if matrix[i, j] == matrix[i, j] and matrix[i, j] != 0
    ]
    return df.sparkSession.createDataFrame(pairs, "i int, j int, r double")


def pair_summary(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Mean and max |r|, pairs above the threshold, and the first ten of those in row order."""
    size = F.abs(F.col("r"))
    high = F.when(size > threshold, F.struct("i", "j", "r"))
    return pairs.agg(
        F.avg(size).alias("mean_correlation"), F.max(size).alias("max_correlation"),
        F.count(high).alias("high_pairs"), F.count(F.lit(1)).alias("pairs"),
        F.slice(F.array_sort(F.collect_list(high)), 1, 10).alias("first_high"),
    )


def label_correlation(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Dim and Pearson r with the label; dimensions fold per task before they are shuffled."""
    cells = df.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("dim", "x"))
    return cells.groupBy("dim").agg(F.corr(F.col("x").cast("double"), F.col(label).cast("double")).alias("r"))


def label_correlation_summary(dims: DataFrame, most: int = 10) -> DataFrame:
    """Max and mean |r|, dimensions above 0.1, and the `most` strongest."""
    size = F.abs(F.col("r"))
    strongest = F.array_sort(F.collect_list(F.struct((-size).alias("k"), F.col("dim"), F.col("r"))))
    return dims.agg(
        F.max(size).alias("max_correlation"), F.avg(size).alias("mean_correlation"),
        F.count_if(size > 0.1).alias("significant_dims"),
        F.transform(F.slice(strongest, 1, most), lambda s: s["dim"]).alias("top_dims"),
    )


def explained_variance(df: DataFrame, vector: str) -> DataFrame:
    """Component, ratio, cumulative; all-zero vectors are left out; fewer than two rows have no variance and give nothing."""
    rows = df.where(any_nonzero(F.col(vector))).select(array_to_vector(vector).alias("v"))
    spark = df.sparkSession
    first = rows.limit(2).collect()
    ratios = []
    if len(first) == 2:
        ratios = [float(r) for r in PCA(k=first[0]["v"].size, inputCol="v", outputCol="p").fit(rows).explainedVariance]
    table = spark.createDataFrame(list(enumerate(ratios)), "component int, ratio double")
    return running_share(table)


def pca_dims(spectrum: DataFrame, levels: Sequence[float] = (0.95, 0.99, 0.999)) -> DataFrame:
    """Dimensions that reach each level of explained variance."""
    def first(level: float) -> Column:
        # Numpy's argmax over a condition that never holds is 0, hence 1 component.
        return F.coalesce(F.min(F.when(F.col("cumulative") >= level, F.col("component") + 1)), F.lit(1))

    return spectrum.agg(
        F.count(F.lit(1)).alias("dims"), *[first(x).alias("dims_" + f"{x:g}"[2:]) for x in levels])


def pair_similarities(df: DataFrame, key: str, image: str, text: str, draws: int | None = None) -> DataFrame:
    """Kind (same, random), similarity. Zero vectors are skipped.

    All rows are numbered by two keyed hashes, and rows with the same number are a random pair: as many as there are
    rows, or `draws` if given. Pairs of a row with itself are skipped.
    """
    same = df.select(F.lit("same").alias("kind"), cosine(F.col(image), F.col(text)).alias("similarity"))

    def draw(salt: str, vector: str) -> DataFrame:
        rows = df.select(keyed_hash(key, salt).alias("h"), F.col(key).alias("id"), F.col(vector).alias("v"))
        placed = number_rows(rows, [], ["h", "id"], "place")
        return placed if draws is None else placed.where(F.col("place") <= draws)

    left = draw("i", image).select("place", F.col("id").alias("id_i"), F.col("v").alias("v_i"))
    right = draw("j", text).select("place", F.col("id").alias("id_j"), F.col("v").alias("v_j"))
    matched = left.join(right, "place").where(F.col("id_i") != F.col("id_j"))
    random = matched.select(F.lit("random").alias("kind"), cosine(F.col("v_i"), F.col("v_j")).alias("similarity"))
    return same.unionByName(random).where(F.col("similarity").isNotNull())


def alignment(similarities: DataFrame) -> DataFrame:
    """Mean, population std and count per kind."""
    return similarities.groupBy("kind").agg(
        F.avg("similarity").alias("mean"), F.stddev_pop("similarity").alias("std"), F.count(F.lit(1)).alias("n"))


def _sides(similarities: DataFrame) -> DataFrame:
    cells = []
    for kind, p in (("same", "p"), ("random", "q")):
        x = F.when(F.col("kind") == kind, F.col("similarity"))
        cells += [F.avg(x).alias(f"{p}_mean"), F.var_pop(x).alias(f"{p}_var"), F.count(x).cast("double").alias(f"{p}_n")]
    return similarities.agg(*cells)


def cohens_d(similarities: DataFrame) -> DataFrame:
    """A24."""
    pooled = F.sqrt((F.col("p_var") + F.col("q_var")) / 2)
    d = F.when(pooled > 0, (F.col("p_mean") - F.col("q_mean")) / F.when(pooled > 0, pooled)).otherwise(0.0)
    return _sides(similarities).select(F.coalesce(d, F.lit(0.0)).alias("cohens_d"))


def t_test(similarities: DataFrame, with_p: bool = True) -> DataFrame:
    """Two samples, equal variances."""
    p_n, q_n = F.col("p_n"), F.col("q_n")
    dof = p_n + q_n - 2
    pooled = (F.col("p_var") * p_n + F.col("q_var") * q_n) / F.when(dof > 0, dof)
    t = (F.col("p_mean") - F.col("q_mean")) / F.sqrt(pooled * (1 / F.when(p_n > 0, p_n) + 1 / F.when(q_n > 0, q_n)))
    out = _sides(similarities).select(t.alias("t_statistic"), dof.alias("dof"))
    return out.withColumn("p_value", t_two_sided(F.col("t_statistic"), F.col("dof"))) if with_p else out


def vector_audit(df: DataFrame, vectors: Sequence[str], first: int = 5) -> DataFrame:
    """Per vector column: dims, zero rows and share, norm mean and std, and the first dimensions' means and stds."""
    cells, lines = [], []
    for i, v in enumerate(vectors):
        norm, zero = l2_norm(F.col(v)), F.count_if(~any_nonzero(F.col(v)))
        heads = range(1, first + 1)
        cells += [
            F.max(F.size(v)).alias(f"{i}_dims"), zero.alias(f"{i}_zero"), F.count(F.lit(1)).alias(f"{i}_rows"),
            F.avg(norm).alias(f"{i}_mean"), F.stddev_pop(norm).alias(f"{i}_std"),
            F.array(*[F.avg(F.try_element_at(v, F.lit(k))) for k in heads]).alias(f"{i}_means"),
            F.array(*[F.stddev_pop(F.try_element_at(v, F.lit(k))) for k in heads]).alias(f"{i}_stds"),
        ]
        rows = F.greatest(F.col(f"{i}_rows"), F.lit(1))
        lines.append(F.struct(
            F.lit(v).alias("vector"), F.col(f"{i}_dims").alias("dims"), F.col(f"{i}_zero").alias("zero_rows"),
            F.col(f"{i}_rows").alias("rows"), (F.col(f"{i}_zero") * 100.0 / rows).alias("zero_pct"),
            F.col(f"{i}_mean").alias("norm_mean"), F.col(f"{i}_std").alias("norm_std"),
            F.col(f"{i}_means").alias("first_means"), F.col(f"{i}_stds").alias("first_stds"),
        ))
    return df.agg(*cells).select(F.inline(F.array(*lines)))


def norm_histogram(df: DataFrame, vector: str, bins: int = 50) -> DataFrame:
    """Bin (from 1), n; equal widths between the smallest and the largest norm, the last bin closed."""
    norms = df.where(F.col(vector).isNotNull()).select(l2_norm(F.col(vector)).alias("norm"))
    ends = norms.agg(F.struct(F.min("norm").alias("low"), F.max("norm").alias("high")))
    low, high = F.col("_ends.low"), F.col("_ends.high")
    spot = F.floor((F.col("norm") - low) / F.when(high > low, high - low) * bins) + 1
    placed = norms.withColumn("_ends", ends.scalar()).select(
        F.least(F.coalesce(spot, F.lit(1)), F.lit(bins)).cast("int").alias("bin"))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def pool_rows(df: DataFrame, key: str, vector: str, dim: int, how: str = "mean") -> DataFrame:
    """V7 over rows: pooled vector per key, zeros where a key has none; an unknown method means mean.

    Partial sums fold per task, so a key with very many vectors is one row per task in the shuffle.
    """
    metric = Summarizer.max if how == "max" else Summarizer.mean
    pooled = df.where(F.col(vector).isNotNull()).groupBy(key).agg(
        vector_to_array(metric(array_to_vector(vector))).alias("pooled"))
    return df.select(key).distinct().join(pooled, key, "left").withColumn(
        "pooled", F.coalesce("pooled", F.array_repeat(F.lit(0.0), dim)))
