"""Centred PCA."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CentredPca:
    """Spark's PCA does not subtract the mean when it transforms and leaves signs free; both are settled here."""

    model: PCAModel
    center: DataFrame
    signs: list[float]

    def transform(self, df: DataFrame, vector: str, name: str) -> DataFrame:
        fit = self.center.select("center")
        moved = df.withColumn("_center", fit.scalar()).withColumn(
            "_in", array_to_vector(F.zip_with(vector, "_center", lambda x, m: x.cast("double") - m)))
        projected = self.model.setInputCol("_in").setOutputCol("_out").transform(moved)
        signs = F.array(*[F.lit(s) for s in self.signs])
        return projected.withColumn(
            name, F.zip_with(vector_to_array("_out"), signs, lambda x, s: x * s)).drop("_center", "_in", "_out")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.center.select("center", F.lit(self.signs).alias("signs")).write.mode("overwrite").parquet(f"{path}/center")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CentredPca:
        center = spark.read.parquet(f"{path}/center")
        return CentredPca(PCAModel.load(f"{path}/model"), center.select("center"), list(center.head()["signs"]))


def fit_pca(df: DataFrame, vector: str, components: int) -> CentredPca:
    """k = min(components, dimensions); each component's largest loading is made positive."""
    rows = df.where(F.col(vector).isNotNull()).select(array_to_vector(vector).alias("v"))
    center = rows.agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("center"))
    dims = rows.head()["v"].size
    model = PCA(k=min(components, dims), inputCol="v", outputCol="p").fit(rows)
    loadings = model.pc.toArray()
    signs = [1.0 if c[abs(c).argmax()] >= 0 else -1.0 for c in loadings.T]
    return CentredPca(model, center, signs)
