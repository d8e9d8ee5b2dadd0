"""Samples and splits from a keyed hash of the row's id (O3-O6): repeatable on any cluster, independent of row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 10_000


def keyed_hash(key: Column | str, salt: str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(salt), key.cast("string")))


def bucket(key: Column | str, salt: str, buckets: int = BUCKETS) -> Column:
    return (F.conv(F.substring(keyed_hash(key, salt), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def hash_sample(df: DataFrame, key: str, most: int, salt: str = "42", direct: int = 2000) -> DataFrame:
    """O3: the `most` rows with the smallest hash of a unique key.

    Up to `direct` rows every task offers its own candidates. A larger sample is cut at a hash prefix found
    by counting: rows below it stay where they are, and only the rows of that one prefix are ranked.
    """
    hashed = df.withColumn("_h", keyed_hash(key, salt))
    if most <= direct:
        return hashed.orderBy("_h", key).limit(most).drop("_h")
    prefix = F.substring("_h", 1, 4)
    seen = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    # 65536 prefixes at most, so one task can add them up.
    counts = hashed.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).withColumn("seen", F.coalesce(seen, F.lit(0)))
    edge = counts.where(F.col("seen") < most).agg(
        F.struct(F.max("p").alias("p"), (F.lit(most) - F.max("seen")).alias("left")))
    placed = hashed.withColumn("_edge", edge.scalar())
    below = placed.where(prefix < F.col("_edge.p"))
    rank = F.row_number().over(Window.partitionBy(prefix).orderBy("_h", key))
    at = placed.where(prefix == F.col("_edge.p")).withColumn("_r", rank).where(F.col("_r") <= F.col("_edge.left"))
    return below.unionByName(at.drop("_r")).drop("_h", "_edge")


def split(df: DataFrame, key: str, test: float = 0.2, validation: float = 0.0, salt: str = "42") -> DataFrame:
    """Adds `split`; shares are of the whole, test first, then val, the rest train."""
    b = bucket(key, salt)
    name = F.when(b < int(round(test * BUCKETS)), "test")
    if validation > 0:
        name = name.when(b < int(round((test + validation) * BUCKETS)), "val")
    return df.withColumn("split", name.otherwise("train"))


def train_val(df: DataFrame, key: str, share: float = 0.2, salt: str = "42") -> DataFrame:
    """Adds `split` with train and val."""
    b = bucket(key, salt)
    return df.withColumn("split", F.when(b < int(round(share * BUCKETS)), "val").otherwise("train"))


def folds(df: DataFrame, key: str, k: int = 5, name: str = "fold", salt: str = "fold") -> DataFrame:
    """Fold number per row, for CrossValidator(foldCol=...)."""
    return df.withColumn(name, bucket(key, salt, k))


def sample_files(files: DataFrame, most: int, salt: str = "42") -> DataFrame:
    """The `most` files of a listing (path) with the smallest keyed hash of their names; every task offers its own."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("_h", keyed_hash(name, salt)).orderBy("_h", "path").limit(most).drop("_h")
