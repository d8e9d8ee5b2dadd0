"""Image bytes beside posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str, pattern: str = "*", key: Column | None = None) -> DataFrame:
    """url, image for every file below `path`; `key` turns the file path into the URL it stands for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1) if key is None else key
    return files.select(name.alias("url"), F.col("content").alias("image"))


def attach_cover(posts: DataFrame, images: DataFrame, url: str = "cover_url", name: str = "cover_image") -> DataFrame:
    """Left join; a URL without an image leaves NULL. Posts without a URL have nothing to join and stay where they are,
    so that they do not meet in one task."""
    named, bare = posts.where(F.col(url).isNotNull()), posts.where(F.col(url).isNull())
    joined = named.join(images.select(F.col("url").alias(url), F.col("image").alias(name)), url, "left")
    return joined.unionByName(bare.withColumn(name, F.lit(None).cast("binary")))


def attach_inner(
    posts: DataFrame, images: DataFrame, key: str = "note_id", urls: str = "inner_urls", name: str = "inner_images"
) -> DataFrame:
    """An array of images in URL order, NULL where one is missing. The URL list is already cut to its few entries."""
    each = posts.select(key, F.posexplode(urls).alias("pos", "url")).join(images, "url", "left")
    lists = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "image"))).alias("_l"))
    return posts.join(lists, key, "left").withColumn(
        name, F.coalesce(F.transform("_l", lambda s: s["image"]), F.array().cast("array<binary>"))).drop("_l")
