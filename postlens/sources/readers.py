"""Reading parquet: numbered batches, trees, samples, latest run, object stores."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlens.functions.numeric import nan_to_null
from postlens.operators.sampling import sample_files


def read_batches(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Files part-{i:05d}*.parquet for start <= i <= end. No match is an error; nothing else is ever read."""
    numbers = ",".join(f"{i:05d}" for i in range(start, end + 1))
    return spark.read.parquet(f"{path}/part-{{{numbers}}}*.parquet")


def read_tree(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
    skip_corrupt: bool = False, merge: bool = False, schema: StructType | None = None,
) -> DataFrame:
    """A file, several, or all files below a directory; floats come with NaN as NULL.

    Without a schema, skip_corrupt looks at all footers, since the one file asked otherwise may be the bad one.
    """
    merge = merge or (skip_corrupt and schema is None)
    reader = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", str(merge).lower())
    if schema is not None:
        reader = reader.schema(schema)
    if skip_corrupt:
        reader = reader.option("ignoreCorruptFiles", "true")
    paths = [path] if isinstance(path, str) else list(path)
    df = reader.parquet(*paths)
    return nan_to_null(df.select(*[c for c in columns if c in df.columns]) if columns else df)


def list_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path, size_bytes of all files below, as a table; no file is opened."""
    paths = [path] if isinstance(path, str) else list(path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return found.select("path", F.col("length").alias("size_bytes"))


def read_sampled(spark: SparkSession, path: str | Sequence[str], files: int, **options) -> DataFrame:
    """Only `files` of the files below, chosen by a keyed hash of their names. The chosen names alone reach the driver."""
    return read_tree(spark, [r["path"] for r in sample_files(list_files(spark, path), files).collect()], **options)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """By name, absent columns NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def latest_run(spark: SparkSession, path: str, column: str = "dt") -> DataFrame:
    """T4: the newest `dt=` directory, found in the listing; only its files are read."""
    base = path.rstrip("/")
    below = [f.partition(base.split("://")[-1])[2] for f in spark.read.parquet(base).inputFiles()]
    stamps = [m.group(1) for f in below if (m := re.match(rf"/{column}=([^/]+)/", f))]
    if not stamps:
        raise ValueError(f"no {column}= directories below {base}")
    return spark.read.option("basePath", base).parquet(f"{base}/{column}={max(stamps)}")


def store_uri(path: str, bucket: str, scheme: str = "oss") -> str:
    """bucket/key, /key, key or a full URI to one URI."""
    if "://" in path:
        return path
    key = path.lstrip("/")
    if key == bucket or key.startswith(bucket + "/"):
        key = key[len(bucket):].lstrip("/")
    return f"{scheme}://{bucket}/{key}"


def split_uri(uri: str, bucket: str = "") -> tuple[str, str]:
    """(bucket, key); without a scheme the whole path is the key of the given bucket."""
    if "://" not in uri:
        return bucket, uri
    name, _, key = uri.split("://", 1)[1].partition("/")
    return name, key


def read_store(spark: SparkSession, path: str, bucket: str, scheme: str = "oss") -> DataFrame:
    """Lazy; credentials come from the session's Hadoop settings."""
    return spark.read.parquet(store_uri(path, bucket, scheme))


def write_store(
    df: DataFrame, path: str, bucket: str, partitions: int | None = None, mode: str = "overwrite", scheme: str = "oss"
) -> None:
    out = df.repartition(partitions) if partitions else df
    out.write.mode(mode).option("compression", "snappy").parquet(store_uri(path, bucket, scheme))
