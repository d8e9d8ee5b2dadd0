"""Audits over files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.vectors import l2_norm
from postlens.operators.ordering import running_weight


def file_sizes(df: DataFrame) -> DataFrame:
    """file, size_bytes of every file with rows."""
    meta = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size_bytes"))
    return meta.groupBy("file").agg(F.max("size_bytes").alias("size_bytes"))


def verify_output(df: DataFrame) -> DataFrame:
    """S9 on a freshly read output: rows, columns, files, megabytes, from one pass that reads no data column."""
    files = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("size"))
    return files.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
        F.count(F.lit(1)).alias("files"), (F.coalesce(F.sum("size"), F.lit(0)) / 1048576.0).alias("mb"))


def relative_path(base: str | None = None) -> Column:
    """The path of a row's file: below `base` if given. Its name alone does not tell files of two folders apart."""
    path = F.col("_metadata.file_path")
    if not base:
        return path
    folder = base.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    return F.when(F.contains(path, F.lit("/" + folder)), F.element_at(F.split(path, re.escape("/" + folder), 2), 2)).otherwise(path)


def scan_directory(df: DataFrame, groups: Mapping[str, str], base: str | None = None) -> DataFrame:
    """Per file its size, rows, columns and which vector groups hold values; the line without a file is the total.

    `groups` maps a group name to a column of that group.
    """
    present = {g: c for g, c in groups.items() if c in df.columns}
    per_file = df.groupBy(relative_path(base).alias("file")).agg(
        F.max("_metadata.file_size").alias("size"), F.count(F.lit(1)).alias("rows"),
        *[(F.count(c) > 0).alias(f"has_{g}") for g, c in present.items()])
    return per_file.rollup("file").agg(
        F.sum("size").alias("size_bytes"), F.sum("rows").alias("rows"), F.lit(len(df.columns)).alias("columns"),
        F.count(F.lit(1)).alias("files"), *[F.bool_or(f"has_{g}").alias(f"has_{g}") for g in present])


def file_rows(df: DataFrame, base: str | None = None) -> DataFrame:
    return df.groupBy(relative_path(base).alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def batch_plan(files: DataFrame, size: int) -> DataFrame:
    """File, rows, batches, first and last batch id, files in name order; a file without rows has none."""
    sized = files.withColumn("batches", F.ceil(F.col("rows") / size).cast("bigint"))
    placed = running_weight(sized, [], ["file"], F.col("batches"))
    return placed.select(
        "file", "rows", "batches", F.col("before").alias("first_batch"),
        (F.col("before") + F.greatest(F.col("batches"), F.lit(1)) - 1).alias("last_batch"))


def preview(df: DataFrame, key: str, rows: int = 10, width: int = 100, vectors: Sequence[str] = ()) -> DataFrame:
    """O2: the first rows by key, long strings cut with '...', vectors as norm and non-zero count."""
    cells = []
    for name, kind in df.dtypes:
        if name in vectors:
            cells += [
                l2_norm(F.col(name)).alias(f"{name}_norm"),
                F.size(F.filter(name, lambda x: x != 0)).alias(f"{name}_nonzero"),
            ]
        elif kind == "string":
            text = F.col(name)
            cells.append(F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text).alias(name))
        else:
            cells.append(F.col(name))
    return df.orderBy(key).limit(rows).select(*cells)
