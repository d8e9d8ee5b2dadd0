"""Writing results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from postlens.sources.audit import relative_path

STAMP = "%Y%m%d_%H%M%S"


def batch_path(out: str, start: int, end: int, stamp: datetime) -> str:
    return f"{out}/batch_{start:05d}_{end:05d}/dt={stamp.strftime(STAMP)}"


def save_batch(
    df: DataFrame, out: str, start: int, end: int, stamp: datetime, files: int | None = None, compression: str = "snappy",
    rows_per_file: int = 1_000_000,
) -> str:
    """Files of one batch and run; the path is the partition. Rows stay in the tasks that made them, unless the
    caller asks for a number of files; no file gets more than `rows_per_file` rows."""
    path = batch_path(out, start, end, stamp)
    rows = df if files is None else df.repartition(max(1, files))
    rows.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", rows_per_file).parquet(path)
    return path


def save_per_source(df: DataFrame, out: str, source: str = "source_file") -> None:
    """Output kept apart by the input file a row came from. One job; large sources spread over several files."""
    df.write.mode("overwrite").partitionBy(source).parquet(out)


def with_source(df: DataFrame, base: str | None = None) -> DataFrame:
    """The input file of every row, for `save_per_source`: its path below `base`, so that files of one name in two folders
    stay apart; the whole path without a base."""
    return df.withColumn("source_file", F.concat(F.lit("incremental_"), relative_path(base)))


def save_csv(df: DataFrame, out: str, order: str | None = None) -> None:
    """With header; NULL is an empty field."""
    rows = df.orderBy(order) if order else df
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(out)


def save_json(df: DataFrame, out: str) -> None:
    """Result tables as JSON lines."""
    df.write.mode("overwrite").json(out)


def observed(df: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """Row count and first/last moment, collected by the job that writes the rows, without a job of its own."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch


def run_statistics(watch: Observation, seconds: float, files_in: DataFrame, files_out: DataFrame) -> dict:
    """Rows, rows per second, files and megabytes on both sides, from file metadata."""
    rows = watch.get["rows"]
    sizes = {}
    for side, df in (("in", files_in), ("out", files_out)):
        line = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b")).head()
        sizes |= {f"files_{side}": line["n"], f"mb_{side}": line["b"] / 1024 / 1024}
    return {"rows": rows, "seconds": seconds, "rows_per_second": rows / seconds if seconds > 0 else 0.0, **sizes}
