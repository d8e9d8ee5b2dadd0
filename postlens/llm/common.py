"""Helpers the operators share: shared folders, slices of Arrow batches, words, spread prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.session import checkpoint_dir, cut_lineage

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: what follows neither recomputes it nor needs its executors."""
    return cut_lineage(df)


# What a worker keeps for its next task of the same operator, each with a way to let go of it.
HELD: list[Callable[[], None]] = []


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, keep_held: bool = False) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cuts batches so that texts of one piece add up to about `limit` bytes; a longer text stands alone. Null texts are empty.

    A worker that turns to this work lets go of what it holds for other operators, unless `keep_held`, and gives memory
    back when it is done."""
    if not keep_held:
        for let_go in HELD:
            let_go()
    try:
        yield from _slices(batches, column, limit)
    finally:
        pa.default_memory_pool().release_unused()


def _slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop


def text_bytes(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: per word its text's place, its code, and the distinct words by code."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = pc.list_flatten(lists).dictionary_encode()
    distinct = coded.dictionary
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py() if len(distinct) else -1
    if empty >= 0:
        kept = codes != empty
        owner, codes = owner[kept], codes[kept]
    return owner, codes, distinct


# What a term is made of: ASCII letters (lower-cased) and digits, and every character beyond ASCII; all else parts terms.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As words, for maximal runs of term characters; `texts` are large strings without nulls."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = bytes(memoryview(data)[ends[0] : ends[-1]]).translate(_TERM_BYTES) if data is not None else b""
    return words(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(held)))


def hash_words(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words, the same in every process."""
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in distinct.to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """Distinct values in order, by one sort."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets before each group."""
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every run, one run after another."""
    total = int(lengths.sum())
    return np.repeat(starts - starts_of(lengths), lengths) + np.arange(total)


def running_before(df: DataFrame, order: str, value: Column, out: str, block: int = 1024) -> DataFrame:
    """Adds the sum of `value` over all rows of smaller `order` (whole numbers from 0, one row each).

    Sums of blocks of rows are put in order first, so that no task gets more than a block's rows, or one row per
    block."""
    rows = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_value", value)
    blocks = rows.groupBy("_block").agg(F.sum("_value").alias("_sum"))
    if_before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(if_before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return rows.join(blocks, "_block").withColumn(out, (F.col("_before") + F.col("_within")).cast("long")).drop("_block", "_value", "_within", "_before")
