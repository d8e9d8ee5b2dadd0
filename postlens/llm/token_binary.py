"""Token ids in files of Simple-8b words.

A file is a row of blocks, each:

    "S8B1" | u32 header bytes | u64 shard, u64 place in shard, u64 documents, u64 ids, u64 words, u64 groups
           | i64 doc_id per document | u8 1 if its doc_id is null | u64 ids per document
           | u32 first word of each group of 128 ids | u64 words | "\\n"

A word has a selector in its upper four bits: how many ids lie in the other 60 bits, and how wide each is. Selector 15
escapes: its lower bits tell how many whole 64-bit values follow, for ids of over 60 bits. Groups start on a word, so any of them
decodes alone, and all words of a block decode at once, selector by selector."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.llm.common import materialise, running_before, shared_path, starts_of, text_slices
from postlens.llm.pieces import json_tokenizer, tokenizer_path

END_ID = 2
# Ids in a word and bits of each, by selector.
COUNT = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTH = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE, GROUP = 15, 128
MAGIC, HEAD = b"S8B1", struct.Struct("<6Q")


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each group of 128 ids). All groups advance together, a word of each at a step.

    Ids of up to 64 bits; no ids give no words. A word that reaches past its group's end holds zeros there."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    groups = -(-n // GROUP)
    values = np.zeros((groups, GROUP), np.uint64)
    values.reshape(-1)[:n] = ids
    values = np.pad(values, ((0, 0), (0, COUNT[0])))
    bits = np.frexp(values.astype(np.float64))[1].astype(np.int8)
    ends = np.minimum(GROUP, n - np.arange(groups) * GROUP)
    at, active, step = np.zeros(groups, np.int64), np.arange(groups), 0
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (group, step, word)
    while len(active):
        here = at[active]
        choice = _selectors(bits, active, here)
        word, moved = np.zeros(len(active), np.uint64), np.ones(len(active), np.int64)
        raw = choice == len(COUNT)
        for s in np.unique(choice[~raw]).tolist():
            own, count, width = choice == s, int(COUNT[s]), int(WIDTH[s])
            held = values[active[own, None], here[own, None] + np.arange(count)]
            word[own] = np.bitwise_or.reduce(held << (np.arange(count) * width).astype(np.uint64), axis=1) | np.uint64(s << 60)
            moved[own] = count
        word[raw] = np.uint64(ESCAPE << 60 | 1)
        made.append((active, np.full(len(active), 2 * step), word))
        if raw.any():
            made.append((active[raw], np.full(int(raw.sum()), 2 * step + 1), values[active[raw], here[raw]]))
        at[active] += moved
        active, step = active[at[active] < ends[active]], step + 1
    group, step_of, word = (np.concatenate(x) for x in zip(*made, strict=True))
    order = np.lexsort((step_of, group))
    return word[order], starts_of(np.bincount(group, minlength=groups)).astype(np.uint32)


def _selectors(bits: np.ndarray, group: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place the first selector whose ids all fit; 14 if even the first id is too wide."""

    def first(rows: np.ndarray, some: int) -> np.ndarray:
        widest = np.maximum.accumulate(bits[group[rows, None], at[rows, None] + np.arange(COUNT[some])], axis=1)
        fits = widest[:, COUNT[some:] - 1] <= WIDTH[some:]
        return np.where(fits.any(axis=1), some + fits.argmax(axis=1), len(COUNT))

    choice = first(np.arange(len(group)), 3)
    narrow = np.flatnonzero(choice == 3)  # only these can lie closer
    if len(narrow):
        choice[narrow] = first(narrow, 0)
    return choice


def decode(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The n ids. `first` tells where groups start; the last word of a group may have room for more ids than are left."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE).tolist():  # a value after an escape may look like one
        if not raw[i]:
            raw[i + 1 : i + 1 + int(words[i] & np.uint64((1 << 60) - 1))] = True
    escape = (selector == ESCAPE) & ~raw
    holds = np.where(raw, 1, np.where(escape, 0, COUNT[np.minimum(selector, len(COUNT) - 1)]))
    group = np.zeros(len(words), np.int64)
    group[first[1:]] = 1
    group = np.cumsum(group)
    before = starts_of(holds)
    inside = before - before[first][group]
    room = np.minimum(GROUP, n - group * GROUP) - inside
    holds = np.minimum(holds, room)
    target = group * GROUP + inside
    out[target[raw]] = words[raw]
    normal = ~raw & ~escape
    for s in np.unique(selector[normal]).tolist():
        own = np.flatnonzero(normal & (selector == s))
        count, width = int(COUNT[s]), int(WIDTH[s])
        values = (words[own, None] >> (np.arange(count) * width).astype(np.uint64)) & np.uint64((1 << width) - 1)
        real = np.arange(count) < holds[own, None]
        out[(target[own, None] + np.arange(count))[real]] = values[real]
    return out


def block_bytes(shard: int, place: int, keys: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    coded, first = encode(ids)
    head = HEAD.pack(shard, place, len(keys), len(ids), len(coded), len(first))
    return b"".join((
        MAGIC, struct.pack("<I", len(head)), head,
        np.array([k or 0 for k in keys], "<i8").tobytes(), bytes(k is None for k in keys), counts.astype("<u8").tobytes(),
        first.astype("<u4").tobytes(), coded.astype("<u8").tobytes(),
    ))


def blocks_in(content: bytes) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """(shard, place in shard, doc_ids, ids per document, ids) of each block of a file."""
    at, data = 0, memoryview(content)
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        (size,) = struct.unpack_from("<I", data, at + 4)
        shard, place, docs, n, n_words, groups = HEAD.unpack_from(data, at + 8)
        at += 8 + size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(data, kind, count, at)
            at += values.nbytes
            return values

        keys, null, counts, first, coded = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u4", groups), take("<u8", n_words)
        at += 1
        yield shard, place, [None if x else k for k, x in zip(keys.tolist(), null, strict=True)], counts.astype(np.int64), decode(coded, first.astype(np.int64), n)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, shards: int | None = None, block_ids: int = 1 << 20, file_blocks: int = 16) -> None:
    """Writes the ids of every whole text, each with `end_id` after it, in ascending doc_id order over shards and blocks.

    Shards are ranges of doc_id (ties: of a hash of the text), so a hot doc_id does not make a hot shard; a shard's
    files have at most `file_blocks` blocks each, whatever the number of shards. Null and empty texts are `end_id` alone; a null doc_id comes first; rows that repeat are
    written each; other columns are not read. An empty table writes no blocks."""
    spark = docs.sparkSession
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = F.xxhash64("text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, place, coder = TaskContext.get().partitionId(), 0, json_tokenizer(tokenizer_path(tokenizer))
        keys, counts, parts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            body = block_bytes(shard, place, keys, np.concatenate(counts), np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["block"])

        for batch, texts in text_slices(batches, keep_held=True):
            n, ids = coder.encode(texts)
            keys += batch.column("doc_id").to_pylist()
            counts.append(n + 1)
            parts.append(np.insert(ids, np.cumsum(n), np.uint32(end_id)))
            held += len(parts[-1])
            if held >= block_ids:
                yield block()
                place, keys, counts, parts, held = place + 1, [], [], [], 0
        if keys:
            yield block()

    ranged = docs.select("doc_id", "text", tie.alias("tie")).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    # The text writer puts a value's bytes into the file as they are, and commits a task's file as a whole.
    ranged.select("doc_id", "text").mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", file_blocks).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """shard, place, doc_id, inside, n_tokens, ids_crc32 of every document in the files below `path`; inside: ids of its
    block before it."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for shard, place, keys, counts, ids in blocks_in(content.as_py()):
                    first, plain = starts_of(counts), ids.astype("<u4")
                    crc = [zlib.crc32(plain[a : a + n].tobytes()) for a, n in zip(first.tolist(), counts.tolist(), strict=True)]
                    m = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in ([shard] * m, [place] * m, keys, first, counts, crc)], names=["shard", "place", "doc_id", "inside", "n_tokens", "ids_crc32"]
                    )

    schema = "shard long, place long, doc_id long, inside long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(digest, schema)


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, where start counts the ids of all documents before in the files' order."""
    rows = materialise(read_tokens(spark, path))
    blocks = rows.groupBy("shard", "place").agg(F.sum("n_tokens").alias("ids"))
    shard_sums = running_before(blocks.groupBy("shard").agg(F.sum("ids").alias("ids")), "shard", F.col("ids"), "shard_start").drop("ids")
    block_sums = running_before_in(blocks).join(shard_sums, "shard")
    starts = block_sums.select("shard", "place", (F.col("shard_start") + F.col("block_start")).alias("base"))
    out = rows.join(starts, ["shard", "place"])
    return out.select("doc_id", (F.col("base") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def running_before_in(blocks: DataFrame) -> DataFrame:
    """Adds block_start: the ids before each block in its shard."""
    w = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("block_start", F.coalesce(F.sum("ids").over(w), F.lit(0)).cast("long"))


def encode_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID) -> DataFrame:
    """Writes the documents' ids to a new shared folder and gives what reading it back finds."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-ids")
    write_tokens(docs, path, tokenizer, end_id)
    return token_positions(spark, path)
