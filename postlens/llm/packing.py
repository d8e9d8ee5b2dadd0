"""Packing documents into sequences with a bounded number of open windows."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import materialise, starts_of, text_slices
from postlens.llm.pieces import json_tokenizer, tokenizer_path

END_ID, WINDOW, OPEN_WINDOWS, FAN_IN = 1, 2048, 64, 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, at long, leftover boolean"


class OpenWindows:
    """At most `most` open windows. A piece goes where it leaves the least room; if none has room, the fullest of a full
    set is emitted and a new window opens."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.number = size, most, 0
        self.open: list[tuple[int, int]] = []  # (room, window), in order

    def place(self, length: int) -> tuple[int, int]:
        """The window and the offset in it for a piece of at most `size` tokens."""
        if length >= self.size:
            self.number += 1
            return self.number - 1, 0
        i = bisect_left(self.open, (length, -1))
        if i < len(self.open):
            room, window = self.open.pop(i)
        else:
            if len(self.open) >= self.most:
                self.open.pop(0)  # the fullest: it has the least room
            room, window = self.size, self.number
            self.number += 1
        if room > length:
            insort(self.open, (room - length, window))
        return window, self.size - room


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", size: int = WINDOW, most: int = OPEN_WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task keeps `most` windows open over its own documents and emits the fullest when none fits. What is still open
    at the end, at most `most` windows a task, is merged by the same rule: tasks in groups of `fan_in`, the groups'
    leftovers again, until one group is left. So no task holds more than fan_in * most leftovers at a time. Windows are
    rows of numbers by then; the pieces follow by a join.

    A document is its ids and END_ID; it is cut only where it is longer than a window, into full windows and a rest.
    Null and empty texts are END_ID alone. Rows that repeat are packed each. A null doc_id stays null. An empty table
    gives no rows."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, windows = json_tokenizer(tokenizer_path(tokenizer)), OpenWindows(size, most)
        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        for batch, texts in text_slices(batches, keep_held=True):
            counts, ids = coder.encode(texts)
            first = starts_of(counts)
            for key, begin, n in zip(batch.column("doc_id").to_pylist(), first.tolist(), counts.tolist(), strict=True):
                own = np.append(ids[begin : begin + n], np.uint32(END_ID)).astype("<u4")
                for start in range(0, n + 1, size):
                    part = own[start : start + size]
                    window, at = windows.place(len(part))
                    rows.append((key, start, len(part), zlib.crc32(part.tobytes()), n + 1, base + window, at))
            if len(rows) >= 20_000:
                yield numbered(rows)
                rows = []
        if rows:
            yield numbered(rows)
        if windows.open:  # a row of its own for each window that is still open
            yield numbered([(None, None, size - room, None, None, base + w, None) for room, w in windows.open])

    names = [x.split()[0] for x in PIECES.split(", ")][:-1]

    def numbered(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r[6] is None for r in rows])], names=[*names, "leftover"])

    filled = materialise(docs.select("doc_id", "text").mapInArrow(fill, PIECES))
    moved = merge_leftovers(filled.where("leftover").select("window", F.col("length").alias("used")), size, most, fan_in)
    pieces = filled.where(~F.col("leftover")).join(moved, "window", "left")
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("into", "window").alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset"),
    )


def merge_leftovers(left: DataFrame, size: int, most: int, fan_in: int) -> DataFrame:
    """window, into, shift: every leftover window goes whole behind others, into the sequence named by the first of them."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("team", "root", "held")), strict=True):
                if row[0] != group and rows:
                    yield merged(rows)
                    rows = []
                group = row[0]
                rows.append(row)
        if rows:
            yield merged(rows)

    def merged(rows: list[tuple]) -> pa.RecordBatch:
        """Best fit, the largest first; full and emitted windows are done, the rest goes on to the next round."""
        windows, name, out = OpenWindows(size, most), {}, []
        for _, root, held in sorted(rows, key=lambda r: (-r[2], r[1])):
            window, at = windows.place(held)
            out.append((root, name.setdefault(window, root), at, window))
        room = {w: r for r, w in windows.open}
        cols = list(zip(*((root, into, at, size - room.get(w, 0), w in room) for root, into, at, w in out), strict=True))
        kinds = [pa.int64()] * 4 + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["root", "next", "at", "total", "open"])

    schema = "root long, next long, at long, total long, open boolean"
    todo = materialise(left.select("window", F.col("window").alias("root"), F.col("used").alias("held"), F.lit(0).cast("long").alias("shift"), F.shiftright("window", 33).alias("team")))
    done = []
    while True:
        last = (todo.agg(F.max("team")).first()[0] or 0) < fan_in
        todo = todo.withColumn("team", F.floor(F.col("team") / fan_in))
        parts = max(1, int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        roots = todo.where("window = root").select("team", "root", "held").repartition(parts, "team").sortWithinPartitions("team", "root")
        step = materialise(roots.mapInArrow(merge, schema))
        todo = materialise(
            todo.join(step, "root").select("window", F.col("next").alias("root"), F.col("total").alias("held"), (F.col("shift") + F.col("at")).alias("shift"), "team", "open")
        )
        if last:
            done.append(todo)
            break
        done.append(todo.where("NOT open"))
        todo = todo.where("open").drop("open")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("window", F.col("root").alias("into"), "shift")
