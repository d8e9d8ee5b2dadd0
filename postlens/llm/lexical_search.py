"""Ranked lexical search over K2-treaps: compressed quadtrees of a term-document grid whose cells hold impact maxima."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.llm.common import shared_path, terms, text_slices

TOP, BLOCK_DOCS, BLOCK_BYTES, SLICE_BYTES, BATCH_BYTES, FIRST_POP = 20, 8192, 16 << 20, 2 << 20, 8 << 20, 32
# Rows of an index are large and differ: each is written out once it is there, and no dictionary of them is tried.
ROW_GROUPS = {"compression": "zstd", "parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
# Set bits of a 4-bit mask below a place: where a cell's child stands among its brothers.
_BELOW = np.array([[bin(m & ((1 << s) - 1)).count("1") for s in range(4)] for m in range(16)], np.int64)
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all terms with repeats: what impacts rest on."""

    documents: int
    terms: int

    def impact(self, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a term adds to a document's score, without the term's weight; whole numbers."""
        m = 75 + 25 * length * self.documents // max(self.terms, 1)
        return 1_000_000_000 * times // (1000 * times + 12 * m)

    def weight(self, held_by: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * held_by + 1)))


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits at every other place."""
    x = x.astype(np.uint64)
    for shift, mask in _SPREAD:
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


@dataclass(frozen=True)
class Treap:
    """Cells by level from the root, within a level in Morton order (row bit above column bit).

    masks: which of an inner cell's four children exist; drops: by how much a cell's maximum is below its parent's."""

    depth: int
    masks: np.ndarray  # uint8, of all inner cells
    drops: np.ndarray  # uint32, of all cells

    @staticmethod
    def build(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> Treap:
        """From the cells of a grid, each once; rows and columns below 2^31."""
        if not len(rows):
            return Treap(0, np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        depth = max(1, int(max(rows.max(), columns.max())).bit_length())
        key = _spread(rows) << np.uint64(1) | _spread(columns)
        by_key = np.argsort(key)
        key, most = key[by_key], impacts[by_key]
        del rows, columns, impacts, by_key
        masks, drops = [], []
        for _ in range(depth):
            up = key >> np.uint64(2)
            first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            parent = np.maximum.reduceat(most, first)
            masks.append(np.bitwise_or.reduceat(np.uint8(1) << (key & np.uint64(3)).astype(np.uint8), first))
            drops.append((np.repeat(parent, np.diff(np.append(first, len(key)))) - most).astype(np.uint32))
            key, most = up[first], parent
            del up, first, parent
        return Treap(depth, np.concatenate(masks[::-1]), np.concatenate([most.astype(np.uint32), *drops[::-1]]))

    def open(self) -> Cells:
        """Cells with their maxima and the place of their first child."""
        children = (_BELOW[:, 3] + (np.arange(16) >> 3)).astype(np.uint8)[self.masks]
        first = np.ones(len(children), np.int32)  # the root is cell 0, and the children of inner cells follow in order
        np.cumsum(children[:-1], dtype=np.int32, out=first[1:])
        first[1:] += 1
        most, at, n = self.drops.astype(np.int32), 0, 1
        for _ in range(self.depth):
            held = children[at : at + n]
            below = int(held.sum())
            most[at + n : at + n + below] = np.repeat(most[at : at + n], held) - most[at + n : at + n + below]
            at, n = at + n, below
        return Cells(self.depth, self.masks, first, most)


@dataclass(frozen=True)
class Cells:
    depth: int
    masks: np.ndarray
    first: np.ndarray
    most: np.ndarray

    def best(self, rows: np.ndarray, weights: np.ndarray, top: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of all columns that score at least as the top-th best one, and at least `floor`.

        The paths of all rows descend jointly over ranges of columns. A range's bound is the sum of its cells' maxima by
        weight. The ranges of the highest bounds are opened first, a few at once and, when these have reached single
        columns, twice as many each time; a range whose bound is below the top-th best score found is never opened."""
        pool_level, pool_column, pool_bound = np.array([self.depth]), np.zeros(1, np.int64), np.array([int((weights * self.most[0]).sum())])
        owner, cell, row = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        columns, scores, pop, rounds = [], [], FIRST_POP, 0
        found = np.zeros(0, np.int64)
        while len(pool_bound):
            live = pool_bound >= floor
            if not live.all():
                pool_level, pool_column, pool_bound, owner, cell, row = _take(live, pool_level, pool_column, pool_bound, owner, cell, row)
                if not len(pool_bound):
                    break
            if len(pool_bound) > pop:
                chosen = np.zeros(len(pool_bound), bool)
                chosen[np.argpartition(-pool_bound, pop - 1)[:pop]] = True
            else:
                chosen = np.ones(len(pool_bound), bool)
            level, column, _, o, c, r = _take(chosen, pool_level, pool_column, pool_bound, owner, cell, row)
            pool_level, pool_column, pool_bound, owner, cell, row = _take(~chosen, pool_level, pool_column, pool_bound, owner, cell, row)
            rounds += 1
            pop *= 2 if rounds > self.depth else 1
            # Each row's path goes to the half its row bit names; both halves of the columns are tried.
            down = level[o] - 1
            slot = (rows[r] >> down & 1) * 2
            mask, base = self.masks[c], self.first[c]
            parts = [(has := np.flatnonzero(mask >> (slot + half) & 1), o[has] * 2 + half, base[has] + _BELOW[mask[has], slot[has] + half], r[has]) for half in (0, 1)]
            o, c, r = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
            total = np.bincount(o, weights[r] * self.most[c], 2 * len(level)).astype(np.int64)
            level = np.repeat(level - 1, 2)
            column = np.repeat(column * 2, 2) + np.tile([0, 1], len(column))
            leaf = (level == 0) & (total >= floor)
            if leaf.any():
                columns.append(column[leaf])
                scores.append(total[leaf])
                found = np.concatenate([found, total[leaf]])
                if len(found) >= top:
                    found = -np.partition(-found, top - 1)[:top]
                    floor = max(floor, int(found.min()))
            kept = (level > 0) & (total >= floor)
            level, column, total, o, c, r = _take(kept, level, column, total, o, c, r)
            owner = np.concatenate([owner, o + len(pool_bound)])
            pool_level, pool_column, pool_bound = np.concatenate([pool_level, level]), np.concatenate([pool_column, column]), np.concatenate([pool_bound, total])
            cell, row = np.concatenate([cell, c]), np.concatenate([row, r])
        if not columns:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        columns, scores = np.concatenate(columns), np.concatenate(scores)
        kept = scores >= floor
        return columns[kept], scores[kept]


def _take(kept, level, column, bound, owner, cell, row):
    """The kept ranges with their rows' cells."""
    to = np.cumsum(kept) - 1
    own = kept[owner]
    return level[kept], column[kept], bound[kept], to[owner[own]], cell[own], row[own]


BLOCKS = "block long, n_docs int, doc_ids binary, terms string, held_by binary, depth int, masks binary, drops binary"


def measure(docs: DataFrame) -> Corpus:
    """Documents with a term and number of terms over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches):
            n = np.bincount(terms(texts)[0], minlength=1)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["documents", "terms"])

    total = docs.select("text").mapInArrow(count, "documents long, terms long").agg(F.sum("documents").alias("d"), F.sum("terms").alias("t")).first()
    return Corpus(total["d"] or 0, total["t"] or 0)


def index(docs: DataFrame, path: str, corpus: Corpus, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes a treap per block of documents to `path` and reads them back.

    A block has at most block_docs documents of one task and, if it has several, about block_bytes of text. Its columns
    are its documents by id (null ids last), its rows its terms, those of most documents first and those of equally many
    by their first document, which keeps lone cells of one document together. Rows that repeat are documents of their own.
    Of a block's texts only their cells are kept, slice by slice. A large block is a row group of its own, so that writers
    and readers of a file hold one at a time."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch, texts in text_slices(batches, limit=SLICE_BYTES):
            parts = [(batch.column("doc_id"), texts)]
            while parts:
                ids, texts = parts.pop()
                room = block_docs - n
                if len(ids) > room:
                    parts.append((ids.slice(room), texts.slice(room)))
                    ids, texts = ids.slice(0, room), texts.slice(0, room)
                held.append((ids.take(pa.array(np.arange(len(ids)))), *cells_of(texts, corpus)))  # a slice would keep its batch
                n, size = n + len(ids), size + int(pc.sum(pc.binary_length(texts)).as_py() or 0)
                if n >= block_docs or size >= block_bytes:
                    yield block(held)
                    held, n, size = [], 0, 0
        if held:
            yield block(held)

    def block(held: list) -> pa.RecordBatch:
        """From the parts in `held`, which is emptied."""
        ids = pa.concat_arrays([ids for ids, *_ in held])
        order = pc.array_sort_indices(ids)  # nulls last
        place = np.empty(len(ids), np.int32)
        place[order.to_numpy()] = np.arange(len(ids))
        coded = pa.concat_arrays([names for *_, names, _ in held]).dictionary_encode()
        code_of, distinct = np.split(coded.indices.to_numpy(), np.cumsum([len(names) for *_, names, _ in held])[:-1]), coded.dictionary
        place_of = np.split(place, np.cumsum([len(ids) for ids, *_ in held])[:-1])
        term = np.concatenate([to[code] for to, (_, code, *_) in zip(code_of, held, strict=True)])
        column = np.concatenate([to[owner] for to, (_, _, owner, *_) in zip(place_of, held, strict=True)])
        impacts, n_terms = np.concatenate([part for _, _, _, part, *_ in held]), sum(n for *_, n in held)
        held.clear()
        held_by, first = np.bincount(term, minlength=len(distinct)), np.full(len(distinct), len(ids), np.int32)
        np.minimum.at(first, term, column)
        known = np.flatnonzero(held_by)  # an empty string may be among the distinct ones
        rank = known[np.lexsort((first[known], -held_by[known]))]
        row_of = np.empty(len(distinct), np.int32)
        row_of[rank] = np.arange(len(rank))
        row = row_of[term]
        del term
        tree = Treap.build(row, column, impacts)
        del row, column, impacts
        names = distinct.take(pa.array(rank))
        joined = "" if not len(names) else pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.cast(pa.string())), " ")[0].as_py()
        sorted_ids = ids.take(order)
        key = hash_of(sorted_ids, n_terms)
        values = [pa.array([key], pa.int64()), pa.array([len(ids)], pa.int32()), blob(packed_ids(sorted_ids)), pa.array([joined], pa.string()), blob(held_by[rank].astype(np.uint32)), pa.array([tree.depth], pa.int32()), blob(tree.masks), blob(planes(tree.drops))]
        return pa.RecordBatch.from_arrays(values, names=[x.split()[0] for x in BLOCKS.split(", ")])

    docs.select("doc_id", "text").mapInArrow(blocks, BLOCKS).write.options(**ROW_GROUPS).parquet(path)
    return docs.sparkSession.read.schema(BLOCKS).parquet(path)


def cells_of(texts: pa.Array, corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, int]:
    """For each text and each of its terms the term's code, the text's place and the impact; the terms by code, and their number with repeats."""
    owner, codes, distinct = terms(texts)
    length = np.bincount(owner, minlength=len(texts))
    key = np.sort(codes * len(texts) + owner)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    code, place = key[first] // len(texts), key[first] % len(texts)
    return code.astype(np.int32), place.astype(np.int32), corpus.impact(times, length[place]).astype(np.int32), distinct, len(codes)


def hash_of(ids: pa.Array, n: int) -> int:
    """Deals blocks into groups; any number does."""
    return (int(pc.sum(pc.fill_null(ids, 0)).as_py() or 0) + n) % (1 << 40)


def packed_ids(ids: pa.Array) -> np.ndarray:
    """Ids and, at the end, how many of them are null."""
    return np.append(pc.fill_null(ids, 0).to_numpy(), ids.null_count).astype(np.int64)


def blob(values: np.ndarray) -> pa.Array:
    """One binary value with the bytes of the numbers, which are not copied."""
    return pa.BinaryArray.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, values.nbytes], np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def planes(values: np.ndarray) -> np.ndarray:
    """The lowest bytes of all values, then the next ones, as files are compressed by bytes; impacts have three."""
    return np.ascontiguousarray(values.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T[:3])


def from_planes(data) -> np.ndarray:
    low = np.frombuffer(data, np.uint8).reshape(3, -1)
    values = low[2].astype(np.uint32)
    for plane in (low[1], low[0]):
        values <<= np.uint32(8)
        values |= plane
    return values


def held_by(blocks: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each of the words is; only the blocks' words are read."""
    sent = blocks.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(sent.value, pa.string())
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, n = _rows_of(wanted, batch.column("terms")[i].as_py()), np.frombuffer(batch.column("held_by")[i].as_py(), np.uint32)
                total[at >= 0] += n[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    sums = blocks.select("terms", "held_by").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {words[r["word"]]: r["n"] for r in sums.toLocalIterator()}


def _rows_of(wanted: pa.Array, joined: str) -> np.ndarray:
    """The row of each wanted word, -1 without one."""
    if not joined:
        return np.full(len(wanted), -1)
    names = pc.list_flatten(pc.split_pattern(pa.array([joined], pa.large_string()), " "))
    return pc.fill_null(pc.index_in(wanted.cast(pa.large_string()), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def search(blocks: DataFrame, items: list[tuple[int, str]], corpus: Corpus, top: int = TOP) -> DataFrame:
    """item_id, doc_id, score and rank of each item's best documents among those of `blocks`; items are one bounded batch.

    A task goes through its blocks with the items' best scores so far as the least that counts, and sends at most `top`
    rows an item. These meet in two steps, first within groups of tasks."""
    spark = blocks.sparkSession
    counts = [Counter(_terms_of(text)) for _, text in items]
    words = sorted(set().union(*counts))
    held = held_by(blocks, words)
    place = {w: i for i, w in enumerate(words)}
    queries = []
    for (item, _), count in zip(items, counts, strict=True):
        known = [(place[w], n * corpus.weight(held[w])) for w, n in count.items() if w in held]
        queries.append((item, np.array([p for p, _ in known], np.int64), np.array([w for _, w in known], np.int64)))
    sent = spark.sparkContext.broadcast((words, queries))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, queries = sent.value
        wanted, group = pa.array(words, pa.string()), 0
        best = [(np.zeros(0, np.int64),) * 3 for _ in queries]  # score, id, whether the id is null
        for batch in batches:
            for i in range(batch.num_rows):
                block = {c: batch.column(c)[i] for c in batch.schema.names}
                group = group or block["block"].as_py()
                if not block["depth"].as_py():
                    continue
                cells = None  # of the block before
                cells = Treap(block["depth"].as_py(), np.frombuffer(block["masks"].as_buffer(), np.uint8), from_planes(block["drops"].as_buffer())).open()
                row_of = _rows_of(wanted, block["terms"].as_py())
                ids = np.frombuffer(block["doc_ids"].as_buffer(), np.int64)
                ids, missing = ids[:-1], np.arange(len(ids) - 1) >= len(ids) - 1 - ids[-1]
                for q, (_, at, weights) in enumerate(queries):
                    rows = row_of[at]
                    some = rows >= 0
                    if not some.any():
                        continue
                    floor = int(best[q][0].min()) if len(best[q][0]) >= top else 1
                    columns, scores = cells.best(rows[some], weights[some], top, floor)
                    if len(columns):
                        s, d, m = (np.concatenate(x) for x in zip(best[q], (scores, ids[columns], missing[columns]), strict=True))
                        first = np.lexsort((d, m, -s))[:top]
                        best[q] = s[first], d[first], m[first]
        out = [(item, s, d, m) for (item, _, _), (s, d, m) in zip(queries, best, strict=True) if len(s)]
        if out:
            n = [len(s) for _, s, _, _ in out]
            item = pa.array([item for item, *_ in out], pa.int64()).take(pa.array(np.repeat(np.arange(len(out)), n)))
            score, doc, missing = (np.concatenate([x[k] for x in out]) for k in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([item, pa.array(doc, mask=missing.astype(bool)), pa.array(score), pa.array(np.full(len(doc), group))], names=["item_id", "doc_id", "score", "block"])

    best = blocks.mapInArrow(find, "item_id long, doc_id long, score long, block long").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(1024)))
    by_rank = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*by_rank))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*by_rank))).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _terms_of(text: str | None) -> list[str]:
    _, codes, distinct = terms(pa.array([text or ""], pa.large_string()))
    return distinct.take(pa.array(codes)).to_pylist()


@contextmanager
def row_by_row(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile get their rows in Arrow batches of one: rows of an index are large, and a batch holds 64 MB of them by default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batches_of(rows: Iterator, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Items in batches of about `limit` bytes; a larger text stands alone."""
    held, size = [], 0
    for item, text in rows:
        if held and size + len(text or "") > limit:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += len(text or "") + 64
    if held:
        yield held


def rank_documents(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_docs: int = BLOCK_DOCS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of highest score above 0 for each item, ties by doc_id.

    All documents are indexed, and the index is written to the shared folder. Items are searched in batches of
    batch_bytes, whose words and weights tasks get by broadcast; results of several batches are written before the next.
    Null and empty texts have no terms: such documents are never found, such items have no rows. Documents that repeat are
    found each, with equal scores; null ids come last among ties. Items that repeat an item_id are one item each by their text,
    and their rows are ranked apart. Other columns are not read; an empty table gives no rows."""
    spark: SparkSession = docs.sparkSession
    corpus = measure(docs)
    blocks = index(docs, shared_path(spark, "treaps"), corpus, block_docs)
    rows = ((r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").toLocalIterator())
    parts = []
    for batch in batches_of(rows, batch_bytes):
        numbered = [(n, text) for n, (_, text) in enumerate(batch)]
        ids = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(batch)], "n long, item_id long")
        path = shared_path(spark, "found")
        found = search(blocks, numbered, corpus, top).withColumnRenamed("item_id", "n").join(F.broadcast(ids), "n").select("item_id", "rank", "doc_id", "score")
        with row_by_row(spark):
            found.write.parquet(path)
        parts.append(spark.read.schema("item_id long, rank int, doc_id long, score long").parquet(path))
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, parts, none) if not parts else reduce(DataFrame.unionAll, parts)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
n AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY term), n),
i AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * length * n_docs) // n_terms))) AS part FROM t JOIN w USING (term), n),
s AS (SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
