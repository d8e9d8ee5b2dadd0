"""Near duplicates: b-bit MinHash signatures, a multi-index Hamming join, and a check of every link on full sets.

A signature has CHUNKS chunks of CHUNK components, each the low BITS bits of one MinHash. Two signatures that differ in
at most d components have a chunk with at most floor(d / CHUNKS) differing components; with ERRORS of them allowed, every
pair with d < CHUNKS * (ERRORS + 1) is found. The allowed errors of a chunk are enumerated by leaving out components:
two chunks that differ in one component agree on the key that leaves it out. Equal keys tie documents into clusters; links
are looked for within clusters only, and confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import hash_words, materialise, mix, ragged, starts_of, text_slices, words
from postlens.llm.components import connected_components


@dataclass(frozen=True)
class Setting:
    """width: words in a shingle. percent: least similarity of a link. chunks, chunk, errors: the multi-index.
    slack: components in which a pair may differ and still be checked on full sets (beyond the guaranteed distance)."""

    width: int = 5
    percent: int = 80
    chunks: int = 16
    chunk: int = 6
    errors: int = 1
    slack: int = 48
    block_rows: int = 1024
    block_shingles: int = 1 << 20

    @property
    def components(self) -> int:
        return self.chunks * self.chunk

    @property
    def guaranteed(self) -> int:
        return self.chunks * (self.errors + 1) - 1


GAP = np.uint64(0x2545F4914F6CDD1D)  # stands behind the words of a text that is shorter than a shingle
COMBINED_DOCS = 8192


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of whole texts, in order: A-Z in lower case, words between ASCII white space.

    A text with fewer words than a shingle has one, of all its words; one without words has none."""
    owner, codes, distinct = words(texts, lower=True)
    h = hash_words(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.bincount(owner, minlength=len(texts))
    filled = np.where((n > 0) & (n < width), width, n)
    flat = np.full(int(filled.sum()), GAP)
    first = starts_of(filled)
    flat[ragged(first, n)] = h
    begin = ragged(first, np.maximum(filled - width + 1, 0))
    owner = np.repeat(np.arange(len(texts)), np.maximum(filled - width + 1, 0))
    x = np.full(len(begin), np.uint64(width))
    for j in range(width):
        x = mix(x ^ flat[begin + j], j + 1)
    order = np.lexsort((x, owner))
    owner, x = owner[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], x[new]


def signatures(owner: np.ndarray, x: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and their signatures: a byte per MinHash."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros((0, components), np.uint8)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    rng = np.random.Generator(np.random.PCG64(20))
    factors = rng.integers(0, 1 << 63, components, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    shifts = rng.integers(0, 1 << 63, components, dtype=np.uint64)
    out = np.empty((len(first), components), np.uint8)
    for i in range(components):
        least = np.minimum.reduceat(x * factors[i] + shifts[i], first)
        out[:, i] = mix(least, i) & np.uint64(255)
    return owner[first], out


def chunk_keys(signature: np.ndarray, s: Setting) -> np.ndarray:
    """Keys of each signature: each chunk with each choice of `errors` components left out. Up to 7 components stay."""
    stay = list(combinations(range(s.chunk), s.chunk - s.errors))
    keys = np.empty((len(signature), s.chunks * len(stay)), np.int64)
    parts = signature.reshape(-1, s.chunks, s.chunk).astype(np.uint64)
    for c in range(s.chunks):
        for t, places in enumerate(stay):
            key = np.full(len(signature), np.uint64(c * len(stay) + t + 1))
            for p in places:
                key = key << np.uint64(8) | parts[:, c, p]
            keys[:, c * len(stay) + t] = key.astype(np.int64)
    return keys


def classes(docs: DataFrame, s: Setting) -> DataFrame:
    """doc_id, n_shingles, rep: the smallest doc_id with the same set (null for a text without words)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            owner, x = shingles(texts, s.width)
            n = np.bincount(owner, minlength=len(texts))
            sums = np.zeros((2, len(texts)), np.uint64)
            if len(x):
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                for i in (0, 1):
                    sums[i, owner[first]] = np.add.reduceat(mix(x, 101 + i), first)
            empty = n == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(sums[i].view(np.int64), pa.int64(), mask=empty) for i in (0, 1))], names=["doc_id", "n_shingles", "h1", "h2"]
            )

    rows = materialise(docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n_shingles long, h1 long, h2 long"))
    # Written, so that the join is one of two plain shuffles and a class of very many documents is split.
    least = materialise(rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")))
    return rows.join(least, ["h1", "h2"], "left").select("doc_id", "n_shingles", "rep")


def ties(docs: DataFrame, s: Setting) -> DataFrame:
    """a, b: documents with a key in common, as few pairs as connect all that share it.

    A task sends a key once for each COMBINED_DOCS documents that have it, and ties the others to the first of them at
    once, so a key of very many documents is neither a hot row nor a hot group."""

    def emit(ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        width = keys.shape[1]
        flat, docs_of = keys.reshape(-1), np.repeat(ids, width)
        order = np.lexsort((docs_of, flat))
        flat, docs_of = flat[order], docs_of[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        lead = docs_of[np.flatnonzero(new)][np.cumsum(new) - 1]
        other = lead != docs_of
        pairs = np.unique(np.stack([lead[other], docs_of[other]], axis=1), axis=0)
        spread = -1 - (mix(pairs[:, 0].astype(np.uint64) * np.uint64(31) + pairs[:, 1].astype(np.uint64), 7) >> np.uint64(2)).astype(np.int64)
        nothing = pa.nulls(int(new.sum()), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([flat[new], spread])), pa.array(np.concatenate([docs_of[new], pairs[:, 0]])), pa.concat_arrays([nothing, pa.array(pairs[:, 1])])], names=["key", "a", "b"]
        )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, held = [], [], 0
        for batch, texts in text_slices(batches):
            own, signature = signatures(*shingles(texts, s.width), s.components)
            if len(own):
                ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False)[own].astype(np.int64))
                keys.append(chunk_keys(signature, s))
                held += len(own)
            if held >= COMBINED_DOCS:
                yield emit(np.concatenate(ids), np.concatenate(keys))
                ids, keys, held = [], [], 0
        if held:
            yield emit(np.concatenate(ids), np.concatenate(keys))

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(sketch, "key long, a long, b long")
    first = F.min("a").over(Window.partitionBy("key"))
    pairs = rows.select(F.when(F.col("b").isNull(), first).otherwise(F.col("a")).alias("p"), F.coalesce("b", "a").alias("q"))
    return pairs.where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()


def blocks(members: DataFrame, s: Setting) -> DataFrame:
    """member, task, side: in which tasks a cluster's members meet. members: member, cluster, n.

    A small cluster is one task. A larger one is cut into size classes, of which only neighbours can have links, and
    those into blocks of bounded rows and shingles; each task gets one block, or two."""
    ratio = 100 / s.percent
    # Sums are written before they are joined back, so that a large cluster's rows are split.
    sums = materialise(members.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("n").alias("load")))
    small = (F.col("rows") <= s.block_rows) & (F.col("load") <= s.block_shingles)
    sized = members.join(sums.where("rows > 1"), "cluster").withColumn("bin", F.when(small, F.lit(-2)).otherwise(F.floor(F.log(F.col("n")) / float(np.log(ratio)) + 1e-9)).cast("int")).drop("rows", "load")
    parts = sized.groupBy("cluster", "bin").agg(F.count("*").alias("rows"), F.sum("n").alias("load"))
    parts = parts.withColumn("k", F.ceil(F.greatest(F.col("rows") / s.block_rows, F.col("load") / s.block_shingles, F.lit(1))).cast("int"))
    w = Window.partitionBy("cluster").orderBy("bin")
    near = lambda f: F.when(f("bin").over(w) == F.col("bin") + (1 if f is F.lead else -1), f("k").over(w)).otherwise(0)
    parts = materialise(parts.select("cluster", "bin", "k", near(F.lead).alias("up"), near(F.lag).alias("down")))
    placed = sized.join(parts, ["cluster", "bin"]).withColumn("own", F.pmod(F.xxhash64("member"), F.col("k")).cast("int"))

    def meet(count: str, fn) -> F.Column:
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), fn)).otherwise(F.array().cast("array<struct<task:string,side:int>>"))

    def task(low_bin, low, high_bin, high, side) -> F.Column:
        return F.struct(F.concat_ws(":", F.col("cluster"), low_bin, low, high_bin, high).alias("task"), side.cast("int").alias("side"))

    same = meet("k", lambda t: task(F.col("bin"), F.least("own", t), F.col("bin"), F.greatest("own", t), (F.col("own") > t).cast("int")))
    up = meet("up", lambda t: task(F.col("bin"), F.col("own"), F.col("bin") + 1, t, F.lit(0)))
    down = meet("down", lambda t: task(F.col("bin") - 1, t, F.col("bin"), F.col("own"), F.lit(1)))
    out = placed.select("member", F.explode(F.concat(same, up, down)).alias("m"))
    return out.select("member", "m.task", "m.side")


class Links:
    """Confirmed links in one task's sets: those that join parts not yet joined."""

    def __init__(self, s: Setting):
        self.s = s

    def find(self, ids: np.ndarray, side: np.ndarray, owner: np.ndarray, x: np.ndarray) -> list[tuple[int, int]]:
        """owner, x: shingles of the rows. Rows of both sides: only pairs across. Pairs whose signatures differ in more
        than `slack` components are passed over; all others are checked on full sets, unless already joined."""
        n = np.bincount(owner, minlength=len(ids))
        first = starts_of(n)
        across = side.min() != side.max()
        signature = signatures(owner, x, self.s.components)[1] if len(ids) > 2 else None
        parent = np.arange(len(ids))
        out = []
        for i in range(len(ids) - 1):
            js = np.arange(i + 1, len(ids))
            ok = parent[js] != parent[i]
            if across:
                ok &= side[js] != side[i]
            lo, hi = np.minimum(n[js], n[i]), np.maximum(n[js], n[i])
            ok &= 100 * lo >= self.s.percent * hi
            js = js[ok]
            if len(js) and signature is not None:
                js = js[(signature[js] != signature[i]).sum(axis=1) <= self.s.slack]
            if not len(js):
                continue
            mine = x[first[i] : first[i] + n[i]]
            theirs = x[ragged(first[js], n[js])]
            hit = mine[np.minimum(np.searchsorted(mine, theirs), n[i] - 1)] == theirs
            shared = np.add.reduceat(hit.astype(np.int64), starts_of(n[js]))
            for j in js[100 * shared >= self.s.percent * (n[i] + n[js] - shared)].tolist():
                if parent[j] != parent[i]:
                    parent[parent == parent[j]] = parent[i]
                    out.append((int(ids[i]), int(ids[j])))
        return out


def confirmed(members: DataFrame, docs: DataFrame, s: Setting) -> DataFrame:
    """a, b: links that join each cluster's linked members. Only members' texts meet; their sets are built again."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.nbytes < 4 << 20:
                continue
            task = held.column("task").combine_chunks()
            last = task[-1].as_py()
            stop = held.num_rows
            names = task.to_pylist()
            while stop and names[stop - 1] == last:
                stop -= 1
            if stop:
                yield from search(held.slice(0, stop))
                held = held.slice(stop)
        if held is not None and held.num_rows:
            yield from search(held)

    def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        names = np.array(rows.column("task").to_pylist(), object)
        ids = rows.column("member").to_numpy().astype(np.int64)
        side = rows.column("side").to_numpy()
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in rows.column("text").chunks])
        owner, x = shingles(texts, s.width)
        # A repeated doc_id may have a text without words, which links with nothing.
        some = np.bincount(owner, minlength=len(ids)) > 0
        if not some.any():
            return
        names, ids, side, owner = names[some], ids[some], side[some], (np.cumsum(some) - 1)[owner]
        bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
        edges = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(ids)]])
        links, finder = [], Links(s)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo > 1:
                a, b = bounds[lo], bounds[hi]
                links += finder.find(ids[lo:hi], side[lo:hi], owner[a:b] - lo, x[a:b])
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("member"), "text")
    rows = blocks(members, s).join(texts, "member")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "task").sortWithinPartitions("task", "member").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    component_id is the smallest doc_id that links of at least `percent` similarity lead to, the document itself
    included; kept marks that document. Texts without words are linked with nothing. A row whose doc_id is null is
    linked with nothing, has a null component and is kept. Rows that repeat a doc_id with another text are one node with
    the links of all its texts; repeated rows are each returned. Other columns are not read; an empty table gives no rows."""
    s = setting
    known = materialise(classes(docs, s))
    cluster = connected_components(ties(docs, s))
    reps = known.where("rep IS NOT NULL AND doc_id = rep").groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    members = materialise(cluster.join(reps, F.col("node") == F.col("doc_id")).select(F.col("node").alias("member"), F.col("component").alias("cluster"), "n"))
    links = connected_components(confirmed(members, docs, s))
    out = known.join(links, known["rep"] == links["node"], "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


# Two-word shingles, as the registered query takes them.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh
    FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
