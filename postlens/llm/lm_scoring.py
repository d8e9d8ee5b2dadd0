"""Masked pseudo-likelihood: a small network predicts every word from the words on both sides.

Words are hashed to 4096 buckets, each written as two digits of base 64. From the embeddings of the two words on each
side a hidden layer gives the probability of the first digit, and with that digit's own embedding the probability of
the second. A document's score is the sum of the log probabilities of all its words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import hash_words, materialise, text_slices, words


@dataclass(frozen=True)
class Setting:
    radius: int = 2
    digits: int = 64
    embedding: int = 8
    hidden: int = 32
    rounds: int = 2
    batch: int = 4096
    rate: float = 1.0
    block: int = 1024

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        """Embedding (the last row: beyond the text), hidden layer, first digit, its embedding, second digit."""
        v, h = self.digits, self.hidden
        return [(v * v + 1, self.embedding), (2 * self.radius * self.embedding, h), (h,), (h, v), (v,), (v, h), (h, v), (v,)]


Parameters = list[np.ndarray]


def initial(s: Setting) -> Parameters:
    rng = np.random.Generator(np.random.PCG64(9))
    return [np.zeros(x, np.float32) if len(x) == 1 else (rng.standard_normal(x) * (0.3 if x[0] > s.digits * s.digits else x[0] ** -0.5)).astype(np.float32) for x in s.shapes]


def flat(parameters: Parameters) -> np.ndarray:
    return np.concatenate([p.ravel() for p in parameters])


def shaped(values: np.ndarray, s: Setting) -> Parameters:
    out, at = [], 0
    for shape in s.shapes:
        n = int(np.prod(shape))
        out.append(values[at : at + n].reshape(shape).astype(np.float32))
        at += n
    return out


def sequences(texts: pa.Array, s: Setting) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word of whole texts, A-Z in lower case."""
    owner, codes, distinct = words(texts, lower=True)
    if not len(codes):
        return owner, codes
    return owner, (hash_words(distinct) % np.uint64(s.digits**2)).astype(np.int64)[codes]


def bucketed(docs: DataFrame, s: Setting = Setting()) -> DataFrame:
    """doc_id, buckets: of every word of the whole text, 16 bits each; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            owner, bucket = sequences(texts, s)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))]) * 2
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(bucket.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values.cast(pa.binary())], names=["doc_id", "buckets"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, buckets binary")


def bucket_slices(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, text, bucket) of runs of whole texts with about `limit` bytes of buckets; a longer text stands alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("buckets")).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            rows = batch.slice(start, stop - start)
            held = np.frombuffer(b"".join(rows.column("buckets").to_pylist()), "<u2").astype(np.int64)
            yield rows, np.repeat(np.arange(stop - start), sizes[start:stop] // 2), held
            start = stop


def contexts(owner: np.ndarray, bucket: np.ndarray, s: Setting) -> np.ndarray:
    """Buckets of the words at -radius .. -1, 1 .. radius of every word; beyond the text the last row."""
    pad, n = s.digits**2, len(bucket)
    out = np.full((n, 2 * s.radius), pad, np.int64)
    for column, d in enumerate([*range(-s.radius, 0), *range(1, s.radius + 1)]):
        lo, hi = max(0, -d), min(n, n - d)
        if hi > lo:
            same = owner[lo:hi] == owner[lo + d : hi + d]
            out[lo:hi, column] = np.where(same, bucket[lo + d : hi + d], pad)
    return out


def _exponentials(x: np.ndarray, w: np.ndarray, b: np.ndarray, digit: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of z = x w + b: the values at `digit`, the exponentials, and their sums by row, for inputs of at most `largest` in
    size. Rows are shifted by their maximum only where the weights are large enough for an overflow."""
    z = x @ w
    z += b
    if largest * np.abs(w).sum(axis=0).max() + np.abs(b).max() > 60:
        z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(z)), digit]
    np.exp(z, out=z)
    return own, z, z @ np.ones(z.shape[1], z.dtype)


def _layers(p: Parameters, context: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Input, hidden layer, hidden layer with the first digit, and a bound of the latter's values."""
    x = p[0][context].reshape(len(context), -1)
    h = np.tanh(x @ p[1] + p[2])
    return x, h, h + p[5][first], 1 + float(np.abs(p[5]).max())


def log_probabilities(p: Parameters, context: np.ndarray, target: np.ndarray, s: Setting) -> np.ndarray:
    """Log probability of each target given its context."""
    first, second = target // s.digits, target % s.digits
    _, h, joint, bound = _layers(p, context, first)
    z2, _, sum2 = _exponentials(h, p[3], p[4], first, 1.0)
    z3, _, sum3 = _exponentials(joint, p[6], p[7], second, bound)
    return z2 + z3 - np.log(sum2) - np.log(sum3)


def gradients(p: Parameters, context: np.ndarray, target: np.ndarray, s: Setting) -> Parameters:
    """Of the mean log loss."""
    n, first, second, rows = len(target), target // s.digits, target % s.digits, np.arange(len(target))
    x, h, joint, bound = _layers(p, context, first)
    _, g2, sum2 = _exponentials(h, p[3], p[4], first, 1.0)
    _, g3, sum3 = _exponentials(joint, p[6], p[7], second, bound)
    for g, total, digit in ((g2, sum2, first), (g3, sum3, second)):
        g *= (1 / (n * total))[:, None]
        g[rows, digit] -= g.dtype.type(1 / n)
    gj = g3 @ p[6].T
    gh = (g2 @ p[3].T + gj) * (1 - h * h)
    gx = (gh @ p[1].T).reshape(-1, s.embedding)
    place = context.ravel()
    ge = np.stack([np.bincount(place, gx[:, k], len(p[0])) for k in range(s.embedding)], axis=1)
    is_first = (first[:, None] == np.arange(s.digits)).astype(gj.dtype)
    each = ge, x.T @ gh, gh.sum(0), h.T @ g2, g2.sum(0), is_first.T @ gj, joint.T @ g3, g3.sum(0)
    return [g.astype(q.dtype) for g, q in zip(each, p, strict=True)]


class Descent:
    """Gradient steps scaled by the root of summed squares, which also keeps rare words' rows moving."""

    def __init__(self, parameters: Parameters, s: Setting):
        self.p, self.s = [x.copy() for x in parameters], s
        self.squares = [np.full_like(x, 1e-6) for x in parameters]

    def step(self, context: np.ndarray, target: np.ndarray):
        for x, q, g in zip(self.p, self.squares, gradients(self.p, context, target, self.s), strict=True):
            q += g * g
            x -= np.float32(0.1 * self.s.rate) * g / np.sqrt(q)


def train(docs: DataFrame, s: Setting = Setting()) -> Parameters:
    """Parameters learned from every word of every text; `docs` may be the rows that bucketed() gives.

    Words are dealt over `rounds` by place, so each is a target once. In a round each task goes over its own texts from the
    common parameters and sends what it arrived at, weighted by its number of words; the weighted means, one per
    parameter, are the next round's start. What is gathered grows with the tasks, and so with the input; what reaches the
    driver is one set of parameters. No words leave the initial parameters."""
    spark = docs.sparkSession
    now = initial(s)
    rows_of = (docs if "buckets" in docs.columns else bucketed(docs, s)).select("buckets")
    for turn in range(s.rounds):
        sent = spark.sparkContext.broadcast(flat(now))

        def learn(batches: Iterator[pa.RecordBatch], turn: int = turn, sent=sent) -> Iterator[pa.RecordBatch]:
            descent, seen, contexts_held, targets_held, held = Descent(shaped(sent.value, s), s), 0, [], [], 0
            for _, owner, bucket in bucket_slices(batches):
                own = np.arange(turn, len(bucket), s.rounds)
                if not len(own):
                    continue
                order = own[np.argsort(own * 0x9E3779B1 & 0xFFFFFF, kind="stable")]  # neighbours in one batch say the same
                contexts_held.append(contexts(owner, bucket, s)[order])
                targets_held.append(bucket[order])
                held += len(order)
                while held >= s.batch:
                    context, target = np.concatenate(contexts_held), np.concatenate(targets_held)
                    descent.step(context[: s.batch], target[: s.batch])
                    seen += s.batch
                    contexts_held, targets_held, held = [context[s.batch :]], [target[s.batch :]], held - s.batch
            if held:
                descent.step(np.concatenate(contexts_held), np.concatenate(targets_held))
                seen += held
            if seen:
                values = flat(descent.p)
                blocks = [values[i : i + s.block].astype(np.float64) for i in range(0, len(values), s.block)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([float(seen)] * len(blocks)), pa.array(blocks, pa.list_(pa.float64()))], names=["block", "weight", "part"])

        parts = rows_of.mapInArrow(learn, "block int, weight double, part array<double>")
        vectors = parts.select("block", "weight", array_to_vector("part").alias("part"))
        means = vectors.groupBy("block").agg(Summarizer.mean(F.col("part"), F.col("weight")).alias("mean")).select("block", vector_to_array("mean").alias("mean"))
        rows = sorted(means.collect(), key=lambda r: r["block"])  # as many rows as the network has blocks
        if rows:
            now = shaped(np.concatenate([np.array(r["mean"]) for r in rows]), s)
        sent.unpersist()
    return now


def score(docs: DataFrame, parameters: Parameters, s: Setting = Setting()) -> DataFrame:
    """doc_id, n_words, log_probability (the sum over all words), per_word of every whole text; `docs` as for train().

    Null and empty texts have no words, 0.0 and a null per_word. Rows that repeat are scored each; a null doc_id stays null;
    other columns are not read; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(flat(parameters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shaped(sent.value, s)
        for batch, owner, bucket in bucket_slices(batches):
            context = contexts(owner, bucket, s)
            logs = np.zeros(len(bucket), np.float64)
            for i in range(0, len(bucket), 1024):  # few enough to stay in a core's cache
                logs[i : i + 1024] = log_probabilities(p, context[i : i + 1024], bucket[i : i + 1024], s)
            n = np.bincount(owner, minlength=batch.num_rows)
            total = np.bincount(owner, logs, batch.num_rows).astype(np.float64)  # whole numbers where there are no words
            mean = total / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(total), pa.array(mean, mask=n == 0)], names=["doc_id", "n_words", "log_probability", "per_word"])

    rows = docs if "buckets" in docs.columns else bucketed(docs, s)
    return rows.select("doc_id", "buckets").mapInArrow(run, "doc_id long, n_words long, log_probability double, per_word double")


def scored_documents(docs: DataFrame, s: Setting = Setting()) -> DataFrame:
    """Learns from all documents and scores all of them; texts are cut into words once, for all rounds and the scores."""
    rows = materialise(bucketed(docs, s))
    return score(rows, train(rows, s), s)
