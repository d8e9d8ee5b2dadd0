"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import text_slices

BUCKETS, ORDERS, SMOOTHING, MOST_LANGUAGES, UNKNOWN = 1 << 15, (1, 2, 3), 0.5, 512, "und"


@dataclass(frozen=True)
class Model:
    """Languages in order, and per bucket and language the log probability: of bounded size."""

    languages: list[str]
    prior: np.ndarray  # float64 by language
    weights: np.ndarray  # float32, buckets x languages


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """By code point: that of the lower-case letter, 0 for all else."""
    codes = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            codes[i] = ord(low) if len(low) == 1 else i
    return codes


def grams(texts: pa.Array, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram in whole texts, by order, then text, and which texts have a letter.

    Runs of other characters count as one space. An n-gram lies within a text and has a letter."""
    strings = texts.to_pylist()
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = letter_codes()[points]
    owner = np.repeat(np.arange(len(strings)), np.fromiter(map(len, strings), np.int64, len(strings)))
    kept = np.ones(len(codes), bool)
    kept[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
    codes, owner = codes[kept], owner[kept]
    lettered = np.zeros(len(strings), bool)
    lettered[owner[codes != 0]] = True
    owners, found = [], []
    for n in orders:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF), np.uint32)
        letter = np.zeros(m, bool)
        for j in range(n):
            part = codes[j : j + m]
            h = (h ^ part) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            letter |= part != 0
        letter &= owner[:m] == owner[n - 1 :]
        owners.append(owner[:m][letter])
        found.append((h[letter] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - buckets.bit_length() + 1))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lettered
    return np.concatenate(owners), np.concatenate(found).astype(np.int64), lettered


def fit(labelled: DataFrame, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, smoothing: float = SMOOTHING, most_languages: int = MOST_LANGUAGES) -> Model:
    """Counts n-grams by language over all rows of `labelled` (text, lang) and turns them into log probabilities.

    A task sends one sum per language and bucket; the sums that reach the driver are at most most_languages x buckets
    (more languages raise). Rows without a language or text are left out; no rows give a model of no languages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch, texts in text_slices(batches, limit=1 << 20):
            langs = np.array(batch.column("lang").to_pylist(), object)
            owner, bucket, _ = grams(texts, buckets, orders)
            for lang in set(langs.tolist()):
                own = langs == lang
                sums.setdefault(lang, np.zeros(buckets, np.int64))
                sums[lang] += np.bincount(bucket[own[owner]], minlength=buckets)
                docs[lang] = docs.get(lang, 0) + int(own.sum())
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(used) + 1)), pa.array(np.append(used, -1)), pa.array(np.append(total[used], docs[lang]))], names=["lang", "bucket", "n"]
            )

    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    totals = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = totals.limit(most_languages * (buckets + 1) + 1).toArrow()
    if table.num_rows > most_languages * (buckets + 1):
        raise ValueError(f"more than {most_languages} languages")
    langs = np.array(table.column("lang").to_pylist(), object)
    bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    languages = sorted(set(langs.tolist()))
    place = {x: i for i, x in enumerate(languages)}
    row = np.fromiter((place[x] for x in langs), np.int64, len(langs))
    counts, docs = np.zeros((buckets, len(languages))), np.zeros(len(languages))
    head = bucket < 0
    docs[row[head]] = n[head]
    counts[bucket[~head], row[~head]] = n[~head]
    weights = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * buckets)
    return Model(languages, np.log(docs / max(docs.sum(), 1)) if languages else docs, weights.astype(np.float32))


def log_scores(texts: pa.Array, model: Model, buckets: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Log joint probability by text and language (the sparse row of a text's n-grams times the matrix), and which
    texts have a letter."""
    owner, bucket, lettered = grams(texts, buckets, orders)
    scores = np.tile(model.prior, (len(texts), 1))
    for i in range(0, len(owner), 1 << 18):
        o = owner[i : i + (1 << 18)]
        first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        np.add.at(scores, o[first], np.add.reduceat(model.weights[bucket[i : i + (1 << 18)]].astype(np.float64), first, axis=0))
    return scores, lettered


def predict(docs: DataFrame, model: Model, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, per_gram: bool = False) -> DataFrame:
    """docs with lang_pred and score, the posterior probability of the predicted language; only text is read for them.

    Null texts and texts without a letter are UNKNOWN with score 0, as is all text under a model of no languages. Equal
    scores go to the first language in order. Columns named lang_pred or score are replaced. Rows that repeat are
    scored each; an empty table gives no rows.

    per_gram adds _grams, the number of a text's n-grams, and _log_gram, the mean log probability of one under the
    predicted language (null without n-grams or languages)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = docs.schema
    columns = docs.columns
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if per_gram:
        added += [T.StructField("_grams", T.LongType()), T.StructField("_log_gram", T.DoubleType())]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch, texts in text_slices(batches, limit=1 << 20):
            best, sure = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            n, mean = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, np.nan)
            if per_gram:
                n = np.bincount(grams(texts, buckets, orders)[0], minlength=batch.num_rows)
            if known.languages:
                scores, lettered = log_scores(texts, known, buckets, orders)
                top = scores.argmax(axis=1)
                posterior = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
                best = [known.languages[t] if x else UNKNOWN for t, x in zip(top.tolist(), lettered.tolist(), strict=True)]
                sure = np.where(lettered, posterior, 0.0)
                mean = np.where(n > 0, (scores.max(axis=1) - known.prior[top]) / np.maximum(n, 1), np.nan)
            out = [pa.array(best, pa.string()), pa.array(sure), pa.array(n, pa.int64()), pa.array(mean, from_pandas=True)][: len(added)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *out], names=[*columns, *(f.name for f in added)])

    return docs.mapInArrow(score, T.StructType([*schema.fields, *added]))


def gram_deviation(model: Model) -> np.ndarray:
    """By language: the standard deviation of the log probability of an n-gram."""
    w = model.weights.astype(np.float64)
    p = np.exp(w)
    return np.sqrt(np.maximum((p * w * w).sum(axis=0) - (p * w).sum(axis=0) ** 2, 0))


def held_out():
    """True for the documents that a model must not learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from documents that are not held out."""
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
