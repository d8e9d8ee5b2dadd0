"""FTRL against a plain loop, held-out accuracy, and what a score may depend on."""

import collections
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postlens.llm import toxicity
from tests.llm.test_lexical_search import split


def plain_features(text):
    w = split(text)
    return set(w) | {(d, w[i], w[i + d]) for d in toxicity.DISTANCES for i in range(len(w) - d)}


def test_distinct_features():
    texts = ["a b a b", "", "A, b! c", "x", "a b c d e a b c", "été É"]
    counts, hashed = toxicity.distinct_features(pa.array(texts, pa.large_string()))
    assert counts.tolist() == [len(plain_features(t)) for t in texts]
    at, seen = 0, collections.defaultdict(set)
    for t, n in zip(texts, counts.tolist(), strict=True):
        seen[frozenset(plain_features(t))].add(tuple(hashed[at : at + n].tolist()))
        at += n
    assert all(len(x) == 1 for x in seen.values())
    assert len(set(hashed.tolist())) == len(set().union(*map(plain_features, texts)))


def plain_ftrl(documents, labels, rates):
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    times = collections.Counter(f for d in documents for f in d)
    documents = [[f for f in d if times[f] >= rates.least] + ["bias"] for d in documents]
    def weight(f):
        l1, l2 = (0, 0) if f == "bias" else (rates.l1, rates.l2)
        return 0.0 if abs(z[f]) <= l1 else (np.sign(z[f]) * l1 - z[f]) / ((rates.beta + n[f] ** 0.5) / rates.alpha + l2)
    for _ in range(rates.epochs):
        for d, y in zip(documents, labels, strict=True):
            w = {f: weight(f) for f in d}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for f in d:
                sigma = ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / rates.alpha
                z[f] += g - sigma * w[f]
                n[f] += g * g
    return {f: w for f in times if (w := weight(f))}, weight("bias")


def test_ftrl_steps():
    rng = np.random.default_rng(3)
    documents = [np.flatnonzero(rng.random(60) < 0.2).tolist() for _ in range(150)]
    labels = [int(7 in d or (3 in d and 5 in d)) for d in documents]
    for rates in (toxicity.Rates(l1=0.2), toxicity.Rates(l1=1.0, least=40), toxicity.Rates()):
        got = toxicity.train(np.array([len(d) for d in documents]), np.concatenate(documents).astype(np.uint32), np.array(labels), rates)
        want, bias = plain_ftrl(documents, labels, rates)
        assert dict(zip(got.features.tolist(), got.values.tolist(), strict=True)).keys() == want.keys()
        assert np.allclose(got.values, [want[f] for f in got.features.tolist()]) and np.isclose(got.bias, bias)


def made(spark, n=1500):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        w = rng.choice(words, rng.integers(5, 60)).tolist()
        toxic = int(rng.random() < 0.2)
        if toxic:
            w[int(rng.integers(len(w)))] = str(rng.choice(["vile", "Vile", "nasty!"]))
        rows.append((i, " ".join(w), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int"), rows


def test_held_out_accuracy(spark):
    docs, rows = made(spark)
    labels = docs.select("doc_id", "toxic").withColumn("quality", F.lit(1))
    truth = {i: t for i, _, t in rows}
    for most_rows, chunk_rows in ((toxicity.MOST_ROWS, toxicity.CHUNK_ROWS), (700, 200)):
        weights = toxicity.fit(docs.drop("toxic"), labels.where(~toxicity.held_out()), most_rows, chunk_rows)
        assert 2 <= len(weights.features) < 60
        got = toxicity.predict(docs, weights).collect()
        held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
        assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98 and len(held) > 200
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_labels_of_held_out_documents_are_not_learned(spark):
    docs, rows = made(spark, 600)
    labels = docs.select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity_of_documents(docs.drop("toxic"), x).collect())) for x in (labels, turned))
    assert a == b


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(14)] + [(3, 0, "x"), (4, None, "x"), (None, 1, "x"), (14, 1, "x"), (99, 1, "x")], "doc_id long, toxic int, score string")
    got = toxicity.toxicity_of_documents(odd_docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == odd_docs.count()
    empty = {r.score for r in got.where("doc_id IN (0, 1)").collect()}
    assert len(empty) == 1
    assert {r.score for r in toxicity.toxicity_of_documents(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity_of_documents(no_docs, labels).collect() == []
    copies = odd_docs.unionAll(odd_docs.where("doc_id = 14"))
    a, b = (toxicity.fit(d, labels) for d in (odd_docs, copies))
    assert np.array_equal(a.features, b.features) and np.array_equal(a.values, b.values) and a.bias == b.bias
