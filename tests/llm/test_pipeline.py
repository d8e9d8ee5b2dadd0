"""The pipeline against plain versions of its stages, each on what its predecessor kept."""

import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import texts_of
from tests.llm.test_near_dup import plain as plain_near
from tests.llm.test_text_models import plain_counts
from tests.llm.test_tokens import check_packing


def accepted(text):
    n, chars, symbols, dup, repeat = plain_counts(text)
    lines = sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in (text or "").split("\n"))
    return n >= 10 and 100 * repeat <= 20 * n and 10 * symbols <= n and 100 * dup <= 30 * lines and 2 * n <= chars <= 25 * n


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_stages(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = dict(texts_of(spark, sf_dir))
    steps = [
        lambda have: {k for k, t in have.items() if any(c.isalpha() for c in t or "")},
        lambda have: {k for k, t in have.items() if accepted(t)},
        lambda have: {k for k, (_, root) in plain_near(list(have.items()), 5).items() if k == root},
        lambda have: {k for k, t in have.items() if not any(b in t for b in items)},
    ]
    for (_, stage), step in zip(pipeline.STAGES[:-1], steps, strict=True):
        docs = stage(spark, docs, sf_dir).checkpoint()
        keep = step(want)
        want = {k: t for k, t in want.items() if k in keep}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r.doc_id: r.text for r in docs.collect()} == want
    check_packing(pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), list(want.items()))
    check_packing(pipeline.run(spark, sf_dir).collect(), list(want.items()))


def test_odd_rows_pass_through_every_stage(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        before = docs.count()
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf_dir).checkpoint()
            if name != "packing":
                assert out.columns == docs.columns
                assert out.count() <= before
            docs, before = (out, out.count()) if name != "packing" else (docs, before)
        assert (out.count() > 0) == (before > 0)
    kept = odd_docs
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
    assert 400 in {r.doc_id for r in kept.select("doc_id").collect()}


def test_language_stage_rejects_by_its_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dice = random.Random(1)
    noise = [(-1 - i, "".join(dice.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)), None, None, n) for i, n in enumerate((200, 1000, 3000))]
    noise += [(-10, "Κάθε άνθρωπος γεννιέται ελεύθερος και ίσος στην αξιοπρέπεια και τα δικαιώματα", None, None, 1), (-11, "12 34", None, None, 1)]
    words = docs.where("doc_id < 20").select((F.col("doc_id") + 10_000).alias("doc_id"), F.substring("text", 1, 80).alias("text"), F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    mixed = docs.unionByName(spark.createDataFrame(noise, docs.schema)).unionByName(words)
    kept = {r.doc_id for r in pipeline.with_language(spark, mixed, sf_dir).select("doc_id").collect()}
    assert kept == {r.doc_id for r in mixed.where("doc_id >= 0").select("doc_id").collect()}
    unlabelled = mixed.withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.with_language(spark, unlabelled, sf_dir).count() == mixed.count() - 1


def test_repeated_rows_and_null_ids(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    a, b = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta"))
    rows = [(1, a, 7), (1, a, 8), (1, b, 9), (None, a, 1), (None, b + " end", 2), (None, None, 3), (None, None, 4), (5, None, 5), (None, f"before {item} after", 6), (2, "before and after", 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _given_id int")
    kept = pipeline.without_near_copies(spark, docs.where("text IS NULL OR text NOT LIKE 'beta%' OR doc_id IS NULL"), sf_dir)
    assert kept.columns == docs.columns
    seen = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = [(1, a), (None, b + " end"), (None, None), (None, None), (5, None), (None, f"before {item} after"), (2, "before and after")]
    assert seen == sorted(want, key=str)
    clean = pipeline.without_leaks(spark, docs, sf_dir)
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r._given_id) for r in clean.collect()), key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
