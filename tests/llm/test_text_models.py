"""Quality cascade, language identification and pseudo-likelihood."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postlens.llm import language_id, lm_scoring, quality_cascade
from tests.llm.conftest import texts_of


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    texts = dict(texts_of(spark, sf_dir))
    texts |= {-1: "a b c d e a b c d e f", -2: "x\nx\n \n\nx\ty\nx\ty", -3: "a a a a a a a"}
    more = spark.createDataFrame([(k, texts[k]) for k in (-1, -2, -3)], "doc_id long, text string")
    rows = quality_cascade.measure_documents(docs.select("doc_id", "text").unionByName(more)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        n, chars, symbols, dup, repeat = counts
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        lines = sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in (texts[r.doc_id] or "").split("\n"))
        assert r.kept == (not r.base_failed and not (10 * symbols > n or 100 * dup > 30 * lines or not 2 * n <= chars <= 25 * n))
        if labels.get(r.doc_id) == 1 and not r.base_failed:
            assert r.kept
    assert quality_cascade.measure_documents(odd_docs).count() == odd_docs.count()
    assert quality_cascade.measure_documents(no_docs).count() == 0


def test_cascade_order_and_short_circuit(spark, odd_docs, no_docs):
    ran = []
    rule = lambda name, out: quality_cascade.Rule(name, lambda t: ran.append(name) or out)
    rules = (rule("dear", True), rule("cheap", True), rule("idle", False))
    ordered = quality_cascade.order_rules([("dear", 1e-3, 0.9), ("cheap", 1e-6, 0.3), ("idle", 1e-6, 0.0)], rules)
    assert [r.name for r in ordered] == ["cheap", "dear", "idle"]
    assert quality_cascade.verdict(quality_cascade.Text("x"), ordered) == "cheap" and ran == ["cheap"]
    estimates = quality_cascade.estimate(odd_docs)
    assert {e[0] for e in estimates} == {r.name for r in quality_cascade.RULES} and all(cost > 0 and 0 <= share <= 1 for _, cost, share in estimates)
    a = {(r.doc_id, r.n_chars): r.rejected_by is None for r in quality_cascade.judge(odd_docs).collect()}
    b = {(r.doc_id, r.n_chars): r.rejected_by is None for r in quality_cascade.judge(odd_docs, ordered=quality_cascade.RULES[::-1]).collect()}
    assert a == b and len(a) < odd_docs.count() and a[(0, 0)] is False
    assert quality_cascade.judge(no_docs).count() == 0


def test_language_accuracy_and_columns(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language_id.language_of_documents(docs).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held if r.lang_pred != "und"]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)
    odd = language_id.language_of_documents(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    by = {r.doc_id: r for r in odd}
    assert by[0].lang_pred == by[1].lang_pred == by[6].lang_pred == "und" and by[6].score == 0.0 and by[7].lang_pred == "en"
    assert language_id.language_of_documents(no_docs).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.language_of_documents(unlabelled).collect()} == {"und"}


def test_language_model_counts_and_scores(spark):
    rows = [("ab Ab", "x"), ("ba b", "y"), (None, "x"), ("ab", None)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), buckets=1 << 10, orders=(1, 2))
    assert model.languages == ["x", "y"] and np.allclose(model.prior, np.log([0.5, 0.5]))
    counts = {lang: collections.Counter(language_id.grams(pa.array([text]), 1 << 10, (1, 2))[1].tolist()) for text, lang in rows[:2]}
    assert sum(counts["x"].values()) == 4 + 4 and sum(counts["y"].values()) == 3 + 3  # a b a b; ab, b_, _a, ab
    for i, lang in enumerate(("x", "y")):
        n = sum(counts[lang].values())
        want = np.log([(counts[lang][b] + 0.5) / (n + 0.5 * 1024) for b in range(1024)])
        assert np.allclose(model.weights[:, i], want, atol=1e-5)
    texts = pa.array(["abba", "b a\n\n!!a", "", "??"], pa.large_string())
    scores, lettered = language_id.log_scores(texts, model, 1 << 10, (1, 2))
    assert lettered.tolist() == [True, True, False, False]
    for i, text in enumerate(texts.to_pylist()):
        one = language_id.grams(pa.array([text]), 1 << 10, (1, 2))[1]
        assert np.allclose(scores[i], model.prior + model.weights[one].sum(axis=0), atol=1e-4)


def test_gradients():
    s = lm_scoring.Setting(radius=1, digits=3, embedding=2, hidden=4)
    rng = np.random.default_rng(0)
    p = [rng.standard_normal(x) for x in s.shapes]
    context, target = rng.integers(0, 10, (20, 2)), rng.integers(0, 9, 20)
    loss = lambda q: -lm_scoring.log_probabilities(q, context, target, s).mean()
    for i, g in enumerate(lm_scoring.gradients(p, context, target, s)):
        for place in list(np.ndindex(p[i].shape))[:6]:
            q = [x.copy() for x in p]
            q[i][place] += 1e-6
            up = loss(q)
            q[i][place] -= 2e-6
            assert abs((up - loss(q)) / 2e-6 - g[place]) < 1e-5


def test_probabilities_add_up_and_contexts():
    s = lm_scoring.Setting(radius=2, digits=4, embedding=2, hidden=3)
    p = lm_scoring.initial(s)
    every = np.arange(16)
    assert abs(np.exp(lm_scoring.log_probabilities(p, np.tile([1, 2, 3, 16], (16, 1)), every, s)).sum() - 1) < 1e-5
    owner, bucket = np.array([0, 0, 0, 2, 3, 3]), np.array([5, 6, 7, 8, 9, 10])
    assert lm_scoring.contexts(owner, bucket, s).tolist() == [[16, 16, 6, 7], [16, 5, 7, 16], [5, 6, 16, 16], [16] * 4, [16, 16, 10, 16], [16, 9, 16, 16]]


def test_scores(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    s = lm_scoring.Setting()
    p = lm_scoring.train(docs, s)
    small = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in lm_scoring.score(small, p, s).collect()}
    totals = {}
    for name, q in (("learned", p), ("initial", lm_scoring.initial(s))):
        total = 0.0
        for key, text in texts_of(spark, sf_dir)[:60]:
            owner, bucket = lm_scoring.sequences(pa.array([text or ""], pa.large_string()), s)
            logs = [float(lm_scoring.log_probabilities(q, lm_scoring.contexts(owner, bucket, s)[i : i + 1], bucket[i : i + 1], s)[0]) for i in range(len(bucket))]
            total += sum(logs)
            if name == "learned":
                assert got[key].n_words == len((text or "").split()) and abs(got[key].log_probability - sum(logs)) < 1e-3 * max(1, len(logs))
        totals[name] = total
    assert totals["learned"] > totals["initial"] * 0.95
    rows = lm_scoring.scored_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all((r.n_words == 0) == (r.per_word is None) and r.log_probability <= 0 for r in rows)
    assert lm_scoring.scored_documents(no_docs).count() == 0


def test_words_are_cut_once(spark):
    """Scores are those of rounds that each read the texts; a plan that learns and scores holds no texts."""
    from postlens.llm import lm_scoring as lm

    texts = [None, "", "one", "The cat sat on the mat " * 50, "naïve Café über " * 20, "x " * 600_000]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a b")], "doc_id long, text string").coalesce(1)
    both = [{(r["doc_id"], r["n_words"]): r["per_word"] for r in d.collect()} for d in (lm.scored_documents(docs), lm.score(docs, lm.train(docs)))]
    assert both[0] == both[1] and {k[1] for k in both[0]} == {0, 1, 300, 60, 600_000, 2}
    assert "text" not in lm.scored_documents(docs)._jdf.queryExecution().toString()
