import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from postlens.plans import ablation as ab
from postlens.plans import training as tr


@pytest.fixture(scope="module")
def rows(spark):
    x = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0).alias(f"x{i}") for i in range(4)]
    posts = spark.range(600).select(F.col("id").cast("string").alias("note_id"), *x)
    return posts.select("note_id", F.array("x0", "x1").alias("image_vec"), F.array("x2", "x3").alias("text_vec"), (F.col("x0") + F.col("x2") / 4).alias("ctr")).cache()


def test_contributions_fit_only_what_they_read(rows, spark, monkeypatch, sf_dir):
    from postlens.catalog import models

    fits = []
    monkeypatch.setattr(ab, "forest", lambda *a, f=ab.forest: fits.append(1) or f(3, 2))
    monkeypatch.setattr(models, "evaluation_rows", lambda *_: rows)
    got = {r["feature_group"]: r for r in models.contributions(spark, sf_dir).collect()}
    assert len(fits) == 3
    whole = {r["feature_group"]: r for r in ab.contributions(ab.ablation(rows)).collect()}
    assert len(fits) == 3 + 7 * 6 and got == whole and set(got) == {"image_features", "text_features"}


def test_models_are_measured_together(rows, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    calls = []
    monkeypatch.setattr(tr, "kendall_tau", lambda *a, f=tr.kendall_tau, **k: calls.append(1) or f(*a, **k))
    kept = rows.select("ctr", array_to_vector(F.concat("image_vec", "text_vec")).alias("features"), (F.col("note_id") % 5 == 0).alias("test"))
    models = {"plain": LinearRegression(regParam=0.0), "none": LinearRegression(loss="huber", regParam=1.0, elasticNetParam=0.5), "flat": LinearRegression(regParam=100.0)}
    scores, ranking = tr.compare_models(kept.where("NOT test"), kept.where("test"), "ctr", models)
    got = {r["model"]: r for r in scores.collect()}
    assert list(got) == list(models) and len(calls) == 1
    assert got["plain"]["r2"] == pytest.approx(1) and got["plain"]["kendall_tau"] == pytest.approx(1, abs=0.01) and got["flat"]["r2"] < 0.5
    assert got["none"]["error"] and got["none"]["r2"] is None and got["plain"]["error"] is None
    assert {r["model"] for r in ranking.collect()} == {"plain", "flat"}
