import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from postlens.operators import encoding, sampling
from postlens.operators.projection import CentredPca, fit_pca
from postlens.plans.training import FeatureModel, FeatureSpec, TaskModels, batch_scores, fit_features, fit_tasks


def test_codes_are_dense_sorted_and_cover_nulls(spark):
    df = spark.createDataFrame([("b",), ("B",), (None,), ("é",), ("a",), ("b",)], "c string")
    codes = {r["value"]: r["code"] for r in encoding.fit_vocabulary(df, ["c"]).collect()}
    assert codes == {v: i for i, v in enumerate(sorted(["b", "B", "missing", "é", "a"], key=lambda s: s.encode()))}


def test_unseen_policies(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    vocab = encoding.fit_vocabulary(train, ["c"])
    zero = sorted(r["c_code"] for r in encoding.encode(test, vocab, ["c"]).collect())
    own = sorted(r["c_code"] for r in encoding.encode(test, vocab, ["c"], unseen="reserve").collect())
    assert zero == [0, 0, 1] and own == [1, 2, 2]
    with pytest.raises(ValueError):
        encoding.encode(test, vocab, ["c"], unseen="guess")


def test_constant_and_empty_columns_scale_by_one(spark):
    df = spark.createDataFrame([(3.0, None), (3.0, None)], "a double, b double")
    fit = {r["feature"]: (r["center"], r["scale"]) for r in encoding.fit_scaler(df, ["a", "b"]).collect()}
    assert fit == {"a": (3.0, 1.0), "b": (0.0, 1.0)}
    assert [r["a"] for r in encoding.scale(df, encoding.fit_scaler(df, ["a", "b"]), ["a", "b"]).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_inverse_undoes_normalisation(spark, method):
    values = [0.1, 0.4, 0.4, 0.9, 3.0]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(values)], "note_id int, ctr double, fav_rate double")
    tasks = {"ctr": "ctr", "fav_rate": "fav_rate", "gone": "gone"}
    stats = encoding.fit_labels(df, tasks, method)
    normal = encoding.normalise_labels(df, stats, tasks)
    lines = normal.select("note_id", F.lit("ctr").alias("task"), F.col("ctr_norm").alias("y_pred"))
    back = {r["note_id"]: r["y_pred"] for r in encoding.denormalise(lines, stats).collect()}
    assert all(back[i] == pytest.approx(v) for i, v in enumerate(values))
    assert {(r["fav_rate_norm"], r["gone_norm"]) for r in normal.collect()} == {(0.0, 0.0)}


def test_unfitted_task_passes_through(spark):
    df = spark.createDataFrame([(1, 0.5)], "note_id int, ctr double")
    stats = encoding.fit_labels(df, {"ctr": "ctr"})
    lines = spark.createDataFrame([("other", 7.0)], "task string, y_pred double")
    assert encoding.denormalise(lines, stats).head()["y_pred"] == 7.0
    with pytest.raises(ValueError):
        encoding.fit_labels(df, {"ctr": "ctr"}, "cubic")


def test_split_does_not_depend_on_order(spark):
    ids = [str(i) for i in range(300)]
    a = spark.createDataFrame([(i,) for i in ids], "note_id string")
    b = spark.createDataFrame([(i,) for i in reversed(ids)], "note_id string").repartition(7)
    pick = lambda df: {r["note_id"]: r["split"] for r in sampling.split(df, "note_id", 0.2, 0.1).collect()}
    assert pick(a) == pick(b) and set(pick(a).values()) == {"train", "val", "test"}


@pytest.mark.parametrize("most", [0, 1, 37, 999, 1000, 5000])
def test_both_sampling_paths_agree(spark, most):
    df = spark.range(1000).select(F.col("id").cast("string").alias("note_id"))
    short = {r[0] for r in sampling.hash_sample(df, "note_id", most, direct=10**6).collect()}
    long = {r[0] for r in sampling.hash_sample(df, "note_id", most, direct=-1).collect()}
    assert short == long and len(short) == min(most, 1000)


def vectors(spark, n=120, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 5
    rows = [
        (str(i), ["p", "q", "r"][i % 3], float(i % 7), [float(v) for v in x[i]], float(0.3 * x[i, 0] + 0.01 * (i % 3)), float(x[i, 1]))
        for i in range(n)]
    return x, spark.createDataFrame(
        rows, "note_id string, cat string, title_length double, v array<double>, ctr double, impression_log double")


def test_pca_is_centred_with_fixed_signs(spark, tmp_path):
    x, df = vectors(spark)
    pca = fit_pca(df, "v", 3)
    got = np.array([r["p"] for r in pca.transform(df, "v", "p").orderBy(F.col("note_id").cast("int")).collect()])
    assert np.allclose(got.mean(axis=0), 0, atol=1e-9)
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    vt = vt[:3] * np.array([1 if r[abs(r).argmax()] >= 0 else -1 for r in vt[:3]])[:, None]
    assert np.allclose(got, (x - x.mean(axis=0)) @ vt.T, atol=1e-6)
    pca.save(str(tmp_path / "pca"))
    again = CentredPca.load(spark, str(tmp_path / "pca")).transform(df, "v", "p").orderBy(F.col("note_id").cast("int"))
    assert np.allclose([r["p"] for r in again.collect()], got)


@pytest.mark.parametrize("order", ["first", "scaled"])
def test_features_keep_rows_and_survive_saving(spark, tmp_path, order):
    x, df = vectors(spark)
    spec = FeatureSpec(["cat", "absent"], ["title_length"], {"v": 6}, pca=4, pca_order=order)
    model = fit_features(df, spec)
    out = model.transform(df).select("note_id", vector_to_array("features").alias("f")).collect()
    assert len(out) == 120 and {len(r["f"]) for r in out} == {2 + 1 + 4}
    model.save(str(tmp_path / "features"))
    loaded = FeatureModel.load(spark, str(tmp_path / "features"))
    again = {r["note_id"]: r["f"] for r in loaded.transform(df).select("note_id", vector_to_array("features").alias("f")).collect()}
    assert all(np.allclose(again[r["note_id"]], r["f"]) for r in out)
    bare = loaded.transform(df.select("note_id")).select(vector_to_array("features").alias("f"))
    assert bare.count() == 120


def test_task_models_predict_in_label_units(spark, tmp_path):
    from pyspark.ml.regression import LinearRegressionModel

    x, df = vectors(spark)
    prepared = fit_features(df, FeatureSpec([], ["title_length"], {"v": 6})).transform(df)
    models = fit_tasks(prepared, ["ctr", "impression"])
    models.save(str(tmp_path / "m"))
    models = TaskModels.load(spark, str(tmp_path / "m"), ["ctr", "impression"], LinearRegressionModel)
    scored = models.score(prepared)
    for r in scored.collect():
        assert r["y_pred"] == pytest.approx(r["y_true"], abs=0.2)
    wide = batch_scores(scored, ["ctr", "impression"]).head()
    assert wide["impression_pred"] > 0 and not math.isnan(wide["ctr_pred"])
