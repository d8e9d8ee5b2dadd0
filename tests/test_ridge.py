"""The one-pass multi-task fit against a fit per task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import ridge
from postlens.plans.training import LinearTasks, fit_linear_tasks


def plain(x, y, penalty):
    known = ~np.isnan(y)
    x, y = x[known], y[known]
    c = (x - x.mean(0)).T @ (x - x.mean(0)) / len(x)
    b = np.linalg.solve(c + penalty * np.diag(np.diag(c)), (x - x.mean(0)).T @ (y - y.mean()) / len(x))
    return len(x), y.mean() - x.mean(0) @ b, b


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 6)) + 1e5  # means far from zero
    y = np.column_stack([x @ rng.normal(size=6) + rng.normal(size=500) for _ in range(4)])
    y[rng.random(y.shape) < 0.3] = np.nan
    rows = [(i, a.tolist(), *[None if np.isnan(v) else float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "note_id int, features array<double>, y0 double, y1 double, y2 double, y3 double").repartition(7)


@pytest.mark.parametrize("held", [16, 1])
@pytest.mark.parametrize("penalty", [0.0, 0.01, 5.0])
def test_each_task_as_if_alone(data, held, penalty, monkeypatch):
    monkeypatch.setattr(ridge, "TABLES_HELD", held)
    x, y, rows = data
    got = {r["task"]: r for r in ridge.fit_ridge(rows, "features", {f"t{i}": f"y{i}" for i in range(4)}, penalty).collect()}
    for i in range(4):
        n, intercept, b = plain(x, y[:, i], penalty)
        assert got[f"t{i}"]["n"] == n and np.allclose(got[f"t{i}"]["coefficients"], b, rtol=1e-6, atol=1e-9)
        assert np.isclose(got[f"t{i}"]["intercept"], intercept, rtol=1e-6)


def test_reads_once_and_folds_before_the_shuffle(data):
    plan = ridge.centred_sums(data[2], "features", ["y0", "y1"])._jdf.queryExecution().executedPlan().toString()
    first = plan.index("MapInArrow", plan.rindex("Exchange hashpartitioning"))  # below the last shuffle stands the fold
    assert plan.count("Scan") == 1 and first > 0


def test_odd_rows(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 3.0], 1.0, None), (2, [2.0, 3.0], 2.0, None), (3, [3.0, 3.0], float("nan"), None), (4, None, 9.0, 1.0), (5, [4.0, 3.0], 4.0, None)],
        "note_id int, features array<double>, a double, b double")
    got = ridge.fit_ridge(rows, "features", {"a": "a", "b": "b", "absent": "c"}, 0.0).collect()
    assert [(r["task"], r["n"]) for r in got] == [("a", 3)]
    assert np.allclose(got[0]["coefficients"], [1.0, 0.0]) and abs(got[0]["intercept"]) < 1e-9
    scored = {r["note_id"]: r["a_raw"] for r in ridge.predict(rows, "features", ridge.fit_ridge(rows, "features", {"a": "a"}, 0.0)).collect()}
    assert scored[4] is None and np.isclose(scored[3], 3.0)
    assert ridge.fit_ridge(rows.limit(0), "features", {"a": "a"}).collect() == []
    one = ridge.fit_ridge(rows.limit(1), "features", {"a": "a"}).head()
    assert one["coefficients"] == [0.0, 0.0] and one["intercept"] == 1.0


def test_saved_models_score_alike(spark, data, tmp_path):
    rows = data[2].select("note_id", "features", F.col("y0").alias("ctr"), F.abs("y1").alias("impression_log"))
    from postlens.operators.targets import task_columns

    tasks = ["ctr", "impression"]
    rows = rows.withColumnRenamed("impression_log", task_columns(tasks)["impression"])
    models = fit_linear_tasks(rows, tasks)
    models.save(str(tmp_path / "m"))
    again = LinearTasks.load(spark, str(tmp_path / "m"))
    a, b = (sorted(map(str, m.score(rows).collect())) for m in (models, again))
    assert a == b and len(a) == 2 * 500
    wide = {r["note_id"]: r["ctr_pred"] for r in again.wide(rows).collect()}
    long = {r["note_id"]: r["y_pred"] for r in models.score(rows).where("task = 'ctr'").collect()}
    assert all(np.isclose(wide[k], v) for k, v in long.items())
    assert "Exchange" not in again.wide(rows.coalesce(3))._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
