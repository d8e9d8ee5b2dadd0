"""K-means of several numbers of clusters and starts trained together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import sweep
from postlens.operators.folding import sum_arrays


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 5)) * 8
    x = np.concatenate([c + rng.normal(size=(80, 5)) for c in centers])
    return x, spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(x)], "note_id string, v array<double>").repartition(5)


def test_sums_of_arrays(spark):
    rng = np.random.default_rng(1)
    keys, values = rng.integers(0, 9, 500), rng.normal(size=(500, 4))
    parts = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, values, strict=True)], "key long, sums array<double>").repartition(6)
    got = {r["key"]: r["sums"] for r in sum_arrays(parts).collect()}
    assert set(got) == set(keys.tolist()) and all(np.allclose(s, values[keys == k].sum(0)) for k, s in got.items())
    assert sum_arrays(parts.limit(0)).collect() == []


def test_one_pass_equals_a_plain_one(planted):
    x, rows = planted
    models = [x[:3].copy(), x[10:17].copy()]
    both = list(zip(models * 2, sweep._pass(rows, models) + sweep._pass(rows, models, 5), strict=True))
    for centers, sums in both:
        far = ((x[:, None] - centers[None]) ** 2).sum(2)
        near = far.argmin(1)
        for c in range(len(centers)):
            assert sums[c, 0] == (near == c).sum() and np.allclose(sums[c, 1], far[near == c, c].sum()) and np.allclose(sums[c, 2:], x[near == c].sum(0))


def test_finds_the_planted_clusters_for_any_layout(planted):
    x, rows = planted
    models = sweep.train_sweep(rows, "note_id", "v", [3, 6, 12, 480, 1], starts=4, tolerance=0.0)
    assert [m.k for m in models] == [3, 6, 12]
    costs = [m.cost for m in models]
    assert costs[0] > costs[1] > costs[2]
    label = models[1].nearest(x)
    assert all(len(set(label[i : i + 80].tolist())) == 1 for i in range(0, 480, 80)) and len(set(label.tolist())) == 6
    means = np.array([x[label == c].mean(0) for c in range(6)])
    assert np.allclose(means, models[1].centers) and np.isclose(costs[1], ((x - means[label]) ** 2).sum())
    again = sweep.train_sweep(rows.coalesce(1), "note_id", "v", [3, 6, 12], starts=4, tolerance=0.0)
    assert np.allclose([m.cost for m in again], costs)


def test_small_groups_of_models_give_the_same(planted, monkeypatch):
    _, rows = planted
    a = sweep.train_sweep(rows, "note_id", "v", [4, 7], starts=3)
    monkeypatch.setattr(sweep, "MOST_BYTES", 300)
    b = sweep.train_sweep(rows, "note_id", "v", [4, 7], starts=3)
    assert all(np.allclose(p.centers, q.centers) for p, q in zip(a, b, strict=True))


def test_odd_rows(spark):
    rows = spark.createDataFrame([("a", [1.0, 1.0]), ("a", [1.0, 1.0]), ("b", [1.0, 1.0]), ("c", None), ("d", [5.0, 5.0])], "note_id string, v array<double>")
    models = sweep.train_sweep(rows, "note_id", "v", [2, 3, 4])
    assert [(m.k, round(m.cost, 9)) for m in models] == [(2, 0.0), (3, 0.0)]
    labels = {r["note_id"]: r["clusters"] for r in sweep.assign(rows, "v", models).collect()}
    assert labels["c"] is None and labels["a"] == labels["b"] != labels["d"]
    assert sweep.train_sweep(rows.where(F.lit(False)), "note_id", "v", [2]) == []


def test_silhouettes_against_a_plain_loop():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    x[:5] = x[0]
    models = [sweep.Clusters(4, 0, x[[0, 10, 20, 30]], 0.0), sweep.Clusters(2, 0, np.array([x[0], x[0] + 1e6]), 0.0)]
    got = sweep.sample_silhouettes(x, models)
    label, total = models[0].nearest(x), 0.0
    for i in range(60):
        far = np.linalg.norm(x - x[i], axis=1)
        own = (label == label[i]).sum()
        a = far[label == label[i]].sum() / max(own - 1, 1)
        b = min(far[label == c].mean() for c in set(label.tolist()) - {label[i]})
        total += (b - a) / max(a, b) if own > 1 else 0
    assert got[0] == pytest.approx(total / 60) and got[1] is None
