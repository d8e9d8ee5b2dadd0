import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from postlens.functions.special import student_p
from postlens.operators.kendall import kendall_tau, ordered_pairs, small_groups
from postlens.operators.metrics import auc, spearman


def brute(x, y, w=None):
    w = np.ones(len(x)) if w is None else w
    c = d = 0.0
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            c += w[i] * w[j] * (s > 0)
            d += w[i] * w[j] * (s < 0)
    return c, d


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 4)), max_size=25))
def test_ordered_pairs(cells):
    a, b, w = (np.array([c[i] for c in cells], dtype=float) for i in range(3))
    assert ordered_pairs(a, b, w) == brute(a, b, w)


def frame(spark, seed, n=240):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, n).astype(float)
    x[: n // 3] = 7.0
    y = x * (rng.random(n) < 0.5) + rng.integers(0, 12, n)
    y[n // 2:] = np.where(rng.random(n - n // 2) < 0.4, 3.0, y[n // 2:])
    pdf = pd.DataFrame({"task": "t", "y_true": x, "y_pred": y})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("seed, blocks, cells", [(0, 128, 100000), (1, 6, 5), (2, 4, 2), (3, 5, 70)])
def test_blocks_do_not_change_the_count(spark, seed, blocks, cells):
    pdf, df = frame(spark, seed)
    got = kendall_tau(df, blocks=blocks, most_cells=cells).head()
    x, y = pdf["y_true"].to_numpy(), pdf["y_pred"].to_numpy()
    c, d = brute(x, y)
    assert (got["concordant"], got["discordant"]) == (c, d)
    n0 = len(x) * (len(x) - 1) / 2
    tx = sum(k * (k - 1) / 2 for k in pdf["y_true"].value_counts())
    ty = sum(k * (k - 1) / 2 for k in pdf["y_pred"].value_counts())
    assert got["kendall_tau"] == pytest.approx((c - d) / math.sqrt((n0 - tx) * (n0 - ty)))
    assert 0 <= got["kendall_p"] <= 1


def test_groups_get_small_over_several_rounds(spark):
    rng = np.random.default_rng(8)
    x, y = rng.permutation(6000) // 2, rng.permutation(6000) // 3
    y[:2000] = 5  # a hot value
    cells = spark.createDataFrame(pd.DataFrame({"task": "t", "a": x.astype(float), "b": y.astype(float)})).groupBy("task", "a", "b").count().withColumnRenamed("count", "w")
    parts = small_groups(cells, 4, 64)
    sizes = [p.groupBy("path").count().agg(F.max("count")).head()[0] for p in parts]
    assert len(parts) > 3 and all(n is None or n <= 64 for n in sizes)
    pdf = pd.concat([p.toPandas() for p in parts])
    got = [ordered_pairs(g["a"].to_numpy(), g["b"].to_numpy(), g["w"].to_numpy()) for _, g in pdf.groupby("path")]
    s = np.sign(x[:, None] - x[None, :]) * np.sign(y[:, None] - y[None, :])
    assert tuple(map(sum, zip(*got))) == ((s > 0).sum() // 2, (s < 0).sum() // 2)


def test_counts_beyond_64_bits():
    w = np.array([5 * 10**10, 4 * 10**10, 10**10])
    assert ordered_pairs(np.array([1.0, 2.0, 3.0]), np.array([1.0, 3.0, 2.0]), w) == (5 * 10**10 * 5 * 10**10, 4 * 10**10 * 10**10)


def test_order_extremes(spark):
    rows = [("up", float(i), float(i * i)) for i in range(1, 30)] + [("down", float(i), float(-i)) for i in range(30)]
    rows += [("flat", float(i), 1.0) for i in range(5)] + [("two", 1.0, 2.0), ("two", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "task string, y_true double, y_pred double")
    tau = {r["task"]: r["kendall_tau"] for r in kendall_tau(df, with_p=False).collect()}
    assert tau.pop("flat") is None
    assert tau == pytest.approx({"up": 1.0, "down": -1.0, "two": -1.0})
    rho = {r["task"]: r["spearman"] for r in spearman(df, with_p=False).collect()}
    assert rho["up"] == pytest.approx(1) and rho["down"] == pytest.approx(-1) and rho["flat"] is None


def test_spearman_matches_pandas(spark):
    pdf, df = frame(spark, 9)
    got = spearman(df).head()
    assert got["spearman"] == pytest.approx(pdf["y_true"].rank().corr(pdf["y_pred"].rank()))


def test_t_distribution():
    assert student_p(2.7764451051977987, 4) == pytest.approx(0.05, abs=1e-9)
    assert student_p(0.0, 7) == pytest.approx(1.0)
    rho, n = 0.8, 5
    assert student_p(rho * math.sqrt((n - 2) / (1 - rho**2)), n - 2) == pytest.approx(0.10409, abs=1e-5)


def test_auc_with_ties(spark):
    rows = [("t", 1, 0.9), ("t", 1, 0.5), ("t", 0, 0.5), ("t", 0, 0.1)]
    df = spark.createDataFrame(rows, "task string, label int, y_pred double")
    assert auc(df).head()["auc"] == pytest.approx(0.875)


@pytest.mark.parametrize("dof", [9.9e6, 1.1e7, 1e11, 1e13, 1e15])
def test_p_values_do_not_drift_with_the_degrees_of_freedom(dof):
    assert student_p(2.0, dof) == pytest.approx(math.erfc(math.sqrt(2.0)), abs=1e-7)
