import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postlens.operators import ordering

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(params=[8, 64, 700])
def partitions(request, spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)


def skewed(n=4000, seed=1):
    """One group holds most rows and one value a third of them."""
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=n), 2)
    v[: n // 3] = 0.25
    return pd.DataFrame({"g": np.where(rng.random(n) < 0.8, "a", rng.choice(["b", "c"], n)), "v": v})


def test_average_ranks_match_pandas(spark, partitions):
    pdf = skewed()
    want = pdf.assign(r=pdf.groupby("g")["v"].rank()).drop_duplicates()
    got = ordering.average_ranks(spark.createDataFrame(pdf), ["g"], "v", "r").toPandas()
    both = want.merge(got, on=["g", "v"], suffixes=("_w", "_g"))
    assert len(both) == len(want) == len(got)
    assert (both["r_w"] == both["r_g"]).all()


def test_quantiles_match_pandas(spark, partitions):
    pdf = skewed()
    probs = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    got = {r["g"]: r["quantiles"] for r in ordering.exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], part["v"].quantile(probs), rtol=0, atol=1e-12)


def test_positions_of_text(spark, partitions):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": "k", "v": ["w%05d" % i for i in rng.integers(0, 3000, 5000)]})
    got = ordering.dense_positions(spark.createDataFrame(pdf), ["g"], "v").toPandas().sort_values("position")
    assert got["v"].tolist() == sorted(set(pdf["v"]))
    assert got["position"].tolist() == list(range(len(got)))


def test_row_numbers_split_one_long_group(spark, partitions):
    pdf = pd.DataFrame({"g": 1, "o": np.random.default_rng(0).permutation(3000)})
    got = ordering.number_rows(spark.createDataFrame(pdf), ["g"], ["o"]).toPandas()
    assert (got["row"] == got["o"] + 1).all() and len(got) == 3000


@few
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=1, max_size=30))
def test_small_inputs(spark, values):
    df = spark.createDataFrame([("g", None if v is None else float(v)) for v in values], "g string, v double")
    known = pd.Series([v for v in values if v is not None], dtype="float64")
    got = ordering.exact_quantiles(df, ["g"], "v", [0.25, 0.5]).collect()
    if known.empty:
        assert got == []
    else:
        assert np.allclose(got[0]["quantiles"], known.quantile([0.25, 0.5]))


def test_median_of_nothing(spark):
    rows = ordering.median(spark.createDataFrame([(None,)], "v double"), "v").collect()
    assert [r["median"] for r in rows] == [None]
