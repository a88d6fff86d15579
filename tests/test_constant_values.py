"""Variables that never change, as the largest and least of very many values an hour don't."""

import math

import pytest

from tidewright.operators import analytics


@pytest.fixture(scope="module")
def hours(spark):
    return spark.sql("SELECT 'a' AS k, timestamp_ntz'2024-01-01' + make_dt_interval(0, id) AS ts, 99.0D AS same, IF(id = 3, NULL, double(id * id)) AS x, IF(id = 0, 5.0D, NULL) AS one, double(NULL) AS none FROM range(8)").select("k", "ts", "same", "x", "one", "none").localCheckpoint()


def test_correlations_of_constants_are_nan(spark, hours):
    got = {(r["feature"], r["target"]): r["r"] for r in analytics.correlations(hours, ["same", "x", "one", "none"], ["same", "x"]).collect()}
    assert got["none", "x"] is None and got["none", "same"] is None
    assert all(math.isnan(got[p]) for p in got if "none" not in p and p != ("x", "x"))
    assert got["x", "x"] == pytest.approx(1)


def test_correlations_take_pairs_that_exist(spark):
    df = spark.sql("SELECT * FROM VALUES (1.0D, 2.0D), (2.0D, 1.0D), (4.0D, 7.0D), (NULL, 100.0D), (-50.0D, NULL) AS t(a, b)")
    want = df.dropna().selectExpr("corr(a, b)").first()[0]
    assert analytics.correlations(df, ["a"], ["b"]).first()["r"] == pytest.approx(want, rel=1e-12)


def test_horizon_difficulty_of_a_constant(spark, hours):
    got = {r["horizon"]: (r["r"], r["mean_abs_change"]) for r in analytics.horizon_difficulty(hours, "same", (1, 7, 8), ["k"]).collect()}
    assert math.isnan(got[1][0]) and math.isnan(got[7][0]) and got[1][1] == got[7][1] == 0.0 and got[8] == (None, None)


def test_histogram_of_a_constant_is_its_last_bin(spark, hours):
    got = sorted(tuple(r) for r in analytics.histogram(hours, ["same", "none", "one"], 60).collect())
    assert got == [("one", 59, 1), ("same", 59, 8)]
