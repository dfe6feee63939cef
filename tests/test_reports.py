"""Means with clustered errors, trends, step-down tests and roll-out panels against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import inference
from tidemark.functions.tails import normal_cdf
from tidemark.operators import fees
from tidemark.operators import regression as R


def test_clustered_mean_equals_the_regression_on_a_constant(spark):
    rng = np.random.default_rng(0)
    rows = [("a", int(c), float(c % 3 + rng.normal())) for c in rng.integers(0, 9, 300)] + [("b", 1, 2.0), ("b", 1, 4.0), ("a", None, 1.0), ("a", 2, None)]
    df = spark.createDataFrame(rows, "k string, c int, y double").repartition(6)
    got = {r.k: r for r in R.clustered_mean(df, ["k"], "c", "y").collect()}
    fit = R.clustered_ols(df.where("k = 'a'"), {}, F.col("y"), "c")
    assert (got["a"].n, got["a"].clusters) == (fit.rows, fit.clusters) == (300, 9)
    assert got["a"].mean == pytest.approx(fit.beta[0], rel=1e-12) and got["a"].se == pytest.approx(fit.se()[0], rel=1e-9)
    assert got["b"].mean == 3.0 and got["b"].se is None  # one cluster tells nothing of the spread between them


def test_trend_equals_a_plain_fit(spark):
    rng = np.random.default_rng(1)
    x, y = np.arange(12.0), 0.3 * np.arange(12.0) + rng.normal(size=12)
    rows = [("noisy", a, b) for a, b in zip(x, y)] + [("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("two", 0.0, 1.0), ("two", 1.0, 3.0), ("line", None, 5.0)] + [("line", float(k), 2.0 * k) for k in range(5)]
    got = {r.k: r for r in R.trend(spark.createDataFrame([(k, a if a is None else float(a), float(b)) for k, a, b in rows], "k string, x double, y double"), ["k"], "x", "y").collect()}
    design = np.column_stack([np.ones(12), x])
    beta = np.linalg.solve(design.T @ design, design.T @ y)
    se = np.sqrt(((y - design @ beta) ** 2).sum() / 10 * np.linalg.inv(design.T @ design)[1, 1])
    assert (got["noisy"].slope, got["noisy"].se) == pytest.approx((beta[1], se), rel=1e-9)
    assert got["noisy"].p == pytest.approx(float(2 * (1 - normal_cdf(abs(beta[1] / se)))), abs=1e-12) and got["noisy"].range == pytest.approx(float(np.ptp(y)))
    assert got["flat"].slope is None and got["flat"].p is None and got["two"].slope == 2 and got["two"].se is None and got["line"].slope == pytest.approx(2) and got["line"].p is None


@pytest.mark.parametrize("seed", range(3))
def test_holm_equals_adjusted_p(spark, seed):
    p = np.random.default_rng(seed).uniform(0, 1, 25) ** 5
    p[:3] = p[3]  # ties
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(99, None)], "i int, p double").repartition(5)
    got = {r.i: r.rejected for r in R.holm(df, "p", ["i"]).collect()}
    want = inference.holm(p) <= 0.05
    assert [got[i] for i in range(25)] == want.tolist() and got[99] is False and 0 < want.sum() < 25
    assert R.holm(df.where("i < 0"), "p", ["i"]).count() == 0


def test_balanced_rows_keep_the_same_units(spark):
    rows = [(u, s, float(10 * u + s), float(u + 1)) for u, times in ((0, range(-2, 3)), (1, range(-1, 2)), (2, (-1, 1, 2))) for s in times]
    out = fees.rollout(spark.createDataFrame(rows, "u int, s int, y double, w double"), "u", "s", ["y"], "y", "w", 2, -1, 1)
    got = {(r.scope, r.s): r for r in out.collect()}
    assert {s: got["balanced", s].units for s in (-1, 0, 1)} == {-1: 2, 0: 2, 1: 2} and len(got) == 8
    assert got["balanced", 1].y == 6.0 and got["balanced", 1].weighted == pytest.approx((1 * 1 + 11 * 2) / 3)
    assert got["pooled", 1].units == 3 and got["pooled", 2].y == 12.0 and got["pooled", -2].units == 1
