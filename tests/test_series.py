"""Granger tests against a plain solve."""

import numpy as np
import pytest

from tidemark.functions.tails import student_cdf
from tidemark.operators import series as V


def _plain(y, x, lags):
    rows = range(lags, len(y))
    Y = np.array([y[t] for t in rows])
    own = np.array([[1.0, *[y[t - k] for k in range(1, lags + 1)]] for t in rows])
    full = np.column_stack([own, [[x[t - k] for k in range(1, lags + 1)] for t in rows]])
    rss = [float(((Y - d @ np.linalg.lstsq(d, Y, rcond=None)[0]) ** 2).sum()) for d in (own, full)]
    return (rss[0] - rss[1]) / lags / (rss[1] / (len(Y) - full.shape[1])), 1 - rss[1] / ((Y - Y.mean()) ** 2).sum()


def test_f_equals_a_plain_solve_and_finds_what_was_planted(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key, weight in ((1, 0.8), (2, 0.0)):
        x, y = rng.normal(size=200) + 5, np.zeros(200)
        for t in range(1, 200):
            y[t] = 0.4 * y[t - 1] + weight * x[t - 1] + rng.normal()
        want[key] = _plain(y, x, 2)
        rows += [(key, t, float(x[t]), float(y[t])) for t in range(200)]
    rows += [(3, t, 1.0, 2.0) for t in range(20)] + [(4, t, float(t), 1.0) for t in (1, 2)]  # constant; too short
    df = spark.createDataFrame(rows, "k int, t int, x double, y double").repartition(4)
    got = {r.k: r for r in V.granger(df, "k", "t", "x", "y", 2).collect()}
    for key in (1, 2):
        assert got[key].f == pytest.approx(want[key][0], rel=1e-6) and got[key].r2 == pytest.approx(want[key][1], rel=1e-6) and got[key].n == 198
    assert got[1].p < 1e-6 < 0.001 < got[2].p and got[3].f is None and 4 not in got


def test_gaps_in_time_leave_rows_out(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in (1, 2, 3, 5, 6, 7)], "k int, t int, y double")
    assert sorted((r.t, r.y_1, r.y_2) for r in V.lagged(df, "k", "t", ["y"], 2).collect()) == [(3, 2.0, 1.0), (7, 6.0, 5.0)]


def test_f_tail_is_that_of_t_squared():
    assert V.f_tail(2.0**2, 1, 9) == pytest.approx(2 * (1 - student_cdf(2.0, 9)), abs=1e-9)
