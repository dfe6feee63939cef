"""Regressions, effects and permutations on tables against plain solves, enumeration and other partitionings."""

import collections
import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import inference as I
from tidemark.operators import effects as E
from tidemark.operators import regression as R


def _frame(spark, clusters=7, n=210, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(c), float(a), float(b), float(1 + 2 * a - b + rng.normal() + 0.5 * (c % 3))) for c, a, b in zip(rng.integers(0, clusters, n), rng.normal(size=n), rng.integers(0, 2, n))]
    df = spark.createDataFrame([*rows, (1, None, 1.0, 2.0), (None, 1.0, 1.0, 2.0), (2, 1.0, 0.0, None)], "c int, a double, b double, y double")
    c, a, b, y = (np.array(v) for v in zip(*rows))
    return df, np.column_stack([np.ones(n), a, b]), y, c


def test_clustered_errors_equal_the_plain_solve(spark):
    df, X, y, c = _frame(spark)
    fit = R.clustered_ols(df.repartition(5), {"a": F.col("a"), "b": F.col("b")}, F.col("y"), "c")
    beta, se = I.ols(X, y, c)
    assert fit.rows == len(y) and fit.clusters == len(set(c.tolist()))
    assert fit.beta == pytest.approx(beta, abs=1e-10) and fit.se() == pytest.approx(se, abs=1e-10)
    fit.close()


def test_enumerated_bootstrap_equals_refitting(spark):
    df, X, y, c = _frame(spark)
    fit = R.clustered_ols(df, {"a": F.col("a"), "b": F.col("b")}, F.col("y"), "c")
    for name, j in (("a", 1), ("b", 2)):
        beta, se = I.ols(X, y, c)
        t, two, less = R.wild_cluster(fit, name)
        assert t == pytest.approx(beta[j] / se[j])
        rest = np.delete(X, j, axis=1)
        fitted = rest @ np.linalg.pinv(rest) @ y
        ts = []
        for s in itertools.product((-1, 1), repeat=7):
            b, v = I.ols(X, fitted + (y - fitted) * np.array(s)[c], c)
            ts.append(b[j] / v[j])
        assert two == np.mean(np.abs(ts) >= abs(t) * (1 - 1e-9)) and less == np.mean(np.array(ts) <= t + 1e-9 * max(1, abs(t)))


def test_drawn_bootstrap_is_seeded_by_cluster_and_draw(spark):
    df, X, y, c = _frame(spark, clusters=20, n=300, seed=2)
    p = [R.wild_cluster(R.clustered_ols(df.repartition(k), {"a": F.col("a"), "b": F.col("b")}, F.col("y"), "c"), "b", draws=99) for k in (1, 6)]
    assert p[0] == pytest.approx(p[1])
    rest = X[:, :2]
    fitted = rest @ np.linalg.pinv(rest) @ y
    ts = []
    for d in range(99):
        sign = {k: -1.0 if hashlib.md5(f"42:{d}:{k}".encode()).hexdigest()[0] < "8" else 1.0 for k in range(20)}
        b, v = I.ols(X, fitted + (y - fitted) * np.array([sign[k] for k in c.tolist()]), c)
        ts.append(b[2] / v[2])
    assert p[0][1] == pytest.approx((np.sum(np.abs(ts) >= abs(p[0][0])) + 1) / 100)


def test_collinear_columns_and_single_clusters(spark):
    df, *_ = _frame(spark)
    fit = R.clustered_ols(df, {"a": F.col("a"), "twice": F.col("a") * 2}, F.col("y"), "c")
    assert fit.beta[2] == pytest.approx(2 * fit.beta[1])
    one = R.clustered_ols(df.where("c = 1"), {"a": F.col("a")}, F.col("y"), "c")
    assert one.clusters == 1 and np.isfinite(one.beta).all()
    assert R.clustered_ols(df.limit(0), {"a": F.col("a")}, F.col("y"), "c").rows == 0
    with pytest.raises(ValueError):
        R.indicators(spark.range(70).toDF("k"), "k")


def test_two_way_effects_equal_dummies(spark):
    rng = np.random.default_rng(4)
    cells = [(u, t) for u in range(15) for t in range(12) if rng.random() < 0.7]  # unbalanced
    rows = [(u, t, float(t >= u % 5 + 4), float(rng.normal()), float(rng.normal() + u + 0.3 * t * (u % 2))) for u, t in cells]
    df = spark.createDataFrame([*rows, (1, 1, None, 1.0, 1.0)], "u int, t int, d double, x double, y double")
    fit = R.twfe(df.repartition(3), "u", "t", "y", ["d", "x"])
    u, t, d, x, y = (np.array(v) for v in zip(*rows))
    D = np.column_stack([d, x, *[(u == k).astype(float) for k in range(15)], *[(t == k).astype(float) for k in range(1, 12)]])
    assert fit.beta == pytest.approx((np.linalg.pinv(D) @ y)[:2], abs=1e-8)
    beta, se = I.twfe(y, np.column_stack([d, x]), u, t)
    assert fit.se() == pytest.approx(se, abs=1e-8)
    z = I.demean(np.column_stack([y, d, x]), u, t)
    scale = 15 / 14 * (len(y) - 1) / (len(y) - 2)
    assert fit.wald()[0] == pytest.approx(I.wald(beta, z[:, 1:], z[:, 0] - z[:, 1:] @ beta, u) / scale, rel=1e-7)


def test_effects_by_time_since_start(spark):
    rng = np.random.default_rng(6)
    rows = []
    for u in range(24):
        g = [None, 6, 9][u % 3]
        for t in range(16):
            if rng.random() < 0.9:
                rows.append((u, t, g, float(u + 0.1 * t * t + (2.0 if g and t >= g else 0.0) + rng.normal() * 0.1)))
    df = spark.createDataFrame([*rows, (3, 3, 6, None)], "u int, t int, g int, y double")
    got = {r.since: r for r in E.group_time_effects(df.repartition(4), "u", "t", "g", "y", -4, 4, draws=60).collect()}
    y = {(u, t): v for u, t, _, v in rows}
    g = {u: s for u, _, s, _ in rows}

    def effect(k, weight):
        num = den = 0.0
        for s in (6, 9):
            mine = [(weight[u], y[u, s + k] - y[u, s - 1]) for u in g if g[u] == s and (u, s + k) in y and (u, s - 1) in y and weight[u]]
            others = [(weight[u], y[u, s + k] - y[u, s - 1]) for u in g if g[u] is None and (u, s + k) in y and (u, s - 1) in y and weight[u]]
            if mine and others:
                mean = lambda v: sum(w * d for w, d in v) / sum(w for w, _ in v)
                n = sum(w for w, _ in mine)
                num, den = num + (mean(mine) - mean(others)) * n, den + n
        return num / den if den else None

    draws = [collections.Counter(int(hashlib.md5(f"42:{b}:{i}".encode()).hexdigest()[:12], 16) % 24 for i in range(24)) for b in range(60)]
    for k in range(-4, 5):
        assert got[k].att == pytest.approx(effect(k, collections.Counter(range(24))), abs=1e-9)
        assert got[k].se == pytest.approx(np.std([effect(k, w) for w in draws], ddof=1), abs=1e-9)
    assert got[-1].att == 0 and abs(got[-3].att) < 0.2 and got[2].att == pytest.approx(2, abs=0.2)
    same = {r.since: r for r in E.group_time_effects(df.repartition(1), "u", "t", "g", "y", -4, 4, draws=60).collect()}
    assert all(same[k].att == pytest.approx(got[k].att) and same[k].se == pytest.approx(got[k].se) for k in got)


def test_shuffles_keep_strata_and_repeat_nothing(spark):
    df = spark.createDataFrame([(s, k, 100 * s + k) for s in range(3) for k in range(1 + 9 * s)], "s int, k int, v int")
    out = E.shuffled_within(df.repartition(5), "s", ["k"], "v", 3).collect()
    for d in range(3):
        for s in range(3):
            assert sorted(r.v for r in out if r.draw == d and r.s == s) == [100 * s + k for k in range(1 + 9 * s)]
    assert sorted(map(tuple, out)) == sorted(map(tuple, E.shuffled_within(df.repartition(1), "s", ["k"], "v", 3).collect()))
    assert len({tuple(r.v for r in sorted(out, key=lambda r: (r.s, r.k)) if r.draw == d) for d in range(3)}) == 3


def test_shuffles_reach_every_arrangement_alike(spark):
    df = spark.createDataFrame([(1, k, k) for k in range(3)], "s int, k int, v int")
    out = E.shuffled_within(df, "s", ["k"], "v", 1200).collect()
    by = collections.defaultdict(dict)
    for r in out:
        by[r.draw][r.k] = r.v
    counts = collections.Counter(tuple(v[k] for k in range(3)) for v in by.values())
    assert len(counts) == 6 and all(140 < n < 260 for n in counts.values())


def test_exact_quantiles(spark):
    rng = np.random.default_rng(7)
    rows = [(k, float(v)) for k in range(4) for v in rng.normal(size=1 + 37 * k)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(3)
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.x for r in E.exact_quantile(df, ["k"], "v", q, "x").collect()}
        for k in range(4):
            assert got[k] == pytest.approx(np.quantile([v for j, v in rows if j == k], q), abs=1e-12)
