"""Digests: errors of rank within their bound, merges in any order, edge values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import sketch as S

ASKED = (0.001, 0.01, 0.25, 0.5, 0.9, 0.99, 0.999)


def _miss(x, q, v):
    return max((x < v).mean() - q, q - (x <= v).mean(), 0.0)


def test_folding_keeps_weight_mean_and_ends():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 5000):
        x = rng.lognormal(size=n)
        mean, weight = S.fold(x, np.ones(n))
        assert weight.sum() == n and (mean * weight).sum() == pytest.approx(x.sum())
        assert mean[0] == x.min() and mean[-1] == x.max() and (np.diff(mean) >= 0).all() and len(mean) <= S.DELTA + 5


def test_ranks_stay_within_the_bound_on_any_partitioning(spark):
    rng = np.random.default_rng(2)
    data = {0: rng.normal(size=20_000), 1: rng.lognormal(sigma=2, size=9_000), 2: rng.integers(0, 4, 3_000).astype(float), 3: np.array([7.0]), 4: np.sort(rng.random(30_000))}
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [(0, None), (1, float("nan"))]
    df = spark.createDataFrame(rows, "k int, v double")
    found = {}
    for n in (1, 7, 150):
        parts = S.digests(df.repartition(n), ["k"], "v")
        for label, given in (("in order", parts), ("anyhow", parts.orderBy(F.rand(n)).withColumn("part", F.col("part") * 37 % 101))):
            out = S.quantiles(S.merged(given, ["k"]), ["k"], ASKED).collect()
            assert len(out) == len(ASKED) * len(data)
            for r in out:
                assert _miss(data[r.k], r.q, r.value) <= S.rank_bound(r.q) + 1 / len(data[r.k]), (n, label, r)
                found.setdefault((r.k, r.q), []).append(r.value)
    for (k, q), values in found.items():
        spread = np.quantile(data[k], np.clip([q - 2 * S.rank_bound(q), q + 2 * S.rank_bound(q)], 0, 1))
        assert spread[0] - 1e-9 <= min(values) <= max(values) <= spread[1] + 1e-9


def test_the_query_reports_errors_within_bounds(spark, sf_dir):
    from tidemark.plans.registry import QUERIES, load

    load()
    rows = QUERIES["quantile_sketches"](spark, sf_dir).collect()
    assert len(rows) == 28 and all(0 <= r.rank_error <= r.bound for r in rows)


def test_empty_tables_have_no_digest(spark):
    df = spark.createDataFrame([], "k int, v double")
    assert S.quantiles(S.merged(S.digests(df, ["k"], "v"), ["k"]), ["k"], ASKED).collect() == []
