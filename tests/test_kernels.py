"""Inference kernels against closed forms, enumeration and planted effects."""

import itertools
import math

import numpy as np
import pytest

from tidemark.functions import inference as I
from tidemark.functions import tails as T


def test_tails():
    assert T.poisson_sf(3, 2.0) == pytest.approx(1 - sum(math.exp(-2) * 2**k / math.factorial(k) for k in range(4)), abs=1e-12)
    assert T.binomial_sf(7, 10, 0.5) == pytest.approx(176 / 1024, abs=1e-12)
    assert T.beta_cdf(0.3, 2, 5) == pytest.approx(sum(math.comb(6, k) * 0.3**k * 0.7 ** (6 - k) for k in range(2, 7)), abs=1e-12)
    assert T.beta_cdf(T.beta_ppf(0.05, 4, 6), 4, 6) == pytest.approx(0.05, abs=1e-10)
    assert T.student_cdf(0.0, 5) == pytest.approx(0.5)
    assert T.gamma_p(50, 80) == pytest.approx(1 - sum(math.exp(-80) * 80**k / math.factorial(k) for k in range(50)), abs=1e-10)


def test_multiple_testing():
    assert I.bh_qvalues([0.01, 0.04, 0.03, 0.5]) == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
    assert I.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert I.tost(0.0, 0.1, 1.0) < 1e-6 < I.tost(1.0, 0.1, 1.0)


def test_sign_flip_near_enumeration():
    x = np.array([1.0, 2, -0.5, 3, 1, 0.2, -1, 2])
    exact = np.mean([np.dot(s, x) >= x.sum() - 1e-12 for s in itertools.product((-1, 1), repeat=len(x))])
    assert I.sign_flip_p(x, 20000) == pytest.approx(exact, abs=0.01)


def test_sign_flip_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k, float((k * 7 + i * 3) % 11 - 4)) for k in range(5) for i in range(12)], "k long, v double")
    out = [sorted(map(tuple, I.sign_flip(df.repartition(n), "k", "v", n=200).collect())) for n in (1, 5)]
    assert out[0] == out[1] and len(out[0]) == 5


def test_panels():
    rng = np.random.default_rng(0)
    u, t = np.repeat(np.arange(30), 10), np.tile(np.arange(10), 30)
    g = np.where(u < 15, 5, np.nan)
    d = (t >= g).astype(float)
    y = 2 * d + u * 0.1 + t * 0.2 + rng.normal(0, 0.1, 300)
    beta, se = I.twfe(y, d, u, t)
    assert beta[0] == pytest.approx(2, abs=0.1) and 0 < se[0] < 0.1
    assert I.group_time_att(y, u, t, g, 50)["att"] == pytest.approx(2, abs=0.1)
    X = np.column_stack([np.ones(300), d])
    assert I.wild_cluster_p(X, y, u, 1, 99) <= 0.02
    assert I.slope_test(t, t * 3.0 + rng.normal(0, 0.1, 300))[0] == pytest.approx(3, abs=0.05)
    low, high = I.bootstrap_ci(y, n=300)
    assert low < y.mean() < high


def test_wild_bootstrap_enumerates_few_clusters():
    x, y, c = np.arange(12.0), np.arange(12.0) * 0 + np.tile([1, -1], 6), np.repeat(np.arange(4), 3)
    p = I.wild_cluster_p(np.column_stack([np.ones(12), x]), y, c, 1)
    assert p * 16 == round(p * 16)


def test_sign_flip_sums_large_keys_instead_of_drawing(spark):
    df = spark.createDataFrame([(1, float(i % 5 - 1.5)) for i in range(60)] + [(2, 1.0)] * 3, "k long, v double")
    drawn, summed = ({r.k: r for r in I.sign_flip(df, "k", "v", n=4000, cap=c).collect()} for c in (100, 20))
    assert drawn[1].p_up == pytest.approx(summed[1].p_up, abs=0.03) and drawn[1].z == summed[1].z and drawn[2].p_up is None is summed[2].p_up
    assert drawn[1].p_up + drawn[1].p_down == pytest.approx(1, abs=0.06)


def test_population_draws_do_not_depend_on_partitions(spark):
    from tidemark.operators import population as N

    rows = [(w, 1, int((w * 7 + i * 13) % 100 < 40 + w % 20), 30 + (w * i) % 40) for w in range(40) for i in range(15)]
    bet = spark.createDataFrame(rows, "wallet long, one long, won long, implied long")
    groups = spark.createDataFrame([(w, w % 2 + 1) for w in range(40)], "wallet long, g long")
    a, b = (N.simulated_discoveries(bet.repartition(k), sims=50).first() for k in (1, 6))
    assert a == b and 0 <= a.by_chance <= a.by_chance_95 <= 40
    x, y = (N.bootstrap_difference(bet.repartition(k), groups, "g", 1, 2, 200).first() for k in (1, 6))
    assert x == pytest.approx(y) and x.low < x.middle < x.high


def test_shuffles_within_groups_keep_what_groups_explain():
    rng = np.random.default_rng(3)
    group = np.repeat(np.arange(5), 40)
    x, y = group + rng.normal(size=200), group + rng.normal(size=200)  # related through the group alone
    assert np.corrcoef(x, y)[0, 1] > 0.4 and I.within_group_shuffle(group, x, y, 200) > 0.02
    assert I.within_group_shuffle(group, x, x + rng.normal(size=200), 200) < 0.02


def test_bootstrap_of_a_ratio():
    rng = np.random.default_rng(4)
    table = np.column_stack([rng.normal(3, 1, 400), rng.normal(2, 0.3, 400)])
    low, high = I.bootstrap_ci(table, lambda t: t[:, 0].sum() / t[:, 1].sum(), 400)
    assert low < 1.5 < high and high - low < 0.3


def test_never_treated_controls():
    u, t = np.repeat(np.arange(9), 6), np.tile(np.arange(6), 9)
    g = np.where(u < 3, 2, np.where(u < 6, 4, np.nan))
    y = np.where(t >= g, 1.0, 0.0) + 5.0 * ((g == 4) & (t == 3))  # a jump before treatment, which only later controls see
    assert I.group_time_att(y, u, t, g, 5)["cells"][0][:3] == (2.0, 2, 1.0)
    never, later = ({c[:2]: c[2] for c in I.group_time_att(y, u, t, g, 5, controls=k)["cells"]} for k in ("never", "later"))
    assert never[2.0, 3] == 1.0 and later[2.0, 3] != 1.0


def test_gates_are_hard(spark):
    from tidemark.operators.classify import enforce_gates

    fine = spark.createDataFrame([(0.9, 0.1, True, 0.5)], "coverage double, unmapped double, has_control boolean, largest double")
    assert enforce_gates(fine) is fine
    with pytest.raises(ValueError, match="has_control"):
        enforce_gates(fine.withColumn("has_control", ~fine.has_control))
