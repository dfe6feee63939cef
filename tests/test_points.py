"""Hawkes fits against the sum over all pairs and planted parameters; change points against all segmentations."""

import itertools
import math

import numpy as np
import pytest

from tidemark.operators import points as P


def _pairs(times, steps, start=(0.5, 10.0)):
    """EM by sums over all pairs of one key."""
    t, m = (np.array(x, dtype=float) for x in np.unique(times, return_counts=True))
    span, n = t[-1] - t[0], m.sum()
    base, branching, decay, loglik = n / span * (1 - start[0]), start[0], n / span * start[1], None
    gap = t[:, None] - t[None, :]
    for _ in range(steps):
        w = np.where(gap > 0, m[None, :] * np.exp(-decay * np.maximum(gap, 0)), 0)
        near, lag, pull, left = w.sum(1), (w * gap).sum(1), branching * decay, t[-1] - t
        lam, gone = base + pull * near, np.exp(-decay * left)
        loglik = (m * np.log(lam)).sum() - base * span - branching * (m * (1 - gone)).sum()
        led = (m * pull * near / lam).sum()
        new = led / ((m * pull * lag / lam).sum() + branching * (m * left * gone).sum())
        base, branching, decay = (m * base / lam).sum() / span, led / (m * (1 - gone)).sum(), new
    return base, branching, decay, loglik


def _stream(rng, base, branching, decay, span):
    """Times of a Hawkes process by generations: each time has a Poisson number of children after exponential waits."""
    found = parents = rng.uniform(0, span, rng.poisson(base * span))
    while len(parents):
        parents = np.repeat(parents, rng.poisson(branching, len(parents)))
        parents = parents + rng.exponential(1 / decay, len(parents))
        parents = parents[parents < span]
        found = np.concatenate([found, parents])
    return np.sort(found)


def test_em_equals_the_sum_over_all_pairs(spark):
    rng = np.random.default_rng(1)
    streams = {1: rng.integers(0, 5_000, 120), 2: np.cumsum(rng.integers(0, 3, 150)), 3: np.concatenate([rng.integers(k, k + 50, 40) for k in (0, 90_000, 400_000)])}
    rows = [(k, int(x)) for k, xs in streams.items() for x in xs] + [(4, 7), (4, 7), (5, None), (None, 3)]
    got = {r.k: r for r in P.hawkes(spark.createDataFrame(rows, "k int, t int").repartition(5), "k", "t", 4).collect()}
    assert set(got) == {1, 2, 3}  # seen at one time only, or never: left out
    for k, xs in streams.items():
        assert (got[k].base, got[k].branching, got[k].decay, got[k].loglik) == pytest.approx(_pairs(xs, 4), rel=1e-9)
        assert got[k].n == len(xs)


def test_planted_parameters_are_recovered(spark):
    times = (_stream(np.random.default_rng(5), 0.2, 0.6, 2.0, 20_000) * 1000).astype(int)
    rows = spark.createDataFrame([(1, int(t)) for t in times], "k int, t long")
    one = P.hawkes(rows, "k", "t", 20, (0.4, 5.0)).first()
    assert one.base * 1000 == pytest.approx(0.2, rel=0.1) and one.branching == pytest.approx(0.6, rel=0.1) and one.decay * 1000 == pytest.approx(2.0, rel=0.1)


def _evidence(ys, prior):
    """Log marginal likelihood of rows of one level, in closed form."""
    m, k, a, b = prior
    n, mean = len(ys), float(np.mean(ys))
    bn = b + 0.5 * float(((np.array(ys) - mean) ** 2).sum()) + k * n * (mean - m) ** 2 / (2 * (k + n))
    return math.lgamma(a + n / 2) - math.lgamma(a) + a * math.log(b) - (a + n / 2) * math.log(bn) + 0.5 * math.log(k / (k + n)) - n / 2 * math.log(2 * math.pi)


def _by_segmentations(ys, hazard, prior):
    """Probability of each length of the last level, from all ways to cut the rows into levels."""
    n, p = len(ys), {}
    for cuts in itertools.product((0, 1), repeat=n - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
        log = sum(_evidence(ys[a:b], prior) for a, b in zip(at, at[1:])) + sum(cuts) * math.log(hazard) + (n - 1 - sum(cuts)) * math.log(1 - hazard)
        p[n - at[-2]] = p.get(n - at[-2], 0.0) + math.exp(log)
    total = sum(p.values())
    return {r: x / total for r, x in p.items()}


@pytest.mark.parametrize("chunk", [3, 1000])
def test_beliefs_equal_all_segmentations(spark, chunk):
    rng, prior = np.random.default_rng(2), (0.0, 0.5, 1.5, 0.8)
    series = {1: [*rng.normal(0, 1, 5), *rng.normal(6, 1, 4)], 2: list(rng.normal(0, 1, 7))}
    rows = [(k, t - 2, float(y)) for k, ys in series.items() for t, y in enumerate(ys)] + [(3, 1, None), (3, 2, float("nan")), (2, None, 1.0)]
    out = P.change_points(spark.createDataFrame(rows, "k int, t int, y double").repartition(3), "k", "t", "y", 0.1, prior, 2, chunk, 0.0)
    got = {(r.k, r.t): r for r in out.collect()}
    assert len(got) == sum(map(len, series.values()))
    for k, ys in series.items():
        for n in range(1, len(ys) + 1):
            want, r = _by_segmentations(ys[:n], 0.1, prior), got[k, n - 3]
            assert r.mean_run == pytest.approx(sum(a * b for a, b in want.items()), rel=1e-9)
            assert r.recent == pytest.approx(sum(b for a, b in want.items() if a <= 2), rel=1e-9) and r.run == max(want, key=lambda a: (want[a], -a)) and r.dropped == 0


def test_pruned_beliefs_stay_within_what_was_dropped(spark):
    rng = np.random.default_rng(4)
    ys = [*rng.normal(0, 1, 300), *rng.normal(5, 1, 200)]
    df = spark.createDataFrame([("a", t, float(y)) for t, y in enumerate(ys)], "k string, t long, y double")
    whole, pruned = ({r.t: r for r in P.change_points(df, "k", "t", "y", chunk=128, prune=p).collect()} for p in (0.0, 1e-6))
    for t, r in pruned.items():
        assert abs(r.recent - whole[t].recent) <= 4 * r.dropped + 1e-9 and r.dropped < 0.01
    assert abs(pruned[310].run - 11) <= 1 and pruned[299].run > 250 and pruned[499].run > 150
    assert P.change_points(df.where("t < 0"), "k", "t", "y").count() == 0
