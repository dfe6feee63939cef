"""Weights against their optimality conditions and a grid, and controls against plain arrays."""

import numpy as np
import pytest

from tidemark.operators import controls as C


@pytest.mark.parametrize("seed", range(40))
def test_weights_meet_the_optimality_conditions(seed):
    rng = np.random.default_rng(seed)
    n, rows = int(rng.integers(2, 9)), int(rng.integers(3, 40))
    x = rng.normal(size=(rows, n)) + (seed % 3)
    if seed % 4 == 0:
        x[:, -1] = x[:, 0]  # a donor twice
    y = x @ rng.dirichlet(np.full(n, 0.3)) + rng.normal(size=rows) * (seed % 2)
    g, c = x.T @ x / rows, x.T @ y / rows
    w = C.simplex_weights(g, c)
    assert (w >= 0).all() and w.sum() == pytest.approx(1)
    slopes = g @ w - c
    level = slopes @ w  # those in use share the least slope, others have no smaller one
    assert np.allclose(slopes[w > 1e-9], level, atol=1e-7) and (slopes >= level - 1e-7).all()


def test_weights_beat_a_grid():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    w = C.simplex_weights(x.T @ x, x.T @ y)
    loss = lambda v: float(((y - x @ v) ** 2).sum())
    grid = [np.array([a, b, 100 - a - b]) / 100 for a in range(101) for b in range(101 - a)]
    assert loss(w) <= min(map(loss, grid)) + 1e-9


def test_effect_of_a_planted_start_ranks_first(spark):
    rng = np.random.default_rng(3)
    walk = {d: np.cumsum(rng.normal(size=40)) + 20 for d in (1, 2, 3, 4, 5)}
    y = 0.6 * walk[1] + 0.4 * walk[3] + rng.normal(size=40) * 0.05
    y[25:] += 3
    rows = [(d, t, float(v)) for d, s in walk.items() for t, v in enumerate(s)] + [(9, t, float(v)) for t, v in enumerate(y)] + [(8, 30, 1.0), (7, 3, None), (None, 2, 1.0)]
    rows = [r for r in rows if r[:2] != (2, 11)]  # a donor lacks period 11
    panel = spark.createDataFrame(rows, "u int, t int, y double").repartition(5)
    cases = spark.createDataFrame([(9, 25), (8, 25), (7, 25), (1, 25), (None, 25)], "u int, start int")
    got = {(r.u, r.placebo): r for r in C.synthetic_control(panel, "u", "t", "y", cases, [1, 2, 3, 4, 5]).collect()}
    assert set(got) == {(9, False), *((d, True) for d in range(1, 6))}  # 8 has nothing before, 7 no value, 1 is a donor
    one = got[9, False]
    assert (one.pre, one.post, one.rank, one.of) == (24, 15, 1, 5) and one.gap == pytest.approx(3, abs=0.15)
    assert one.weights == pytest.approx([0.6, 0, 0.4, 0, 0], abs=0.03)
    keep = [t for t in range(25) if t != 11]
    fitted = np.array([walk[d] for d in range(1, 6)]).T @ np.array(one.weights)
    assert one.pre_rmse == pytest.approx(float(np.sqrt(((y - fitted)[keep] ** 2).mean())), rel=1e-6) and one.gap == pytest.approx(float((y - fitted)[25:].mean()), rel=1e-9)
    for d in range(1, 6):
        assert got[d, True].weights[d - 1] == 0 and 1 <= got[d, True].rank <= 5
    assert C.synthetic_control(panel, "u", "t", "y", cases.where("u < 0"), [1, 2]).count() == 0
