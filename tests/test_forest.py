"""Isolation forests against a plain recursion."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.operators import forest as I


def _unit(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 16**12


def _depths(rows, trees, sample, seed="42"):
    """Mean path lengths of all rows, each tree grown by recursion. rows: key to features."""
    pool = sorted(rows, key=lambda k: (_unit(seed, k), k))[: trees * sample]
    total = dict.fromkeys(rows, 0.0)

    def walk(tree, node, level, members, asking):
        spans = [(f, min(v), max(v)) for f, v in enumerate(zip(*[rows[m] for m in members]))] if members else []
        spans = [s for s in spans if s[2] > s[1]]
        if level == math.ceil(math.log2(sample)) or not spans:
            for a in asking:
                total[a] += level + float(I.mean_path(len(members)))
            return
        f, low, high = spans[int(_unit(seed, tree, node, "feature") * len(spans))]
        at = low + _unit(seed, tree, node, "cut") * (high - low)
        for side in (0, 1):
            part = lambda ks: [k for k in ks if (rows[k][f] > at) == bool(side)]
            walk(tree, 2 * node + side, level + 1, part(members), part(asking))

    for tree in range(trees):
        walk(tree, 1, 0, sorted(pool, key=lambda k: (_unit(seed, tree, k), k))[:sample], list(rows))
    return {k: v / trees for k, v in total.items()}


@pytest.mark.parametrize("n,trees,sample", [(300, 6, 32), (20, 4, 64)])
def test_depths_equal_a_plain_recursion_on_any_partitioning(spark, n, trees, sample):
    rng = np.random.default_rng(n)
    rows = {int(k): (float(rng.normal()), float(rng.integers(0, 3)), 7.0) for k in range(n)}
    rows[0] = (40.0, 90.0, 7.0)
    df = spark.createDataFrame([(k, *v) for k, v in rows.items()] + [(-1, None, 1.0, 7.0), (-2, float("nan"), 1.0, 7.0)], "k long, a double, b double, c double")
    one, other = ({r.k: r for r in I.isolation(df.repartition(p), "k", ["a", "b", "c"], trees, sample).collect()} for p in (1, 5))
    assert one == other and len(one) == n + 2 and one[-1].score is None and one[-2].depth is None
    want = _depths(rows, trees, sample)
    for k, d in want.items():
        assert one[k].depth == pytest.approx(d, rel=1e-12)
    assert max((r for r in one.values() if r.score is not None), key=lambda r: r.score).k == 0


def test_tables_that_cannot_be_cut(spark):
    alike = spark.createDataFrame([(k, 1.0) for k in range(9)], "k long, a double")
    assert {r.score for r in I.isolation(alike, "k", ["a"], 3, 8).collect()} == {0.5}
    assert I.isolation(alike.where("k < 0"), "k", ["a"], 3, 8).count() == 0
    assert I.isolation(alike.where("k = 1"), "k", ["a"], 3, 8).first().score is None  # nothing to be set apart from
