"""A cleaned map is the same however its bins are dealt, and no window orders all of them."""

import random
from statistics import median

import pytest
from tidemark.operators import primitives as P


def _plain(bins, most, rounds=3, wide=15, smooth=2):
    keys = list(range(min(bins), max(bins) + 1))
    c = [bins.get(k) for k in keys]
    around = lambda x, i, w: [v for v in x[max(0, i - w) : i + w + 1] if v is not None]
    for _ in range(rounds):
        m = [median(v) if len(v := around(c, i, wide)) >= 3 else None for i in range(len(c))]
        c = [None if v is None or (u is not None and abs(v - u) > most) else v for v, u in zip(c, m)]
    at = [i for i, v in enumerate(c) if v is not None]
    filled = []
    for i, v in enumerate(c):
        lo, hi = max((j for j in at if j <= i), default=None), min((j for j in at if j >= i), default=None)
        filled.append(v if v is not None else c[hi] if lo is None else c[lo] if hi is None else c[lo] + (c[hi] - c[lo]) * (i - lo) / (hi - lo))
    s = [median(around(filled, i, smooth)) for i in range(len(filled))]
    return {k: max(s[: i + 1]) for i, k in enumerate(keys)}


@pytest.mark.parametrize("chunk", [20, 20_000])
def test_chunks_of_bins_do_not_change_the_map(spark, monkeypatch, chunk):
    monkeypatch.setattr(P, "MAP_BINS", chunk)
    rng = random.Random(3)
    bins = {k: float(k * 10 + rng.choice([0, 0, 0, rng.randrange(-900, 900)])) for k in range(-37, 400) if rng.random() < 0.6 and not 90 < k < 190}
    df = spark.createDataFrame(list(bins.items()), "bin long, c double")
    out = P.cleaned_map(df, "bin", "c", 200.0)
    assert {r.bin: r.c for r in out.collect()} == pytest.approx(_plain(bins, 200.0))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan


def test_no_window_of_a_map_reads_on_to_the_end(spark, monkeypatch):
    plans, cut = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    df = spark.createDataFrame([(k, float(k)) for k in range(50)], "bin long, c double")
    plans.append(P.cleaned_map(df, "bin", "c", 200.0)._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans) > 1 and not any("unboundedfollowing" in p for p in plans)
