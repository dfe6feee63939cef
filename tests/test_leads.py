"""Leads and their expectations against brute force, and what their plan joins."""

import random
from collections import defaultdict

import pytest

from tidemark.operators import coordination as G
from tidemark.plans.registry import QUERIES, load


@pytest.mark.parametrize("small", [False, True])
def test_expected_leads_are_those_of_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(G, "BLOCK_ROWS", 20)
        monkeypatch.setattr(G, "STEP", 7)
    rng = random.Random(6)
    data = [(rng.choice([None, 1, 2, 3]), rng.choice("BS"), rng.randrange(-300, 300), rng.choice([None, *range(1, 15)])) for _ in range(300)]
    trades = spark.createDataFrame(data, "asset_id long, side string, sec long, wallet long")
    at, k = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for a, side, t, w in data:
        if a is not None:
            at[a, side][t].add(w)
            k[a, side, w].add(t)
    events, lags, share = defaultdict(int), defaultdict(list), {}
    for key, seconds in at.items():
        order = sorted(seconds)
        steps = [(x, y) for x, y in zip(order, order[1:]) if y - x <= 5]
        share[key] = len(steps) / len(order) ** 2
        for x, y in steps:
            for p in seconds[x] - {None}:
                for q in seconds[y] - {None, p}:
                    events[p, q] += 1
                    lags[p, q].append(y - x)
    got = {(r.leader, r.follower): (r.events, r.expected) for r in G.leader_lag_null(trades, 5).collect()}
    assert got == {(p, q): (n, pytest.approx(sum(len(k[*s, p]) * len(k[*s, q]) * share[s] for s in share))) for (p, q), n in events.items()}
    found = {(r.leader, r.follower): (r.events, r.mean_lag) for r in G.leader_lag(trades, 5, 2).collect()}
    assert found == {p: (len(v), pytest.approx(sum(v) / len(v), abs=1e-6)) for p, v in lags.items() if len(v) > 1}


def test_pairs_do_not_travel_by_stratum(spark, sf_dir):
    load()
    plan = QUERIES["leader_lag_null"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "Aggregate" not in plan  # of wallets with seconds, and nothing after
