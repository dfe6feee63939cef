"""Pairs by blocks against brute force, and what their plans shuffle."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import coordination as G
from tidemark.operators import pairs
from tidemark.operators import primitives as P


@pytest.mark.parametrize("block", [3, 2_048])
def test_pairs_by_blocks_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    rng = random.Random(4)
    rows = {(rng.randrange(4), rng.choice("BS"), rng.randrange(9), rng.choice([None, *range(1, 20)])): rng.choice([None, 1, 5, 1 << 54]) for _ in range(400)}
    data = [(s // 2, s, side, t * 100, w, n) for (s, side, t, w), n in rows.items()]
    trades = spark.createDataFrame(data, "condition_id long, asset_id long, side string, sec long, wallet long, notional long")
    cells, k, buckets = defaultdict(dict), defaultdict(int), defaultdict(set)
    for c, s, side, t, w, n in data:
        buckets[s, side].add(t)
        if w is not None:
            cells[c, s, side, t][w] = n
            k[s, side, w] += 1
    buckets = {key: len(ts) for key, ts in buckets.items()}
    want = defaultdict(lambda: [0, set(), None])
    for (c, *_), who in cells.items():
        for a, b in combinations(sorted(who), 2):
            pair = want[a, b]
            pair[0] += 1
            pair[1].add(c)
            if who[a] is not None and who[b] is not None:
                pair[2] = (pair[2] or 0) + who[a] + who[b]
    got = {(r.a, r.b): (r.events, r.markets, r.pair_notional) for r in G.cotrade_pairs(trades, 100, 1).collect()}
    assert got == {p: (e, len(m), n) for p, (e, m, n) in want.items()}
    found = {(r.a, r.b): r.expected for r in G.cotrade_expected(trades, 100).collect()}
    assert found == {(a, b): pytest.approx(sum(k[s, side, a] * k[s, side, b] / n for (s, side), n in buckets.items() if (s, side, a) in k and (s, side, b) in k)) for a, b in want}


def test_no_pair_is_shuffled(spark, sf_dir):
    from tidemark.plans.registry import QUERIES, load

    load()
    for name in ("cotrade_pairs", "cotrade_null", "behavioural_edges"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan, name


def test_counted_q_values_are_those_of_rows(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, rng.randrange(30) / 40) for i in range(200)], "i long, p double")
    want = {r.p: r.q_value for r in P.bh_qvalues(df, "p", ["i"]).groupBy("p").agg(F.max("q_value").alias("q_value")).collect()}
    got = P.bh_counted(df.withColumn("one", F.lit(1)), "p", "one").collect()
    assert {r.p: r.q_value for r in got} == pytest.approx(want)


def _sets(spark):
    rng = random.Random(7)
    rows = {(rng.randrange(4), rng.choice("BS"), rng.randrange(9), rng.randrange(1, 40)): rng.randrange(-5, 90) for _ in range(600)}
    return spark.createDataFrame([(s // 2, s, side, t * 100, w, n) for (s, side, t, w), n in rows.items()], "condition_id long, asset_id long, side string, sec long, wallet long, notional long")


def test_blocks_grow_but_parts_do_not(spark, monkeypatch):
    trades = _sets(spark)
    want = sorted(tuple(r) for r in G.cotrade_pairs(trades, 100, 1).collect())
    monkeypatch.setattr(pairs, "BLOCK", 3)
    monkeypatch.setattr(pairs, "BLOCKS", 2)
    cells, sizes = pairs.sent_blocks(G._presence(trades, 100), G._CELL, "condition_id", G._STRATUM, "bucket"), []
    assert cells.agg(F.max("_j")).first()[0] + 1 == 4  # 13 parts of 3 wallets, four a block
    blocks = [r.asDict() for r in cells.where("_i = _j").collect()]
    for row in blocks:
        sizes += [len(p[0]) for p in pairs._parts(pairs._unpack(row))]
    assert max(sizes) == 3 and sum(sizes) == 39
    assert sorted(tuple(r) for r in pairs.block_pairs(cells, 1).collect()) == want


def test_tasks_count_alike_pairs_themselves(spark):
    sent = pairs.sent_blocks(G._presence(_sets(spark), 100), G._CELL, "condition_id", G._STRATUM, "bucket")
    want = {(r.events, r.expected): r["count"] for r in pairs.block_pairs(sent, 1, expect=True).groupBy("events", "expected").count().collect()}
    rows = pairs.block_pairs(sent, 1, expect=True, count=True).collect()
    assert {(r.events, r.expected): r._m for r in rows} == want and len(rows) == len(want)
