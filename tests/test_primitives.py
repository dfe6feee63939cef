"""Edge cases of the building blocks."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.plain import louvain
from tidemark.operators import concentration as C
from tidemark.operators import primitives as P
from tidemark.operators import skill as K
from tidemark.operators.graph import connected_components
from tidemark.operators.paths import markouts


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_dedup_keeps_first_of_total_order(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 1, 3), (2, 1, 9)], "tx long, e long, b long")
    assert rows(P.dedup_first(df, ["tx", "e"], ["b"]), "tx", "b") == [(1, 3), (2, 9)]


def test_asof_boundaries(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 5, "c")], "k long, t long, id string")
    right = spark.createDataFrame([(1, 20, 7), (1, 30, 8)], "k long, t2 long, v long")
    assert rows(P.asof_forward(left, right, ["k"], "t", "t2", "v", 10), "id", "next", "next_t") == [("a", 7, 20), ("b", 8, 30), ("c", None, None)]
    assert rows(P.asof_backward(left, right, ["k"], "t", "t2", "v", 10), "id", "last") == [("a", 7), ("b", 7), ("c", None)]


def test_markout_grace_window(spark):
    makers = spark.createDataFrame([(1, 0, "BUY", 40, 100), (2, 0, "SELL", 40, 100), (3, 0, "BUY", 40, 100)], "token_id long, sec long, side string, pc long, cents long")
    prices = spark.createDataFrame([(1, 960, 50.0), (2, 961, 50.0), (3, 60, 40.0)], "token_id long, sec long, vwap double")
    assert rows(markouts(makers, prices, [60]), "token_id", "markout") == [(1, 10.0), (2, None), (3, 0.0)]
    both = markouts(makers, prices, [60, 900])
    assert rows(both.where("horizon = 900"), "token_id", "markout") == [(1, 10.0), (2, -10.0), (3, None)]


def test_band_join_meets_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0), (1, 10), (1, 25)], "k long, x long")
    b = spark.createDataFrame([(1, 10), (1, 20), (1, -10)], "k long, y long")
    got = rows(P.band_join(a, b, ["k"], "x", "y", 10), "x", "y")
    assert got == sorted((x, y) for x in (0, 10, 25) for y in (10, 20, -10) if abs(x - y) <= 10)


def test_gini_edges(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 1, 4), (2, 2, 4), (3, 1, 0)], "m long, w long, a long")
    out = {r.m: r for r in C.concentration(C.wallet_weights(df, ["m"], "w", "a"), ["m"]).collect()}
    assert out[1].gini is None and abs(out[2].gini) < 1e-12 and 3 not in out


def test_covered_sell(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, "BUY", 2, 50), (1, 0, 0, 0, "SELL", 4, 60), (2, 0, 0, 0, "SELL", 4, 60)], "wallet long, condition_id long, outcome_index long, winner long, side string, size long, pc long")
    out = {r.wallet: r.covered for r in K.covered_pnl(df).collect()}
    assert out == {1: 2 * 50 - 0.5 * 4 * 40, 2: 0.0}


def test_positions_drop_flat_and_single_bench_is_null(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, "BUY", 2, 50), (1, 1, 1, 0, "BUY", 2, 50), (2, 1, 0, 0, "BUY", 1, 30)], "wallet long, condition_id long, outcome_index long, winner long, side string, size long, pc long")
    assert rows(K.positions(df), "wallet", "bench_loo") == [(2, None)]


def test_interval_gaps(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 3, 5), (1, 6, 7), (1, 10, 12)], "k long, a long, b long")
    assert rows(P.interval_gaps(df, ["k"], "a", "b"), "gap_low", "gap_high") == [(8, 9)]


def test_global_ntile_matches_window(spark):
    from pyspark.sql.window import Window

    df = spark.range(103).withColumn("x", F.col("id") * 7 % 103)
    want = rows(df.withColumn("t", F.ntile(10).over(Window.orderBy("x"))), "id", "t")
    assert rows(P.global_ntile(df, ["x"], 10), "id", "tile") == want


def test_asof_is_the_nearest_whatever_the_chunk(spark):
    rng = random.Random(3)
    left = [(rng.randrange(3) or None, rng.randrange(-500, 500), i) for i in range(200)]
    right = [(rng.randrange(3) or None, rng.randrange(-500, 500), rng.randrange(50)) for _ in range(120)]
    a, b = spark.createDataFrame(left, "k long, t long, id long"), spark.createDataFrame(right, "k long, t2 long, v long")
    for chunk in (7, 100, 10_000):
        ahead = {r.id: (r.next_t, r.next) for r in P.asof_forward(a, b, ["k"], "t", "t2", "v", 20, chunk=chunk).collect()}
        back = {r.id: (r.last_t, r.last) for r in P.asof_backward(a, b, ["k"], "t", "t2", "v", chunk=chunk).collect()}
        for k, t, i in left:
            after = min(((t2, -v) for k2, t2, v in right if k2 == k is not None and t2 >= t + 20), default=(None, None))
            before = max(((t2, v) for k2, t2, v in right if k2 == k is not None and t2 <= t), default=(None, None))
            assert (ahead[i][0], back[i]) == (after[0], before) and (after[0] is None or ahead[i][1] in {v for k2, t2, v in right if (k2, t2) == (k, after[0])})


def test_running_values_are_those_of_plain_windows(spark):
    from pyspark.sql.window import Window

    rng = random.Random(5)
    df = spark.createDataFrame([(rng.randrange(2), rng.randrange(60), i, rng.choice([None, 1, 2, 3])) for i in range(150)], "k long, t long, i long, x long")
    w = Window.partitionBy("k").orderBy("t", "i")
    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns({"s": F.sum(F.coalesce("x", F.lit(0))).over(upto), "l": F.last("x", True).over(upto), "b": F.last("x", True).over(prior)})
    for chunk in (1, 9, 1000):
        got = P.running(df, ["k"], ["t", "i"], chunk, sums={"s": F.coalesce("x", F.lit(0))}, last={"l": F.col("x")}, before={"b": F.col("x")})
        assert rows(got.fillna(-1), "i", "s", "l", "b") == rows(want.fillna(-1), "i", "s", "l", "b") and set(got.columns) == set(want.columns)


def test_ranks_and_q_values_by_ranges(spark):
    from tidemark.functions.inference import bh_qvalues

    rng = random.Random(6)
    data = [(i, rng.randrange(12), rng.random()) for i in range(90)]
    df = spark.createDataFrame(data, "i long, x long, p double")
    for ties, place in (("average", lambda v: sum(x < v for _, x, _ in data) + (sum(x == v for _, x, _ in data) + 1) / 2), ("min", lambda v: sum(x < v for _, x, _ in data) + 1)):
        assert rows(P.average_ranks(df, ["x"], ties), "i", "rank_x") == [(i, place(x)) for i, x, _ in data]
    got = dict(rows(P.bh_qvalues(df, "p", ["i"]), "i", "q_value"))
    assert [got[i] for i in range(90)] == pytest.approx(list(bh_qvalues([p for _, _, p in data])))


def test_quantiles_from_counted_values(spark):
    rng = random.Random(8)
    data = [(rng.choice([None, 1, 2]), rng.choice([None, 0.5, 1.25, 1.25, 7.0, rng.random()])) for _ in range(120)] + [(3, 4.0), (4, None)]
    df = spark.createDataFrame(data, "k long, v double")
    asked = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r.k: r for r in P.counted_quantiles(df, ["k"], "v", asked).collect()}
    assert set(got) == {None, 1, 2, 3}
    for k, r in got.items():
        want = np.quantile([v for key, v in data if key == k and v is not None], list(asked.values()))
        assert [r[c] for c in asked] == pytest.approx(list(want))


def test_narrow_dedup_keeps_what_the_window_keeps(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2]), rng.randrange(3)) for _ in range(80)], "k long, a long, b long")
    assert sorted(map(repr, P.dedup_narrow(df, ["k"], ["a", "b"]).collect())) == sorted(map(repr, P.dedup_first(df, ["k"], ["a", "b"]).collect()))


def test_components_and_communities(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21)], "a long, b long")
    assert rows(connected_components(edges), "node", "component") == [(i, 1) for i in range(1, 10)] + [(20, 20), (21, 20)]
    clique = lambda at: [(i, j, 1.0) for i in range(at, at + 5) for j in range(i + 1, at + 5)]
    label = louvain(clique(0) + clique(10) + [(0, 10, 0.1)])
    assert set(label.values()) == {0, 10}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k long, t long, v long")
    other = spark.createDataFrame([], "k long, t2 long, w long")
    assert P.asof_forward(none, other, ["k"], "t", "t2", "w").count() == 0
    assert P.band_join(none, other, ["k"], "t", "t2", 5).count() == 0
    assert P.bh_qvalues(none.withColumn("p", F.lit(0.5)), "p", ["k"]).count() == 0
    assert P.average_ranks(none, ["v"]).count() == 0 and P.global_ntile(none, ["v"], 4).count() == 0
    assert C.concentration(none.select(F.col("k").alias("wallet"), F.col("v").alias("w")), []).first().n == 0
    assert P.running(none, ["k"], ["t"], 10, sums={"s": F.col("v")}).count() == 0


def test_no_window_over_raw_rows_in_one_task(spark, sf_dir):
    """A window without keys is allowed only over one row a range or bucket; ranks over wallets, pairs or fills go by ranges."""
    from tidemark.plans.registry import QUERIES, load

    load()
    for name in ("platform_concentration", "topshare_profile", "universe_union_topn", "quartile_band_crosstab", "maker_decile_economics", "account_type_decile", "bh_qvalues", "cotrade_significance", "rank_deciles", "markout_by_decile", "top_fee_payers", "correction_concentration", "coded_trades"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        for window in re.findall(r"Window \[.*", plan):
            first = window.split("windowspecdefinition(", 1)[1].split(",", 1)[0]
            alone = " ASC" in first or " DESC" in first or first.startswith("specifiedwindowframe")
            assert not alone or first.split("#", 1)[0] in ("_range", "bucket"), (name, window)


def test_plans_have_no_cartesian_product(spark, sf_dir):
    from tidemark.plans.registry import QUERIES, load

    load()
    for name in ("markout_curve", "cotrade_pairs", "roundtrip_match", "convergence_offsets"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
