"""Keys are tried by buckets, from one reading of their rows, with the p of each key alone."""

import random

import pytest

from tidemark.functions import inference as I


@pytest.mark.parametrize("values", [30, 100_000])
def test_buckets_of_keys_give_each_keys_own_p(spark, monkeypatch, values):
    monkeypatch.setattr(I, "BUCKET_VALUES", values, raising=False)
    rng = random.Random(3)
    data = [(k, float(rng.randrange(-9, 12))) for k in ["a", "b", "c", "d", None] for _ in range(rng.randrange(8, 20))]
    out = I.sign_flip(spark.createDataFrame(data, "k string, v double"), "k", "v", n=300)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "LogicalRDD" not in plan  # no Python call a key, no second reading
    got = {r.k: (r.n, r.p_up, r.p_down) for r in out.collect()}
    for k in ["a", "b", "c", "d"]:
        x = sorted(v for name, v in data if name == k)
        some = len(x) >= 10
        assert got[k] == (len(x), *((I.sign_flip_p(x, 300, k), I.sign_flip_p([-v for v in x], 300, k)) if some else (None, None)))
    assert got[None][1:] == (None, None)
