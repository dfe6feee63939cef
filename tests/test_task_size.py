"""Tasks hold a bounded number of rows whatever the size of the input."""

from tidemark.plans.registry import QUERIES, load
from tidemark.sources import adapters

load()


def test_the_tape_is_dealt_by_its_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(adapters, "TASK_ROWS", 100)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name in ("dedup_first", "both_sides"):
        assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == -(-rows // 100)


def test_aggregates_by_transaction_stay_where_the_tape_lies(spark, sf_dir):
    for name in ("both_sides", "coverage_gain"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Union" not in plan and "Expand" not in plan, name


def test_shuffled_rows_keep_their_order_over_buckets(spark, monkeypatch):
    """Places by buckets of the hash are those of one sort, null strata included, and no hash is shuffled."""
    import hashlib
    import random

    from tidemark.operators import effects

    monkeypatch.setattr(effects, "TASK_ROWS", 7)
    rng = random.Random(2)
    data = [(rng.choice([None, 1, 2]), i, rng.randrange(5), rng.randrange(100)) for i in range(90)]
    df = spark.createDataFrame(data, "s long, w long, c long, v long")
    out = effects.shuffled_within(df, "s", ["w", "c"], "v", 3)
    want = set()
    for s in (None, 1, 2):
        rows = sorted(r for r in data if r[0] == s) if s else [r for r in data if r[0] is None]
        for draw in range(3):
            order = sorted(rows, key=lambda r: (hashlib.md5(f"42:{draw}:{r[1]}:{r[2]}".encode()).hexdigest(), r[1:3]))
            want |= {(draw, w, c, s, v[3]) for (_, w, c, _), v in zip(order, sorted(rows, key=lambda r: r[1:3]))}
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS _h#") < plan.index("RepartitionByExpression")


def test_ranges_of_intervals_grow_in_number(spark, monkeypatch):
    from tidemark.operators import primitives

    monkeypatch.setattr(primitives, "RANGE_ROWS", 20)
    ranges = []
    read = primitives.cut
    monkeypatch.setattr(primitives, "cut", lambda df: ("_range" in df.columns and ranges.append(df.rdd.getNumPartitions())) or read(df))
    df = spark.range(100).selectExpr("id % 3 as k", "id * 10 as lo", "id * 10 + 5 as hi")
    gaps = sorted(map(tuple, primitives.interval_gaps(df, ["k"], "lo", "hi").collect()))
    assert gaps == sorted((i % 3, i * 10 + 6, i * 10 + 29) for i in range(97))
    assert max(ranges) >= 10
