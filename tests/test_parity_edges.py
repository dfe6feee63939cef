"""Queries against their SQL on small tables with the rows that larger tables hold."""

import math
from datetime import datetime, timedelta

import duckdb
import pytest

from tidemark.plans.registry import ORACLES, QUERIES, load

load()


def _events(spark, path, rows):
    """rows: second, wallet, event type, value, k."""
    at = datetime(2024, 1, 1)
    data = [(i, at + timedelta(seconds=s), w, kind, float(v), f'{{"k": {k}}}') for i, (s, w, kind, v, k) in enumerate(rows)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    return duck


def _same(spark, duck, name, path):
    out = QUERIES[name](spark, str(path))
    cols = sorted(out.columns)
    plain = lambda r: tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)
    got = sorted((plain(r) for r in out.select(cols).collect()), key=repr)
    want = sorted((plain(r) for r in duck.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, rel=1e-12, nan_ok=True) if all(isinstance(v, (int, float)) for v in (*g, *w)) else g == w
    return got


def test_interpolation_rounds_as_sql_and_borrows_no_price(spark, tmp_path):
    """Halves at the sixth place fall as in SQL, and a second whose trades have no size gives no value."""
    rows = [(0, 1, "purchase", 3.0, 0), (64 * 49, 1, "purchase", 5.0, 0)]
    rows += [(s, 2, "click", 1.0, 0) for s in range(7, 64 * 49, 7)]
    rows += [(5000, 1, "purchase", 0.0, 0), (5000, 3, "error", 1.0, 0), (5100, 3, "error", 1.0, 0), (5200, 1, "view", 2.0, 0)]
    rows += [(0, 4, "purchase", 1.0, 1), (1280, 4, "purchase", 1.0, 1), *[(s, 4, "click", 1.0, 1) for s in range(1, 1280, 11)]]
    got = _same(spark, _events(spark, tmp_path, rows), "interp_linear", tmp_path)
    assert sum(v == "nan" for _, v in got) == 2
