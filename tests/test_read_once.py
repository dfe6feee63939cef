"""Queries that need the tape several times read it once; pairs are made where their group lies."""

import pytest

from tidemark.plans.registry import QUERIES, load

load()


@pytest.mark.parametrize("name", ["resumed_buckets", "winner_cotrade", "episodes", "correction_profit"])
def test_the_tape_is_read_once(name, spark, sf_dir, monkeypatch):
    scans, write = [], type(spark.range(0).write).parquet

    def told(plan):
        scans.append(plan.split("Physical Plan")[0].count("l_linenumber#") and plan.count("lineitem.parquet"))

    def seen(self, path, *a, **k):
        told(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *a, **k)

    monkeypatch.setattr(type(spark.range(0).write), "parquet", seen)
    told(QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString())
    assert sum(scans) == 1, scans
