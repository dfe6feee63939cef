"""The panel of markets and days is dealt into tasks by its rows."""

from tidemark.plans.registry import QUERIES, load
from tidemark.sources import adapters

load()


def test_the_panel_is_dealt_by_its_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(adapters, "TASK_ROWS", 1_000)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    out = QUERIES["market_day_panel"](spark, sf_dir)
    plan = out._jdf.queryExecution()
    assert f"hashpartitioning(condition_id#" in plan.executedPlan().toString() and f", {-(-2 * rows // 1_000)}), REPARTITION_BY_NUM" in plan.executedPlan().toString()
    assert "Expand" not in plan.optimizedPlan().toString() and "distinct" not in plan.optimizedPlan().toString()
    assert out.selectExpr("sum(n) as n").first().n == adapters.fills(spark, sf_dir).count()
