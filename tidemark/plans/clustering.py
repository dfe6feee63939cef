"""Clustering of trade times, changes of price level, odd wallets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import forest as I
from tidemark.operators import points as P
from tidemark.plans.base_sql import fills_sql
from tidemark.plans.registry import query
from tidemark.sources.adapters import fills, trades
from tidemark.sources.store import cut

_STEPS = 3


def _round(k: int) -> list[str]:
    """One round of EM over all pairs of a market's minutes."""
    return [
        f"pw{k} as materialized (select a.id, a.t, any_value(a.m) as m, coalesce(sum(b.m * exp(-p.decay * (a.t - b.t))), 0) as near, coalesce(sum(b.m * (a.t - b.t) * exp(-p.decay * (a.t - b.t))), 0) as lag from mt a join hk{k} p using (id) left join mt b on a.id = b.id and b.t < a.t group by 1, 2)",
        f"""hk{k + 1} as materialized (select id, lo, hi, n, own / (hi - lo) as base, led / past as branching, led / (wait + br * edge) as decay, lg - ba * (hi - lo) - br * past as loglik from (
 select id, any_value(lo) as lo, any_value(hi) as hi, any_value(n) as n, any_value(base) as ba, any_value(branching) as br, sum(m * base / (base + branching * decay * near)) as own, sum(m * branching * decay * near / (base + branching * decay * near)) as led,
  sum(m * branching * decay * lag / (base + branching * decay * near)) as wait, sum(m * (1 - exp(-decay * (hi - t)))) as past, sum(m * (hi - t) * exp(-decay * (hi - t))) as edge, sum(m * ln(base + branching * decay * near)) as lg from pw{k} join hk{k} using (id) group by 1))""",
    ]


_HAWKES = [
    "mt as materialized (select condition_id as id, minute as t, count(*) as m from f group by 1, 2)",
    "hk0 as materialized (select id, min(t) as lo, max(t) as hi, cast(sum(m) as bigint) as n, 0.5 * sum(m) / (max(t) - min(t)) as base, 0.5::double as branching, 10.0 * sum(m) / (max(t) - min(t)) as decay from mt group by 1 having min(t) < max(t))",
    *[c for k in range(_STEPS) for c in _round(k)],
]


@query(fills_sql(f"select id as condition_id, n, round(base * 1440, 8) as base_a_day, round(branching, 8) as branching, round(decay * 1440, 8) as decay_a_day, round(loglik, 6) as loglik from hk{_STEPS}", *_HAWKES))
def trade_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far trades of a market call forth trades: a Hawkes process in minutes, after three rounds of EM for all markets at once."""
    fit = P.hawkes(fills(spark, sf_dir), "condition_id", "minute", _STEPS)
    return fit.select("condition_id", "n", F.round(F.col("base") * 1440, 8).alias("base_a_day"), F.round("branching", 8).alias("branching"), F.round(F.col("decay") * 1440, 8).alias("decay_a_day"), F.round("loglik", 6).alias("loglik"))


@query()
def level_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each market and day, how long its mean price is believed to have kept its level, and whether it has just changed."""
    daily = fills(spark, sf_dir).where("outcome_index = 0").groupBy("condition_id", "day").agg((F.sum("cents").cast("double") / (F.sum("q") * 100)).alias("price"))
    return P.change_points(daily, "condition_id", "day", "price", hazard=0.01, prior=(0.5, 1.0, 1.0, 0.05))


@query()
def odd_wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How easily each wallet is set apart by what it trades, how much, where and when: an isolation forest over all wallets."""
    tape = trades(spark, sf_dir)
    share = lambda c: F.avg(c.cast("int"))
    per = tape.groupBy("wallet").agg(
        F.log(F.count(F.lit(1))).alias("orders"), F.log(F.greatest(F.sum("notional"), F.lit(1))).alias("notional"), F.countDistinct("asset_id").cast("double").alias("assets"), share(F.col("side") == "BUY").alias("buys"),
        F.avg(F.abs(F.col("pc") - 50)).alias("extremity"), share(F.expr("sec div 3600 % 24 < 6")).alias("night"),
    )
    return I.isolation(cut(per), "wallet", ["orders", "notional", "assets", "buys", "extremity", "night"]).select("wallet", F.round("depth", 8).alias("depth"), F.round("score", 8).alias("score"))
