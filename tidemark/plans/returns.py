"""Queries on markout and mirrored trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import paths as P
from tidemark.operators import population as N
from tidemark.operators.primitives import asof_forward, global_ntile, ratio, spearman
from tidemark.plans.base_sql import fills_sql, trades_sql
from tidemark.plans.flow import _BETS, _pnl_cte
from tidemark.plans.registry import query
from tidemark.sources.adapters import fills, trades, written_fills
from tidemark.sources.store import cut

#: Horizons are those of a dense tape times 1440: the synthetic one has about a fill a day and token.
HORIZONS = (86_400, 432_000, 1_296_000, 5_184_000, 124_416_000)
_TV = "tv as (select token_id, sec, sum(q * pc)::double / sum(q) as v, cast(sum(q) as bigint) as size, count(*) as n from f where is_taker group by 1, 2)"


@query(fills_sql("select token_id, sec, round(v, 8) as vwap, size, n from tv", _TV))
def taker_vwap_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.vwap(fills(spark, sf_dir).where("is_taker"), ["token_id", "sec"], "q")
    return out.withColumn("vwap", F.round("vwap", 8))


def _point(h: int) -> str:
    within = f"gap <= {h + max(2 * h, 900)}"
    return f"""select cast({h} as bigint) as horizon, count(*) as n, round(count(m) / count(*)::double, 8) as coverage, round(sum(cents * m) / nullif(sum(case when m is not null then cents end)::double, 0), 6) as weighted,
 round(avg(m), 6) as mean, round(count(*) filter (where m < -1e-9) / nullif(count(m), 0)::double, 8) as adverse, round(avg(case when m is not null then gap end), 6) as mean_gap
 from (select cents, gap, case when {within} then case when side = 'BUY' then v - pc else pc - v end end as m from (select k.cents, k.side, k.pc, x.v, x.sec - k.sec as gap from (select * from f where not is_taker) k asof left join tv x on k.token_id = x.token_id and k.sec + {h} <= x.sec))"""


@query(fills_sql(" union all ".join(_point(h) for h in HORIZONS), _TV))
def markout_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    tape = written_fills(spark, sf_dir, "token_id", "sec", "maker", "side", "pc", "q", "cents", "is_taker")
    makers = tape.where("not is_taker").select("token_id", "sec", "maker", "side", "pc", "cents")
    prices = P.vwap(tape.where("is_taker"), ["token_id", "sec"], "q")
    return P.markout_points(P.markouts(makers, prices, HORIZONS))


@query(fills_sql("""select cast(count(*) as bigint) as n, round(corr(a, b), 6) as rho from (select rank() over (order by vol) as a, rank() over (order by mk) as b from (
 select maker, sum(cents) as vol, round(sum(cents * m)::double / sum(case when m is not null then cents end), 9) as mk from (select maker, cents, case when gap <= 86400 * 3 then case when side = 'BUY' then v - pc else pc - v end end as m from (
  select k.*, x.v, x.sec - k.sec as gap from (select * from f where not is_taker and maker in (select maker from f where not is_taker group by 1 having count(*) >= 20)) k asof left join tv x on k.token_id = x.token_id and k.sec + 86400 <= x.sec)) group by maker) where mk is not null)""", _TV))
def markout_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of volume and markout over a subset of makers, those with twenty fills (O04, O05, A16: first places of ties)."""
    tape = fills(spark, sf_dir)
    makers = tape.where("not is_taker").select("token_id", "sec", "maker", "side", "pc", "cents")
    busy = makers.groupBy("maker").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("maker")
    marked = P.markouts(makers.join(busy, "maker", "left_semi"), P.vwap(tape.where("is_taker"), ["token_id", "sec"], "q"), [86_400])
    mean = ratio(F.sum(F.col("cents") * F.col("markout")), F.sum(F.when(F.col("markout").isNotNull(), F.col("cents"))))
    per = cut(marked.groupBy("maker").agg(F.sum("cents").alias("vol"), F.round(mean, 9).alias("mk")).where("mk is not null"))
    return spearman(per, "vol", "mk", ties="min").select("n", F.round("rho", 6).alias("rho"))


@query(fills_sql("""select decile, count(*) as makers, cast(sum(vol) as bigint) as volume, round(avg(mk), 6) as mean_markout from (select *, ntile(10) over (order by vol, maker) as decile from (
 select maker, sum(cents) as vol, sum(cents * m)::double / sum(case when m is not null then cents end) as mk from (select maker, cents, case when side = 'BUY' then x.v - k.pc else k.pc - x.v end as m from (select * from f where not is_taker) k asof left join tv x on k.token_id = x.token_id and k.sec + 86400 <= x.sec) group by maker)) group by decile""", _TV))
def markout_by_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makers by volume decile and their mean weighted markout a day later, whatever the gap."""
    tape = fills(spark, sf_dir)
    makers = tape.where("not is_taker").select("token_id", "sec", "maker", "side", "pc", "cents")
    later = asof_forward(makers, P.vwap(tape.where("is_taker"), ["token_id", "sec"], "q"), ["token_id"], "sec", "sec", "vwap", 86_400, "v")
    m = F.when(F.col("side") == "BUY", F.col("v") - F.col("pc")).otherwise(F.col("pc") - F.col("v"))
    per = later.withColumn("m", m).groupBy("maker").agg(F.sum("cents").alias("vol"), ratio(F.sum(F.col("cents") * F.col("m")), F.sum(F.when(F.col("m").isNotNull(), F.col("cents")))).alias("mk"))
    ranked = global_ntile(per, ["vol", "maker"], 10, "decile")
    return ranked.groupBy("decile").agg(F.count(F.lit(1)).alias("makers"), F.sum("vol").alias("volume"), F.round(F.avg("mk"), 6).alias("mean_markout"))


_EV = "ev as (select condition_id, coalesce(max(sec) filter (where (outcome_index = winner and pc < 95) or (outcome_index <> winner and pc > 5)), min(sec)) as event_sec from t group by 1)"
_SETS = """ls as (select wallet, name from (
 select wallet, 'top notional' as name, row_number() over (order by sum(notional) desc, wallet) as r from t group by wallet union all
 select wallet, 'top profit', row_number() over (order by sum(gross) desc, wallet) from pl group by wallet union all
 select wallet, 'calibrated', row_number() over (order by avg(won) - avg(implied) / 100 desc, wallet) from b group by wallet having count(*) >= 20 union all
 select wallet, 'active', row_number() over (order by count(*) desc, wallet) from t group by wallet union all
 select wallet, 'broad', row_number() over (order by count(distinct condition_id) desc, sum(notional) desc, wallet) from t group by wallet union all
 select wallet, 'sample', row_number() over (order by md5(wallet || '42'), wallet) from (select distinct wallet from t)) where r <= 20)"""
_LE = "le as (select t.* from t join ev using (condition_id) where notional >= 300000 and pc between 2 and 98 and sec <= event_sec and wallet in (select wallet from ls))"
_LEAD = [_BETS, _pnl_cte("t", "wallet", "size"), _SETS, _EV, _LE]


@query(trades_sql("select event_id, wallet, asset_id, condition_id, sec, notional from le", *_LEAD))
def leader_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaders(trades(spark, sf_dir)).select("event_id", "wallet", "asset_id", "condition_id", "sec", "notional")


def _leaders(tape: DataFrame) -> DataFrame:
    """Large trades of the six leader sets at middling prices, up to the market's event time."""
    chosen = N.leader_sets(tape).select("wallet").distinct()  # 120 rows at most
    found = tape.where("notional >= 300000 and pc between 2 and 98").join(F.broadcast(chosen), "wallet", "left_semi")
    return found.join(P.event_times(tape), "condition_id").where("sec <= event_sec")


@query(trades_sql("select leader_id, event_id, r as rank from (select e.event_id as leader_id, x.event_id, row_number() over (partition by e.event_id order by md5(cast(x.event_id as varchar) || '42'), x.event_id) as r from le e join t x on e.asset_id = x.asset_id and e.side = x.side and abs(e.sec - x.sec) <= 43200 and abs(e.pc - x.pc) <= 5 and e.wallet <> x.wallet) where r <= 3", *_LEAD))
def matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tape = cut(trades(spark, sf_dir))
    return P.matched_controls(_leaders(tape), tape, 43_200, 5, 3, "42").select("leader_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


_MV = "mv as (select asset_id, minute * 60 as sec, sum(size * pc)::double / sum(size) as v from t group by 1, 2), mk as (select condition_id, max(winner) as winner, max(sec) as close_sec from t group by 1)"


def _mirror_duck(h: int) -> str:
    return f"""select event_id, condition_id, wallet, cast({h} as bigint) as horizon, entry, x, case when side = 'BUY' then (x - entry) / entry else (entry - x) / (100 - entry) end as gross from (
 select e.*, case when close_sec <= e.sec + {h} then case when outcome_index = mk.winner then 100.0 else 0.0 end else px end as x from (
  select a.event_id, a.condition_id, a.wallet, a.side, a.outcome_index, a.sec, a.v as entry, a.vt as entry_t, b.v as px, b.vt as exit_t from
   (select le.*, mv.v, mv.sec as vt from le asof left join mv on le.asset_id = mv.asset_id and le.sec + 60 <= mv.sec) a join
   (select le.event_id, mv.v, mv.sec as vt from le asof left join mv on le.asset_id = mv.asset_id and le.sec + {h} >= mv.sec) b using (event_id)) e
 join mk using (condition_id) where entry_t - e.sec - 60 <= 86400 and (close_sec <= e.sec + {h} or exit_t > entry_t))"""


_MR = "mr as (" + " union all ".join(_mirror_duck(h) for h in (86_400, 604_800)) + ")"


def _mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders' trades entered a minute later and left at each horizon. The tape, minute prices and events are written once."""
    tape = cut(trades(spark, sf_dir))
    minute = cut(P.vwap(tape.withColumn("sec", F.col("minute") * 60), ["asset_id", "sec"], "size"))
    known = tape.groupBy("condition_id").agg(F.max("winner").alias("winner"), F.max("sec").alias("close_sec"))
    events = cut(_leaders(tape).select("event_id", "wallet", "asset_id", "condition_id", "outcome_index", "side", "sec"))
    parts = [P.mirror(events, minute, known, 60, 86_400, h, 20.0).withColumn("horizon", F.lit(h).cast("bigint")) for h in (86_400, 604_800)]
    return parts[0].union(parts[1])


@query(trades_sql("select event_id, wallet, horizon, round(entry, 6) as entry, round(x, 6) as exit, round(gross, 8) as gross, round(gross - 0.004, 8) as net from mr", *_LEAD, _MV, _MR))
def mirror_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, k).alias(c) for c, k in (("entry", 6), ("exit", 6), ("gross", 8), ("net", 8))]
    return _mirrored(spark, sf_dir).select("event_id", "wallet", "horizon", *rounded)


@query(trades_sql("""select horizon, cast(sum(n) as bigint) as n, round(sum(hits)::double / sum(n), 8) as hit_rate, round(sum(g) / sum(n), 6) as mean_gross, round(avg(g / n), 6) as market_mean, round(stddev_samp(g / n) / sqrt(count(*)), 6) as market_se
 from (select horizon, condition_id, count(*) as n, count(*) filter (where gross > 0) as hits, sum(gross) as g from mr group by 1, 2) group by 1""", *_LEAD, _MV, _MR))
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _mirrored(spark, sf_dir).groupBy("horizon", "condition_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gross") > 0).alias("hits"), F.sum("gross").alias("g"))
    mean = F.col("g") / F.col("n")
    return per.groupBy("horizon").agg(
        F.sum("n").alias("n"), F.round(ratio(F.sum("hits"), F.sum("n")), 8).alias("hit_rate"), F.round(F.sum("g") / F.sum("n"), 6).alias("mean_gross"),
        F.round(F.avg(mean), 6).alias("market_mean"), F.round(F.stddev_samp(mean) / F.sqrt(F.count(F.lit(1))), 6).alias("market_se"),
    )
