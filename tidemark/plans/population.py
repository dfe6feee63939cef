"""Queries on the skill of populations, markets' winners, entities and leader sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import concentration as C
from tidemark.operators import coordination as G
from tidemark.operators import graph
from tidemark.operators import population as N
from tidemark.operators import skill as K
from tidemark.operators.primitives import global_ntile, ratio, top_k
from tidemark.plans.base_sql import fills_sql, trades_sql
from tidemark.plans.behaviour import _FUND, _PAIRS, _PRES, COTRADE_S, _funding
from tidemark.plans.flow import _BETS, _FBETS, _pnl_cte
from tidemark.plans.registry import query
from tidemark.plans.returns import _SETS
from tidemark.sources.adapters import fills, trades
from tidemark.sources.store import cut

_PL = _pnl_cte("f", "taker", "q")
_WM = "wm as (select wallet, condition_id, cast(sum(gross) as bigint) as pnl, cast(sum(n) as bigint) as n from pl group by 1, 2)"


def _profits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (wallet, market): profit and fills."""
    return K.covered_pnl(fills(spark, sf_dir), "taker", "q").groupBy("wallet", "condition_id").agg(F.sum("gross").alias("pnl"), F.sum("n").alias("n"))


@query(fills_sql("""select wallet, n, wins, round(p, 7) as p, round(least(min(p * m / r) over (order by r desc rows unbounded preceding), 1.0), 7) as q_value from (select *, row_number() over (order by p, wallet) as r, count(*) over () as m from (
 select wallet, n, wins, case when wins <= 0 then 1.0 else least(1.0, list_sum(list_transform(range(wins, n + 1), lambda j: exp(lgamma(n + 1) - (case when j = 0 then 0 else lgamma(j + 1) end) - (case when n - j = 0 then 0 else lgamma(n - j + 1) end) + j * ln(rate) + (n - j) * ln(1 - rate))))) end as p from (
  select taker as wallet, count(*) as n, cast(sum(won) as bigint) as wins, sum(implied)::double / (count(*) * 100) as rate from fb group by 1 having count(*) >= 10)))""", _FBETS))
def binomial_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallets that win more often than their prices say: exact binomial tails and q-values."""
    out = N.binomial_skill(K.bets(fills(spark, sf_dir)), "taker")
    return out.select("wallet", "n", F.col("wins").cast("bigint").alias("wins"), F.round("p", 7).alias("p"), F.round("q_value", 7).alias("q_value"))


@query()
def population_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many wallets look skilled at 5 %, and how many would by chance, in 200 simulated worlds."""
    return N.simulated_discoveries(K.bets(fills(spark, sf_dir)), wallet="taker")


@query(fills_sql("select count(*) as n, round(corr(a, b), 6) as rho from (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as a, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as b from (select wallet, sum(case when substr(md5(condition_id || '42'), 1, 1) < '8' then pnl else 0 end) as x, sum(case when substr(md5(condition_id || '42'), 1, 1) < '8' then 0 else pnl end) as y from wm group by 1))", _PL, _WM))
def split_half_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do wallets that earn in one half of their markets earn in the other (B09)?"""
    return N.split_half(_profits(spark, sf_dir)).select("n", F.round("rho", 6).alias("rho"))


@query(fills_sql("""select quintile, count(*) as wallets, cast(sum(before) as bigint) as before, cast(sum(after) as bigint) as after, round(avg((after > 0)::int), 8) as winners_after from (select *, ntile(5) over (order by before, wallet) as quintile from (
 select wallet, sum(pnl) filter (where close_sec <= mid) as before, sum(pnl) filter (where close_sec > mid) as after from wm join (select condition_id, max(sec) as close_sec from f group by 1) using (condition_id), (select median(c) as mid from (select max(sec) as c from f group by condition_id)) group by 1) where before is not null and after is not null) group by 1""", _PL, _WM))
def quintile_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallets by quintile of profit in markets that closed early, and what they earned in the rest."""
    tape = fills(spark, sf_dir)
    close = tape.groupBy("condition_id").agg(F.max("sec").alias("close_sec"))
    mid = close.agg(F.median("close_sec").alias("mid"))
    early = close.crossJoin(F.broadcast(mid)).select("condition_id", (F.col("close_sec") <= F.col("mid")).alias("early"))
    return N.quintile_persistence(_profits(spark, sf_dir).join(early, "condition_id"), "early")


_QUART = "qt as (select wallet, ntile(4) over (order by sum(notional), wallet) as quartile from t group by wallet)"


def _quartiles(tape: DataFrame) -> DataFrame:
    return cut(global_ntile(tape.groupBy("wallet").agg(F.sum("notional").alias("w")), ["w", "wallet"], 4, "quartile").select("wallet", "quartile"))


@query(trades_sql("""select quartile, cast(sum(n) as bigint) as bets, count(*) as wallets, round(max(gap), 8) as gap, round(sqrt(sum(power(edge / 100.0 - n * gap, 2))) / sum(n), 8) as se from (
 select quartile, n, edge, sum(edge) over (partition by quartile)::double / (sum(n) over (partition by quartile) * 100) as gap from (select wallet, count(*) as n, sum(won * 100 - implied) as edge from b group by 1) join qt using (wallet)) group by 1""", _BETS, _QUART))
def quartile_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration gap by quartile of account size, errors clustered by wallet."""
    tape = trades(spark, sf_dir)
    return N.clustered_gap(K.bets(tape), _quartiles(tape), "quartile")


@query()
def quartile_gap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the largest accounts' gap less the smallest ones', drawing wallets again."""
    tape = trades(spark, sf_dir)
    return N.bootstrap_difference(K.bets(tape), _quartiles(tape), "quartile", 1, 4)


@query(trades_sql("select wallet, count(*) as n, count(distinct condition_id) as markets, cast(sum(won) as bigint) as wins, round(avg(bench), 6) as bench from (select wallet, condition_id, won, cast(sum(won) over (partition by decile) - won as double) / nullif(count(*) over (partition by decile) - 1, 0) as bench from pos) where bench is not null group by 1 having count(*) >= 5 and count(distinct condition_id) >= 3",
    """pos as (select wallet, condition_id, p, won, cast(least(floor(p / 10), 9) as bigint) as decile from (
 select wallet, condition_id, case when net > 0 then wp::double / w else 100 - wp::double / w end as p, case when (net > 0) = (winner = 0) then 1 else 0 end as won from (
  select wallet, condition_id, sum(case when (side = 'BUY') = (outcome_index = 0) then size else -size end) as net, sum(size * case when outcome_index = 0 then pc else 100 - pc end) as wp, sum(size) as w, max(winner) as winner from t group by 1, 2) where net <> 0 and w > 0) where p between 5 and 95)"""))
def position_wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What position_posterior is worked out from: positions, wins and the benchmark of others."""
    per = K.positions(trades(spark, sf_dir)).where("bench_loo is not null").groupBy("wallet").agg(
        F.count("*").alias("n"), F.countDistinct("condition_id").alias("markets"), F.sum("won").cast("bigint").alias("wins"), F.round(F.avg("bench_loo"), 6).alias("bench")
    )
    return per.where("n >= 5 and markets >= 3")


@query(fills_sql("""select weight, bin, n, round(mean, 8) as mean_implied, round(rate, 8) as win_rate from (
 select 'count' as weight, least(implied // 10, 9) as bin, count(*) as n, sum(implied)::double / (count(*) * 100) as mean, sum(won)::double / count(*) as rate from fb group by 2 union all
 select 'notional', least(implied // 10, 9), count(*), sum(cents * implied)::double / (sum(cents) * 100), sum(cents * won)::double / sum(cents) from fb where cents > 0 group by 2)""", _FBETS))
def reliability_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reliability table by count and by notional."""
    bet = K.bets(fills(spark, sf_dir)).withColumn("one", F.lit(1))
    parts = [K.reliability(bet.where("cents > 0") if w == "cents" else bet, weight=w).select(F.lit(name).alias("weight"), "bin", "n", "mean_implied", "win_rate") for w, name in (("one", "count"), ("cents", "notional"))]
    return parts[0].union(parts[1])


@query(fills_sql("""select condition_id, round(sum(case when r <= 5 then pnl else 0 end)::double / sum(pnl), 8) as top5_share, round(case when count(*) > 1 then 2 * sum(i * pnl)::double / (count(*) * sum(pnl)::double) - (count(*) + 1) / count(*)::double end, 8) as gini from (
 select *, row_number() over (partition by condition_id order by pnl, wallet) as i, row_number() over (partition by condition_id order by pnl desc, wallet) as r from wm where pnl > 0) group by 1""", _PL, _WM))
def market_winner_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How concentrated each market's winnings are."""
    won = _profits(spark, sf_dir).where("pnl > 0").select("condition_id", "wallet", F.col("pnl").alias("w"))
    return C.concentration(won, ["condition_id"], (5,)).select("condition_id", F.col("top5").alias("top5_share"), "gini")


@query(fills_sql("""select board, rank, wallet, pnl from (select 'all' as board, row_number() over (order by sum(pnl) desc, wallet) as rank, wallet, cast(sum(pnl) as bigint) as pnl from wm group by wallet
 union all select 'class ' || condition_id % 7, row_number() over (partition by condition_id % 7 order by sum(pnl) desc, wallet), wallet, cast(sum(pnl) as bigint) from wm group by condition_id % 7, wallet) where rank <= 15""", _PL, _WM))
def leaderboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifteen wallets by profit, overall and by class."""
    per = _profits(spark, sf_dir)
    by_class = per.groupBy(F.concat(F.lit("class "), F.col("condition_id") % 7).alias("board"), "wallet").agg(F.sum("pnl").alias("pnl"))
    best = top_k(by_class, ["board"], [F.col("pnl").desc(), "wallet"], 15)
    first = per.groupBy("wallet").agg(F.sum("pnl").alias("pnl")).orderBy(F.col("pnl").desc(), "wallet").limit(15).withColumn("board", F.lit("all"))
    return top_k(first, ["board"], [F.col("pnl").desc(), "wallet"], 15).unionByName(best).select("board", "rank", "wallet", "pnl")


@query(fills_sql("""select coalesce(g.taker, x.taker) as wallet, coalesce(gross, 0) as gross, coalesce(fee, 0) as fee, coalesce(gross, 0) * 10000 - coalesce(fee, 0) as net
 from (select taker, cast(sum(q * (case when outcome_index = winner then 100 else 0 end - pc) * case when side = 'BUY' then -1 else 1 end) as bigint) as gross from f where not is_taker group by 1) g
 full join (select taker, cast(sum(fee) as bigint) as fee from f where is_taker or fee_paying group by 1) x on g.taker = x.taker"""))
def wallet_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross from maker rows, fees from the others, net by wallet, joined in full."""
    tape = fills(spark, sf_dir)
    payout, sign = F.when(F.col("outcome_index") == F.col("winner"), 100).otherwise(0), F.when(F.col("side") == "BUY", -1).otherwise(1)
    gross = tape.where("not is_taker").groupBy("taker").agg(F.sum(F.col("q") * (payout - F.col("pc")) * sign).alias("gross"))
    fee = tape.where("is_taker or fee_paying").groupBy("taker").agg(F.sum("fee").alias("fee"))
    g, f = F.coalesce("gross", F.lit(0)), F.coalesce("fee", F.lit(0))
    return gross.join(fee, "taker", "full").select(F.col("taker").alias("wallet"), g.alias("gross"), f.alias("fee"), (g * 10000 - f).alias("net"))


@query(fills_sql("""select decile, year, count(distinct maker) as makers, cast(sum(pnl) as bigint) as pnl, round(sum(lost)::double / sum(n), 8) as counterparty_win_rate from (
 select maker, month // 12 as year, sum(q * (case when outcome_index = winner then 100 else 0 end - pc) * case when side = 'BUY' then 1 else -1 end) as pnl, count(*) as n, count(*) filter (where (side = 'BUY') <> (outcome_index = winner)) as lost from f where not is_taker group by 1, 2)
 join (select maker, ntile(10) over (order by count(distinct condition_id), maker) as decile from f where not is_taker group by maker) using (maker) group by 1, 2"""))
def maker_breadth_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makers by decile of the number of their markets, by year: profit and how often the other side wins."""
    made = fills(spark, sf_dir).where("not is_taker")
    payout, sign = F.when(F.col("outcome_index") == F.col("winner"), 100).otherwise(0), F.when(F.col("side") == "BUY", 1).otherwise(-1)
    lost = (F.col("side") == "BUY") != (F.col("outcome_index") == F.col("winner"))
    per = made.groupBy("maker", F.expr("month div 12").alias("year")).agg(F.sum(F.col("q") * (payout - F.col("pc")) * sign).alias("pnl"), F.count(F.lit(1)).alias("n"), F.count_if(lost).alias("lost"))
    deciles = global_ntile(made.groupBy("maker").agg(F.countDistinct("condition_id").alias("markets")), ["markets", "maker"], 10, "decile").select("maker", "decile")
    return per.join(deciles, "maker").groupBy("decile", "year").agg(F.count(F.lit(1)).alias("makers"), F.sum("pnl").alias("pnl"), F.round(ratio(F.sum("lost"), F.sum("n")), 8).alias("counterparty_win_rate"))


# Entities: transfers between wallets of a universe are the direct evidence, rare shared neighbours the indirect one.

_DIRECT = "de as (select least(maker, taker) as a, greatest(maker, taker) as b, count(*) as n, cast(sum(cents) as bigint) as total from f where maker <> taker and cents >= 2000 group by 1, 2)"
_NEIGH = "ng as (select distinct maker as node, taker as via from f where cents >= 2000 and maker <> taker union select distinct taker, maker from f where cents >= 2000 and maker <> taker), po as (select via, count(*) as d from ng group by 1), ce as (select x.node as a, y.node as b, count(*) as shared, sum(1.0::double / d) as weight from ng x join ng y using (via) join po using (via) where x.node < y.node and d < 20 group by 1, 2)"
_GRAPH = "ge as (select coalesce(de.a, ce.a) as a, coalesce(de.b, ce.b) as b, case when de.a is not null then 'direct' else 'common' end as kind, case when de.a is not null then total / 10000.0::double else weight end as weight, coalesce(shared, 0) as shared from de full join ce on de.a = ce.a and de.b = ce.b)"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fills(spark, sf_dir).select(F.col("maker").alias("source"), F.col("taker").alias("target"), "cents")
    return graph.entity_edges(moved, "cents", 2000, 20, 10_000.0)


@query(fills_sql("select a, b, kind, round(weight, 8) as weight, shared from ge", _DIRECT, _NEIGH, _GRAPH))
def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct edges of large transfers, else shared neighbours that are not popular, rare ones weighing more."""
    return _entities(spark, sf_dir).select("a", "b", "kind", F.round("weight", 8).alias("weight"), "shared")


_COMP = ["k as (select a, b from fe where shared >= 2 union all select b, a from fe where shared >= 2)", "r(id, c) as (select distinct a, a from k union select k.b, r.c from r join k on k.a = r.id where r.c < k.b)", "cc as (select id as node, min(c) as component from r group by 1)"]


@query(fills_sql("select component, count(*) as members, cast(sum(vol) as bigint) as volume, cast(sum(pnl) as bigint) as pnl from cc join (select wallet, sum(pnl) as pnl from wm group by 1) p on p.wallet = node join (select taker, sum(cents) as vol from f group by 1) v on v.taker = node group by 1", _PL, _WM, _FUND, *_COMP).replace("with ", "with recursive ", 1))
def cluster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cluster of commonly funded wallets trades and earns."""
    tape = fills(spark, sf_dir)
    member = graph.connected_components(_funding(spark, sf_dir).where("shared >= 2"))
    vol = tape.groupBy(F.col("taker").alias("node")).agg(F.sum("cents").alias("vol"))
    pnl = _profits(spark, sf_dir).groupBy(F.col("wallet").alias("node")).agg(F.sum("pnl").alias("pnl"))
    return member.join(vol, "node").join(pnl, "node").groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("vol").alias("volume"), F.sum("pnl").alias("pnl"))


_TIGHT = ["kt as (select a, b from fe where shared >= 3 union all select b, a from fe where shared >= 3)", "rt(id, c) as (select node, node from cc union select kt.b, rt.c from rt join kt on kt.a = rt.id where rt.c < kt.b)", "tc as (select cc.component, cc.node, min(rt.c) as community from cc join rt on rt.id = cc.node group by 1, 2)"]


@query(fills_sql("""select component, members, cohorts, twin, overlap from (select component, count(*) as members, count(distinct community) as cohorts from tc group by 1) join (
 select component, twin, overlap from (select component, community as twin, count(*) as overlap, row_number() over (partition by component order by count(*) desc, community) as r from tc group by 1, 2) where r = 1) using (component)""", _FUND, *_COMP, *_TIGHT).replace("with ", "with recursive ", 1))
def entity_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into how many tighter clusters (three funders shared, or alone) each funded cluster falls, and its twin: the largest."""
    edges = cut(_funding(spark, sf_dir).where("shared >= 2").select("a", "b", "shared"))
    member = graph.connected_components(edges.select("a", "b"))
    tight = graph.connected_components(edges.where("shared >= 3").select("a", "b")).withColumnRenamed("component", "community")
    partition = member.select("node").join(tight, "node", "left").withColumn("community", F.coalesce("community", "node"))
    return graph.cross_checked(member, partition)


@query()
def community_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funded clusters against communities over the same weighted edges: sizes, spread and twins."""
    edges = cut(_funding(spark, sf_dir).where("shared >= 2"))
    member = graph.connected_components(edges.select("a", "b"))
    found = graph.communities(member.select("node"), edges.select("a", "b", F.col("weight").cast("double").alias("w")))
    return graph.cross_checked(member, found)


@query(fills_sql("""select condition_id, count(*) as n, cast(sum(w) as bigint) as total, round(case when count(*) > 1 then 2 * sum(i * w)::double / (count(*) * sum(w)::double) - (count(*) + 1) / count(*)::double end, 8) as gini, round(sum(case when i > m - 10 then w else 0 end)::double / sum(w), 8) as top10 from (
 select *, row_number() over (partition by condition_id order by w, entity) as i, count(*) over (partition by condition_id) as m from (select condition_id, coalesce(cc.component, taker) as entity, cast(sum(cents) as bigint) as w from f left join cc on cc.node = taker group by 1, 2 having sum(cents) > 0)) group by 1""", _FUND, *_COMP).replace("with ", "with recursive ", 1))
def entity_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration when the wallets of a funded cluster count as one, the others by themselves (C09, by the clusters of G13)."""
    tape = fills(spark, sf_dir)
    member = graph.connected_components(_funding(spark, sf_dir).where("shared >= 2"))
    named = tape.join(member, tape["taker"] == member["node"], "left").withColumn("entity", F.coalesce("component", "taker"))
    return C.concentration(C.wallet_weights(named, ["condition_id"], "entity", "cents"), ["condition_id"], (10,)).select("condition_id", "n", "total", "gini", "top10")


@query(trades_sql("""select p.a, p.b, p.events, round(e.m, 6) as expected, round(p, 7) as p, round(least(min(p * n / r) over (order by r desc rows unbounded preceding), 1.0), 7) as q_value from (
 select *, row_number() over (order by p, a, b) as r, count(*) over () as n from (select p.a, p.b, p.events, e.m, greatest(0.0, 1 - list_sum(list_transform(range(0, p.events), lambda j: exp(-e.m + j * ln(e.m) - case when j = 0 then 0 else lgamma(j + 1) end)))) as p from pairs p join ex e on p.a = e.a and p.b = e.b)) p join ex e on p.a = e.a and p.b = e.b""", _PRES, _PAIRS,
    "k as (select asset_id, side, wallet, count(*) as k, any_value(n) as n from pr join (select asset_id, side, count(distinct bucket) as n from pr group by 1, 2) using (asset_id, side) group by 1, 2, 3)",
    "ex as (select x.wallet as a, y.wallet as b, sum(x.k * y.k / x.n::double) as m from k x join k y using (asset_id, side) where x.wallet < y.wallet group by 1, 2)"))
def cotrade_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson tails of shared buckets and their q-values over all pairs that were seen."""
    shown = {f"shown_{c}": F.round(c, digits) for c, digits in (("expected", 6), ("p", 7), ("q_value", 7))}
    out = G.cotrade_null(trades(spark, sf_dir), COTRADE_S, **shown)
    return out.select("a", "b", "events", *[F.col(f"shown_{c}").alias(c) for c in ("expected", "p", "q_value")])


@query(trades_sql("""select name, half, count(*) as n, cast(sum(notional) as bigint) as notional, round(avg(won), 8) as win_rate, round(avg(won) - avg(implied) / 100, 8) as gap from ls join b using (wallet)
 join (select condition_id, case when c <= (select median(c) from (select max(sec) as c from t group by condition_id)) then 'early' else 'late' end as half from (select condition_id, max(sec) as c from t group by 1)) using (condition_id) where notional >= 300000 and pc between 2 and 98 group by 1, 2""", _BETS, _pnl_cte("t", "wallet", "size"), _SETS))
def leader_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six ways to choose twenty leaders, and how their large trades do before and after the median close."""
    tape = trades(spark, sf_dir)
    bet = K.bets(tape)
    chosen = N.leader_sets(tape)
    close = tape.groupBy("condition_id").agg(F.max("sec").alias("close_sec"))
    mid = close.agg(F.median("close_sec").alias("mid"))
    split = close.crossJoin(F.broadcast(mid)).select("condition_id", F.when(F.col("close_sec") <= F.col("mid"), "early").otherwise("late").alias("half"))
    large = bet.where("notional >= 300000 and pc between 2 and 98")
    return large.join(F.broadcast(chosen), "wallet").join(split, "condition_id").groupBy("name", "half").agg(
        F.count(F.lit(1)).alias("n"), F.sum("notional").alias("notional"), F.round(F.avg("won"), 8).alias("win_rate"), F.round(F.avg("won") - F.avg("implied") / 100, 8).alias("gap")
    )


@query(fills_sql("""select label, family, n, gini, top10 from (select case when family is not null then 'family ' || family else 'M:' || condition_id end as label, family, count(*) as n, round(case when count(*) > 1 then 2 * sum(i * w)::double / (count(*) * sum(w)::double) - (count(*) + 1) / count(*)::double end, 8) as gini, round(sum(case when r <= 10 then w else 0 end)::double / sum(w), 8) as top10 from (
 select *, row_number() over (partition by family, condition_id order by w, wallet) as i, row_number() over (partition by family, condition_id order by w desc, wallet) as r from (
  select case when family % 4 = 0 then null else family end as family, case when family % 4 = 0 then condition_id end as condition_id, taker as wallet, sum(cents) as w from f where not (family % 4 = 0 and condition_id % 5 = 4) group by 1, 2, 3 having sum(cents) > 0)) group by family, condition_id)"""))
def labelled_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration by family, or by market where there is none; exclusive markets without a family are left out."""
    tape = fills(spark, sf_dir).withColumn("own", F.when(F.col("family") % 4 != 0, F.col("family")))
    exclusive = F.col("own").isNull() & (F.col("condition_id") % 5 == 4)
    label = F.when(F.col("own").isNotNull(), F.concat(F.lit("family "), F.col("own"))).otherwise(F.concat(F.lit("M:"), F.col("condition_id")))
    named = tape.where(~exclusive).withColumn("label", label)
    out = C.concentration(C.wallet_weights(named, ["label", "own"], "taker", "cents"), ["label", "own"], (10,))
    return out.select("label", F.col("own").alias("family"), "n", "gini", "top10")


@query(fills_sql("""select category, week, count(*) as n, round(sum(w * w)::double / power(sum(w), 2), 8) as hhi, round(max(w)::double / sum(w), 8) as top1, round(sum(case when r <= 5 then w else 0 end)::double / sum(w), 8) as top5 from (
 select category, week, w, row_number() over (partition by category, week order by w desc, condition_id, maker) as r from (select category, week, condition_id, maker, cast(sum(cents) as double) as w from f group by 1, 2, 3, 4 having sum(cents) > 0)) group by 1, 2"""))
def maker_market_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration of a class's week over pairs of market and maker."""
    pairs = fills(spark, sf_dir).groupBy("category", "week", "condition_id", "maker").agg(F.sum("cents").alias("w")).where("w > 0")
    named = pairs.select("category", "week", F.concat_ws(":", "condition_id", "maker").alias("wallet"), "w")
    return C.concentration(named, ["category", "week"], (1, 5)).select("category", "week", "n", "hhi", "top1", "top5")


@query(fills_sql("""select round(sum(case when flagged then n else 0 end)::double / sum(n), 8) as flagged_share, round(sum(case when flagged and back then n else 0 end)::double / sum(n), 8) as reciprocal_share, count(*) filter (where flagged) as pairs from (
 select x.*, coalesce(y.flagged, false) as back from tops x left join tops y on x.a = y.b and x.b = y.a)""",
    "n as (select a, b, count(*) as n from (select maker as a, taker as b from f union all select taker, maker from f) where a <> b group by 1, 2)",
    "tops as (select a, b, n, total >= 20 and hhi >= 0.05 as flagged from (select *, row_number() over (partition by a order by n desc, b) as r, sum(n) over (partition by a) as total, (sum(n * n) over (partition by a))::double / power(sum(n) over (partition by a), 2) as hhi from n) where r = 1)"))
def flagged_pair_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of first-counterparty fills that concentrated, and mutually concentrated, pairs account for."""
    out = G.pair_structure(fills(spark, sf_dir), 20, 0.05)
    share = lambda c: F.round(ratio(F.sum(F.when(c, F.col("n")).otherwise(0)), F.sum("n")), 8)
    return out.agg(share(F.col("flagged")).alias("flagged_share"), share(F.col("reciprocal")).alias("reciprocal_share"), F.count_if("flagged").alias("pairs"))


@query(fills_sql("""select tier, count(*) as wallets, round(avg(z), 6) as z, round(avg(wins), 6) as win_rate from (select case when z >= 1.645 then 'skilled' when z <= -1.645 then 'unlucky' else 'plain' end as tier, z, wins from (
 select wallet, sum(pnl) / nullif(sqrt(sum(pnl * pnl)), 0) as z, avg((pnl > 0)::int) as wins from (select wallet, cast(pnl as double) as pnl from wm) group by 1 having count(*) >= 10) where z is not null) group by 1""", _PL, _WM))
def skill_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallets by the z of their markets' profits under random signs (B15, X06's normal approximation)."""
    x = F.col("pnl").cast("double")
    per = _profits(spark, sf_dir).groupBy("wallet").agg((F.sum(x) / F.nullif(F.sqrt(F.sum(x * x)), F.lit(0.0))).alias("z"), F.avg((F.col("pnl") > 0).cast("int")).alias("wins"), F.count(F.lit(1)).alias("n"))
    tier = F.when(F.col("z") >= 1.645, "skilled").when(F.col("z") <= -1.645, "unlucky").otherwise("plain")
    return per.where("n >= 10 and z is not null").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("wallets"), F.round(F.avg("z"), 6).alias("z"), F.round(F.avg("wins"), 6).alias("win_rate"))
