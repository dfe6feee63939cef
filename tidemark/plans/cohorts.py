"""Queries on cohorts: entities, eras, leader sets, incidence tails, block times, calibration of legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.inference import sign_flip
from tidemark.functions.tails import beta_posterior_columns
from tidemark.operators import concentration as C
from tidemark.operators import population as N
from tidemark.operators import skill as K
from tidemark.operators.primitives import bh_qvalues, ratio, top_k
from tidemark.plans.base_sql import fills_sql, trades_sql
from tidemark.plans.flow import _BETS, _conc
from tidemark.plans.prices import _AT, _CONV, _MK, _convergence
from tidemark.plans.registry import query
from tidemark.plans.returns import _LEAD, _MR, _MV, _mirrored
from tidemark.sources.adapters import fills, table, trades, written_fills
from tidemark.sources.store import cut


@query(_conc("select condition_id, community as wallet, cast(sum(cents) as bigint) as w from f join (select taker, maker as community from (select taker, maker, row_number() over (partition by taker order by sum(cents) desc, maker) as r from f group by taker, maker) where r = 1) using (taker) group by 1, 2", "condition_id"))
def collapsed_entity_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration over communities of wallets: takers that deal most with the same maker count as one."""
    tape = written_fills(spark, sf_dir, "condition_id", "taker", "maker", "cents")
    most = top_k(tape.groupBy("taker", "maker").agg(F.sum("cents").alias("w")), ["taker"], [F.col("w").desc(), "maker"], 1).select("taker", F.col("maker").alias("entity"))
    return C.concentration(C.wallet_weights(tape.join(most, "taker"), ["condition_id"], "entity", "cents"), ["condition_id"])


@query(_conc("select condition_id, taker as wallet, cast(sum(case when side = 'BUY' then q else -q end) as bigint) as w from f group by 1, 2 having sum(case when side = 'BUY' then q else -q end) > 0", "condition_id"))
def holdings_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration of what wallets hold: bought less sold, where positive."""
    held = fills(spark, sf_dir).withColumn("signed", F.when(F.col("side") == "BUY", F.col("q")).otherwise(-F.col("q")))
    return C.concentration(C.wallet_weights(held, ["condition_id"], "taker", "signed"), ["condition_id"])


@query()
def position_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallets with five positions in three markets: Beta posterior of the win rate against the leave-one-out benchmark."""
    per = K.positions(trades(spark, sf_dir)).where("bench_loo is not null").groupBy("wallet").agg(
        F.count("*").alias("n"), F.countDistinct("condition_id").alias("markets"), F.sum("won").alias("wins"), F.avg("bench_loo").alias("bench")
    )
    per = per.where("n >= 5 and markets >= 3")
    a, b = F.col("bench") * 4 + F.col("wins"), (1 - F.col("bench")) * 4 + F.col("n") - F.col("wins")
    return per.withColumn("post", beta_posterior_columns(a, b, F.col("bench"))).select("wallet", "n", "wins", "bench", "post.*")


@query()
def skill_signflip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-flip test of each wallet's profits by market, with q-values over the wallets that were tried."""
    legs = K.covered_pnl(fills(spark, sf_dir), "taker", "q").groupBy("wallet", "condition_id").agg(F.sum("gross").cast("double").alias("pnl"))
    tried = cut(sign_flip(legs, "wallet", "pnl", 10, 500))
    return bh_qvalues(tried.where("p_up is not null"), "p_up", ["wallet"]).unionByName(tried.where("p_up is null"), allowMissingColumns=True)


@query(trades_sql("select case when implied % 10 < 5 or (implied % 10 = 5 and (implied // 10) % 2 = 0) then implied // 10 else implied // 10 + 1 end as bucket, count(*) as n, round(avg(won), 8) as empirical from b group by 1", _BETS))
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.bround(F.col("implied") / F.lit(10).cast("decimal(10,0)"), 0).cast("bigint")
    return K.bets(trades(spark, sf_dir)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("won"), 8).alias("empirical"))


@query(trades_sql("select case when day % 2 = 0 then 'even' else 'odd' end as era, side, count(*) as n, round(avg(power(implied / 100.0 - won, 2)), 8) as brier, round(avg(won) - avg(implied) / 100, 8) as gap from b group by 1, 2", _BETS))
def era_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    era = F.when(F.col("day") % 2 == 0, "even").otherwise("odd").alias("era")
    miss = F.col("implied") / 100.0 - F.col("won")
    return K.bets(trades(spark, sf_dir)).groupBy(era, "side").agg(F.count("*").alias("n"), F.round(F.avg(miss * miss), 8).alias("brier"), F.round(F.avg("won") - F.avg("implied") / 100, 8).alias("gap"))


@query(fills_sql("select category, month, count(*) as n, cast(sum(q * (case when outcome_index = winner then 100 else 0 end - pc) * case when side = 'BUY' then 1 else -1 end) as bigint) as pnl, round(avg(case when (side = 'BUY') = (outcome_index = winner) then 1 else 0 end), 8) as win_rate from f where is_taker group by 1, 2"))
def platform_taker_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    payout, sign = F.when(F.col("outcome_index") == F.col("winner"), 100).otherwise(0), F.when(F.col("side") == "BUY", 1).otherwise(-1)
    won = ((F.col("side") == "BUY") == (F.col("outcome_index") == F.col("winner"))).cast("int")
    return fills(spark, sf_dir).where("is_taker").groupBy("category", "month").agg(F.count("*").alias("n"), F.sum(F.col("q") * (payout - F.col("pc")) * sign).alias("pnl"), F.round(F.avg(won), 8).alias("win_rate"))


@query(fills_sql("""select category, hours, n, median, min(case when median < 50 then hours end) over (partition by category) as first_under from (
 select mk.category, hours, count(*) as n, round(median(abs_error), 6) as median from cv join mk using (condition_id) group by 1, 2)""", _MK, _AT, _CONV))
def efficiency_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median error by class and hours to the close, and the last horizon at which it is under 50."""
    long = _convergence(spark, sf_dir).withColumn("category", F.col("condition_id") % 7)
    cell = long.groupBy("category", "hours").agg(F.count("*").alias("n"), F.round(F.median("abs_error"), 6).alias("median"))
    return cell.withColumn("first_under", F.min(F.when(F.col("median") < 50, F.col("hours"))).over(Window.partitionBy("category")))


@query(fills_sql("select hours, span > 220000000 as long_lived, count(*) as n, round(avg(case when abs_error > 50 then 1 else 0 end), 8) as wrong, round(avg(case when abs_error <= 5 then 1 else 0 end), 8) as within5 from cv group by 1, 2", _MK, _AT, _CONV))
def convergence_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.round(F.avg(c.cast("int")), 8)
    return _convergence(spark, sf_dir).groupBy("hours", (F.col("span") > 220_000_000).alias("long_lived")).agg(F.count("*").alias("n"), share(F.col("abs_error") > 50).alias("wrong"), share(F.col("abs_error") <= 5).alias("within5"))


@query(fills_sql("""select count(*) as payers, round(sum(case when r <= ceil(n * 0.01) then fee else 0 end)::double / sum(fee), 8) as top1pct, round(sum(case when r <= ceil(n * 0.001) then fee else 0 end)::double / sum(fee), 8) as top01pct
 from (select taker, sum(fee) as fee, row_number() over (order by sum(fee) desc, taker) as r, count(*) over () as n from f where fee > 0 group by taker)"""))
def top_fee_payers(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = fills(spark, sf_dir).where("fee > 0").groupBy(F.col("taker").alias("wallet")).agg(F.sum("fee").alias("w"))
    return C.top_profile(per, (0.5,), (0.01, 0.001)).select(F.col("n").alias("payers"), F.col("top_share_0").alias("top1pct"), F.col("top_share_1").alias("top01pct"))


@query(fills_sql("select category, week, count(distinct maker) as makers, count(distinct case when first_week = week then maker end) as new_makers from (select *, min(week) over (partition by maker) as first_week from f) group by 1, 2"))
def new_maker_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    tape = fills(spark, sf_dir)
    first = tape.groupBy("maker").agg(F.min("week").alias("first_week"))
    return tape.join(first, "maker").groupBy("category", "week").agg(F.countDistinct("maker").alias("makers"), F.countDistinct(F.when(F.col("first_week") == F.col("week"), F.col("maker"))).alias("new_makers"))


@query(fills_sql("select tx_hash, cast(coalesce(sum(case when is_taker then q end), 0) as bigint) as taken, cast(coalesce(sum(case when not is_taker then q end), 0) as bigint) as made, coalesce(sum(case when is_taker then q end), 0) = coalesce(sum(case when not is_taker then q end), 0) as conserved from f group by 1"))
def reconcile_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares taken against shares made in each transaction."""
    legs = [F.coalesce(F.sum(F.when(c, F.col("q"))), F.lit(0)).alias(n) for c, n in ((F.col("is_taker"), "taken"), (~F.col("is_taker"), "made"))]
    return fills(spark, sf_dir).groupBy("tx_hash").agg(*legs).withColumn("conserved", F.col("taken") == F.col("made"))


@query(fills_sql("""select k.block, round(coalesce(lo.t + (hi.t - lo.t) * (k.block - lo.b)::double / nullif(hi.b - lo.b, 0), lo.t, hi.t), 4) as sec from k asof left join env lo on k.block >= lo.b join (select k.block, e.t, e.b from k asof left join env e on k.block <= e.b) hi using (block)""",
    "env as (select b, max(t) over (order by b rows unbounded preceding) as t from (select tx_hash // 500 * 500 as b, median(sec) as t from f group by 1))", "k as (select distinct tx_hash as block from f)"))
def block_time_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block to its time: a median per bin, made monotone, straight lines between.

    A block lies in a bin that exists, so it joins that bin and carries the next one: only one row a bin is ordered globally.
    """
    blocks = fills(spark, sf_dir).select("tx_hash", "sec", F.expr("tx_hash div 500 * 500").alias("b"))
    order = Window.orderBy("b")
    mono = blocks.groupBy("b").agg(F.median("sec").alias("t")).withColumn("t", F.max("t").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    mono = mono.withColumns({"b1": F.lead("b").over(order), "t1": F.lead("t").over(order)})
    line = F.col("t") + (F.col("t1") - F.col("t")) * ratio(F.col("block") - F.col("b"), F.col("b1") - F.col("b"))
    asked = blocks.select(F.col("tx_hash").alias("block"), "b").distinct().join(mono, "b")
    return asked.select("block", F.round(F.coalesce(line, "t"), 4).alias("sec"))


@query(fills_sql("select f.tx_hash, f.evt_index, m.month0 from f asof left join (select tx_hash as lo, max(month) as month0 from f where tx_hash % 1000 = 0 group by 1) m on f.tx_hash >= m.lo"))
def block_month_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month label of the last breakpoint block at or before the block of every fill.

    Blocks are dealt by the thousand, which starts with its breakpoint if that was traded; a thousand without one takes
    the last earlier label. Only one row a thousand is ordered globally.
    """
    tape = fills(spark, sf_dir).withColumn("lo", F.expr("tx_hash div 1000"))
    own = tape.groupBy("lo").agg(F.max(F.when(F.col("tx_hash") % 1000 == 0, F.col("month"))).alias("own"))
    labels = own.select("lo", F.last("own", ignorenulls=True).over(Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)).alias("month0"))
    return tape.join(labels, "lo").select("tx_hash", "evt_index", "month0")


@query(fills_sql("""select n_legs, count(*) as txs, round(avg(abs_gap), 6) as mean_gap from (select tx_hash, condition_id, count(*) as n_legs, abs(sum(case when outcome_index = 0 then pc else 0 end)::double / nullif(count(*) filter (where outcome_index = 0), 0) + sum(case when outcome_index = 1 then pc else 0 end)::double / nullif(count(*) filter (where outcome_index = 1), 0) - 100) as abs_gap
 from f group by 1, 2) where abs_gap is not null group by 1"""))
def complement_leg_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with legs on both outcomes: how far their mean prices are from summing to one."""
    mean = lambda k: F.avg(F.when(F.col("outcome_index") == k, F.col("pc")))
    per = fills(spark, sf_dir).groupBy("tx_hash", "condition_id").agg(F.count("*").alias("n_legs"), F.abs(mean(0) + mean(1) - 100).alias("abs_gap"))
    return per.where("abs_gap is not null").groupBy("n_legs").agg(F.count("*").alias("txs"), F.round(F.avg("abs_gap"), 6).alias("mean_gap"))


@query(trades_sql("""select x.asset0 as condition_id, x.hour, x.p0, x.p1, x.p0 + x.p1 - 100 as off from (select a.condition_id as asset0, a.hour, a.p as p0, b.p as p1 from h a join h b on a.condition_id = b.condition_id and a.hour = b.hour and a.outcome_index = 0 and b.outcome_index = 1) x""",
    "h as (select condition_id, outcome_index, hour, arg_max(pc, (sec, event_id)) as p from t group by 1, 2, 3)"))
def outcome_sum_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which both outcomes traded: their last prices and the distance of the sum from one, in one aggregation."""
    pick = lambda k: F.max_by(F.when(F.col("outcome_index") == k, F.col("pc")), F.when(F.col("outcome_index") == k, F.struct("sec", "event_id")))
    both = trades(spark, sf_dir).groupBy("condition_id", "hour").agg(pick(0).alias("p0"), pick(1).alias("p1")).where("p0 is not null and p1 is not null")
    return both.withColumn("off", F.col("p0") + F.col("p1") - 100)


@query(trades_sql("select name as leader_set, half, horizon, count(*) as n, round(avg(gross - 0.004), 8) as mean_net from mr join ls using (wallet) join (select condition_id, case when c <= (select median(c) from (select max(sec) as c from t group by condition_id)) then 'early' else 'late' end as half from (select condition_id, max(sec) as c from t group by 1)) using (condition_id) group by 1, 2, 3", *_LEAD, _MV, _MR))
def leader_set_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrored returns of each of the six leader sets in markets before and after the median close."""
    tape = cut(trades(spark, sf_dir))
    close = tape.groupBy("condition_id").agg(F.max("sec").alias("close_sec"))
    half = close.agg(F.median("close_sec").alias("mid"))
    split = close.crossJoin(F.broadcast(half)).select("condition_id", F.when(F.col("close_sec") <= F.col("mid"), "early").otherwise("late").alias("half"))
    sets = N.leader_sets(tape).withColumnRenamed("name", "leader_set")
    out = _mirrored(spark, sf_dir).join(F.broadcast(sets), "wallet").join(split, "condition_id")
    return out.groupBy("leader_set", "half", "horizon").agg(F.count("*").alias("n"), F.round(F.avg("net"), 8).alias("mean_net"))


@query(fills_sql("select category, cast(sum(case when fee_paying and is_leg then cents else 0 end) as bigint) as leg_cents, cast(sum(case when fee_paying then cents else 0 end) as bigint) as cents from (select f.*, exists (select 1 from f g where g.taker = f.taker and g.token_id = f.token_id and g.side <> f.side and abs(g.sec - f.sec) <= 8640000) as is_leg from f) group by 1"))
def roundtrip_fee_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notional of fee-paying fills that have an opposite fill of the same taker and token near in time: a semi join."""
    tape = fills(spark, sf_dir)
    w = 8_640_000
    left = tape.select("tx_hash", "evt_index", "taker", "token_id", F.col("side").alias("s1"), "sec", F.explode(F.array([F.expr(f"sec div {w}") + d for d in (-1, 0, 1)])).alias("b"))
    right = tape.select(F.col("taker").alias("taker2"), F.col("token_id").alias("token2"), F.col("side").alias("s2"), F.col("sec").alias("sec2"), F.expr(f"sec div {w}").alias("b2"))
    near = (F.col("taker") == F.col("taker2")) & (F.col("token_id") == F.col("token2")) & (F.col("b") == F.col("b2")) & (F.col("s1") != F.col("s2")) & (F.abs(F.col("sec") - F.col("sec2")) <= w)
    legs = left.join(right, near, "left_semi").select("tx_hash", "evt_index", F.lit(True).alias("leg")).distinct()
    paid = F.when(F.col("fee_paying"), F.col("cents")).otherwise(0)
    return tape.join(legs, ["tx_hash", "evt_index"], "left").groupBy("category").agg(F.sum(F.when(F.col("leg"), paid).otherwise(0)).alias("leg_cents"), F.sum(paid).alias("cents"))


@query("select p_brand, count(*) as n, min(p_partkey) as first_id, string_agg(p_name, '|' order by p_partkey) as names, md5(p_brand || '42') as h from part group by 1")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered string aggregation and the hash that orders pseudo-random picks."""
    part = table(spark, sf_dir, "part")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), "|")
    return part.groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id"), names.alias("names"), F.md5(F.concat("p_brand", F.lit("42")).cast("binary")).alias("h"))


@query(fills_sql("select tx_hash, evt_index, cents, least(cast(floor(10.0 * (rank() over (partition by category order by cents) - 1) / count(*) over (partition by category)) as bigint), 9) as decile from f"))
def rank_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decile of every fill. Ranks come from counts of each amount, so no task holds the fills of a class."""
    tape = fills(spark, sf_dir)
    w = Window.partitionBy("category")
    amounts = tape.groupBy("category", "cents").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(w.orderBy("cents").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    deciles = amounts.select("category", "cents", F.least(F.floor(10.0 * below / F.sum("n").over(w)), F.lit(9)).cast("bigint").alias("decile"))
    return tape.join(deciles, ["category", "cents"]).select("tx_hash", "evt_index", "cents", "decile")


@query(fills_sql("select a.condition_id, a.day, a.v, b.v as v_prev, round(a.v::double / nullif(b.v, 0) - 1, 8) as change from d a left join d b on a.condition_id = b.condition_id and a.day = b.day + 1", "d as (select condition_id, day, cast(sum(cents) as bigint) as v from f group by 1, 2)"))
def daily_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume against the day before, null where there was none: a lag with a gap check instead of a self-join."""
    d = fills(spark, sf_dir).groupBy("condition_id", "day").agg(F.sum("cents").alias("v"))
    w = Window.partitionBy("condition_id").orderBy("day")
    prev = F.when(F.lag("day").over(w) == F.col("day") - 1, F.lag("v").over(w))
    return d.withColumn("v_prev", prev).withColumn("change", F.round(ratio(F.col("v"), F.col("v_prev")) - 1, 8))
