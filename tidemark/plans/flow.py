"""Queries on dedup, concentration, bets, calibration, positions and profit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import concentration as C
from tidemark.operators import skill as K
from tidemark.operators.primitives import global_ntile, global_row_number, ratio, top_k
from tidemark.plans.base_sql import fills_sql, raw_sql, trades_sql
from tidemark.plans.registry import query
from tidemark.sources.adapters import fills, raw_fills, trades
from tidemark.sources.store import cut

_CONC = """, r as (select *, row_number() over (partition by {k} order by w, wallet) as i,
  row_number() over (partition by {k} order by w desc, wallet) as r from w)
select {cols} count(*) as n, cast(sum(w) as bigint) as total,
 round(case when count(*) > 1 then 2 * cast(sum(i * w) as double) / (count(*) * cast(sum(w) as double)) - (count(*) + 1) / count(*) end, 8) as gini,
 round(cast(sum(cast(w as hugeint) * w) as double) / (cast(sum(w) as double) * cast(sum(w) as double)), 8) as hhi,
 {tops} from r {group}"""


def _conc(weights: str, keys: str, tops=(1, 5, 10, 25)) -> str:
    tops_sql = ", ".join(f"round(cast(sum(case when r <= {k} then w else 0 end) as double) / cast(sum(w) as double), 8) as top{k}" for k in tops)
    body = _CONC.format(k=keys or "1", cols=f"{keys}," if keys else "", tops=tops_sql, group=f"group by {keys}" if keys else "")
    return f"{fills_sql('').rstrip()}, w as ({weights}){body}"


def _weights(keys: str, wallet: str = "taker") -> str:
    return f"select {keys + ',' if keys else ''} {wallet} as wallet, cast(sum(cents) as bigint) as w from f group by {keys + ',' if keys else ''} {wallet} having sum(cents) > 0"


@query(fills_sql("select * from f"))
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(spark, sf_dir)


@query(raw_sql("select count(*) as n_rows, count(distinct (tx_hash, evt_index)) as n_keys, cast(sum(case when c > 1 then 1 else 0 end) as bigint) as repeated from (select tx_hash, evt_index, count(*) over (partition by tx_hash, evt_index) as c from raw)"))
def dedup_hash_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key statistics from one narrow aggregation: no window over wide rows."""
    keys = raw_fills(spark, sf_dir).groupBy("tx_hash", "evt_index").count()
    return keys.agg(
        F.sum("count").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)), F.lit(0)).alias("repeated")
    )


@query(_conc(_weights("condition_id"), "condition_id"))
def concentration_gini_hhi_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.concentration(C.wallet_weights(fills(spark, sf_dir), ["condition_id"], "taker", "cents"), ["condition_id"])


@query(_conc("select condition_id, taker as wallet, cast(abs(sum(case when (side = 'BUY') = (outcome_index = 0) then cents else -cents end)) as bigint) as w from f group by condition_id, taker having sum(case when (side = 'BUY') = (outcome_index = 0) then cents else -cents end) <> 0", "condition_id"))
def net_flow_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.concentration(C.net_flow_weights(fills(spark, sf_dir), ["condition_id"], "taker", "cents"), ["condition_id"])


@query(_conc(_weights("family"), "family"))
def family_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.concentration(C.wallet_weights(fills(spark, sf_dir), ["family"], "taker", "cents"), ["family"])


@query(_conc(_weights(""), "", (10, 100, 1000)))
def platform_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.concentration(C.wallet_weights(fills(spark, sf_dir), [], "taker", "cents"), [], (10, 100, 1000))


@query(_conc(_weights("category, week", "maker"), "category, week", (1, 5)))
def maker_hhi_class_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.concentration(C.wallet_weights(fills(spark, sf_dir), ["category", "week"], "maker", "cents"), ["category", "week"], (1, 5))


@query(fills_sql("""select count(*) as n, min(case when cum >= 0.5 * total then r end) as wallets_for_50, min(case when cum >= 0.9 * total then r end) as wallets_for_90,
 min(case when cum >= 0.99 * total then r end) as wallets_for_99,
 round(cast(sum(case when r <= ceil(n * 0.001) then w else 0 end) as double) / max(total), 8) as top_share_0,
 round(cast(sum(case when r <= ceil(n * 0.01) then w else 0 end) as double) / max(total), 8) as top_share_1,
 round(cast(sum(case when r <= ceil(n * 0.1) then w else 0 end) as double) / max(total), 8) as top_share_2
 from (select *, row_number() over (order by w desc, wallet) as r, sum(w) over (order by w desc, wallet rows unbounded preceding) as cum, sum(w) over () as total, count(*) over () as n from w)""", f"w as ({_weights('')})"))
def topshare_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_profile(C.wallet_weights(fills(spark, sf_dir), [], "taker", "cents"))


@query(fills_sql("""select bucket, round(cast(sum(n) over (order by bucket) as double) / sum(n) over (), 8) as cum_wallets, round(cast(sum(w) over (order by bucket) as double) / sum(w) over (), 8) as cum_weight
 from (select bucket, count(*) as n, sum(w) as w from (select *, ntile(10) over (order by w, wallet) as bucket from w) group by bucket)""", f"w as ({_weights('')})"))
def lorenz_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lorenz_points(C.wallet_weights(fills(spark, sf_dir), [], "taker", "cents"))


@query(fills_sql("""select m.month, count(*) as n_makers, round(1.0 / sum(power(w / tot, 2)), 8) as effective_n,
 cast(count(*) filter (where r <= 10 and exists (select 1 from k p where p.month = m.month - 1 and p.wallet = m.wallet and p.r <= 10)) as bigint) as persistent_top10
 from k m group by m.month""", f"k as (select *, row_number() over (partition by month order by w desc, wallet) as r, cast(sum(w) over (partition by month) as double) as tot from ({_weights('month', 'maker')}))"))
def monthly_maker_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = C.wallet_weights(fills(spark, sf_dir), ["month"], "maker", "cents")
    part = Window.partitionBy("month")
    ranked = w.withColumns({"r": F.row_number().over(part.orderBy(F.col("w").desc(), "wallet")), "tot": F.sum("w").over(part).cast("double")})
    before = ranked.where("r <= 10").select((F.col("month") + 1).alias("month"), "wallet", F.lit(1).alias("was"))
    share = F.col("w") / F.col("tot")
    return ranked.join(before, ["month", "wallet"], "left").groupBy("month").agg(
        F.count(F.lit(1)).alias("n_makers"), F.round(1 / F.sum(share * share), 8).alias("effective_n"), F.sum(F.when((F.col("r") <= 10) & (F.col("was") == 1), 1).otherwise(0)).alias("persistent_top10")
    )


@query(trades_sql("""select bucket, cast(total as bigint) as total, wallet as top_wallet, round(cast(w as double) / total, 8) as top_share from (
 select sec // 300 as bucket, wallet, sum(notional) as w, sum(sum(notional)) over (partition by sec // 300) as total,
  row_number() over (partition by sec // 300 order by sum(notional) desc, wallet) as r from t group by sec // 300, wallet) where r = 1 and total > 100000"""))
def whale_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = trades(spark, sf_dir).groupBy(F.expr("sec div 300").alias("bucket"), "wallet").agg(F.sum("notional").alias("w"))
    per = per.withColumn("total", F.sum("w").over(Window.partitionBy("bucket")))
    best = top_k(per.where("total > 100000"), ["bucket"], [F.col("w").desc(), "wallet"], 1)
    return best.select("bucket", "total", F.col("wallet").alias("top_wallet"), F.round(ratio(F.col("w"), F.col("total")), 8).alias("top_share"))


_BETS = "b as (select *, case when side = 'BUY' then pc else 100 - pc end as implied, case when (side = 'BUY') = (outcome_index = winner) then 1 else 0 end as won from t)"


@query(trades_sql("select event_id, wallet, condition_id, outcome_index, side, implied, won from b", _BETS))
def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.bets(trades(spark, sf_dir)).select("event_id", "wallet", "condition_id", "outcome_index", "side", "implied", "won")


@query(trades_sql("""select least(implied * 10 // 100, 9) as bin, count(*) as n, round(cast(sum(size * implied) as double) / (sum(size) * 100), 8) as mean_implied,
 round(cast(sum(size * won) as double) / sum(size), 8) as win_rate, round(cast(sum(size * won) as double) / sum(size) - cast(sum(size * implied) as double) / (sum(size) * 100), 8) as gap from b group by 1""", _BETS))
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.reliability(K.bets(trades(spark, sf_dir)))


@query(trades_sql("""select wallet, n, wins, round(mean_p, 8) as mean_p, round(a / (a + b), 8) as posterior, round(greatest(a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0), 8) as low,
 round(least(a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 1), 8) as high, round(a / (a + b) - mean_p, 8) as skill
 from (select *, mean_p * 4 + wins as a, (1 - mean_p) * 4 + n - wins as b from (select wallet, count(*) as n, cast(sum(won) as bigint) as wins, cast(sum(implied) as double) / (count(*) * 100) as mean_p from b group by wallet having count(*) >= 5))""", _BETS))
def wallet_beta_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.beta_skill(K.bets(trades(spark, sf_dir)))


def _pnl_cte(base: str, wallet: str, size: str) -> str:
    return f"""pl as (select *, buy_pnl + sell_pnl as gross, buy_pnl + sell_pnl * case when sold > 0 then least(1.0::double, bought::double / nullif(sold, 0)) else 0.0 end as covered from (
 select {wallet} as wallet, condition_id, outcome_index, sum(case when side = 'BUY' then {size} else 0 end) as bought, sum(case when side = 'BUY' then 0 else {size} end) as sold,
  sum(case when side = 'BUY' then {size} * (case when outcome_index = winner then 100 else 0 end - pc) else 0 end)::double as buy_pnl,
  sum(case when side = 'BUY' then 0 else {size} * (pc - case when outcome_index = winner then 100 else 0 end) end)::double as sell_pnl, count(*) as n from {base} group by 1, 2, 3))"""


@query(trades_sql("select wallet, cast(sum(n) as bigint) as n, cast(sum(gross) as bigint) as gross, round(sum(covered), 4) as covered from pl group by wallet", _pnl_cte("t", "wallet", "size")))
def wallet_pnl_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = K.covered_pnl(trades(spark, sf_dir))
    return legs.groupBy("wallet").agg(F.sum("n").alias("n"), F.sum("gross").alias("gross"), F.round(F.sum("covered"), 4).alias("covered"))


_POS = """pos as (select wallet, condition_id, p, won, cast(least(floor(p / 10), 9) as bigint) as decile from (
 select wallet, condition_id, case when net > 0 then wp::double / w else 100 - wp::double / w end as p, case when (net > 0) = (winner = 0) then 1 else 0 end as won from (
  select wallet, condition_id, sum(case when (side = 'BUY') = (outcome_index = 0) then size else -size end) as net, sum(size * case when outcome_index = 0 then pc else 100 - pc end) as wp, sum(size) as w, max(winner) as winner from t group by 1, 2) where net <> 0 and w > 0) where p between 5 and 95)"""


@query(trades_sql("select wallet, condition_id, round(p, 6) as p, won, decile, round(cast(sum(won) over (partition by decile) - won as double) / nullif(count(*) over (partition by decile) - 1, 0), 8) as bench_loo from pos", _POS))
def position_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.positions(trades(spark, sf_dir))


@query(trades_sql("""select a.wallet, notional, pnl, gap, r_notional, r_pnl, r_gap from (
 select wallet, notional, pnl, gap, row_number() over (order by notional desc, wallet) as r_notional, row_number() over (order by pnl desc, wallet) as r_pnl,
  case when gap is not null then row_number() over (order by gap desc nulls last, wallet) end as r_gap from (
  select b.wallet, cast(sum(b.notional) as bigint) as notional, case when count(*) >= 20 then round(avg(b.won) - avg(b.implied) / 100, 8) end as gap, any_value(p.pnl) as pnl
  from b join (select wallet, cast(sum(gross) as bigint) as pnl from pl group by wallet) p on b.wallet = p.wallet group by b.wallet)) a
 where r_notional <= 50 or r_pnl <= 50 or coalesce(r_gap, 999) <= 50""", _BETS, _pnl_cte("t", "wallet", "size")))
def universe_union_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallets in the top 50 by notional, profit or raw calibration gap (20 bets at least), with all three ranks."""
    tape = trades(spark, sf_dir)
    gap = F.round(F.avg("won") - F.avg("implied") / 100, 8)
    base = K.bets(tape).groupBy("wallet").agg(F.sum("notional").alias("notional"), F.when(F.count(F.lit(1)) >= 20, gap).alias("gap"))
    pnl = K.covered_pnl(tape).groupBy("wallet").agg(F.sum("gross").alias("pnl"))
    both = base.join(pnl, "wallet")
    both, ranked = cut(both), None
    for c in ("notional", "pnl", "gap"):
        places = global_row_number(both.where(F.col(c).isNotNull()).select("wallet", c), [F.col(c).desc(), F.col("wallet")], f"r_{c}").select("wallet", f"r_{c}")
        ranked = (both if ranked is None else ranked).join(places, "wallet", "left")
    return ranked.where("r_notional <= 50 or r_pnl <= 50 or coalesce(r_gap, 999) <= 50").select("wallet", "notional", "pnl", "gap", "r_notional", "r_pnl", "r_gap")


@query(trades_sql("""select q.quartile, case when implied < 20 then 'low' when implied > 80 then 'high' else 'mid' end as band, count(*) as n, round(avg(won) - avg(implied) / 100, 8) as gap
 from b join (select wallet, ntile(4) over (order by sum(notional), wallet) as quartile from t group by wallet) q on b.wallet = q.wallet group by 1, 2""", _BETS))
def quartile_band_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    tape = trades(spark, sf_dir)
    size = tape.groupBy("wallet").agg(F.sum("notional").alias("w"))
    quart = global_ntile(size, ["w", "wallet"], 4, "quartile").select("wallet", "quartile")
    band = F.when(F.col("implied") < 20, "low").when(F.col("implied") > 80, "high").otherwise("mid")
    return K.bets(tape).join(quart, "wallet").groupBy("quartile", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("won") - F.avg("implied") / 100, 8).alias("gap"))


_FBETS = "fb as (select *, case when side = 'BUY' then pc else 100 - pc end as implied, case when (side = 'BUY') = (outcome_index = winner) then 1 else 0 end as won from f)"


@query(fills_sql("select category, least(implied // 10, 9) as decile, count(*) as n, round(avg(implied) / 100, 8) as mean_implied, round(avg(won), 8) as win_rate from fb group by 1, 2", _FBETS))
def category_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    bet = K.bets(fills(spark, sf_dir))
    decile = F.least(F.expr("implied div 10"), F.lit(9)).alias("decile")
    return bet.groupBy("category", decile).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("implied") / 100, 8).alias("mean_implied"), F.round(F.avg("won"), 8).alias("win_rate"))


@query(fills_sql("""select condition_id, count(*) filter (where pnl > 0) as winners, count(*) filter (where pnl < 0) as losers, cast(sum(pnl) as bigint) as total,
 round(cast(sum(case when r = 1 and pnl > 0 then pnl else 0 end) as double) / nullif(cast(sum(case when pnl > 0 then pnl else 0 end) as double), 0), 8) as top1_share
 from (select *, row_number() over (partition by condition_id order by pnl desc, wallet) as r from (select condition_id, wallet, sum(gross) as pnl from pl group by 1, 2)) group by 1""", _pnl_cte("f", "taker", "q")))
def market_pnl_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = K.covered_pnl(fills(spark, sf_dir), "taker", "q").groupBy("condition_id", "wallet").agg(F.sum("gross").alias("pnl"))
    per = per.withColumn("r", F.row_number().over(Window.partitionBy("condition_id").orderBy(F.col("pnl").desc(), "wallet")))
    up = F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0)
    return per.groupBy("condition_id").agg(
        F.count_if(F.col("pnl") > 0).alias("winners"), F.count_if(F.col("pnl") < 0).alias("losers"), F.sum("pnl").alias("total"),
        F.round(ratio(F.sum(F.when(F.col("r") == 1, up).otherwise(0)), F.sum(up)), 8).alias("top1_share"),
    )


@query(fills_sql("""select coalesce(g.category, x.category) as category, coalesce(g.month, x.month) as month, coalesce(gross, 0) as gross, coalesce(fee, 0) as fee, coalesce(gross, 0) * 10000 - coalesce(fee, 0) as net
 from (select category, month, cast(sum(q * (case when outcome_index = winner then 100 else 0 end - pc) * case when side = 'BUY' then -1 else 1 end) as bigint) as gross from f where not is_taker group by 1, 2) g
 full join (select category, month, cast(sum(fee) as bigint) as fee from f where is_taker or fee_paying group by 1, 2) x on g.category = x.category and g.month = x.month"""))
def gross_fee_net_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takers' gross from maker rows (the taker's side is the opposite one), fees from the others, joined in full."""
    tape = fills(spark, sf_dir)
    payout = F.when(F.col("outcome_index") == F.col("winner"), 100).otherwise(0)
    sign = F.when(F.col("side") == "BUY", -1).otherwise(1)
    gross = tape.where("not is_taker").groupBy("category", "month").agg(F.sum(F.col("q") * (payout - F.col("pc")) * sign).alias("gross"))
    fee = tape.where("is_taker or fee_paying").groupBy("category", "month").agg(F.sum("fee").alias("fee"))
    g, f = F.coalesce("gross", F.lit(0)), F.coalesce("fee", F.lit(0))
    return gross.join(fee, ["category", "month"], "full").select("category", "month", g.alias("gross"), f.alias("fee"), (g * 10000 - f).alias("net"))


@query(fills_sql("""select decile, count(*) as n, cast(sum(vol) as bigint) as volume, cast(sum(pnl) as bigint) as pnl, count(*) filter (where pnl > 0) as winners from (
 select *, ntile(10) over (order by vol, maker) as decile from (
  select maker, sum(cents) as vol, sum(q * (case when outcome_index = winner then 100 else 0 end - pc) * case when side = 'BUY' then 1 else -1 end) as pnl from f where not is_taker group by maker)) group by decile"""))
def maker_decile_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    payout = F.when(F.col("outcome_index") == F.col("winner"), 100).otherwise(0)
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    per = fills(spark, sf_dir).where("not is_taker").groupBy("maker").agg(F.sum("cents").alias("vol"), F.sum(F.col("q") * (payout - F.col("pc")) * sign).alias("pnl"))
    per = global_ntile(per, ["vol", "maker"], 10, "decile")
    return per.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.sum("vol").alias("volume"), F.sum("pnl").alias("pnl"), F.count_if(F.col("pnl") > 0).alias("winners"))


@query(fills_sql("""select tier, count(*) as wallets, round(avg(n_markets), 6) as markets, round(avg(n_categories), 6) as categories, round(avg(top_share), 6) as top_share from (
 select wallet, case when pnl > 0 then 'up' when pnl < 0 then 'down' else 'flat' end as tier, n_markets, n_categories, top_share from (
  select wallet, sum(pnl) as pnl, count(*) as n_markets, count(distinct condition_id % 7) as n_categories, max(n)::double / sum(n) as top_share from (
   select wallet, condition_id, sum(gross) as pnl, sum(n) as n from pl group by 1, 2) group by 1 having sum(n) >= 10)) group by tier""", _pnl_cte("f", "taker", "q")))
def breadth_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = K.covered_pnl(fills(spark, sf_dir), "taker", "q").groupBy("wallet", "condition_id").agg(F.sum("gross").alias("pnl"), F.sum("n").alias("n"))
    wallet = per.groupBy("wallet").agg(
        F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("n_markets"), F.countDistinct(F.col("condition_id") % 7).alias("n_categories"), (F.max("n").cast("double") / F.sum("n")).alias("top_share"), F.sum("n").alias("n"),
    )
    tier = F.when(F.col("pnl") > 0, "up").when(F.col("pnl") < 0, "down").otherwise("flat").alias("tier")
    means = [F.round(F.avg(c), 6).alias(a) for c, a in (("n_markets", "markets"), ("n_categories", "categories"), ("top_share", "top_share"))]
    return wallet.where("n >= 10").groupBy(tier).agg(F.count(F.lit(1)).alias("wallets"), *means)


_CELLS = """c as (select c, count(*) as n, sum(won) as won from (select won, cast(case when implied % 10 < 5 or (implied % 10 = 5 and (implied // 10) % 2 = 0) then implied // 10 else implied // 10 + 1 end as bigint) as c from b) group by c),
 d as (select c / 10.0::double as f, won::double / n as o, (sum(won) over ())::double / sum(n) over () as base, n::double / sum(n) over () as s, n from c)"""


@query(trades_sql("""select cast(sum(n) as bigint) as n, round(sum(s * (f - o) * (f - o)), 8) as reliability, round(sum(s * (o - base) * (o - base)), 8) as resolution, round(max(base * (1 - base)), 8) as uncertainty,
 round(sum(s * (f - o) * (f - o)) - sum(s * (o - base) * (o - base)) + max(base * (1 - base)), 8) as brier from d""", _BETS, _CELLS))
def brier_murphy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.brier(K.bets(trades(spark, sf_dir)))
