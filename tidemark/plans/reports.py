"""Reports by cohort of time and by time since fees began: fees by size, round trips, builders, trends with tests, roll-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import concentration as C
from tidemark.operators import controls as K
from tidemark.operators import coordination as O
from tidemark.operators import fees
from tidemark.operators import regression as R
from tidemark.operators.primitives import global_running, ratio, top_k
from tidemark.plans.base_sql import fills_sql
from tidemark.plans.registry import query
from tidemark.sources.adapters import written_fills
from tidemark.sources.store import cut

#: Seconds between the legs of a round trip: takers of the synthetic tape trade a token every few weeks.
WITHIN_S = 8_640_000

_CO = "co as (select *, month // 12 as cohort, taker as wallet, tx_hash * 16 + evt_index as id from f)"
_DEC = "dc as (select *, least(10 * (rank() over (partition by cohort order by cents) - 1) // count(*) over (partition by cohort), 9) as decile from co)"


def _amounts(tape: DataFrame) -> DataFrame:
    """cohort, cents, decile, n, fee, paying: each amount of a cohort once, with its decile by rank. Places run by ranges of amounts."""
    amounts = tape.groupBy("cohort", "cents").agg(F.count(F.lit(1)).alias("n"), F.sum("fee").alias("fee"), F.count_if("fee_paying").alias("paying"))
    upto = cut(global_running(amounts, ["cohort", "cents"], {"_upto": (F.col("n"), "sum")}))
    base = upto.groupBy("cohort").agg(F.min(F.col("_upto") - F.col("n")).alias("_base"), F.sum("n").alias("_all"))
    below = F.col("_upto") - F.col("n") - F.col("_base")
    return upto.join(F.broadcast(base), "cohort").withColumn("decile", F.least(F.floor(10 * below / F.col("_all")), F.lit(9)).cast("bigint")).drop("_upto", "_base", "_all")  # a row a year


def _deciles(tape: DataFrame) -> DataFrame:
    rate = F.sum(F.col("fee") / (F.col("cents") * 10_000.0)) / F.sum(F.when(F.col("cents") > 0, F.col("n")))
    return _amounts(tape).groupBy("cohort", "decile").agg(F.sum("n").alias("n"), F.percentile("cents", F.lit(0.5), F.col("n")).alias("median_cents"), rate.alias("fee_rate"))


def _cohort_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_fills(spark, sf_dir, "month", "tx_hash", "evt_index", "sec", "taker", "maker", "token_id", "side", "q", "pc", "cents", "fee", "fee_paying").withColumn("cohort", F.expr("month div 12"))


@query(fills_sql("select cohort, cast(decile as bigint) as decile, count(*) as n, median(cents) as median_cents, round(avg(fee / (cents * 10000.0)) filter (where cents > 0), 8) as fee_rate from dc group by 1, 2", _CO, _DEC))
def cohort_fee_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees by decile of order size within each yearly cohort (R05). Amounts are counted first, so no task holds a cohort."""
    return _deciles(_cohort_tape(spark, sf_dir)).select("cohort", "decile", "n", "median_cents", F.round("fee_rate", 8).alias("fee_rate"))


_TRIPS = [
    f"""rt as (select * from (select *, row_number() over (partition by sell_id order by gap, buy_id) as r2 from (
 select b.id as buy_id, s.id as sell_id, abs(b.sec - s.sec) as gap, row_number() over (partition by b.id order by abs(b.sec - s.sec), s.id) as r1 from co b join co s on b.wallet = s.wallet and b.token_id = s.token_id and b.side = 'BUY' and s.side = 'SELL' and abs(b.sec - s.sec) <= {WITHIN_S} and least(b.q, s.q)::double / greatest(b.q, s.q) >= 0.5) where r1 = 1) where r2 = 1)""",
    "lg as (select distinct unnest([buy_id, sell_id]) as id from rt)",
    "cr as (select cohort, fee_paying, count(*) as n, count(lg.id) as legs, round(count(lg.id)::double / count(*), 8) as share from co left join lg using (id) group by 1, 2)",
]


def _round_trips(tape: DataFrame) -> DataFrame:
    ids = tape.withColumn("event_id", F.col("tx_hash") * 16 + F.col("evt_index"))
    trades = ids.select("event_id", F.col("taker").alias("wallet"), F.col("token_id").alias("asset_id"), "side", "sec", F.col("q").alias("size"), "pc")
    found = O.round_trips(trades, WITHIN_S, 0.5)
    legs = found.select(F.explode(F.array("buy_id", "sell_id")).alias("event_id")).distinct().withColumn("leg", F.lit(1))
    return ids.select("event_id", "cohort", "fee_paying").join(legs, "event_id", "left").groupBy("cohort", "fee_paying").agg(F.count(F.lit(1)).alias("n"), F.count("leg").alias("legs"), F.round(ratio(F.count("leg"), F.count(F.lit(1))), 8).alias("share"))


@query(fills_sql("select * from cr", _CO, *_TRIPS))
def cohort_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of orders that are a leg of a one-to-one round trip, by cohort and by whether they pay fees."""
    return _round_trips(_cohort_tape(spark, sf_dir))


_BUILT = "bd as (select cohort, builder, count(*) as fills, sum(cents) as w, count(*) filter (where fee_paying) as paying from (select cohort, tx_hash * 7 % 40 as builder, cents, fee_paying from co) group by 1, 2)"
_BUILDERS = "bs as (select cohort, count(*) as builders, round(sum(power(w / tot, 2)), 8) as hhi, round(sum(case when r <= 8 then w / tot else 0 end), 8) as top8, round(sum(paying) filter (where r <= 8)::double / sum(fills) filter (where r <= 8), 8) as top8_paying from (select *, sum(w) over (partition by cohort)::double as tot, row_number() over (partition by cohort order by w desc, builder) as r from bd) group by 1)"


def _builders(tape: DataFrame) -> DataFrame:
    per = tape.groupBy("cohort", (F.col("tx_hash") * 7 % 40).alias("wallet")).agg(F.sum("cents").alias("w"), F.count(F.lit(1)).alias("fills"), F.count_if("fee_paying").alias("paying"))
    shares = C.concentration(per.select("cohort", "wallet", "w"), ["cohort"], (8,)).select("cohort", F.col("n").alias("builders"), F.round("hhi", 8).alias("hhi"), F.round("top8", 8).alias("top8"))
    first = top_k(per, ["cohort"], [F.col("w").desc(), "wallet"], 8).groupBy("cohort").agg(F.round(ratio(F.sum("paying"), F.sum("fills")), 8).alias("top8_paying"))
    return shares.join(first, "cohort")


@query(fills_sql("select * from bs", _CO, _BUILT, _BUILDERS))
def cohort_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How few builders route a cohort's notional, and how often the first eight pay fees (R05; a hash stands in for builders)."""
    return _builders(_cohort_tape(spark, sf_dir))


_MEASURES = [
    """ms as (select cohort, 'fee_share' as measure, avg(fee_paying::int) as y from co group by 1 union all select cohort, 'self_match', avg((maker = taker)::int) from co group by 1
 union all select cohort, case when fee_paying then 'median_paying' else 'median_free' end, median(cents) from co group by cohort, fee_paying union all select cohort, 'builder_hhi', hhi from bs union all select cohort, 'builder_top8', top8 from bs
 union all select cohort, case when fee_paying then 'trips_paying' else 'trips_free' end, share from cr union all select cohort, 'maker_hhi', sum(power(w / tot, 2)) from (select cohort, w, sum(w) over (partition by cohort)::double as tot from (select cohort, maker, sum(cents) as w from co group by 1, 2)) group by 1)""",
    "sm as (select measure, count(*) as n, avg(y) as mean, covar_pop(y, cohort) / nullif(var_pop(cohort), 0) as slope, var_pop(cohort) as xx, var_pop(y) as yy, covar_pop(y, cohort) as xy, max(y) - min(y) as span from ms where y is not null group by 1)",
    "tt as (select *, slope / sqrt(nullif(case when n > 2 and yy - xy * xy / xx > 1e-12 * yy then n * (yy - xy * xy / xx) end, 0) / (n - 2) / (n * xx)) as t from sm)",
    "tp as (select *, 1 - 2 / sqrt(2 * pi()) * abs(t) / 1200 * list_sum(list_transform(range(0, 401), lambda k: (case when k in (0, 400) then 1 when k % 2 = 1 then 4 else 2 end) * exp(-power(t * k / 400, 2) / 2))) as p from tt)",
    "th as (select *, row_number() over (order by p, measure) as i, count(p) over () as m from tp where p is not null)",
]


@query(fills_sql("""select measure, n, round(mean, 8) as mean, round(slope, 8) as slope, round(t, 5) as t, round(p, 5) as p, coalesce(rejected, false) as rejected, span <= 0.15 * abs(mean) as stable from tp left join (select measure, min((p <= 0.05 / (m - i + 1))::int) over (order by i) = 1 as rejected from th) using (measure)""", _CO, _BUILT, _BUILDERS, *_TRIPS, *_MEASURES))
def cohort_trend_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends of nine measures across cohorts with Holm's correction, and whether a measure stays within 15 % of its mean."""
    tape = _cohort_tape(spark, sf_dir)
    whole = tape.groupBy("cohort").agg(F.avg(F.col("fee_paying").cast("int")).alias("fee_share"), F.avg((F.col("maker") == F.col("taker")).cast("int")).alias("self_match"))
    amounts = tape.groupBy("cohort", "fee_paying", "cents").agg(F.count(F.lit(1)).alias("n"))
    named = lambda a: F.when(F.col("fee_paying"), f"{a}_paying").otherwise(f"{a}_free").alias("measure")
    medians = amounts.groupBy("cohort", "fee_paying").agg(F.percentile("cents", F.lit(0.5), F.col("n")).alias("y")).select("cohort", named("median"), "y")
    trips = _round_trips(tape).select("cohort", named("trips"), F.col("share").alias("y"))
    w = F.col("w").cast("double")
    makers = tape.groupBy("cohort", "maker").agg(F.sum("cents").alias("w")).groupBy("cohort").agg(ratio(F.sum(w * w), F.sum(w) * F.sum(w)).alias("y")).select("cohort", F.lit("maker_hhi").alias("measure"), "y")
    wide = whole.selectExpr("cohort", "stack(2, 'fee_share', fee_share, 'self_match', self_match) as (measure, y)")
    built = _builders(tape).selectExpr("cohort", "stack(2, 'builder_hhi', hhi, 'builder_top8', top8) as (measure, y)")
    long = wide.union(medians).union(trips).union(built).union(makers)
    tested = R.holm(cut(R.trend(long, ["measure"], "cohort", "y")), "p", ["measure"])
    return tested.select("measure", "n", F.round("mean", 8).alias("mean"), F.round("slope", 8).alias("slope"), F.round("t", 5).alias("t"), F.round("p", 5).alias("p"), "rejected", (F.col("range") <= 0.15 * F.abs("mean")).alias("stable"))


_ROLL = [
    "od as (select category, month, taker, sum(cents) as cents, sum(fee) as fee from f group by category, month, taker, condition_id, sec, side)",
    "fw as (select taker, min(month) as first_month from od group by 1)",
    "st as (select category, min(month) filter (where fee_paying) + category * 3 as start from f group by 1)",
    "pm as (select category, month - start as since, sum(cents) as notional, sum(fee) / (sum(cents) * 10000.0) as fee_rate, count(distinct taker) as wallets, count(distinct taker) filter (where first_month = month) as new_wallets, median(cents) as median_order, avg((cents < 500)::int) as small from od join fw using (taker) join st using (category) group by 1, 2)",
    "fu as (select category from pm where since between -3 and 3 group by 1 having count(*) = 7)",
    "pb as (select 'pooled' as scope, * from pm where since between -6 and 6 union all select 'balanced', * from pm where since between -3 and 3 and category in (select category from fu))",
    "rp as (select scope, since, count(*) as units, avg(fee_rate) as fee_rate, avg(wallets) as wallets, avg(new_wallets) as new_wallets, avg(median_order) as median_order, avg(small) as small, sum(median_order * notional) / sum(notional)::double as weighted from pb group by 1, 2)",
]


@query(fills_sql("select scope, since, units, round(fee_rate, 8) as fee_rate, round(wallets, 6) as wallets, round(new_wallets, 6) as new_wallets, round(median_order, 6) as median_order, round(small, 8) as small, round(weighted, 6) as weighted_order, round(order_slope, 6) as order_slope, round(new_slope, 6) as new_slope from rp left join (select scope, regr_slope(weighted, since) as order_slope, regr_slope(new_wallets, since) as new_slope from rp where since < 0 group by 1) using (scope)", *_ROLL))
def fee_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and wallets by months since a class's fees began, pooled over all classes and over those seen in every month around it,
    with the trend before (F08). Orders are a taker's fills in one market, second and direction; starts are staggered by class."""
    tape = written_fills(spark, sf_dir, "category", "month", "taker", "condition_id", "sec", "side", "cents", "fee", "fee_paying")
    orders = cut(tape.groupBy("category", "month", "taker", "condition_id", "sec", "side").agg(F.sum("cents").alias("cents"), F.sum("fee").alias("fee")).drop("condition_id", "sec", "side"))
    start = tape.groupBy("category").agg((F.min(F.when(F.col("fee_paying"), F.col("month"))) + F.col("category") * 3).alias("start"))
    seen = orders.select("category", "month", "taker").distinct().join(orders.groupBy("taker").agg(F.min("month").alias("first_month")), "taker")
    wallets = seen.groupBy("category", "month").agg(F.count(F.lit(1)).alias("wallets"), F.count_if(F.col("first_month") == F.col("month")).alias("new_wallets"))
    amounts = orders.groupBy("category", "month", "cents").agg(F.count(F.lit(1)).alias("n"), F.sum("fee").alias("fee"))
    size = amounts.groupBy("category", "month").agg(
        F.sum(F.col("cents") * F.col("n")).alias("notional"), ratio(F.sum("fee"), F.sum(F.col("cents") * F.col("n")) * 10_000).alias("fee_rate"),
        F.percentile("cents", F.lit(0.5), F.col("n")).alias("median_order"), ratio(F.sum(F.when(F.col("cents") < 500, F.col("n")).otherwise(0)), F.sum("n")).alias("small"),
    )
    panel = size.join(wallets, ["category", "month"]).join(F.broadcast(start), "category").withColumn("since", F.col("month") - F.col("start"))  # a row a class
    out = cut(fees.rollout(panel, "category", "since", ["fee_rate", "wallets", "new_wallets", "median_order", "small"], "median_order", "notional", 6, -3, 3))
    before = out.where("since < 0")
    slopes = R.trend(before, ["scope"], "since", "weighted").select("scope", F.round("slope", 6).alias("order_slope")).join(R.trend(before, ["scope"], "since", "new_wallets").select("scope", F.round("slope", 6).alias("new_slope")), "scope")
    return out.join(slopes, "scope", "left").select("scope", "since", "units", F.round("fee_rate", 8).alias("fee_rate"), *[F.round(c, 6).alias(c) for c in ("wallets", "new_wallets", "median_order")], F.round("small", 8).alias("small"), F.round("weighted", 6).alias("weighted_order"), "order_slope", "new_slope")


@query()
def fee_synthetic_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log monthly volume of each market of classes 1 and 2 against the mix of the other classes' means that it followed before
    their fees began, with each of those classes as a placebo."""
    tape = written_fills(spark, sf_dir, "condition_id", "category", "month", "cents", "fee_paying")
    volume = tape.groupBy("condition_id", "category", "month").agg(F.log(F.greatest(F.sum("cents"), F.lit(1))).alias("y"))
    mine, classes = F.col("category").isin(1, 2), [0, 3, 4, 5, 6]
    # donors are named -1 - class, apart from markets
    panel = cut(volume.where(mine).select(F.col("condition_id").alias("unit"), "month", "y").union(volume.where(~mine).groupBy((-1 - F.col("category")).alias("unit"), "month").agg(F.avg("y").alias("y"))))
    start = tape.where(mine).groupBy("category").agg((F.min(F.when(F.col("fee_paying"), F.col("month"))) + F.col("category") * 12).alias("start"))
    markets = volume.where(mine).select(F.col("condition_id").alias("unit"), "category").distinct()
    return K.synthetic_control(panel, "unit", "month", "y", markets.join(F.broadcast(start), "category").select("unit", "start"), [-1 - c for c in classes])  # a row a class
