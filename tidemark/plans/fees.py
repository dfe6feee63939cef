"""Queries on fees, incidence, rebates and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.primitives import counted_quantiles, global_ntile, ratio
from tidemark.plans.base_sql import fills_sql
from tidemark.plans.registry import query
from tidemark.sources.adapters import fills, table, task_count, written_fills
from tidemark.sources.store import cut


@query(fills_sql("""select category, count(*) as n, round(median(r), 8) as median, round(quantile_cont(r, 0.9), 8) as p90, round(quantile_cont(r, 0.99), 8) as p99, round(avg(case when r > 0.06 then 1 else 0 end), 8) as above
 from (select category, cast(fee as double) / (pc * (100 - pc) * q * 100) as r from f where fee > 0) group by 1"""))
def fee_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate that each fee implies under fee = rate * p * (1 - p) * shares. Quantiles come from counts of each rate, by ranges."""
    rate = ratio(F.col("fee"), F.col("pc") * (100 - F.col("pc")) * F.col("q") * 100)
    paid = cut(fills(spark, sf_dir).where("fee > 0").select("category", rate.alias("r")))
    sums = paid.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg((F.col("r") > 0.06).cast("int")), 8).alias("above"))
    q = counted_quantiles(paid, ["category"], "r", {"median": 0.5, "p90": 0.9, "p99": 0.99})
    return sums.join(q, "category").select("category", "n", *[F.round(c, 8).alias(c) for c in ("median", "p90", "p99")], "above")


#: Tasks over which the wallets of a busy market and day are spread, at most.
SLICES = 16

_SHARE = "round(cast(sum(fee) as double) / (sum(cents) * 10000), 8) as fee_share"


def _fee_share():
    return F.round(ratio(F.sum("fee"), F.sum("cents") * 10000), 8).alias("fee_share")


@query(fills_sql(f"select decile, count(*) as n, cast(sum(fee) as bigint) as fee, {_SHARE} from (select *, ntile(10) over (order by cents, tx_hash, evt_index) as decile from f where fee_paying) group by 1"))
def incidence_size_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = fills(spark, sf_dir).where("fee_paying")
    ranked = global_ntile(paid.select("cents", "tx_hash", "evt_index", "fee"), ["cents", "tx_hash", "evt_index"], 10, "decile")
    return ranked.groupBy("decile").agg(F.count("*").alias("n"), F.sum("fee").alias("fee"), _fee_share())


@query(fills_sql(f"select case when pc < 20 then 'longshot' when pc <= 80 then 'middle' else 'favourite' end as band, count(*) as n, {_SHARE}, round(sum(case when pc < 20 then cents else 0 end)::double / (select sum(cents) from f where fee_paying), 8) as longshot from f where fee_paying group by 1"))
def incidence_price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = fills(spark, sf_dir).where("fee_paying")
    band = F.when(F.col("pc") < 20, "longshot").when(F.col("pc") <= 80, "middle").otherwise("favourite")
    grouped = paid.groupBy(band.alias("band")).agg(F.count("*").alias("n"), _fee_share(), F.sum(F.when(F.col("pc") < 20, F.col("cents")).otherwise(0)).alias("l"), F.sum("cents").alias("c"))
    return grouped.select("band", "n", "fee_share", F.round(ratio(F.col("l"), F.sum("c").over(Window.partitionBy(F.lit(1)))), 8).alias("longshot"))


@query(fills_sql(f"select bucket, count(*) as n, {_SHARE} from (select f.*, (cents > e[1])::int + (cents > e[2])::int + (cents > e[3])::int as bucket from f, (select quantile_cont(cents, [0.25, 0.5, 0.75]) as e from f where fee_paying) where fee_paying) group by 1"))
def incidence_quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets between quantile edges: one row of edges, broadcast, instead of a global sort of all rows."""
    paid = fills(spark, sf_dir).where("fee_paying")
    edges = paid.agg(F.percentile("cents", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    bucket = sum(((F.col("cents") > F.col("e")[k]).cast("int") for k in range(3)), F.lit(0))
    return paid.crossJoin(F.broadcast(edges)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), _fee_share())


@query(fills_sql(f"""select month, count(*) as fills, cast(sum(cents) as bigint) as notional, {_SHARE}, round(median(cents), 4) as median_size, round(avg(case when cents < 500 then 1 else 0 end), 8) as small, count(distinct taker) as wallets, count(distinct case when month = first_month then taker end) as new_wallets
 from (select *, min(month) over (partition by taker) as first_month from f) group by 1"""))
def monthly_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallets are counted in a table of one row a (wallet, month); the median comes from counts of each amount."""
    tape = written_fills(spark, sf_dir, "taker", "month", "cents", "fee")
    small = F.count_if(F.col("cents") < 500)
    per = tape.groupBy("taker", "month").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.sum("fee").alias("fee"), small.alias("small"))
    per = per.withColumn("fresh", F.col("month") == F.min("month").over(Window.partitionBy("taker")))
    wallets = per.groupBy("month").agg(
        F.sum("n").alias("fills"), F.sum("cents").alias("notional"), _fee_share(), F.round(ratio(F.sum("small"), F.sum("n")), 8).alias("small"), F.count("*").alias("wallets"), F.count_if("fresh").alias("new_wallets"),
    )
    amounts = tape.groupBy("month", "cents").agg(F.count("*").alias("n"))
    medians = amounts.groupBy("month").agg(F.round(F.percentile("cents", F.lit(0.5), F.col("n")), 4).alias("median_size"))
    return wallets.join(medians, "month").select("month", "fills", "notional", "fee_share", "median_size", "small", "wallets", "new_wallets")


@query(fills_sql("select taker, condition_id, sec, side, count(*) as n, cast(sum(q) as bigint) as q, cast(sum(cents) as bigint) as cents, round(sum(cents)::double / sum(q), 8) as vwap, cast(sum(fee) as bigint) as fee from f group by 1, 2, 3, 4"))
def order_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(spark, sf_dir).groupBy("taker", "condition_id", "sec", "side").agg(
        F.count("*").alias("n"), F.sum("q").alias("q"), F.sum("cents").alias("cents"), F.round(ratio(F.sum("cents"), F.sum("q")), 8).alias("vwap"), F.sum("fee").alias("fee")
    )


@query(fills_sql("""select maker, category, cast(sum((category % 3 + 5) * pc * (100 - pc) * q) as bigint) as base, round(0.2 * cast(sum((category % 3 + 5) * pc * (100 - pc) * q) as double) / 1e6, 6) as rebate from f where not is_taker group by 1, 2"""))
def rebate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of the schedule fee of what a maker filled, by category."""
    base = F.sum((F.col("category") % 3 + 5) * F.col("pc") * (100 - F.col("pc")) * F.col("q"))
    return fills(spark, sf_dir).where("not is_taker").groupBy("maker", "category").agg(base.alias("base"), F.round(0.2 * base.cast("double") / 1e6, 6).alias("rebate"))


@query(fills_sql("""select wallet, min(sec) filter (where role = 't') as first_taker, min(sec) filter (where role = 'm') as first_maker, min(sec) as first_any from (select maker as wallet, 'm' as role, sec from f union all select taker, 't', sec from f) group by 1"""))
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    tape = fills(spark, sf_dir)
    both = tape.select(F.col("maker").alias("wallet"), F.lit("m").alias("role"), "sec").union(tape.select("taker", F.lit("t"), "sec"))
    as_role = lambda r: F.min(F.when(F.col("role") == r, F.col("sec")))
    return both.groupBy("wallet").agg(as_role("t").alias("first_taker"), as_role("m").alias("first_maker"), F.min("sec").alias("first_any"))


@query(fills_sql("""select category, week, cast(sum(w) as bigint) as weight, round(sum(w * (vb - vs)) / nullif(sum(w), 0)::double, 6) as spread from (
 select category, week, token_id, day, least(sum(q) filter (where side = 'BUY'), sum(q) filter (where side = 'SELL')) as w, (sum(cents) filter (where side = 'BUY'))::double / sum(q) filter (where side = 'BUY') as vb, (sum(cents) filter (where side = 'SELL'))::double / sum(q) filter (where side = 'SELL') as vs
 from f group by 1, 2, 3, 4) where w is not null and vb is not null and vs is not null group by 1, 2"""))
def spread_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price of buys less that of sells in a token's day, weighted by the smaller side."""
    leg = lambda c, s: F.sum(F.when(F.col("side") == s, F.col(c)))
    cell = fills(spark, sf_dir).groupBy("category", "week", "token_id", "day").agg(*[leg(c, s).alias(f"{c}_{s}") for c in ("q", "cents") for s in ("BUY", "SELL")])
    cell = cell.where("q_BUY is not null and q_SELL is not null").withColumn("w", F.least("q_BUY", "q_SELL"))
    gap = ratio(F.col("cents_BUY"), F.col("q_BUY")) - ratio(F.col("cents_SELL"), F.col("q_SELL"))
    return cell.groupBy("category", "week").agg(F.sum("w").alias("weight"), F.round(F.sum(F.col("w") * gap) / F.nullif(F.sum("w").cast("double"), F.lit(0.0)), 6).alias("spread"))


@query(fills_sql("""select month, count(*) as builders, round(sum(power(n / tot, 2)), 8) as hhi, round(sum(case when r <= 2 then n else 0 end) / max(tot), 8) as top2 from (
 select month, builder, cast(count(*) as double) as n, cast(sum(count(*)) over (partition by month) as double) as tot, row_number() over (partition by month order by count(*) desc, builder) as r from f group by 1, 2) group by 1"""))
def builder_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fills(spark, sf_dir).groupBy("month", "builder").agg(F.count("*").alias("n"))
    w = Window.partitionBy("month")
    n = n.withColumns({"tot": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.col("n").desc(), "builder"))})
    s = F.col("n") / F.col("tot")
    return n.groupBy("month").agg(F.count("*").alias("builders"), F.round(F.sum(s * s), 8).alias("hhi"), F.round(ratio(F.sum(F.when(F.col("r") <= 2, F.col("n")).otherwise(0)), F.max("tot")), 8).alias("top2"))


@query(fills_sql(f"select condition_id, day, count(*) as n, cast(sum(cents) as bigint) as notional, count(distinct taker) as takers, count(distinct maker) as makers, min(pc) as low, max(pc) as high, {_SHARE} from f group by 1, 2"))
def market_day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fill is told once of its taker, with its amounts, and once of its maker. A cell's wallets are dealt in slices, into tasks by rows."""
    cell, wallet = ["condition_id", "day"], F.col("_e.wallet")
    amounts = ("cents", "pc", "fee")
    of = lambda who, role: F.struct(F.col(who).alias("wallet"), F.lit(role).alias("role"), *[(F.col(c) if role == 0 else F.lit(None).cast("bigint")).alias(c) for c in amounts])
    ends = fills(spark, sf_dir).select(*cell, F.explode(F.array(of("taker", 0), of("maker", 1))).alias("_e")).select(*cell, F.pmod(F.hash(wallet), F.lit(SLICES)).alias("slice"), "_e.*")
    dealt = ends.repartition(task_count(spark, 2 * table(spark, sf_dir, "lineitem").count()), *cell, "slice")
    sums = [F.sum("cents").alias("cents"), F.min("pc").alias("low"), F.max("pc").alias("high"), F.sum("fee").alias("fee")]
    known = dealt.groupBy(*cell, "slice", "role", "wallet").agg(F.count(F.lit(1)).alias("n"), *sums)
    wallets = lambda role: F.count(F.when(F.col("role") == role, F.col("wallet")))
    return known.groupBy(*cell).agg(
        F.sum(F.when(F.col("role") == 0, F.col("n")).otherwise(0)).alias("n"), F.sum("cents").alias("notional"), wallets(0).alias("takers"), wallets(1).alias("makers"), F.min("low").alias("low"), F.max("high").alias("high"), _fee_share()
    )


@query(fills_sql("""select category, month, n, cents, round(cents::double / n, 6) as mean_order, case when start is null then null else month - start end as since, start is not null and month >= start as post
 from (select category, month, count(*) as n, cast(sum(cents) as bigint) as cents, min(case when cast(sum(fee) as double) / (sum(cents) * 10000) >= 0.01 then month end) over (partition by category) as start from f group by 1, 2)"""))
def class_month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class by month with months since fees first reached 1 % of notional."""
    cell = fills(spark, sf_dir).groupBy("category", "month").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.sum("fee").alias("fee"))
    paid = ratio(F.col("fee"), F.col("cents") * 10000) >= 0.01
    cell = cell.withColumn("start", F.min(F.when(paid, F.col("month"))).over(Window.partitionBy("category")))
    return cell.select("category", "month", "n", "cents", F.round(ratio(F.col("cents"), F.col("n")), 6).alias("mean_order"), (F.col("month") - F.col("start")).alias("since"), F.coalesce(F.col("month") >= F.col("start"), F.lit(False)).alias("post"))


@query(fills_sql("""select condition_id, min(day) as birth, min(day) filter (where fee > 0) as fee_day, coalesce(min(day) filter (where fee > 0) = min(day), false) as from_birth, coalesce(min(day) filter (where fee > 0) > min(day), false) as switched from f group by 1"""))
def fee_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = fills(spark, sf_dir).groupBy("condition_id").agg(F.min("day").alias("birth"), F.min(F.when(F.col("fee") > 0, F.col("day"))).alias("fee_day"))
    return per.withColumns({"from_birth": F.coalesce(F.col("fee_day") == F.col("birth"), F.lit(False)), "switched": F.coalesce(F.col("fee_day") > F.col("birth"), F.lit(False))})


@query(fills_sql(f"""select tenure, size, count(*) as n, {_SHARE}, round(avg(case when fee = 0 then 1 else 0 end), 8) as exempt from (
 select f.*, case when day - min(day) over (partition by taker) < 365 then 'new' else 'old' end as tenure, case when cents < 500 then 's' when cents < 2000 then 'm' else 'l' end as size from f) group by 1, 2"""))
def incidence_tenure_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    tape = fills(spark, sf_dir)
    first = tape.groupBy("taker").agg(F.min("day").alias("d0"))
    tenure = F.when(F.col("day") - F.col("d0") < 365, "new").otherwise("old").alias("tenure")
    size = F.when(F.col("cents") < 500, "s").when(F.col("cents") < 2000, "m").otherwise("l").alias("size")
    return tape.join(first, "taker").groupBy(tenure, size).agg(F.count("*").alias("n"), _fee_share(), F.round(F.avg((F.col("fee") == 0).cast("int")), 8).alias("exempt"))
