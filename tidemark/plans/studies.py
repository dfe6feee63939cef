"""Queries on forms of aggregation and dedup, price series, fees, cohorts, classes and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import classify, fees
from tidemark.operators import concentration as C
from tidemark.operators import paths as P
from tidemark.operators import skill as K
from tidemark.operators.primitives import cleaned_map, correlation, dedup_narrow, global_ntile, merged_last, ratio, running, slope
from tidemark.plans.base_sql import fills_sql, raw_sql
from tidemark.plans.exclusive import _COVERED
from tidemark.plans.flow import _pnl_cte
from tidemark.plans.prices import _AT, _CONV, _HL, _MK, TIE, _convergence, hourly_last
from tidemark.plans.registry import query
from tidemark.sources.adapters import FILL_ORDER, fills, raw_fills, table, written_fills
from tidemark.sources.store import cut

# Forms of dedup, distinct and aggregation.


@query(fills_sql("select tx_hash, evt_index, sec, maker, taker, pc, q from f"))
def narrow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a key with narrow state (D03): the least order by key is aggregated, wide rows are only semi-joined."""
    return dedup_narrow(raw_fills(spark, sf_dir), ["tx_hash", "evt_index"], FILL_ORDER).select("tx_hash", "evt_index", "sec", "maker", "taker", "pc", "q")


@query(fills_sql("select tx_hash, evt_index, cents, fee from f"))
def identical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows logged twice, alike in every column: any survivor will do, so no order is asked for."""
    once = fills(spark, sf_dir).select("tx_hash", "evt_index", "cents", "fee")
    return once.union(once).dropDuplicates(["tx_hash", "evt_index"])


@query(fills_sql("select count(distinct tx_hash) as transactions, count(distinct maker) as makers from f"))
def disjoint_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction lies in one block range, so distinct counts of ranges add up (D08); makers do not, and are counted whole."""
    tape = fills(spark, sf_dir)
    parts = tape.groupBy(F.expr("tx_hash div 1000").alias("part")).agg(F.countDistinct("tx_hash").alias("n"))
    return parts.agg(F.sum("n").alias("transactions")).crossJoin(F.broadcast(tape.agg(F.countDistinct("maker").alias("makers"))))


@query(fills_sql("select category, week, round(sum(cents)::double / sum(cents / pc::double), 8) as harmonic, round(sum(cents)::double / sum(q), 8) as vwap, round(exp(avg(ln(cents))), 6) as geometric from f where pc > 0 and cents > 0 group by 1, 2"))
def mean_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonic mean price (A13), volume-weighted mean price (A12), geometric mean order."""
    tape = fills(spark, sf_dir).where("pc > 0 and cents > 0")
    return tape.groupBy("category", "week").agg(
        F.round(F.sum("cents").cast("double") / F.sum(F.col("cents") / F.col("pc").cast("double")), 8).alias("harmonic"),
        F.round(ratio(F.sum("cents"), F.sum("q")), 8).alias("vwap"), F.round(F.exp(F.avg(F.log("cents"))), 6).alias("geometric"),
    )


@query(fills_sql("select category, count(*) as n, true as near from f group by 1"))
def approximate_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from a sketch of bounded size (A09): the share of rows below each is within a hundredth of what was asked."""
    tape = written_fills(spark, sf_dir, "category", "cents")
    asked = (0.5, 0.9, 0.99)
    q = tape.groupBy("category").agg(F.percentile_approx("cents", list(asked), 10_000).alias("q"))
    below = [F.avg((F.col("cents") < F.col("q")[k]).cast("double")).alias(f"b{k}") for k in range(3)]
    upto = [F.avg((F.col("cents") <= F.col("q")[k]).cast("double")).alias(f"u{k}") for k in range(3)]
    per = tape.join(F.broadcast(q), "category").groupBy("category").agg(F.count(F.lit(1)).alias("n"), *below, *upto)
    near = [(F.col(f"b{k}") <= p + 0.01) & (F.col(f"u{k}") >= p - 0.01) for k, p in enumerate(asked)]
    return per.select("category", "n", (near[0] & near[1] & near[2]).alias("near"))


@query(fills_sql("select token_id, arg_max(pc, (sec, tx_hash, evt_index)) as p, max(sec) as at_sec, count(*) as n, cast(sum(cents) as bigint) as cents from f group by 1"))
def merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last prices and sums by part, kept, and merged later (A11, A22): what is merged equals what is computed at once."""
    tape = fills(spark, sf_dir)
    parts = [merged_last(tape.where(F.col("tx_hash") % 3 == k), ["token_id"], "pc", ["sec", "tx_hash", "evt_index"]) for k in range(3)]
    kept = cut(parts[0].union(parts[1]).union(parts[2]))
    both = kept.groupBy("token_id").agg(F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    return both.select("token_id", F.col("last.pc").alias("p"), F.col("last.sec").alias("at_sec"), "n", "cents")


@query(fills_sql("select token_id, count(*) as fills, count(*) filter (where side is distinct from prev) as turns from (select *, lag(side) over (partition by token_id order by sec, tx_hash, evt_index) as prev from f) group by 1"))
def side_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a token's flow turns; the first fill differs from nothing, by null-safe inequality."""
    held = running(fills(spark, sf_dir).select("token_id", "sec", *TIE, "side"), ["token_id"], ["sec", *TIE], 2_592_000, before={"prior": F.col("side")})
    turned = ~F.col("side").eqNullSafe(F.col("prior"))
    return held.select("token_id", turned.alias("turned")).groupBy("token_id").agg(F.count(F.lit(1)).alias("fills"), F.count_if("turned").alias("turns"))


@query(fills_sql("select f.category, round(avg((outcome_index = winner)::int - d.rate), 8) as excess from f join (select floor(pc / 10.0) as k, avg((outcome_index = winner)::int) as rate from f group by 1) d on floor(f.pc / 10.0) = d.k group by 1"))
def decile_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win rates less those of the price decile: a join on a computed key with ten rows."""
    tape = written_fills(spark, sf_dir, "category", "pc", "outcome_index", "winner").withColumns({"k": F.expr("pc div 10"), "won": (F.col("outcome_index") == F.col("winner")).cast("int")})
    rate = tape.groupBy("k").agg(F.avg("won").alias("rate"))
    return tape.join(F.broadcast(rate), "k").groupBy("category").agg(F.round(F.avg(F.col("won") - F.col("rate")), 8).alias("excess"))


@query(fills_sql("select g.family, g.hour, count(*) as candidates from (select distinct family, hour from fh) g join al on g.family = al.family and g.hour between lo and hi group by 1, 2", *_COVERED[:2]))
def candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each hour in which a family trades (a daily grid here), how many of its candidates are alive."""
    per = fills(spark, sf_dir).where("outcome_index = 0").select("family", "condition_id", F.col("day").alias("hour")).distinct()
    members = per.groupBy("family", "condition_id").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))
    alive = members.select("family", F.explode(F.sequence("first_hour", "last_hour")).alias("hour")).groupBy("family", "hour").agg(F.count(F.lit(1)).alias("candidates"))
    return per.select("family", "hour").distinct().join(alive, ["family", "hour"])


@query(fills_sql("select 'both' as part, count(*) as n from (select maker from f intersect select taker from f) union all select 'makers only', count(*) from (select maker from f except select taker from f) union all select 'all', count(*) from (select maker from f union select taker from f)"))
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and union of two sets of ids."""
    tape = fills(spark, sf_dir)
    m, t = tape.select(F.col("maker").alias("id")).distinct(), tape.select(F.col("taker").alias("id")).distinct()
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(m.intersect(t), "both").union(count(m.subtract(t), "makers only")).union(count(m.union(t).distinct(), "all"))


@query(fills_sql("select round(avg(pnl) filter (where pnl > 0), 4) as mean_won, count(*) filter (where pnl > 0) as n, min(case when cum >= 0.5 * total then r end) as wallets_for_50, min(case when cum >= 0.9 * total then r end) as wallets_for_90, min(case when cum >= 0.99 * total then r end) as wallets_for_99, " + ", ".join(f"round(sum(case when r <= ceil(n * {s}) then pnl else 0 end)::double / max(total), 8) as top_share_{k}" for k, s in enumerate((0.001, 0.01, 0.1))) + ", " + ", ".join(f"round(sum(case when r <= {k} then pnl else 0 end)::double / max(total), 8) as first{k}" for k in (100, 1000)) + " from (select *, row_number() over (order by pnl desc, wallet) as r, sum(pnl) over (order by pnl desc, wallet rows unbounded preceding) as cum, sum(pnl) over () as total, count(*) over () as n from (select wallet, cast(sum(gross) as bigint) as pnl from pl group by 1 having sum(gross) > 0))", _pnl_cte("f", "taker", "q")))
def winners_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How few winners hold how much of all winnings."""
    won = cut(K.covered_pnl(fills(spark, sf_dir), "taker", "q").groupBy("wallet").agg(F.sum("gross").alias("w")).where("w > 0"))
    mean = won.agg(F.round(F.avg("w"), 4).alias("mean_won"))
    return C.top_profile(won, firsts=(100, 1000)).crossJoin(F.broadcast(mean))


# Price series.

_V1 = """m1 as (select condition_id, coalesce(max(sec) filter (where fee_paying and tx_hash % 3 > 0), max(sec)) as anchor, case when max(sec) filter (where fee_paying and tx_hash % 3 > 0) is null then 'close' else 'resolved' end as source, max(case when outcome_index = winner then outcome_index else 1 - outcome_index end) as win from f group by 1),
 v1 as (select condition_id, anchor, source, win, count(*) as n, count(*) filter (where sec > anchor) as late, """ + ", ".join(f"arg_max(p0, (sec, tx_hash, evt_index)) filter (where sec <= anchor - {h * 3600}) as p_{h}h" for h in (168, 24, 0)) + " from (select f.*, m1.anchor, m1.source, m1.win, case when outcome_index = 0 then pc else 100 - pc end as p0 from f join m1 using (condition_id)) group by 1, 2, 3, 4)"


@query(fills_sql("select * from v1", _V1))
def price_series_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices before an anchor that is the resolution where one is known, else the close; the winner from either leg."""
    tape = written_fills(spark, sf_dir, "condition_id", "outcome_index", "winner", "fee_paying", "sec", "pc", *TIE)
    known = F.max(F.when(F.col("fee_paying") & (F.col("tx_hash") % 3 > 0), F.col("sec")))
    leg = F.when(F.col("outcome_index") == F.col("winner"), F.col("outcome_index")).otherwise(1 - F.col("outcome_index"))
    meta = tape.groupBy("condition_id").agg(F.coalesce(known, F.max("sec")).alias("close_sec"), F.when(known.isNull(), "close").otherwise("resolved").alias("source"), F.max(leg).alias("win"), F.count(F.lit(1)).alias("n"))
    prices = P.price_at_offsets(tape, meta, (168, 24, 0), TIE)
    late = tape.join(meta.select("condition_id", "close_sec"), "condition_id").groupBy("condition_id").agg(F.count_if(F.col("sec") > F.col("close_sec")).alias("late"))
    return meta.join(late, "condition_id").join(prices, "condition_id", "left").select("condition_id", F.col("close_sec").alias("anchor"), "source", "win", "n", "late", "p_168h", "p_24h", "p_0h")


@query(fills_sql("select hours, least(p // 10, 9) as decile, count(*) as n, round(avg(p) / 100, 8) as predicted, round(avg((winner = 0)::int), 8) as empirical from cv join mk using (condition_id) group by 1, 2", _MK, _AT, _CONV))
def series_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by horizon against results, by decile."""
    won = (F.col("error") != F.col("p")).cast("int")  # outcome 0 won where the price falls short of 100, not of 0
    cell = _convergence(spark, sf_dir).groupBy("hours", F.least(F.expr("p div 10"), F.lit(9)).alias("decile"))
    return cell.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p") / 100, 8).alias("predicted"), F.round(F.avg(won), 8).alias("empirical"))


@query(fills_sql("select category, back, count(*) as n, round(avg(p), 6) as mean, round(median(p), 6) as median from (select condition_id, category, back, arg_max(pc, (sec, tx_hash, evt_index)) as p from (select f.*, x.back from f join (select condition_id, max(day) as last_day from f group by 1) l using (condition_id), (select unnest([0, 1, 7, 14]) as back) x where outcome_index = winner and day <= last_day - back) group by 1, 2, 3) group by 1, 2"))
def winner_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner's last price some days before the last day, from daily last prices (V08): parts of a day are merged, not read again."""
    tape = fills(spark, sf_dir).select("condition_id", "category", "outcome_index", "winner", "day", "sec", *TIE, "pc")
    last = F.max(F.when(F.col("outcome_index") == F.col("winner"), F.struct("sec", *TIE, "pc")))
    daily = cut(tape.groupBy("condition_id", "category", "day").agg(last.alias("last")))
    end = daily.groupBy("condition_id").agg(F.max("day").alias("last_day"))
    asked = daily.join(end, "condition_id").select("condition_id", "category", "day", "last", "last_day", F.explode(F.array(*map(F.lit, (0, 1, 7, 14)))).alias("back")).where("day <= last_day - back and last is not null")
    price = asked.groupBy("condition_id", "category", "back").agg(F.max("last")["pc"].alias("p"))
    return price.groupBy("category", "back").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.median("p"), 6).alias("median"))


@query(fills_sql("select hours, mk.category, band, count(*) as n, round(avg((abs_error > 50)::int), 8) as wrong, round(avg((abs_error <= 5)::int), 8) as within5 from cv join mk using (condition_id) join (select condition_id, case when sum(cents) < 500000 then 'small' else 'large' end as band from f group by 1) using (condition_id) group by 1, 2, 3", _MK, _AT, _CONV))
def convergence_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convergence by class and notional band."""
    tape = fills(spark, sf_dir)
    cuts = tape.groupBy("condition_id").agg(F.max("category").alias("category"), F.when(F.sum("cents") < 500_000, "small").otherwise("large").alias("band"))
    share = lambda c: F.round(F.avg(c.cast("int")), 8)
    return _convergence(spark, sf_dir).join(cuts, "condition_id").groupBy("hours", "category", "band").agg(F.count(F.lit(1)).alias("n"), share(F.col("abs_error") > 50).alias("wrong"), share(F.col("abs_error") <= 5).alias("within5"))


_JUMP = "jp as (select token_id, hour, p, max24, prior from (select *, max(p) over (w range between 24 preceding and 1 preceding) as max24, last_value(p) over (w range between 12 preceding and 1 preceding) as prior from hl window w as (partition by token_id order by hour)) where max24 < 70 and p >= 70 and prior < 50)"


@query(fills_sql("select jp.token_id, jp.hour, " + ", ".join(f"arg_max(h.p, h.hour) filter (where h.hour <= jp.hour - {b}) as p_{b}h" for b in (12, 3, 1)) + ", (select count(distinct taker) from f where f.token_id = jp.token_id and f.side = 'BUY' and f.hour >= jp.hour - 48 and f.hour < jp.hour) as early_buyers from jp left join hl h on h.token_id = jp.token_id and h.hour < jp.hour and h.hour >= jp.hour - 48 group by 1, 2", _HL, _JUMP))
def jump_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices twelve, three and one hour before a jump, and who bought in the two days before it."""
    hourly = cut(hourly_last(spark, sf_dir))
    jumps = cut(P.jumps(hourly).select("token_id", F.col("hour").alias("at")))
    span = [F.expr("at div 48") + d for d in (-1, 0)]
    asked = jumps.withColumn("b", F.explode(F.array(*span)))
    near = asked.join(hourly.withColumn("b", F.expr("hour div 48")), ["token_id", "b"]).where("hour < at and hour >= at - 48")
    back = lambda k: F.max(F.when(F.col("hour") <= F.col("at") - k, F.struct("hour", "p")))["p"].alias(f"p_{k}h")
    prices = near.groupBy("token_id", "at").agg(*map(back, (12, 3, 1)))
    bought = fills(spark, sf_dir).where("side = 'BUY'").select("token_id", "hour", "taker").withColumn("b", F.expr("hour div 48"))
    early = asked.join(bought, ["token_id", "b"]).where("hour < at and hour >= at - 48").groupBy("token_id", "at").agg(F.countDistinct("taker").alias("early_buyers"))
    out = jumps.join(prices, ["token_id", "at"], "left").join(early, ["token_id", "at"], "left")
    return out.select("token_id", F.col("at").alias("hour"), "p_12h", "p_3h", "p_1h", F.coalesce("early_buyers", F.lit(0)).alias("early_buyers"))


@query("select book_id, cents, cast(sum(case when k <= cents then 10 + (book_id * k) % 13 else 0 end) as bigint) as bid_depth, cast(sum(case when k <= cents then 8 + (book_id * k) % 11 else 0 end) as bigint) as ask_depth from (select s_suppkey as book_id from supplier), range(0, 6) r(k), (select unnest([1, 2, 5]) as cents) group by 1, 2")
def orderbook_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth within one, two and five cents of the best price on either side."""
    book = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("book_id"), F.explode(F.array(*map(F.lit, (1, 2, 5)))).alias("cents"))
    side = lambda base, m: F.aggregate(F.sequence(F.lit(0), F.col("cents")), F.lit(0).cast("bigint"), lambda a, k: a + base + (F.col("book_id") * k) % m)
    return book.select("book_id", "cents", side(10, 13).alias("bid_depth"), side(8, 11).alias("ask_depth"))


# Fees.


@query(fills_sql("select category, cast(sum(10 * least(pc, 100 - pc) * q) as bigint) as v1_buy_base, round(sum(case when side = 'SELL' then (10 * least(pc, 100 - pc) * q / 100.0) / nullif(pc, 0) * pc else 10 * least(pc, 100 - pc) * q / 100.0 end), 4) as v1_cents, cast(sum((category % 3 + 5) * pc * (100 - pc) * q) as bigint) as v2_millionths, round(avg((category % 3 + 5) / 100.0 * (1 - pc / 100.0)), 8) as incidence from f where pc > 0 group by 1"))
def fee_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fee laws and the incidence of the second (F01); sales are logged in shares under the first and turned into money."""
    tape = fills(spark, sf_dir).where("pc > 0")
    rate = F.col("category") % 3 + 5
    logged = fees.law_v1(F.col("pc"), F.col("q"), F.col("side"))
    return tape.groupBy("category").agg(
        F.sum(10 * F.least("pc", 100 - F.col("pc")) * F.col("q")).alias("v1_buy_base"), F.round(F.sum(fees.in_money(logged, F.col("pc"), F.col("side"))), 4).alias("v1_cents"),
        F.sum(fees.law_v2(rate, F.col("pc"), F.col("q"))).alias("v2_millionths"), F.round(F.avg(fees.incidence_v2(rate, F.col("pc"))), 8).alias("incidence"),
    )


_FS = "fs as (select category, min(month) filter (where fee_paying) + category * 3 as start from f group by 1), pn as (select f.category, f.month - fs.start as since, count(*) as n, cast(sum(cents) as bigint) as cents, ln(sum(cents)) as y from f join fs using (category) group by 1, 2)"


@query(fills_sql("select since, count(*) as classes, round(avg(y - base), 8) as effect from pn join (select category, avg(y) as base from pn where since between -6 and -1 group by 1) using (category) where since between -6 and 6 group by 1", _FS))
def fee_event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log volume by months since a class's fee start, less its mean in the six months before."""
    return fees.event_study(_class_months(spark, sf_dir), "category", "since", "y", 6)


def _class_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log notional by class and months since the class's start; starts are staggered by three months a class."""
    tape = written_fills(spark, sf_dir, "category", "month", "cents", "fee_paying")
    start = tape.groupBy("category").agg((F.min(F.when(F.col("fee_paying"), F.col("month"))) + F.col("category") * 3).alias("start"))
    return tape.join(F.broadcast(start), "category").groupBy("category", (F.col("month") - F.col("start")).alias("since")).agg(F.log(F.sum("cents")).alias("y"))


@query(fills_sql("select category, count(*) as months, round(regr_slope(y, since), 8) as slope from pn where since between -12 and -1 group by 1", _FS))
def fee_pre_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope of log volume in the year before a class's fee start."""
    before = _class_months(spark, sf_dir).where("since between -12 and -1")
    return before.groupBy("category").agg(F.count(F.lit(1)).alias("months"), F.round(slope("y", "since"), 8).alias("slope"))


_MIN = "mn as (select category, condition_id, week, token_id, minute, sum(q) filter (where side = 'BUY') as qb, sum(q) filter (where side = 'SELL') as qs, sum(cents) filter (where side = 'BUY') as cb, sum(cents) filter (where side = 'SELL') as cs from f group by 1, 2, 3, 4, 5)"
_SPREAD = "count(*) filter (where qb is not null and qs is not null) as minutes, round(sum(least(qb, qs) * (cb / qb::double - cs / qs::double)) / nullif(sum(case when qb is not null and qs is not null then least(qb, qs) end), 0)::double, 6) as spread, cast(sum(coalesce(cb, 0) + coalesce(cs, 0)) as bigint) as notional"


@query(fills_sql(f"select 'class' as level, category as id, week, {_SPREAD} from mn group by 2, 3 union all select 'market', condition_id, week, {_SPREAD} from mn group by 2, 3", _MIN))
def week_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-week and market-week panels with the minute spread proxy (F13), from one pass over minutes."""
    leg = lambda c, s: F.sum(F.when(F.col("side") == s, F.col(c)))
    minutes = fills(spark, sf_dir).groupBy("category", "condition_id", "week", "token_id", "minute").agg(leg("q", "BUY").alias("qb"), leg("q", "SELL").alias("qs"), leg("cents", "BUY").alias("cb"), leg("cents", "SELL").alias("cs"))
    both = F.col("qb").isNotNull() & F.col("qs").isNotNull()
    w = F.when(both, F.least("qb", "qs"))
    gap = ratio(F.col("cb"), F.col("qb")) - ratio(F.col("cs"), F.col("qs"))
    sums = [F.count_if(both).alias("minutes"), F.sum(w * gap).alias("s"), F.sum(w).alias("w"), F.sum(F.coalesce("cb", F.lit(0)) + F.coalesce("cs", F.lit(0))).alias("notional")]
    market = cut(minutes.groupBy("category", "condition_id", "week").agg(*sums))
    whole = market.groupBy("category", "week").agg(*[F.sum(c).alias(c) for c in ("minutes", "s", "w", "notional")])
    show = lambda df, level, key: df.select(F.lit(level).alias("level"), F.col(key).alias("id"), "week", "minutes", F.round(F.col("s") / F.nullif(F.col("w").cast("double"), F.lit(0.0)), 6).alias("spread"), "notional")
    return show(whole, "class", "category").union(show(market, "market", "condition_id"))


@query(fills_sql("select month, count(*) as builders, round(sum(n * n) / power(sum(n), 2), 8) as hhi, round(sum(case when r <= 8 then n else 0 end) / sum(n), 8) as top8 from (select month, tx_hash * 7 % 40 as b, cast(count(*) as double) as n, row_number() over (partition by month order by count(*) desc, tx_hash * 7 % 40) as r from f group by 1, 2) group by 1"))
def builder_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution to forty builders: the share of the first eight and the Herfindahl index."""
    n = fills(spark, sf_dir).groupBy("month", (F.col("tx_hash") * 7 % 40).alias("wallet")).agg(F.count(F.lit(1)).alias("w"))
    return C.concentration(n, ["month"], (8,)).select("month", F.col("n").alias("builders"), "hhi", "top8")


# Cohorts, classes, registries.

_COHORT = """ch as (select month // 12 as cohort, count(*) as fills, cast(sum(cents) as bigint) as notional, count(distinct taker) as takers, count(distinct maker) as makers, round(exp(avg(ln(greatest(cents, 1)))), 6) as geometric_order, round(sum(fee)::double / (sum(cents) * 10000), 8) as fee_share, round(avg((cents < 500)::int), 8) as small from f group by 1)"""
_COHORT_HHI = "hh as (select cohort, round(sum(w * w) / power(sum(w), 2), 8) as maker_hhi from (select month // 12 as cohort, maker, cast(sum(cents) as double) as w from f group by 1, 2) group by 1)"


@query(fills_sql("select * from ch join hh using (cohort)", _COHORT, _COHORT_HHI))
def cohort_descriptives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each yearly cohort's size, concentration and fees."""
    return _cohorts(spark, sf_dir)


def _cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tape = written_fills(spark, sf_dir, "month", "taker", "maker", "cents", "fee").withColumn("cohort", F.expr("month div 12"))
    size = tape.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("fills"), F.sum("cents").alias("notional"), F.countDistinct("taker").alias("takers"), F.countDistinct("maker").alias("makers"),
        F.round(F.exp(F.avg(F.log(F.greatest("cents", F.lit(1))))), 6).alias("geometric_order"), F.round(ratio(F.sum("fee"), F.sum("cents") * 10_000), 8).alias("fee_share"),
        F.round(F.avg((F.col("cents") < 500).cast("int")), 8).alias("small"),
    )
    w = F.col("w").cast("double")
    hhi = tape.groupBy("cohort", "maker").agg(F.sum("cents").alias("w")).groupBy("cohort").agg(F.round(F.sum(w * w) / (F.sum(w) * F.sum(w)), 8).alias("maker_hhi"))
    return size.join(hhi, "cohort")


@query(fills_sql("select measure, count(*) as cohorts, round(regr_slope(y, cohort), 6) as slope, round(corr(y, cohort), 6) as r from (select cohort, 'fee_share' as measure, fee_share as y from ch union all select cohort, 'geometric_order', geometric_order from ch union all select cohort, 'small', small from ch union all select cohort, 'maker_hhi', maker_hhi from hh) group by 1", _COHORT, _COHORT_HHI))
def cohort_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend of each measure across cohorts."""
    names = ["fee_share", "geometric_order", "small", "maker_hhi"]
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    long = _cohorts(spark, sf_dir).selectExpr("cohort", f"stack({len(names)}, {pairs}) as (measure, y)")
    return long.groupBy("measure").agg(F.count(F.lit(1)).alias("cohorts"), F.round(slope("y", "cohort"), 6).alias("slope"), F.round(correlation("y", "cohort"), 6).alias("r"))


@query("""select p_partkey, case when broad <> 'sports' and (regexp_matches(slug, '\\b(old|new)\\b') or list_contains(tags, 'brass')) then 'world' when broad <> 'sports' and list_contains(tags, 'steel') then 'macro'
 when broad = 'sports' and regexp_matches(slug, 'ring') then 'esports' when broad = 'crypto' and (regexp_matches(slug, '^(hot|cold)') or list_contains(tags, 'tin')) then 'updown' else broad end as class
 from (select p_partkey, lower(p_name) as slug, string_split(lower(p_type), ' ') as tags, case when regexp_matches(lower(p_type), '^promo') then 'sports' when regexp_matches(lower(p_type), '^eco') then 'crypto' when p_size > 40 then 'politics' else 'other' end as broad from part)""")
def fee_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with precedence (R02): topics are recaptured unless the first tag says sports, the slug splits sports and crypto."""
    kind = F.lower("p_type")
    broad = F.when(kind.rlike("^promo"), "sports").when(kind.rlike("^eco"), "crypto").when(F.col("p_size") > 40, "politics").otherwise("other")
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("slug"), F.split(kind, " ").alias("tags"), broad.alias("broad"))
    return part.select("p_partkey", classify.with_recapture("broad", "slug", "tags", gate="sports", recapture=[("world", r"\b(old|new)\b", "brass"), ("macro", None, "steel")], split=[("sports", "esports", "ring", None), ("crypto", "updown", "^(hot|cold)", "tin")]).alias("class"))


@query("select p_partkey, case when regexp_matches(lower(p_name), '\\b(rod)\\b|\\b(ring)\\b|\\bwidget') then 'metal' when regexp_matches(lower(p_name), '\\b(red)\\b|\\b(blue)\\b') then 'colour' when p_brand like '%1' then 'first' else 'other' end as class, regexp_matches(lower(p_name), '\\b(rod)\\b|\\b(ring)\\b|\\bwidget|\\b(red)\\b|\\b(blue)\\b') as by_keyword from part")
def keyword_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered keyword rules, short words matched whole, and a refined label where none fits."""
    fallback = F.when(F.col("p_brand").endswith("1"), "first").otherwise("other")
    cls, found = classify.keyword_class(F.lower("p_name"), [("metal", ["rod", "ring", "widget"]), ("colour", ["red", "blue"])], fallback)
    return table(spark, sf_dir, "part").select("p_partkey", cls.alias("class"), found.alias("by_keyword"))


@query(fills_sql("""select status, count(*) as txs, cast(sum(taken) as bigint) as taken, cast(sum(made) as bigint) as made from (select tx_hash, condition_id, coalesce(sum(q) filter (where is_taker), 0) as taken, coalesce(sum(q) filter (where not is_taker), 0) as made,
 case when count(*) filter (where is_taker) = 0 then 'no taker' when count(*) filter (where not is_taker) = 0 then 'no maker' when coalesce(sum(q) filter (where is_taker), 0) = coalesce(sum(q) filter (where not is_taker), 0) then 'conserved' else 'off' end as status from f group by 1, 2) group by 1"""))
def fill_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taker orders matched with maker fills in each transaction and market, and whether shares are conserved."""
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("q"))), F.lit(0))
    taker = F.col("is_taker")
    per = fills(spark, sf_dir).groupBy("tx_hash", "condition_id").agg(side(taker).alias("taken"), side(~taker).alias("made"), F.count_if(taker).alias("nt"), F.count_if(~taker).alias("nm"))
    status = F.when(F.col("nt") == 0, "no taker").when(F.col("nm") == 0, "no maker").when(F.col("taken") == F.col("made"), "conserved").otherwise("off")
    return per.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("txs"), F.sum("taken").alias("taken"), F.sum("made").alias("made"))


@query(raw_sql("select month, count(distinct case when evt_index <= 4 then tx_hash end) as base, count(distinct tx_hash) as whole, round(1 - count(distinct case when evt_index <= 4 then tx_hash end)::double / count(distinct tx_hash), 8) as gain from raw group by 1"))
def coverage_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many transactions a second source adds to the first."""
    per = raw_fills(spark, sf_dir).groupBy("tx_hash", "month").agg(F.min("evt_index").alias("least"))  # where the tape lies, by transaction
    out = per.groupBy("month").agg(F.count_if(F.col("least") <= 4).alias("base"), F.count("tx_hash").alias("whole"))
    return out.withColumn("gain", F.round(1 - ratio(F.col("base"), F.col("whole")), 8))


@query(fills_sql("select account, decile, count(*) as wallets, cast(sum(pnl) as bigint) as pnl from (select case substr(md5(wallet || 'code'), 1, 1) when '0' then 'none' when '1' then 'none' when '2' then 'proxy' when '3' then 'proxy' when '4' then 'safe' else 'other' end as account, pnl, ntile(10) over (order by pnl, wallet) as decile from (select wallet, cast(sum(gross) as bigint) as pnl from pl group by 1)) group by 1, 2", _pnl_cte("f", "taker", "q")))
def bytecode_pnl_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account types by the hash of their code, across deciles of profit."""
    per = K.covered_pnl(fills(spark, sf_dir), "taker", "q").groupBy("wallet").agg(F.sum("gross").alias("pnl"))
    code = F.substring(F.md5(F.concat(F.col("wallet").cast("string"), F.lit("code")).cast("binary")), 1, 1)
    known = spark.createDataFrame([("0", "none"), ("1", "none"), ("2", "proxy"), ("3", "proxy"), ("4", "safe")], "code string, kind string")
    ranked = global_ntile(per, ["pnl", "wallet"], 10, "decile").withColumn("code", code).join(F.broadcast(known), "code", "left")
    return ranked.groupBy(F.coalesce("kind", F.lit("other")).alias("account"), "decile").agg(F.count(F.lit(1)).alias("wallets"), F.sum("pnl").alias("pnl"))


@query(fills_sql("select condition_id, count(*) filter (where side = 'BUY') as mints, count(*) filter (where side = 'SELL') as merges, cast(coalesce(sum(sets) filter (where side = 'BUY'), 0) as bigint) as minted, cast(coalesce(sum(sets) filter (where side = 'SELL'), 0) as bigint) as merged from (select condition_id, tx_hash, side, least(sum(q) filter (where outcome_index = 0), sum(q) filter (where outcome_index = 1)) as sets from f group by 1, 2, 3 having min(outcome_index) = 0 and max(outcome_index) = 1) group by 1"))
def mint_and_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets bought on both outcomes of a market in one transaction must have been made, sets sold merged."""
    leg = lambda k: F.sum(F.when(F.col("outcome_index") == k, F.col("q")))
    cell = fills(spark, sf_dir).groupBy("condition_id", "tx_hash", "side").agg(leg(0).alias("q0"), leg(1).alias("q1")).where("q0 is not null and q1 is not null").withColumn("sets", F.least("q0", "q1"))
    buy = F.col("side") == "BUY"
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("sets"))), F.lit(0))
    return cell.groupBy("condition_id").agg(F.count_if(buy).alias("mints"), F.count_if(~buy).alias("merges"), total(buy).alias("minted"), total(~buy).alias("merged"))


_CLEAN = ["c0 as (select b, c from (select unnest(range((select min(tx_hash // 200) from f), (select max(tx_hash // 200) from f) + 1)) as b) left join (select tx_hash // 200 as b, median(sec) as c from f group by 1) using (b))"]
for _k in range(3):
    _CLEAN.append(f"m{_k} as (select b, c, case when count(c) over w >= 3 then median(c) over w end as m from c{_k} window w as (order by b rows between 15 preceding and 15 following)), c{_k + 1} as (select b, case when abs(c - m) > 20000000 then null else c end as c from m{_k})")
_CLEAN.append("""ci as (select b, coalesce(c, case when lc is null then nc when nc is null then lc else lc + (nc - lc) * (b - lb)::double / (nb - lb) end) as c from (select b, c, last_value(c ignore nulls) over p as lc, last_value(case when c is not null then b end ignore nulls) over p as lb, first_value(c ignore nulls) over n as nc, first_value(case when c is not null then b end ignore nulls) over n as nb from c3
 window p as (order by b rows between unbounded preceding and current row), n as (order by b rows between current row and unbounded following)))""")


@query(fills_sql("select b as bin, round(max(s) over (order by b rows unbounded preceding), 4) as sec from (select b, median(c) over (order by b rows between 2 preceding and 2 following) as s from ci)", *_CLEAN))
def time_map_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block-to-time map freed of spikes in three rounds, filled, smoothed and made monotone (R18, W12). One row a bin is ordered."""
    bins = fills(spark, sf_dir).groupBy(F.expr("tx_hash div 200").alias("bin")).agg(F.median("sec").alias("c"))
    return cleaned_map(cut(bins), "bin", "c", 20_000_000.0).select("bin", F.round("c", 4).alias("sec"))


@query(raw_sql("""select (select count(*) from (select tx_hash, count(*) filter (where outcome_index = 0) as a, count(*) filter (where outcome_index = 1) as b from raw group by 1) where a <> b) as uneven_lists, (select count(*) from (select token_id, sec from raw group by 1, 2 having count(*) > 1)) as repeated_times,
 (select count(*) from (select token_id, sec - lag(sec) over (partition by token_id order by sec) as gap from (select distinct token_id, sec from raw)) where gap > 864000) as gaps, (select count(*) from (select condition_id, day, avg(case when outcome_index = 0 then pc end) + avg(case when outcome_index = 1 then pc end) as s from raw group by 1, 2) where abs(s - 100) > 50) as sums_off"""))
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on lists, times, gaps and sums of outcomes."""
    tape = raw_fills(spark, sf_dir)
    lists = tape.groupBy("tx_hash").agg(F.sum(F.when(F.col("outcome_index") == 0, 1).otherwise(-1)).alias("d")).agg(F.count_if(F.col("d") != 0).alias("uneven_lists"))
    times = tape.groupBy("token_id", "sec").agg(F.count(F.lit(1)).alias("n"))
    gap = F.col("sec") - F.lag("sec").over(Window.partitionBy("token_id").orderBy("sec"))
    steps = times.select("n", gap.alias("gap")).agg(F.count_if(F.col("n") > 1).alias("repeated_times"), F.count_if(F.col("gap") > 864_000).alias("gaps"))
    mean = lambda k: F.avg(F.when(F.col("outcome_index") == k, F.col("pc")))
    sums = tape.groupBy("condition_id", "day").agg((mean(0) + mean(1)).alias("s")).agg(F.count_if(F.abs(F.col("s") - 100) > 50).alias("sums_off"))
    return lists.crossJoin(F.broadcast(steps)).crossJoin(F.broadcast(sums))


@query(fills_sql("select round((a1 - a0) - (b1 - b0), 6) as effect, n from (select avg(y) filter (where treated and post) as a1, avg(y) filter (where treated and not post) as a0, avg(y) filter (where not treated and post) as b1, avg(y) filter (where not treated and not post) as b0, count(*) as n from (select category in (1, 2) as treated, month % 12 >= 6 as post, ln(greatest(cents, 1)) as y from f))"))
def order_size_did(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log order size of treated classes against the others, before and after (X14): the saturated two-by-two."""
    treated, post, y = F.col("category").isin(1, 2), F.col("month") % 12 >= 6, F.log(F.greatest("cents", F.lit(1)))
    cell = lambda t, p: F.avg(F.when((treated == t) & (post == p), y))
    return fills(spark, sf_dir).agg(F.round((cell(True, True) - cell(True, False)) - (cell(False, True) - cell(False, False)), 6).alias("effect"), F.count(F.lit(1)).alias("n"))
