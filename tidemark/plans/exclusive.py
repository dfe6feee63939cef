"""Queries on families of exclusive markets: trades with codes, price sums, corrections, episodes and what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import families
from tidemark.operators.effects import exact_quantile
from tidemark.operators.primitives import average_ranks, correlation, global_row_number, ratio
from tidemark.operators.regression import clustered_mean
from tidemark.plans.base_sql import fills_sql
from tidemark.plans.registry import query
from tidemark.sources.adapters import fills, written_fills
from tidemark.sources.store import cut

#: On the synthetic tape a candidate trades about daily, so a price stays good for a month.
STALE_S = 2_592_000

_E = "e0 as (select family, condition_id, condition_id % 5 as c, sec, tx_hash, evt_index, pc, q, cents, fee, side, winner, taker as wallet from f where outcome_index = 0 and pc > 0 and pc < 100)"
_PIVOT = ", ".join(f"last_value(case when c = {k} then pc end ignore nulls) over w as p{k}, last_value(case when c = {k} then sec end ignore nulls) over w as s{k}" for k in range(5))
_LAGS = ", ".join(f"lag(p{k}) over v as b{k}, lag(s{k}) over v as t{k}" for k in range(5))
_plus = lambda p: " + ".join(f"coalesce({p}{k}, 0)" for k in range(5))
_have = lambda p: " + ".join(f"({p}{k} is not null)::int" for k in range(5))
_live = lambda p: " and ".join(f"(sec - coalesce({p}{k}, sec)) <= {STALE_S}" for k in range(5))
_SUMS = [
    _E,
    f"e1 as (select *, {_PIVOT} from e0 window w as (partition by family order by sec, tx_hash, evt_index rows unbounded preceding))",
    f"e2 as (select *, {_LAGS} from e1 window v as (partition by family order by sec, tx_hash, evt_index))",
    "nc as (select family, count(distinct c) as members from e0 group by 1 having count(distinct c) >= 3)",
    f"ps as (select e2.*, case when {_have('b')} = members and {_live('t')} then cast(abs({_plus('b')} - 100) as bigint) end as off_before, case when {_have('p')} = members and {_live('s')} then cast(abs({_plus('p')} - 100) as bigint) end as off_after from e2 join nc using (family))",
]
_EPISODES = [
    *_SUMS,
    "st as (select *, case when off_after > 5 then 1 when off_before is not null and off_after < 2 then 0 end as state, case when off_before is not null and off_after is not null then off_before - off_after end as mag from ps)",
    "pr as (select *, coalesce(last_value(state ignore nulls) over (partition by family order by sec, tx_hash, evt_index rows between unbounded preceding and 1 preceding), 0) as prior from st)",
    "ep as (select *, sum(case when prior = 0 and state = 1 then 1 else 0 end) over (partition by family order by sec, tx_hash, evt_index rows unbounded preceding) as k from pr)",
    "ins as (select * from ep where prior = 1 or coalesce(state, -1) = 1)",
    "gain as (select family, k, wallet, cast(sum(mag) as bigint) as gain, min((sec, tx_hash, evt_index)) as begun from ins where mag > 0 group by 1, 2, 3)",
    "top as (select *, row_number() over (partition by family, k order by gain desc, begun) as r, count(*) over (partition by family, k) as n from gain)",
    """eps as (select w.family, w.start, w.peak, coalesce(top.n, 0) as correctors, top.wallet as closer, coalesce(top.gain, 0) as corrective from (
 select family, k, min(sec) as start, max(case when mag is not null then greatest(off_before, off_after) when prior = 0 then off_after end) as peak, max(case when prior = 1 and state = 0 then 1 else 0 end) as ended from ins group by 1, 2) w
 left join top on w.family = top.family and w.k = top.k and top.r = 1 where ended = 1)""",
]
_WALLETS = [
    *_EPISODES,
    "wl as (select wallet, cast(sum(cents) as bigint) as vol, cast(sum(case when side = 'BUY' then -cents else cents end) + sum(case when winner = 0 then (case when side = 'BUY' then q else -q end) * 100 else 0 end) as bigint) as pnl, cast(sum(fee) as bigint) as fees, count(*) as trades from e0 group by 1)",
    "ww as (select wl.*, coalesce(w.wins, 0) as wins from wl left join (select closer, count(*) as wins from eps where closer is not null group by 1) w on wl.wallet = w.closer)",
]


def _tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of outcome 0 at prices between 0 and 100 cents, named by their aggressor."""
    return fills(spark, sf_dir).where("outcome_index = 0 and pc > 0 and pc < 100").withColumn("wallet", F.col("taker"))


#: What price sums and wallets' accounts read of the tape. It is read several times, so it is written once.
_READ = ["family", "condition_id", "sec", "tx_hash", "evt_index", "pc", "wallet", "side", "q", "cents", "winner", "fee"]


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.price_sums(cut(_tape(spark, sf_dir).select(*_READ[:7])), STALE_S)


@query(fills_sql("select tx_hash, evt_index, pc, dense_rank() over (order by family) - 1 as fid, dense_rank() over (order by condition_id) - 1 as tid, dense_rank() over (order by wallet) - 1 as wid from e0", _E))
def coded_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with dense integer codes: codes are numbered over distinct values, by ranges, and joined back."""
    out = _tape(spark, sf_dir)
    for column, code in (("family", "fid"), ("condition_id", "tid"), ("wallet", "wid")):
        codes = global_row_number(out.select(column).distinct(), [column], code).withColumn(code, F.col(code) - 1)
        out = out.join(codes, column)
    return out.select("tx_hash", "evt_index", "pc", "fid", "tid", "wid")


@query(fills_sql("select family, tx_hash, evt_index, off_before, off_after from ps", *_SUMS))
def family_price_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trade with the distance of its family's price sum from one, before and after it."""
    return _sums(spark, sf_dir).select("family", "tx_hash", "evt_index", "off_before", "off_after")


@query(fills_sql("select family, start, peak, correctors, closer, corrective from eps", *_EPISODES))
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.episodes(cut(_sums(spark, sf_dir)))


@query(fills_sql("select wallet, cast(coalesce(sum(case when off_before > off_after then off_before - off_after end), 0) as bigint) as corrective, cast(coalesce(sum(case when off_before < off_after then off_after - off_before end), 0) as bigint) as added, count(*) filter (where off_before > off_after) as n_corrective, count(*) filter (where off_before < off_after) as n_added from ps where off_before is not null and off_after is not null group by 1", *_SUMS))
def wallet_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.corrections(_sums(spark, sf_dir))


def _closers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Per wallet its volume, profit, fees, trades and episodes closed; and the episodes."""
    tape = cut(_tape(spark, sf_dir).select(*_READ))
    found = cut(families.episodes(cut(families.price_sums(tape, STALE_S))))
    bought = F.when(F.col("side") == "BUY", F.col("q")).otherwise(-F.col("q"))
    cash = F.when(F.col("side") == "BUY", -F.col("cents")).otherwise(F.col("cents"))
    per = tape.groupBy("wallet").agg(
        F.sum("cents").alias("vol"), (F.sum(cash) + F.sum(F.when(F.col("winner") == 0, bought * 100).otherwise(0))).alias("pnl"), F.sum("fee").alias("fees"), F.count(F.lit(1)).alias("trades")
    )
    wins = found.where("closer is not null").groupBy(F.col("closer").alias("wallet")).agg(F.count(F.lit(1)).alias("wins"))
    return cut(per.join(wins, "wallet", "left").withColumn("wins", F.coalesce("wins", F.lit(0)))), found


@query(fills_sql("""select count(*) filter (where wins > 0) as correctors, cast(sum(wins) as bigint) as wins, round(2 * sum(i * wins)::double / (count(*) * sum(wins)) - (count(*) + 1)::double / count(*), 8) as gini,
 round(sum(case when r <= 10 then wins else 0 end)::double / sum(wins), 8) as top10, round(sum(case when r <= 100 then wins else 0 end)::double / sum(wins), 8) as top100
 from (select wins, row_number() over (order by wins, wallet) as i, row_number() over (order by wins desc, wallet) as r from ww)""", *_WALLETS))
def correction_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How few wallets close the episodes: Gini over all wallets, shares of the first 10 and 100."""
    wallets, _ = _closers(spark, sf_dir)
    placed = global_row_number(wallets, ["wins", "wallet"], "i")
    n, w = F.count(F.lit(1)), F.sum("wins")
    tops = [wallets.orderBy(F.col("wins").desc(), "wallet").limit(k).agg(F.sum("wins").alias(f"top{k}")) for k in (10, 100)]
    out = placed.agg(F.count_if(F.col("wins") > 0).alias("correctors"), w.alias("wins"), F.round(2 * ratio(F.sum(F.col("i") * F.col("wins")), n * w) - (n + 1) / n, 8).alias("gini"))
    for t in tops:
        out = out.crossJoin(F.broadcast(t))
    return out.withColumns({f"top{k}": F.round(ratio(F.col(f"top{k}"), F.col("wins")), 8) for k in (10, 100)})


@query(fills_sql("""select measure, round(corr(a, b), 6) as rho, cast(count(*) filter (where ra <= 100 and rb <= 100) as bigint) as shared_top100 from (
 select measure, rank() over (partition by measure order by wins) + (count(*) over (partition by measure, wins) - 1) / 2.0 as a, rank() over (partition by measure order by x) + (count(*) over (partition by measure, x) - 1) / 2.0 as b,
  row_number() over (partition by measure order by wins desc, wallet) as ra, row_number() over (partition by measure order by x desc, wallet) as rb from (
  select wallet, wins, 'vol' as measure, vol as x from ww union all select wallet, wins, 'pnl', pnl from ww union all select wallet, wins, 'fees', fees from ww union all select wallet, wins, 'trades', trades from ww)) group by 1""", *_WALLETS))
def correction_distinctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether closers are merely the large, the profitable, the paying or the busy: rank correlation, and shared first hundreds."""
    wallets, _ = _closers(spark, sf_dir)
    measures = ["vol", "pnl", "fees", "trades"]
    ranks = average_ranks(wallets, ["wins", *measures]).agg(*[correlation("rank_wins", f"rank_{m}").alias(m) for m in measures])
    first = lambda c: wallets.orderBy(F.col(c).desc(), "wallet").limit(100).select("wallet")
    shared = [first("wins").intersect(first(m)).agg(F.count(F.lit(1)).alias("shared_top100")).withColumn("measure", F.lit(m)) for m in measures]
    pairs = ", ".join(f"'{m}', {m}" for m in measures)
    long = ranks.selectExpr(f"stack({len(measures)}, {pairs}) as (measure, rho)")
    both = shared[0].union(shared[1]).union(shared[2]).union(shared[3])
    return long.join(both, "measure").select("measure", F.round("rho", 6).alias("rho"), "shared_top100")


@query(fills_sql("""select cast(sum(pnl) filter (where wins > 0) as bigint) as gross, cast(sum(fees) filter (where wins > 0) as bigint) as fees, cast(sum(vol) filter (where wins > 0) as bigint) as vol, round(10000 * sum(pnl) filter (where wins > 0)::double / sum(vol) filter (where wins > 0), 6) as gross_bps,
 round(count(*) filter (where wins > 0 and pnl * 1000000 > fees * 100)::double / count(*) filter (where wins > 0), 8) as net_winners, cast(sum(pnl) as bigint) as all_gross from ww""", *_WALLETS))
def correction_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What closers earn, before and after fees (fees are in millionths of a dollar, profit in cents)."""
    wallets, _ = _closers(spark, sf_dir)
    mine = lambda c: F.sum(F.when(F.col("wins") > 0, F.col(c)))
    net = F.col("pnl") * 1_000_000 > F.col("fees") * 100
    return wallets.agg(
        mine("pnl").alias("gross"), mine("fees").alias("fees"), mine("vol").alias("vol"), F.round(10_000 * ratio(mine("pnl"), mine("vol")), 6).alias("gross_bps"),
        F.round(ratio(F.count_if((F.col("wins") > 0) & net), F.count_if(F.col("wins") > 0)), 8).alias("net_winners"), F.sum("pnl").alias("all_gross"),
    )


@query(fills_sql("""select count(*) as both_halves, round(corr(a, b), 6) as rho, (select count(*) from (select closer from eps where closer is not null group by 1 having count(distinct family) >= 5)) as in_five_families,
 (select round(count(*) filter (where closer in (select wallet from ww order by vol desc, wallet limit 100))::double / count(*), 8) from eps where closer is not null) as by_top100_volume from (
 select rank() over (order by h1) + (count(*) over (partition by h1) - 1) / 2.0 as a, rank() over (order by h2) + (count(*) over (partition by h2) - 1) / 2.0 as b from (
  select closer, count(*) filter (where start < mid) as h1, count(*) filter (where start >= mid) as h2 from eps, (select median(start) as mid from eps where closer is not null) where closer is not null group by 1) where h1 > 0 and h2 > 0)""", *_WALLETS))
def correction_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether who closes in the first half of the time closes in the second, in many families, or by volume alone."""
    wallets, found = _closers(spark, sf_dir)
    found = found.where("closer is not null")
    mid = found.agg(F.median("start").alias("mid"))
    early = F.col("start") < F.col("mid")
    halves = found.crossJoin(F.broadcast(mid)).groupBy("closer").agg(F.count_if(early).alias("h1"), F.count_if(~early).alias("h2"), F.countDistinct("family").alias("families"))
    halves = cut(halves)
    rho = average_ranks(halves.where("h1 > 0 and h2 > 0"), ["h1", "h2"]).agg(F.count(F.lit(1)).alias("both_halves"), F.round(correlation("rank_h1", "rank_h2"), 6).alias("rho"))
    wide = halves.agg(F.count_if(F.col("families") >= 5).alias("in_five_families"))
    large = wallets.orderBy(F.col("vol").desc(), "wallet").limit(100).select(F.col("wallet").alias("closer"), F.lit(1).alias("large"))
    share = found.join(F.broadcast(large), "closer", "left").agg(F.round(ratio(F.count("large"), F.count(F.lit(1))), 8).alias("by_top100_volume"))
    return rho.crossJoin(F.broadcast(wide)).crossJoin(F.broadcast(share))


_FH = "fh as (select family, condition_id, day as hour, arg_max(pc, (sec, tx_hash, evt_index)) as p from f where outcome_index = 0 group by 1, 2, 3)"
_COVERED = [
    _FH,
    "al as (select family, condition_id, min(hour) as lo, max(hour) as hi from fh group by 1, 2)",
    """cs as (select g.family, g.hour, g.alive, g.total, a.candidates from (select g.family, g.hour, count(*) as alive, cast(sum(s.p) as bigint) as total from (select distinct family, hour from fh) g
 join (select *, lead(hour) over (partition by family, condition_id order by hour) as nxt from fh) s on g.family = s.family and g.hour >= s.hour and g.hour <= s.hour + 24 and (s.nxt is null or g.hour < s.nxt) group by 1, 2) g
 join (select g.family, g.hour, count(*) as candidates from (select distinct family, hour from fh) g join al on g.family = al.family and g.hour between lo and hi group by 1, 2) a using (family, hour) where candidates >= 3 and alive >= 0.8 * candidates)""",
]


@query(fills_sql("""select family, count(*) as hours, round(avg(abs(total - 100)), 6) as mean_off, round(median(abs(total - 100)), 6) as median_off, round(stddev_samp(total), 6) as sd, round(avg(case when total > 102 then 1 else 0 end), 8) as above, round(avg(case when total < 98 then 1 else 0 end), 8) as below from cs group by 1""", *_COVERED))
def covered_family_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far family sums stand from one in hours in which four fifths of the living candidates have a price (a daily grid here)."""
    per = fills(spark, sf_dir).where("outcome_index = 0").groupBy("family", "condition_id", F.col("day").alias("hour")).agg(F.max_by("pc", F.struct("sec", "tx_hash", "evt_index")).alias("p"))
    members = per.groupBy("family", "condition_id").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))
    off = F.abs(F.col("total") - 100)
    return families.covered_sums(per, members, 24, 3).groupBy("family").agg(
        F.count(F.lit(1)).alias("hours"), F.round(F.avg(off), 6).alias("mean_off"), F.round(F.median(off), 6).alias("median_off"), F.round(F.stddev_samp("total"), 6).alias("sd"),
        F.round(F.avg((F.col("total") > 102).cast("int")), 8).alias("above"), F.round(F.avg((F.col("total") < 98).cast("int")), 8).alias("below"),
    )


_AUDIT = """ad as (
 select cs.family, cs.hour, abs(total - 100) / 100.0 as adev, case when alive <= 3 then 0 when alive <= 4 then 1 else 2 end as n_bin, vol, fee, case when cls in (1, 2, 4) then 'treated' else 'placebo' end as scope
 from cs join (select family, day as hour, sum(cents) as vol, 2 * sum(case when fee_paying then cents else 0 end) > sum(cents) as fee, (family * 5) % 7 as cls from f group by 1, 2, 5) using (family, hour)
), au as (
 select 'all' as scope, * exclude (scope) from ad union all select scope, * exclude (scope) from ad
), ae as (
 select scope, quantile_cont(vol, [0.2, 0.4, 0.6, 0.8]) as e from au where scope = 'all' group by 1
), ar as (
 select au.*, len(list_filter(e, lambda x: x < vol)) as vol_bin, row_number() over (partition by au.scope order by family * 100000 + hour) as i, count(*) over (partition by au.scope) as n from au, ae
), aw as (
 select scope, draw, pick, count(*) as w from (select scope, r.draw, cast('0x' || substr(md5('42:' || r.draw || ':' || (i - 1)), 1, 12) as bigint) % n + 1 as pick from ar, range(0, 40) r(draw)) group by 1, 2, 3
), ag as (
 select scope, draw, sum((x1 / w1 - x0 / w0) * (w1 + w0)) / sum(w1 + w0) as gap from (
  select scope, draw, n_bin, vol_bin, sum(w * adev) filter (where fee) as x1, sum(w) filter (where fee)::double as w1, sum(w * adev) filter (where not fee) as x0, sum(w) filter (where not fee)::double as w0 from (
   select ar.*, -1 as draw, 1 as w from ar union all select ar.*, aw.draw, aw.w from ar join aw on ar.scope = aw.scope and ar.i = aw.pick) group by all) where w1 > 0 and w0 > 0 group by 1, 2)"""


@query(fills_sql("select g.scope, n, round(g.gap, 8) as gap, round(low, 8) as low, round(high, 8) as high from (select * from ag where draw = -1) g join (select scope, quantile_cont(gap, 0.025) as low, quantile_cont(gap, 0.975) as high from ag where draw >= 0 group by 1) using (scope) join (select scope, count(*) as n from ar group by 1) using (scope)", *_COVERED, _AUDIT))
def band_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much further family sums stand from one where fees are paid, within bins of candidates and volume, for all families, for
    treated classes and for the placebo ones, with intervals from drawing family days again (N07)."""
    tape = written_fills(spark, sf_dir, "family", "condition_id", "outcome_index", "day", "sec", "tx_hash", "evt_index", "pc", "cents", "fee_paying")
    per = tape.where("outcome_index = 0").groupBy("family", "condition_id", F.col("day").alias("hour")).agg(F.max_by("pc", F.struct("sec", "tx_hash", "evt_index")).alias("p"))
    members = per.groupBy("family", "condition_id").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))
    paid = F.sum(F.when(F.col("fee_paying"), F.col("cents")).otherwise(0))
    volume = tape.groupBy("family", F.col("day").alias("hour")).agg(F.sum("cents").alias("vol"), (2 * paid > F.sum("cents")).alias("fee"))
    sums = cut(families.covered_sums(per, members, 24, 3).join(volume, ["family", "hour"]))
    edges = [exact_quantile(sums.withColumn("one", F.lit(1)).select("one", F.col("vol").cast("double").alias("vol")), ["one"], "vol", q, "e").first()["e"] for q in (0.2, 0.4, 0.6, 0.8)]
    n_bin = F.when(F.col("alive") <= 3, 0).when(F.col("alive") <= 4, 1).otherwise(2)
    rows = sums.select(
        (F.abs(F.col("total") - 100) / 100.0).alias("adev"), n_bin.alias("n_bin"), sum(((F.col("vol") > e).cast("int") for e in edges), F.lit(0)).alias("vol_bin"), "fee", (F.col("family") * 100_000 + F.col("hour")).alias("row"),
        F.explode(F.array(F.lit("all"), F.when((F.col("family") * 5 % 7).isin(1, 2, 4), "treated").otherwise("placebo"))).alias("scope"),
    )
    out = families.gap_intervals(rows, "scope", ["n_bin", "vol_bin"], "fee", "adev", "row", draws=40)
    return out.select("scope", "n", *[F.round(c, 8).alias(c) for c in ("gap", "low", "high")])


@query(fills_sql("""select (select cast(median(families) as double) from (select families from cl order by n desc, closer limit 50)) as top50_median_families, round(corr(a, b), 6) as rho_recurring, count(a) as both_halves_recurring, any_value(distinct_closers) as distinct_closers, round(any_value(distinct_closers)::double / any_value(wallets), 8) as closers_share,
 any_value(span_days) as span_days, round(any_value(drag), 6) as fee_drag_bps, round(any_value(net), 6) as net_margin_bps, any_value(all_net) as all_net from (
 select rank() over (order by h1) + (count(*) over (partition by h1) - 1) / 2.0 as a, rank() over (order by h2) + (count(*) over (partition by h2) - 1) / 2.0 as b from (
  select closer, count(*) filter (where start < mid) as h1, count(*) filter (where start >= mid) as h2 from ec where family in (select family from ec group by 1 having min(start) < any_value(mid) and max(start) >= any_value(mid)) group by 1) where h1 > 0 and h2 > 0) right join (
 select (select count(*) from cl) as distinct_closers, count(*) as wallets, (select (max(start) - min(start)) // 86400 from eps) as span_days, cast(sum(pnl) * 10000 - sum(fees) as bigint) as all_net, sum(fees) filter (where wins > 0)::double / sum(vol) filter (where wins > 0) as drag,
  (sum(pnl) filter (where wins > 0) * 10000 - sum(fees) filter (where wins > 0))::double / sum(vol) filter (where wins > 0) as net from ww) on true""", *_WALLETS, "ec as (select e.*, mid from eps e, (select median(start) as mid from eps where closer is not null) where closer is not null)", "cl as (select closer, count(*) as n, count(distinct family) as families from ec group by 1)"))
def correction_generalism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first fifty closers work in many families, closers persist within families that recur, how many there are, and
    their margin after fees (N05). Fees and net amounts are in millionths of a dollar."""
    wallets, found = _closers(spark, sf_dir)
    span = found.agg(F.expr("(max(start) - min(start)) div 86400").alias("span_days"))
    found = found.where("closer is not null")
    found = cut(found.crossJoin(F.broadcast(found.agg(F.median("start").alias("mid")))).withColumn("early", F.col("start") < F.col("mid")))
    closers = cut(found.groupBy("closer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("family").alias("families")))
    first = closers.orderBy(F.col("n").desc(), "closer").limit(50).agg(F.median("families").alias("top50_median_families"))
    recurring = found.groupBy("family").agg(F.bool_or("early").alias("a"), F.bool_or(~F.col("early")).alias("b")).where("a and b")
    halves = found.join(recurring, "family", "left_semi").groupBy("closer").agg(F.count_if("early").alias("h1"), F.count_if(~F.col("early")).alias("h2")).where("h1 > 0 and h2 > 0")
    rho = average_ranks(cut(halves), ["h1", "h2"]).agg(F.round(correlation("rank_h1", "rank_h2"), 6).alias("rho_recurring"), F.count(F.lit(1)).alias("both_halves_recurring"))
    mine = lambda c: F.sum(F.when(F.col("wins") > 0, F.col(c)))
    money = wallets.agg(
        F.count_if(F.col("wins") > 0).alias("distinct_closers"), F.round(ratio(F.count_if(F.col("wins") > 0), F.count(F.lit(1))), 8).alias("closers_share"),
        F.round(ratio(mine("fees"), mine("vol")), 6).alias("fee_drag_bps"), F.round(ratio(mine("pnl") * 10_000 - mine("fees"), mine("vol")), 6).alias("net_margin_bps"), (F.sum("pnl") * 10_000 - F.sum("fees")).alias("all_net"),
    )
    return money.crossJoin(F.broadcast(rho)).crossJoin(F.broadcast(first)).crossJoin(F.broadcast(span))


#: Hours that a price is carried: candidates of the synthetic tape trade every few days.
CARRY_H = 720

_BY_HOUR = [
    "hp as (select family, condition_id, hour, arg_max(pc, (sec, tx_hash, evt_index)) as p from f where outcome_index = 0 group by 1, 2, 3)",
    "hl as (select *, lead(hour) over (partition by family, condition_id order by hour) as nxt from hp)",
    "hg as (select family, hour, any_value(month) as month, sum(cents) as vol, 2 * sum(case when fee_paying then cents else 0 end) > sum(cents) as fee from f where outcome_index = 0 group by 1, 2)",
    "hb as (select family, condition_id, min(hour) as lo, max(hour) as hi from hp group by 1, 2)",
    "hs as (select g.family, g.hour, count(*) as alive, cast(sum(p) as bigint) as total from hg g join hl s on g.family = s.family and g.hour >= s.hour and g.hour <= s.hour + 720 and (s.nxt is null or g.hour < s.nxt) group by 1, 2)",
    "hc as (select hs.family, hs.hour, total, month, fee from hs join hg using (family, hour) join (select g.family, g.hour, count(*) as candidates from hg g join hb on g.family = hb.family and g.hour between lo and hi group by 1, 2) a using (family, hour) where candidates >= 3 and alive >= 0.8 * candidates)",
]


@query(fills_sql("""select month, fee, cast(sum(n) as bigint) as hours, count(*) as families, round(any_value(mean), 8) as mean_dev, round(case when count(*) > 1 then sqrt(sum(power(s - mean * n, 2))) / sum(n) * sqrt(count(*) / (count(*) - 1.0)) end, 7) as se
 from (select *, sum(s) over w / sum(n) over w as mean from (select month, fee, family, count(*) as n, sum((total - 100) / 100.0) as s from hc group by 1, 2, 3) window w as (partition by month, fee)) group by 1, 2""", *_BY_HOUR))
def family_sum_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of family sums from one by month and by whether fees are paid, hour by hour, with errors by family."""
    tape = written_fills(spark, sf_dir, "family", "condition_id", "outcome_index", "hour", "month", "sec", "tx_hash", "evt_index", "pc", "cents", "fee_paying").where("outcome_index = 0")
    per = tape.groupBy("family", "condition_id", "hour").agg(F.max_by("pc", F.struct("sec", "tx_hash", "evt_index")).alias("p"))
    members = per.groupBy("family", "condition_id").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))
    paid = F.sum(F.when(F.col("fee_paying"), F.col("cents")).otherwise(0))
    hours = tape.groupBy("family", "hour").agg(F.max("month").alias("month"), (2 * paid > F.sum("cents")).alias("fee"))
    rows = families.covered_sums(per, members, CARRY_H, 3).join(hours, ["family", "hour"]).withColumn("dev", (F.col("total") - 100) / 100.0)
    out = clustered_mean(rows, ["month", "fee"], "family", "dev")
    return out.select("month", "fee", F.col("n").alias("hours"), F.col("clusters").alias("families"), F.round("mean", 8).alias("mean_dev"), F.round("se", 7).alias("se"))
