"""Queries on coordination: pairs, leads, round trips, funding, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import coordination as G
from tidemark.operators import graph
from tidemark.operators.primitives import ratio
from tidemark.plans.base_sql import fills_sql, trades_sql
from tidemark.plans.registry import query
from tidemark.sources.adapters import fills, trades
from tidemark.sources.store import cut

#: The synthetic trades are sparse, so windows are wider than on a real tape (300 s, 600 s, 600 s).
COTRADE_S, LEAD_S, ROUND_S = 21_600, 3_600, 86_400

_PRES = f"pr as (select condition_id, asset_id, side, sec // {COTRADE_S} as bucket, wallet, sum(notional) as own from t group by 1, 2, 3, 4, 5)"
_PAIRS = "pairs as (select x.wallet as a, y.wallet as b, count(*) as events, count(distinct x.condition_id) as markets, cast(sum(x.own + y.own) as bigint) as pair_notional from pr x join pr y using (condition_id, asset_id, side, bucket) where x.wallet < y.wallet group by 1, 2)"


@query(trades_sql("select * from pairs where events >= 3", _PRES, _PAIRS))
def cotrade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cotrade_pairs(trades(spark, sf_dir), COTRADE_S, 3)


@query(trades_sql("""select p.a, p.b, p.events, round(e.expected, 6) as expected, round(p.events / e.expected, 6) as excess from pairs p join (
 select x.wallet as a, y.wallet as b, sum(x.k * y.k / x.n::double) as expected from k x join k y using (asset_id, side) where x.wallet < y.wallet group by 1, 2) e on p.a = e.a and p.b = e.b""", _PRES, _PAIRS, "k as (select asset_id, side, wallet, count(*) as k, any_value(n) as n from pr join (select asset_id, side, count(distinct bucket) as n from pr group by 1, 2) using (asset_id, side) group by 1, 2, 3)"))
def cotrade_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic part, for the oracle; cotrade_significance adds tail probabilities."""
    out = G.cotrade_expected(trades(spark, sf_dir), COTRADE_S)
    return out.select("a", "b", "events", F.round("expected", 6).alias("expected"), F.round("excess", 6).alias("excess"))


_LL = f"ll as (select x.wallet as leader, y.wallet as follower, s.nxt - s.sec as lag from (select *, lead(sec) over (partition by asset_id, side order by sec) as nxt from (select distinct asset_id, side, sec from t)) s join (select distinct asset_id, side, sec, wallet from t) x using (asset_id, side, sec) join (select distinct asset_id, side, sec, wallet from t) y on y.asset_id = s.asset_id and y.side = s.side and y.sec = s.nxt where s.nxt - s.sec <= {LEAD_S} and x.wallet <> y.wallet)"


@query(trades_sql("select leader, follower, count(*) as events, round(avg(lag), 6) as mean_lag, round(median(lag), 6) as median_lag from ll group by 1, 2 having count(*) >= 3", _LL))
def leader_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.leader_lag(trades(spark, sf_dir), LEAD_S, 3)


@query(trades_sql(f"""select x.wallet as leader, y.wallet as follower, round(sum(x.k * y.k * s.adj / (s.n * s.n)::double), 6) as expected, any_value(e.events) as events from k x join k y using (asset_id, side)
 join (select asset_id, side, count(*) as n, count(*) filter (where nxt - sec <= {LEAD_S}) as adj from (select *, lead(sec) over (partition by asset_id, side order by sec) as nxt from (select distinct asset_id, side, sec from t)) group by 1, 2) s using (asset_id, side)
 join (select leader, follower, count(*) as events from ll group by 1, 2) e on e.leader = x.wallet and e.follower = y.wallet
 where x.wallet <> y.wallet group by 1, 2""", _LL, "k as (select asset_id, side, wallet, count(distinct sec) as k from t group by 1, 2, 3)"))
def leader_lag_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.leader_lag_null(trades(spark, sf_dir), LEAD_S).select("leader", "follower", "events", F.round("expected", 6).alias("expected"))


@query(trades_sql("""select wallet, count(*) as n, cast(sum(least(buy_size, sell_size)) as bigint) as matched, round(avg(gap), 6) as mean_gap from (
 select *, row_number() over (partition by sell_id order by gap, buy_id) as r2 from (
  select b.wallet, b.event_id as buy_id, s.event_id as sell_id, b.size as buy_size, s.size as sell_size, abs(b.sec - s.sec) as gap, row_number() over (partition by b.event_id order by abs(b.sec - s.sec), s.event_id) as r1
  from t b join t s on b.wallet = s.wallet and b.asset_id = s.asset_id and b.side = 'BUY' and s.side = 'SELL' and abs(b.sec - s.sec) <= 86400 and least(b.size, s.size)::double / greatest(b.size, s.size) >= 0.5)
 where r1 = 1) where r2 = 1 group by wallet"""))
def roundtrip_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.round_trips(trades(spark, sf_dir), ROUND_S)
    return out.groupBy("wallet").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("buy_size", "sell_size")).alias("matched"), F.round(F.avg("gap"), 6).alias("mean_gap"))


@query(fills_sql("""select taker, count(*) as orders, count(*) filter (where closes) as closing, round(count(*) filter (where closes) / count(*)::double, 8) as share from (
 select taker, coalesce(lag(side) over w <> side and sec - lag(sec) over w <= 8640000 and least(q, lag(q) over w)::double / greatest(q, lag(q) over w) >= 0.5, false) as closes
 from (select taker, token_id, sec, side, sum(q) as q from f group by 1, 2, 3, 4) window w as (partition by taker, token_id order by sec, side)) group by taker"""))
def roundtrip_laglead(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.neighbour_round_trips(fills(spark, sf_dir), 8_640_000)
    n, k = F.count(F.lit(1)), F.count_if("closes")
    return out.groupBy("taker").agg(n.alias("orders"), k.alias("closing"), F.round(ratio(k, n), 8).alias("share"))


@query(fills_sql("""select x.a, x.b, x.n, cast(x.total as bigint) as total, round(x.hhi, 8) as hhi, x.flagged, x.flagged and coalesce(y.flagged, false) as reciprocal from tops x left join tops y on x.a = y.b and x.b = y.a""",
    "n as (select a, b, count(*) as n from (select maker as a, taker as b from f union all select taker, maker from f) where a <> b group by 1, 2)",
    "tops as (select a, b, n, total, hhi, total >= 20 and hhi >= 0.05 as flagged from (select *, row_number() over (partition by a order by n desc, b) as r, sum(n) over (partition by a) as total, (sum(n * n) over (partition by a))::double / power(sum(n) over (partition by a), 2) as hhi from n) where r = 1)"))
def pair_hhi_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.pair_structure(fills(spark, sf_dir), 20, 0.05)
    return out.select("a", "b", "n", "total", F.round("hhi", 8).alias("hhi"), "flagged", "reciprocal")


@query(fills_sql("""select tx_hash, wallet, roles from (select tx_hash, wallet, count(distinct role) as roles from (select tx_hash, maker as wallet, 'm' as role from f union all select tx_hash, taker, 't' from f) group by 1, 2) where roles = 2"""))
def both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallets that make and take in one transaction, self-matches among them."""
    sides = F.array(*[F.struct(F.col(c).alias("wallet"), F.lit(made).alias("made"), F.lit(1 - made).alias("took")) for c, made in (("maker", 1), ("taker", 0))])
    roles = fills(spark, sf_dir).select("tx_hash", F.explode(sides).alias("s")).select("tx_hash", "s.*")  # the tape is read once
    per = roles.groupBy("tx_hash", "wallet").agg(F.max("made").alias("made"), F.max("took").alias("took"))
    return per.select("tx_hash", "wallet", (F.col("made") + F.col("took")).cast("bigint").alias("roles")).where("roles = 2")


@query(fills_sql("select count(*) as n_fills, count(*) filter (where maker = taker) as self_matches, cast(coalesce(sum(case when maker = taker then cents end), 0) as bigint) as self_cents from f"))
def self_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.col("maker") == F.col("taker")
    return fills(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_fills"), F.count_if(same).alias("self_matches"), F.coalesce(F.sum(F.when(same, F.col("cents"))), F.lit(0)).alias("self_cents"))


@query(fills_sql("select x.token_id, x.maker as m, x.taker as t, x.tx_hash as tx1, x.evt_index as e1, y.tx_hash as tx2, y.evt_index as e2, y.sec - x.sec as dt from f x join f y on x.token_id = y.token_id and x.maker = y.taker and x.taker = y.maker and abs(x.sec - y.sec) <= 8640000 where x.maker < x.taker"))
def flipped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.flipped_pairs(fills(spark, sf_dir), 8_640_000)
    return out.select("token_id", "m", "t", "tx1", "e1", "tx2", "e2", (F.col("sec2") - F.col("sec1")).alias("dt"))


@query(fills_sql("""select a, b, count(*) as days from (select distinct x.taker as a, y.taker as b, x.condition_id, x.side, x.day from g x join g y using (condition_id, side, day) where x.taker < y.taker) group by 1, 2""",
    "g as (select * from (select distinct condition_id, side, day, taker, count(*) over (partition by condition_id, side, day) as size from (select distinct condition_id, side, day, taker from f where (side = 'BUY') = (outcome_index = winner))) where size <= 40)"))
def winner_cotrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of winners on the same market, side and day, in groups of at most 40."""
    won = cut(fills(spark, sf_dir).where("(side = 'BUY') = (outcome_index = winner)").select("condition_id", "side", "day", "taker").distinct())
    keys = ["condition_id", "side", "day"]
    small = won.groupBy(*keys).count().where("count between 2 and 40").drop("count")
    groups = won.where("taker is not null").join(small, keys).groupBy(*keys).agg(F.sort_array(F.collect_list("taker")).alias("who"))  # 40 at most
    first = groups.select(F.posexplode("who").alias("at", "a"), "who")
    pairs = first.select("a", F.explode(F.slice("who", F.col("at") + 2, F.size("who"))).alias("b"))  # made where the group lies
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("days"))


_FUND = "e as (select distinct taker as node, builder * 100000 + maker * 1000 + condition_id as via from f), d as (select via, count(*) as d from e group by 1 having count(*) between 2 and 5), fe as (select x.node as a, y.node as b, count(*) as shared, sum(1.0::double / d) as weight from e x join e y using (via) join d using (via) where x.node < y.node group by 1, 2)"


def _funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    via = (F.col("builder") * 100000 + F.col("maker") * 1000 + F.col("condition_id")).alias("via")
    return graph.shared_neighbours(fills(spark, sf_dir).select(F.col("taker").alias("node"), via), 5)


@query(fills_sql("select a, b, shared, round(weight, 8) as weight from fe", _FUND))
def funding_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _funding(spark, sf_dir).select("a", "b", "shared", F.round("weight", 8).alias("weight"))


@query(fills_sql("""select id as node, min(c) as component from r group by 1""", _FUND.replace("e as (", "e as (", 1),
    "k as (select a, b from fe where shared >= 2 union all select b, a from fe where shared >= 2)", "r(id, c) as (select distinct a, a from k union select k.b, r.c from r join k on k.a = r.id where r.c < k.b)").replace("with ", "with recursive ", 1))
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(_funding(spark, sf_dir).where("shared >= 2"))


@query()
def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities over all co-trading pairs with at least 3 events; every trading wallet is a node."""
    tape = trades(spark, sf_dir)
    weight = F.col("events") * (1 + 0.5 * (F.col("markets") - 1))
    pairs = G.cotrade_pairs(tape, COTRADE_S, 3).select("a", "b", weight.cast("double").alias("w"))
    return graph.communities(tape.select(F.col("wallet").alias("node")).where("node is not null").distinct(), cut(pairs))


@query(trades_sql("select a, b, events, markets, round(events * (1 + 0.5 * (markets - 1)), 6)::double as weight from pairs where events >= 3", _PRES, _PAIRS))
def behavioural_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = G.cotrade_pairs(trades(spark, sf_dir), COTRADE_S, 3)
    return pairs.select("a", "b", "events", "markets", F.round(F.col("events") * (1 + 0.5 * (F.col("markets") - 1)), 6).cast("double").alias("weight"))
