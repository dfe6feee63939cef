"""Price paths: minute means, prices at horizons, convergence, jumps, markouts and mirrored trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.primitives import asof_backward, asof_forward, band_join, ratio


def vwap(tape: DataFrame, keys: Sequence[str], size: str, price: str = "pc") -> DataFrame:
    """Size-weighted mean price by keys, in cents."""
    return tape.groupBy(*keys).agg(ratio(F.sum(F.col(size) * F.col(price)), F.sum(size)).alias("vwap"), F.sum(size).alias("size"), F.count(F.lit(1)).alias("n"))


def price_at_offsets(tape: DataFrame, markets: DataFrame, hours: Sequence[int], order: Sequence[str]) -> DataFrame:
    """Per market, the last price of outcome 0 at or before close - h hours, for each h: one aggregation, no join per h.

    Prices of outcome 1 count as 100 - price. `order` breaks ties in time.
    """
    p0 = F.when(F.col("outcome_index") == 0, F.col("pc")).otherwise(100 - F.col("pc"))
    joined = tape.join(markets.select("condition_id", "close_sec"), "condition_id")
    key = F.struct("sec", *order)
    picks = [F.max_by(F.when(F.col("sec") <= F.col("close_sec") - h * 3600, p0), F.when(F.col("sec") <= F.col("close_sec") - h * 3600, key)).alias(f"p_{h}h") for h in hours]
    return joined.groupBy("condition_id").agg(*picks)


def convergence(prices: DataFrame, markets: DataFrame, hours: Sequence[int]) -> DataFrame:
    """Long form: error of the price of outcome 0 against the result, by hours before the close."""
    pairs = ", ".join(f"{h}, p_{h}h" for h in hours)
    long = prices.join(markets.select("condition_id", "winner", "first_sec", "close_sec"), "condition_id").selectExpr(
        "condition_id", "winner", "close_sec - first_sec as span", f"stack({len(hours)}, {pairs}) as (hours, p)"
    )
    error = F.col("p") - F.when(F.col("winner") == 0, 100).otherwise(0)
    return long.where("p is not null").select("condition_id", F.col("hours").cast("bigint").alias("hours"), "p", error.cast("bigint").alias("error"), F.abs(error).cast("bigint").alias("abs_error"), "span")


def jumps(hourly: DataFrame, high: float = 70.0, low: float = 50.0) -> DataFrame:
    """Hours in which a token's price, below `high` in the 24 hours before, ends at or above it from under `low` an hour earlier."""
    w = Window.partitionBy("token_id").orderBy("hour")
    day = F.max("p").over(w.rangeBetween(-24, -1))
    before = F.last("p").over(w.rangeBetween(-12, -1))
    out = hourly.withColumns({"max24": day, "prior": before})
    return out.where((F.col("max24") < high) & (F.col("p") >= high) & (F.col("prior") < low))


def markouts(makers: DataFrame, taker_prices: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Maker fills by horizon with the first taker price at least that much later, and what it moved in the maker's favour.

    A price later than horizon + max(2 * horizon, 900) seconds does not count. All horizons share one as-of pass.
    """
    h = F.col("horizon")
    asked = makers.withColumn("horizon", F.explode(F.array(*[F.lit(x).cast("bigint") for x in horizons]))).withColumn("at", F.col("sec") + h)
    found = asof_forward(asked, taker_prices, ["token_id"], "at", "sec", "vwap", 0, "later")
    gap = F.col("later_t") - F.col("sec")
    move = F.when(F.col("side") == "BUY", F.col("later") - F.col("pc")).otherwise(F.col("pc") - F.col("later"))
    within = gap <= h + F.greatest(2 * h, F.lit(900))
    return found.withColumns({"gap": F.when(within, gap), "markout": F.when(within, move)})


def markout_points(marked: DataFrame) -> DataFrame:
    """Per horizon: coverage, dollar-weighted and mean markout (cents a share), share below -1e-9 and mean gap."""
    has, w = F.col("markout").isNotNull(), F.col("cents")
    return marked.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(ratio(F.count_if(has), F.count(F.lit(1))), 8).alias("coverage"),
        F.round(F.sum(w * F.col("markout")) / F.nullif(F.sum(F.when(has, w)).cast("double"), F.lit(0.0)), 6).alias("weighted"),
        F.round(F.avg("markout"), 6).alias("mean"),
        F.round(ratio(F.count_if(F.col("markout") < -1e-9), F.count_if(has)), 8).alias("adverse"),
        F.round(F.avg("gap"), 6).alias("mean_gap"),
    )


def event_times(tape: DataFrame, high: int = 95, low: int = 5) -> DataFrame:
    """Per market, the last second at which the winner traded below `high` or the loser above `low`; else the first trade."""
    wins = F.col("outcome_index") == F.col("winner")
    open_ = (wins & (F.col("pc") < high)) | (~wins & (F.col("pc") > low))
    return tape.groupBy("condition_id").agg(F.coalesce(F.max(F.when(open_, F.col("sec"))), F.min("sec")).alias("event_sec"))


def matched_controls(events: DataFrame, tape: DataFrame, within_s: int, price: int, k: int, seed: str) -> DataFrame:
    """Up to k other trades for each event: equal asset and side, near in time and price, in a fixed hashed order."""
    e = events.select(F.col("event_id").alias("leader_id"), "asset_id", "side", F.col("sec").alias("leader_sec"), F.col("pc").alias("leader_pc"), F.col("wallet").alias("leader"))
    t = tape.select("asset_id", "side", "event_id", "sec", "pc", "wallet")
    near = band_join(e, t, ["asset_id", "side"], "leader_sec", "sec", within_s)
    near = near.where((F.abs(F.col("pc") - F.col("leader_pc")) <= price) & (F.col("wallet") != F.col("leader")))
    h = F.md5(F.concat(F.col("event_id").cast("string"), F.lit(seed)).cast("binary"))
    w = Window.partitionBy("leader_id").orderBy("h", "event_id")
    return near.withColumn("h", h).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mirror(events: DataFrame, minute_prices: DataFrame, markets: DataFrame, delay_s: int, late_s: int, horizon_s: int, cost_bps: float) -> DataFrame:
    """Copying each event: enter at the first minute price at least delay later (at most late_s late), leave at the last
    one up to the horizon, or at the payout if the market closed by then. Events without a price after entry drop out."""
    entered = asof_forward(events, minute_prices, ["asset_id"], "sec", "sec", "vwap", delay_s, "entry")
    entered = entered.where(F.col("entry_t") - F.col("sec") - delay_s <= late_s)
    left = asof_backward(entered, minute_prices, ["asset_id"], "sec", "sec", "vwap", horizon_s, "exit")
    closed = left.join(markets.select("condition_id", "close_sec", "winner"), "condition_id")
    paid = F.col("close_sec") <= F.col("sec") + horizon_s
    payout = F.when(F.col("outcome_index") == F.col("winner"), 100.0).otherwise(0.0)
    closed = closed.where(paid | (F.col("exit_t") > F.col("entry_t")))
    out = F.when(paid, payout).otherwise(F.col("exit"))
    gross = F.when(F.col("side") == "BUY", ratio(out - F.col("entry"), F.col("entry"))).otherwise(ratio(F.col("entry") - out, 100 - F.col("entry")))
    return closed.select("event_id", "condition_id", "wallet", F.col("entry"), out.alias("exit"), gross.alias("gross"), (gross - 2 * cost_bps / 1e4).alias("net"))
