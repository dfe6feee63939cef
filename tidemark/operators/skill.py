"""Bets, calibration, positions and realised profit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.primitives import ratio


def bets(trades: DataFrame) -> DataFrame:
    """Each trade as a bet: buying backs its outcome at the price, selling backs the other at 100 - price (cents)."""
    buy = F.col("side") == "BUY"
    return trades.withColumns(
        {
            "implied": F.when(buy, F.col("pc")).otherwise(100 - F.col("pc")),
            "won": F.when(buy, F.col("outcome_index") == F.col("winner")).otherwise(F.col("outcome_index") != F.col("winner")).cast("int"),
        }
    )


def reliability(bet: DataFrame, bins: int = 10, weight: str = "size") -> DataFrame:
    """By bin of implied probability: bets, weighted mean of it, weighted rate of winning, and their difference."""
    b = bet.withColumn("bin", F.least(F.floor(F.col("implied") * bins / 100), F.lit(bins - 1)).cast("bigint"))
    w = F.sum(weight)
    mean, rate = ratio(F.sum(F.col(weight) * F.col("implied")), w * 100), ratio(F.sum(F.col(weight) * F.col("won")), w)
    return b.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.round(mean, 8).alias("mean_implied"), F.round(rate, 8).alias("win_rate"), F.round(rate - mean, 8).alias("gap")
    )


def beta_skill(bet: DataFrame, wallet: str = "wallet", prior: float = 4.0, least: int = 5) -> DataFrame:
    """Posterior of a wallet's win rate under a Beta prior centred on its mean price; 90 % normal interval, clipped."""
    n, won, mean_p = F.count(F.lit(1)), F.sum("won"), ratio(F.sum("implied"), F.count(F.lit(1)) * 100)
    base = bet.groupBy(F.col(wallet).alias("wallet")).agg(n.alias("n"), won.alias("wins"), mean_p.alias("mean_p")).where(F.col("n") >= least)
    a, b = F.col("mean_p") * prior + F.col("wins"), (1 - F.col("mean_p")) * prior + F.col("n") - F.col("wins")
    post, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return base.select(
        "wallet", "n", F.col("wins").cast("bigint").alias("wins"), F.round("mean_p", 8).alias("mean_p"), F.round(post, 8).alias("posterior"),
        F.round(F.greatest(post - 1.645 * sd, F.lit(0.0)), 8).alias("low"), F.round(F.least(post + 1.645 * sd, F.lit(1.0)), 8).alias("high"),
        F.round(post - F.col("mean_p"), 8).alias("skill"),
    )


def covered_pnl(trades: DataFrame, wallet: str = "wallet", size: str = "size") -> DataFrame:
    """Realised profit by (wallet, market, outcome) in double precision; selling counts up to what was bought.

    Buying size at price p earns size * (100 * won - p); selling earns the reverse, scaled by min(1, bought / sold).
    """
    buy, payout = F.col("side") == "BUY", F.when(F.col("outcome_index") == F.col("winner"), 100).otherwise(0)
    edge = F.col(size) * (payout - F.col("pc"))
    legs = trades.groupBy(F.col(wallet).alias("wallet"), "condition_id", "outcome_index").agg(
        F.sum(F.when(buy, F.col(size)).otherwise(0)).alias("bought"),
        F.sum(F.when(buy, 0).otherwise(F.col(size))).alias("sold"),
        F.sum(F.when(buy, edge).otherwise(0)).alias("buy_pnl"),
        F.sum(F.when(buy, 0).otherwise(-edge)).alias("sell_pnl"),
        F.count(F.lit(1)).alias("n"),
    )
    scale = F.when(F.col("sold") > 0, F.least(F.lit(1.0), F.col("bought").cast("double") / F.nullif(F.col("sold"), F.lit(0)))).otherwise(0.0)
    return legs.withColumns({"gross": (F.col("buy_pnl") + F.col("sell_pnl")).cast("bigint"), "covered": F.col("buy_pnl") + F.col("sell_pnl") * scale})


def positions(trades: DataFrame, wallet: str = "wallet", size: str = "size", low: int = 5, high: int = 95) -> DataFrame:
    """One trial per (wallet, market): the side of net exposure at its size-weighted price, within a price band.

    Each trade is exposure to outcome 0 (positive) or 1; markets that net to zero give no trial. bench_loo is the win
    rate of the other trials in the price decile, null where there are none.
    """
    toward0 = (F.col("side") == "BUY") == (F.col("outcome_index") == 0)
    p0 = F.when(F.col("outcome_index") == 0, F.col("pc")).otherwise(100 - F.col("pc"))
    agg = trades.groupBy(F.col(wallet).alias("wallet"), "condition_id").agg(
        F.sum(F.when(toward0, F.col(size)).otherwise(-F.col(size))).alias("net"), F.sum(F.col(size) * p0).alias("wp"), F.sum(size).alias("w"), F.max("winner").alias("winner")
    )
    long0 = F.col("net") > 0
    trial = agg.where("net <> 0 and w > 0").withColumns(
        {
            "p": F.when(long0, ratio(F.col("wp"), F.col("w"))).otherwise(100 - ratio(F.col("wp"), F.col("w"))),
            "won": (long0 == (F.col("winner") == 0)).cast("int"),
        }
    )
    trial = trial.where(F.col("p").between(low, high)).withColumn("decile", F.least(F.floor(F.col("p") / 10), F.lit(9)).cast("bigint"))
    deciles = trial.groupBy("decile").agg(F.sum("won").alias("wins"), F.count(F.lit(1)).alias("trials"))  # ten rows
    loo = ratio(F.col("wins") - F.col("won"), F.col("trials") - 1)
    return trial.join(F.broadcast(deciles), "decile").select("wallet", "condition_id", F.round("p", 6).alias("p"), "won", "decile", F.round(loo, 8).alias("bench_loo"))


def brier(bet: DataFrame, bins: int = 10) -> DataFrame:
    """Murphy's decomposition on forecasts rounded half-even to bin centres (bins + 1 of them)."""
    centre = F.bround(F.col("implied") * bins / F.lit(100).cast("decimal(10,0)"), 0).cast("bigint")
    cell = bet.withColumn("c", centre).groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("won"))
    whole = Window.partitionBy(F.lit(1))
    cell = cell.withColumns({"total": F.sum("n").over(whole), "wins": F.sum("won").over(whole)})
    f, o, base, share = F.col("c") / bins, F.col("won") / F.col("n"), F.col("wins") / F.col("total"), F.col("n") / F.col("total")
    sums = cell.agg(
        F.sum("n").alias("n"), F.sum(share * (f - o) * (f - o)).alias("rel"), F.sum(share * (o - base) * (o - base)).alias("res"), F.max(base * (1 - base)).alias("unc"),
    )
    return sums.select("n", *[F.round(c, 8).alias(a) for c, a in (("rel", "reliability"), ("res", "resolution"), ("unc", "uncertainty"))], F.round(F.col("rel") - F.col("res") + F.col("unc"), 8).alias("brier"))
