"""How concentrated flow is: Gini, Herfindahl, top shares, Lorenz points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.primitives import global_ntile, global_row_number, global_running, ratio
from tidemark.sources.store import cut


def wallet_weights(df: DataFrame, keys: Sequence[str], wallet: str, amount: str) -> DataFrame:
    """Positive totals of amount (an integer) by keys and wallet."""
    return df.groupBy(*keys, F.col(wallet).alias("wallet")).agg(F.sum(amount).cast("bigint").alias("w")).where("w > 0")


def net_flow_weights(df: DataFrame, keys: Sequence[str], wallet: str, amount: str) -> DataFrame:
    """|sum of signed amounts| towards outcome 0: buying it and selling the other one count alike."""
    toward = (F.col("side") == "BUY") == (F.col("outcome_index") == 0)
    signed = F.when(toward, F.col(amount)).otherwise(-F.col(amount))
    return df.groupBy(*keys, F.col(wallet).alias("wallet")).agg(F.abs(F.sum(signed)).cast("bigint").alias("w")).where("w > 0")


def concentration(weights: DataFrame, keys: Sequence[str], tops: Sequence[int] = (1, 5, 10, 25)) -> DataFrame:
    """Per key: n, total, gini, hhi and the share of the largest k wallets.

    gini = 2 * sum(i * w) / (n * sum(w)) - (n + 1) / n over ascending weights, null for a single wallet. One sort by key
    serves all: equal weights may stand in any order, and the largest are the last. Without keys, places are counted by
    ranges (global_row_number).
    """
    if keys:
        part = Window.partitionBy(*keys)
        ranked = weights.withColumns({"i": F.row_number().over(part.orderBy("w", "wallet")), "m": F.count(F.lit(1)).over(part)})
    else:
        placed = cut(global_row_number(weights, ["w", "wallet"], "i"))
        ranked = placed.crossJoin(F.broadcast(placed.agg(F.count(F.lit(1)).alias("m"))))
    w = F.col("w").cast("double")
    total, n = F.sum("w").cast("double"), F.count(F.lit(1))
    gini = 2 * F.sum(F.col("i") * w) / (n * total) - (n + 1) / n
    return ranked.groupBy(*keys).agg(
        n.alias("n"),
        F.sum("w").cast("bigint").alias("total"),
        F.round(F.when(n > 1, gini), 8).alias("gini"),
        F.round(F.sum(w * w) / (total * total), 8).alias("hhi"),
        *[F.round(F.sum(F.when(F.col("i") > F.col("m") - k, F.col("w")).otherwise(0)).cast("double") / total, 8).alias(f"top{k}") for k in tops],
    )


def top_profile(weights: DataFrame, quantiles: Sequence[float] = (0.5, 0.9, 0.99), shares: Sequence[float] = (0.001, 0.01, 0.1), firsts: Sequence[int] = ()) -> DataFrame:
    """How few wallets hold a share of the total, what the top share of wallets (rounded up) holds, and what the first k hold.

    Ranks and running sums are global, by ranges; ties by wallet.
    """
    order = [F.col("w").desc(), F.col("wallet")]
    placed = cut(global_running(weights, order, {"r": (F.lit(1).cast("bigint"), "sum"), "cum": (F.col("w"), "sum")}))
    ranked = placed.crossJoin(F.broadcast(placed.agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"))))
    few = [F.min(F.when(F.col("cum") >= q * F.col("total"), F.col("r"))).cast("bigint").alias(f"wallets_for_{round(q * 100)}") for q in quantiles]
    held = lambda c: F.round(F.sum(F.when(c, F.col("w")).otherwise(0)).cast("double") / F.max("total"), 8)
    tops = [held(F.col("r") <= F.ceil(F.col("n") * s)).alias(f"top_share_{k}") for k, s in enumerate(shares)]
    return ranked.agg(F.max("n").alias("n"), *few, *tops, *[held(F.col("r") <= k).alias(f"first{k}") for k in firsts])


def lorenz_points(weights: DataFrame, buckets: int = 10) -> DataFrame:
    """Cumulative share of wallets and of weight at each bucket of ascending weight."""
    ranked = global_ntile(weights, ["w", "wallet"], buckets, "bucket")
    grouped = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    run = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(1))
    return grouped.select(
        F.col("bucket").cast("bigint").alias("bucket"),
        F.round(ratio(F.sum("n").over(run), F.sum("n").over(whole)), 8).alias("cum_wallets"),
        F.round(ratio(F.sum("w").over(run), F.sum("w").over(whole)), 8).alias("cum_weight"),
    )
