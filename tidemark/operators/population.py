"""Skill of a whole population: tails against chance, sign flips with false-discovery control, persistence, clustered gaps."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.inference import seeded
from tidemark.functions.tails import binomial_sf_column
from tidemark.operators import skill as K
from tidemark.operators.primitives import bh_qvalues, global_ntile, ratio, spearman
from tidemark.sources.store import cut


def binomial_skill(bet: DataFrame, wallet: str = "wallet", least: int = 10) -> DataFrame:
    """Per wallet with `least` bets: wins, mean implied probability in cents, P(at least so many wins) by chance, q-value."""
    per = bet.groupBy(F.col(wallet).alias("wallet")).agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("wins"), F.sum("implied").alias("implied"))
    per = per.where(F.col("n") >= least).withColumn("rate", ratio(F.col("implied"), F.col("n") * 100))
    return bh_qvalues(per.withColumn("p", binomial_sf_column(F.col("wins"), F.col("n"), F.col("rate"))), "p", ["wallet"])


def simulated_discoveries(bet: DataFrame, level: float = 0.05, least: int = 10, sims: int = 200, wallet: str = "wallet") -> DataFrame:
    """Wallets under `level` as seen, and in simulated worlds where every bet wins with its implied probability.

    A world is simulated where the wallets are: each partition draws its own wallets' wins from seeds of (wallet, world), so
    the result does not depend on the partitioning, and only counts by world are shuffled.
    """
    per = bet.groupBy(F.col(wallet).alias("wallet")).agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("wins"), F.sum("implied").alias("implied"))
    per = per.where(F.col("n") >= least).select("wallet", "n", "wins", ratio(F.col("implied"), F.col("n") * 100).alias("rate"))

    def draw(batches):
        from tidemark.functions.tails import binomial_sf

        for pdf in batches:
            n, rate = pdf["n"].to_numpy(float), np.clip(pdf["rate"].to_numpy(float), 0, 1)
            wins = np.stack([seeded("null", w).binomial(int(k), r, sims) for w, k, r in zip(pdf["wallet"], n, rate)]) if len(pdf) else np.zeros((0, sims))
            hits = binomial_sf(wins, n[:, None], rate[:, None]) < level if len(pdf) else np.zeros((0, sims), bool)
            seen = binomial_sf(pdf["wins"].to_numpy(float), n, rate) < level if len(pdf) else np.zeros(0, bool)
            yield pd.DataFrame({"world": np.arange(-1, sims), "hits": np.concatenate([[seen.sum()], hits.sum(axis=0)]).astype("int64")})

    worlds = per.mapInPandas(draw, "world int, hits bigint").groupBy("world").agg(F.sum("hits").alias("hits"))
    chance = F.when(F.col("world") >= 0, F.col("hits"))
    return worlds.agg(F.max(F.when(F.col("world") < 0, F.col("hits"))).alias("seen"), F.avg(chance).alias("by_chance"), F.percentile(chance, F.lit(0.95)).alias("by_chance_95"))


def split_half(profits: DataFrame, market: str = "condition_id", seed: str = "42") -> DataFrame:
    """Rank correlation across wallets of what they earn in either half of their markets, halves by the md5 of market and seed."""
    half = F.substring(F.md5(F.concat(F.col(market).cast("string"), F.lit(seed)).cast("binary")), 1, 1) < "8"
    per = profits.groupBy("wallet").agg(F.sum(F.when(half, F.col("pnl")).otherwise(0)).alias("first"), F.sum(F.when(~half, F.col("pnl")).otherwise(0)).alias("second"))
    return spearman(cut(per), "first", "second")


def quintile_persistence(profits: DataFrame, early: str) -> DataFrame:
    """Wallets by quintile of profit in early markets, and what they earn in the late ones (early: a boolean column)."""
    per = profits.groupBy("wallet").agg(
        F.sum(F.when(F.col(early), F.col("pnl"))).alias("before"), F.sum(F.when(~F.col(early), F.col("pnl"))).alias("after")
    ).where("before is not null and after is not null")
    ranked = global_ntile(per, ["before", "wallet"], 5, "quintile")
    return ranked.groupBy("quintile").agg(F.count(F.lit(1)).alias("wallets"), F.sum("before").alias("before"), F.sum("after").alias("after"), F.round(F.avg((F.col("after") > 0).cast("int")), 8).alias("winners_after"))


def clustered_gap(bet: DataFrame, groups: DataFrame, group: str, wallet: str = "wallet") -> DataFrame:
    """Per group: bets, wallets, win rate less implied, and its standard error with bets of one wallet taken together (CR0).

    The sums of each wallet's residuals are all that the error needs, so bets are aggregated once.
    """
    per = bet.groupBy(F.col(wallet).alias("wallet")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("won") * 100 - F.col("implied")).alias("edge"))
    named = cut(per.join(groups.select("wallet", group), "wallet"))
    means = named.groupBy(group).agg(F.sum("n").alias("bets"), F.count(F.lit(1)).alias("wallets"), ratio(F.sum("edge"), F.sum("n") * 100).alias("gap"))
    off = F.col("edge") / 100.0 - F.col("n") * F.col("gap")
    error = named.join(means.select(group, "gap"), group).groupBy(group).agg(F.sqrt(F.sum(off * off)).alias("root"))
    return means.join(error, group).select(group, "bets", "wallets", F.round("gap", 8).alias("gap"), F.round(F.col("root") / F.col("bets"), 8).alias("se"))


def bootstrap_difference(bet: DataFrame, groups: DataFrame, group: str, low: int, high: int, draws: int = 500, wallet: str = "wallet") -> DataFrame:
    """Interval of gap(high) - gap(low) when wallets are drawn again: each wallet gets a Poisson(1) weight in each draw.

    Weights come from seeds of (wallet, draw), so no sample is ever collected; sums by draw are all that is shuffled.
    """
    per = bet.groupBy(F.col(wallet).alias("wallet")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("won") * 100 - F.col("implied")).alias("edge"))
    named = per.join(groups.select("wallet", group), "wallet").where(F.col(group).isin(low, high))

    def draw(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            weight = np.stack([seeded("poisson", w).poisson(1.0, draws) for w in pdf["wallet"]])
            for g, at in pdf.groupby(group).indices.items():
                yield pd.DataFrame({"g": int(g), "draw": np.arange(draws), "edge": (weight[at] * pdf["edge"].to_numpy(float)[at, None]).sum(axis=0), "n": (weight[at] * pdf["n"].to_numpy(float)[at, None]).sum(axis=0)})

    sums = named.mapInPandas(draw, "g bigint, draw int, edge double, n double").groupBy("draw").agg(*[F.sum(F.when(F.col("g") == g, F.col(c))).alias(f"{c}{g}") for g in (low, high) for c in ("edge", "n")])
    gap = lambda g: F.col(f"edge{g}") / F.nullif(F.col(f"n{g}") * 100, F.lit(0.0))
    return sums.select((gap(high) - gap(low)).alias("d")).agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.5)).alias("middle"), F.percentile("d", F.lit(0.975)).alias("high"))


def leader_sets(tape: DataFrame, k: int = 20, least: int = 20, seed: str = "42") -> DataFrame:
    """(wallet, name): six ways to choose the first k wallets: by notional, profit, calibration (with `least` bets), trades, breadth,
    and a seeded sample. Six times k rows, from one aggregation each; ties go to the smaller wallet."""
    pnl = K.covered_pnl(tape).groupBy("wallet").agg(F.sum("gross").alias("s"))
    by = tape.groupBy("wallet").agg(F.sum("notional").alias("s"), F.count(F.lit(1)).alias("n"), F.countDistinct("condition_id").alias("m"))
    skilled = K.bets(tape).groupBy("wallet").agg(F.count(F.lit(1)).alias("n"), (F.avg("won") - F.avg("implied") / 100).alias("s")).where(F.col("n") >= least)
    hashed = F.md5(F.concat(F.col("wallet").cast("string"), F.lit(seed)).cast("binary"))
    down = lambda c: F.col(c).desc()
    ways = [("top notional", by, [down("s")]), ("top profit", pnl, [down("s")]), ("calibrated", skilled, [down("s")]), ("active", by, [down("n")]), ("broad", by, [down("m"), down("s")]), ("sample", by, [hashed])]
    first = [df.orderBy(*order, "wallet").limit(k).select("wallet", F.lit(name).alias("name")) for name, df, order in ways]
    return reduce(DataFrame.union, first)
