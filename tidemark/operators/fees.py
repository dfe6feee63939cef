"""Fee laws and what became of volume after fees began. Prices in cents, rates in hundredths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def law_v1(pc: Column, q: Column, side: Column, rate: int = 10) -> Column:
    """rate * min(p, 1 - p) * shares: logged in cents for buys, and in shares (over the price) for sales."""
    cents = rate * F.least(pc, 100 - pc) * q / 100.0
    return F.when(side == "SELL", cents / F.nullif(pc, F.lit(0))).otherwise(cents)


def in_money(logged: Column, pc: Column, side: Column) -> Column:
    """A logged fee of the first law in cents."""
    return F.when(side == "SELL", logged * pc).otherwise(logged)


def law_v2(rate: Column, pc: Column, q: Column) -> Column:
    """rate * p * (1 - p) * shares, exact, in millionths."""
    return rate * pc * (100 - pc) * q


def incidence_v2(rate: Column, pc: Column) -> Column:
    """Fee over notional under the second law: rate * (1 - p)."""
    return rate / 100.0 * (1 - pc / 100.0)


def event_study(panel: DataFrame, unit: str, since: str, y: str, reach: int) -> DataFrame:
    """Mean of y by time since treatment, less each unit's mean over the `reach` periods before it; units without any drop out."""
    before = panel.where(F.col(since).between(-reach, -1)).groupBy(unit).agg(F.avg(y).alias("base"))
    near = panel.where(F.col(since).between(-reach, reach)).join(before, unit)
    return near.groupBy(since).agg(F.count(F.lit(1)).alias("classes"), F.round(F.avg(F.col(y) - F.col("base")), 8).alias("effect"))


def rollout(panel: DataFrame, unit: str, since: str, measures: Sequence[str], weighted: str, weight: str, reach: int, low: int, high: int) -> DataFrame:
    """scope, since, units, <measure>..., weighted: means over units by time since their start, pooled over all units within
    `reach`, and balanced over those that have every time from low to high, so that no change of units mixes with an effect.

    panel holds one row for each unit and time. `weighted` is averaged by `weight` as well.
    """
    full = panel.where(F.col(since).between(low, high)).groupBy(unit).agg(F.countDistinct(since).alias("_n")).where(F.col("_n") == high - low + 1).select(unit)
    pooled = panel.where(F.col(since).between(-reach, reach)).withColumn("scope", F.lit("pooled"))
    balanced = panel.where(F.col(since).between(low, high)).join(full, unit, "left_semi").withColumn("scope", F.lit("balanced"))
    both = pooled.unionByName(balanced)
    total = F.nullif(F.sum(F.col(weight).cast("double")), F.lit(0.0))
    return both.groupBy("scope", since).agg(F.count(F.lit(1)).alias("units"), *[F.avg(m).alias(m) for m in measures], (F.sum(F.col(weighted) * F.col(weight)) / total).alias("weighted"))
