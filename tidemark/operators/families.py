"""Families of exclusive markets whose prices should sum to one: hourly sums, corrective trades, episodes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.effects import unit_draws
from tidemark.operators.primitives import running
from tidemark.sources.store import cut

_ORDER = ["sec", "tx_hash", "evt_index"]


def hourly_sums(hourly: DataFrame, carry_h: int = 24, least: int = 3) -> DataFrame:
    """Per (family, hour) with a trade: how many candidates had a price within carry_h hours, and the sum of the last ones.

    hourly: (family, condition_id, hour, p). Each candidate's price is spread over the hours until it is replaced or
    goes stale; hours come from the family's own grid, so the join is by family.
    """
    w = Window.partitionBy("family", "condition_id").orderBy("hour")
    spans = hourly.withColumn("until", F.least(F.coalesce(F.lead("hour").over(w) - 1, F.col("hour") + carry_h), F.col("hour") + carry_h))
    grid = hourly.select("family", F.col("hour").alias("h")).distinct()
    live = spans.withColumn("h", F.explode(F.sequence("hour", "until"))).join(grid, ["family", "h"], "left_semi")
    out = live.groupBy("family", F.col("h").alias("hour")).agg(F.count(F.lit(1)).alias("alive"), F.sum("p").alias("total"))
    return out.where(F.col("alive") >= least)


def price_sums(trades: DataFrame, stale_s: int = 172_800, least: int = 3, chunk: int = 2_592_000) -> DataFrame:
    """Each trade with how far its family's price sum stands from 100 cents before and after it (off_before, off_after).

    trades: family, condition_id, sec, tx_hash, evt_index, pc, wallet. The sum counts only while every candidate of the
    family (all that ever trade in it; `least` or more) has a price no older than stale_s; else the distance is null. The
    sum is a running sum of price changes, and a candidate that goes stale is an event of its own, so nothing is held per
    family but running totals, by chunks of time.
    """
    known = running(trades, ["family", "condition_id"], _ORDER, chunk, before={"prev_pc": F.col("pc"), "prev_sec": F.col("sec")})
    known = cut(known)  # read twice by each running total
    late = F.coalesce((F.col("sec") - F.col("prev_sec") > stale_s).cast("bigint"), F.lit(0))
    known = known.withColumns({"late": late, "fresh": F.col("prev_sec").isNull().cast("bigint"), "step": F.col("pc") - F.coalesce("prev_pc", F.lit(0))})
    members = trades.groupBy("family", "condition_id").agg(F.max("sec").alias("sec"))
    gone = known.where("late = 1").select("family", "prev_sec").union(members.select("family", "sec"))
    none = F.lit(0).cast("bigint")
    gone = gone.toDF("family", "sec").select("family", (F.col("sec") + stale_s + 1).alias("sec"), F.lit(0).alias("kind"), none.alias("step"), none.alias("fresh"), F.lit(1).cast("bigint").alias("aged"))
    events = known.withColumns({"kind": F.lit(1), "aged": -F.col("late")}).unionByName(gone, allowMissingColumns=True)
    sums = {"total": F.col("step"), "seen": F.col("fresh"), "stale": F.col("aged")}
    totals = running(events, ["family"], ["sec", "kind", "tx_hash", "evt_index"], chunk, sums=sums).where("kind = 1")
    size = members.groupBy("family").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least)
    after = (F.col("seen") == F.col("members")) & (F.col("stale") == 0)
    before = (F.col("seen") - F.col("fresh") == F.col("members")) & (F.col("stale") + F.col("late") == 0)
    return totals.join(size, "family").select(
        "family", "condition_id", *_ORDER, "pc", "wallet",
        F.when(before, F.abs(F.col("total") - F.col("step") - 100)).alias("off_before"), F.when(after, F.abs(F.col("total") - 100)).alias("off_after"),
    )


def _credited(sums: DataFrame, opens: int, closes: int, chunk: int) -> DataFrame:
    """Trades with mag (what they take off the distance; negative if they add to it) and the number of their episode."""
    both = F.col("off_before").isNotNull() & F.col("off_after").isNotNull()
    state = F.when(F.col("off_after") > opens, 1).when(both & (F.col("off_after") < closes), 0)
    held = cut(running(sums, ["family"], _ORDER, chunk, before={"prior": state}))
    prior, state = F.coalesce("prior", F.lit(0)), F.coalesce(state, F.lit(-1))
    starts = ((prior == 0) & (state == 1)).cast("bigint")
    held = held.withColumns({"starts": starts, "ends": ((prior == 1) & (state == 0)).cast("int"), "inside": (prior == 1) | (starts == 1), "mag": F.when(both, F.col("off_before") - F.col("off_after"))})
    return running(held, ["family"], _ORDER, chunk, sums={"episode": F.col("starts")})


def episodes(sums: DataFrame, opens: int = 5, closes: int = 2, chunk: int = 2_592_000) -> DataFrame:
    """Finished stretches in which a family's prices sum to more than `opens` cents off, until within `closes`.

    sums: as price_sums gives them. Per episode: start, peak distance, how many wallets took something off, and the closer:
    the wallet with the largest total taken off (ties by its first such trade), null if there is none.
    """
    inside = cut(_credited(sums, opens, closes, chunk).where("inside"))
    peak = F.when(F.col("mag").isNotNull(), F.greatest("off_before", "off_after")).when(F.col("starts") == 1, F.col("off_after"))
    whole = inside.groupBy("family", "episode").agg(F.min("sec").alias("start"), F.max(peak).alias("peak"), F.max("ends").alias("ended"))
    gains = inside.where("mag > 0").groupBy("family", "episode", "wallet").agg(F.sum("mag").alias("gain"), F.min(F.struct(*_ORDER)).alias("at"))
    ranked = F.row_number().over(Window.partitionBy("family", "episode").orderBy(F.col("gain").desc(), "at"))
    several = F.count(F.lit(1)).over(Window.partitionBy("family", "episode"))
    top = gains.select("family", "episode", "wallet", "gain", ranked.alias("r"), several.alias("n")).where("r = 1")
    out = whole.where("ended = 1").join(top, ["family", "episode"], "left")
    return out.select("family", "start", F.col("peak").cast("bigint").alias("peak"), F.coalesce("n", F.lit(0)).cast("bigint").alias("correctors"), F.col("wallet").alias("closer"), F.coalesce("gain", F.lit(0)).cast("bigint").alias("corrective"))


def corrections(sums: DataFrame) -> DataFrame:
    """Per wallet: cents taken off and added to the distance by its trades, and how many did either."""
    mag = F.col("off_before") - F.col("off_after")
    total = lambda c: F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0)).cast("bigint")
    return sums.where("off_before is not null and off_after is not null").groupBy("wallet").agg(
        total(mag).alias("corrective"), total(-mag).alias("added"), F.count_if(mag > 0).alias("n_corrective"), F.count_if(mag < 0).alias("n_added")
    )


def covered_sums(hourly: DataFrame, members: DataFrame, carry_h: int = 24, least: int = 3, coverage: float = 0.8) -> DataFrame:
    """hourly_sums where the candidates alive in that hour (first to last trade) number `least` and enough have a price."""
    grid = hourly_sums(hourly, carry_h, 1)
    alive = members.select("family", F.explode(F.sequence("first_hour", "last_hour")).alias("hour")).groupBy("family", "hour").agg(F.count(F.lit(1)).alias("candidates"))
    return grid.join(alive, ["family", "hour"]).where((F.col("candidates") >= least) & (F.col("alive") >= coverage * F.col("candidates")))


def standardised_gap(rows: DataFrame, keys: Sequence[str], cells: Sequence[str], flag: str, value: str, weight: str) -> DataFrame:
    """keys and gap: the mean of value where the flag holds less the mean where it does not, by cell, cells weighted by their rows.

    Cells that lack one side are left out, so only like is compared with like. `weight` counts a row several times, or not at all.
    """
    w = F.col(weight).cast("double")
    part = lambda t, c: F.sum(F.when(F.col(flag) == t, c))
    by = rows.groupBy(*keys, *cells).agg(part(True, w * F.col(value)).alias("x1"), part(True, w).alias("w1"), part(False, w * F.col(value)).alias("x0"), part(False, w).alias("w0"))
    full = by.where("w1 > 0 and w0 > 0").withColumns({"d": F.col("x1") / F.col("w1") - F.col("x0") / F.col("w0"), "w": F.col("w1") + F.col("w0")})
    return full.groupBy(*keys).agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("gap"))


def gap_intervals(rows: DataFrame, scope: str, cells: Sequence[str], flag: str, value: str, row: str, draws: int, seed: str = "42") -> DataFrame:
    """scope, n, gap, low, high: the standardised gap of each scope with a 95 % interval from drawing its rows again.

    Rows are reweighted by multinomial counts (effects.unit_draws) rather than copied, scope by scope; `row` names a row, as a
    whole number. Scopes are few: each is a pass of its own.
    """
    parts = []
    for (name,) in rows.select(scope).distinct().orderBy(scope).collect():
        mine = cut(rows.where(F.col(scope) == name).withColumn("one", F.lit(1)))
        point = standardised_gap(mine, [scope], cells, flag, value, "one")
        weights = unit_draws(mine.select(F.col(row).alias("unit")), draws, seed).withColumnRenamed("unit", row)
        drawn = standardised_gap(mine.drop("one").join(weights, row), ["draw"], cells, flag, value, "weight")
        span = drawn.agg(F.percentile("gap", F.lit(0.025)).alias("low"), F.percentile("gap", F.lit(0.975)).alias("high"))  # a row a draw
        counts = mine.agg(F.count(F.lit(1)).alias("n"))
        parts.append(point.crossJoin(F.broadcast(span)).crossJoin(F.broadcast(counts)))
    return reduce(DataFrame.union, parts)
