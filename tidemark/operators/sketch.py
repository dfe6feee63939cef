"""A mergeable quantile sketch: t-digest centroids (Dunning and Ertl), kept by key and merged in any order."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Centroids of a digest, about; errors of rank fall with it (rank_bound).
DELTA = 200
#: Values of a key that a task holds before it folds them, and digests of a key that one task of a merge takes.
HELD, FAN = 8192, 64


def rank_bound(q: float, delta: int = DELTA, merges: int = 2) -> float:
    """A bound on the error of a quantile's rank, as a share of all rows: each merge moves no value by more than a cluster's
    weight, which the scale function keeps under 2 pi / delta * sqrt(q (1 - q)), widened by a cluster's own width."""
    width = 2 * math.pi / delta
    return merges * width * (math.sqrt(q * (1 - q)) + width)


def fold(mean: np.ndarray, weight: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray]:
    """Centroids in order, folded so that each spans at most one unit of delta / (2 pi) asin(2 q - 1). Ends stay single."""
    order = np.lexsort((weight, mean))
    mean, weight = mean[order], weight[order]
    if len(mean) < 3:
        return mean, weight
    upto = np.cumsum(weight)
    k = delta / (2 * math.pi) * np.arcsin(np.clip(2 * (upto - weight / 2) / upto[-1] - 1, -1, 1))
    cluster = np.floor(k - k[0]).astype(np.int64)
    cluster[-1] = cluster[-2] + 1  # the largest value is a cluster of its own, as the least one is
    cluster[1:] += 1
    starts = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
    total = np.add.reduceat(weight, starts)
    return np.add.reduceat(mean * weight, starts) / total, total


def digests(df: DataFrame, keys: Sequence[str], value: str, delta: int = DELTA) -> DataFrame:
    """keys, part, mean, weight: each task's digest of each key. Nothing is shuffled; a task holds HELD values a key at most.

    Null and NaN values are left out. These rows can be written, kept by part, and merged with those of other parts later.
    """
    kept = df.select(*keys, F.col(value).cast("double").alias("mean")).where("mean is not null and not isnan(mean)")
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[tuple, int] = {}
        for pdf in batches:
            for key, x in pdf.groupby(names, dropna=False)["mean"] if names else [((), pdf["mean"])]:
                x = x.to_numpy(float)
                parts = held.setdefault(key, [])
                parts.append((x, np.ones(len(x))))
                sizes[key] = sizes.get(key, 0) + len(x)
                if sizes[key] > HELD:
                    held[key] = [fold(*map(np.concatenate, zip(*parts)), delta)]
                    sizes[key] = len(held[key][0][0])
        part = TaskContext.get().partitionId()
        for key, parts in held.items():
            mean, weight = fold(*map(np.concatenate, zip(*parts)), delta)
            yield pd.DataFrame({**dict(zip(names, key)), "part": part, "mean": mean, "weight": weight})

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in names)
    return kept.mapInPandas(run, f"{kinds}part bigint, mean double, weight double")


def merged(parts: DataFrame, keys: Sequence[str], delta: int = DELTA) -> DataFrame:
    """keys, mean, weight: one digest of each key, from those of any number of parts.

    Parts are merged FAN at a time in two rounds, so a key that all tasks have seen is no single task's burden.
    """
    kinds = "".join(f"`{k}` {parts.schema[k].dataType.simpleString()}, " for k in keys)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, weight = fold(pdf["mean"].to_numpy(), pdf["weight"].to_numpy(), delta)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "mean": mean, "weight": weight})

    salted = parts.withColumn("_s", F.floor(F.col("part") / FAN))
    once = salted.groupBy(*keys, "_s").applyInPandas(join, f"{kinds}mean double, weight double")
    return once.groupBy(*keys).applyInPandas(join, f"{kinds}mean double, weight double")


def quantiles(digest: DataFrame, keys: Sequence[str], asked: Sequence[float]) -> DataFrame:
    """keys, q, value: straight lines between the middles of centroids, of which a key has about DELTA."""
    w = Window.partitionBy(*keys).orderBy("mean", "weight")
    whole = Window.partitionBy(*keys)
    placed = digest.withColumn("_upto", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("weight").over(whole))
    placed = placed.withColumn("_at", (F.col("_upto") - F.col("weight") / 2) / F.col("_n"))
    placed = placed.withColumns({"_to": F.lead("_at").over(w), "_next": F.lead("mean").over(w), "_first": F.row_number().over(w) == 1})
    out = placed.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in asked])))
    inside = (F.col("q") >= F.col("_at")) & (F.col("_to").isNull() | (F.col("q") < F.col("_to")))
    out = out.where(inside | (F.col("_first") & (F.col("q") < F.col("_at"))))
    share = F.greatest((F.col("q") - F.col("_at")) / (F.col("_to") - F.col("_at")), F.lit(0.0))
    line = F.when(F.col("_to").isNull(), F.col("mean")).otherwise(F.col("mean") + share * (F.col("_next") - F.col("mean")))
    return out.select(*keys, "q", line.alias("value"))


def rank_errors(df: DataFrame, found: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """found with n, and by how much its q misses the ranks of its value: 0 if q lies between the shares below and up to it."""
    asked = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("q", F.col("value").alias("v")))).alias("_asked"))  # a few a key
    rows = df.select(*keys, F.col(value).cast("double").alias("_x")).where("_x is not null and not isnan(_x)").join(F.broadcast(asked), list(keys))
    each = rows.select(*keys, "_x", F.explode("_asked").alias("a"))
    counted = each.groupBy(*keys, F.col("a.q").alias("q"), F.col("a.v").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_x") < F.col("a.v")).cast("double")).alias("_b"), F.avg((F.col("_x") <= F.col("a.v")).cast("double")).alias("_u"))
    return counted.withColumn("rank_error", F.greatest(F.col("_b") - F.col("q"), F.col("q") - F.col("_u"), F.lit(0.0))).drop("_b", "_u")
