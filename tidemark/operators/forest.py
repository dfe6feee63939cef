"""Isolation forests: how few random cuts set a row apart from the others."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.store import delete, written


def _unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search among n: what a leaf of n rows would still take."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _whole(features: Sequence[str]) -> Column:
    fine = [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) < float("inf")) for f in features]
    return reduce(and_, fine)


def grow(df: DataFrame, key: str, features: Sequence[str], trees: int = 64, sample: int = 256, seed: str = "42") -> DataFrame:
    """tree, node, feature, cut, n: random trees over samples of rows, node 1 the root, 2 k and 2 k + 1 the children of k.

    A tree takes `sample` rows (all, if fewer), the first by md5(seed:tree:key) of a pool of trees * sample rows, the first by
    md5(seed:key): sampling is the method's own, and the pool bounds the work. Each level is one aggregation over the pool's rows:
    a node that holds several different rows is cut at a random place of a random feature that varies in it, down to
    log2(sample) levels. feature is null in leaves. Rows with a null or non-finite feature, or a null key, are left out.
    """
    values = F.array(*[F.col(f).cast("double") for f in features])
    pool = df.where(_whole(features) & F.col(key).isNotNull()).select(F.col(key).alias("k"), values.alias("v"))
    pool = pool.orderBy(_unit(seed, F.col("k")), "k").limit(trees * sample)
    first = Window.partitionBy("tree").orderBy(_unit(seed, F.col("tree"), F.col("k")), "k")
    dealt = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= sample)
    rows, path = written(dealt.select("tree", F.lit(1).cast("bigint").alias("node"), "v"), "forest-rows")
    levels = []
    for level in range(math.ceil(math.log2(sample)) + 1):
        ends = rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), *[f(F.col("v")[i]).alias(f"{a}{i}") for i in range(len(features)) for f, a in ((F.min, "a"), (F.max, "b"))])
        spans = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b")) for i in range(len(features))]), lambda s: s["b"] > s["a"])
        open_ = ends.withColumn("_s", spans).withColumn("_p", F.get("_s", F.floor(_unit(seed, F.col("tree"), F.col("node"), "feature") * F.size("_s")).cast("int")))
        if level == math.ceil(math.log2(sample)):
            open_ = open_.withColumn("_p", F.when(F.lit(False), F.col("_p")))
        place = F.col("_p.a") + _unit(seed, F.col("tree"), F.col("node"), "cut") * (F.col("_p.b") - F.col("_p.a"))
        nodes, at = written(open_.select("tree", "node", F.col("_p.i").alias("feature"), F.greatest(place, F.col("_p.a")).alias("cut"), "n"), "forest-nodes")
        levels.append(nodes)
        below = rows.join(F.broadcast(nodes.where("feature is not null").drop("n")), ["tree", "node"])  # trees * sample rows at most
        old = path
        rows, path = written(below.select("tree", (F.col("node") * 2 + (F.get("v", F.col("feature")) > F.col("cut")).cast("bigint")).alias("node"), "v"), "forest-rows")
        delete(df.sparkSession, old)
    delete(df.sparkSession, path)
    return reduce(DataFrame.union, levels)


def isolation(df: DataFrame, key: str, features: Sequence[str], trees: int = 64, sample: int = 256, seed: str = "42") -> DataFrame:
    """key, depth, score for every row: the mean number of cuts that set it apart, and 2^(-depth / expected), near 1 for odd rows.

    The forest, 2 * trees * sample nodes at most, is collected and sent with the tasks; rows are scored where they lie. Rows
    with a null or non-finite feature, and all rows where none could be sampled, have null depth and score. The same on any
    partitioning: samples and cuts come from md5 of keys and nodes.
    """
    grown = grow(df, key, features, trees, sample, seed).toPandas()
    levels = math.ceil(math.log2(sample))
    feature, cut = np.full((trees, 2 ** (levels + 1)), -1), np.zeros((trees, 2 ** (levels + 1)))
    rest = np.zeros((trees, 2 ** (levels + 1)))
    t, node = grown["tree"].to_numpy(int), grown["node"].to_numpy(int)
    feature[t, node], cut[t, node] = grown["feature"].fillna(-1).to_numpy(int), grown["cut"].fillna(0).to_numpy(float)
    rest[t, node] = mean_path(grown["n"].to_numpy(float))
    expected = float(mean_path(grown.loc[node == 1, "n"].max())) if len(grown) else 0.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[[f"_f{i}" for i in range(len(features))]].to_numpy(float)
            depth, each = np.zeros(len(x)), np.arange(len(x))
            for k in range(trees):
                at, steps = np.ones(len(x), int), np.zeros(len(x))
                for _ in range(levels):
                    f = feature[k, at]
                    inner = f >= 0
                    at = np.where(inner, 2 * at + (x[each, np.maximum(f, 0)] > cut[k, at]), at)
                    steps += inner
                depth += steps + rest[k, at]
            depth /= trees
            fine = np.isfinite(x).all(1) & (expected > 0)
            yield pd.DataFrame({key: pdf[key], "depth": np.where(fine, depth, np.nan), "score": np.where(fine, 2 ** (-depth / max(expected, 1e-300)), np.nan)})

    rows = df.select(key, *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
    found = rows.mapInPandas(score, f"`{key}` {df.schema[key].dataType.simpleString()}, depth double, score double")
    return found.select(key, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("depth", "score")])
