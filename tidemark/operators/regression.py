"""Least squares on tables of any size: clustered errors, wild bootstrap and two-way effects from sums, never from rows.

One aggregation gives each cluster's cross products. All that follows works on that table: coefficients need its total, errors
a sum over clusters, and a bootstrap draw re-signs cluster sums. What reaches the driver has the size of the coefficients.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tails import gamma_p, normal_sf_column
from tidemark.operators.primitives import global_row_number, global_running, small_side
from tidemark.sources.store import cut, delete, written

#: Sign vectors are enumerated up to so many clusters.
ENUMERATED = 12


@dataclass(frozen=True)
class Fit:
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    bread: np.ndarray
    scale: float
    rows: int
    clusters: int
    sums: DataFrame  # cluster, _n, _b<i>, _g<i>_<j>
    path: str

    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    def wald(self) -> tuple[float, float]:
        """Statistic and chi-squared p of all coefficients being 0."""
        w = float(self.beta @ np.linalg.pinv(self.cov) @ self.beta)
        return w, 1 - gamma_p(len(self.beta) / 2, w / 2)

    def close(self) -> None:
        """Delete the table of cluster sums."""
        delete(self.sums.sparkSession, self.path)


def indicators(df: DataFrame, column: str, most: int = 64) -> dict[str, Column]:
    """A 0/1 column for each value but the least; more than `most` values want two_way instead."""
    values = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return {f"{column}={v}": (F.col(column) == v).cast("double") for v in values[1:]}


def _dot(names: Sequence[str], weights: Sequence[float]) -> Column:
    return reduce(add, [F.col(n) * float(w) for n, w in zip(names, weights)], F.lit(0.0))


def _gram(k: int) -> list[list[str]]:
    return [[f"_g{min(i, j)}_{max(i, j)}" for j in range(k)] for i in range(k)]


def clustered_ols(df: DataFrame, x: dict[str, Column], y: Column, cluster: str, intercept: bool = True) -> Fit:
    """Coefficients with CR1 errors, G/(G-1) (n-1)/(n-k). Rows with a null in y, x or the cluster are left out.

    Two aggregations: of rows by cluster (pre-aggregated, so a hot cluster costs no more than another), and of the clusters.
    """
    terms = (["1"] if intercept else []) + list(x)
    columns = ([F.lit(1.0)] if intercept else []) + [c.cast("double") for c in x.values()]
    k = len(terms)
    named = df.select(F.col(cluster).alias("cluster"), y.cast("double").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(columns)])
    named = named.where(reduce(and_, [F.col(c).isNotNull() for c in named.columns]))
    products = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_g{i}_{j}") for i in range(k) for j in range(i, k)]
    sums, path = written(named.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"), *products, *[F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"_b{i}") for i in range(k)]), "cluster-sums")
    total = sums.agg(F.count(F.lit(1)).alias("_clusters"), *[F.sum(c).alias(c) for c in sums.columns if c != "cluster"]).first()
    gram = _gram(k)
    g = np.array([[total[c] or 0.0 for c in row] for row in gram])
    bread = np.linalg.pinv(g)
    beta = bread @ np.array([total[f"_b{i}"] or 0.0 for i in range(k)])
    scored = sums.select([(F.col(f"_b{i}") - _dot(gram[i], beta)).alias(f"_s{i}") for i in range(k)])
    meat = scored.agg(*[F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")).alias(f"_m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    m = np.array([[meat[f"_m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    n, clusters = total["_n"] or 0, total["_clusters"]
    scale = clusters / max(clusters - 1, 1) * (n - 1) / max(n - k, 1)
    return Fit(terms, beta, scale * bread @ m @ bread, bread, scale, n, clusters, sums, path)


def wild_cluster(fit: Fit, term: str, draws: int = 999, seed: str = "42") -> tuple[float, float, float]:
    """Restricted wild-cluster bootstrap of a coefficient being 0: its t, two-sided p, and p of as low a t.

    Under the restriction each draw flips whole clusters of residuals. The coefficients and the error of a draw follow from
    sums over clusters of signed scores, so a draw costs 2 k sums a cluster, pre-aggregated. Signs are all of them with up
    to ENUMERATED clusters; else the first digit of md5(seed:draw:cluster), the same on any partitioning.
    """
    k, j = len(fit.terms), fit.terms.index(term)
    gram = _gram(k)
    rest = [i for i in range(k) if i != j]
    total = fit.sums.agg(*[F.sum(c).alias(c) for c in fit.sums.columns if c not in ("cluster", "_n")]).first()
    g = np.array([[total[c] for c in row] for row in gram])
    base = np.zeros(k)
    base[rest] = np.linalg.pinv(g[np.ix_(rest, rest)]) @ np.array([total[f"_b{i}"] for i in rest])
    a = fit.bread[j]
    scored = fit.sums.select("cluster", *[(F.col(f"_b{i}") - _dot(gram[i], base)).alias(f"_r{i}") for i in range(k)], *[_dot(gram[i], a).alias(f"_h{i}") for i in range(k)])
    scored = scored.withColumn("_p", _dot([f"_r{i}" for i in range(k)], a))
    fixed = scored.agg(F.sum(F.col("_p") * F.col("_p")).alias("pp"), *[F.sum(F.col(f"_h{i}") * F.col(f"_h{m}")).alias(f"hh{i}_{m}") for i in range(k) for m in range(i, k)]).first()
    enumerate_all = fit.clusters <= ENUMERATED
    n = 1 << fit.clusters if enumerate_all else draws
    if enumerate_all:
        place = F.array_position(F.array_sort(F.lit([str(r[0]) for r in fit.sums.select(F.col("cluster").cast("string")).collect()])), F.col("cluster").cast("string"))
        minus = F.expr("shiftright(draw, cast(_place as int) - 1) & 1") == 1
        scored = scored.withColumn("_place", place)
    else:
        minus = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("draw").cast("string"), F.col("cluster").cast("string")).cast("binary")), 1, 1) < "8"
    signed = scored.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_w", F.when(minus, -1.0).otherwise(1.0))
    drawn = signed.groupBy("draw").agg(*[F.sum(F.col("_w") * F.col(f"_r{i}")).alias(f"r{i}") for i in range(k)], *[F.sum(F.col("_w") * F.col("_p") * F.col(f"_h{i}")).alias(f"q{i}") for i in range(k)])
    rows = np.array([[r[f"r{i}"] for i in range(k)] + [r[f"q{i}"] for i in range(k)] for r in drawn.collect()])  # a row a draw
    hh = np.array([[fixed[f"hh{min(i, m)}_{max(i, m)}"] for m in range(k)] for i in range(k)])
    delta = rows[:, :k] @ fit.bread
    variance = fit.scale * (fixed["pp"] - 2 * (rows[:, k:] * delta).sum(axis=1) + ((delta @ hh) * delta).sum(axis=1))
    t = _ratio(delta[:, j], np.sqrt(np.maximum(variance, 0)))
    seen = float(_ratio(fit.beta[j : j + 1], fit.se()[j : j + 1])[0])
    slack = 1e-9 * max(1.0, abs(seen)) if math.isfinite(seen) else 0.0
    two, less = int((np.abs(t) >= abs(seen) - slack).sum()), int((t <= seen + slack).sum())
    if enumerate_all:
        return seen, two / n, less / n
    return seen, (two + 1) / (n + 1), (less + 1) / (n + 1)


def _ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """top / bottom; 0 where the error is 0, as for a coefficient that nothing identifies."""
    return np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)


def two_way(df: DataFrame, unit: str, period: str, columns: Sequence[str], tol: float = 1e-11, most: int = 500) -> DataFrame:
    """unit, period and the columns without what units and periods explain: alternating projections until nothing changes.

    Rows are written once; a round computes the units' effects given the periods', then the other way round, and keeps only
    these two narrow tables, which replace those of the round before. Rounds end when no period's effect moves by more than
    `tol` of the largest value. Rows with a null in any of the columns are left out.
    """
    spark = df.sparkSession
    kept = df.select(unit, period, *[F.col(c).cast("double").alias(c) for c in columns])
    rows, _ = written(kept.where(reduce(and_, [F.col(c).isNotNull() for c in kept.columns])), "panel")
    largest = rows.agg(F.greatest(*[F.max(F.abs(F.col(c))) for c in columns], F.lit(0.0))).first()[0]
    if not largest:
        return rows
    times, times_path = written(rows.select(period).distinct().select(period, *[F.lit(0.0).alias(f"_t_{c}") for c in columns]), "periods")
    units, units_path = None, None
    for _ in range(most):
        given = rows.join(small_side(times), period)
        new, new_path = written(given.groupBy(unit).agg(*[F.avg(F.col(c) - F.col(f"_t_{c}")).alias(f"_u_{c}") for c in columns]), "units")
        if units_path:
            delete(spark, units_path)
        units, units_path = new, new_path
        given = rows.join(small_side(units), unit)
        after, after_path = written(given.groupBy(period).agg(*[F.avg(F.col(c) - F.col(f"_u_{c}")).alias(f"_t_{c}") for c in columns]), "periods")
        moved = after.alias("a").join(times.alias("b"), period).agg(F.max(F.greatest(*[F.abs(F.col(f"a._t_{c}") - F.col(f"b._t_{c}")) for c in columns], F.lit(0.0)))).first()[0]
        delete(spark, times_path)
        times, times_path = after, after_path
        if moved <= tol * largest:
            break
    out = rows.join(small_side(units), unit).join(small_side(times), period)
    return out.select(unit, period, *[(F.col(c) - F.col(f"_u_{c}") - F.col(f"_t_{c}")).alias(c) for c in columns])


def twfe(df: DataFrame, unit: str, period: str, y: str, x: Sequence[str]) -> Fit:
    """Two-way fixed effects: coefficients of x, errors clustered by unit (without a charge for the effects)."""
    flat = two_way(df, unit, period, [y, *x])
    return clustered_ols(flat, {c: F.col(c) for c in x}, F.col(y), unit, intercept=False)


def coefficients(fit: Fit) -> DataFrame:
    """term, beta, se, t as a table."""
    rows = [(t, float(b), float(s), float(b / s) if s else None) for t, b, s in zip(fit.terms, fit.beta, fit.se())]
    return fit.sums.sparkSession.createDataFrame(rows, "term string, beta double, se double, t double")


def clustered_mean(df: DataFrame, keys: Sequence[str], cluster: str, value: str) -> DataFrame:
    """keys, n, clusters, mean, se: the mean of `value` with its error by cluster, sqrt(G / (G - 1)) and all; null with one cluster.

    Rows are summed by cluster, then clusters by keys, from three sums of products: neither a hot cluster nor a hot key is ever
    brought together. Rows with a null value or cluster are left out.
    """
    v = F.col(value)
    by = df.where(v.isNotNull() & F.col(cluster).isNotNull()).groupBy(*keys, cluster).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(v.cast("double")).alias("_s"))
    pair = lambda a, b: F.sum(F.col(a) * F.col(b))
    sums = by.groupBy(*keys).agg(F.sum("_n").alias("_N"), F.count(F.lit(1)).alias("clusters"), F.sum("_s").alias("_S"), pair("_s", "_s").alias("_ss"), pair("_s", "_n").alias("_sn"), pair("_n", "_n").alias("_nn"))
    mean, g = F.col("_S") / F.col("_N"), F.col("clusters")
    meat = F.greatest(F.col("_ss") - 2 * mean * F.col("_sn") + mean * mean * F.col("_nn"), F.lit(0.0))
    return sums.select(*keys, F.col("_N").cast("bigint").alias("n"), "clusters", mean.alias("mean"), F.when(g > 1, F.sqrt(meat) / F.col("_N") * F.sqrt(g / (g - 1))).alias("se"))


def trend(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, n, mean, slope, se, t, p, range: the least-squares trend of y on x, by keys, with a two-sided normal p.

    slope is null where x does not vary; se, t and p also with fewer than three rows or a perfect fit. Rows with a null are left out.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    sums = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), F.covar_pop("_x", "_y").alias("_xy"), F.var_pop("_x").alias("_xx"), F.var_pop("_y").alias("_yy"), (F.max("_y") - F.min("_y")).alias("range"))
    xx = F.nullif(F.col("_xx"), F.lit(0.0))
    left = F.col("n") * (F.col("_yy") - F.col("_xy") * F.col("_xy") / xx)
    se = F.when((F.col("n") > 2) & (left > 1e-12 * F.col("n") * F.col("_yy")), F.sqrt(left / (F.col("n") - 2) / (F.col("n") * xx)))
    found = sums.withColumns({"slope": F.col("_xy") / xx, "se": se}).withColumn("t", F.col("slope") / F.col("se"))
    return found.select(*keys, "n", "mean", "slope", "se", "t", F.when(F.col("t").isNotNull(), 2 * normal_sf_column(F.abs("t"))).alias("p"), "range")


def holm(df: DataFrame, p: str, tie: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """A column rejected: Holm's step-down over all rows, false where p is null. By ranges, so tests may be many."""
    tests = cut(global_row_number(df.where(F.col(p).isNotNull()), [p, *tie], "_i"))
    m = tests.agg(F.count(F.lit(1)).alias("_m"))
    fits = (F.col(p) <= alpha / (F.col("_m") - F.col("_i") + 1)).cast("int")
    down = global_running(tests.crossJoin(F.broadcast(m)), ["_i"], {"_all": (fits, "min")})  # one row: the number of tests
    return down.withColumn("rejected", F.col("_all") == 1).drop("_i", "_m", "_all").unionByName(df.where(F.col(p).isNull()).withColumn("rejected", F.lit(False)))
