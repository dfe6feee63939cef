"""Inference kernels for panels of up to some ten thousand rows, in numpy, and their per-key Spark forms.

Seeds are derived from the key, so results do not depend on how rows are partitioned.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tails import normal_cdf, normal_sf_column, student_cdf
from tidemark.sources.store import cut


def seeded(*parts: object) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(zlib.crc32("|".join(map(str, parts)).encode())))


def bh_qvalues(p: Sequence[float]) -> np.ndarray:
    p = np.asarray(p, float)
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


def holm(p: Sequence[float]) -> np.ndarray:
    """Step-down adjusted p-values."""
    p = np.asarray(p, float)
    order = np.argsort(p, kind="stable")
    steps = np.maximum.accumulate(p[order] * np.arange(len(p), 0, -1))
    out = np.empty(len(p))
    out[order] = np.minimum(steps, 1)
    return out


def tost(estimate: float, se: float, margin: float, df: float | None = None) -> float:
    """p of equivalence within +-margin: the larger of the two one-sided tests."""
    cdf = normal_cdf if df is None else (lambda t: student_cdf(t, df))
    low, high = (estimate + margin) / se, (estimate - margin) / se
    return float(max(1 - cdf(low), cdf(high)))


def bootstrap_ci(x: Sequence[float], statistic: Callable[[np.ndarray], float] = np.mean, n: int = 2000, level: float = 0.95, key: object = 0) -> tuple[float, float]:
    """Percentile interval; rows may be matrices (a ratio of columns, say)."""
    x, rng = np.asarray(x, float), seeded("bootstrap", key)
    draws = [statistic(x[rng.integers(0, len(x), len(x))]) for _ in range(n)]
    return tuple(np.quantile(draws, [(1 - level) / 2, (1 + level) / 2]))


def sign_flip_ps(x: np.ndarray, n: int, key: object) -> tuple[float, float]:
    """One-sided permutation p of a positive and of a negative sum under the same random signs: (hits + 1) / (n + 1)."""
    rng, seen, up, down = seeded("sign-flip", key), x.sum(), 0, 0
    for at in range(0, n, 256):
        signs = rng.integers(0, 2, (min(256, n - at), len(x))) * 2 - 1
        drawn = signs @ x
        up += int((drawn >= seen - 1e-12).sum())
        down += int((-drawn >= -seen - 1e-12).sum())
    return (up + 1) / (n + 1), (down + 1) / (n + 1)


def sign_flip_p(x: Sequence[float], n: int = 2000, key: object = 0) -> float:
    """One-sided permutation p of a positive sum under random signs."""
    return sign_flip_ps(np.asarray(x, float), n, key)[0]


#: Values of a bucket of keys, about: what a task tries at once.
BUCKET_VALUES = 100_000


def sign_flip(df: DataFrame, key: str, value: str, least: int = 10, n: int = 2000, cap: int = 5000) -> DataFrame:
    """Per key: n, total, z under random signs, and the Monte Carlo p that as much (p_up) or as little (p_down) comes by chance.

    p is null below `least` values and normal above `cap`, so a key of any size is only summed: no task holds more than cap
    values of a key. Values are sorted, so the order of rows does not matter. Keys are tried by buckets; rows are written once.
    """
    rows = cut(df.select(key, F.col(value).cast("double").alias("_x")))
    x = F.col("_x")
    sums = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.sqrt(F.sum(x * x)).alias("_sd")))

    def run(table: pa.Table) -> pa.Table:
        of, first = np.unique(table[key].to_numpy(), return_inverse=True)
        values = table["_x"].to_numpy()
        order = np.lexsort((values, first))
        parts = np.split(values[order], np.cumsum(np.bincount(first))[:-1])
        up, down = zip(*[sign_flip_ps(part, n, k) for k, part in zip(of, parts)])
        return pa.table({key: pa.array(of, table[key].type), "_up": up, "_down": down})

    buckets = max(1, -(-rows.count() // BUCKET_VALUES))
    tried = rows.join(sums.where(F.col("n").between(least, cap)).select(key), key, "left_semi").withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    kind = df.schema[key].dataType.simpleString()
    found = tried.repartition(min(buckets, 4_096), "_b").groupBy("_b").applyInArrow(run, f"`{key}` {kind}, _up double, _down double")
    z = F.coalesce(F.col("total") / F.nullif("_sd", F.lit(0.0)), F.lit(0.0))
    out = sums.withColumn("z", z).join(found, key, "left")
    tail = normal_sf_column(F.col("z"))
    p = lambda c, t: F.when(F.col("n") > cap, t).otherwise(F.col(c))
    return out.select(key, "n", "total", "z", p("_up", tail).alias("p_up"), p("_down", 1 - tail).alias("p_down"))


def within_group_shuffle(group: Sequence, x: Sequence[float], y: Sequence[float], n: int = 1000, key: object = 0) -> float:
    """p of corr(x, y) when y is permuted within groups."""
    group, x, y, rng = np.asarray(group), np.asarray(x, float), np.asarray(y, float), seeded("shuffle", key)
    seen = np.corrcoef(x, y)[0, 1]
    cells = [np.flatnonzero(group == g) for g in np.unique(group)]
    hits = 0
    for _ in range(n):
        z = y.copy()
        for cell in cells:
            z[cell] = y[rng.permutation(cell)]
        hits += np.corrcoef(x, z)[0, 1] >= seen - 1e-12
    return (hits + 1) / (n + 1)


def ols(X: np.ndarray, y: np.ndarray, cluster: Sequence | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and CR1 (or HC1) standard errors."""
    X, y = np.asarray(X, float), np.asarray(y, float)
    bread = np.linalg.pinv(X.T @ X)
    beta = bread @ X.T @ y
    e = y - X @ beta
    n, k = X.shape
    if cluster is None:
        meat, scale = (X * e[:, None]).T @ (X * e[:, None]), n / max(n - k, 1)
    else:
        _, at = np.unique(np.asarray(cluster), return_inverse=True)
        sums = np.zeros((at.max() + 1, k))
        np.add.at(sums, at, X * e[:, None])
        g = len(sums)
        meat, scale = sums.T @ sums, g / max(g - 1, 1) * (n - 1) / max(n - k, 1)
    return beta, np.sqrt(np.maximum(np.diag(scale * bread @ meat @ bread), 0))


def wild_cluster_p(X: np.ndarray, y: np.ndarray, cluster: Sequence, j: int, n: int = 999, key: object = 0) -> float:
    """Restricted wild-cluster bootstrap p of coefficient j = 0; all sign vectors if there are at most 12 clusters."""
    X, y = np.asarray(X, float), np.asarray(y, float)
    _, at = np.unique(np.asarray(cluster), return_inverse=True)
    g = at.max() + 1
    beta, se = ols(X, y, at)
    seen = abs(beta[j] / se[j]) if se[j] else np.inf
    rest = np.delete(X, j, axis=1)
    fitted = rest @ (np.linalg.pinv(rest) @ y)
    e = y - fitted
    if g <= 12:
        draws = [np.array(s, float) for s in itertools.product((-1, 1), repeat=g)]
    else:
        rng = seeded("wild", key)
        draws = [rng.integers(0, 2, g) * 2.0 - 1 for _ in range(n)]
    hits = 0
    for s in draws:
        b, v = ols(X, fitted + e * s[at], at)
        hits += (abs(b[j] / v[j]) if v[j] else np.inf) >= seen - 1e-12
    return hits / len(draws) if g <= 12 else (hits + 1) / (len(draws) + 1)


def demean(columns: np.ndarray, *groups: Sequence, rounds: int = 500, tol: float = 1e-11) -> np.ndarray:
    """Take out the means of each grouping in turn until nothing changes."""
    z = np.asarray(columns, float).copy()
    codes = [np.unique(np.asarray(g), return_inverse=True)[1] for g in groups]
    counts = [np.bincount(c)[:, None] for c in codes]
    for _ in range(rounds):
        before = z.copy()
        for c, n in zip(codes, counts, strict=True):
            sums = np.zeros((len(n), z.shape[1]))
            np.add.at(sums, c, z)
            z -= (sums / n)[c]
        if np.abs(z - before).max(initial=0) < tol:
            break
    return z


def twfe(y: Sequence[float], d: np.ndarray, unit: Sequence, period: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Two-way fixed effects: coefficients of the columns of d, errors clustered by unit."""
    d = np.asarray(d, float).reshape(len(y), -1)
    z = demean(np.column_stack([y, d]), unit, period)
    return ols(z[:, 1:], z[:, 0], unit)


def event_dummies(since: Sequence[float], window: Sequence[int], base: int = -1) -> np.ndarray:
    """A column for each event time but the base; nan (never treated) is 0 everywhere, times beyond go to the ends."""
    since, edges = np.asarray(since, float), sorted(window)
    inside = np.clip(since, edges[0], edges[-1])
    return np.column_stack([(inside == k).astype(float) for k in edges if k != base])


def wald(beta: np.ndarray, X: np.ndarray, residual: np.ndarray, cluster: Sequence) -> float:
    """Wald statistic that all coefficients are 0, with a clustered covariance."""
    bread = np.linalg.pinv(X.T @ X)
    _, at = np.unique(np.asarray(cluster), return_inverse=True)
    sums = np.zeros((at.max() + 1, X.shape[1]))
    np.add.at(sums, at, X * np.asarray(residual)[:, None])
    return float(beta @ np.linalg.pinv(bread @ sums.T @ sums @ bread) @ beta)


def group_time_att(y: Sequence[float], unit: Sequence, period: Sequence, start: Sequence[float], draws: int = 200, key: object = 0, controls: str = "never") -> dict:
    """Average effects by (start, period) against units never treated (or, controls="later", not yet), from the period before the start.

    Returns the table, the mean over treated cells (weighted by units) and a unit-cluster bootstrap error.
    """
    frame = pd.DataFrame({"y": y, "u": unit, "t": period, "g": start})

    def effects(wide: pd.DataFrame, first: pd.Series) -> list[tuple[float, int, float, int]]:
        out = []
        for g in sorted(first.dropna().unique()):
            mine, base = first[first == g].index, g - 1
            for t in wide.columns:
                if t < g or base not in wide.columns:
                    continue
                others = first[first.isna() | ((first > t) & (controls == "later"))].index
                a = (wide.loc[mine, t] - wide.loc[mine, base]).dropna()
                b = (wide.loc[others, t] - wide.loc[others, base]).dropna()
                if len(a) and len(b):
                    out.append((float(g), int(t), float(a.mean() - b.mean()), len(a)))
        return out

    wide, first = frame.pivot_table(index="u", columns="t", values="y"), frame.groupby("u")["g"].first()
    table = effects(wide, first)
    mean = lambda cells: float(np.average([c[2] for c in cells], weights=[c[3] for c in cells])) if cells else np.nan
    rng, means = seeded("att", key), []
    for _ in range(draws):
        pick = rng.choice(len(wide), len(wide))
        w, f = wide.iloc[pick].reset_index(drop=True), first.reindex(wide.index).iloc[pick].reset_index(drop=True)
        if (cells := effects(w, f)):
            means.append(mean(cells))
    return {"cells": table, "att": mean(table), "se": float(np.std(means, ddof=1)) if len(means) > 1 else np.nan}


def stacked(frame: pd.DataFrame, start: str, period: str, unit: str, before: int, after: int) -> pd.DataFrame:
    """One copy of the panel for each start, cut to its window, with units not treated in it as controls."""
    parts = []
    for g in sorted(frame[start].dropna().unique()):
        near = frame[(frame[period] >= g - before) & (frame[period] <= g + after)]
        kept = near[(near[start] == g) | near[start].isna() | (near[start] > g + after)]
        parts.append(kept.assign(stack=g, since=np.where(kept[start] == g, kept[period] - g, np.nan)))
    return pd.concat(parts, ignore_index=True) if parts else frame.iloc[:0]


def slope_test(x: Sequence[float], y: Sequence[float]) -> tuple[float, float]:
    """OLS slope and its two-sided normal p."""
    X = np.column_stack([np.ones(len(x)), x])
    beta, se = ols(X, np.asarray(y, float))
    return float(beta[1]), float(2 * (1 - normal_cdf(abs(beta[1] / se[1])))) if se[1] else 0.0
