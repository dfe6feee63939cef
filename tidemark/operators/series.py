"""Vector autoregressions by key: one ordered pass makes the lags, one aggregation the normal equations, one small solve a key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tails import beta_cdf


def lagged(df: DataFrame, key: str, time: str, columns: Sequence[str], lags: int) -> DataFrame:
    """key, time, the columns, and <column>_<lag> of `lags` consecutive times before; times that lack one of these are left out.

    Each row is sent to the times that look back at it, and meets them by (key, time): an aggregation instead of a window, so a
    key of any length is spread over its times. There must be one row for each key and time, of whole numbers.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("_l")
    sent = df.select(F.col(key), F.col(time).cast("long").alias("_t"), *columns, steps).withColumn(time, F.col("_t") + F.col("_l"))
    at = lambda c, k: F.max(F.when(F.col("_l") == k, F.col(c)))
    wide = sent.groupBy(key, time).agg(F.count(F.lit(1)).alias("_n"), *[at(c, 0).alias(c) for c in columns], *[at(c, k).alias(f"{c}_{k}") for c in columns for k in range(1, lags + 1)])
    return wide.where(F.col("_n") == lags + 1).drop("_n")


def normal_equations(rows: DataFrame, key: str, x: Sequence[str], y: Sequence[str]) -> DataFrame:
    """key, n, and sums of all products of (1, x, y), named g<i>_<j>: all that least squares of any y on any of x needs."""
    kept = rows.select(key, F.lit(1.0).alias("_v0"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate([*x, *y], 1)]).na.drop()
    k = 1 + len(x) + len(y)
    return kept.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)])


def f_tail(f: float, a: float, b: float) -> float:
    """P(F with a and b degrees of freedom exceeds f)."""
    return 1.0 if not f > 0 else float(beta_cdf(b / (b + a * f), b / 2, a / 2))


def granger(df: DataFrame, key: str, time: str, cause: str, effect: str, lags: int = 2) -> DataFrame:
    """key, n, f, p, r2: whether lags of `cause` help to foretell `effect` beyond its own lags (block F test), by key.

    Rows are only summed; a key's test is a solve of 2 lags + 1 unknowns on its sums. Columns that do not vary give null.
    """
    names = [f"{effect}_{k}" for k in range(1, lags + 1)] + [f"{cause}_{k}" for k in range(1, lags + 1)]
    sums = normal_equations(lagged(df, key, time, [effect, cause], lags), key, names, [effect])
    k = 2 + len(names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                g, n = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]), int(row["n"])
                whole = np.diag(1 / np.sqrt(np.maximum(np.diag(g), 1e-300)))  # unit columns: solves of a like scale
                g = whole @ g @ whole

                def left(use: list[int]) -> float:
                    b = np.linalg.lstsq(g[np.ix_(use, use)], g[use, -1], rcond=1e-12)[0]
                    return max(g[-1, -1] - 2 * b @ g[use, -1] + b @ g[np.ix_(use, use)] @ b, 0.0)

                free = n - k + 1
                full, own, none = left(list(range(k - 1))), left(list(range(1 + lags))), left([0])
                fine = free > 0 and full > 1e-12 and np.linalg.matrix_rank(g[:-1, :-1], tol=1e-9) == k - 1
                f = (own - full) / lags / (full / free) if fine else None
                out.append((row[key], n, f, f_tail(f, lags, free) if fine else None, 1 - full / none if fine and none > 1e-12 else None))
            yield pd.DataFrame(out, columns=[key, "n", "f", "p", "r2"]).astype({"f": float, "p": float, "r2": float})

    kind = df.schema[key].dataType.simpleString()
    found = sums.mapInPandas(solve, f"`{key}` {kind}, n bigint, f double, p double, r2 double")
    return found.select(key, "n", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("f", "p", "r2")])
