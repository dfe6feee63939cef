"""Synthetic controls: each treated unit against the mix of donors that was most like it before, and each donor as a placebo."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.primitives import small_side

#: Donors are columns of one Gram matrix, so they are few and named; treated units may be any number.
MOST_DONORS = 64


def simplex_weights(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """The w >= 0 with sum 1 that makes w'Gw - 2 w'c least: an active-set search, exact up to rounding."""
    n = len(cross)
    w, held = np.zeros(n), [int(np.argmin(np.diag(gram) - 2 * cross))]
    w[held[0]] = 1.0
    tol = 1e-10 * max(float(np.abs(gram).max()), float(np.abs(cross).max()), 1e-300)
    for _ in range(20 * n):
        while True:
            k = len(held)
            system = np.zeros((k + 1, k + 1))
            system[:k, :k], system[:k, k], system[k, :k] = gram[np.ix_(held, held)], 1.0, 1.0
            best = np.linalg.lstsq(system, np.append(cross[held], 1.0), rcond=1e-13)[0][:k]
            if (best > 0).all() or k == 1:
                break
            now = w[held]
            falling = best <= 0
            share = float(np.min(now[falling] / np.maximum(now[falling] - best[falling], 1e-300)))
            now = now + min(share, 1.0) * (best - now)
            now[np.argmin(np.where(falling, now, np.inf))] = 0.0
            w[held] = np.maximum(now, 0)
            held = [i for i, x in zip(held, now) if x > 0]
            w[[i for i in range(n) if i not in held]] = 0.0
        w[:] = 0.0
        w[held] = best / best.sum()
        slopes = gram @ w - cross
        slopes[held] = np.inf
        enter = int(np.argmin(slopes))
        if slopes[enter] >= float((gram @ w - cross)[held] @ w[held]) - tol:
            break
        held = [*held, enter]
    return w


def synthetic_control(panel: DataFrame, unit: str, period: str, y: str, treated: DataFrame, donors: Sequence[int | str]) -> DataFrame:
    """unit, start, placebo, pre, post, pre_rmse, post_rmse, gap, weights, rank, of: each treated unit, and each donor as if treated.

    panel: one row for each unit and period; treated: unit and start, the first period that counts as after. Weights (one a
    donor, in their order; a donor takes no part in its own control) make pre_rmse least; gap is the mean of y less the control's
    after the start. rank is the place of post_rmse / pre_rmse among the `of` placebos of the same start and the unit itself, 1
    for the largest. Periods in which a donor has no row are left out, and so are units with no period before or after.

    Rows of a unit meet one row of donors by period and are summed into two Gram matrices, before and after: the weights, errors
    and gaps all follow from these, so a solve has the size of the donors whatever the number of rows.
    """
    donors = list(donors)
    if not 2 <= len(donors) <= MOST_DONORS:
        raise ValueError(f"between 2 and {MOST_DONORS} donors")
    spark, k = panel.sparkSession, len(donors)
    rows = panel.select(F.col(unit).alias("unit"), F.col(period).alias("period"), F.col(y).cast("double").alias("y")).where("unit is not null and period is not null and y is not null")
    wide = rows.groupBy("period").agg(*[F.max(F.when(F.col("unit") == d, F.col("y"))).alias(f"_v{i}") for i, d in enumerate(donors)]).na.drop()
    given = treated.select(F.col(unit).alias("unit"), F.col("start"), F.lit(False).alias("placebo")).where("unit is not null and start is not null")
    kind = rows.schema["unit"].dataType.simpleString()
    names = spark.createDataFrame([(d,) for d in donors], f"unit {kind}")
    shadows = given.select("start").distinct().crossJoin(F.broadcast(names)).select("unit", "start", F.lit(True).alias("placebo"))  # MOST_DONORS at most
    cases = given.join(F.broadcast(names), "unit", "left_anti").unionByName(shadows)
    met = rows.join(small_side(cases), "unit").join(small_side(wide), "period").withColumnRenamed("y", f"_v{k}").withColumn(f"_v{k + 1}", F.lit(1.0)).withColumn("_after", F.col("period") >= F.col("start"))
    pairs = [(i, j) for i in range(k + 2) for j in range(i, k + 2)]
    part = lambda after, i, j: F.sum(F.when(F.col("_after") == after, F.col(f"_v{i}") * F.col(f"_v{j}")).otherwise(0.0)).alias(f"{'b' if after else 'a'}{i}_{j}")
    sums = met.groupBy("unit", "start", "placebo").agg(*[part(after, i, j) for after in (False, True) for i, j in pairs])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                a, b = (np.array([[row[f"{s}{min(i, j)}_{max(i, j)}"] for j in range(k + 2)] for i in range(k + 2)]) for s in "ab")
                pre, post = a[k + 1, k + 1], b[k + 1, k + 1]
                if not pre or not post:
                    continue
                use = [i for i, d in enumerate(donors) if not (row["placebo"] and d == row["unit"])]
                w = np.zeros(k + 2)
                w[use] = -simplex_weights(a[np.ix_(use, use)] / pre, a[use, k] / pre)
                w[k] = 1.0
                rmse = [float(np.sqrt(max(w @ g @ w, 0) / n)) for g, n in ((a, pre), (b, post))]
                out.append((row["unit"], row["start"], row["placebo"], int(pre), int(post), *rmse, float(w @ b[:, k + 1] / post), (-w[:k] + 0.0).tolist()))
            yield pd.DataFrame(out, columns=["unit", "start", "placebo", "pre", "post", "pre_rmse", "post_rmse", "gap", "weights"])

    fields = f"unit {kind}, start {cases.schema['start'].dataType.simpleString()}, placebo boolean, pre bigint, post bigint, pre_rmse double, post_rmse double, gap double, weights array<double>"
    found = sums.mapInPandas(solve, fields).withColumn("_ratio", F.col("post_rmse") / F.greatest("pre_rmse", F.lit(1e-12)))
    others = found.where("placebo").groupBy("start").agg(F.collect_list(F.struct("unit", "_ratio")).alias("_others"))  # MOST_DONORS at most, a start
    larger = F.size(F.filter("_others", lambda o: (o["_ratio"] > F.col("_ratio")) & (o["unit"] != F.col("unit"))))
    placed = found.join(small_side(others), "start", "left").withColumns({"rank": (F.coalesce(larger, F.lit(0)) + 1).cast("bigint"), "of": F.coalesce(F.size("_others"), F.lit(0)).cast("bigint")})
    return placed.withColumnRenamed("unit", unit).drop("_ratio", "_others")
