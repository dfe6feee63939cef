"""Clustering of times and changes of level, by key: an exponential-kernel Hawkes process fitted by EM, Bayesian change points."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.primitives import BROADCAST_ROWS, ratio
from tidemark.sources.store import delete, written

#: A chunk is so many decay times long, and what it leaves is carried to so many chunks after it. Later ones get less than
#: exp(-SPAN * REACH) of it, far below what a double can tell beside a base rate.
SPAN, REACH = 40, 5


def excitation(rows: DataFrame, key: str, t: str, m: str, decay: str) -> DataFrame:
    """Each row with near = sum of m exp(-decay (t - t')) over earlier times t' of its key, and lag = the same weighted by t - t'.

    One row for each (key, t); `decay` is one positive value a key. The sums are an associative scan: prefix sums within a chunk
    of SPAN / decay, and one row for each chunk carried to the REACH after it. A key of any size is spread over its chunks.
    """
    return _scanned(rows.withColumn("_c", _chunk(F.col(t), F.col(decay))), key, t, m, decay)


def _chunk(t: Column, decay: Column) -> Column:
    return F.floor(t * decay / SPAN)


def _scanned(rows: DataFrame, key: str, t: str, m: str, decay: str) -> DataFrame:
    """excitation() of rows that know their chunk _c."""
    held = rows.withColumn("_u", F.col(t) - F.col("_c") * SPAN / F.col(decay))
    grown = F.col(m) * F.exp(F.col(decay) * F.col("_u"))
    held = held.withColumns({"_s": grown, "_w": grown * F.col("_u")})
    before = Window.partitionBy(key, "_c").orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    inner = held.withColumns({c: F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("_s", "_w")})
    ends = held.groupBy(key, "_c").agg(F.sum("_s").alias("_s"), F.sum("_w").alias("_w"), F.first(decay).alias("_d"))
    sent = ends.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(REACH))))
    fall, gap = F.exp(-SPAN * F.col("_k")), SPAN * F.col("_k") / F.col("_d")
    carried = sent.groupBy(key, (F.col("_c") + F.col("_k")).alias("_c")).agg(F.sum(F.col("_s") * fall).alias("_r"), F.sum((gap * F.col("_s") - F.col("_w")) * fall).alias("_rw"))
    out = inner.join(carried, [key, "_c"], "left").na.fill(0.0, ["_r", "_rw"])
    shrink, u = F.exp(-F.col(decay) * F.col("_u")), F.col("_u")
    near, lag = shrink * (F.col("_s") + F.col("_r")), shrink * (u * (F.col("_s") + F.col("_r")) - F.col("_w") + F.col("_rw"))
    return out.withColumns({"near": near, "lag": F.greatest(lag, F.lit(0.0))}).drop("_c", "_u", "_s", "_w", "_r", "_rw")


def hawkes(df: DataFrame, key: str, time: str, steps: int = 30, start: tuple[float, float] = (0.5, 10.0)) -> DataFrame:
    """key, n, base, branching, decay, loglik: rate(t) = base + branching * decay * sum over earlier t' of exp(-decay (t - t')).

    Fitted by `steps` rounds of EM, all keys at once; loglik is that of the rates before the last round. Times are whole numbers;
    rows at one time of a key count together and do not excite each other. The process is seen from a key's first time to its
    last; keys seen at one time only are left out, as are null keys and times. It starts at a branching of start[0] and a
    decay of start[1] mean rates. A round reads a row for each (key, time) and writes a row for each key.
    """
    spark = df.sparkSession
    times = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, F.col(time).cast("long").alias("_t")).agg(F.count(F.lit(1)).alias("_m"))
    rows, kept = written(times, "times")
    ends = rows.groupBy(key).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.sum("_m").alias("n")).where("_lo < _hi")
    rate = F.col("n") / (F.col("_hi") - F.col("_lo"))
    fit, path = written(ends.withColumns({"base": rate * (1 - start[0]), "branching": F.lit(start[0]), "decay": rate * start[1], "loglik": F.lit(None).cast("double")}), "hawkes")
    for _ in range(steps):
        fit, old = written(_em(rows, fit, key), "hawkes"), path
        fit, path = fit
        delete(spark, old)
    delete(spark, kept)
    return fit.drop("_lo", "_hi")


def _em(rows: DataFrame, fit: DataFrame, key: str) -> DataFrame:
    """A round of EM. Rows are dealt by chunk once a round, as times and counts: what is computed of them stays where they lie."""
    of = fit.drop("n", "loglik")
    few = of.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    of = F.broadcast(of) if few else of
    x = (F.col("_t") - F.col("_lo")).cast("double")
    at = rows.join(of, key).withColumn("_c", _chunk(x, F.col("decay")))
    dealt = at.select(key, "_t", "_m", "_c").repartition(key, "_c").join(of, key) if few else at.repartition(key, "_c")
    seen = _scanned(dealt.withColumn("_x", x), key, "_x", "_m", "decay")
    left = F.col("_hi") - F.col("_t")
    pull = F.col("branching") * F.col("decay")
    lam = F.col("base") + pull * F.col("near")
    gone = F.exp(-F.col("decay") * left)
    sums = seen.groupBy(key).agg(
        F.sum(F.col("_m") * F.col("base") / lam).alias("_own"), F.sum(F.col("_m") * pull * F.col("near") / lam).alias("_led"), F.sum(F.col("_m") * pull * F.col("lag") / lam).alias("_wait"),
        F.sum(F.col("_m") * (1 - gone)).alias("_past"), F.sum(F.col("_m") * left * gone).alias("_edge"), F.sum(F.col("_m") * F.log(lam)).alias("_log"),
    )
    span = F.col("_hi") - F.col("_lo")
    next_decay = ratio(F.col("_led"), F.col("_wait") + F.col("branching") * F.col("_edge"))
    loglik = F.col("_log") - F.col("base") * span - F.col("branching") * F.col("_past")
    return fit.drop("loglik").join(sums, key).select(
        key, "_lo", "_hi", "n", (F.col("_own") / span).alias("base"), F.coalesce(ratio(F.col("_led"), F.col("_past")), F.lit(0.0)).alias("branching"),
        F.when(next_decay > 0, next_decay).otherwise(F.col("decay")).alias("decay"), loglik.alias("loglik"),
    )


_STATE = ("run", "logp", "mean", "shape", "rate")


def change_points(
    df: DataFrame, key: str, time: str, value: str, hazard: float = 0.01, prior: tuple[float, float, float, float] = (0.0, 1.0, 1.0, 1.0), recent: int = 3, chunk: int = 1024, prune: float = 1e-12
) -> DataFrame:
    """key, time, run, mean_run, recent, dropped: what is believed, after each row, of the number of rows since the level changed.

    Adams and MacKay's recursion: levels are normal with unknown mean and variance (prior: mean, weight, shape, rate of a
    normal-inverse-gamma), and a change comes before a row with probability `hazard`. run is the most probable length (the least,
    of equal ones), mean_run its mean, recent the probability of at most `recent` rows, dropped the mass of lengths below `prune`
    left out so far, which bounds the error of each probability. One row for each key and whole-numbered time; nulls and values
    that are not finite are left out.

    Time is cut into chunks of `chunk`; a round reads one chunk and carries one row of state for each key to the next, so a task
    holds no more than a chunk of a key and its state whatever the length of the series.
    """
    spark = df.sparkSession
    fine = F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < float("inf"))
    rows, kept = written(df.where(fine).select(F.col(key), F.col(time).cast("long").alias("_t"), F.col(value).cast("double").alias("_y")), "series")
    kind = df.schema[key].dataType.simpleString()
    fields = f"`{key}` {kind}, _t bigint, run bigint, mean_run double, recent double, dropped double, state struct<{', '.join(f'{c}: array<double>' for c in _STATE)}>"
    step = _step(key, hazard, prior, recent, prune)
    low, high = rows.agg(F.min(F.floor(F.col("_t") / chunk)), F.max(F.floor(F.col("_t") / chunk))).first()
    state, parts = spark.createDataFrame([], fields), []
    for c in range(low, high + 1) if low is not None else ():
        now = rows.where((F.col("_t") >= c * chunk) & (F.col("_t") < (c + 1) * chunk))
        out, path = written(state.groupBy(key).cogroup(now.groupBy(key)).applyInPandas(step, fields), "beliefs")
        state = out.where("state is not null")
        parts.append(path)
    delete(spark, kept)
    found = spark.read.schema(fields).parquet(*parts) if parts else spark.createDataFrame([], fields)
    return found.where("state is null").select(key, F.col("_t").alias(time), "run", "mean_run", "recent", "dropped")


def _step(key: str, hazard: float, prior: Sequence[float], recent: int, prune: float):
    mean0, weight0, shape0, rate0 = prior

    def step(old: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        name = (old if len(old) else now)[key].iloc[0]
        if len(old):
            run, logp, mean, shape, rate = (np.asarray(old["state"].iloc[0][c], dtype=float) for c in _STATE)
            dropped = float(old["dropped"].iloc[0])
        else:
            run, logp, mean, shape, rate, dropped = np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), 0.0
        out = []
        for t, y in now.sort_values("_t")[["_t", "_y"]].itertuples(index=False):
            # a change before this row: a run of none, met from the prior
            grown = np.log1p(-hazard) + logp
            run, logp = np.append(run, 0.0), np.append(grown, np.log(hazard) if len(grown) else 0.0)
            mean, shape, rate = np.append(mean, mean0), np.append(shape, shape0), np.append(rate, rate0)
            weight = weight0 + run
            scale2 = rate * (weight + 1) / (shape * weight)
            z2 = (y - mean) ** 2 / scale2
            logp = logp + _gap(shape) - 0.5 * np.log(2 * np.pi * shape * scale2) - (shape + 0.5) * np.log1p(z2 / (2 * shape))
            rate = rate + weight * (y - mean) ** 2 / (2 * (weight + 1))
            mean, shape, run = (weight * mean + y) / (weight + 1), shape + 0.5, run + 1
            p = np.exp(logp - logp.max())
            p /= p.sum()
            keep = p >= prune
            dropped += (1 - dropped) * float(p[~keep].sum())
            run, mean, shape, rate, p = run[keep], mean[keep], shape[keep], rate[keep], p[keep] / p[keep].sum()
            logp = np.log(p)
            out.append((name, t, int(run[p == p.max()].min()), float(p @ run), float(p[run <= recent].sum()), dropped, None))
        out.append((name, None, None, None, None, dropped, dict(zip(_STATE, (x.tolist() for x in (run, logp, mean, shape, rate))))))
        frame = pd.DataFrame(out, columns=[key, "_t", "run", "mean_run", "recent", "dropped", "state"])
        return frame.astype({"_t": "Int64", "run": "Int64", "mean_run": float, "recent": float, "dropped": float})

    return step


def _gap(shape: np.ndarray) -> np.ndarray:
    """log gamma(shape + 1/2) - log gamma(shape)."""
    return np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in shape])
