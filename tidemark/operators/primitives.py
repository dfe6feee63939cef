"""Relational building blocks: dedup, as-of joins, band joins, top-k, intervals, weighted means, q-values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.store import cut


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom in double precision; null where bottom is 0."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


#: Rows of a table that is sent to every executor, at most.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table marked for broadcast if it is counted to be small; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; null where either side does not vary (corr() itself divides by zero there)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def slope(y: str, x: str) -> Column:
    """The least-squares slope of y on x over rows that have both; null where x does not vary."""
    both = F.when(F.col(y).isNotNull(), F.col(x))
    return F.covar_pop(y, x) / F.nullif(F.var_pop(both), F.lit(0.0))


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key: the first in `order`, which must be total for the survivor to be defined."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup_narrow(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """dedup_first with narrow state: the least order of each key is aggregated, and only rows that have it are kept.

    `order` must be total over all columns that differ within a key, so that what ties is alike; alike rows count once. Null
    keys and order values are compared as values.
    """
    least = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_least"))
    same = reduce(and_, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.struct(*[F.col(f"l.{c}") for c in order]).eqNullSafe(F.col("r._least"))])
    return df.alias("l").join(least.alias("r"), same, "left_semi").dropDuplicates(list(keys))


def merged_last(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], amount: str = "cents") -> DataFrame:
    """What must be kept of a part so that parts merge: the last value with its order, a count, a sum."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("last"), F.count(F.lit(1)).alias("n"), F.sum(amount).alias(amount))


#: Bins that a task of cleaned_map orders.
MAP_BINS = 20_000


def _with_edges(df: DataFrame, key: str, wide: int) -> tuple[DataFrame, Window]:
    """Rows with their chunk of MAP_BINS keys (_c) and, as copies, those that lie within `wide` of it (_own is false); chunks in order."""
    home = lambda c: F.floor(c / MAP_BINS)
    near = F.sequence(home(F.col(key) - wide), home(F.col(key) + wide))
    dealt = df.select("*", F.explode(near).alias("_c")).withColumn("_own", F.col("_c") == home(F.col(key)))
    return dealt, Window.partitionBy("_c").orderBy(key)


def cleaned_map(bins: DataFrame, key: str, value: str, most: float, rounds: int = 3, wide: int = 15, smooth: int = 2) -> DataFrame:
    """A value by consecutive bin: `rounds` times what is further than `most` from the rolling median is dropped, gaps are filled
    by straight lines (ends by the nearest), then a rolling median smooths and a running maximum makes it monotone.

    Bins are dealt into chunks with copies of what lies beside them, as wide as all rounds look together; known values nearest to a
    chunk and its maximum are carried from chunk to chunk.
    """
    ends = bins.agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a is not null")
    every = ends.select(F.explode(F.sequence(F.floor(F.col("a") / MAP_BINS), F.floor(F.col("b") / MAP_BINS))).alias("_k"), "a", "b")  # bins are made by many tasks
    every = every.repartition("_k").select(F.explode(F.sequence(F.greatest("a", F.col("_k") * MAP_BINS), F.least("b", F.col("_k") * MAP_BINS + MAP_BINS - 1))).alias(key))
    out, order = _with_edges(every.join(bins, key, "left"), key, rounds * wide)
    near = order.rowsBetween(-wide, wide)
    for _ in range(rounds):
        middle = F.when(F.count(value).over(near) >= 3, F.percentile(value, F.lit(0.5)).over(near))
        out = out.withColumn("_m", middle).withColumn(value, F.when(~F.coalesce(F.abs(F.col(value) - F.col("_m")) > most, F.lit(False)), F.col(value))).drop("_m")
    out = cut(out.where("_own").select(key, value).withColumn("_back", -F.col(key)))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(key).alias("k"), F.col(value).alias("v")))
    out = running(out, [], [key], MAP_BINS, last={"_lo": known})
    out = running(out, [], ["_back"], MAP_BINS, last={"_hi": known})
    line = F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * ratio(F.col(key) - F.col("_lo.k"), F.col("_hi.k") - F.col("_lo.k"))
    filled = F.coalesce(F.col(value), F.when(F.col("_lo").isNull(), F.col("_hi.v")).when(F.col("_hi").isNull(), F.col("_lo.v")).otherwise(line))
    out, order = _with_edges(out.select(key, filled.alias(value)), key, smooth)
    out = cut(out.withColumn(value, F.percentile(value, F.lit(0.5)).over(order.rowsBetween(-smooth, smooth))).where("_own").select(key, value))
    chunk = F.floor(F.col(key) / MAP_BINS)
    most_of = out.groupBy(chunk.alias("_c")).agg(F.max(value).alias("_top"))
    before = most_of.select("_c", F.max("_top").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)).alias("_top"))  # a row a chunk
    out = out.withColumn("_c", chunk).join(F.broadcast(before), "_c")
    upto = F.max(value).over(Window.partitionBy("_c").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(value, F.greatest(upto, "_top")).drop("_c", "_top")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank. Spark prunes each task to k rows a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).where(F.col(rank) <= k)


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


#: Rows of a range, about, where their number is known.
RANGE_ROWS = 500_000


def global_running(df: DataFrame, order: Sequence[str | Column], running: dict[str, tuple[Column, str]], rows: int = 0) -> DataFrame:
    """Running sums, minima or maxima over all rows in a total order, without bringing them into one task.

    Rows are dealt by ranges of the order and written; what runs within a range is combined with one row for each range
    before it. If `rows` of them are named, ranges grow in number, not in size.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    dealt = cut(df.withColumns({f"_{k}": c for k, (c, _) in running.items()}).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    ends = dealt.groupBy("_range").agg(*[_MERGE[how](f"_{k}").alias(f"_{k}") for k, (_, how) in running.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_range", *[_MERGE[how](f"_{k}").over(before).alias(f"_before_{k}") for k, (_, how) in running.items()])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({k: _MERGE[how](f"_{k}").over(within) for k, (_, how) in running.items()}).join(F.broadcast(carried), "_range")
    both = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    out = out.withColumns({k: both[how](F.col(k), F.col(f"_before_{k}")) for k, (_, how) in running.items()})
    return out.drop("_range", *[f"_{k}" for k in running], *[f"_before_{k}" for k in running])


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str = "row_number") -> DataFrame:
    """Row numbers over all rows in a total order, by ranges (global_running)."""
    return global_running(df, order, {name: (F.lit(1).cast("bigint"), "sum")})


def global_ntile(df: DataFrame, order: Sequence[str | Column], tiles: int, name: str = "tile") -> DataFrame:
    """ntile over all rows in a total order: the first (count mod tiles) tiles get one row more."""
    numbered = cut(global_row_number(df, order, "_k"))
    total = numbered.agg(F.count(F.lit(1)).alias("_total"))
    small, more, k = F.expr(f"_total div {tiles}"), F.col("_total") % tiles, F.col("_k") - 1
    large = more * (small + 1)
    place = F.when(k < large, F.floor(k / (small + 1))).otherwise(more + F.floor((k - large) / F.greatest(small, F.lit(1))))
    return numbered.crossJoin(F.broadcast(total)).withColumn(name, (place + 1).cast("bigint")).drop("_k", "_total")


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: int, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, before: dict[str, Column] | None = None
) -> DataFrame:
    """Running sums, last values that are not null, and the same without the row itself (before), by keys in a total order.

    The first column of the order is a whole number that is cut into chunks, so a key of any size is spread: a task holds a
    chunk of a key, and what earlier chunks leave is carried in from a table of one row for each.
    """
    sums, last, before = sums or {}, last or {}, before or {}
    values = {**last, **before}
    held = df.withColumn("_chunk", F.floor(F.col(order[0]) / chunk)).withColumns({f"_{k}": c for k, c in {**sums, **values}.items()})
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    inner = {k: F.sum(f"_{k}").over(upto) for k in sums} | {k: F.last(f"_{k}", ignorenulls=True).over(upto if k in last else prior) for k in values}
    newest = lambda k: F.max(F.when(F.col(f"_{k}").isNotNull(), F.struct(*order, F.col(f"_{k}").alias("_value"))))["_value"]
    ends = held.groupBy(*keys, "_chunk").agg(*[F.sum(f"_{k}").alias(k) for k in sums], *[newest(k).alias(k) for k in values])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_chunk", *[F.sum(k).over(earlier).alias(f"_in_{k}") for k in sums], *[F.last(k, ignorenulls=True).over(earlier).alias(f"_in_{k}") for k in values])
    out = held.withColumns(inner).join(carried, [*keys, "_chunk"])
    out = out.withColumns({k: F.col(k) + F.coalesce(F.col(f"_in_{k}"), F.lit(0)) for k in sums} | {k: F.coalesce(k, f"_in_{k}") for k in values})
    return out.drop("_chunk", *[f"{p}{k}" for k in {**sums, **values} for p in ("_", "_in_")])


def _merged(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Both sides in one table by key and time: no join, one shuffle by key."""
    names = [c for c in left.columns if c not in keys and c != "_t"]
    lhs = left.select(*keys, "_t", F.struct(*names).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast("bigint").alias("_vt"))
    rhs = right.select(*keys, "_t", F.lit(None).cast(lhs.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.col("_t").alias("_vt"))
    return lhs.unionByName(rhs)


#: Seconds of a chunk in as-of joins. A key's rows are spread over its chunks; a denser tape wants shorter ones.
CHUNK = 2_592_000


def _nearest(df: DataFrame, keys: Sequence[str], found: str, forward: bool, chunk: int) -> DataFrame:
    """Each left row with the nearest right row before it (forward: after it); at one time right rows count as met.

    Within a chunk of time the frame only grows, so n rows cost n steps; what lies beyond a chunk's edge is carried in from
    one row for each chunk. A busy key is spread over its chunks.
    """
    sign = -1 if forward else 1
    real = reduce(and_, [F.col(k).isNotNull() for k in keys], F.lit(True))
    near = F.when(F.col("_row").isNull() & real, F.struct((F.col("_t") * sign).alias("at"), F.col("_v").alias("v"), F.col("_vt").alias("vt")))
    held = df.withColumns({"_p": near, "_c": F.floor(F.col("_t") / chunk) * sign})
    w = Window.partitionBy(*keys, "_c").orderBy(F.col("_t") * sign, F.col("_row").isNotNull(), "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    ends = held.groupBy(*keys, "_c").agg(F.max("_p").alias("_e"))
    carried = ends.select(*keys, "_c", F.last("_e", ignorenulls=True).over(earlier).alias("_e"))
    out = held.withColumn("_p", F.last("_p", ignorenulls=True).over(w)).where("_row is not null").join(carried, [*keys, "_c"], "left")
    p = F.coalesce("_p", "_e")
    return out.select(*keys, "_row.*", p["v"].alias(found), p["vt"].alias(f"{found}_t"))


def asof_forward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str, shift: int = 0, found: str = "next", chunk: int = CHUNK) -> DataFrame:
    """Each left row with the value of the first right row at or after its time + shift (and that row's time).

    Left rows with a null key find nothing; among right rows of one time the largest value counts.
    """
    stream = _merged(left.withColumn("_t", F.col(left_time) + shift), right.withColumn("_t", F.col(right_time)), keys, value)
    return _nearest(stream, keys, found, True, chunk)


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str, shift: int = 0, found: str = "last", chunk: int = CHUNK) -> DataFrame:
    """Each left row with the value of the last right row at or before its time + shift (and that row's time)."""
    stream = _merged(left.withColumn("_t", F.col(left_time) + shift), right.withColumn("_t", F.col(right_time)), keys, value)
    return _nearest(stream, keys, found, False, chunk)


def interpolate(left: DataFrame, points: DataFrame, keys: Sequence[str], time: str, point_time: str, value: str) -> DataFrame:
    """Each left row with `value` between the points around its time, by straight line; the nearer end outside them."""
    back = asof_backward(left, points, keys, time, point_time, value, found="lo")
    both = asof_forward(back, points, keys, time, point_time, value, found="hi")
    rise = (F.col("hi") - F.col("lo")).cast("double") * (F.col(time) - F.col("lo_t"))  # multiplied before it is divided: halves stay halves
    line = F.col("lo") + ratio(rise, F.col("hi_t") - F.col("lo_t"))
    return both.withColumn("value", F.coalesce(line, F.col("lo").cast("double"), F.col("hi").cast("double")))


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, width: int) -> DataFrame:
    """Pairs with equal keys and |left_time - right_time| <= width, as an equi-join on time buckets.

    A left row looks into its bucket and both neighbours, so the join is by hash on (keys, bucket), and a busy key is
    spread over its buckets. Columns of the two sides must differ, but for the keys.
    """
    lhs = left.withColumn("_b", F.explode(F.array([F.floor(F.col(left_time) / width) + d for d in (-1, 0, 1)])))
    rhs = right.withColumn("_b", F.floor(F.col(right_time) / width))
    near = F.abs(F.col(left_time) - F.col(right_time)) <= width
    return lhs.join(rhs, [*keys, "_b"]).where(near).drop("_b")


def _islands(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """keys, low, high, _k: merged intervals, numbered in their order over all keys.

    A sweep: each interval adds one at its low end and takes one off after its high end; where the running sum leaves 0 an
    island begins, where it comes back one ends. The sum runs by ranges of (keys, place), so a key of any size is spread.
    """
    ends = F.array(F.struct(F.col(low).cast("long").alias("at"), F.lit(1).alias("d")), F.struct((F.col(high) + 1).cast("long").alias("at"), F.lit(-1).alias("d")))
    df = cut(df.select(*keys, low, high))  # counted and read
    n = -(-2 * df.count() // RANGE_ROWS)
    events = df.where(F.col(low).isNotNull() & F.col(high).isNotNull()).select(*keys, F.explode(ends).alias("_e"))
    if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        events = events.repartition(n, *keys, F.col("_e.at"))
    events = cut(events.groupBy(*keys, F.col("_e.at").alias("_at")).agg(F.sum("_e.d").alias("_d")).where("_d <> 0"))  # ranges are sampled: read, not made, twice
    swept = cut(global_running(events, [*keys, "_at"], {"_open": (F.col("_d"), "sum")}, events.count()).where("_open = 0 or _open = _d"))
    numbered = global_running(swept, [*keys, "_at"], {"_k": ((F.col("_open") > 0).cast("long"), "sum")}, swept.count())
    return numbered.groupBy(*keys, "_k").agg(F.min("_at").alias(low), (F.max("_at") - 1).alias(high))


def merged_intervals(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Closed integer intervals of a key, merged where they overlap or touch. Intervals with a null end are left out."""
    return _islands(df, keys, low, high).drop("_k")


def interval_gaps(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """What merged intervals of a key leave open between them."""
    found = cut(_islands(df, keys, low, high))
    later = found.select((F.col("_k") - 1).alias("_k"), *[F.col(k).alias(f"_next_{k}") for k in keys], F.col(low).alias("_n"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_next_{k}")) for k in keys], F.lit(True))
    return found.join(later, "_k").where(same).select(*keys, (F.col(high) + 1).alias("gap_low"), (F.col("_n") - 1).alias("gap_high"))


def bh_qvalues(df: DataFrame, p: str, tie: Sequence[str]) -> DataFrame:
    """Benjamini-Hochberg q-values over all rows: the least p * n / rank over this and all larger p, at most 1. By ranges."""
    ranked = cut(global_row_number(df, [p, *tie], "_r"))
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    q = F.col(p) * F.col("_n") / F.col("_r")
    down = global_running(ranked.crossJoin(F.broadcast(n)), [F.col("_r").desc()], {"q_value": (q, "min")})
    return down.withColumn("q_value", F.least("q_value", F.lit(1.0))).drop("_r", "_n")


def bh_counted(df: DataFrame, p: str, count: str) -> DataFrame:
    """p, q_value for each distinct p: bh_qvalues over rows that stand for `count` rows each. The last of a tie has its least value."""
    by_p = cut(df.groupBy(p).agg(F.sum(count).alias("_m")))
    ranked = cut(global_running(by_p, [p], {"_r": (F.col("_m"), "sum")}))
    n = ranked.agg(F.sum("_m").alias("_n"))
    q = F.col(p) * F.col("_n") / F.col("_r")
    down = global_running(ranked.crossJoin(F.broadcast(n)), [F.col("_r").desc()], {"q_value": (q, "min")})
    return down.select(p, F.least("q_value", F.lit(1.0)).alias("q_value"))


def average_ranks(df: DataFrame, columns: Sequence[str], ties: str = "average") -> DataFrame:
    """A column rank_<c> for each c: over all rows, ascending, ties sharing the mean place (or the first, if ties is "min").

    Places are counted over distinct values, by ranges; values then meet their places by an equi-join, in which few distinct
    values are broadcast, so that a value that most rows share stays where it is.
    """
    for c in columns:
        counts = global_running(df.groupBy(c).agg(F.count(F.lit(1)).alias("_m")), [c], {"_upto": (F.col("_m"), "sum")})
        first = F.col("_upto") - F.col("_m") + 1
        place = first + (F.col("_m") - 1) / 2.0 if ties == "average" else first.cast("double")
        df = df.join(small_side(cut(counts.select(c, place.alias(f"rank_{c}")))), c)
    return df


def counted_quantiles(df: DataFrame, keys: Sequence[str], value: str, asked: dict[str, float]) -> DataFrame:
    """keys, and a column for each quantile asked for, by straight line between neighbours; null values are left out.

    Each value of a key is counted first and places run over counted values by ranges, so no task holds a key's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m"))
    placed = cut(global_running(counts, [*keys, value], {"_upto": (F.col("_m"), "sum")}))
    sizes = placed.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_m")).alias("_base"), F.sum("_m").alias("_n"))
    sizes = sizes.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_base", "_n")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.lit(True))
    inside = placed.join(small_side(sizes), same)
    last = F.col("_upto") - F.col("_base") - 1
    first = last - F.col("_m") + 1

    def line(q: float) -> Column:
        at = (F.col("_n") - 1) * F.lit(q)
        low, high = (F.max(F.when(side(at).between(first, last), F.col(value))) for side in (F.floor, F.ceil))
        return low + (high - low) * F.max(at - F.floor(at))

    return inside.groupBy(*keys).agg(*[line(q).alias(name) for name, q in asked.items()])


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), ties: str = "average") -> DataFrame:
    """Rank correlation by keys, with average ranks for ties: rank + (ties - 1) / 2; or with the first place of ties ("min")."""
    if not keys:
        return average_ranks(df, [x, y], ties).agg(correlation(f"rank_{x}", f"rank_{y}").alias("rho"), F.count(F.lit(1)).alias("n"))

    def rank(c: str) -> Column:
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(c)) + ((F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2.0 if ties == "average" else 0)

    ranked = df.withColumns({"_x": rank(x), "_y": rank(y)})
    return ranked.groupBy(*keys).agg(correlation("_x", "_y").alias("rho"), F.count(F.lit(1)).alias("n"))


def ordered_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows in a fixed pseudo-random order: by md5 of the key and a seed."""
    return df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))).orderBy("_h", key).limit(n).drop("_h")
