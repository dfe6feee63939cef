"""Hard negatives by a distributed kNN join over Voronoi cells of anchors, with exact integer scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.blocks import by_group
from tidemark.llm.common import integer_id, map_arrow, small_or_shuffled, written

#: Rows in a fixed pseudo-random order whose scores give first bounds, and of these the most that serve as pivots. They
#: decide how much is compared, never what is found.
SAMPLE_ROWS, MOST_PIVOTS = 2048, 1024
#: Anchors of a block, candidates of a chunk (a task compares one with the other), and candidates that are scored at once.
BLOCK, CHUNK, TILE = 4096, 32_768, 1024
#: Squared lengths stay below 2**55, so that a score times 100 fits into 64 bits.
MOST_NORM = float(1 << 55)
NONE = np.iinfo(np.int64).min


def _whole(vectors: pa.Array, scale: float) -> tuple[list[bytes | None], np.ndarray]:
    """floor(scale * x) of each vector as 32-bit integers, and squared lengths; None where a vector takes no part."""
    sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    places = np.concatenate([[0], np.cumsum(sizes)])
    out: list[bytes | None] = [None] * len(vectors)
    norms = np.zeros(len(vectors))
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    for dim in set(sizes.tolist()) - {0}:
        at = np.flatnonzero((sizes == dim) & valid)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(values[places[at][:, None] + np.arange(dim)] * scale)
            norms[at] = (x * x).sum(axis=1)
        for k, row in zip(at.tolist(), x):
            if norms[k] < MOST_NORM:  # false for NaN too
                out[k] = row.astype("<i4").tobytes()
    return out, norms


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers. Floating point is exact while no sum can pass 2**53."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    x, y = a.astype(np.float64), b.astype(np.float64)
    if math.sqrt((x * x).sum(axis=1).max() * (y * y).sum(axis=1).max()) < 1 << 52:
        return (x @ y.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass(frozen=True)
class Cells:
    """Pivots by vector length. A cell's number is that length times 2**11, plus the place of its pivot from 1.

    Vectors are augmented by one component that gives all candidates the length `most`, and anchors none: then the nearest
    candidate is the one of the highest inner product, and distances to pivots obey the triangle inequality. Lengths
    without a pivot are a cell of their own, which is never pruned.
    """

    pivots: dict[int, np.ndarray]
    most: float  # the largest squared length

    def of_anchors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot."""
        dim = x.shape[1]
        p = self.pivots.get(dim)
        if p is None:
            return np.full(len(x), dim << 11), np.full(len(x), np.inf)
        d = self._distances(x, p, False)
        near = d.argmin(axis=1)
        return (dim << 11) + 1 + near, d[np.arange(len(x)), near]

    def _distances(self, x: np.ndarray, p: np.ndarray, candidates: bool) -> np.ndarray:
        x = x.astype(np.float64)
        own = np.full(len(x), self.most) if candidates else (x * x).sum(axis=1)
        return np.sqrt(np.maximum(own[:, None] + (p * p).sum(axis=1) - 2 * (x @ p.T), 0))

    def grouped(self, counts: dict[int, int], most: int) -> dict[int, int]:
        """Cell -> group: neighbouring cells share one while they hold `most` anchors at most; a larger cell is alone.

        Cells of one length are walked from pivot to nearest pivot. A candidate goes to a group once, however many of its
        cells it may serve.
        """
        out: dict[int, int] = {}
        group = -1
        for dim in sorted({c >> 11 for c in counts}):
            left = {c for c in counts if c >> 11 == dim}
            held, at = 0, min(left)
            group += 1
            while left:
                left.discard(at)
                if held and held + counts[at] > most:
                    group, held = group + 1, 0
                out[at], held = group, held + counts[at]
                if left:
                    p, rest = self.pivots[dim], sorted(left)
                    gap = ((p[np.array(rest) - (dim << 11) - 1] - p[at - (dim << 11) - 1]) ** 2).sum(axis=1)
                    at = rest[int(gap.argmin())]
        return out

    def served(self, x: np.ndarray, stats: dict[int, tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
        """(place of a candidate, cell) wherever the candidate could be among what an anchor of the cell asks for.

        stats by cell: the largest distance of an anchor to the pivot, the largest squared length of an anchor, and
        the least score that could still count. No score of the cell passes |pivot . c| + radius |c|, nor what the triangle
        inequality allows; a candidate whose bound is below the least score is not sent.
        """
        dim = x.shape[1]
        p = self.pivots.get(dim)
        cells = sorted(c for c in stats if c >> 11 == dim)
        if not cells:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if p is None:
            return np.arange(len(x)), np.full(len(x), cells[0])
        at = np.array(cells) - (dim << 11) - 1
        radius, long, least = np.array([stats[c] for c in cells]).T
        d = self._distances(x, p[at], True)
        y = x.astype(np.float64)
        gap = np.maximum(d - radius, 0)
        best = (long + self.most - gap * gap) / 2
        best = np.minimum(best, y @ p[at].T + radius * np.sqrt((y * y).sum(axis=1))[:, None])
        rows, which = np.nonzero(best + 1 + 1e-9 * (long + self.most) >= least)
        return rows, np.array(cells)[which]


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are among the first k of their row by score, then id; and the k-th score of each row that has k."""
    order = np.lexsort((ids, -score, row))
    sorted_rows = row[order]
    starts = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    return order[place < k], order[place == k - 1]


def _compare(group: pa.Table, k: int, positives: bool) -> Iterator[pa.RecordBatch]:
    """The first k candidates of the group for each query of its anchors: within its bounds, by score, then id."""
    is_anchor = group.column("queries").is_valid().to_numpy(zero_copy_only=False)
    anchors, others = group.filter(pa.array(is_anchor)), group.filter(pa.array(~is_anchor))
    if not len(anchors) or not len(others):
        return
    queries = anchors.column("queries").combine_chunks()
    asked = queries.value_lengths().to_numpy(zero_copy_only=False)
    flat = queries.flatten()
    low, high = (flat.field(f).to_numpy(zero_copy_only=False).copy() for f in ("low", "high"))
    of = np.repeat(np.arange(len(anchors)), asked)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(asked) - asked, asked)
    a, own, label = _matrix(anchors.column("q")), anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    number = anchors.column("aid").to_numpy()
    held = [np.zeros(0, np.int64)] * 3
    for at in range(0, len(others), TILE):
        part = others.slice(at, TILE)
        ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
        s = products(a, _matrix(part.column("q")))
        fit = own[:, None] != ids[None, :] if positives else label[:, None] != labels[None, :]
        found = [held]
        for t in range(int(asked.max())):
            mine = np.flatnonzero(turn == t)
            x = s[of[mine]]
            r, c = np.nonzero((x >= low[mine, None]) & (x <= high[mine, None]) & fit[of[mine]])
            found.append([mine[r], x[r, c], ids[c]])
        row, score, who = (np.concatenate(v) for v in zip(*found))
        keep, last = _best(row, score, who, k)
        low[row[last]] = np.maximum(low[row[last]], score[last])
        held = [row[keep], score[keep], who[keep]]
    row, score, who = held
    if len(row):
        yield pa.RecordBatch.from_arrays([pa.array(number[of[row]]), pa.array(turn[row].astype(np.int32)), pa.array(who), pa.array(score)], ["aid", "turn", "found", "score"])


@dataclass(frozen=True)
class Sample:
    """Rows whose scores are known everywhere: k-th scores among them bound k-th scores among all."""

    ids: np.ndarray
    labels: np.ndarray
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]]  # places and vectors

    def lows(self, x: np.ndarray, fits, k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each row of x the k-th score in low .. high among sample rows that fit; low where there are fewer."""
        at, y = self.by_dim.get(x.shape[1], (np.zeros(0, np.int64), x[:0]))
        s = products(x, y)
        s = np.where((s >= low[:, None]) & (s <= high[:, None]) & fits(self.ids[at], self.labels[at]), s, NONE)
        if s.shape[1] < k:
            return low
        return np.maximum(low, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])


QUERY = "array<struct<low: bigint, high: bigint>>"


def _query_array(low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> pa.Array:
    both = pa.StructArray.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["low", "high"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), both)


def _join(rows: DataFrame, anchors: DataFrame, cells: Cells, k: int, positives: bool) -> DataFrame:
    """(aid, turn, found, score): for each query of the anchors the first k rows. anchors: aid, vec_id, label, q, cell, radius,
    norm, queries; written. With `positives`, only rows of the anchor's label are compared, and groups are by label."""
    spark = rows.sparkSession
    keys = ["label", "group"] if positives else ["group"]
    summary = anchors.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("radius").alias("radius"), F.max("norm").alias("long"), F.min(F.array_min(F.transform("queries", lambda q: q["low"]))).cast("double").alias("least")
    )
    found = summary.collect()  # one row a pivot or length
    stats, group_of = {r.cell: (r.radius, r.long, r.least) for r in found}, cells.grouped({r.cell: r.n for r in found}, BLOCK)
    numbers = spark.createDataFrame(list(group_of.items()), "cell bigint, group bigint")
    anchors = anchors.join(F.broadcast(numbers), "cell")

    def served(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for at, x in _by_length(batch.column(2)):
            which, cell = cells.served(x, stats)
            pairs = np.unique(np.stack([at[which], np.array([group_of[c] for c in cell.tolist()], np.int64)]), axis=1)
            parts.append((pairs[0], pairs[1]))
        if not parts:
            return None
        which, group = (np.concatenate(v) for v in zip(*parts))
        taken = batch.take(pa.array(which))
        return pa.RecordBatch.from_arrays([*taken.columns, pa.array(group)], [*taken.schema.names, "group"])

    most = rows.groupBy("label").count().agg(F.max("count")) if positives else rows.agg(F.count(F.lit(1)))
    chunks = max(1, -(-int(most.first()[0] or 0) // CHUNK))
    groups, _ = written(anchors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("g")), "anchor-groups")
    sent = map_arrow(rows.select("vec_id", "label", "q"), served, "vec_id bigint, label bigint, q binary, group bigint")
    sent = sent.join(small_or_shuffled(groups), keys).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    sent = sent.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)))
    asking = anchors.join(small_or_shuffled(groups), keys).withColumn("block", F.pmod(F.xxhash64("aid"), F.col("g")))
    asking = asking.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    keys = [*keys, "block", "chunk"]
    names = list(dict.fromkeys(["vec_id", "label", "q", *keys]))
    both = asking.select(*names, "aid", "queries").union(sent.select(*names, F.lit(None).cast("long"), F.lit(None).cast(QUERY)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return by_group(both, keys, lambda g: _compare(g, k, positives), "aid bigint, turn int, found bigint, score bigint", n)


def _by_length(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of each length in a column of packed vectors."""
    sizes = np.array([len(v) for v in vectors.to_pylist()])
    return [(at, _matrix(vectors.take(pa.array(at)))) for s in set(sizes.tolist()) for at in [np.flatnonzero(sizes == s)]]


def _first(df: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    """The first k of each key by score, then id. Each task keeps k a key before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "found")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """For each anchor and each of its positives the first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x); scores are integer inner products, higher first, ties by smaller id. Positives
    of an anchor (a row where `anchor` holds) are its first `positives` other rows of its label; negatives are the first
    `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    Anchors are dealt to the nearest of some pivots (as many as the root of their number, MOST_PIVOTS at most). A row is sent to
    a cell's anchors only if its bound there reaches the least score that could count for one of them; scores with a bounded
    sample give that floor first. Small cells share a group and large ones are cut into blocks, and rows into chunks, so a
    task compares at most some BLOCK anchors with some CHUNK rows, and each keeps its first k. Results are exact whatever pivots and sample are.

    Rows with a null id or label, or with a vector that is null, empty, holds null or non-finite components, or whose squared
    length in whole numbers reaches 2**55, take no part. Vectors of unlike length never meet. Ids and labels must be
    integers. Rows that share an id are never each other's positives; each such anchor row gets its own results. A positive
    whose score is negative, or that has no row in its band, gives no row; nor does an empty table.
    """
    spark = df.sparkSession
    given = df.select(integer_id(df, id_column).alias("vec_id"), integer_id(df, label_column).alias("label"), F.col(vector_column).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed, norms = _whole(batch.column(2), scale)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(norms), batch.column(3)], ["vec_id", "label", "q", "norm", "anchor"])

    packed = map_arrow(given.where("vec_id is not null and label is not null and v is not null"), pack, "vec_id bigint, label bigint, q binary, norm double, anchor boolean")
    rows, _ = written(packed.where("q is not null"), "whole-vectors")
    counts = rows.agg(F.count_if("anchor").alias("anchors"), F.coalesce(F.max("norm"), F.lit(0.0)).alias("most")).first()
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "q").limit(SAMPLE_ROWS).select("vec_id", "label", "q").toArrow()
    by_length = _by_length(drawn.column("q").combine_chunks()) if len(drawn) else []
    sample = Sample(drawn.column("vec_id").to_numpy(), drawn.column("label").to_numpy(), {x.shape[1]: (at, x) for at, x in by_length})
    wanted = min(MOST_PIVOTS, math.isqrt(max(counts.anchors - 1, 0)) + 1)
    cells = Cells({x.shape[1]: x[:wanted].astype(np.float64) for _, x in by_length}, counts.most)

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, x in _by_length(batch.column(3)):
            part = batch.take(pa.array(at))
            own, label = part.column(1).to_numpy(), part.column(2).to_numpy()
            cell, radius = cells.of_anchors(x)
            top = np.full(len(x), -NONE - 1)
            floor = sample.lows(x, lambda ids, labels: (ids[None, :] != own[:, None]) & (labels[None, :] == label[:, None]), positives, np.full(len(x), NONE + 1), top)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(cell.astype(np.int64)), pa.array(radius), _query_array(floor, top, np.ones(len(x), np.int64))], [*part.schema.names, "cell", "radius", "queries"]
            )

    numbered = rows.where("anchor").select(F.monotonically_increasing_id().alias("aid"), "vec_id", "label", "q", "norm")
    placed = numbered.mapInArrow(lambda batches: (out for b in batches for out in place(b)), f"aid bigint, vec_id bigint, label bigint, q binary, norm double, cell bigint, radius double, queries {QUERY}")
    anchors, _ = written(placed, "anchors")
    near = _first(_join(rows, anchors, cells, positives, True), ["aid"], positives, "r")
    pairs, _ = written(near.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("r", "found", "score"))).alias("pairs")), "positives")

    def band(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, x in _by_length(batch.column(3)):
            part = batch.take(pa.array(at))
            label = part.column(2).to_numpy()
            lists = part.column(7)
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            score = lists.flatten().field("score").to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(x)), n)
            lo, hi = -((-low * score) // 100), high * score // 100
            floor = np.concatenate([sample.lows(x[of[k : k + TILE]], lambda ids, labels: labels[None, :] != label[of[k : k + TILE], None], negatives, lo[k : k + TILE], hi[k : k + TILE]) for k in range(0, len(of), TILE)])
            yield pa.RecordBatch.from_arrays([*part.columns, _query_array(floor, hi, n)], [*part.schema.names, "queries"])

    kinds = "aid bigint, vec_id bigint, label bigint, q binary, norm double, cell bigint, radius double, pairs array<struct<r: int, found: bigint, score: bigint>>"
    joined = anchors.drop("queries").join(pairs, "aid")
    banded = joined.mapInArrow(lambda batches: (out for b in batches for out in band(b)), f"{kinds}, queries {QUERY}")
    asking, _ = written(banded, "bands")
    found = _first(_join(rows, asking, cells, negatives, False), ["aid", "turn"], negatives, "rank")
    named = asking.select("aid", F.col("vec_id").alias("anchor_id"), F.posexplode("pairs").alias("turn", "p"))
    return found.join(named, ["aid", "turn"]).select(
        "anchor_id", F.col("p.found").alias("positive_id"), "rank", F.col("found").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score")
    )
