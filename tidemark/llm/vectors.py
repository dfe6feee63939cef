"""Near-duplicate embeddings by Euclidean p-stable hashing, confirmed by exact cosine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemark.llm.blocks import by_groups, dealt
from tidemark.llm.common import delete, integer_id, map_arrow, small_or_shuffled, written
from tidemark.llm.components import components

#: Tables, projections of a table, and the width of a projection's steps. At cosine 0.93 (distance 0.374) a pair meets
#: in some table with probability 0.97, at 0.95 with 0.995; unrelated unit vectors meet in one with 4e-5.
TABLES, HASHES, WIDTH, SEED = 32, 14, 2.0, 11
#: Members of a block: two blocks give a matrix of products of 32 MB.
BLOCK_ROWS = 2048
#: Buckets of up to so many members are compared together, pair by pair.
SMALL = 32


#: Fractional bits of a unit vector's components and of the directions, as whole numbers: sums of their products are exact in
#: any order, so a vector has the same codes wherever they are computed.
UNIT_BITS, DIRECTION_BITS = 20, 12


@lru_cache(maxsize=8)
def projections(dim: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gaussian directions (2-stable) and uniform offsets, as whole numbers, and odd multipliers that fold a table's steps into one."""
    rng = np.random.Generator(np.random.PCG64([SEED, dim]))
    directions = np.rint(rng.standard_normal((dim, tables * hashes)) * (1 << DIRECTION_BITS))
    offsets = np.rint(rng.uniform(0, width, tables * hashes) * (1 << UNIT_BITS + DIRECTION_BITS))
    fold = rng.integers(1, 1 << 62, tables * hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return directions, offsets, fold


def codes(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> np.ndarray:
    """One number for each row and table: equal where all quantised projections of the table are."""
    directions, offsets, fold = projections(unit.shape[1], tables, hashes, width)
    along = np.rint(unit * (1 << UNIT_BITS)) @ directions + offsets
    steps = np.floor(along / (width * (1 << UNIT_BITS + DIRECTION_BITS))).astype(np.int64).astype(np.uint64)
    folded = (steps * fold).reshape(len(unit), tables, hashes).sum(axis=2, dtype=np.uint64)
    return (folded ^ (folded >> np.uint64(29))).astype(np.int64)


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can be compared, and those over their lengths, in double precision; the same for a row in any company."""
    top = np.abs(x).max(axis=1, initial=0)
    fine = np.isfinite(x).all(axis=1) & (top > 0)
    x = x[fine] / top[fine, None]  # first by the largest component, so that squares neither vanish nor overflow
    return fine, x / np.sqrt((x * x).sum(axis=1))[:, None]


def _single(df: DataFrame) -> bool:
    kind = df.schema["v"].dataType
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)


def _packed(df: DataFrame) -> DataFrame:
    """vec_id, label, v (components as they are given, packed), key (of label and unit vector); the last two are null where the
    vector links with nothing."""
    kind = np.dtype("<f4" if _single(df) else "<f8")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors, n = batch.column(1), batch.num_rows
        sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
        places = np.concatenate([[0], np.cumsum(sizes)])
        values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        usable, packed, keys = batch.column(2).is_valid().to_numpy(zero_copy_only=False), [None] * n, [None] * n
        labels = batch.column(2).cast(pa.string()).to_pylist()
        for dim in set(sizes.tolist()) - {0}:
            at = np.flatnonzero((sizes == dim) & usable)
            x = values[places[at][:, None] + np.arange(dim)]
            fine, units = _units(x)
            for k, row, unit in zip(at[fine].tolist(), x[fine].astype(kind), units):
                packed[k] = row.tobytes()
                keys[k] = hashlib.sha256(f"{labels[k]}:".encode() + unit.tobytes()).digest()
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "label", "v", "key"])

    label = df.schema["label"].dataType.simpleString()
    return map_arrow(df, run, f"vec_id bigint, label {label}, v binary, key binary")


def _unpack(column: pa.Array | pa.ChunkedArray, single: bool) -> np.ndarray:
    """Unit vectors of packed rows of one length."""
    x = np.frombuffer(b"".join(column.to_pylist()), "<f4" if single else "<f8").reshape(len(column), -1)
    return _units(x.astype(np.float64))[1]


def _buckets(classes: DataFrame, tables: int, hashes: int, width: float, single: bool) -> DataFrame:
    """(rep, t, h): the bucket of each class in each table, as one number of label, length, table and code."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(v) for v in batch.column(2).to_pylist()])
        for size in set(sizes.tolist()):
            part = batch.take(pa.array(np.flatnonzero(sizes == size)))
            found = codes(_unpack(part.column(2), single), tables, hashes, width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * tables, pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(found), size)), lists], ["rep", "label", "dim", "codes"])

    coded = classes.select("rep", F.col("label").cast("string").alias("label"), "v").mapInArrow(lambda batches: (out for b in batches for out in run(b)), "rep bigint, label string, dim bigint, codes array<bigint>")
    met = coded.select("rep", "label", "dim", F.posexplode("codes").alias("t", "code"))
    return met.select("rep", "t", F.xxhash64("label", "dim", "t", "code").alias("h"))


def _pairs(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows (i < j) of the same group, for groups of a few rows."""
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    at, i, j = np.arange(n), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = 1
    while len(at := at[at + step < ends[at]]):
        i.append(at)
        j.append(at + step)
        step += 1
    return np.concatenate(i), np.concatenate(j)


def _block_links(threshold: float, tables: int, hashes: int, width: float, single: bool):
    """Counts and connections among the members of buckets, each pair in the first table where it meets."""

    def large(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        units = _unpack(group.column("v"), single)
        own = group.column("own").to_numpy()
        near = units @ units.T >= threshold
        np.fill_diagonal(near, False)
        if group.column("bi")[0].as_py() != group.column("bj")[0].as_py():
            near &= own[:, None] != own[None, :]
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            return
        near = near[np.ix_(some, some)]
        for code in codes(units[some], tables, hashes, width).T[: group.column("t")[0].as_py()]:  # in the tables before this one
            near &= code[:, None] != code[None, :]
        held = near.any(axis=1)
        some, near = some[held], near[np.ix_(held, held)]
        root = np.arange(len(some))
        while len(some):
            least = np.minimum(root, np.where(near, root[None, :], len(some)).min(axis=1))
            least = least[least]
            if (least == root).all():
                break
            root = least
        if len(some):
            yield ids[some], ids[some][root], near @ copies[some]

    def small(rows: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Many buckets of one vector length at once: a product for each pair."""
        i, j = _pairs(starts, len(rows))
        units = _unpack(rows.column("v"), single)
        near = np.concatenate([np.zeros(0, bool), *[np.einsum("ij,ij->i", units[i[k : k + 8192]], units[j[k : k + 8192]]) >= threshold for k in range(0, len(i), 8192)]])
        own, split = rows.column("own").to_numpy(), rows.column("bi").to_numpy() != rows.column("bj").to_numpy()
        near &= ~split[i] | (own[i] != own[j])
        i, j = i[near], j[near]
        if not len(i):
            return
        some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        found = codes(units[some], tables, hashes, width)
        same = found[at[: len(i)]] == found[at[len(i) :]]
        first = np.where(same.any(axis=1), same.argmax(axis=1), tables) >= rows.column("t").to_numpy()[i]
        i, j = i[first], j[first]
        ids, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        yield np.concatenate([ids[i], ids[j]]), np.concatenate([ids[j], ids[i]]), np.concatenate([copies[j], copies[i]])

    def run(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.r_[starts, len(rows)])
        parts = [part for k in np.flatnonzero(sizes > SMALL) for part in large(rows.slice(starts[k], sizes[k]))]
        few = np.repeat(sizes <= SMALL, sizes)
        if few.any():
            rest, kept = rows.filter(pa.array(few)), sizes[sizes <= SMALL]
            begin = np.cumsum(kept) - kept
            lengths = np.array([len(v) for v in rest.column("v").to_pylist()])
            for length in set(lengths.tolist()):  # a bucket's vectors are of one length
                mine = lengths == length
                of = kept[mine[begin]]
                parts += small(rest.filter(pa.array(mine)), np.cumsum(of) - of)
        for a, b, n in parts:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    return run


def near_vectors(
    df: DataFrame,
    threshold: float = 0.93,
    tables: int = TABLES,
    hashes: int = HASHES,
    width: float = WIDTH,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """Per row: vec_id, n_links (other rows with an equal label and cosine >= threshold), component_id, kept.

    Vectors are normalised in double precision. Equal vectors under one label become one class with a count, so
    copies are never paired. Classes whose codes agree in a table meet in its bucket; products confirm each pair, in
    the first table where it meets. Buckets of any size are dealt into blocks (blocks.py).

    Only narrow rows (class, table, bucket) are grouped to find shared buckets. Buckets of the same members, told by their
    number and two hashes of 64 bits, are one: the first of them is compared. Vectors go, as they were given, to these alone,
    and their codes are computed again where a pair is near. Ids must be
    integers. Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing
    (n_links 0, component_id = own id). Vectors of unlike length never link. A null id counts as unlinked too: null
    component_id, kept. Rows that share an id share a component. An empty table gives no rows.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(integer_id(df, id_column).alias("vec_id"), F.col(vector_column).alias("v"), F.col(label_column).alias("label"))
    packed = _packed(rows)
    single = _single(rows)
    linked = F.when(F.col("vec_id").isNotNull(), F.col("key"))
    keyed, _ = written(packed.select("vec_id", linked.alias("key")), "vector-keys")
    grouped = packed.where("key is not null and vec_id is not null").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.min("v").alias("v")
    )
    classes, _ = written(grouped, "vector-classes")
    met = _buckets(classes, tables, hashes, width, single)
    shared, shared_path = written(met.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    narrow, narrow_path = written(met.join(small_or_shuffled(shared), "h"), "bucket-members")
    sets = narrow.groupBy("h", "t", "m").agg(F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    firsts, firsts_path = written(sets.groupBy("m", "x", "y").agg(F.min(F.struct("t", "h")).alias("f")).select("f.h"), "first-buckets")
    members = narrow.join(small_or_shuffled(firsts), "h").join(classes.select("rep", "copies", "v"), "rep")
    blocks = dealt(members, "h", "rep", F.ceil(F.col("m") / BLOCK_ROWS)).select("h", "bi", "bj", "own", "t", "rep", "copies", "v")
    links, _ = written(by_groups(blocks, ["h", "bi", "bj"], _block_links(threshold, tables, hashes, width, single), "a bigint, b bigint, n bigint", n), "vector-links")
    for path in (shared_path, narrow_path, firsts_path):
        delete(spark, path)
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(links.select("a", "b")).withColumnRenamed("node", "rep")
    resolved = classes.select("key", "rep", "copies").join(counts, "rep", "left").join(joined, "rep", "left")
    resolved = resolved.select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    out = keyed.select("vec_id", "key").join(resolved, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
