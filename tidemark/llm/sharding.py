"""Shards as runs of a Hilbert curve through several metadata columns, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType, Row

from tidemark.llm.common import delete, integer_id, paths_made, written
from tidemark.operators.primitives import global_running

#: Bits of a dimension's cell: 32 cells a dimension, so at most 31 cuts a dimension come to the driver.
BITS = 5
SHARDS = 40
ROW_BYTES = 16


def _let(name: str, value: str, body: str) -> str:
    """SQL that names a value, so that it is computed once however often the body uses it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hilbert_index(cells: Sequence[str], bits: int = BITS) -> Column:
    """The place of a cell on the Hilbert curve through a grid of 2**bits cells a side (Skilling 2004).

    cells: columns of whole numbers in 0 .. 2**bits - 1; bits times their number must stay under 63. Neighbours on the
    curve are neighbours in the grid.
    """
    n = len(cells)
    if not 0 < n * bits < 63:
        raise ValueError("the index must fit into 62 bits")
    axes = f"array({', '.join(f'cast(`{c}` as bigint)' for c in cells)})"
    steps = [(1 << b, k) for b in range(bits - 1, 0, -1) for k in range(n)]
    array = lambda items: f"array({', '.join(items)})"
    turned = "(x, s) -> transform(x, (v, k) -> case when x[s.i] & s.q <> 0 then if(k = 0, v ^ (s.q - 1), v) when k = 0 or k = s.i then v ^ ((x[0] ^ x[s.i]) & (s.q - 1)) else v end)"
    if steps:
        axes = f"aggregate({array(f'named_struct("q", {q}L, "i", {i})' for q, i in steps)}, {axes}, {turned})"
    gray = "transform(a, (v, k) -> aggregate(slice(a, 1, k + 1), 0L, (s, w) -> s ^ w))"
    flips = f"aggregate({array(f'{1 << b}L' for b in range(bits))}, 0L, (t, q) -> if(g[{n - 1}] & q <> 0, t ^ (q - 1), t))"
    order = array(f'named_struct("b", {b}, "i", {i})' for b in range(bits - 1, -1, -1) for i in range(n))
    woven = f"aggregate({order}, 0L, (h, s) -> h * 2 + (shiftright(g[s.i] ^ f, s.b) & 1))"
    return F.expr(_let("a", axes, _let("g", gray, _let("f", flips, woven))))


def _key(df: DataFrame, name: str, dimension: int) -> Column:
    """A column's value in a struct that sorts as the column does: whole numbers, fractions, anything else as text."""
    kind = df.schema[name].dataType
    c = F.col(name)
    whole, part = isinstance(kind, IntegralType), isinstance(kind, FractionalType)
    return F.struct(
        F.lit(dimension).alias("dimension"),
        (c if whole else F.lit(None)).cast("long").alias("whole"),
        (c if part else F.lit(None)).cast("double").alias("part"),
        (c if not whole and not part else F.lit(None)).cast("string").alias("text"),
    )


def _cuts(df: DataFrame, dims: Sequence[str], bits: int) -> list[list[Row]]:
    """For each dimension the least value of each of its cells, which hold about as many rows each.

    A value's cell is 2**bits times the share of rows with lesser values, rounded down, exactly: from counts of each
    value, summed up by ranges. At most 2**bits rows a dimension reach the driver.
    """
    keys = df.select(F.explode(F.array(*[_key(df, c, k) for k, c in enumerate(dims)])).alias("k"))
    counts = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k.*", "n")
    order = ["dimension", "whole", "part", "text"]
    upto = global_running(counts, order, {"upto": (F.col("n"), "sum")})
    total = df.count()
    cell = F.floor((F.col("upto") - F.col("n") - F.col("dimension") * total) * (1 << bits) / F.lit(max(total, 1)))
    least = upto.groupBy("dimension", cell.cast("int").alias("cell")).agg(F.min(F.struct("whole", "part", "text")).alias("v"))
    found: list[list[Row]] = [[] for _ in dims]
    for row in least.orderBy("dimension", "cell").collect():
        found[row.dimension].append(row)
    return found


def _cell(df: DataFrame, name: str, cuts: list[Row]) -> Column:
    """The last cell whose least value is not above the column's: a binary search written as nested conditions."""
    kind = df.schema[name].dataType
    field = "whole" if isinstance(kind, IntegralType) else "part" if isinstance(kind, FractionalType) else "text"
    value = F.col(name).cast({"whole": "long", "part": "double", "text": "string"}[field])

    def search(lo: int, hi: int) -> Column:
        if hi - lo <= 1:
            return F.lit(cuts[lo].cell if cuts else 0)
        middle = (lo + hi) // 2
        return F.when(value >= F.lit(cuts[middle].v[field]), search(middle, hi)).otherwise(search(lo, middle))

    return search(0, len(cuts))


def hilbert_shards(df: DataFrame, dims: Sequence[str], order: Sequence[str], shards: int = SHARDS, size: str | None = None, bits: int = BITS) -> DataFrame:
    """Rows of df as a struct `row`, with curve, shard (0 .. shards - 1) and slot (gapless from 0 in a shard).

    Each dimension is cut into 2**bits cells of about equal counts; a row's cells give its place on the Hilbert curve; rows
    are ordered by that place, then by `order`, and cut into runs. A run is a box-like region of all dimensions, so files
    written from it are pruned by a filter on any of them. With `size` None, runs hold equal counts, at most one apart; else
    equal sums of that column, to within a row.

    Rows are dealt by ranges of the curve and numbered range by range, so no task holds more than a range, and a hot value
    is split by the other dimensions and by `order`, which should be total: rows that tie in it are interchangeable. Give
    the columns to be carried and no others: they are shuffled once. Null values come first in a dimension; NaN last; sizes
    that are null count as 0. An empty table gives no rows.
    """
    spark = df.sparkSession
    outer = df.select(F.struct("*").alias("row"), *[F.col(f"`{c}`").alias(f"_d{k}") for k, c in enumerate(dims)], *[F.col(f"`{c}`").alias(f"_o{k}") for k, c in enumerate(order)], *([F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("_size")] if size else []))
    with paths_made() as made:
        cuts = _cuts(outer, [f"_d{k}" for k in range(len(dims))], bits)
        for path in list(made):
            delete(spark, path)
    cells = outer.withColumns({f"_c{k}": _cell(outer, f"_d{k}", cuts[k]) for k in range(len(dims))})
    placed = cells.withColumn("curve", hilbert_index([f"_c{k}" for k in range(len(dims))], bits))
    placed = placed.select("row", "curve", *[f"_o{k}" for k in range(len(order))], *(["_size"] if size else []))
    sums = {"_r": (F.lit(1).cast("long"), "sum")} | ({"_upto": (F.col("_size"), "sum")} if size else {})
    ranked = global_running(placed, ["curve", *[f"_o{k}" for k in range(len(order))]], sums)
    if not size:
        rows = f"cast({df.count()} as bigint)"
        shard = f"(_r - 1) * {shards} div greatest({rows}, 1)"
        return ranked.selectExpr("row", "curve", f"cast({shard} as int) as shard", f"_r - 1 - (({shard}) * {rows} + {shards - 1}) div {shards} as slot")
    total = int(outer.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0])
    shard = f"least((_upto * 2 - _size) * {shards} div {2 * max(total, 1)}, {shards - 1})"  # by the middle of a row's bytes
    held, _ = written(ranked.selectExpr("row", "curve", "_r", f"cast({shard} as int) as shard"), "shards")
    first = held.groupBy("shard").agg(F.min("_r").alias("_first"))  # one row a shard
    return held.join(F.broadcast(first), "shard").select("row", "curve", "shard", (F.col("_r") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, by_bytes: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes and ROW_BYTES), text_crc32, lang, source, curve, shard, slot.

    Dimensions are lang, source and size; rows tie by crc, size and id, so equal texts of one kind stand together. Only
    narrow columns are kept and dealt; texts are read once. Null texts count as empty. Repeated rows each get a slot.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    narrow, path = written(
        docs.select(integer_id(docs, id_column).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")),
        "sizes",
    )
    out = hilbert_shards(narrow, ["lang", "source", "size"], ["text_crc32", "size", "doc_id"], shards, "size" if by_bytes else None)
    return out.select("row.*", "curve", "shard", "slot")


def write_shards(df: DataFrame, folder: str, dims: Sequence[str], order: Sequence[str], shards: int = SHARDS, size: str | None = None) -> str:
    """Write whole rows as Parquet files under folder/shard=<k>, each file a run of the curve. Gives the folder.

    Ranges of the curve are written where they were numbered, so a shard of any size is as many files as ranges touch it,
    and statistics of each file bound every dimension. A column named shard is refused.
    """
    if "shard" in {c.lower() for c in df.columns}:
        raise ValueError("the rows have a column named shard already")
    placed = hilbert_shards(df, dims, order, shards, size).select("row.*", "shard", F.col("slot").alias("_slot"))
    placed.sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(folder)
    return folder
