"""Comparing the members of groups of any size in bounded tasks.

A group of up to `cap` members is one block. A larger one is dealt into g blocks by hash, and each pair of blocks
becomes a group of its own, so no task holds more than two blocks and every pair of members still meets exactly once.

Where only components are asked for, members of a large group are first compared with one central member. Those near it are
joined through it and need not meet each other; what is left over meets all (around_centres, dealt_apart).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns_schema, small_or_shuffled, written

#: About so many members of a large group are looked at to choose its centre. Any centre gives the same components.
CENTRE_SAMPLE = 64


def dealt(df: DataFrame, key: str, member: str, blocks: Column) -> DataFrame:
    """Rows of df with bi, bj (the pair of blocks they serve) and own (the block they are of). blocks: g of the key."""
    own = F.pmod(F.xxhash64(member), F.col("g"))
    rows = df.withColumn("g", blocks.cast("int")).withColumn("own", own.cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")
    return (
        rows.select("*", other)
        .withColumn("bi", F.least("own", "other"))
        .withColumn("bj", F.greatest("own", "other"))
        .drop("g", "other")
    )


def by_group(
    df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch] | None], schema: str, partitions: int
) -> DataFrame:
    """Call fn on the rows of each group. Groups are streamed from sorted partitions: no start-up cost per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(c[a] for c in columns)
                if held and key != last:
                    yield from fn(pa.Table.from_batches(held)) or ()
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from fn(pa.Table.from_batches(held)) or ()

    return df.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def by_groups(
    df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, partitions: int, rows: int = 4096
) -> DataFrame:
    """by_group for many small groups: fn gets the rows of several whole groups, some `rows` of them, and where each group begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            table = pa.Table.from_batches(held).combine_chunks()
            change = np.zeros(max(n - 1, 0), bool)
            for k in keys:
                c = table.column(k).to_numpy()
                change |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            whole = n if last else int(starts[-1])
            if whole:
                yield from fn(table.slice(0, whole), starts[starts < whole])
            held = table.slice(whole).to_batches()
            n -= whole

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                if n >= rows:
                    yield from cut(False)
        if n:
            yield from cut(True)

    return df.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def around_centres(
    df: DataFrame,
    key: str,
    member: str,
    central: Callable[[pa.Table], int],
    near_of: Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]],
    partitions: int,
) -> tuple[DataFrame, list[str]]:
    """df (key, member: longs; m, the key's rows; g, its blocks; sig and more) with centre: the key's central member if the
    row is near it, else null. As a written table, and the paths to delete once it has served.

    A row travels once, to one of its key's g blocks; the centre's row goes to each of them. central gives the place of the
    centre among a sample of a key's rows (member, sig); near_of is that of spanning_links for a table of rows.
    """
    chosen = F.pmod(F.xxhash64(member, F.lit(key)), F.ceil(F.col("m") / CENTRE_SAMPLE)) == 0

    def centre(group: pa.Table) -> Iterator[pa.RecordBatch]:
        at = central(group)
        yield pa.RecordBatch.from_arrays([pa.array([group.column(c)[at].as_py()], pa.int64()) for c in (key, member)], [key, "centre"])

    sample = df.where(chosen).select(key, member, "sig")
    centres, centres_path = written(by_group(sample, [key], centre, f"{key} bigint, centre bigint", partitions), "centres")
    hubs = df.join(small_or_shuffled(centres), key).where(F.col(member) == F.col("centre")).drop("centre")
    hubs = hubs.withColumns({"own": F.explode(F.sequence(F.lit(0), F.col("g").cast("int") - 1)), "hub": F.lit(True)})
    rows = df.withColumns({"own": F.pmod(F.xxhash64(member), F.col("g")).cast("int"), "hub": F.lit(False)})

    columns = df.columns

    def mark(group: pa.Table) -> Iterator[pa.RecordBatch]:
        hub = group.column("hub").to_numpy()
        at, js = np.flatnonzero(hub), np.flatnonzero(~hub)
        found = pa.nulls(len(js), pa.int64())
        if len(at):
            name = group.column(member)[int(at[0])].as_py()
            found = pc.if_else(pa.array(near_of(group)(int(at[0]), js)), pa.scalar(name, pa.int64()), found)
        yield from group.select(columns).take(pa.array(js)).append_column("centre", found).to_batches()

    marked = by_group(rows.unionByName(hubs), [key, "own"], mark, f"{columns_schema(df)}, centre bigint", partitions)
    marked, marked_path = written(marked, "marked")
    return marked, [centres_path, marked_path]


def dealt_apart(marked: DataFrame, key: str, member: str, blocks: Callable[[Column], Column]) -> DataFrame:
    """dealt for the rows of around_centres, with joined: whether a row is near its centre. Blocks of such rows meet only blocks
    of the others, so a group whose members are all near its centre gives no rows.

    blocks: how many blocks the rows that meet a condition need, as an aggregate; 0 if there are none.
    """
    alone = F.col("centre").isNull()
    sizes, _ = written(marked.groupBy(key).agg(blocks(alone).cast("int").alias("gu"), blocks(~alone).cast("int").alias("ga")).where("gu > 0"), "sizes")
    rows = marked.join(small_or_shuffled(sizes), key).withColumn("joined", ~alone)
    place = F.xxhash64(member)
    own = F.when(alone, F.pmod(place, F.col("gu"))).otherwise(F.col("gu") + F.pmod(place, F.greatest("ga", F.lit(1))))
    last = F.when(alone, F.col("gu") + F.col("ga")).otherwise(F.col("gu")) - 1
    rows = rows.withColumns({"own": own.cast("int"), "other": F.explode(F.sequence(F.lit(0), last))})
    return rows.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}).drop("gu", "ga", "other", "centre")


def spanning_links(
    n: int, order: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], block: np.ndarray | None = None, joined: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links that join what is near, without comparing members that are joined already.

    Takes members in `order` and compares each with those not yet joined to it; near(i, js) says which of js are
    near i. Pairs inside one block are left out if block is given, but for the first member's. Members marked in `joined`
    are in one component already.
    Every pair that is not compared lies in one component, so the components are those of all near pairs.
    """
    group, links, place = np.arange(n), [], np.empty(n, np.int64)
    place[order] = np.arange(n)
    if joined is not None and joined.any():
        group[joined] = group[joined][0]
    for k, i in enumerate(order):
        open_ = (group != group[i]) & (place > k)
        if block is not None and k:
            open_ &= block != block[i]
        js = np.flatnonzero(open_)
        if not len(js):
            if k == 0 or (group == group[i]).all():
                break
            continue
        found = js[near(int(i), js)]
        if len(found):
            links += [(int(i), int(j)) for j in found]
            group[np.isin(group, group[found])] = group[i]
    return links
