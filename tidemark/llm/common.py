"""Shared plumbing: table loading, names that do not clash, id lists, Arrow mapping."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from tidemark.sources.store import delete, new_path, paths_made, qualified, shared_dir, written

__all__ = ["delete", "new_path", "paths_made", "qualified", "shared_dir", "written"]

#: Arrow batches stay small because a single text can be long.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
#: Narrow rows that are sent to every executor, at most: some 4 MB there. More are joined by a shuffle.
BROADCAST_IDS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch for text-sized rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as set it apart from the columns of df in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def integer_id(df: DataFrame, column: str) -> Column:
    """The id column as a long; an error here, not in a task, if it holds something else."""
    kind = df.schema[column].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"{column} must hold integers, not {kind.simpleString()}")
    return F.col(column).cast("long")


def with_ids(df: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
    """The rows of df whose column is in ids (how: left_semi) or is not (left_anti).

    ids is a written table of one column of that name. It is counted: up to BROADCAST_IDS go to every executor, and df is
    not shuffled.
    """
    return df.join(small_or_shuffled(ids), column, how)


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it is counted to hold at most BROADCAST_IDS."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def columns_schema(df: DataFrame) -> str:
    """The DDL of a frame's columns."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch; fn may return None for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def fold(doc_id) -> int:
    """crc32 of the id as text, modulo 5; 0 marks held-out rows."""
    return zlib.crc32(str(doc_id).encode()) % 5


def fold_column(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)).cast("int")
