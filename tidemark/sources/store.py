"""The shared folder and intermediate tables in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset (tests, local mode)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI with its scheme: a path without one is of the default file system, as it is for Spark."""
    store, at = _file_system(spark, path)
    return store.makeQualified(at).toString()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the driver's JVM ends, even if the session ends earlier."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    store, at = _file_system(spark, path)
    store.deleteOnExit(at)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    store, at = _file_system(spark, path)
    store.delete(at, True)
    store.cancelDeleteOnExit(at)
    if (made := _MADE.get()) is not None and path in made:
        made.remove(path)


@contextmanager
def paths_made() -> Iterator[list[str]]:
    """A list that fills with the paths made inside the with statement and not yet deleted; what is left goes to an outer one."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)
        if (outer := _MADE.get()) is not None:
            outer += made


def written(df: DataFrame, name: str, codec: str | None = None) -> tuple[DataFrame, str]:
    """Cut the lineage: write a table in the shared folder and read it again. The path is for delete()."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a table written to the shared folder: the plan behind them is gone, and no executor holds them."""
    return written(df, "cut")[0]


def bucketed(df: DataFrame, key: str, n: int, name: str) -> tuple[DataFrame, str]:
    """written(), dealt into n buckets by a key: reads join and group by it without a shuffle. The catalog forgets the table at once."""
    path, table = new_path(df.sparkSession, name), f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    out = df.sparkSession.table(table)
    df.sparkSession.sql(f"drop table {table}")  # it lies at a path of its own, so its files stay
    return out, path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file anywhere Spark can write, put in place at once."""
    store, at = _file_system(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    out = store.create(draft, True)
    out.write(text.encode())
    out.close()
    store.delete(at, False)
    if not store.rename(draft, at):
        raise OSError(f"cannot put {path} in place")
