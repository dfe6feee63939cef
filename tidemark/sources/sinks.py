"""Writing results: Parquet, partitioned and sorted, CSV, JSON reports, idempotent chunks, corpora that grow."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, TimestampNTZType, TimestampType

from tidemark.operators.primitives import dedup_first
from tidemark.sources.store import write_text


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_partitioned(df: DataFrame, path: str, key: str, order: Sequence[str], mode: str = "overwrite") -> None:
    """One folder for each key, files sorted inside; the key's column lives in the folder names."""
    df.repartition(key).sortWithinPartitions(key, *order).write.mode(mode).option("compression", "zstd").partitionBy(key).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with ISO-8601 UTC times and lists as JSON."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        elif isinstance(f.dataType, ArrayType):
            c = F.to_json(c)
        columns.append(c.alias(f.name))
    df.select(*columns).write.mode(mode).option("header", "true").csv(path)


def write_report(sections: dict[str, DataFrame], path: str, notes: Sequence[str] = (), rows: int = 10_000) -> None:
    """Small result tables as one JSON file, put in place at once. Larger tables are refused, not cut."""
    out: dict[str, object] = {"notes": list(notes)}
    for name, df in sections.items():
        found = df.limit(rows + 1).collect()
        if len(found) > rows:
            raise ValueError(f"{name} has more than {rows} rows; write it as a table")
        out[name] = [r.asDict(recursive=True) for r in found]
    write_text(next(iter(sections.values())).sparkSession, path, json.dumps(out, indent=1, default=str))


def write_bundle(groups: dict[str, DataFrame], root: str, title: str) -> DataFrame:
    """A folder for each group of rows, a manifest of them (a table, one row a group) and a README; gives the manifest.

    A group is read back to be counted, so the manifest says what is there.
    """
    spark, rows = next(iter(groups.values())).sparkSession, []
    for name, df in groups.items():
        write_parquet(df, f"{root}/{name}")
        found = spark.read.schema(df.schema).parquet(f"{root}/{name}")
        rows.append((name, found.count(), len(found.columns), df._jdf.schema().treeString()))
    manifest = spark.createDataFrame(rows, "name string, n_rows bigint, n_columns bigint, layout string")
    write_parquet(manifest.coalesce(1), f"{root}/manifest")
    write_text(spark, f"{root}/README.txt", "\n".join([title, "", *(f"{n}: {r} rows\n{layout}" for n, r, _, layout in rows)]))
    return spark.read.schema(manifest.schema).parquet(f"{root}/manifest")


def write_chunk(df: DataFrame, path: str) -> bool:
    """Write a chunk unless a finished one is there (its success mark, not the mere folder); whether it was written."""
    sc = df.sparkSession.sparkContext
    mark = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if mark.getFileSystem(sc._jsc.hadoopConfiguration()).exists(mark):
        return False
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return True


def write_buckets(spark: SparkSession, jobs: dict[int, DataFrame], root: str) -> list[int]:
    """One folder a bucket, each skipped if it is finished; the buckets that were written now."""
    return [k for k, df in jobs.items() if write_chunk(df, f"{root}/bucket-{k:05d}")]


def grown(corpus: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The corpus with fresh rows in place of old ones of equal keys."""
    return corpus.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def consolidated(parts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Part files as one table: one row for each coalesced key (empty strings count as missing)."""
    key = F.coalesce(*[F.nullif(F.col(k), F.lit("")) for k in keys])
    return dedup_first(parts.withColumn("_key", key), ["_key"], order).drop("_key")
