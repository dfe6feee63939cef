"""Reading tapes: file lists, drifting schemas, partitioned folders, dictionaries, JSON lines, samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every Parquet file below a folder; folder names are not read as columns."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)


def parquet_files(spark: SparkSession, files: Sequence[str], low: int = 0, high: int | None = None) -> DataFrame:
    """A slice of the sorted file names: the same chunk on every run."""
    return spark.read.parquet(*sorted(files)[low:high])


def parquet_drifting(spark: SparkSession, path: str) -> DataFrame:
    """Files whose columns differ: the union of their schemas, nulls where a file lacks one."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def parquet_partitioned(spark: SparkSession, root: str, partitions: bool = True) -> DataFrame:
    """A folder of key=value folders, with or without those keys as columns."""
    return spark.read.parquet(root) if partitions else parquet_tree(spark, root)


def union_layers(layers: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All layers by column name, padded with nulls, each row tagged with its layer."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(k)) for k, df in layers.items()])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of a schema, cast; what is missing becomes null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def dictionary_csv(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A key to value dictionary from CSV; keys stripped and lower-cased, the first of equal keys by value."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.groupBy(F.lower(F.trim(key)).alias(key)).agg(F.min(value).alias(value))


def json_pages(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Cached pages, one JSON object a line, with a declared schema; broken lines come out as nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def string_list(column: Column) -> Column:
    """A list that may be stored as a JSON string: '["a"]' and '' both parse, null stays null."""
    return F.when(F.trim(column) == "", F.array().cast("array<string>")).otherwise(F.from_json(column, "array<string>"))


def safe_double(column: Column) -> Column:
    """The number that a column holds, null where it holds none."""
    return column.try_cast("double")


def safe_bool(column: Column) -> Column:
    """'t', 'true', '1', 'yes' and their negatives in any case; else null."""
    low = F.lower(F.trim(column.cast("string")))
    return F.when(low.isin("t", "true", "1", "yes"), True).when(low.isin("f", "false", "0", "no"), False)


def seeded_sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows chosen by the md5 of a key and a seed: the same rows whatever the partitioning. Each task keeps n rows."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary")), key).limit(n)


def parameter_rows(spark: SparkSession, values: Sequence, name: str) -> DataFrame:
    """A bound list as rows, in no order, repeats kept."""
    return spark.sql(f"select explode(:given) as `{name}`", args={"given": F.array(*map(F.lit, values))})


def block_range(df: DataFrame, block: str, low: int, high: int) -> DataFrame:
    """Rows of a range of blocks: a plain comparison, which prunes row groups at the scan."""
    return df.where(F.col(block).between(low, high))


def canonical(tape: DataFrame, exchanges: Sequence[int], exchange: str = "builder") -> DataFrame:
    """Fills of the given exchanges at prices strictly between 0 and 100 cents, with shares."""
    return tape.where(F.col(exchange).isin(*exchanges) & (F.col("pc") > 0) & (F.col("pc") < 100) & (F.col("q") > 0))


def resolved(tape: DataFrame) -> DataFrame:
    """Fills at open prices in markets with a known winner."""
    return tape.where(F.col("winner").isNotNull() & F.col("pc").between(1, 99))


def token_rows(markets: DataFrame) -> DataFrame:
    """One row for each token of a market; a market without tokens keeps one row."""
    return markets.select("condition_id", F.posexplode_outer("tokens").alias("outcome_index", "token")).select("condition_id", "outcome_index", F.nullif("token", F.lit("")).alias("token_id"))


def holder_rows(pages: DataFrame) -> DataFrame:
    """Holders nested by token: array<struct<token, holders: array<struct<wallet, amount>>>>."""
    per = pages.select("condition_id", F.explode("tokens").alias("t"))
    return per.select("condition_id", "t.token", F.explode("t.holders").alias("h")).select("condition_id", "token", F.lower("h.wallet").alias("wallet"), F.col("h.amount").cast("double").alias("amount"))
