"""Canonical tapes over the synthetic tables. All amounts are integers: prices in cents, shares whole, fees in millionths.

Integer amounts make every sum exact whatever the order of addition, which raw on-chain amounts are as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.primitives import dedup_first
from tidemark.sources.store import cut

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
#: A total order over a fill's columns, so that one survivor of a repeated key is defined.
FILL_ORDER = ["sec", "maker", "taker", "token_id", "pc", "q", "side", "is_taker", "fee_paying"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where a tape is dealt out: at most, and on small tapes as long as there are shuffle partitions.
TASK_ROWS, SMALL_TASK_ROWS = 200_000, 25_000


def task_count(spark: SparkSession, rows: int) -> int:
    """Partitions that grow with the rows, so that what a task sorts and holds does not."""
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SMALL_TASK_ROWS))
    return max(1, few, -(-rows // TASK_ROWS))


def calendar(df: DataFrame, sec: str = "sec") -> DataFrame:
    """Minute, hour, day, week (from a Monday) and month numbers of epoch seconds, free of any session time zone."""
    day = F.expr(f"{sec} div 86400")
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    return df.withColumns(
        {
            "minute": F.expr(f"{sec} div 60"),
            "hour": F.expr(f"{sec} div 3600"),
            "day": day,
            "week": F.expr(f"({sec} div 86400 + 3) div 7"),
            "month": (F.year(date) * 12 + F.month(date) - 1).cast("bigint"),
        }
    )


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log itself says of each fill. Lines are dealt by transaction: one exchange serves the join and the dedup."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = lines.repartition(task_count(spark, lines.count()), "l_orderkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(
        "l_orderkey as tx_hash",
        "cast(l_linenumber as bigint) as evt_index",
        f"timestampdiff(SECOND, {EPOCH}, l_shipdate) + (l_suppkey * 397 + l_partkey * 13 + l_linenumber * 7) % 86400 as sec",
        "(l_partkey % 100) * 2 + l_suppkey % 2 as token_id",
        "l_suppkey as maker",
        "o_custkey as taker",
        "case when l_linestatus = 'O' then 'BUY' else 'SELL' end as side",
        "cast(round((l_discount * 8 + l_tax + 0.01D) * 100) as bigint) as pc",
        "cast(l_quantity as bigint) as q",
        "l_returnflag = 'N' as is_taker",
        "l_returnflag = 'R' as fee_paying",
    )


def _described(logged: DataFrame) -> DataFrame:
    """Fills with what follows from the log: market, outcome, class, amounts, fee, calendar."""
    market = "token_id div 2"
    out = logged.selectExpr(
        "tx_hash", "evt_index", "sec", f"{market} as condition_id", "token_id % 2 as outcome_index", "token_id", f"({market}) % 2 as winner", f"({market}) div 5 as family",
        f"({market}) % 7 as category", "maker", "taker", "side", "pc", "q", "is_taker", "fee_paying", "tx_hash % 3 as builder", "pc * q as cents",
    )
    rate = F.when(F.col("fee_paying"), F.col("category") % 3 + 5).otherwise(0)
    return calendar(out.withColumn("fee", (rate * F.col("pc") * (100 - F.col("pc")) * F.col("q")).cast("bigint")))


def raw_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape as logged: keys (tx_hash, evt_index) repeat."""
    return _described(_logged(spark, sf_dir))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape with one row for each (tx_hash, evt_index). Only logged columns are shuffled and sorted; the rest follows."""
    return _described(dedup_first(_logged(spark, sf_dir), ["tx_hash", "evt_index"], FILL_ORDER))


def written_fills(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Some columns of the tape, written once to the shared folder: for queries that read it more than once."""
    return cut(fills(spark, sf_dir).select(*columns))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of wallets with microsecond times: size in hundredths, price in cents, notional in ten-thousandths."""
    events = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    out = events.selectExpr(
        "event_id",
        f"timestampdiff(MICROSECOND, {EPOCH}, ts) as us",
        "user_id as wallet",
        "cast(get_json_object(props, '$.k') as bigint) as k",
        "case when event_type in ('purchase', 'view') then 'BUY' else 'SELL' end as side",
        "cast(round(value * 100) as bigint) as size",
        "(event_id * 37) % 97 + 1 as pc",
    )
    out = out.selectExpr(
        "*", "us div 1000000 as sec", "k % 10 as asset_id", "(k % 10) div 2 as condition_id", "(k % 10) % 2 as outcome_index",
        "((k % 10) div 2) % 2 as winner", "pc * size as notional",
    )
    return calendar(out)


def markets(tape: DataFrame) -> DataFrame:
    """One row per market of a tape: its winner, family, category, first and last second."""
    return tape.groupBy("condition_id").agg(
        F.max("winner").alias("winner"), F.min("sec").alias("first_sec"), F.max("sec").alias("close_sec"), F.max("category").alias("category"), F.max("family").alias("family")
    )
