"""Connected components by alternating large-star and small-star steps on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import delete, written

#: The table of minima is broadcast only below so many links (it has at most two rows of 16 bytes a link).
BROADCAST_LINKS = 500_000


def _with_min(links: DataFrame, small: bool) -> tuple[DataFrame, list[str]]:
    """links (u, v) with m, the least v of u. Beyond the bound both sides are shuffled, so that a hot u can be split."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    if small:
        return links.join(F.broadcast(least), "u"), []
    table, path = written(least, "least")
    return links.join(table, "u"), [path]


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> (node, component): each linked node with the least node that it reaches.

    Self links, repeats and rows with a null are dropped first. Each round is written to the shared folder, which
    cuts the lineage; the state is the link table alone, and minima are pre-aggregated before they are shuffled.
    Rounds end when the links no longer change: then each node points at its root. No link gives no row.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    table, path = written(ordered, "links")
    mark = _mark(table)
    while mark[0]:
        paths = [path]
        small = mark[0] <= BROADCAST_LINKS
        both = table.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            table.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        joined, used = _with_min(both, small)
        paths += used
        large = joined.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        if not small:
            large, used_path = written(large, "large")
            paths.append(used_path)
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        joined, used = _with_min(down, small)
        paths += used
        star = joined.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("x"))
        table, path = written(star.select("x.a", "x.b").where("a <> b").distinct(), "links")
        for old in paths:
            delete(table.sparkSession, old)
        before, mark = mark, _mark(table)
        if before == mark:
            break
    pairs = table.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = table.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.union(roots)


def _mark(links: DataFrame) -> tuple[int, int]:
    """How many links, and a sum of their hashes: equal marks mean equal tables."""
    one = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return int(one[0]), int(one[1])
