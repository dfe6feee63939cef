"""Classes of markets and wallets: tag modes, keyword rules, activity taxonomy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.primitives import ratio, small_side


def rule_class(text: Column, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """The first rule whose pattern is found in the text, in order."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def keyword_class(text: Column, rules: Sequence[tuple[str, Sequence[str]]], fallback: Column, whole: int = 4) -> tuple[Column, Column]:
    """(class, whether a keyword gave it): the first rule with a word found at a word's start; words up to `whole` letters match whole."""
    found, out = F.lit(False), fallback
    for name, words in reversed(rules):
        pattern = "|".join(rf"\b({w})\b" if len(w) <= whole else rf"\b{w}" for w in words)
        found, out = found | text.rlike(pattern), F.when(text.rlike(pattern), name).otherwise(out)
    return out, found


def with_recapture(broad: str, slug: str, tags: str, gate: str, recapture: Sequence[tuple[str, str | None, str]], split: Sequence[tuple[str, str, str, str | None]]) -> Column:
    """A broad class refined by precedence.

    recapture: (class, pattern of the slug or None, tag), the first that fits wins, but never for rows of the gate's class.
    split: (class, finer class, pattern of the slug, tag or None) within a class. What is left keeps its class.
    """
    has = lambda tag: F.array_contains(F.col(tags), tag) if tag else F.lit(False)
    seen = lambda pattern: F.col(slug).rlike(pattern) if pattern else F.lit(False)
    out = F.col(broad)
    for of, finer, pattern, tag in reversed(split):
        out = F.when((F.col(broad) == of) & (seen(pattern) | has(tag)), finer).otherwise(out)
    for name, pattern, tag in reversed(recapture):
        out = F.when((F.col(broad) != gate) & (seen(pattern) | has(tag)), name).otherwise(out)
    return out


def mode_of_tags(df: DataFrame, key: str, tags: str, mapping: DataFrame) -> DataFrame:
    """The class that most of a key's tags map to; among equals the one seen first."""
    each = df.select(key, F.posexplode(tags).alias("pos", "tag")).join(small_side(mapping), F.lower(F.trim("tag")) == F.col("name"))
    n = each.groupBy(key, "class").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), "first", "class")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "class", "n")


def hour_entropy(tape: DataFrame, wallet: str) -> DataFrame:
    """Shannon entropy (nats) of a wallet's activity over the hours of the day."""
    n = tape.groupBy(F.col(wallet).alias("wallet"), (F.col("hour") % 24).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("wallet"))
    return n.withColumn("p", p).groupBy("wallet").agg(F.sum("n").alias("n"), F.abs(F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def taxonomy(tape: DataFrame, maker_share: float = 0.7, per_day: float = 40, regular: float = 0.9) -> DataFrame:
    """Wallets by the first rule that fits: market maker, high frequency, one shot, active."""
    sides = tape.select(F.col("maker").alias("wallet"), F.lit(1).alias("made"), "day", "hour").union(tape.select("taker", F.lit(0), "day", "hour"))
    h = hour_entropy(sides, "wallet").select("wallet", "entropy")
    f = sides.groupBy("wallet").agg(F.count(F.lit(1)).alias("n"), ratio(F.sum("made"), F.count(F.lit(1))).alias("share"), F.countDistinct("day").alias("days")).join(h, "wallet")
    busy = (F.col("n") / F.col("days") >= per_day) & (F.col("entropy") >= regular * F.log(F.lit(24.0)))
    kind = F.when(F.col("share") >= maker_share, "market_maker").when(busy, "high_frequency").when(F.col("n") == 1, "one_shot").otherwise("active")
    return f.withColumn("kind", kind)


def enforce_gates(figures: DataFrame, coverage: float = 0.85, unmapped: float = 0.15, largest: float = 0.60) -> DataFrame:
    """The figures of a class panel (one row: coverage, unmapped, has_control, largest), or an error that says what is off."""
    row = figures.first()
    rules = {"coverage": row.coverage >= coverage, "unmapped": row.unmapped < unmapped, "has_control": row.has_control, "largest": row.largest <= largest}
    if off := [name for name, fine in rules.items() if not fine]:
        raise ValueError(f"the panel fails its gates: {', '.join(f'{n} = {row[n]}' for n in off)}")
    return figures
