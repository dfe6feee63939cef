"""URL filtering: rules first, then the likelihood ratio of two character models of accepted and rejected URLs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import delete, fold_column, paths_made, written

#: Longest context, and the weight of the next shorter one.
ORDER, WEIGHT = 5, 2.0
#: Characters that a task scores at once, and the counts of a gram by accepted, held out.
CHUNK, _N = 1 << 18, ("n00", "n01", "n10", "n11")
#: Bins of the calibration histogram over scores from -RANGE to RANGE.
BINS, RANGE = 1024, 4.0
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UP, _LOW), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, ties by text; nulls if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last one put in front is the longest
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _tails(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each character (a byte), it and the ORDER before it as one number (exact, six bytes), and its row.

    Each text starts after ORDER zero bytes and ends with byte 1. The low k + 1 bytes are the gram of order k; they
    without the last byte are its context.
    """
    coded = [t.encode("utf-8", "surrogatepass") + b"\x01" for t in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    data = np.frombuffer(b"".join(b"\0" * ORDER + c for c in coded), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(row)) + (row + 1) * ORDER
    tails = np.zeros(len(at), np.int64)
    for k in range(ORDER, -1, -1):
        tails = tails << 8 | data[at - k]
    return tails, row


def _chunked(rows: DataFrame) -> DataFrame:
    """Rows with the number of their chunk: neighbours in a partition, about CHUNK characters. To be written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, used = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            out = []
            for size in pc.binary_length(batch.column(batch.schema.get_field_index("shown"))).to_pylist():
                if used > CHUNK:
                    chunk, used = chunk + 1, 0
                used += size + 1
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "chunk"])

    return rows.mapInArrow(run, f"{_ddl(rows)}, chunk bigint")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def _tail_counts(rows: DataFrame) -> DataFrame:
    """(chunk, tail, n00, n01, n10, n11): every tail in the chunk's texts, n by accepted and held out where ruled.

    A chunk's counts are added up before anything is shuffled, so a tail of every URL makes one row a chunk."""
    flag = F.when(F.col("verdict").isNull(), 4).otherwise(F.when(F.col("verdict") == "allow", 2).otherwise(0) + F.col("held"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int, list, list] | None = None
        for batch in batches:
            chunks, flags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            texts = np.array(batch.column(0).to_pylist(), object)
            for chunk in np.unique(chunks):
                mine = np.flatnonzero(chunks == chunk)
                tails, row = _tails(texts[mine].tolist())
                if kept is None or kept[0] != chunk:
                    if kept is not None:
                        yield emit(*kept)
                    kept = (chunk, [], [])
                kept[1].append(tails)
                kept[2].append(flags[mine][row])
        if kept is not None:
            yield emit(*kept)

    def emit(chunk: int, tails: list, flags: list) -> pa.RecordBatch:
        some, place = np.unique(np.concatenate(tails), return_inverse=True)
        n = np.bincount(place * 5 + np.concatenate(flags), minlength=5 * len(some)).reshape(-1, 5)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), chunk)), pa.array(some), *(pa.array(n[:, k]) for k in range(4))], ["chunk", "tail", *_N])

    return rows.select("shown", "chunk", flag.cast("int").alias("flag")).mapInArrow(count, "chunk bigint, tail bigint, " + ", ".join(f"{c} bigint" for c in _N))


def _differences(counts: DataFrame) -> DataFrame:
    """(tail, first, final): the log-likelihood difference of a character after its context, by models of the rows not
    held out and of all ruled rows.

    Exact counts, order by order: a gram joins its context's counts and the estimate of the next shorter order, so a key
    meets at most the 256 grams that lengthen it by a byte, however common it is.
    """
    levels = [counts]  # from the longest order to 0
    for k in range(ORDER - 1, -1, -1):
        gram = F.col("tail").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        levels.append(levels[-1].groupBy(gram.alias("tail")).agg(*[F.sum(c).alias(c) for c in _N]))
    models = {"r0": ["n00"], "a0": ["n10"], "r1": ["n00", "n01"], "a1": ["n10", "n11"]}
    estimates = None
    for k, grams in enumerate(reversed(levels)):
        context = F.shiftright("tail", 8)
        totals = grams.groupBy(context.alias("context")).agg(*[F.sum(c).alias(f"t{c}") for c in _N])
        joined = grams.withColumn("context", context).join(totals, "context")
        if estimates is None:
            joined = joined.withColumns({m: F.lit(1 / 256) for m in models})
        else:
            joined = joined.withColumn("shorter", F.col("tail").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(estimates.withColumnRenamed("tail", "shorter"), "shorter")
        add = lambda names: sum((F.col(c) for c in names[1:]), F.col(names[0]))
        p = {m: (add(names) + WEIGHT * F.col(m)) / (add([f"t{c}" for c in names]) + WEIGHT) for m, names in models.items()}
        estimates, _ = written(joined.select("tail", *[e.alias(m) for m, e in p.items()]), "url-estimates")
    return estimates.select("tail", (F.log("a0") - F.log("r0")).alias("first"), (F.log("a1") - F.log("r1")).alias("final"))


def _scored(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Chunked rows with first and final, the mean over a text's characters of the differences asked has for its chunk
    (chunk, tail, first, final); 0 for an empty text."""
    names = rows.columns

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        tails, row = _tails(texts.column("shown").to_pylist())
        known = found.column("tail").to_numpy()
        order = np.argsort(known)
        place = order[np.searchsorted(known, tails, sorter=order)]
        sizes = np.bincount(row, minlength=texts.num_rows)
        for name in ("first", "final"):
            sums = np.bincount(row, found.column(name).to_numpy()[place], texts.num_rows)
            texts = texts.append_column(name, pa.array(sums / sizes * (sizes > 1)))
        return texts.select([*names, "first", "final"])

    return rows.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(run, f"{_ddl(rows)}, first double, final double")


def _threshold(held: DataFrame) -> float:
    """The score that best separates held-out accepted from rejected URLs (the mean of the two rates), from a
    histogram of fixed size; in the middle of the best stretch. 0 if a side has none."""
    place = F.least(F.greatest(F.floor((F.col("score") + RANGE) / (2 * RANGE) * BINS), F.lit(0)), F.lit(BINS - 1))
    found = held.groupBy(place.cast("int").alias("bin"), (F.col("verdict") == "allow").alias("good")).count().collect()
    sides = np.zeros((2, BINS))
    for r in found:
        sides[int(r["good"]), r["bin"]] = r["count"]
    if not sides.sum(axis=1).all():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(sides, axis=1)], axis=1) / sides.sum(axis=1, keepdims=True)
    quality = below[0] + 1 - below[1]
    best = np.flatnonzero(quality >= quality.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 / BINS * 2 * RANGE - RANGE)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict (allow or block), score.

    Rules decide where one fits: its host or a subdomain, and a path that starts with the rule's; the longest wins.
    All URLs that rules decide train the two models; a fifth of them, by hash of the URL, first calibrates the
    threshold against models of the others. The rest get the method's verdict: allow if the score reaches it.

    Null URLs and URLs without :// have empty host and path and score 0, and are judged by it like any other. Null ids
    and repeated rows pass through; URLs of any length are scored whole; other columns are not read. With no ruled URL
    on a side the threshold is 0. An empty table gives no rows.
    """
    host, path = host_of(F.col(url_column)), path_of(F.col(url_column))
    rows = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"), F.concat("host", "path").alias("shown"))
    rows = rows.withColumn("held", (fold_column("shown") == 0).cast("int"))
    with paths_made() as made:
        rows, _ = written(_chunked(rows), "urls")
        counts, _ = written(_tail_counts(rows), "url-tails")
        differences = _differences(written(counts.groupBy("tail").agg(*[F.sum(c).alias(c) for c in _N]), "url-counts")[0])
        out, path = written(_scored(rows, counts.select("chunk", "tail").join(differences, "tail")), "url-scores")
        for old in [p for p in made if p != path]:
            delete(pages.sparkSession, old)
    threshold = _threshold(out.where("verdict is not null and held = 1").select("verdict", F.col("first").alias("score")))
    own = F.when(F.col("final") >= threshold, "allow").otherwise("block")
    return out.select(id_column, "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), F.col("final").alias("score"))
