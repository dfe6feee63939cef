"""A training corpus from raw documents: reject, deduplicate, decontaminate, redact, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.codec import encode_decode
from tidemark.llm.common import delete, free_name, paths_made, table, tune, with_ids, written
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.pii import redact_personal_data
from tidemark.llm.quality import fit_quality, score_quality
from tidemark.operators.primitives import global_row_number

KEEP_SCORE = 0.3
TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least KEEP_SCORE. Null and empty texts are scored like any other."""
    tune(spark)
    score = free_name(docs, "score")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), score)
    return scored.where(F.col(score) >= KEEP_SCORE).select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the first by id (nulls last), then by a hash of all columns.

    Every row is a document of its own, also those that share an id or have none; rows that are equal in all columns
    are interchangeable. Texts without words are in no group: such rows stay. Where ids are null or repeated, rows are
    numbered in that order first, and the numbers stand for ids.
    """
    tune(spark)
    if not _ambiguous(docs):
        return with_ids(docs, "doc_id", _dropped(docs, "doc_id"), "left_anti").select(docs.columns)
    row, place, null, digest = (free_name(docs, c) for c in ("row", "place", "null", "digest"))
    rows, _ = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    whole = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), {"ignoreNullFields": "false"}), 256)
    order = rows.select(F.col("doc_id").isNull().alias(null), "doc_id", whole.alias(digest), row)
    places = global_row_number(order, [null, "doc_id", digest, row], place).select(row, place)
    rows, _ = written(rows.join(places, row), "placed")
    return with_ids(rows, place, _dropped(rows, place), "left_anti").select(docs.columns)


def _dropped(docs: DataFrame, id_column: str) -> DataFrame:
    """The ids of the rows that are not the first of their group, as a table."""
    found = near_duplicates(docs, size=5, percent=80, id_column=id_column).where("not kept")
    return written(found.select(F.col("doc_id").alias(id_column)), "dropped")[0]


def _ambiguous(docs: DataFrame) -> bool:
    """Whether an id is null or stands in more than one row, so that ids do not name rows."""
    return bool(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").head(1))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    tune(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars counted anew."""
    tune(spark)
    return redact_personal_data(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document doc_id, n_tokens, ids_sha256 (ids as little-endian u32) and decoded_sha256 (of the decoded text)."""
    tune(spark)
    done = encode_decode(docs, public_tokenizers.path(TOKENIZER))
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality),
    ("deduplicate", deduplicate),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("encode", encode),
]

#: SQL can express neither the classifier nor the field; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. Each stage's table, and all that it wrote on the way, is deleted once the next one stands."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with paths_made() as made:
            docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
            for old in [p for p in made if p != path]:
                delete(spark, old)
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
