"""Token counts by heap-and-linked-list byte-pair merging; no ids are made."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm import bpe
from tidemark.llm.common import map_arrow


@lru_cache(maxsize=2)
def counter(path: str) -> bpe.WordPieces:
    """One per worker process; its table lives as long as the worker."""
    vocab = bpe.vocabulary(path)
    return bpe.WordPieces(path, lambda piece: bpe.count_tokens(vocab.symbols(piece), vocab.ranks, vocab.made))


def token_counts(
    df: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048
) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No shuffle: each row is counted where it is read. Null text counts as empty (0 bytes, 0 tokens); null ids and
    repeated rows pass through, one result per row; an empty table gives none; other columns are not read.
    """
    id_type = df.select(id_column).schema[0].dataType.simpleString()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tokens = counter(tokenizer).totals(texts, special=1)
        sizes = pc.coalesce(pc.binary_length(batch.column(1)), pa.scalar(0, pa.int32())).cast(pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), sizes, pa.array(tokens), pa.array(tokens > limit)], [id_column, "n_bytes", "n_tokens", "over_limit"]
        )

    schema = f"`{id_column}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return map_arrow(df.select(id_column, text_column), count, schema)
