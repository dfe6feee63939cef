"""BPE encoding and decoding by a bounded-lookahead transducer."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import bpe
from tidemark.llm.common import map_arrow


@lru_cache(maxsize=2)
def transducer(path: str) -> bpe.Transducer:
    """One per worker process."""
    return bpe.Transducer(path)


def encode_decode(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), decoded (the text of those ids).

    The decoder sees the ids alone. Null text counts as empty: no ids, empty text. Null ids and repeated rows pass
    through, one result per row; an empty table gives none; other columns are not read. No shuffle.
    """
    id_type = df.select(id_column).schema[0].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = transducer(tokenizer)
        ids = tool.encode_all([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array(ids, pa.binary()),
                pa.array(map(tool.decode, ids), pa.string()),
            ],
            [id_column, "n_tokens", "ids", "decoded"],
        )

    schema = f"`{id_column}` {id_type}, n_tokens bigint, ids binary, decoded string"
    return map_arrow(df.select(id_column, text_column), run, schema)
