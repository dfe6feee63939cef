"""Chat formatting at token level: segments encoded apart, reserved ids between them, loss masks by prefix sums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.codec import transducer

#: Reserved ids follow the vocabulary's own; their strings are how they are shown.
MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
#: Strings that steer some model or template. Inside contents they are escaped.
CONTROL = (*MARKS, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Tokens of one output row, from which the next turn starts a new part.
PART_TOKENS = 1 << 18
_FOUND = "|".join(rf"{re.escape(c[0])}(\\*)(?={re.escape(c[1:])})" for c in CONTROL)
_ESCAPE = re.compile(_FOUND)


def escape(text: str) -> str:
    r"""Put a backslash after the first character of each control string, and one more where some stand already.

    So no control string is left, and unescape() takes back exactly what was put in.
    """
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group()[:-1] if m.group().endswith("\\") else m.group(), text)


def first_reserved(tokenizer: str) -> int:
    return len(transducer(tokenizer).table)


def id_type(tokenizer: str) -> np.dtype:
    """Two bytes an id where the vocabulary and the reserved ids allow, else four."""
    return np.dtype("<u2" if first_reserved(tokenizer) + len(MARKS) <= 1 << 16 else "<u4")


def mask_of(runs: bytes, n: int) -> np.ndarray:
    """The mask of n tokens: 1 in each of the runs (pairs of start and length, 32 bits each)."""
    step, pairs = np.zeros(n + 1, np.int8), np.frombuffer(runs, "<u4").reshape(-1, 2)
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, pairs.sum(axis=1), -1)
    return np.cumsum(step[:-1], dtype=np.int8)


def encode_segments(tokenizer: str, texts: list[str]) -> list[bytes]:
    """Ids (u32) of escaped contents; special strings do not occur in them."""
    return transducer(tokenizer).encode_all([escape(t) for t in texts], plain=True)


def format_conversations(df: DataFrame, tokenizer: str, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Rows (conv_id, part, n_turns, ids, mask): a conversation's tokens (id_type), and which are an assistant's text, as runs
    whose prefix sums mask_of() gives back.

    A turn is START role SEP text END with reserved ids for the marks; role and text are escaped and encoded apart,
    so no content can make a mark. Turns are ordered by turn (nulls first), role, a hash of the text, and the text.
    Rows are dealt by ranges of that order, so a conversation of any size, or all rows without one, spread over tasks;
    each task streams its range. A conversation leaves in one or several parts, whose numbers ascend along it.

    Null role and text are empty; rows with a null conv_id form one conversation; repeated rows are turns of their
    own; a turn of any length is in one part; an empty table gives no rows; other columns are not read.
    """
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie"), F.col("text")]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order[:4]).sortWithinPartitions(*order).select("conv_id", "role", "text")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        start, sep, end = (int(first_reserved(tokenizer) + k).to_bytes(4, "little") for k in range(3))
        held: list[tuple[bytes, int, int]] = []
        size, conv = 0, None

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(h[0] for h in held), "<u4").astype(id_type(tokenizer))
            sizes, before, inside = np.array([(len(raw) // 4, *span) for raw, *span in held], np.int64).T
            starts = np.cumsum(sizes) - sizes + before  # a turn begins after all turns before it
            runs = np.stack([starts, inside], axis=1)[inside > 0].astype("<u4")
            columns = [pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array([len(held)], pa.int64())]
            columns += [pa.array([ids.tobytes()], pa.binary()), pa.array([runs.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "n_turns", "ids", "mask"])

        for batch in batches:
            convs, roles, texts = (c.to_pylist() for c in batch.columns)
            coded = zip(convs, roles, encode_segments(tokenizer, roles), encode_segments(tokenizer, texts), strict=True)
            for this, role, head, body in coded:
                if held and (this != conv or size >= part_tokens):
                    yield flush()
                    part, held, size = part + 1, [], 0
                conv = this
                held.append((b"".join([start, head, sep, body, end]), 2 + len(head) // 4, len(body) // 4 if role == "assistant" else 0))
                size += len(held[-1][0]) // 4
        if held:
            yield flush()

    return dealt.mapInArrow(assemble, "conv_id bigint, part bigint, n_turns bigint, ids binary, mask binary")


@dataclass
class _Digest:
    """What is read back of one conversation, a part at a time."""

    conv_id: int | None
    n_turns: int = 0
    loss_chars: int = 0
    formatted_chars: int = 0
    turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def add(self, tokenizer: str, ids: bytes, mask: bytes) -> None:
        base, tool = first_reserved(tokenizer), transducer(tokenizer)
        numbers = np.frombuffer(ids, id_type(tokenizer)).astype("<u4")
        under = mask_of(mask, len(numbers))
        marks = np.flatnonzero(numbers >= base)
        for a, b, c in zip(marks[0::3], marks[1::3], marks[2::3], strict=True):
            if tuple(numbers[[a, b, c]] - base) != (0, 1, 2):
                raise ValueError("marks out of order")
            role, text = (tool.decode(numbers[x + 1 : y].tobytes()) for x, y in ((a, b), (b, c)))
            self.n_turns += 1
            self.formatted_chars += len(role) + len(text) + sum(map(len, MARKS))
            self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            if under[a:c].any() or under[c]:
                held = unescape(tool.decode(numbers[a : c + 1][under[a : c + 1] > 0].tobytes()))
                self.loss_chars += len(held)
                self.loss.update(held.encode())

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, from its tokens and mask alone: counts and digests of its turns and of what is under the mask.

    The digests run over a conversation from its first turn to its last, so its parts, wherever they stand, are streamed
    in order through one task, which holds a part at a time.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            done = []
            for conv, ids, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv:
                    done += [now.row()] if now else []
                    now = _Digest(conv)
                now.add(tokenizer, ids, mask)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.row(), types, strict=True)], names)

    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "ids", "mask")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return dealt.mapInArrow(run, schema)
