"""Fill-in-the-middle rearrangement of texts at line boundaries, found with succinct rank and select."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import integer_id, map_arrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = ("plain", "psm", "spm")
#: Words of 64 bits under one entry of the popcount directory.
BLOCK_WORDS = 8


class Marks:
    """A packed bit vector with a directory of the ones before each block: rank and select for arrays of queries.

    It takes one bit a place, and an eighth of that for the directory. rank reads one directory entry and at most
    BLOCK_WORDS words; select finds the block by binary search and the word and bit inside it by popcounts.
    """

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        blocks = -(-len(packed) // (8 * BLOCK_WORDS)) + 1  # one more, so that a rank at the very end has a block
        held = np.zeros(blocks * 8 * BLOCK_WORDS, np.uint8)
        held[: len(packed)] = packed
        self.words = held.view("<u8").reshape(blocks, BLOCK_WORDS)
        self.before = np.zeros(blocks + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64), out=self.before[1:])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        block, rest = np.divmod(places, 64 * BLOCK_WORDS)
        width = np.clip(rest[:, None] - 64 * np.arange(BLOCK_WORDS), 0, 64).astype(np.uint64)
        full = ~np.uint64(0)
        below = np.where(width == 64, full, (np.uint64(1) << (width & np.uint64(63))) - np.uint64(1))
        return self.before[block] + np.bitwise_count(self.words[block] & below).sum(axis=1, dtype=np.int64)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The place of the one with that many ones before it."""
        block = np.searchsorted(self.before, ranks, side="right") - 1
        words = self.words[block]
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        left = ranks - self.before[block]
        word = (upto <= left[:, None]).sum(axis=1)
        at = np.arange(len(ranks))
        left = left - np.where(word > 0, upto[at, np.maximum(word - 1, 0)], 0)
        bits = np.unpackbits(np.ascontiguousarray(words[at, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)
        return block * 64 * BLOCK_WORDS + word * 64 + bit


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that the seed and the id decide."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))  # type: ignore[return-value]


def _arrange(ids: list[int | None], texts: pa.Array, seed: int, rate: int, spm: int) -> list[pa.Array]:
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    first = offsets[0] if len(offsets) else 0
    data = memoryview(texts.buffers()[2] or b"")[first : offsets[-1]]
    offsets = offsets - first
    start, end = offsets[:-1], offsets[1:]
    raw = np.frombuffer(data, np.uint8)
    last = raw == 10
    last[end[end > start] - 1] = True  # a text's last byte ends a line too
    marks = Marks(last)
    at = marks.rank(start)
    n = marks.rank(end) - at
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    lo, hi = np.minimum(a, b), np.maximum(a, b)

    def cut(k: np.ndarray) -> np.ndarray:
        """The byte after k lines of each text."""
        out = start.copy()
        some = np.flatnonzero(k)
        out[some] = marks.select(at[some] + k[some] - 1) + 1
        return out

    one, two = cut(lo), cut(hi)
    taken = pc.fill_null(pc.match_substring_regex(texts, f"{PREFIX}|{SUFFIX}|{MIDDLE}"), False).to_numpy(zero_copy_only=False)
    plain = (end == start) | taken | (h[:, 2] % 100 >= rate)
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < spm, 2, 1))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    outputs = []
    for kind, w, x, y, z in zip(form.tolist(), start.tolist(), one.tolist(), two.tolist(), end.tolist()):
        if kind == 0:
            outputs.append(bytes(data[w:z]))
        elif kind == 1:
            outputs.append(b"".join((p, data[w:x], s, data[y:z], m, data[x:y])))
        else:
            outputs.append(b"".join((s, data[y:z], p, data[w:x], m, data[x:y])))
    heads = Marks((raw & 0xC0) != 0x80)  # bytes that begin a code point
    chars = [heads.rank(v) for v in (start, one, two)]
    return [
        pa.array(n, pa.int64()),
        pa.DictionaryArray.from_arrays(pa.array(form, pa.int8()), pa.array(FORMS)).cast(pa.string()),
        pa.array(chars[1] - chars[0], pa.int64(), mask=plain),
        pa.array(chars[2] - chars[1], pa.int64(), mask=plain),
        pa.array(outputs, pa.binary()).cast(pa.string()),
    ]


def fill_in_middle(df: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output.

    A line is what ends with a line feed, or the rest. Prefix and suffix are cut off at two line boundaries that sha256 of
    the seed and the id chooses; `rate` and `spm` are percents. The boundaries of a batch of texts are one packed bit
    vector: a text's ones are its lines, and select on two ranks gives the bytes to cut at. Texts that hold a marker stay
    plain, so restore() is exact. One pass over the rows, nothing is shuffled; a task holds one batch.

    Null texts count as empty, and empty ones stay plain with n = 0. A null id draws as an empty one. Repeated rows give
    repeated results; an empty table gives none. Other columns are not read. Ids must be integers.
    """
    rows = df.select(integer_id(df, id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = _arrange(batch.column(0).to_pylist(), batch.column(1), seed, rate, spm)
        return pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_arrow(rows, run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that fill_in_middle rearranged. Markers cannot overlap one another, so each is found where it was put."""

    def after(marker: str) -> Column:
        return F.instr(output, marker) + len(marker)

    def upto(first: str, following: str) -> Column:
        return F.substring(output, after(first), F.instr(output, following) - after(first))

    rest = F.substring(output, after(MIDDLE), F.length(output))
    psm = F.concat(upto(PREFIX, SUFFIX), rest, upto(SUFFIX, MIDDLE))
    spm = F.concat(upto(PREFIX, MIDDLE), rest, upto(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
