"""Token-id files: fixed-width bit packing in blocks, with block offsets for random access.

A file is: MAGIC, one byte of bits per id, ids per block (u32); the packed blocks; a footer; the footer's length
(u64) and MAGIC again. Eight ids of b bits fill b bytes, least significant bit first, so packing and unpacking are a
few numpy operations on columns. The footer is an Arrow stream of (doc_id, start, n) in file order, with the block
offsets and the number of ids in its metadata.
"""

from __future__ import annotations

import os
import struct
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.bpe import byte_alphabet
from tidemark.llm.common import delete, integer_id, new_path, qualified, written
from tidemark.llm.pieces import FAR, PieceTable, WordSplit, segments

MAGIC = b"TMIDS1"
#: Ids per block; a multiple of eight.
BLOCK = 1 << 15
#: Bytes of text for which a file is wanted.
FILE_BYTES = 256 << 20
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


def bits_for(vocabulary_size: int) -> int:
    """Bits that hold every id below vocabulary_size."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), bits), np.uint8)
    for k in range(8):
        first = k * bits
        for byte in range(first // 8, (first + bits - 1) // 8 + 1):
            shift = byte * 8 - first
            part = groups[:, k] >> np.uint64(shift) if shift >= 0 else groups[:, k] << np.uint64(-shift)
            out[:, byte] |= (part & np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def unpack(packed: bytes, bits: int, count: int) -> np.ndarray:
    data = np.frombuffer(packed, np.uint8).reshape(-1, bits)
    groups = np.zeros((len(data), 8), np.uint32)
    for k in range(8):
        first = k * bits
        for byte in range(first // 8, (first + bits - 1) // 8 + 1):
            shift = byte * 8 - first
            part = data[:, byte].astype(np.uint64)
            groups[:, k] |= ((part << np.uint64(shift) if shift >= 0 else part >> np.uint64(-shift)) & np.uint64((1 << bits) - 1)).astype(np.uint32)
    return groups.reshape(-1)[:count]


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI; a bare path is of this machine, so paths that tasks share are qualified first."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Streams ids into one file; only a block of ids and the index of documents are held."""

    def __init__(self, uri: str, bits: int) -> None:
        store, path = _filesystem(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        self.out, self.bits = store.open_output_stream(path), bits
        self.out.write(MAGIC + struct.pack("<BI", bits, BLOCK))
        self.at, self.offsets, self.index, self.held, self.n_held, self.total, self.n_docs = len(MAGIC) + 5, [], [], [], 0, 0, 0

    def add_batch(self, doc_ids: pa.Array, ids: list[np.ndarray]) -> None:
        """Append the ids of some documents."""
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = self.total + np.cumsum(sizes) - sizes
        self.index.append(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], schema=_INDEX))
        self.n_docs += len(ids)
        for x in ids:
            self.held.append(x)
            self.n_held += len(x)
            if self.n_held >= 8 * BLOCK:
                self._flush(last=False)
        self.total += int(sizes.sum())

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self.held, np.zeros(0, np.uint32)])
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            packed = pack(ids[k : min(k + BLOCK, whole)], self.bits)
            self.offsets.append(self.at)
            self.out.write(packed)
            self.at += len(packed)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(last=True)
        sink = pa.BufferOutputStream()
        meta = {"total": str(self.total), "offsets": np.array([*self.offsets, self.at], "<u8").tobytes()}
        schema = _INDEX.with_metadata(meta)
        with pa.ipc.new_stream(sink, schema) as stream:
            for batch in self.index:
                stream.write_batch(batch.replace_schema_metadata(meta))
        footer = sink.getvalue().to_pybytes()
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()


class Reader:
    """Random access by block: ids(start, n) reads only the blocks that hold the range."""

    def __init__(self, uri: str) -> None:
        store, path = _filesystem(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        head = self.file.read_at(len(MAGIC) + 5, 0)
        if tail[8:] != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"not a token-id file: {uri}")
        self.bits, self.block = struct.unpack("<BI", head[len(MAGIC) :])
        (length,) = struct.unpack("<Q", tail[:8])
        stream = pa.ipc.open_stream(self.file.read_at(length, size - 8 - len(MAGIC) - length))
        self.index = stream.read_all()
        meta = stream.schema.metadata
        self.total, self.offsets = int(meta[b"total"]), np.frombuffer(meta[b"offsets"], "<u8")
        self.have, self.ids_of_have = -1, np.zeros(0, np.uint32)

    def _one(self, k: int) -> np.ndarray:
        if self.have != k:
            packed = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
            self.have = k
            self.ids_of_have = unpack(packed, self.bits, min(self.block, self.total - k * self.block))
        return self.ids_of_have

    def ids(self, start: int, n: int) -> np.ndarray:
        parts, at = [np.zeros(0, np.uint32)], start
        while at < start + n:
            k = at // self.block
            part = self._one(k)[at - k * self.block :][: start + n - at]
            parts.append(part)
            at += len(part)
        return np.concatenate(parts)


class LibraryEncoder:
    """Ids of whole texts from the tokenizers library, asked once for each distinct piece.

    The word-end vocabulary drops white space, lower-cases, and splits by a fixed pattern, so the ids of a text are those
    of its pieces in turn, and the library's model is asked for pieces. What the library would normalise otherwise than
    by lower case goes to it as it stands: chunks with far characters, and whole texts with special strings.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.size = self.tool.get_vocab_size(with_added_tokens=True)
        self.alone = [t.content for t in self.tool.get_added_tokens_decoder().values()] + list("\x1c\x1d\x1e\x1f")
        self.split, self.letters = WordSplit(whole_far=True), byte_alphabet()
        self.known = PieceTable(self._learn, "<u4")

    def _learn(self, keys: list[str | int | tuple[str]]) -> Iterator[bytes]:
        """A number stands for itself, a tuple holds a whole text."""
        ask, model, letters = self.tool.encode, self.tool.model, self.letters
        for key in keys:
            if isinstance(key, int):
                ids = [key]
            elif isinstance(key, tuple) or FAR.search(key):
                ids = ask(key[0] if isinstance(key, tuple) else key, add_special_tokens=False).ids
            else:
                ids = [t.id for t in model.tokenize(key if key.isascii() and key.isprintable() else key.encode().decode("latin-1").translate(letters))]
            yield array("I", ids).tobytes()

    def encode_all(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end_id, and where those of each text end."""
        last = [] if end_id is None else [[end_id]]

        def keys(text: str) -> Iterator[list]:
            yield from [[(text,)]] if any(map(text.__contains__, self.alone)) else map(self.split, segments(text))
            yield from last

        return self.known.gather([keys(t) for t in texts])


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def id_type(vocabulary_size: int, end_id: int) -> np.dtype:
    return np.dtype("<u2" if max(vocabulary_size, end_id + 1) <= 1 << 16 else "<u4")


def _range_ends(rows: DataFrame, files: int) -> list[tuple[bool, int, int]]:
    """The last key of each of `files` ranges of about as many rows: (not null, id, hash), nulls first."""
    ranges = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "h").groupBy(F.spark_partition_id().alias("k"))
    last = ranges.agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("real"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "h")).alias("last"))
    return [tuple(r.last) for r in last.orderBy("k").collect()]


def write_ids(
    df: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> str:
    """Encode every text, append end_id, and write the ids in ascending id order; returns the folder.

    Texts are encoded where they are read and only ids are shuffled, two bytes each where the vocabulary allows. Ranges of
    (id, hash of the text) are found first, from those columns alone, as many as the size of the texts asks for
    (FILE_BYTES), so a repeated id is not one task's burden. Each task streams its range into one file of its own name and
    reports it. The reports are the manifest: a file that no report names, left by a lost or repeated attempt, is never
    read. Null ids come first, null and empty texts give the end id alone, repeated rows are all written (ordered by hash
    and ids), an empty table gives an empty manifest, a text of any length goes to one file, other columns are not read.
    """
    spark = df.sparkSession
    folder = qualified(spark, folder or new_path(spark, "token-ids"))  # workers write where Spark does, whatever the default is
    rows = df.select(integer_id(df, id_column).alias("doc_id"), F.col(text_column).alias("text")).withColumn("h", F.xxhash64("text"))
    keys, path = written(rows.select("doc_id", "h", F.octet_length("text").alias("size")), "keys")
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(keys.agg(F.sum("size")).first()[0] or 0) // FILE_BYTES))
    ends = spark.sparkContext.broadcast(_range_ends(keys, files))
    delete(spark, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, last = encoder(tokenizer), ends.value
        dtype = id_type(tool.size, end_id)
        for batch in batches:
            ids, stops = tool.encode_all([t or "" for t in batch.column(1).to_pylist()], end_id)
            flat, places = pa.py_buffer(ids.astype(dtype).tobytes()), np.concatenate([[0], stops * dtype.itemsize])
            packed = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(places.astype("<i8").tobytes()), flat])
            key = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
            shard = [bisect_left(last, (d is not None, d or 0, h)) for d, h in key]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(shard, pa.int32()), packed.cast(pa.binary())], ["doc_id", "h", "shard", "ids"])

    coded = rows.select("doc_id", "text", "h").mapInArrow(encode, "doc_id bigint, h bigint, shard int, ids binary")
    dealt = coded.repartitionById(files, "shard").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, shard, size = None, TaskContext.get().partitionId(), encoder(tokenizer).size
        name, dtype = f"{folder}/ids-{shard:05d}-{uuid.uuid4().hex}", id_type(size, end_id)
        for batch in batches:
            if out is None:
                out = Writer(name, bits_for(max(size, end_id + 1)))
            out.add_batch(batch.column(0), [np.frombuffer(x, dtype) for x in batch.column(1).to_pylist()])
        if out is not None:
            out.close()
            columns = [[shard], [name], [out.n_docs], [out.total]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "file", "n_docs", "n_ids"])

    reports = dealt.select("doc_id", "ids").mapInArrow(write, "shard bigint, file string, n_docs bigint, n_ids bigint")
    reports.write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file, with the ids of all files before it. As many rows as tasks wrote, so one window holds them."""
    found = spark.read.schema("shard bigint, file string, n_docs bigint, n_ids bigint").parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back: per document doc_id, start (ids of all documents before it), n_tokens, ids (binary, u32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(file)
                for part in reader.index.to_batches(max_chunksize=256):
                    starts, sizes = part.column(1).to_pylist(), part.column(2).to_pylist()
                    ids = [reader.ids(s, n).tobytes() for s, n in zip(starts, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([before + s for s in starts], pa.int64()), part.column(2), pa.array(ids, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    files = manifest(spark, folder)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = files.select("file", "before").repartition(n, "file")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


