"""Benchmark decontamination: near copies of benchmark items inside documents, by edit distance over words.

Item-sized windows of a document are embedded by CGK random walks, which turn edit distance into Hamming distance;
bit-sampling tables over the embeddings propose (window, item) pairs; a semi-global alignment confirms each.
Windows that cannot match are not embedded, which loses nothing: with at most k edits, one of k + 1 disjoint segments
of the item stands unchanged in the document, so only windows around such a segment can match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import columns_schema, delete, map_arrow, written
from tidemark.llm.shingles import bare_words, mix

#: Edits allowed, as a share of an item's words.
RATE = 0.2
#: Walks, tables of each walk, and positions that a table samples. A window at exactly the edits allowed is met with a
#: probability above 0.9995 (tests/llm plants 2,000).
WALKS, TABLES, SAMPLED = 12, 16, 3
#: Bytes of item text that one pass over the documents holds; more items take more passes.
ITEM_BYTES = 16 << 20
_FILTER_BITS = 22


def edits_allowed(n_words: int, rate: float = RATE) -> int:
    return int(rate * n_words)


def align(item: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the part of text nearest to item, if at most `most` edits away; the first such."""
    cost, begin = [0] * (len(text) + 1), list(range(len(text) + 1))
    for k, word in enumerate(item, 1):
        corner, corner_begin = cost[0], begin[0]
        cost[0], left, left_begin = k, k, 0
        begin[0] = 0
        for j, other in enumerate(text, 1):
            up, up_begin = cost[j], begin[j]
            best, start = corner + (word != other), corner_begin
            if up + 1 < best:
                best, start = up + 1, up_begin
            if left + 1 < best:
                best, start = left + 1, left_begin
            corner, corner_begin = up, up_begin
            cost[j] = left = best
            begin[j] = left_begin = start
    low = min(cost)
    if low > most:
        return None
    at = cost.index(low)
    return low, begin[at], at


def embed(windows: np.ndarray, sizes: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """CGK embeddings of rows of words (padded with 0): at each step the word under the walker is put out, and a
    random function of step and word says whether the walker moves on; beyond the end it puts out 0."""
    rng = np.random.Generator(np.random.PCG64([17, walk]))
    moves = rng.integers(1, 1 << 62, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    rows, at = np.arange(len(windows)), np.zeros(len(windows), np.int64)
    padded = np.hstack([windows, np.zeros((len(windows), 1), np.uint64)])
    stop = np.minimum(sizes, windows.shape[1])
    out = np.empty((steps, len(windows)), np.uint64)
    for k in range(steps):
        word = np.where(at < stop, padded[rows, np.minimum(at, stop)], np.uint64(0))
        out[k] = word
        at += ((word * moves[k]) >> np.uint64(63)).astype(np.int64)
    return out


@dataclass
class Index:
    """What is kept of a block of items; built once in each worker."""

    items: list[tuple[int, np.ndarray]]
    rate: float = RATE
    walks: int = WALKS
    tables: int = TABLES
    sampled: int = SAMPLED
    max_words: int = field(init=False)

    def __post_init__(self) -> None:
        self.max_words = max((len(w) for _, w in self.items), default=0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("seeds", "buckets", "filter")}

    @cached_property
    def seeds(self) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """Segment length -> hash -> (item, offset): k + 1 disjoint segments of each item."""
        out: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for number, (_, words) in enumerate(self.items):
            size = len(words) // (edits_allowed(len(words), self.rate) + 1)
            grams = _grams(words, size)
            for k in range(edits_allowed(len(words), self.rate) + 1):
                out.setdefault(size, {}).setdefault(int(grams[k * size]), []).append((number, k * size))
        return out

    @cached_property
    def filter(self) -> dict[int, np.ndarray]:
        """For each segment length, one bit for each value of the first bits of the segments' hashes."""
        out = {}
        for size, found in self.seeds.items():
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(np.fromiter(found, np.uint64, len(found)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            out[size] = bits
        return out

    def keys(self, windows: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """For each table, a key of each window. Sampled places are shares of the embedding's length, 3n."""
        rng = np.random.Generator(np.random.PCG64(23))
        for walk in range(self.walks):
            steps = embed(windows, sizes, 3 * self.max_words, walk)
            for _ in range(self.tables):
                # The walks drift apart along the text, so the first half is sampled.
                places = (rng.random(self.sampled)[:, None] * 1.5 * sizes[None, :]).astype(np.int64)
                key = np.full(len(sizes), int(rng.integers(1, 1 << 62)), np.uint64)
                for row in places:
                    key = mix(key ^ steps[row, np.arange(len(sizes))])
                yield key

    @cached_property
    def buckets(self) -> list[dict[int, set[int]]]:
        n = np.array([len(w) for _, w in self.items])
        rows = np.zeros((len(self.items), self.max_words), np.uint64)
        for row, (_, words) in zip(rows, self.items, strict=True):
            row[: len(words)] = words
        out = []
        for key in self.keys(rows, n):
            table: dict[int, set[int]] = {}
            for number, k in enumerate(key.tolist()):
                table.setdefault(k, set()).add(number)
            out.append(table)
        return out

    def windows(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, start) of the windows that hold a segment of the item about where the item has it."""
        out = set()
        for size, found in self.seeds.items():
            grams = _grams(words, size)
            some = np.flatnonzero(self.filter[size][(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            for at, gram in zip(some.tolist(), grams[some].tolist(), strict=True):
                for number, offset in found.get(gram, ()):
                    reach = edits_allowed(len(self.items[number][1]), self.rate)
                    out.update((number, at - offset + d) for d in range(-reach, reach + 1))
        return out

    def matches(self, docs: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """For each document, (item number, distance, first word, word after the last) of each item found in it."""
        asked = [(doc, number, start) for doc, words in enumerate(docs) for number, start in sorted(self.windows(words))]
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in docs]
        for at in range(0, len(asked), 4096):
            for doc, number, start in self._proposed(docs, asked[at : at + 4096]):
                item = self.items[number][1]
                reach = edits_allowed(len(item), self.rate)
                a, b = max(0, start - reach), start + len(item) + 2 * reach
                found = align(item.tolist(), docs[doc][a:b].tolist(), reach)
                if found:
                    out[doc].append((number, found[0], a + found[1], a + found[2]))
        # Windows of one place propose it again and again: the nearest, then the first, stands for each item.
        return [[min((f for f in found if f[0] == number), key=lambda f: f[1:]) for number in sorted({f[0] for f in found})] for found in out]

    def _proposed(self, docs: list[np.ndarray], asked: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        sizes = np.array([len(self.items[number][1]) for _, number, _ in asked])
        rows = np.zeros((len(asked), self.max_words), np.uint64)
        for row, (doc, _, start), n in zip(rows, asked, sizes, strict=True):
            a = max(0, start)
            part = docs[doc][a : max(a, start + n)]
            row[: len(part)] = part
        met = np.zeros(len(asked), bool)
        for table, key in zip(self.buckets, self.keys(rows, sizes), strict=True):
            for k in np.flatnonzero(~met).tolist():
                if (found := table.get(int(key[k]))) and asked[k][1] in found:
                    met[k] = True
        # One proposal for each run of neighbouring windows is enough: the alignment looks around it.
        out, last = [], None
        for k in np.flatnonzero(met).tolist():
            doc, number, start = asked[k]
            reach = edits_allowed(len(self.items[number][1]), self.rate)
            if last is None or last[:2] != (doc, number) or start - last[2] > reach:
                out.append(asked[k])
                last = asked[k]
        return out


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k]
    return mix(out)


def _indexes(items: DataFrame, rate: float, item_bytes: int) -> Iterator[Index]:
    """Blocks of items of bounded size, one index each. Items without words match nothing."""
    rows = items.select("item_id", "text").where("text is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("text") * 2), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // item_bytes))
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        found = [(r.item_id, bare_words(r.text)[0]) for r in block.orderBy("item_id", "text").collect()]
        index = Index([f for f in found if len(f[1])], rate)
        if index.items:
            yield index


def find_items(docs: DataFrame, items: DataFrame, rate: float = RATE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, first_word, n_words.

    A word is a run of letters, digits or characters beyond ASCII, in lower case. An item of n words is found if some
    stretch of the document is at most int(rate * n) word edits away; the nearest (then first) stretch is given.
    No shuffle: items go to the documents, in blocks of bounded size. Ids may be of any type. Null or empty texts and
    items without words match nothing; texts of any length are searched whole; null doc ids and item ids pass through;
    repeated rows repeat; items that share an id give a row each; other columns are not read.
    """
    spark = docs.sparkSession
    rows, out = docs.select("doc_id", "text"), None
    ids_of = [("doc_id", docs.schema["doc_id"].dataType), ("item_id", items.schema["item_id"].dataType)]
    schema = ", ".join(f"{n} {t.simpleString()}" for n, t in ids_of) + ", distance int, first_word int, n_words int"
    types = (*(to_arrow_type(t) for _, t in ids_of), pa.int32(), pa.int32(), pa.int32())
    for index in _indexes(items, rate, item_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            index, ids = shared.value, batch.column(0).to_pylist()
            found = index.matches([bare_words(t.as_py() or "")[0] for t in batch.column(1)])
            flat = [(ids[k], index.items[f[0]][0], f[1], f[2], f[3] - f[2]) for k, fs in enumerate(found) for f in fs]
            columns = zip(*flat, strict=True) if flat else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "distance", "first_word", "n_words"])

        part = map_arrow(rows, run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The documents, all columns, in which find_items finds nothing.

    Rows with null or empty text are kept, repeated rows alike. With several blocks of items, what a block leaves is
    written before the next one, so a task holds one block's index at a time.
    """
    spark, before = docs.sparkSession, None
    for k, index in enumerate(_indexes(items, rate, item_bytes)):
        if k:
            docs, path = written(docs, "decontaminated")
            if before:
                delete(spark, before)
            before = path
        shared = spark.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = shared.value.matches([bare_words(t.as_py() or "")[0] for t in texts])
            return batch.filter(pa.array([not f for f in found], pa.bool_()))

        docs = map_arrow(docs, run, columns_schema(docs))
    return docs
