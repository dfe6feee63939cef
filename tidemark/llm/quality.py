"""Quality scores: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns_schema, delete, fold_column, map_arrow, written
from tidemark.llm.shingles import mix

#: Slots that features are hashed to.
SLOTS = 1 << 18
#: Labelled rows of each class that the model is fitted on, at most; those with the least hashes of their ids.
TRAIN_ROWS_PER_CLASS = 1500
_rng = np.random.Generator(np.random.PCG64(99))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xD1342543DE82EF95
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Kinds of byte: 0 white space and controls, 1 of a word (letters, digits, all beyond ASCII), 2 punctuation.
_KIND = np.full(256, 1, np.int8)
_KIND[:33] = 0
_KIND[127] = 0
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2
_UPPER, _DIGIT = np.zeros(256, np.int32), np.zeros(256, np.int32)
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_SALTS = [np.uint64(int(x)) for x in _rng.integers(1, 1 << 63, 8, dtype=np.uint64)]
_ODD = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(1, 1 << 62, 4, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a whole text.

    Tokens are runs of word bytes and runs of punctuation. Families of n-grams: tokens, pairs of tokens, shapes
    (kind, case, digits, length up to 8) of one to three tokens, and whether a token repeats one of the last four.
    Each family's counts are scaled to length one, so that the length of a text does not matter.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kind = _KIND[data]
    edge = np.flatnonzero(np.diff(kind)) + 1
    cuts = np.concatenate([[0], edge, [len(data)]]).astype(np.int64)
    starts, ends = cuts[:-1], cuts[1:]
    real = (ends > starts) & (kind[np.minimum(starts, len(data) - 1)] > 0) if len(data) else np.zeros(0, bool)
    starts, ends = starts[: len(real)][real], ends[: len(real)][real]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:], dtype=np.uint64)
    size = ends - starts
    token = mix((total[ends] - total[starts]) * down[starts] + size.astype(np.uint64))
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    n_upper, n_digit = upper[ends] - upper[starts], digit[ends] - digit[starts]
    case = np.where(n_upper == 0, 0, np.where(n_upper == size, 1, np.where((n_upper == 1) & (_UPPER[data[starts]] == 1), 2, 3)))
    shape = (kind[starts].astype(np.uint64) << np.uint64(8)) | (case.astype(np.uint64) << np.uint64(6)) | ((n_digit > 0).astype(np.uint64) << np.uint64(5)) | np.minimum(size, 8).astype(np.uint64)
    again = np.zeros(len(token), np.uint64)
    for k in range(1, 5):
        again[k:] |= (token[k:] == token[:-k]).astype(np.uint64) << np.uint64(k)
    families = [token, token[:-1] * _ODD[0] + token[1:] * _ODD[1], shape, shape[:-1] * _ODD[0] + shape[1:] * _ODD[1]]
    families.append(shape[:-2] * _ODD[0] + shape[1:-1] * _ODD[1] + shape[2:] * _ODD[2])
    families.append(again)
    slots, values = [], []
    for salt, family in zip(_SALTS, families, strict=False):
        if len(family):
            at, count = np.unique(mix(family + salt) % np.uint64(SLOTS), return_counts=True)
            slots.append(at.astype(np.int64))
            values.append(count / np.sqrt((count * count).sum()))
    return np.concatenate(slots), np.concatenate(values)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        slots, values = features(text)
        margin = self.bias + float(self.weights[slots] @ values)
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


class Learner:
    """FTRL-proximal: per slot a sum of adjusted gradients z and of squares n; the weight follows from them."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, at) -> np.ndarray:
        zs = self.z[at]
        return np.where(np.abs(zs) <= self.l1, 0.0, -(zs - np.sign(zs) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def see(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One example: distinct slots and their values."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        old = self.n[at]
        self.z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / self.alpha * w
        self.n[at] = old + g * g

    def model(self) -> Model:
        w = self.weights(np.arange(SLOTS + 1))
        return Model(w[:-1].astype(np.float32), float(w[-1]))


def with_bias(slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots, the values of those that coincide added up, and the bias as a slot of its own."""
    at, back = np.unique(np.append(slots, SLOTS), return_inverse=True)
    return at.astype(np.int32), np.bincount(back, np.append(values, 1.0)).astype(np.float32)


def train(examples: Iterable[tuple[np.ndarray, np.ndarray, int]], epochs: int = 2) -> Model:
    """Fit to examples (slots, values, label) in a fixed shuffled order."""
    ready = [(*with_bias(slots, values), label) for slots, values, label in examples]
    learner, rng = Learner(), np.random.Generator(np.random.PCG64(3))
    for _ in range(epochs if ready else 0):
        for k in rng.permutation(len(ready)):
            learner.see(*ready[k])
    return learner.model()


def fit_quality(docs: DataFrame, labels: DataFrame, label_column: str = "quality", rows_per_class: int = TRAIN_ROWS_PER_CLASS, epochs: int = 2) -> Model:
    """Fit on labelled documents whose id's crc32 modulo 5 is not 0, at most rows_per_class of each class.

    The sample is bounded by that parameter, so its ids are broadcast. Its features are written and streamed to the driver
    once an epoch, in an order of their own, a partition at a time: the driver holds the model and one partition. Labels
    of a document that disagree count as 0; null labels and ids are left out; every row of a repeated id is an example.
    Ids may be of any type that compares with the labels' ids. Rows that tie in id and features are interchangeable. Without
    labels every score is 0.5.
    """
    known = labels.where(F.col(label_column).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min(label_column).alias("y")).where(fold_column("doc_id") != 0)
    picks = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for y in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(picks[0].union(picks[1])), "doc_id").select("doc_id", "y", "text")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [with_bias(*features(t.as_py() or "")) for t in batch.column(2)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1).cast(pa.int32()), pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary())],
            ["doc_id", "y", "slots", "v"],
        )

    kind = columns_schema(sample.select("doc_id"))
    rows, path = written(map_arrow(sample, extract, f"{kind}, y int, slots binary, v binary"), "quality-features")
    learner = Learner()
    for epoch in range(epochs):
        for r in rows.orderBy(F.xxhash64("doc_id", F.lit(epoch)), "doc_id", "slots").toLocalIterator():
            learner.see(np.frombuffer(r.slots, "<i4"), np.frombuffer(r.v, "<f4"), r.y)
    delete(docs.sparkSession, path)
    return learner.model()


def score_quality(docs: DataFrame, model: Model, score_column: str = "score") -> DataFrame:
    """All columns of docs with a score (0 to 1) of the whole text. Null text is empty text, scored by the bias.

    The model is an array of SLOTS numbers, whatever the data, and is broadcast. A column of the score's name is
    replaced; repeated rows and null ids are scored as any; texts of any length are read whole; an empty table gives
    no rows. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        here = Model(*shared.value)
        at = batch.schema.get_field_index("text")
        scores = pa.array([here.score(t.as_py() or "") for t in batch.column(at)], pa.float64())
        return pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, score_column])

    docs = docs.drop(score_column)
    return map_arrow(docs, run, f"{columns_schema(docs)}, `{score_column}` double")
