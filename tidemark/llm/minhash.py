"""MinHash near-duplicate groups over word shingles, exact on the links they report."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import around_centres, by_group, dealt_apart, spanning_links
from tidemark.llm.common import delete, integer_id, map_arrow, small_or_shuffled, with_ids, written
from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_set

#: Bands and rows: a pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**30 = 7e-6.
BANDS, ROWS = 30, 5
#: Signatures are compared by one byte a minimum. A pair is taken to the full sets if at least so many agree: five
#: standard deviations below what similarity 0.8 gives.
AGREE = int(BANDS * ROWS * (0.8 - 5 * (0.8 * 0.2 / (BANDS * ROWS)) ** 0.5))
#: Members of a block when signatures are compared; shingles of a block when full sets are.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 3_000_000
_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_STEP = 2048


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash a*x + b (modulo 2**64) over the set."""
    out = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), _STEP):
        hashed = np.multiply.outer(_A, shingles[k : k + _STEP])
        hashed += _B[:, None]
        np.minimum(out, hashed.min(axis=1), out=out)
    return out


_SET_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _features(docs: DataFrame, size: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, bands, sigs = [], [], [], []
        for text in batch.column(1):
            found = shingle_set(text.as_py() or "", size)
            n.append(len(found))
            if not len(found):
                keys.append(None), bands.append(None), sigs.append(None)
                continue
            low = signature(found)
            keys.append(_key(found))
            rows = np.ascontiguousarray(low.reshape(BANDS, ROWS))
            bands.append([int.from_bytes(hashlib.blake2b(bytes([k]) + rows[k].tobytes(), digest_size=8).digest(), "little", signed=True) for k in range(BANDS)])
            sigs.append((low >> np.uint64(40)).astype(np.uint8).tobytes())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            ["doc_id", "n_shingles", "key", "bands", "sig"],
        )

    return map_arrow(docs, run, "doc_id bigint, n_shingles bigint, key binary, bands array<bigint>, sig binary")


def _bytes_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _central_first(sig: np.ndarray) -> np.ndarray:
    """Members by how many minima they share with the most common ones: an original comes before its copies."""
    sample = np.sort(sig, axis=0)
    middle = sample[len(sample) // 2]
    return np.argsort(-(sig == middle).sum(axis=1), kind="stable")


def _emit(ids: np.ndarray, links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if links:
        at = np.array(links)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], ["a", "b"])


def _most_central(group: pa.Table) -> int:
    return int(_central_first(_bytes_matrix(group.column("sig")))[0])


def _near_signatures(group: pa.Table):
    sig = _bytes_matrix(group.column("sig"))
    return lambda i, js: (sig[js] == sig[i]).sum(axis=1) >= AGREE


def _near_sets(percent: int):
    def near_of(group: pa.Table):
        sig, sets = _bytes_matrix(group.column("sig")), [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])

        def near(i: int, js: np.ndarray) -> np.ndarray:
            ok = (100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i])) & ((sig[js] == sig[i]).sum(axis=1) >= AGREE)
            some = np.flatnonzero(ok)
            if len(some):
                flat = np.concatenate([sets[j] for j in js[some]])
                at = np.searchsorted(sets[i], flat)
                hit = sets[i][np.minimum(at, len(sets[i]) - 1)] == flat
                both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[js[some]])[:-1]]), dtype=np.int64)
                ok[some] = 100 * both >= percent * (sizes[i] + sizes[js[some]] - both)
            return ok

        return near

    return near_of


def _linking(near_of):
    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, sig = group.column("rep").to_numpy(), _bytes_matrix(group.column("sig"))
        block = group.column("own").to_numpy() if group.column("bi")[0].as_py() != group.column("bj")[0].as_py() else None
        yield from _emit(ids, spanning_links(len(ids), _central_first(sig), near_of(group), block, group.column("joined").to_numpy()))

    return run


def _links(small: DataFrame, large: DataFrame | None, key: str, payload: list[str], near_of, blocks, n: int) -> tuple[DataFrame, list[str]]:
    """Links (a, b) whose components are those of all near pairs of a key, and paths to delete. Columns key, rep, sig and more.

    The keys of small have one block each. large (with m and g, None if there is none): keys of more than one, first tried
    against their centres.
    """
    one = [F.lit(0).alias(c) for c in ("bi", "bj", "own")]
    met, paths, attached = small.select(key, *one, F.lit(False).alias("joined"), *payload), [], None
    if large is not None:
        marked, paths = around_centres(large, key, "rep", _most_central, near_of, n)
        met = met.union(dealt_apart(marked, key, "rep", blocks).select(key, "bi", "bj", "own", "joined", *payload))
        attached = marked.where("centre is not null").select(F.col("centre").alias("a"), F.col("rep").alias("b"))
    found = by_group(met, [key, "bi", "bj"], _linking(near_of), "a bigint, b bigint", n)
    return found if attached is None else found.union(attached), paths


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable by links), kept (doc_id = component_id).

    Words lie between ASCII white space, A-Z lower-cased. A set holds the distinct `size`-word shingles; with fewer
    words, the whole sequence. Rows link if 100 * intersection >= percent * union; sets without words link nothing.

    Rows with equal sets become one class, represented by its least id. Classes that share a band and enough of
    their signatures form candidate groups; within a group, full sets confirm the links; components follow. Blocks
    bound every task, whatever the size of a group; members of a group beyond one block are tried against a central one, and
    only those not near it meet the others, so near copies of one text travel once (blocks.py). Texts are fetched for the members of candidate groups
    only. Ids must be integers. Null text is empty text; texts of any length are read whole. A null id is linked with
    nothing: its component_id is null and it is kept. Rows that share an id count as one document: one component.
    An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(integer_id(docs, id_column).alias("doc_id"), F.col(text_column).alias("text"))
    features, _ = written(_features(rows, size), "features")
    usable = features.where("doc_id is not null and key is not null")
    classes, _ = written(usable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")

    banded = classes.select(F.explode("bands").alias("h"), "rep")
    shared, shared_path = written(banded.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "bands")

    def members(some: DataFrame) -> DataFrame:
        return banded.join(small_or_shuffled(some), "h").join(classes.select("rep", "sig"), "rep")

    def rows_fit(met: Column) -> Column:
        return F.ceil(F.count_if(met) / BLOCK_ROWS)

    huge = shared.where(F.col("m") > BLOCK_ROWS)
    large = members(huge).withColumn("g", F.ceil(F.col("m") / BLOCK_ROWS)) if huge.head(1) else None
    links, used = _links(members(shared.where(F.col("m") <= BLOCK_ROWS)), large, "h", ["rep", "sig"], _near_signatures, rows_fit, n)
    candidates = components(links)
    for path in used:
        delete(spark, path)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the rows whose set is the class's; a repeat that follows at once is left out."""
        last = None
        for batch in batches:
            out = []
            for component, rep, text, key, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingle_set(text or "", size)
                if (rep, key) != last and _key(found) == key:
                    last = (rep, key)
                    out.append((component, rep, len(found), found.tobytes(), sig))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SET_TYPES, strict=True)], ["component", "rep", "n", "shingles", "sig"])

    wanted = candidates.select(F.col("node").alias("doc_id"), "component").join(classes.select(F.col("rep").alias("doc_id"), "key", "sig"), "doc_id")
    wanted, wanted_path = written(wanted, "candidates")
    texts = with_ids(rows, "doc_id", wanted.select("doc_id"), "left_semi").join(wanted, "doc_id")
    texts = texts.select("component", F.col("doc_id").alias("rep"), "text", "key", "sig")
    found, found_path = written(texts.mapInArrow(sets, "component bigint, rep bigint, n bigint, shingles binary, sig binary"), "sets")

    def sets_fit(met: Column) -> Column:
        return F.greatest(F.ceil(F.coalesce(F.sum(F.when(met, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES), F.ceil(F.count_if(met) / BLOCK_ROWS))

    weight, weight_path = written(found.groupBy("component").agg(sets_fit(F.lit(True)).alias("g"), F.count("*").alias("m")), "weights")
    huge = weight.where("g > 1")
    large = found.join(small_or_shuffled(huge), "component") if huge.head(1) else None
    small = found.join(weight.where("g = 1"), "component") if huge.head(1) else found
    links, used = _links(small, large, "component", ["rep", "shingles", "sig"], _near_sets(percent), sets_fit, n)
    linked = components(links)
    for path in (shared_path, wanted_path, found_path, weight_path, *used):
        delete(spark, path)

    resolved = classes.select("key", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    resolved = resolved.select("key", F.coalesce("component", "rep").alias("component"))
    out = features.select("doc_id", "n_shingles", "key").join(resolved, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
