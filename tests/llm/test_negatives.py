"""Hard negatives against brute force: edge rows, ties, several cells, blocks and chunks; bounds that never lose a row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives
from tidemark.llm.common import tune

SCHEMA = "vec_id long, embedding array<float>, label int, score string, Rank int"


def _plain(rows, is_anchor, positives=5, wanted=10, low=30, high=90):
    use = []
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in q) < 1 << 55:
            use.append((i, label, q))
    out = []
    for i, label, q in use:
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(q, r)), j, m) for j, m, r in use if len(r) == len(q)]
        for s, j, _ in sorted(x for x in scored if x[2] == label and x[1] != i)[:positives]:
            band = sorted(x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)[:wanted]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(band)]
    return sorted(out)


def _rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 12))
    x = centres[rng.integers(0, 8, 400)] + rng.normal(size=(400, 12)) * rng.uniform(0.05, 0.6, (400, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[50:90] = x[50]  # copies tie
    rows = [(k, [float(v) for v in x[k]], 0 if k % 3 else int(rng.integers(1, 5)), "a", k) for k in range(400)]
    rows += [(400, None, 1, "a", 1), (410, [], 1, "a", 1), (420, [None] * 12, 1, "", 1), (430, [math.nan] * 12, 2, "", 1), (440, [math.inf] + [0.0] * 11, 2, "", 1), (450, [0.0] * 12, 2, "", 1)]
    rows += [(460, rows[10][1], None, "", 1), (None, rows[10][1], 1, "", 1), (470, [3e38] * 12, 1, "", 1), (480, [1.0, 2.0], 1, "", 1), (481, [1.0, 2.5], 1, "", 1), (482, [0.5, 1.0], 3, "", 1)]
    rows += [(500, [v * 4000 for v in rows[20][1]], 0, "", 1), (40, rows[40][1], 0, "", 1), (60, rows[61][1], 2, "", 1)]  # long vectors, repeated ids
    return rows


def test_agrees_with_brute_force(spark, monkeypatch):
    tune(spark)
    rows = _rows()
    want = _plain(rows, lambda i: i % 10 == 0)
    df = spark.createDataFrame(rows, SCHEMA)
    for block, chunk, sample, pivots in ((2048, 32_768, 2048, 1024), (4, 100, 7, 3), (16, 64, 0, 1)):
        for name, value in (("BLOCK", block), ("CHUNK", chunk), ("SAMPLE_ROWS", sample), ("MOST_PIVOTS", pivots)):
            monkeypatch.setattr(negatives, name, value)
        got = sorted(tuple(r) for r in negatives.hard_negatives(df.repartition(5), F.col("vec_id") % 10 == 0).collect())
        assert got == want and len(want) > 1000


def test_tables_without_rows_or_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(1, [1.0], 1, "", 1), (3, [1.0], 2, "", 1)], SCHEMA)
    assert negatives.hard_negatives(one, F.col("vec_id") % 10 == 0).collect() == []
    with pytest.raises(TypeError):
        negatives.hard_negatives(spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<float>, label int"), F.lit(True))


def test_bounds_lose_no_row_and_prune_clusters():
    rng = np.random.default_rng(5)
    for _ in range(200):
        spread, dim = float(rng.choice([2, 30, 200])), int(rng.integers(2, 20))
        centres = rng.normal(size=(6, dim)) * 256
        x = np.floor(centres[rng.integers(0, 6, 80)] + rng.normal(size=(80, dim)) * spread).astype(np.int64)
        a = x[:20]
        norms = (x.astype(float) ** 2).sum(axis=1)
        cells = negatives.Cells({dim: x[:5].astype(float)}, norms.max())
        cell, radius = cells.of_anchors(a)
        scores = negatives.products(a, x)
        assert (scores == np.array([[int(sum(int(p) * int(q) for p, q in zip(u, v))) for v in x] for u in a])).all()
        low = np.sort(scores, axis=1)[:, -8]
        stats = {int(c): (radius[cell == c].max(), norms[:20][cell == c].max(), float(low[cell == c].min())) for c in set(cell.tolist())}
        sent = set(zip(*(v.tolist() for v in cells.served(x, stats))))
        need = {(j, int(cell[i])) for i, j in zip(*np.nonzero(scores >= low[:, None]))}
        assert need <= sent
        if spread == 2 and dim > 10:
            assert len(sent) < 0.9 * len(x) * len(stats)


def test_products_beyond_doubles_are_exact():
    a = np.array([[2**26 + 1, 3], [-(2**26), 5]], np.int64)
    assert negatives.products(a, a).tolist() == [[int(sum(int(x) * int(y) for x, y in zip(u, v))) for v in a] for u in a]


def test_groups_hold_whole_cells_up_to_the_bound():
    rng = np.random.default_rng(9)
    cells = negatives.Cells({4: rng.normal(size=(30, 4))}, 9.0)
    counts = {(4 << 11) + 1 + k: int(rng.integers(1, 60)) for k in range(30)} | {5 << 11: 7}
    groups = cells.grouped(counts, 100)
    assert set(groups) == set(counts)
    held = {g: sum(counts[c] for c, h in groups.items() if h == g) for g in set(groups.values())}
    assert max(held.values()) <= 100 and len(held) < 20
    assert len({c >> 11 for c, g in groups.items() if g == groups[5 << 11]}) == 1  # lengths never share a group
    assert len(set(cells.grouped(counts, 1).values())) == 31
