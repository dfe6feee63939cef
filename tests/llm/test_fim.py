"""Rank and select against counting, the rearrangement against plain Python, and exact restoring."""

import hashlib
import random
import re

import numpy as np

from tidemark.llm import fim
from tidemark.llm.common import tune


def test_rank_and_select_count_ones():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        for share in (0.0, 0.01, 0.5, 1.0):
            bits = rng.random(n) < share
            marks, at = fim.Marks(bits), np.flatnonzero(bits)
            places = np.arange(n + 1)
            assert (marks.rank(places) == np.r_[0, np.cumsum(bits)]).all()
            assert (marks.select(np.arange(len(at))) == at).all()


def _plain(doc_id, text, seed, rate, spm):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or re.search("<P>|<S>|<M>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_agrees_with_plain_python(spark):
    tune(spark)
    rng = random.Random(6)
    texts = ["", "\n", "\n\n\n", "a", "a\n", "é\nü\r\nx", "<P>\nq", "a<\nS>b\nP>", "<\n<\nS", "<M\n>", "x" * 300_000, "y\n" * 100_000]
    texts += ["".join(rng.choice(["a", "\n", "é", "<", "P", ">", "中\n", "\r", " ", "\x00"]) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    rows = [(k, t, k % 3, "f") for k, t in enumerate(texts)] + [(5000, None, 1, "f"), (7, texts[20], 1, "g"), (7, texts[20], 1, "g"), (-3, "a\nb\nc", 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N int, form string").repartition(3)
    for seed, rate, spm in ((7, 100, 50), (1, 60, 20)):
        made = fim.fill_in_middle(df, seed, rate, spm)
        out = made.withColumn("back", fim.restore(made["output"], made["form"])).collect()
        got = sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out)
        assert got == sorted((i, *_plain(i, t or "", seed, rate, spm)) for i, t, *_ in rows)
        assert sorted((r.doc_id, r.back) for r in out) == sorted((i, t or "") for i, t, *_ in rows)
        assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a\nb")], "doc_id int, text string")
    row = fim.fill_in_middle(df).first()
    assert row.doc_id is None and row.n == 2 and row.output == _plain("", "a\nb", 7, 100, 50)[-1]
    assert fim.fill_in_middle(df.limit(0)).collect() == []
