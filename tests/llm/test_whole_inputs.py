"""Corpus operators do the whole job: no cap on rows, no filter that thins them out."""

import collections
import math

import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, urls
from tidemark.llm.registry import RULES


def _exact_scores(shown, ruled):
    """The character models in plain Python, with a count for each gram and context."""
    models = []
    for verdict in ("allow", "block"):
        grams, contexts = collections.Counter(), collections.Counter()
        for text, v in zip(shown, ruled, strict=True):
            if v == verdict:
                coded = b"\0" * urls.ORDER + text.encode() + b"\x01"
                for at in range(urls.ORDER, len(coded)):
                    for k in range(urls.ORDER + 1):
                        grams[coded[at - k : at + 1], k] += 1
                        contexts[coded[at - k : at], k] += 1
        models.append((grams, contexts))
    for text in shown:
        coded, total = b"\0" * urls.ORDER + text.encode() + b"\x01", 0.0
        for at in range(urls.ORDER, len(coded)):
            for sign, (grams, contexts) in zip((1, -1), models, strict=True):
                p = 1 / 256
                for k in range(urls.ORDER + 1):
                    p = (grams[coded[at - k : at + 1], k] + urls.WEIGHT * p) / (contexts[coded[at - k : at], k] + urls.WEIGHT)
                total += sign * math.log(p)
        yield total / (len(coded) - urls.ORDER)


def test_url_scores_are_those_of_exact_counts(spark):
    made = [f"http://{'example.org' if k % 3 else 'x.net'}/{'es' if k % 2 else 'en'}/{k * 7919 % 9_999_991:07d}{k * 104_729 % 9_999_973:07d}" for k in range(12_000)]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string").repartition(3)
    got = urls.judge_urls(df, RULES).orderBy("page_id").collect()
    ruled = [r.verdict if r.rule is not None else None for r in got]
    assert {None, "allow", "block"} == set(ruled)
    assert [r.score for r in got] == pytest.approx(list(_exact_scores([r.host + r.path for r in got], ruled)), abs=1e-9)


def test_items_without_an_id_are_found(spark):
    passage = "the quick brown fox jumps over the lazy dog near the old river bank at dawn"
    docs = spark.createDataFrame([(1, f"before it {passage} after it"), (2, "nothing of the kind stands in here")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, passage), (7, None)], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_items(docs, items).collect()] == [(1, None, 0)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [2]


def test_one_row_of_a_group_stays_whatever_its_id(spark, sf_dir):
    one, two = (" ".join(f"{w}{k}" for k in range(30)) for w in ("first", "second"))
    rows = [(1, one), (5, one), (5, two), (5, two), (None, one), (None, one), (None, "only here there are these six words"), (9, two), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, docs, sf_dir).collect()), key=repr)
    assert got == sorted([(1, one), (5, two), (None, "only here there are these six words"), (None, "")], key=repr)
    alone = spark.createDataFrame([(2, one), (1, one), (3, two)], docs.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, alone, sf_dir).collect()) == [1, 3]
