"""Edge rows of every operator and stage, and methods against plain forms of themselves."""

import collections
import itertools
import json
import math
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, codec, decontaminate, minhash, packed_ids, pii, quality, urls, vectors
from tidemark.llm.common import tune, written
from tidemark.llm.registry import ORACLES, RULES
from tidemark.llm.shingles import bare_words

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


# Op 6: every short text, through windows far smaller than the text.


def _toy(path, merges):
    letters = bpe.byte_alphabet()
    vocab = {c: k for k, c in enumerate(letters[b] for b in range(256))}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": [f"{a} {b}" for a, b in merges]}, "added_tokens": []}))
    return str(path)


def test_small_windows_emit_what_the_whole_text_gives(tmp_path):
    rng = random.Random(2)
    lists = [[("a", "b"), ("b", "a"), ("ab", "a")], [("b", "b"), ("a", "bb"), ("a", "a"), ("abb", "aa")], [("a", "a"), ("aa", "a"), ("b", "aa"), ("aaa", "b")]]
    for number in range(12):
        if number < len(lists):
            merges = lists[number]
        else:
            known, merges = ["a", "b"], []
            while len(merges) < 5:
                pair = (rng.choice(known), rng.choice(known))
                if pair not in merges and len("".join(pair)) <= 5:
                    merges.append(pair)
                    known.append("".join(pair))
        tool = bpe.Transducer(_toy(tmp_path / f"{number}.json", merges))
        assert tool.lookahead <= 16
        for window in {tool.lookahead + 5, 2 * tool.lookahead}:
            tool.window = max(window, tool.lookahead + max(len(a + b) for a, b in merges))
            for n in (*range(11), 30):
                for text in itertools.product(b"ab", repeat=n) if n < 11 else [[rng.choice(b"ab") for _ in range(n)] for _ in range(200)]:
                    piece = bytes(text)
                    whole = bpe.merge_long(tool.vocab.symbols(piece), tool.vocab.ranks, tool.vocab.made)
                    assert [i for part in tool.tokens(piece) for i in part] == whole, (merges, piece)
                    assert tool.decode(np.array(whole, "<u4").tobytes()) == piece.decode()


# Op 5: the updates and the features in plain Python.


def test_updates_are_those_of_ftrl_proximal():
    rng = np.random.default_rng(4)
    learner, z, n = quality.Learner(), collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= learner.l1:
            return 0.0
        return -(z[i] - math.copysign(learner.l1, z[i])) / ((learner.beta + math.sqrt(n[i])) / learner.alpha + learner.l2)

    for _ in range(200):
        at, label = np.unique(rng.integers(0, 30, 6)).astype(np.int32), int(rng.integers(0, 2))
        x = rng.normal(size=len(at))
        learner.see(at, x, label)
        w = {int(i): weight(int(i)) for i in at}
        p = 1 / (1 + math.exp(-sum(w[int(i)] * v for i, v in zip(at, x))))
        for i, v in zip(map(int, at), x):
            g = (p - label) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / learner.alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert learner.weights(np.arange(30)) == pytest.approx([weight(i) for i in range(30)])


def _kind(c):
    return "w" if ord(c) > 127 or c.isalnum() else "_" if ord(c) <= 32 or ord(c) == 127 else "p"


def test_features_count_tokens_and_pairs():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "é", "7", " ", "!", ".", "word", "\n", "中"]) for _ in range(rng.randint(0, 40)))
        tokens = [w for k, g in itertools.groupby(text, _kind) if k != "_" for w in ["".join(g)]]
        slots, values = quality.features(text)
        sizes = [len(collections.Counter(tokens)), len(collections.Counter(zip(tokens, tokens[1:])))]
        assert len(slots) == len(values) >= sum(sizes)
        for at, counts in ((0, collections.Counter(tokens)), (sizes[0], collections.Counter(zip(tokens, tokens[1:])))):
            norm = math.sqrt(sum(c * c for c in counts.values()))
            assert sorted(values[at : at + len(counts)]) == pytest.approx(sorted(c / norm for c in counts.values()))
        assert len(with_all := quality.with_bias(slots, values)[0]) == len(set(slots.tolist())) + 1 and with_all[-1] == quality.SLOTS


# Op 2: threshold and verdict from held-out scores, by brute force.


def test_threshold_separates_best(spark):
    rng = random.Random(5)
    rows = [(rng.gauss(0.6, 0.8), "allow") for _ in range(150)] + [(rng.gauss(-0.6, 0.8), "block") for _ in range(90)]
    rows = [(min(max(s, -3.9), 3.9), v) for s, v in rows]
    found = urls._threshold(spark.createDataFrame(rows, "score double, verdict string"))
    rate = lambda t: np.mean([s >= t for s, v in rows if v == "allow"]) + np.mean([s < t for s, v in rows if v == "block"])
    assert rate(found) >= max(rate(s) for s, _ in rows) - 0.02
    assert urls._threshold(spark.createDataFrame(rows[:5], "score double, verdict string")) == 0.0


def test_every_verdict_follows_from_rule_or_score(spark):
    made = [f"http://a{k % 9}.{'com' if k % 2 else 'org'}/{'fr' if k % 3 else 'de'}/x{k}" for k in range(300)] + ["http://else.net/fr/y", "http://else.net/de/y", None, "no", "http://x.io/" + "z" * 20_000]
    df = spark.createDataFrame([(k, u, "q", 1) for k, u in enumerate(made)] * 2, "page_id long, url string, verdict string, score int")
    out = urls.judge_urls(df, RULES).collect()
    assert len(out) == 2 * len(made) and all(r.verdict in ("allow", "block") for r in out)
    free = [r for r in out if r.rule is None]
    edge = max([r.score for r in free if r.verdict == "block"], default=-math.inf), min([r.score for r in free if r.verdict == "allow"], default=math.inf)
    assert edge[0] < edge[1] and {r.score for r in out if r.host == ""} == {0.0}


# Op 4: recall at exactly the edits allowed, and every match of the small tables.


def test_recall_at_the_full_allowance():
    rng = random.Random(13)
    word = lambda: rng.randrange(1, 1 << 62)
    items = [(k, np.array([word() for _ in range(rng.randint(12, 60))], np.uint64)) for k in range(2000)]
    index, docs = decontaminate.Index(items), []
    for _, words in items:
        w = words.tolist()
        for at in sorted(rng.sample(range(len(w)), decontaminate.edits_allowed(len(w))), reverse=True):
            w[at : at + 1] = rng.choice([[word()], [], [w[at], word()]])
        docs.append(np.array([word() for _ in range(10)] + w + [word() for _ in range(10)], np.uint64))
    could = [decontaminate.align(words.tolist(), d.tolist(), decontaminate.edits_allowed(len(words))) is not None for (_, words), d in zip(items, docs)]
    found = [any(f[0] == k for f in fs) for k, fs in enumerate(index.matches(docs))]
    assert sum(could) > 1900 and sum(f for f, c in zip(found, could) if c) >= 0.999 * sum(could)


def test_every_exact_and_near_passage_of_the_small_tables_is_found(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_items(docs, items).collect()}
    texts = {r.doc_id: bare_words(r.text or "")[0].tolist() for r in docs.collect()}
    want = {}
    for item in items.collect():
        words = bare_words(item.text)[0].tolist()
        most = decontaminate.edits_allowed(len(words))
        for k, t in texts.items():
            if len(set(words) & set(t)) >= (len(set(words)) - most) * 0.5 and (near := decontaminate.align(words, t, most)):
                want[k, item.item_id] = near[0]
    assert {k: v for k, v in want.items() if got.get(k) != v} == {} and set(got) == set(want)


# Op 8: the oracle on data that has links, a hot label among them.


def test_links_agree_with_sql(spark):
    tune(spark)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(15, 32))
    x = (centres[rng.integers(0, 15, 500)] + rng.normal(size=(500, 32)) * rng.uniform(0.02, 0.25, (500, 1))).astype(np.float32)
    x[10] = x[11] = x[12]
    labels = np.where(rng.random(500) < 0.6, 1, rng.integers(2, 5, 500))
    df = spark.createDataFrame([(k, [float(v) for v in x[k]], int(labels[k]), "z") for k in range(500)], "vec_id long, embedding array<float>, label int, kept string")
    got = sorted(tuple(r) for r in vectors.near_vectors(df).collect())
    con = duckdb.connect()
    con.register("given", df.toPandas())
    con.execute("create view embeddings as select vec_id, cast(embedding as float[]) as embedding, label from given")
    want = sorted(con.sql(ORACLES["op8_embedding_groups"]).fetchall())
    assert sum(r[1] for r in want) > 2000
    assert sum(a == b for a, b in zip(got, want)) >= 0.98 * len(want)


def test_vectors_with_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.02], 1)]
    got = sorted(map(tuple, vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=repr)
    assert [r for r in got if r[0] is None] == [(None, 0, None, True)] and {r[2] for r in got if r[0] in (1, 3)} == {1} and (2, 0, 2, True) in got
    with pytest.raises(TypeError):
        vectors.near_vectors(spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<double>, label int"))


# Long texts, clashing columns, repeated rows.


def test_operators_take_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{k % 5000} Straße 12{k}" for k in range(60_000)) + " mail jane@doe.org"
    rows = [(1, long, "a", "b"), (1, long, "a", "b"), (2, None, None, None), (3, "", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_shingles string").withColumns({"h": F.lit(1), "shard": F.lit("x"), "ids": F.lit("y"), "batch": F.lit(2), "KEY": F.lit(3)})
    tune(spark)
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    assert [long[s.start : s.end] for s in spans[1] if s.kind == "email"] == ["jane@doe.org"] and spans[2] == spans[3] == []
    groups = minhash.near_duplicates(df, 4).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in groups) == [(1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True)]
    back = packed_ids.read_ids(spark, packed_ids.write_ids(df, WORD, 2)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in back)[2:] == [(2, 1), (3, 1)] and min(r.n_tokens for r in back if r.doc_id == 1) > 200_000
    coded = codec.encode_decode(df, BYTE).where("doc_id = 1").collect()
    assert len(coded) == 2 and all(r.decoded == long for r in coded)
    assert packed_ids.read_ids(spark, packed_ids.write_ids(df.limit(0), WORD, 2)).count() == 0
    with pytest.raises(TypeError):
        minhash.near_duplicates(df.withColumn("doc_id", F.lit("x")))


def test_items_and_documents_may_have_ids_of_any_type(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([("d1", f"so {passage} it is", "x"), ("d1", f"so {passage} it is", "x"), ("d2", None, "y"), (None, "nothing", "z")], "doc_id string, text string, distance string")
    items = spark.createDataFrame([("i", passage), (None, "")], "item_id string, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_items(docs, items).collect()] == [("d1", "i", 0)] * 2
    assert sorted(map(repr, decontaminate.drop_contaminated(docs, items).collect())) == sorted(map(repr, docs.where("doc_id is null or doc_id = 'd2'").collect()))


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """Documents with null, empty and repeated rows, and columns named like those that stages make."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    more = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", "s", 0), (900_001, "", "en", "s", 0), (900_002, "mail a.b@c.de now", None, None, 17)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = base.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).union(more).union(more)
    names = {"score": F.lit(7.5), "Kept": F.lit("k"), "row": F.lit("r"), "place": F.lit("p"), "spans": F.lit("s"), "n_tokens": F.lit("t"), "component": F.lit("c"), "digest": F.lit("d")}
    return written(rows.withColumns(names), "odd")[0]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, sf_dir, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, odd.limit(0), sf_dir).count() == 0
    out = stage(spark, odd, sf_dir)
    got = out.collect()
    if name == "encode":
        assert len(got) == odd.count() and [r.n_tokens for r in got if r.doc_id in (None, 900_001)] == [0] * 6
        return
    assert out.columns == odd.columns and all((r.score, r.Kept, r.row, r.place, r.spans, r.n_tokens, r.component, r.digest) == (7.5, "k", "r", "p", "s", "t", "c", "d") for r in got)
    if name == "redact":
        assert len(got) == odd.count() and sum(r.text == "mail [EMAIL] now" and r.n_chars == 16 for r in got) == 2
    if name in ("deduplicate", "decontaminate"):
        assert sum(r.doc_id is None and r.text is None for r in got) == 2 and sum(r.doc_id == 900_001 for r in got) == 4
        assert sum(r.doc_id == 900_002 for r in got) == (1 if name == "deduplicate" else 2)


def test_the_survivor_does_not_depend_on_the_order_of_rows(spark, sf_dir):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(5, text, s) for s in "xyzw"] + [(None, text, s) for s in "ab"] + [(7, text + " more", "q")]
    seen = set()
    for turn in range(3):
        random.Random(turn).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(turn + 1)
        got = corpus_pipeline.deduplicate(spark, docs, sf_dir).collect()
        assert len(got) == 1 and got[0].doc_id == 5
        seen.add(got[0].source)
    assert len(seen) == 1


def test_redaction_covers_what_is_found():
    field = pii.SemiMarkov(pii.trained())
    text = "a +1 (504) 555-2652 4111 1111 1111 1111 b"
    out = pii.redact(text, pii.find_spans(field, text))
    assert not re.search(r"\d{4}", out) and out.startswith("a [") and out.endswith(" b")


# Ids of other types, ties and repeated rows in the classifier; scores as plain dot products.


def _graded(spark, kind):
    texts = ["good plain words of a story told well"] * 6 + ["@@@ buy buy !!! 777 <<>>"] * 6 + ["good words", "buy !!!", None, ""]
    docs = spark.createDataFrame([(kind(k), f"{t} {k % 5}" if t else t, "y", 0.5) for k, t in enumerate(texts)] + [(kind(0), texts[0], "y", 0.5)] * 2, f"doc_id {'string' if kind is str else 'int' if kind is int else 'bigint'}, text string, y string, slots double")
    return docs, spark.createDataFrame([(k, int(k < 6)) for k in range(12)] + [(3, 1)], "doc_id bigint, quality int")


def test_quality_takes_ids_of_any_type(spark):
    tune(spark)
    scores = []
    for kind in (str, int, lambda k: k):
        docs, labels = _graded(spark, kind)
        model = quality.fit_quality(docs, labels)
        rows = quality.score_quality(docs, model).collect()
        assert len(rows) == 18 and all(0 <= r.score <= 1 for r in rows)
        for r in rows:
            slots, values = quality.features(r.text or "")
            plain = 1 / (1 + math.exp(-(sum(float(model.weights[s]) * v for s, v in zip(slots.tolist(), values.tolist())) + model.bias)))
            assert r.score == pytest.approx(plain, abs=1e-5)
        by = {str(r.doc_id): r.score for r in rows}
        assert by["12"] > by["13"] and by["14"] == by["15"]
        scores.append(len(by))
    assert scores == [16] * 3
    empty = quality.score_quality(docs.limit(0), quality.fit_quality(docs.limit(0), labels))
    assert empty.collect() == []


def test_the_quality_stage_takes_ids_of_any_type(spark, tmp_path):
    for kind in (str, int):
        docs, labels = _graded(spark, kind)
        folder = tmp_path / kind.__name__
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.quality(spark, docs, str(folder))
        assert out.columns == docs.columns and 0 < out.count() < 18


def test_token_files_are_named_by_uri(spark, tmp_path):
    docs = spark.createDataFrame([(k % 7, f"text {k}", 1) for k in range(40)] + [(3, "same", 1)] * 3, "doc_id long, text string, start int")
    for folder in (f"{tmp_path}/bare", f"file:{tmp_path}/short", f"file://{tmp_path}/whole"):
        made = packed_ids.write_ids(docs, WORD, 2, folder)
        names = [r.file for r in packed_ids.manifest(spark, made).collect()]
        assert names and all(n.startswith("file:") for n in names)
        back = packed_ids.read_ids(spark, made).orderBy("start").collect()
        assert len(back) == 43 and [r.doc_id for r in back] == sorted(r.doc_id for r in back)
        assert [r.start for r in back] == list(np.cumsum([0] + [r.n_tokens for r in back])[:-1])
