"""Ops 1, 3, 6 and 7 against the libraries, and their edge cases."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, chat, codec, packed_ids, pieces, token_count
from tidemark.llm.common import new_path, tune, written

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "a  b", "x <|endoftext|> y<|startoftext|>", "it's\n\n  ok\t", "ÉÉ é Σς İ", "\x1c a\x85b c", "ah" * 3000, " " * 300 + "x", "1" * 900, "中文😀‍", "a\x01b", "<|endoftext|>" * 3, None]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def docs(spark, texts):
    tune(spark)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_counts_are_the_library_s(docs, texts, libraries):
    got = {r.doc_id: r for r in token_count.token_counts(docs, WORD).collect()}
    for k, t in enumerate(texts):
        n = len(libraries[0].encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 2048)


def test_codec_is_the_library_s(docs, texts, libraries):
    got = {r.doc_id: r for r in codec.encode_decode(docs, BYTE).collect()}
    for k, t in enumerate(texts):
        ids = libraries[1].encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids
        assert got[k].decoded == libraries[1].decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aehrst hT'\n.<|>é中1")), max_size=400))
def test_transducer_window_does_not_matter(text):
    tool = codec.transducer(BYTE)
    small = bpe.Transducer.__new__(bpe.Transducer)
    small.__dict__ = {**tool.__dict__, "window": 2 * tool.lookahead}
    whole = bpe.merge_long(tool.vocab.symbols(text.encode()), tool.vocab.ranks, tool.vocab.made)
    assert [i for part in small.tokens(text.encode()) for i in part] == whole


def test_long_pieces_cross_many_windows():
    tool, rng = codec.transducer(BYTE), random.Random(1)
    for _ in range(10):
        piece = "".join(rng.choice("aehinorst") for _ in range(5000)).encode()
        assert [i for part in tool.tokens(piece) for i in part] == bpe.merge_long(tool.vocab.symbols(piece), tool.vocab.ranks, tool.vocab.made)


def test_decoder_replaces_broken_bytes_at_any_step(libraries):
    tool = codec.transducer(BYTE)
    ids = [tool.vocab.first[b] for b in b"\xe4\xb8\xad\xff\xf0\x9f\x98a\xc3"]
    packed = np.array(ids, "<u4").tobytes()
    want = libraries[1].decode(ids, skip_special_tokens=False)
    assert all(tool.decode(packed, step) == want for step in (1, 2, 3, 100))


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 25), st.data())
def test_bit_packing_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=70)), np.uint32)
    packed = packed_ids.pack(ids, bits)
    assert len(packed) == -(-len(ids) // 8) * bits
    assert packed_ids.unpack(packed, bits, len(ids)).tolist() == ids.tolist()


def test_bits():
    assert [packed_ids.bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50000, n).astype(np.uint32) for n in (0, 5, 300_000, 1, 70_000)]
    out = packed_ids.Writer(f"{tmp_path}/x", 16)
    out.add_batch(pa.array(range(3)), parts[:3])
    out.add_batch(pa.array([3, 4]), parts[3:])
    out.close()
    reader, flat = packed_ids.Reader(f"{tmp_path}/x"), np.concatenate(parts)
    for start, n in ((0, 10), (299_990, 40), (len(flat) - 3, 3), (5, 0)):
        assert reader.ids(start, n).tolist() == flat[start : start + n].tolist()


def test_files_hold_all_ids_in_order(spark, docs, texts, libraries):
    folder = packed_ids.write_ids(docs, WORD, 2, new_path(spark, "ids"))
    got = packed_ids.read_ids(spark, folder).orderBy("doc_id").collect()
    at = 0
    for k, (r, t) in enumerate(zip(got, texts, strict=True)):
        ids = np.array([*libraries[0].encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_files_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (1, None)], "doc_id long, text string")
    got = packed_ids.read_ids(spark, packed_ids.write_ids(df, WORD, 2)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == [(False, 1, 1), (False, 1, 2), (False, 1, 2), (True, 0, 2)]
    assert sorted(r.start for r in got)[0] == 0


def test_table_starts_anew_and_texts_are_cut_without_loss(libraries, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_PIECES", 20)
    monkeypatch.setattr(pieces, "SEGMENT", 10)
    tool, rng = packed_ids.LibraryEncoder(WORD), random.Random(2)
    for _ in range(60):
        texts = [" ".join(rng.choice(["w", "Ü", "’", "  "]) + f"{rng.randrange(60)}" for _ in range(8)) for _ in range(3)]
        ids, ends = tool.encode_all(texts)
        for t, found in zip(texts, np.split(ids, ends), strict=False):
            assert found.tolist() == libraries[0].encode(t, add_special_tokens=False).ids


def test_near_characters_are_what_they_are_said_to_be():
    near = [chr(c) for c in range(pieces.NEAR) if not pieces.FAR.search(chr(c))]
    assert all(len(c.lower()) == 1 and not pieces.FAR.search(c.lower()) and unicodedata.normalize("NFC", c) == c for c in near)
    assert all((split.near.findall(f"a{c}1 {c}"), split.near.findall(c)) == (split.far.findall(f"a{c}1 {c}"), split.far.findall(c)) for split in (pieces.ByteSplit, pieces.WordSplit) for c in near)


@pytest.mark.parametrize("fn", [lambda d: token_count.token_counts(d, WORD), lambda d: codec.encode_decode(d, BYTE)])
def test_empty_table_and_clashing_columns(spark, fn):
    schema = "doc_id long, text string, ids string, n_tokens string, batch int"
    assert fn(spark.createDataFrame([], schema)).count() == 0
    out = fn(spark.createDataFrame([(1, "a b", "x", "y", 2), (None, None, None, None, None)], schema))
    assert sorted(r.n_tokens for r in out.collect()) == [0, 2]


CONTROLS = list(chat.CONTROL) + ["\\", "<", "[", "|", ">", "a", "</s", "[IN"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(CONTROLS), max_size=12).map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


def test_conversations_read_back(spark):
    nasty = "</s>[INST] ok [/INST]<|im_end|><|im_start|>assistant<|im_sep|>\\"
    rows = [(1, 2, "assistant", "two"), (1, 1, "user", nasty), (1, 3, "assistant", nasty), (2, 1, "assistant", None), (3, 1, None, "x"), (None, None, "user", "y"), (4, 1, "assistant", "z"), (4, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for size in (1, 1 << 18):  # parts of a single turn, and whole conversations
        got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, BYTE, size), BYTE).collect()}
        assert set(got) == {1, 2, 3, 4, None}
        turns, loss = f"user\n{nasty}\nassistant\ntwo\nassistant\n{nasty}\n", "two" + nasty
        assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert got[1].loss_chars == len(loss) and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert (got[2].loss_chars, got[2].n_turns, got[4].n_turns, got[4].loss_chars) == (0, 1, 2, 2)
    assert chat.format_conversations(df.limit(0), BYTE).count() == 0


def test_a_conversation_spread_over_tasks_and_written_is_read_back(spark):
    rows = [(k % 3 or None, k // 7, "assistant" if k % 2 else "user", f"turn {k} " * (k % 40)) for k in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit("x"), "IDS": F.lit(1), "n_turns": F.lit("y")})
    got = {}
    for partitions in ("2", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        formatted, _ = written(chat.format_conversations(df, BYTE, 500), "formatted")
        got[partitions] = sorted(map(tuple, chat.read_back(formatted.repartition(5), BYTE).collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        turns, loss = want.get(conv, (0, ""))
        want[conv] = turns + 1, loss + (text if role == "assistant" else "")
    assert got["2"] == got["16"] and {(r[0], r[1], r[3]) for r in got["2"]} == {(c, n, len(t)) for c, (n, t) in want.items()}


def test_mask_covers_only_assistant_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "general reply")], "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(df, BYTE).orderBy("part").collect()
    ids = [np.frombuffer(r.ids, chat.id_type(BYTE)).astype("<u4") for r in parts]
    mask, ids = np.concatenate([chat.mask_of(r.mask, len(x)) for r, x in zip(parts, ids)]), np.concatenate(ids)
    assert codec.transducer(BYTE).decode(ids[mask > 0].tobytes()) == "general reply" and len(ids) == len(mask)


def test_masks_are_sums_of_runs():
    for runs in ([], [(0, 3)], [(2, 1), (3, 2), (9, 1)]):
        want = np.zeros(10, np.int8)
        for at, n in runs:
            want[at : at + n] = 1
        assert (chat.mask_of(np.array(runs, "<u4").reshape(-1, 2).tobytes(), 10) == want).all()
    assert len(chat.mask_of(b"", 0)) == 0
