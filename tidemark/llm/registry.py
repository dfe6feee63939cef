"""The subpackage's queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chat import CONTROL, MARKS, format_conversations, read_back
from tidemark.llm.codec import encode_decode
from tidemark.llm.common import fold_column, table, tune
from tidemark.llm.decontaminate import find_items
from tidemark.llm.fim import fill_in_middle, restore
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.negatives import hard_negatives
from tidemark.llm.packed_ids import read_ids, write_ids
from tidemark.llm.pii import KINDS, find_personal_data, joined
from tidemark.llm.quality import fit_quality, score_quality
from tidemark.llm.sharding import shard_documents
from tidemark.llm.token_count import token_counts
from tidemark.llm.urls import Rule, judge_urls
from tidemark.llm.vectors import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEEP_SCORE = 0.3
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn

RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    tokenizer = public_tokenizers.path(BYTE_BPE)
    return read_back(format_conversations(rows.union(more), tokenizer), tokenizer)


@query
def op2_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


@query
def op4_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold_column("doc_id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"),
    )


@query
def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2)
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email and so on count base spans; n_added counts those that the method adds."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


@query
def op10_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256.0)


@query
def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


#: Every pair of equal label, in double precision; components by the least reachable id.
ORACLES["op8_embedding_groups"] = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
), w as (
  select vec_id, label, e, sqrt(list_dot_product(e, e)) as n from v where label is not null and e is not null
), p as (
  select a.vec_id as a, b.vec_id as b from w a join w b on a.label = b.label and a.vec_id <> b.vec_id
  where a.n > 0 and b.n > 0 and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93
), r(id, c) as (
  select vec_id, vec_id from embeddings
  union
  select p.b, r.c from r join p on p.a = r.id where r.c < p.b
)
select e.vec_id, (select count(*) from p where p.a = e.vec_id) as n_links, m.c as component_id, e.vec_id = m.c as kept
from embeddings e join (select id, min(c) as c from r group by id) m on m.id = e.vec_id
"""


_CONTROLS = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL)
_SHOWN = " + ".join(f"len({c}) + len(regexp_extract_all({c}, '{_CONTROLS}'))" for c in ("role", "text"))
#: Read back, a conversation is what went in; an escape adds a character to each control string.
ORACLES["op1_chat_format"] = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{CONTROL_TEXT}' union all select -7, 1, 'assistant', '{CONTROL_TEXT}'
), x as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
   coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '') as loss, cast(sum({_SHOWN} + {sum(map(len, MARKS))}) as bigint) as formatted_chars
  from c group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, len(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from x
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of one set are one class; classes that share a shingle are compared by counting what they share.
ORACLES["op10_minhash_groups"] = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
   else list_sort(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')))) end as sh from w
), k as (
  select min(doc_id) as rep, sh, len(sh) as n, md5(array_to_string(sh, chr(10))) as h from s group by sh
), d as (
  select rep, n, unnest(sh) as x from k
), p as (
  select a.rep as a, b.rep as b from d a join d b using (x) where a.rep < b.rep group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), l as (
  select a, b from p union all select b, a from p
), r(id, c) as (
  select rep, rep from k where n > 0 union select l.b, r.c from r join l on l.a = r.id where r.c < l.b
), m as (
  select id, min(c) as c from r group by id
)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, case when len(s.sh) = 0 then s.doc_id else m.c end as component_id, case when len(s.sh) = 0 then true else s.doc_id = m.c end as kept
from s join k on k.h = md5(array_to_string(s.sh, chr(10))) and k.n = len(s.sh) left join m on m.id = k.rep
"""

_HEX = [f"cast('0x' || substr(h, {8 * k + 1}, 8) as bigint)" for k in range(4)]
#: Lines as a list; two places in it cut prefix and middle off.
ORACLES["op13_fill_in_middle"] = rf"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as ls, sha256('7:' || doc_id) as h from documents
), c as (
  select *, len(ls) as n, {_HEX[0]} % (len(ls) + 1) as a, {_HEX[1]} % (len(ls) + 1) as b, {_HEX[2]} % 100 as u, {_HEX[3]} % 100 as v from t
), p as (
  select doc_id, text, n, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or u >= 100 then 'plain' when v < 50 then 'spm' else 'psm' end as form,
   array_to_string(ls[1 : least(a, b)], '') as pre, array_to_string(ls[least(a, b) + 1 : greatest(a, b)], '') as mid, array_to_string(ls[greatest(a, b) + 1 :], '') as suf from c
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then len(pre) end as prefix_chars, case when form <> 'plain' then len(mid) end as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256
from p
"""

#: Cells by shares of lesser values; the curve by Skilling's steps over the cells that occur; runs of equal counts.
ORACLES["op12_hilbert_shards"] = """
with recursive crc_table as (
  select list(v order by i) as crcs from (
   select i, list_reduce(range(0, 8), lambda v, b: case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, i) as v from range(0, 256) t(i))
), d as (
  select doc_id, cast(strlen(coalesce(text, '')) + 16 as bigint) as size, text, lang, source from documents
), v as (
  select doc_id, size, text, cast((rank() over (order by lang nulls first) - 1) * 32 // count(*) over () as bigint) as c0,
   cast((rank() over (order by source nulls first) - 1) * 32 // count(*) over () as bigint) as c1, cast((rank() over (order by size) - 1) * 32 // count(*) over () as bigint) as c2 from d
), s as (
  select k, cast(2 ** (4 - k // 3) as bigint) as q, k % 3 as i from range(0, 12) r(k)
), w(k, c0, c1, c2, x, y, z) as (
  select distinct cast(0 as bigint), c0, c1, c2, c0, c1, c2 from v
  union all
  select w.k + 1, c0, c1, c2,
   case when (case s.i when 0 then x when 1 then y else z end) & q <> 0 then xor(x, q - 1) else xor(x, xor(x, case s.i when 0 then x when 1 then y else z end) & (q - 1)) end,
   case when s.i = 1 and y & q = 0 then xor(y, xor(x, y) & (q - 1)) else y end, case when s.i = 2 and z & q = 0 then xor(z, xor(x, z) & (q - 1)) else z end
  from w join s on s.k = w.k
), g as (
  select c0, c1, c2, x, xor(x, y) as y, xor(xor(x, y), z) as z from w where k = 12
), f as (
  select c0, c1, c2, xor(x, t) as x, xor(y, t) as y, xor(z, t) as z from (
   select *, xor(xor(case when z & 16 > 0 then 15 else 0 end, case when z & 8 > 0 then 7 else 0 end), xor(case when z & 4 > 0 then 3 else 0 end, case when z & 2 > 0 then 1 else 0 end)) as t from g)
), h as (
  select c0, c1, c2, cast(list_sum(list_transform(range(0, 5), lambda b: ((x >> b) % 2 * 4 + (y >> b) % 2 * 2 + (z >> b) % 2) * 8 ** b)) as bigint) as curve from f
), p as (
  select doc_id, size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: cast('0x' || b as bigint)),
   lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) as text_crc32, curve
  from v join h using (c0, c1, c2), crc_table
), r as (
  select *, row_number() over (order by curve, text_crc32, size, doc_id) - 1 as r, count(*) over () as n from p
)
select doc_id, size, text_crc32, 'rows' as law, cast(r * 40 // n as int) as shard, cast(r - (r * 40 // n * n + 39) // 40 as bigint) as slot, cast(null as int) as grown_shard from r
"""

#: Each anchor with every row: exact scores, first positives, first rows of its bands.
ORACLES["op11_hard_negatives"] = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding,
   list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, c.vec_id as other_id, a.label = c.label as same, cast(list_dot_product(cast(a.q as double[]), cast(c.q as double[])) as bigint) as score
  from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id
), p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
), n as (
  select p.*, s.other_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.other_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
