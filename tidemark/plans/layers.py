"""Queries on reading and writing: trees of files, drifting schemas, partitions, layers, logs, chunks that grow.

Each writes what it reads to the shared folder first, so that its rows can be held against SQL on the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.primitives import interval_gaps, merged_intervals
from tidemark.plans.base_sql import fills_sql, raw_sql
from tidemark.plans.registry import query
from tidemark.sources import chain, readers, sinks
from tidemark.sources.adapters import fills, raw_fills, table, written_fills
from tidemark.sources.store import new_path

_CUSTOMER = "c_custkey as id, c_nationkey as nation, c_mktsegment as segment"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_nationkey as nation", "c_mktsegment as segment")


@query(f"select {_CUSTOMER} from customer")
def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every Parquet file below a folder of folders."""
    path, rows = new_path(spark, "tree"), _customers(spark, sf_dir)
    for k in range(3):
        sinks.write_parquet(rows.where(F.col("id") % 3 == k), f"{path}/part {k}/deep")
    return readers.parquet_tree(spark, path)


@query(f"select {_CUSTOMER} from customer where c_custkey % 10 between 3 and 6")
def scan_file_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of the sorted file list, as chunked jobs take it (S03): the fourth to the seventh of ten."""
    path = new_path(spark, "slice")
    _customers(spark, sf_dir).withColumn("file", F.col("id") % 10).repartition("file").write.partitionBy("file").parquet(path)
    return readers.parquet_files(spark, [f"{path}/file={k}" for k in (7, 3, 9, 1, 0, 2, 8, 4, 6, 5)], 3, 7)


@query("select id, nation, balance from (select c_custkey as id, c_nationkey as nation, null::double as balance from customer union all select s_suppkey, s_nationkey, s_acctbal from supplier)")
def scan_drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two schemas read as one, by name."""
    path = new_path(spark, "drift")
    sinks.write_parquet(_customers(spark, sf_dir).select("id", "nation"), f"{path}/a")
    sinks.write_parquet(table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_nationkey as nation", "s_acctbal as balance"), f"{path}/b")
    return readers.parquet_drifting(spark, f"{path}/*").select("id", "nation", "balance")


@query("select p_size as k, count(*) as n, min(p_partkey) as first_part from part where p_size between 10 and 20 group by 1")
def scan_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition folders, sorted inside (K02), read back with their key, which prunes folders."""
    path = new_path(spark, "hive")
    sinks.write_partitioned(table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size as bigint) as k"), path, "k", ["p_partkey"])
    found = readers.parquet_partitioned(spark, path).withColumn("k", F.col("k").cast(table(spark, sf_dir, "part").schema["p_size"].dataType))
    return found.where("k between 10 and 20").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))


@query("select id, nation, segment, source from (select c_custkey as id, c_nationkey as nation, c_mktsegment as segment, 'customer' as source from customer union all select s_suppkey, s_nationkey, null, 'supplier' from supplier)")
def layers_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of unlike columns in one table, padded with nulls, each row tagged with its layer."""
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_nationkey as nation")
    return readers.union_layers({"customer": _customers(spark, sf_dir), "supplier": suppliers}).select("id", "nation", "segment", "source")


@query("select id, c_name as name from (select unnest([3, 1, 4, 1, 5, 9, 2, 6]) as id) left join customer on c_custkey = id")
def list_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list bound as a parameter, one row an element, repeats kept."""
    ids = readers.parameter_rows(spark, [3, 1, 4, 1, 5, 9, 2, 6], "id").withColumn("id", F.col("id").cast("int"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return ids.join(names, F.col("id") == F.col("key"), "left").select("id", "name")


@query("select c.c_mktsegment as segment, n.r as class, count(*) as n from customer c join (select lower(trim(x)) as s, min(y) as r from (values (' Building', 'b'), ('AUTOMOBILE ', 'a'), ('building', 'z'), ('Machinery', 'm')) t(x, y) group by 1) n on lower(c.c_mktsegment) = n.s group by 1, 2")
def dictionary_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary kept as CSV, its keys stripped and lower-cased (S10), joined to rows."""
    path = new_path(spark, "dictionary")
    rows = [(" Building", "b"), ("AUTOMOBILE ", "a"), ("building", "z"), ("Machinery", "m")]
    spark.createDataFrame(rows, "tag string, class string").coalesce(1).write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    found = readers.dictionary_csv(spark, path, "tag", "class")
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"))
    return segments.join(found, F.lower("segment") == F.col("tag")).groupBy("segment", "class").agg(F.count(F.lit(1)).alias("n"))


@query("select n_nationkey % 5 as page, n_nationkey as key, n_name as name from nation")
def replayed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages kept as JSON lines, replayed instead of fetched (S11, S18): a page that is there is not asked for again."""
    path, nation = new_path(spark, "pages"), table(spark, sf_dir, "nation")
    pages = nation.select((F.col("n_nationkey") % 5).alias("page"), F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("item"))
    pages.groupBy("page").agg(F.collect_list("item").alias("items")).write.json(path)
    kind = table(spark, sf_dir, "nation").schema["n_nationkey"].dataType.simpleString()
    found = readers.json_pages(spark, path, f"page {kind}, items array<struct<key:{kind},name:string>>")
    return found.select("page", F.explode("items").alias("item")).select("page", "item.key", "item.name")


@query("select p_partkey as id from part order by md5(cast(p_partkey as varchar) || '42'), p_partkey limit 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty parts in a fixed pseudo-random order: the reservoir's stand-in."""
    return readers.seeded_sample(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), "id", 50, "42")


_HEX = lambda c: F.lpad(F.lower(F.hex(F.col(c).cast("bigint"))), 64, "0")
_WHO = lambda c: F.concat(F.lit("0x"), _HEX(c))


def _log(tape: DataFrame, words: list[str], kind: str | Column = "fill") -> DataFrame:
    topics = F.array(F.lit(kind), _WHO("tx_hash"), _WHO("maker"), _WHO("taker"))
    return tape.select(F.col("sec").alias("block_number"), F.col("tx_hash").cast("string").alias("tx_hash"), "evt_index", topics.alias("topics"), F.concat(F.lit("0x"), *map(_HEX, words)).alias("data"))


_ADDR = "'0x' || lpad(printf('%x', {0}), 40, '0')"


@query(fills_sql(f"""select cast(tx_hash as varchar) as tx_hash, evt_index, {_ADDR.format('maker')} as maker, {_ADDR.format('taker')} as taker, side as maker_side, cast(token_id + 1 as varchar) as token_id, round(pc / 100.0, 9) as price, round(q::double, 6) as shares from f"""))
def decoded_logs_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event logs of 32-byte words, decoded (S23) and normalised (S29): the maker who gives asset 0 buys."""
    buys = F.col("side") == "BUY"
    usdc, shares = F.col("cents") * 10_000, F.col("q") * 1_000_000
    pick = lambda a, b: F.when(buys, a).otherwise(b)
    zero, token = F.lit(0), F.col("token_id") + 1
    tape = fills(spark, sf_dir).withColumns({"w0": pick(zero, token), "w1": pick(token, zero), "w2": pick(usdc, shares), "w3": pick(shares, usdc), "w4": zero})
    out = chain.normalise_fills(chain.decode_fills_v1(_log(tape, ["w0", "w1", "w2", "w3", "w4"])))
    return out.select("tx_hash", "evt_index", "maker", "taker", "maker_side", "token_id", F.round("price", 9).alias("price"), F.round("shares", 6).alias("shares"))


@query(fills_sql(f"""select cast(tx_hash as varchar) as tx_hash, evt_index, event, case when event = 'fee' then null else side end as side, case when event = 'fee' then null else cast(token_id as varchar) end as token_id, case when event = 'fee' then null else round(pc / 100.0, 9) end as price, cast(fee as varchar) as fee_raw from f, (select unnest(['fill', 'match', 'fee']) as event) where (event = 'match') <= is_taker and (event = 'fee') <= fee_paying"""))
def decoded_logs_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of event (S24): fills, matched orders and fees; amounts swap their meaning between buying and selling."""
    buys = F.col("side") == "BUY"
    usdc, shares = F.col("cents") * 10_000, F.col("q") * 1_000_000
    tape = fills(spark, sf_dir).withColumns({
        "w0": F.when(buys, 0).otherwise(1), "w1": F.col("token_id"), "w2": F.when(buys, usdc).otherwise(shares), "w3": F.when(buys, shares).otherwise(usdc), "w4": F.col("fee"),
    })
    kinds = F.array_compact(F.array(F.lit("fill"), F.when(F.col("is_taker"), "match"), F.when(F.col("fee_paying"), "fee")))
    logs = _log(tape, ["w0", "w1", "w2", "w3", "w4"], F.array_join(kinds, ",")).withColumn("kind", F.explode(F.split(F.col("topics")[0], ",")))  # words are written once for all kinds
    data = F.when(F.col("kind") == "fee", F.concat(F.lit("0x"), F.right("data", F.lit(64)))).otherwise(F.col("data"))  # a fee has its last word only
    logs = logs.withColumns({"data": data, "topics": F.array("kind", *[F.col("topics")[k] for k in (1, 2, 3)])})
    out = chain.decode_events_v2(logs, {"fill": "fill", "match": "match", "fee": "fee"})
    return out.select("tx_hash", "evt_index", "event", "side", "token_id", F.round("price", 9).alias("price"), "fee_raw")


@query("select p_partkey as condition_id, case when a > b then 0 when b > a then 1 end as winner, case when (a = 1 and b = 0) or (a = 0 and b = 1) then true else false end as clean from (select p_partkey, p_partkey % 3 as a, p_size % 3 as b from part)")
def resolved_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners from payout vectors, by strict majority (S25), and whether the vector is one of the two clean ones."""
    pay = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("condition_id"), F.array((F.col("p_partkey") % 3).cast("bigint"), (F.col("p_size") % 3).cast("bigint")).alias("payouts"))
    clean = F.array_contains(F.array(*[F.array(*[F.lit(x).cast("bigint") for x in v]) for v in ((1, 0), (0, 1))]), F.col("payouts"))
    return pay.select("condition_id", chain.winner_of(F.col("payouts")).alias("winner"), clean.alias("clean"))


@query("select p_partkey as condition_id, cast(pos - 1 as int) as outcome_index, nullif(tag, '') as token_id from (select p_partkey, unnest(tags) as tag, generate_subscripts(tags, 1) as pos from (select p_partkey, string_split(p_name, ' ') as tags from part where p_size > 25)) union all select p_partkey, null, null from part where p_size <= 25")
def market_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a token; a market without tokens keeps one row."""
    markets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("condition_id"), F.when(F.col("p_size") > 25, F.split("p_name", " ")).alias("tokens"))
    return readers.token_rows(markets)


@query(fills_sql("select condition_id, cast(token_id as varchar) as token, 'w' || taker as wallet, cast(sum(q) as double) as amount from f group by 1, 2, 3"))
def token_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holders nested by token in a response, flattened."""
    per = fills(spark, sf_dir).groupBy("condition_id", "token_id", "taker").agg(F.sum("q").alias("q"))
    holder = F.struct(F.concat(F.lit("W"), F.col("taker")).alias("wallet"), F.col("q").cast("string").alias("amount"))
    tokens = per.groupBy("condition_id", "token_id").agg(F.collect_list(holder).alias("holders"))
    pages = tokens.groupBy("condition_id").agg(F.collect_list(F.struct(F.col("token_id").cast("string").alias("token"), "holders")).alias("tokens"))
    return readers.holder_rows(pages)


@query("select cast(o_orderkey as varchar) as id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000000Z') as placed, '[' || o_orderkey % 7 || ',' || o_custkey || ']' as tags from orders")
def exported_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with ISO-8601 UTC times and lists as JSON (K04), read back as text."""
    path, orders = new_path(spark, "csv"), table(spark, sf_dir, "orders")
    sinks.write_csv(orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("placed"), F.array(F.col("o_orderkey") % 7, "o_custkey").alias("tags")), path)
    return spark.read.option("header", "true").option("escape", '"').csv(path)


@query(fills_sql("select token_id % 6 as bucket, count(*) as n, cast(sum(cents) as bigint) as cents from f group by 1"))
def resumed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job in buckets that is stopped and resumed (K07, K08): finished buckets stand, an unfinished one is done again."""
    path, tape = new_path(spark, "buckets"), written_fills(spark, sf_dir, "token_id", "cents").withColumn("bucket", F.col("token_id") % 6)
    job = lambda k: tape.where(F.col("bucket") == k).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    sinks.write_buckets(spark, {k: job(k) for k in range(3)}, path)
    sinks.write_buckets(spark, {k: job(k) for k in range(6)}, path)
    return readers.parquet_tree(spark, path)


@query("select id, nation, segment from (select c_custkey as id, c_nationkey as nation, c_mktsegment as segment from customer where c_custkey % 4 > 0 union all select c_custkey, c_nationkey + 100, 'new' from customer where c_custkey % 4 = 0)")
def grown_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus that grows: a fresh row takes the place of the old one of its key."""
    old = _customers(spark, sf_dir)
    fresh = old.where("id % 4 = 0").withColumns({"nation": F.col("nation") + 100, "segment": F.lit("new")})
    kinds = dict(old.dtypes)
    return sinks.grown(old, fresh.withColumn("nation", F.col("nation").cast(kinds["nation"])), ["id"]).select("id", "nation", "segment")


@query("select k, min(p_partkey) as p_partkey from (select p_partkey, coalesce(nullif(case when p_size % 2 = 0 then '' else p_name end, ''), p_type) as k from part) group by 1")
def consolidated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part files as one table, one row a coalesced key; an empty string counts as missing."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")).alias("token"), F.col("p_type").alias("cond"))
    key = F.coalesce(F.nullif("token", F.lit("")), "cond")
    return sinks.consolidated(part, ["token", "cond"], ["p_partkey"]).select(key.alias("k"), "p_partkey")


@query(raw_sql("select tx_hash, evt_index, sec, pc, q from raw where tx_hash between 1000 and 1999 and pc > 0 and pc < 100 and q > 0 and builder in (0, 2)"))
def tape_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical tape predicate (P11) within a range of blocks (P10): the range reaches the scan as pushed filters."""
    return readers.canonical(readers.block_range(raw_fills(spark, sf_dir), "tx_hash", 1000, 1999), exchanges=(0, 2)).select("tx_hash", "evt_index", "sec", "pc", "q")


@query(fills_sql("select tx_hash, evt_index, condition_id, outcome_index = winner as won from f where pc between 1 and 99 and winner is not null and condition_id in (select condition_id from f group by 1 having max(sec) - min(sec) > 86400) and side = 'BUY'"))
def resolved_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buys at open prices in resolved markets that lived for more than a day."""
    tape = fills(spark, sf_dir)
    lived = tape.groupBy("condition_id").agg((F.max("sec") - F.min("sec")).alias("span")).where("span > 86400")
    return readers.resolved(tape).where("side = 'BUY'").join(lived, "condition_id", "left_semi").select("tx_hash", "evt_index", "condition_id", (F.col("outcome_index") == F.col("winner")).alias("won"))


@query(fills_sql("select m.condition_id, w.k as window_id from (select condition_id, min(sec) as lo, max(sec) as hi from f group by 1) m join (select k, 694224000 + k * 31536000 as a, 694224000 + (k + 1) * 31536000 as b from (select unnest(range(0, 8)) as k)) w on m.lo < w.b and m.hi >= w.a"))
def alive_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets alive in each of eight windows of a year (J21): the windows that a life spans are listed, not joined by range."""
    life = fills(spark, sf_dir).groupBy("condition_id").agg(F.min("sec").alias("lo"), F.max("sec").alias("hi"))
    index = lambda c: F.expr(f"floor(({c} - 694224000) / 31536000)")
    within = F.sequence(F.greatest(index("lo"), F.lit(0)), F.least(index("hi"), F.lit(7)))
    return life.where((index("hi") >= 0) & (index("lo") <= 7)).select("condition_id", F.explode(within).alias("window_id"))


@query(fills_sql("select r.id, count(*) as n, cast(sum(f.cents) as bigint) as cents from f join (select condition_id as id, condition_id * 2 as t0, condition_id * 2 + 1 as t1 from (select distinct condition_id from f)) r on f.token_id = r.t0 or f.token_id = r.t1 group by 1"))
def either_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on either of two listed tokens (J15): the list is exploded, so it is an equi-join."""
    tape = fills(spark, sf_dir)
    ids = tape.select("condition_id").distinct().select(F.col("condition_id").alias("id"), F.explode(F.array(F.col("condition_id") * 2, F.col("condition_id") * 2 + 1)).alias("token_id"))
    return tape.join(ids, "token_id").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query(raw_sql("select lo, hi from (select min(lo) as lo, max(hi) as hi from (select *, sum(new) over (order by lo, hi rows unbounded preceding) as k from (select *, case when lo > coalesce(max(hi) over (order by lo, hi rows between unbounded preceding and 1 preceding), -1) + 1 then 1 else 0 end as new from iv)) group by k)", "iv as (select distinct tx_hash // 50 * 50 as lo, tx_hash // 50 * 50 + 20 as hi from raw)"))
def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of blocks merged where they touch."""
    chunks = raw_fills(spark, sf_dir).selectExpr("tx_hash div 50 * 50 as lo", "tx_hash div 50 * 50 + 20 as hi").distinct()
    return merged_intervals(chunks, [], "lo", "hi").select("lo", "hi")


@query("select 'big' as name, count(*) as n_rows, cast(2 as bigint) as n_columns from part where p_size > 25 union all select 'small', count(*), 3 from part where p_size <= 25")
def bundle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of two groups with its manifest (K06), as the manifest says."""
    part = table(spark, sf_dir, "part")
    groups = {"big": part.where("p_size > 25").select("p_partkey", "p_name"), "small": part.where("p_size <= 25").select("p_partkey", "p_name", "p_size")}
    return sinks.write_bundle(groups, new_path(spark, "bundle"), "Parts by size").select("name", "n_rows", "n_columns")
