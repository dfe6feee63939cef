"""Readers, sinks, log decoding and the streaming forms."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import families
from tidemark.sources import chain, readers, sinks
from tidemark.streaming import tapes


def test_parquet_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 3), (1, "y", 1), (2, "z", 2)], "k long, s string, o long")
    sinks.write_partitioned(df, f"{tmp_path}/p", "k", ["o"])
    assert sorted(map(tuple, readers.parquet_partitioned(spark, f"{tmp_path}/p").select("k", "s").collect())) == [(1, "x"), (1, "y"), (2, "z")]
    assert "k" not in readers.parquet_partitioned(spark, f"{tmp_path}/p", False).columns
    assert readers.parquet_tree(spark, f"{tmp_path}/p").count() == 3
    files = glob.glob(f"{tmp_path}/p/*/*.parquet")
    assert readers.parquet_files(spark, files, 0, 1).count() == 2


def test_schema_drift_and_layers(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/d/a")
    spark.range(2).withColumn("x", F.lit(1)).write.parquet(f"{tmp_path}/d/b")
    assert sorted(readers.parquet_drifting(spark, f"{tmp_path}/d/*").columns) == ["id", "x"]
    out = readers.union_layers({"a": spark.range(1), "b": spark.range(1).withColumn("x", F.lit(1))})
    assert sorted((r.source, r.x) for r in out.collect()) == [("a", None), ("b", 1)]


def test_chunk_is_written_once_and_repaired(spark, tmp_path):
    path = f"{tmp_path}/c"
    assert sinks.write_chunk(spark.range(3), path) and not sinks.write_chunk(spark.range(5), path)
    os.remove(f"{path}/_SUCCESS")
    assert sinks.write_chunk(spark.range(5), path) and spark.read.parquet(path).count() == 5


def test_report_csv_and_corpus(spark, tmp_path):
    sinks.write_report({"a": spark.range(2)}, f"{tmp_path}/r.json", ["n"])
    assert json.load(open(f"{tmp_path}/r.json"))["a"] == [{"id": 0}, {"id": 1}]
    with pytest.raises(ValueError):
        sinks.write_report({"a": spark.range(11)}, f"{tmp_path}/r.json", rows=10)
    sinks.write_csv(spark.sql("select timestamp'2024-01-02 03:04:05' as t, array(1, 2) as l"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().l == "[1,2]"
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c")], "k long, v string")
    assert sorted(map(tuple, sinks.grown(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]
    parts = spark.createDataFrame([("t", "c1", 2), ("t", "c1", 1), ("", "c2", 1), (None, "c2", 3)], "token string, cond string, o long")
    assert sorted((r.cond, r.o) for r in sinks.consolidated(parts, ["token", "cond"], ["o"]).collect()) == [("c1", 1), ("c2", 1)]


def test_coercions(spark):
    df = spark.createDataFrame([('["a"]', "t", "1.5"), ("", "No", "x"), (None, None, None)], "l string, b string, d string")
    got = [tuple(r) for r in df.select(readers.string_list(F.col("l")), readers.safe_bool(F.col("b")), readers.safe_double(F.col("d"))).collect()]
    assert got == [(["a"], True, 1.5), ([], False, None), (None, None, None)]


def test_decoding(spark):
    assert chain.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert chain.keccak256(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    word = lambda n: f"{n:064x}"
    who = lambda n: "0x" + "0" * 24 + f"{n:040X}"
    big = 2**255 + 17
    rows = [(1, "h", 0, ["t0", "0xorder", who(10), who(11)], "0x" + "".join(map(word, (0, big, 6_000_000, 10_000_000, 5))))]
    logs = spark.createDataFrame(rows, "block_number long, tx_hash string, evt_index long, topics array<string>, data string")
    r = chain.normalise_fills(chain.decode_fills_v1(logs)).first()
    assert (r.token_id, r.maker_side, r.price, r.maker[-1]) == (str(big), "BUY", 0.6, "a")
    rows = [(1, "h", 0, ["t0", "0xorder", who(10), who(11)], "0x" + "".join(map(word, (1, big, 10_000_000, 4_000_000, 5))))]
    r = chain.decode_fills_v2(spark.createDataFrame(rows, logs.schema)).first()
    assert (r.side, r.price, r.token_id) == ("SELL", 0.4, str(big))
    df = spark.createDataFrame([([1, 0],), ([0, 1],), ([1, 1],), ([1, 0, 0],)], "p array<long>")
    assert [x[0] for x in df.select(chain.winner_of(F.col("p"))).collect()] == [0, 1, None, None]
    for k in (1, 2):
        point = chain.collection_id(b"\x07" * 32, k)
        x = point & ~(1 << 254)
        assert pow((x**3 + 3) % chain.P, (chain.P - 1) // 2, chain.P) == 1


def _stream(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _run(out, name, tmp_path, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.table(name)


@pytest.fixture()
def tape(spark):
    rows = [(i, i % 3, i % 2, "BUY" if i % 4 else "SELL", i % 2, 40 + i % 7, 10 + i % 5, i * 20) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, wallet long, condition_id long, side string, outcome_index long, pc long, size long, s long")
    return df.withColumns({"ts": F.timestamp_seconds(F.col("s") + 1_700_000_000), "asset_id": F.col("condition_id"), "notional": F.col("pc") * F.col("size")})


def test_streams_agree_with_batches(spark, tape, tmp_path):
    twice = tape.union(tape)
    got = _run(tapes.deduplicated(_stream(spark, twice, f"{tmp_path}/in1"), ["event_id"]), "dedup", tmp_path)
    assert got.count() == 200
    stream = _stream(spark, tape, f"{tmp_path}/in2")
    got = _run(tapes.minute_vwap(stream), "vwap", tmp_path, "complete")
    want = tapes.minute_vwap(tape)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = _run(tapes.pressure(stream), "pressure", tmp_path, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tapes.pressure(tape).collect()))
    got = _run(tapes.sessions(stream, "30 seconds"), "sessions", tmp_path, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tapes.sessions(tape, "30 seconds").collect()))


def test_sprt_alerts(spark, tmp_path):
    df = spark.createDataFrame([(1, i, 1) for i in range(60)] + [(2, i, i % 2) for i in range(60)], "condition_id long, seq long, toward int")
    out = _run(tapes.sprt_alerts(_stream(spark, df, f"{tmp_path}/in")), "sprt", tmp_path)
    assert {r.verdict for r in out.where("condition_id = 1").collect()} == {"pressure"}
    assert "pressure" not in {r.verdict for r in out.where("condition_id = 2").collect()}


def test_interval_pairs_of_two_streams(spark, tape, tmp_path):
    buys = tape.where("side = 'BUY'").select("wallet", "asset_id", F.col("event_id").alias("buy_id"), F.col("ts").alias("buy_ts"))
    sells = tape.where("side = 'SELL'").select("wallet", "asset_id", F.col("event_id").alias("sell_id"), F.col("ts").alias("sell_ts"))
    out = tapes.interval_pairs(_stream(spark, buys, f"{tmp_path}/b"), _stream(spark, sells, f"{tmp_path}/s"), "3 minutes", "1 hour")
    got = {(r.buy_id, r.sell_id) for r in _run(out, "pairs", tmp_path).collect()}
    b, s = buys.collect(), sells.collect()
    assert got == {(x.buy_id, y.sell_id) for x in b for y in s if x.wallet == y.wallet and x.asset_id == y.asset_id and abs((x.buy_ts - y.sell_ts).total_seconds()) <= 180} != set()


def test_episodes_as_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k % 3, k % 12, k * 40 + rng.randrange(30), k, 0, rng.choice([18, 20, 22, 25, 25, 25, 30, 32]), rng.randrange(6)) for k in range(1500)]
    rows += [(3, 100, 5, 9000, 0, 50, 1), (3, 101, 6, 9001, 0, 80, 1)]
    tape = spark.createDataFrame(rows, "family long, condition_id long, sec long, tx_hash long, evt_index long, pc long, wallet long")
    want = sorted(map(tuple, families.episodes(families.price_sums(tape, 600, chunk=5000), chunk=7000).collect()))
    size = tape.groupBy("family").agg(F.countDistinct("condition_id").alias("members"))
    ordered = tape.join(size, "family").where("members >= 3").withColumn("seq", F.col("sec") * 100_000 + F.col("tx_hash"))
    got = sorted(map(tuple, _run(tapes.episodes(_stream(spark, ordered, f"{tmp_path}/in"), 600), "episodes", tmp_path).collect()))
    assert got == want and len(want) > 5


def test_paths_are_qualified_by_the_default_file_system(spark, tmp_path):
    from tidemark.sources.store import qualified

    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}" and qualified(spark, f"file://{tmp_path}/a") == f"file:{tmp_path}/a"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://localhost:9")
    try:
        assert qualified(spark, "/shared/x") == "hdfs://localhost:9/shared/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_typed_episodes_survive_a_restart_and_shrink(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k % 2, k % 6, k * 40 + rng.randrange(30), k, rng.choice([28, 30, 33, 35, 36, 40]), rng.randrange(4)) for k in range(400)]
    rows += [(9, 90, rows[-1][2] + 50_000, 5000, 50, 1)]  # far later: the watermark passes all other prices
    tape = spark.createDataFrame(rows, "family long, condition_id long, sec long, tx_hash long, pc long, wallet long")
    want = sorted(map(tuple, families.episodes(families.price_sums(tape.withColumn("evt_index", F.lit(0)), 900, chunk=5000), chunk=7000).collect()))
    ordered = tape.withColumns({"members": F.lit(3), "seq": F.col("sec") * 100_000 + F.col("tx_hash")})
    schema = ordered.schema
    folder, at, out = f"{tmp_path}/in", f"{tmp_path}/at", f"{tmp_path}/out"
    for low, high in ((-1, 3999), (3999, 9999), (9999, 10**9), (10**9, 10**9 + 1)):  # each part is a query of its own that goes on from the checkpoint
        part = ordered.where(f"sec > {low} and sec <= {high}")
        if high > 10**9:
            part = ordered.limit(1).withColumns({"family": F.lit(9).cast("long"), "sec": F.lit(rows[-1][2] + 60).cast("long")})
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = tapes.episodes(spark.readStream.schema(schema).parquet(folder), 900, late="10 seconds")
        stream.writeStream.format("parquet").option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).select("family", "start", "peak", "correctors", "closer", "corrective").collect())) == want and len(want) > 5
    left = spark.read.format("statestore").option("stateVarName", "last").load(at)
    assert {r.key.family for r in left.select("key").collect()} == {9}
