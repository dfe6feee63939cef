"""Operators do the whole job: no cap on rows, no filter that thins them out."""

from tests.plain import louvain
from tidemark.operators.graph import communities
from tidemark.plans.registry import QUERIES, load

load()


def _modularity(edges, label):
    total, inside, sums = sum(2 * w for _, _, w in edges), 0.0, {}
    for a, b, w in edges:
        inside += 2 * w * (label[a] == label[b])
        for n in (a, b):
            sums[label[n]] = sums.get(label[n], 0.0) + w
    return inside / total - sum((s / total) ** 2 for s in sums.values())


def test_communities_keep_every_edge_and_node(spark):
    size, groups = 10, 80  # 3,600 edges in cliques, more than the former cap, and light bridges between them
    cliques = [(g * size + i, g * size + j, 4.0 - g % 3) for g in range(groups) for i in range(size) for j in range(i + 1, size)]
    edges = cliques + [(g * size, (g + 1) * size, 0.5) for g in range(groups - 1)]
    nodes = spark.createDataFrame([(n,) for n in range(groups * size + 3)], "node bigint")
    got = {r.node: r.community for r in communities(nodes, spark.createDataFrame(edges, "a bigint, b bigint, w double")).collect()}
    assert set(got) == set(range(groups * size + 3)) and all(got[n] == n for n in range(groups * size, groups * size + 3))
    assert all(got[a] == got[b] for a, b, _ in cliques)
    assert _modularity(edges, got) > _modularity(edges, louvain(edges)) - 0.01


def test_louvain_covers_every_wallet(spark, sf_dir):
    wallets = QUERIES["behavioural_edges"](spark, sf_dir).selectExpr("explode(array(a, b)) as node").distinct().count()
    got = QUERIES["louvain_communities"](spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type <> 'signup' and user_id is not null")
    assert got.count() == events.select("user_id").distinct().count() > wallets


def _fills(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey as tx_hash", "cast(l_linenumber as bigint) as evt_index").distinct()


def test_every_fill_has_a_decile(spark, sf_dir):
    got = QUERIES["rank_deciles"](spark, sf_dir)
    assert got.count() == _fills(spark, sf_dir).count()
    assert {r.decile for r in got.select("decile").distinct().collect()} == set(range(10))


def test_every_block_has_a_time_and_every_fill_is_labelled(spark, sf_dir):
    fills = _fills(spark, sf_dir)
    times = QUERIES["block_time_map"](spark, sf_dir)
    assert times.where("sec is not null").count() == fills.select("tx_hash").distinct().count()
    months = QUERIES["block_month_asof"](spark, sf_dir)
    assert months.count() == fills.count()


def test_registries_and_names_are_whole(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    ids = read("supplier").selectExpr("s_suppkey as id").union(read("customer").selectExpr("c_custkey")).distinct().count()
    assert QUERIES["registry_verify"](spark, sf_dir).count() == ids
    names = QUERIES["string_functions"](spark, sf_dir).selectExpr("sum(size(split(names, '[|]'))) as n").first().n
    assert names == read("part").count()


