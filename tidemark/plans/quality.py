"""Queries on families, classes, registries, reconciliation and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import classify, families
from tidemark.operators.primitives import global_ntile, interval_gaps, ratio
from tidemark.plans.base_sql import fills_sql, raw_sql
from tidemark.plans.registry import query
from tidemark.sources.adapters import fills, markets, raw_fills, table



@query(fills_sql("select family, count(*) as members, count(*) filter (where winner = 0) as winners, min(first_sec) as first_sec, max(close_sec) as close_sec, array_to_string(list_sort(list(condition_id)), ',') as ids from (select condition_id, max(family) as family, max(winner) as winner, min(sec) as first_sec, max(sec) as close_sec from f group by 1) group by 1"))
def family_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of exclusive markets, with how many of their members won (one, if the map is sound)."""
    return markets(fills(spark, sf_dir)).groupBy("family").agg(
        F.count("*").alias("members"), F.count_if(F.col("winner") == 0).alias("winners"), F.min("first_sec").alias("first_sec"), F.max("close_sec").alias("close_sec"),
        F.array_join(F.transform(F.array_sort(F.collect_set("condition_id")), lambda x: x.cast("string")), ",").alias("ids"),
    )


_FH = "fh as (select family, condition_id, day as hour, arg_max(pc, (sec, tx_hash, evt_index)) as p from f where outcome_index = 0 group by 1, 2, 3)"


@query(fills_sql("""select g.family, g.hour, count(*) as alive, cast(sum(s.p) as bigint) as total from (select distinct family, hour from fh) g join (select *, lead(hour) over (partition by family, condition_id order by hour) as nxt from fh) s
 on g.family = s.family and g.hour >= s.hour and g.hour <= s.hour + 24 and (s.nxt is null or g.hour < s.nxt) group by 1, 2 having count(*) >= 3""", _FH))
def negrisk_hourly_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the synthetic tape the grid is daily: it has about a fill a day and token."""
    per = fills(spark, sf_dir).where("outcome_index = 0").groupBy("family", "condition_id", F.col("day").alias("hour")).agg(F.max_by("pc", F.struct("sec", "tx_hash", "evt_index")).alias("p"))
    return families.hourly_sums(per, 24, 3)


@query(fills_sql("""select wallet, n, round(h, 8) as entropy from (select wallet, cast(sum(n) as bigint) as n, abs(sum(n / t * ln(n / t))) as h from (select taker as wallet, hour % 24, cast(count(*) as double) as n, cast(sum(count(*)) over (partition by taker) as double) as t from f group by 1, 2) group by 1)"""))
def hour_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.hour_entropy(fills(spark, sf_dir), "taker").withColumn("entropy", F.round("entropy", 8))


@query(fills_sql("""select kind, count(*) as wallets, cast(sum(n) as bigint) as fills from (select wallet, n, case when made / n >= 0.7 then 'market_maker' when n / days >= 40 and h >= 0.9 * ln(24) then 'high_frequency' when n = 1 then 'one_shot' else 'active' end as kind from (
 select wallet, count(*)::double as n, sum(made)::double as made, count(distinct day) as days from s group by 1) join (select wallet, abs(sum(n / t * ln(n / t))) as h from (select wallet, hour % 24, cast(count(*) as double) as n, cast(sum(count(*)) over (partition by wallet) as double) as t from s group by 1, 2) group by 1) using (wallet)) group by 1""",
    "s as (select maker as wallet, 1 as made, day, hour from f union all select taker, 0, day, hour from f)"))
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.taxonomy(fills(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("wallets"), F.sum("n").alias("fills"))


_TAGS = "map(name, class) as (values ('red', 'warm'), ('blue', 'cold'), ('green', 'cold'), ('ring', 'jewel'), ('widget', 'tool'), ('economy', 'cheap'), ('standard', 'plain'), ('promo', 'cheap'))"


@query(f"""with {_TAGS} select p_partkey, class, n from (select p_partkey, class, count(*) as n, row_number() over (partition by p_partkey order by count(*) desc, min(pos), class) as r from (
 select p_partkey, generate_subscripts(tags, 1) as pos, unnest(tags) as tag from (select p_partkey, string_split(p_name || ' ' || p_type, ' ') as tags from part)) join map on lower(trim(tag)) = name group by 1, 2) where r = 1""")
def category_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that most of a part's words map to, by a small dictionary."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("tags"))
    rows = [("red", "warm"), ("blue", "cold"), ("green", "cold"), ("ring", "jewel"), ("widget", "tool"), ("economy", "cheap"), ("standard", "plain"), ("promo", "cheap")]
    return classify.mode_of_tags(words, "p_partkey", "tags", spark.createDataFrame(rows, "name string, class string"))


@query("select case when regexp_matches(lower(p_name), '\\bring\\b') then 'jewel' when regexp_matches(lower(p_type), 'eco|promo') then 'cheap' when regexp_matches(lower(p_name), '^(red|blue)') then 'colour' else 'other' end as class, count(*) as n from part group by 1")
def class_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    joined = F.concat(F.lower("p_name"), F.lit("|"), F.lower("p_type"))
    rules = [("jewel", r"^[^|]*\bring\b"), ("cheap", r"\|.*(eco|promo)"), ("colour", r"^(red|blue)")]
    return part.groupBy(classify.rule_class(joined, rules).alias("class")).agg(F.count("*").alias("n"))


@query(fills_sql("""select category, week, count(*) as n, cast(sum(cents) as bigint) as notional, count(distinct condition_id) as markets, round(sum(cents)::double / sum(sum(cents)) over (partition by week), 8) as share from f group by 1, 2"""))
def class_week_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = fills(spark, sf_dir).groupBy("category", "week").agg(F.count("*").alias("n"), F.sum("cents").alias("notional"), F.countDistinct("condition_id").alias("markets"))
    return cell.withColumn("share", F.round(ratio(F.col("notional"), F.sum("notional").over(Window.partitionBy("week"))), 8))


@query(fills_sql("""select round(sum(case when category < 6 then cents else 0 end)::double / sum(cents), 8) as coverage, round(sum(case when category = 6 then cents else 0 end)::double / sum(cents), 8) as unmapped,
 max(case when category = 0 then 1 else 0 end) = 1 as has_control, (select round(max(c)::double / sum(c), 8) from (select sum(cents) as c from f group by category)) as largest from f"""))
def panel_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation figures of the class panel: coverage, unmapped share, a control class, the largest class."""
    per = fills(spark, sf_dir).groupBy("category").agg(F.sum("cents").alias("c"))
    total = F.sum("c")
    return per.agg(
        F.round(ratio(F.sum(F.when(F.col("category") < 6, F.col("c")).otherwise(0)), total), 8).alias("coverage"),
        F.round(ratio(F.sum(F.when(F.col("category") == 6, F.col("c")).otherwise(0)), total), 8).alias("unmapped"),
        F.coalesce(F.bool_or(F.col("category") == 0), F.lit(False)).alias("has_control"), F.round(ratio(F.max("c"), total), 8).alias("largest"),
    )


@query(fills_sql("select family as event_id, count(distinct condition_id) as n_markets, cast(sum(cents) as bigint) as volume, min(sec) as first_sec, max(sec) as last_sec from f group by 1"))
def events_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(spark, sf_dir).groupBy(F.col("family").alias("event_id")).agg(F.countDistinct("condition_id").alias("n_markets"), F.sum("cents").alias("volume"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))


@query(raw_sql("""select category, gap_low, gap_high from (select category, hi + 1 as gap_low, lead(lo) over (partition by category order by lo) - 1 as gap_high from (
 select category, min(lo) as lo, max(hi) as hi from (select *, sum(new) over (partition by category order by lo, hi rows unbounded preceding) as k from (
  select *, case when lo > coalesce(max(hi) over (partition by category order by lo, hi rows between unbounded preceding and 1 preceding), -1) + 1 then 1 else 0 end as new from iv)) group by category, k)) where gap_high is not null""", "iv as (select distinct category, tx_hash as lo, tx_hash + 2 as hi from raw)"))
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that no chunk of three covers, by category."""
    chunks = raw_fills(spark, sf_dir).selectExpr("category", "tx_hash as lo", "tx_hash + 2 as hi").distinct()
    return interval_gaps(chunks, ["category"], "lo", "hi")


@query(raw_sql("""select coalesce(a.tx_hash, b.tx_hash) as tx_hash, a.q as left_q, b.q as right_q, case when a.tx_hash is null then 'right' when b.tx_hash is null then 'left' when a.q = b.q then 'same' else 'differ' end as status
 from (select tx_hash, cast(sum(q) as bigint) as q from raw where evt_index <= 4 group by 1) a full join (select tx_hash, cast(sum(q) as bigint) as q from raw where evt_index >= 3 group by 1) b on a.tx_hash = b.tx_hash"""))
def reconcile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two partial sources of one tape, transaction by transaction."""
    tape = raw_fills(spark, sf_dir)
    left = tape.where("evt_index <= 4").groupBy("tx_hash").agg(F.sum("q").alias("left_q"))
    right = tape.where("evt_index >= 3").groupBy("tx_hash").agg(F.sum("q").alias("right_q"))
    status = F.when(F.col("left_q").isNull(), "right").when(F.col("right_q").isNull(), "left").when(F.col("left_q") == F.col("right_q"), "same").otherwise("differ")
    return left.join(right, "tx_hash", "full").withColumn("status", status)


@query("""select coalesce(s_suppkey, c_custkey) as id, case when s_suppkey is null then 'only_right' when c_custkey is null then 'only_left' when s_nationkey = c_nationkey then 'identical' else 'conflict' end as flag from supplier full join customer on s_suppkey = c_custkey""")
def registry_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registries by id: what only one has, what agrees, what conflicts."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("x"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("y"))
    flag = F.when(F.col("x").isNull(), "only_right").when(F.col("y").isNull(), "only_left").when(F.col("x") == F.col("y"), "identical").otherwise("conflict")
    return a.join(b, "id", "full").select("id", flag.alias("flag"))


@query(raw_sql("""select count(*) as n, count(*) filter (where pc < 0 or pc > 100) as bad_price, count(*) filter (where q <= 0) as bad_size, count(*) filter (where maker = taker) as self_match, count(*) filter (where maker is null or taker is null) as no_party,
 (select count(*) from (select tx_hash, evt_index from raw group by 1, 2 having count(*) > 1)) as repeated_keys from raw"""))
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of each rule, counted in one pass over per-key aggregates."""
    tape = raw_fills(spark, sf_dir)
    rules = {"bad_price": "pc < 0 or pc > 100", "bad_size": "q <= 0", "self_match": "maker = taker", "no_party": "maker is null or taker is null"}
    per = tape.groupBy("tx_hash", "evt_index").agg(F.count("*").alias("n"), *[F.count_if(F.expr(e)).alias(k) for k, e in rules.items()])
    return per.agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in rules], F.count_if(F.col("n") > 1).alias("repeated_keys"))


@query(fills_sql("""select condition_id, count(*) as groups, cast(sum(least(q0, q1)) as bigint) as created from (select condition_id, day, taker, sum(case when outcome_index = 0 then q else 0 end) as q0, sum(case when outcome_index = 1 then q else 0 end) as q1 from f where side = 'BUY' group by 1, 2, 3 having min(outcome_index) = 0 and max(outcome_index) = 1) group by 1"""))
def share_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buys of both outcomes by one taker on one day: complete sets that must have been made."""
    q = lambda k: F.sum(F.when(F.col("outcome_index") == k, F.col("q")).otherwise(0))
    cell = fills(spark, sf_dir).where("side = 'BUY'").groupBy("condition_id", "day", "taker").agg(q(0).alias("q0"), q(1).alias("q1")).where("q0 > 0 and q1 > 0")
    return cell.groupBy("condition_id").agg(F.count("*").alias("groups"), F.sum(F.least("q0", "q1")).alias("created"))


@query(fills_sql("""select grouping(category) as g_category, grouping(side) as g_side, category, side, count(*) as n, cast(sum(cents) as bigint) as cents from f group by grouping sets ((category, side), (category), (side), ())"""))
def multi_level_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by class, side, both and none from one pass."""
    fills(spark, sf_dir).createOrReplaceTempView("tidemark_fills")
    return spark.sql("select cast(grouping(category) as bigint) as g_category, cast(grouping(side) as bigint) as g_side, category, side, count(*) as n, sum(cents) as cents from tidemark_fills group by grouping sets ((category, side), (category), (side), ())")


@query(fills_sql("""select account, decile, count(*) as n, cast(sum(vol) as bigint) as vol from (select taker % 4 as account, vol, ntile(10) over (order by vol, taker) as decile from (select taker, sum(cents) as vol from f group by 1)) group by 1, 2"""))
def account_type_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = fills(spark, sf_dir).groupBy("taker").agg(F.sum("cents").alias("vol"))
    ranked = global_ntile(per, ["vol", "taker"], 10, "decile").select((F.col("taker") % 4).alias("account"), "vol", "decile")
    return ranked.groupBy("account", "decile").agg(F.count("*").alias("n"), F.sum("vol").alias("vol"))
