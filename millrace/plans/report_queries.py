"""Smaller reports: thresholds, runs, pattern shares, positional splits, missing pairs, generated strings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import records
from .registry import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"
#: Seeds that a configuration is confirmed with, at most.
MOST_SEEDS = 1000
LIMITS = [64 * 2**i for i in range(8)]


@query(f"""WITH d AS (SELECT len(regexp_extract_all(text, '[.]')) AS g, {WORDS} AS n FROM documents), t AS (SELECT unnest({LIMITS}) AS most)
    SELECT most, coalesce(max(g), 0) AS max_gates FROM t LEFT JOIN d ON n < most GROUP BY most""")
def gates_by_context_length(spark, sf_dir):
    """Each row falls under every threshold above its length; one partially combined aggregate, no range join."""
    docs = table(spark, sf_dir, "documents").select(F.regexp_count("text", F.lit("[.]")).cast("long").alias("g"), text.token_count(F.col("text")).alias("n"))
    best = docs.agg(*(F.coalesce(F.max(F.when(F.col("n") < m, F.col("g"))), F.lit(0).cast("long")).alias(f"m{m}") for m in LIMITS))
    return best.select(F.inline(F.array(*(F.struct(F.lit(m).alias("most"), F.col(f"m{m}").alias("max_gates")) for m in LIMITS))))


@query(f"""SELECT len(regexp_extract_all(text, '[.]')) AS gates, max({WORDS}) AS max_tokens, count(*) AS n FROM documents GROUP BY 1""")
def tokens_by_gates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.regexp_count("text", F.lit("[.]")).cast("long").alias("gates"), text.token_count(F.col("text")).cast("long").alias("n"))
    return docs.groupBy("gates").agg(F.max("n").alias("max_tokens"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN r <= n * 85 // 100 // 16 * 16 THEN 'train' WHEN r <= n * 95 // 100 // 16 * 16 THEN 'validation' ELSE 'test' END AS part FROM r""")
def positional_split(spark, sf_dir):
    ranked = records.ranked(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    n = F.broadcast(table(spark, sf_dir, "documents").agg(F.count("*").alias("n")))
    cut = lambda p: F.expr(f"n * {p} div 100 div 16 * 16")
    return ranked.crossJoin(n).select("doc_id", F.when(F.col("rank") <= cut(85), "train").when(F.col("rank") <= cut(95), "validation").otherwise("test").alias("part"))


@query("""SELECT c_custkey, p AS priority FROM customer, (SELECT DISTINCT o_orderpriority AS p FROM orders) EXCEPT SELECT o_custkey, o_orderpriority FROM orders""")
def missing_pairs(spark, sf_dir):
    """Confirmations still to run: every configuration with each of the few seeds, less what exists."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority")).distinct()
    seeds = [r["priority"] for r in orders.select("priority").distinct().orderBy("priority").limit(MOST_SEEDS + 1).collect()]
    if len(seeds) > MOST_SEEDS:
        raise ValueError(f"more than {MOST_SEEDS} seeds")
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*(F.lit(s) for s in seeds))).alias("priority"))
    return wanted.join(orders, ["c_custkey", "priority"], "left_anti")


@query("""WITH r AS (SELECT user_id, event_id, ts, event_type = 'view' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY ts, event_id) AS island FROM events),
    i AS (SELECT user_id, island, max(ts) AS last_ts, count(*) AS n FROM r WHERE hit GROUP BY ALL)
    SELECT user_id, n AS last_run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC) AS p FROM i) WHERE p = 1""")
def last_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("hit", F.col("event_type") == "view")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    island = F.row_number().over(order) - F.row_number().over(Window.partitionBy("user_id", "hit").orderBy("ts", "event_id"))
    runs = events.withColumn("island", island).where("hit").groupBy("user_id", "island").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max_by("n", "last_ts").alias("last_run"))


@query("""WITH p AS (SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS pattern FROM orders GROUP BY ALL), c AS (SELECT pattern, count(*) AS n FROM p GROUP BY ALL)
    SELECT max(n) / sum(n) AS modal_share, count(*) AS n_patterns FROM c""")
def modal_pattern_share(spark, sf_dir):
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda r: r.o_orderstatus), "")
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(own.alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("modal_share"), F.count("*").alias("n_patterns"))


@query("""SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal <= 0, s_nationkey DESC, coalesce(nullif(s_acctbal, 0), 'Infinity'::DOUBLE), s_suppkey) AS difficulty_rank FROM supplier""")
def difficulty_ranks(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    order = [F.col("s_acctbal") <= 0, F.desc("s_nationkey"), F.coalesce(F.nullif("s_acctbal", F.lit(0.0)), F.lit(float("inf"))), F.col("s_suppkey")]
    return records.ranked(suppliers, order, "difficulty_rank").select("s_suppkey", "s_acctbal", "difficulty_rank")


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS t, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM c)
    SELECT p_brand, p_type, n, 100.0 * n / t AS percent FROM r WHERE r <= 3""")
def top_cells(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_brand")
    ranked = counts.withColumn("t", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "p_type")))
    return ranked.where("r <= 3").select("p_brand", "p_type", "n", (F.lit(100.0) * F.col("n") / F.col("t")).alias("percent"))


@query("""SELECT count(*) AS n_groups, count(*) FILTER (d = 1) AS all_identical, CAST(sum(d) AS BIGINT) AS total_distinct FROM (SELECT l_orderkey, count(DISTINCT l_returnflag) AS d FROM lineitem GROUP BY ALL)""")
def identical_groups(spark, sf_dir):
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("d"))
    return groups.agg(F.count("*").alias("n_groups"), F.count_if(F.col("d") == 1).alias("all_identical"), F.sum("d").alias("total_distinct"))


@query("""SELECT n, i, lpad(bin(i), n::INTEGER, '0') AS pattern FROM (SELECT unnest(generate_series(1, 8)) AS n), generate_series(0, 255) AS s(i) WHERE i < 2 ** n""")
def binary_patterns(spark, sf_dir):
    n = spark.range(1, 9).select(F.col("id").alias("n"))
    every = n.select("n", F.explode(F.expr("sequence(0L, shiftleft(1L, cast(n as int)) - 1)")).alias("i"))
    return every.select("n", "i", F.expr("lpad(bin(i), cast(n as int), '0')").alias("pattern"))


@query("""SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_total, count(*) AS n FROM events GROUP BY ALL""")
def usage_totals(spark, sf_dir):
    counters = table(spark, sf_dir, "events").select("event_type", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"))
    return counters.groupBy("event_type").agg(F.sum("k").alias("k_total"), F.count("*").alias("n"))


@query("""SELECT o_orderpriority, arg_min(o_orderkey, (length(o_orderstatus || o_custkey), o_orderkey)) AS shortest FROM orders WHERE o_totalprice > 100000 GROUP BY ALL""")
def shortest_counterexample(spark, sf_dir):
    """The record of least length among those that fail a predicate."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    return orders.groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct(F.length(F.concat("o_orderstatus", F.col("o_custkey").cast("string"))), "o_orderkey")).alias("shortest"))
