"""Validated joins, reuse, pairs, manifests and document differences, on orders, lines, suppliers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents, keys, signals
from ..operators import joins
from ..sources import readers
from .registry import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey")
def checked_lookup(spark, sf_dir):
    """Every order must have its one customer."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.checked_join(orders, customers, ["o_custkey"]).select("o_orderkey", "c_mktsegment", "o_totalprice")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber - 1 AS slot FROM lineitem), s AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT slot) AS d, min(slot) AS a, max(slot) AS b FROM l GROUP BY ALL)
    SELECT o_orderkey AS l_orderkey, coalesce(n, 0) AS n_rows, coalesce(n - d, 0) AS n_repeated, coalesce(d = n AND a = 0 AND b = n - 1, false) AS complete FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def slot_coverage(spark, sf_dir):
    slots = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("slot"))
    return joins.slot_report(slots, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"], "slot")


@query("""WITH p AS (SELECT o_orderkey, o_custkey, o_totalprice AS a, o_totalprice * 1.5 - 100 * (o_orderkey % 7) AS b FROM orders)
    SELECT o_custkey, avg(b - a) AS price FROM p GROUP BY ALL""")
def paired_difference(spark, sf_dir):
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    after = before.withColumn("price", F.col("price") * 1.5 - 100 * (F.col("o_orderkey") % 7))
    return joins.paired_difference(before, after, "o_orderkey", "o_custkey", ["price"])


@query("""WITH v AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), f AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
    SELECT l_orderkey, count(*) AS n_cells, count(*) FILTER ((l_partkey + l_suppkey) % 3 = 0) AS n_detected, count(DISTINCT CASE WHEN (l_partkey + l_suppkey) % 3 = 0 THEN l_suppkey END) AS n_faults FROM v JOIN f USING (l_orderkey) GROUP BY ALL""")
def detection_matrix(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    cells = joins.detection_matrix(lines.select("l_orderkey", "l_partkey"), lines.select("l_orderkey", "l_suppkey"), "l_orderkey", (F.col("l_partkey") + F.col("l_suppkey")) % 3 == 0)
    return cells.groupBy("l_orderkey").agg(F.count("*").alias("n_cells"), F.count_if("detected").alias("n_detected"), F.countDistinct(F.when(F.col("detected"), F.col("l_suppkey"))).alias("n_faults"))


@query("""WITH d AS (SELECT o_custkey, CAST(p AS VARCHAR) AS p, o_orderkey, lower(o_orderstatus) || right('0' || (o_orderkey % 100), 2) AS bits FROM (SELECT *, o_orderpriority AS p FROM orders)),
    x AS (SELECT a.o_custkey, (substr(a.bits, 1, 1) = substr(b.bits, 1, 1))::INT AS decisive, (substr(a.bits, 2, 1) = substr(b.bits, 2, 1))::INT + (substr(a.bits, 3, 1) = substr(b.bits, 3, 1))::INT AS other
        FROM d a JOIN d b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey)
    SELECT o_custkey, avg(decisive) AS decisive_agreement, avg(other / 2) AS other_agreement, count(*) AS n_pairs FROM x GROUP BY ALL""")
def ordered_agreement(spark, sf_dir):
    """How often the other vectors of a problem repeat a vector's decisive bits (here the first) and its other bits."""
    bits = F.concat(F.lower("o_orderstatus"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"))
    pairs = joins.other_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", bits.alias("bits")), "o_custkey", "o_orderkey")
    same = lambda at: (F.substring("bits", at, 1) == F.substring("other_bits", at, 1)).cast("int")
    return pairs.groupBy("o_custkey").agg(F.avg(same(1)).alias("decisive_agreement"), F.avg((same(2) + same(3)) / 2).alias("other_agreement"), F.count("*").alias("n_pairs"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lpad(bin(l_partkey % 16), 4, '0') AS bits, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS id FROM lineitem),
    u AS (SELECT l_orderkey, count(DISTINCT bits) AS n_unique, count(*) AS n FROM v GROUP BY ALL),
    h AS (SELECT a.l_orderkey, avg(bit_count(xor(CAST(a.l_partkey % 16 AS INTEGER), CAST(b.l_partkey % 16 AS INTEGER))) / 4.0) AS hamming FROM v a JOIN v b ON a.l_orderkey = b.l_orderkey AND a.id < b.id GROUP BY ALL)
    SELECT l_orderkey, n_unique, hamming FROM u LEFT JOIN h USING (l_orderkey) WHERE n >= 2""")
def vector_diversity(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("r"))
    numbered = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("r")).select("l_orderkey", F.posexplode("r").alias("id", "r"))
    vectors = numbered.select("l_orderkey", "id", F.lpad(F.bin(F.col("r.l_partkey") % 16), 4, "0").alias("bits"))
    unique = vectors.groupBy("l_orderkey").agg(F.countDistinct("bits").alias("n_unique"), F.count("*").alias("n")).where("n >= 2").drop("n")
    pairs = joins.other_rows(vectors, "l_orderkey", "id", ordered=False)
    return unique.join(pairs.groupBy("l_orderkey").agg(F.avg(signals.hamming(F.col("bits"), F.col("other_bits"))).alias("hamming")), "l_orderkey", "left")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_orderkey * 2.0 END AS result, o_orderstatus = 'F' AS reused FROM orders""")
def reused_results(spark, sf_dir):
    """Measured results where a prior run has them, fresh ones otherwise."""
    orders = table(spark, sf_dir, "orders")
    prior = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice").alias("result"))
    return joins.with_reuse(orders.select("o_orderkey"), prior, ["o_orderkey"], lambda rows: rows.withColumn("result", F.col("o_orderkey") * 2.0))


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS internal, CASE WHEN event_id % 5 > 0 THEN value + 1 END AS reference FROM events WHERE event_id % 3 > 0 AND event_id % 5 > 0 AND event_id % 4 > 0""")
def comparable_scores(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("internal"))
    right = events.where("event_id % 4 > 0").select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("value") + 1).alias("reference"))
    return joins.known_on_both(left, right, ["event_id"], "internal", "reference")


_UNIT = "CAST(CAST('0x' || substr(sha256('42:' || o_orderkey), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'frozen' WHEN {_UNIT} < 0.8 THEN 'train' WHEN {_UNIT} < 0.9 THEN 'validation' ELSE 'test' END AS split FROM orders""")
def assigned_splits(spark, sf_dir):
    """The split that a manifest gives, computed for keys that it does not have."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    manifest = orders.where("o_orderkey % 5 = 0").withColumn("split", F.lit("frozen"))
    return joins.assigned_or(orders, manifest, "o_orderkey", "split", keys.hash_split(42, F.col("o_orderkey")))


@query("""SELECT l_orderkey, string_agg(net || '=' || v, ',' ORDER BY net) AS vector FROM (SELECT l_orderkey, coalesce('S_' || s_name, 'v' || l_suppkey) AS net, max(l_linenumber % 2) AS v
    FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) ON s_suppkey = l_suppkey GROUP BY ALL) GROUP BY ALL""")
def renamed_nets(spark, sf_dir):
    """Assignments of a variant design under the original's net names; unmapped names stay."""
    bits = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("net")).agg(F.max(F.col("l_linenumber") % 2).alias("v"))
    vectors = bits.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("net", "v"))).alias("vector"))
    names = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("net"), F.concat(F.lit("S_"), "s_name").alias("original"))
    out = joins.renamed_keys(vectors, "vector", names, "net", "original", "l_orderkey")
    shown = F.transform(F.array_sort(F.map_entries("vector")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("l_orderkey", F.array_join(shown, ",").alias("vector"))


@query("""SELECT event_id, 'a.b' AS path, CAST(value AS VARCHAR) AS before, CAST(value + 1 AS VARCHAR) AS after FROM events WHERE event_id % 2 = 0
    UNION ALL SELECT event_id, 'list[1]', '2', NULL FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'new', NULL, 'true' FROM events WHERE event_id % 5 = 0""")
def document_differences(spark, sf_dir):
    """Leaves of two nested documents that are not the same, by path."""
    events = table(spark, sf_dir, "events")
    number = lambda c: c.cast("string")
    before = F.concat(F.lit('{"a": {"b": '), number(F.col("value")), F.lit(', "c": "x"}, "list": [1'), F.when(F.col("event_id") % 3 == 0, ", 2").otherwise(""), F.lit("]}"))
    after = F.concat(F.lit('{"list": [1], "a": {"c": "x", "b": '), number(F.when(F.col("event_id") % 2 == 0, F.col("value") + 1).otherwise(F.col("value"))), F.lit("}"), F.when(F.col("event_id") % 5 == 0, ', "new": true').otherwise(""), F.lit("}"))
    flat = events.select("event_id", documents.leaves(before).alias("b"), documents.leaves(after).alias("a"))
    found = flat.select("event_id", F.inline(documents.differences(F.col("b"), F.col("a"))))
    return found.select("event_id", "path", *(F.when(F.col("path") == "a.b", F.col(c).cast("double").cast("string")).otherwise(F.col(c)).alias(c) for c in ("before", "after")))


@query("""SELECT count(*) FILTER (o_orderkey % 11 = 0) AS n_removed, 0 AS n_added, count(*) FILTER (o_orderkey % 11 > 0 AND o_orderkey % 13 = 0) AS o_totalprice, 0 AS o_custkey FROM orders""")
def immutable_columns(spark, sf_dir):
    """What a new version of a manifest changed in columns that must stay."""
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    after = before.where("o_orderkey % 11 > 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, -1.0).otherwise(F.col("o_totalprice")))
    return joins.unchanged(before, after, "o_orderkey", ["o_totalprice", "o_custkey"])


@query("""SELECT l_partkey, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_suppkey) > 1 AS repeated FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1""")
def repeated_designs(spark, sf_dir):
    """Designs that stand in more than one place of a split manifest."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n_rows"), F.countDistinct("l_suppkey").alias("n_suppliers"))
    return own.where("n_suppliers > 1").withColumn("repeated", F.col("n_suppliers") > 1)


@query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","props":{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '},"user_id":' || user_id || '}') AS config_hash, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events""")
def config_hashes(spark, sf_dir):
    """The digest of canonical JSON names a trial's configuration; a dotted path reads one of its numbers."""
    events = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"user_id": '), F.col("user_id").cast("string"), F.lit(', "props": '), "props", F.lit(', "event_type": "'), "event_type", F.lit('"}'))
    return events.select("event_id", documents.digest(text).alias("config_hash"), documents.number_at(text, "props.k").alias("k"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '{"a":' || o_orderkey || '}' END AS stored, 'a=' || o_orderkey % 3 AS merged FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, NULL, 'a=0' FROM orders WHERE o_orderkey % 2 = 1""")
def merged_settings(spark, sf_dir):
    """Settings under overrides, leaf by leaf, and a stored value only where it is one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    even = F.col("o_orderkey") % 2 == 0
    over = F.when(even, F.concat(F.lit('{"a": '), (F.col("o_orderkey") % 3).cast("string"), F.lit("}"))).otherwise("{}")
    stored = documents.canonical(F.when(even, F.concat(F.lit('{"a" : '), F.col("o_orderkey").cast("string"), F.lit("}"))))
    flat = orders.select("o_orderkey", stored.alias("stored"), documents.leaves(F.lit('{"a": 0}')).alias("base"), documents.leaves(over).alias("over"))
    # an empty document has one empty leaf without a path
    entries = F.filter(F.map_entries(documents.merged(F.col("base"), F.col("over"))), lambda e: e["key"] != "")
    shown = F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return flat.select("o_orderkey", "stored", shown.alias("merged"))


@query("""SELECT r_name AS parent, n_name AS child, 1 AS depth FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_name, 'leaf', 2 FROM nation""")
def tree_edges(spark, sf_dir):
    """Edges of nested JSON objects, by a table function."""
    readers.register_tree_edges(spark)
    names = F.array_join(F.transform(F.array_sort(F.collect_list("n_name")), lambda n: F.concat(F.lit('"'), n, F.lit('": {"leaf": {}}'))), ", ")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    trees = nations.groupBy("r_name").agg(names.alias("n")).select(F.concat(F.lit('{"'), "r_name", F.lit('": {'), "n", F.lit("}}")).alias("tree"))
    return trees.lateralJoin(readers.TreeEdges(F.col("tree").outer())).select("parent", "child", "depth")


@query("""SELECT part, i, part * 10 + i AS value FROM generate_series(0, 7) AS p(part), generate_series(0, 4) AS s(i)""")
def generated_rows(spark, sf_dir):
    """A generator as a source."""
    return readers.generated(spark, lambda part: ((part, i, part * 10 + i) for i in range(5)), 8, "part bigint, i bigint, value bigint")
