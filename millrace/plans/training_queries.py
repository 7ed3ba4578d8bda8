"""Training streams, rewards, promotion, label checks: compositions of the operators, on documents, orders, lines and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chat, keys, numbers, rewards, signals, text
from ..operators import circuit, joins, ranking, records, statistics, strategies
from . import circuit_queries, outcome_queries
from .registry import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"


@query(f"""WITH c AS (SELECT doc_id, text, CASE WHEN len(regexp_extract_all(text, '[.]')) IN (1, 5, 84) THEN 'gate' WHEN {WORDS} >= 500 THEN 'length' ELSE 'ok' END AS state FROM documents)
    SELECT doc_id, sha256('<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10)) AS formatted FROM c WHERE state = 'ok' ORDER BY doc_id OFFSET 30""")
def fused_stream(spark, sf_dir):
    """Classify, leave out what an earlier run has consumed, and only then format."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    state = records.tri_state(~F.regexp_count("text", F.lit("[.]")).isin(1, 5, 84), text.token_count(F.col("text")), 500)
    left = records.skip_take(docs.where(state == "ok"), ["doc_id"], 30, 0)
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return left.select("doc_id", F.sha2(chat.render(turns, F.lit("chatml")), 256).alias("formatted"))


@query(f"""SELECT DISTINCT source FROM (SELECT source FROM documents WHERE {WORDS} < 300 ORDER BY doc_id LIMIT 64)""")
def valid_test_keys(spark, sf_dir):
    """Keys of the first rows under a length limit."""
    docs = table(spark, sf_dir, "documents").where(text.token_count(F.col("text")) < 300).select("doc_id", "source")
    return records.skip_take(docs, ["doc_id"], 0, 64).select("source").distinct()


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '[.]')) AS gates, length(text) AS n_chars, {WORDS} AS n_tokens, sha256(text) AS digest FROM documents""")
def chunk_projection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[.]")).cast("long").alias("gates"), F.length("text").cast("long").alias("n_chars"), text.token_count(F.col("text")).cast("long").alias("n_tokens"), keys.sha256("text").alias("digest"))


@query("""WITH q AS (SELECT source FROM documents GROUP BY source HAVING count(*) >= 10), f AS (SELECT DISTINCT source FROM documents WHERE doc_id % 97 = 5)
    SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs FROM documents WHERE source IN (SELECT source FROM q) AND source NOT IN (SELECT source FROM f) GROUP BY source""")
def qualifying_designs(spark, sf_dir):
    """Second pass over designs with enough records, less those that could not be parsed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    enough = docs.groupBy("source").agg(F.count("*").alias("k")).where("k >= 10").select("source")
    failed = docs.where("doc_id % 97 = 5").select("source").distinct()
    return docs.join(enough, "source", "left_semi").join(failed, "source", "left_anti").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("n_langs"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'd' || o_custkey WHEN 1 THEN 'i' || o_orderkey WHEN 2 THEN 'n' || o_orderstatus ELSE 'plain' END AS key FROM orders""")
def field_keys(spark, sf_dir):
    """The group key of a record: its payload's id, its own id, its netlist, else the text itself."""
    k = F.col("o_orderkey") % 4
    payload = F.struct(F.when(k == 0, F.concat(F.lit("d"), F.col("o_custkey").cast("string"))).alias("doc_id"), F.when(k <= 1, F.concat(F.lit("i"), F.col("o_orderkey").cast("string"))).alias("id"), F.when(k <= 2, F.concat(F.lit("n"), "o_orderstatus")).alias("netlist"))
    return table(spark, sf_dir, "orders").select("o_orderkey", payload.alias("p")).select("o_orderkey", F.coalesce("p.doc_id", "p.id", "p.netlist", F.lit("plain")).alias("key"))


@query("""WITH r AS (SELECT l_suppkey, (l_returnflag = 'R')::INT AS y, l_discount, row_number() OVER w AS r, sum((l_returnflag = 'R')::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS h FROM lineitem WHERE l_quantity > 48
        WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)),
    g AS (SELECT l_suppkey, avg(CASE WHEN y = 1 THEN h / r END) AS ap, CASE WHEN count(*) FILTER (y = 1 OR l_discount > 0.05) = 0 THEN 1.0 ELSE count(*) FILTER (y = 1 AND l_discount > 0.05) / count(*) FILTER (y = 1 OR l_discount > 0.05) END AS iou FROM r GROUP BY ALL)
    SELECT count(*) AS n_graphs, count(*) FILTER (ap IS NULL) AS n_undefined, avg(ap) AS mean_ap, avg(CASE WHEN ap IS NOT NULL THEN iou END) AS mean_iou FROM g""")
def graph_metrics(spark, sf_dir):
    """Average precision and overlap per graph, then their means over the graphs for which they are defined."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 48").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    ap = ranking.average_precision(lines, ["l_suppkey"], "l_extendedprice", "y", ["l_orderkey", "l_linenumber", "l_partkey"])
    iou = lines.groupBy("l_suppkey").agg(ranking.iou(F.col("y") == 1, F.col("l_discount") > 0.05).alias("iou"))
    both = ap.join(iou, "l_suppkey")
    known = F.col("average_precision").isNotNull()
    return both.agg(F.count("*").alias("n_graphs"), F.count_if(~known).alias("n_undefined"), F.avg("average_precision").alias("mean_ap"), F.avg(F.when(known, F.col("iou"))).alias("mean_iou"))


@query("""SELECT vec_id // 16 AS batch, vec_id, coalesce(lag(vec_id) OVER w, max(vec_id) OVER (PARTITION BY vec_id // 16)) AS negative FROM embeddings WINDOW w AS (PARTITION BY vec_id // 16 ORDER BY vec_id)""")
def rolled_pairs(spark, sf_dir):
    """Each item of a batch with the one before it, the first with the last, as its negative."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 16").alias("batch"), "vec_id")
    w = Window.partitionBy("batch")
    return rows.select("batch", "vec_id", F.coalesce(F.lag("vec_id").over(w.orderBy("vec_id")), F.max("vec_id").over(w)).alias("negative"))


@query("""WITH last AS (SELECT o_custkey, o_orderpriority, arg_max(o_totalprice, o_orderkey) AS m FROM orders GROUP BY ALL), c AS (SELECT o_custkey, quantile_cont(m, 0.5) AS median, count(*) AS n_seeds FROM last GROUP BY ALL HAVING count(*) >= 2),
    r AS (SELECT *, row_number() OVER (ORDER BY median DESC, o_custkey) AS rank FROM c)
    SELECT o_custkey, median, n_seeds, rank, rank = 3 AS exported FROM r WHERE rank <= 5""")
def promoted_evaluations(spark, sf_dir):
    """Configurations by the median of their seeds, the best with their ranks, one of which is exported."""
    medians = statistics.median_of_seeds(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", 2)
    return ranking.top_k(medians, "median", 5, "o_custkey", ["o_custkey"]).select("o_custkey", "median", "n_seeds", "rank", (F.col("rank") == 3).alias("exported"))


@query("""SELECT event_id, name, score FROM (SELECT event_id, 'value' AS name, value AS score FROM events UNION ALL SELECT event_id, 'k', CAST(json_extract(props, '$.k') AS DOUBLE) FROM events)""")
def captured_components(spark, sf_dir):
    """Scored components of each example, one row a component."""
    scored = F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.get_json_object("props", "$.k").cast("double"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(scored).alias("name", "score"))


@query(f"""WITH t AS (SELECT o_custkey, o_orderkey, length(o_orderpriority) AS n FROM orders), s AS ({outcome_queries.SQL['spread_subset']})
    SELECT o_custkey, count(*) AS n_kept, CAST(sum(n) AS BIGINT) AS n_tokens, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS ids FROM s JOIN t USING (o_custkey, o_orderkey) GROUP BY o_custkey""")
def selected_rollouts(spark, sf_dir):
    """The columns of the selected rows, by id, and the totals that follow from them."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    kept = ranking.spread_subset(orders, "o_custkey", "o_totalprice", "o_orderkey", 4).where("keep").select("o_custkey", "o_orderkey")
    rows = joins.checked_join(kept, orders.select("o_orderkey", F.length("o_orderpriority").alias("n")), ["o_orderkey"])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n_kept"), F.sum("n").alias("n_tokens"), ids.alias("ids"))


@query("""WITH p AS (SELECT l_orderkey, list(DISTINCT l_partkey % 16) AS on_ FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(CASE WHEN list_contains(on_, i) THEN '1' ELSE '0' END, '' ORDER BY i) AS labels FROM p, generate_series(0, 15) AS s(i) GROUP BY ALL""")
def multi_hot_labels(spark, sf_dir):
    """The patterns of a record as one vector over all patterns."""
    on = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 16).alias("on"))
    bits = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")), lambda i: F.when(F.array_contains("on", i), "1").otherwise("0"))
    return on.select("l_orderkey", F.array_join(bits, "").alias("labels"))


@query("""SELECT l_orderkey, min(l_orderkey * 7) AS identity FROM lineitem GROUP BY l_orderkey""")
def saved_identities(spark, sf_dir):
    """One identity for each group of saved rows, or an error."""
    return joins.one_identity(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 7).alias("identity")), "l_orderkey", "identity")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'a=' || (o_orderkey % 2) || ',b=' || (o_custkey % 2) END AS vector FROM orders""")
def slot_vectors(spark, sf_dir):
    """The vector of a slot: the stored one, else the one that its text states, else none."""
    a, b = ((F.col(c) % 2).cast("int") for c in ("o_orderkey", "o_custkey"))
    stored = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("a"), a, F.lit("b"), b))
    said = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('random INPUT_VECTOR: "a: '), a.cast("string"), F.lit(", b: "), b.cast("string"), F.lit('" end'))).otherwise("nothing")
    vector = F.coalesce(stored, text.assignment(rewards.field(said, "INPUT_VECTOR")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(vector)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(vector.isNotNull(), shown).alias("vector"))


@query("""WITH p AS (SELECT l_suppkey, l_orderkey, avg(l_discount) AS share, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT l_suppkey % 5 AS bin, count(*) AS n_problems, avg(share) AS mean, sum(n) AS slots FROM p GROUP BY ALL)
    SELECT bin, n_problems, CASE WHEN n_problems >= 5 THEN mean END AS mean, CAST(slots AS BIGINT) AS slots FROM b""")
def problem_then_bin_means(spark, sf_dir):
    """Means per problem, then per bin; a bin with few problems shows none."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    problems = lines.groupBy("l_suppkey", "l_orderkey").agg(F.avg("l_discount").alias("share"), F.count("*").alias("n"))
    bins = problems.groupBy((F.col("l_suppkey") % 5).alias("bin")).agg(F.count("*").alias("n_problems"), F.avg("share").alias("mean"), F.sum("n").alias("slots"))
    return bins.withColumn("mean", F.when(F.col("n_problems") >= 5, F.col("mean")))


@query("""SELECT o_custkey, CAST(r - 1 AS INTEGER) AS slot, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)""")
def flattened_slots(spark, sf_dir):
    """Lists of completions as rows with their place; each list must have the length that is stated beside it."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("slots"), F.count("*").alias("n"))
    checked = lists.withColumn("slots", F.when(F.size("slots") == F.col("n"), F.col("slots")).otherwise(F.raise_error(F.lit("another number of slots"))))
    return checked.select("o_custkey", F.posexplode("slots").alias("slot", "o_orderkey"))


@query("""SELECT p_partkey, 'original' AS part, 'sa' || (p_size % 2) || ' n' || p_size AS fault FROM part UNION ALL SELECT p_partkey, 'control', 'sa' || (1 - p_size % 2) || ' n' || p_size FROM part""")
def control_faults(spark, sf_dir):
    """Each problem and its control with the opposite fault, under the same id."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lit("original").alias("part"), F.concat(F.lit("sa"), (F.col("p_size") % 2).cast("string"), F.lit(" n"), F.col("p_size").cast("string")).alias("fault"))
    return part.unionByName(part.select("p_partkey", F.lit("control").alias("part"), text.opposite_fault(F.col("fault")).alias("fault")))


@query("""SELECT s_suppkey, 'n0=' || (s_suppkey % 2) || ',n1=' || (s_suppkey // 2 % 2) AS named, s_suppkey % 3 = 0 AS label_wrong FROM supplier""")
def label_checks(spark, sf_dir):
    """Positional bits under the declared names, and labels that differ from what the wiring gives."""
    names = F.array(F.lit("n0"), F.lit("n1"))
    bits = F.concat((F.col("s_suppkey") % 2).cast("string"), (F.floor(F.col("s_suppkey") / 2) % 2).cast("string"))
    truth = signals.named_bits(names, bits)
    label = F.transform(truth, lambda p: F.struct(p["name"].alias("name"), F.when((F.col("s_suppkey") % 3 == 0) & (p["name"] == "n1"), 1 - p["bit"]).otherwise(p["bit"]).alias("bit")))
    wrong = F.exists(F.zip_with(truth, label, lambda a, b: a["bit"] != b["bit"]), lambda d: d)
    shown = F.array_join(F.transform(truth, lambda p: F.concat(p["name"], F.lit("="), p["bit"].cast("string"))), ",")
    return table(spark, sf_dir, "supplier").select("s_suppkey", shown.alias("named"), wrong.alias("label_wrong"))


@query("""WITH f AS (SELECT l_suppkey, l_partkey, min([l_orderkey, l_linenumber]) AS o FROM lineitem WHERE l_quantity > 5 GROUP BY ALL),
    r AS (SELECT l_suppkey, l_partkey, o[1] AS l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY sha256('8:' || l_partkey), l_partkey) AS r FROM f)
    SELECT l_suppkey, l_partkey, l_orderkey FROM r WHERE r <= 3""")
def circuit_validation(spark, sf_dir):
    """At most three rows a circuit, one of each distinct fault, in hash order, of the eligible rows."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 5").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    firsts = records.first_occurrence(lines, ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"])
    return records.per_group_sample(firsts, ["l_suppkey"], "l_partkey", 8, 3).select("l_suppkey", "l_partkey", "l_orderkey")


@query("""SELECT doc_id, (r - 1) // 50 AS batch, r FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('6:' || doc_id), doc_id) AS r FROM documents)""")
def fixed_batches(spark, sf_dir):
    """Batches of fifty in a seeded order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", keys.seeded_order(6, F.col("doc_id")).alias("o"))
    return records.ranked(docs, ["o", "doc_id"], "r").select("doc_id", F.floor((F.col("r") - 1) / 50).cast("long").alias("batch"), "r")


@query("""WITH g AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) AS group_order FROM documents GROUP BY lang)
    SELECT doc_id, lang, group_order, row_number() OVER (PARTITION BY lang ORDER BY sha256('2:' || doc_id), doc_id) AS place FROM documents JOIN g USING (lang)""")
def grouped_shuffle(spark, sf_dir):
    """Groups by size, each in its own seeded order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", keys.seeded_order(2, F.col("doc_id")).alias("o"))
    out = records.interleave(docs, "lang", ["o", "doc_id"], "round_robin")
    return out.select("doc_id", "lang", "group_order", F.col("group_rank").alias("place"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN -log2(least(1.0, s_acctbal / 10000)) + 0.0 END AS bits, CASE WHEN s_acctbal > 0 THEN 1 / least(1.0, s_acctbal / 10000) END AS expected, 'sa' || (s_suppkey % 2) AS polarity, 'n' || s_suppkey AS net,
    'The module m' || s_suppkey || ' has ' || CASE WHEN s_suppkey = 1 THEN '1 gate' ELSE s_suppkey || ' gates' END || ', with inputs a, b, and c.' AS caption FROM supplier""")
def difficulty_texts(spark, sf_dir):
    """Bits of difficulty, expected vectors, faults in the long spelling, and captions."""
    suppliers = table(spark, sf_dir, "supplier")
    p = F.least(F.lit(1.0), F.col("s_acctbal") / 10000)
    fault = text.parse_fault_spelling(F.concat(F.lit("Stuck-At-"), (F.col("s_suppkey") % 2).cast("string"), F.lit(" at n"), F.col("s_suppkey").cast("string")))
    caption = F.concat(F.lit("The module m"), F.col("s_suppkey").cast("string"), F.lit(" has "), text.counted(F.col("s_suppkey"), "gate"), F.lit(", with inputs "), text.listed(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), F.lit("."))
    return suppliers.select(
        "s_suppkey", F.when(F.col("s_acctbal") > 0, numbers.difficulty_bits(p) + 0.0).alias("bits"), F.when(F.col("s_acctbal") > 0, numbers.ratio(F.lit(1.0), p)).alias("expected"),
        F.concat(F.lit("sa"), fault["stuck_at"].cast("string")).alias("polarity"), fault["net"].alias("net"), caption.alias("caption"),
    )


_ONE = circuit_queries._ONE


@query(f"""{_ONE}, x AS (SELECT d, (d % 16)::INT AS v, (seen >> (d % 16)::INT) & 1 AS det, (gy >> (d % 16)::INT) & 1 AS yg, (byy >> (d % 16)::INT) & 1 AS yb,
        ((({circuit_queries.GOOD.format('f').replace('vals', 'gv').replace('y', 'gy')}) >> (d % 16)::INT) & 1) <> s AS act, d % 5 > 0 AS right_, d % 7 > 0 AS whole, d % 2 = 0 AS named, d % 11 > 0 AS given FROM p),
    c AS (SELECT *, (2 + given::INT * 3 + (NOT given)::INT * 2) / 6.0 AS fmt, CASE WHEN whole THEN 1.0 ELSE 0.75 END AS pi FROM x)
    SELECT d AS design, CASE WHEN given THEN det ELSE 0 END::DOUBLE AS detection, (given AND act)::INT::DOUBLE AS activation, CASE WHEN given AND right_ THEN det ELSE 0 END::DOUBLE AS fidelity,
        CASE WHEN given THEN det * (0.5 * fmt + 0.5 * pi) ELSE 0 END::DOUBLE AS format, fmt::DOUBLE AS compliance, CASE WHEN given THEN ((yg = yg)::INT + (yb = 1)::INT) / 2 ELSE 0 END::DOUBLE AS table_accuracy,
        (given AND named)::INT::DOUBLE AS mention, given AND det = 1 AND right_ AND whole AND named AS accepted, round(CASE WHEN given THEN det * (1 + (0.2 * right_::INT) + 0.05 * (0.5 * fmt + 0.5 * pi)) + 0.25 * act::INT ELSE 0 END, 9)::DOUBLE AS scalar FROM c""")
def reward_components(spark, sf_dir):
    """Components of completions against replayed machines."""
    problems = circuit_queries._problems(spark, sf_dir)
    machines = circuit.replayed(problems, ["design"])
    maps = machines.groupBy("design").agg(*(F.map_from_entries(F.collect_list(F.struct("net", c))).alias(c) for c in ("good", "bad")))
    d = F.col("design")
    bit = lambda i: F.substring("vector", i + 1, 1)
    given = F.concat(*(F.concat(F.lit(f"a{i}: "), bit(i), F.lit(", " if i < 2 else "")) for i in range(3)), F.when(d % 7 > 0, F.concat(F.lit(", a3: "), bit(3))).otherwise(""))
    y = F.element_at("good", "y")
    completion = F.concat(
        F.lit('<think>so</think> <tool_response>{"Good Machine": {"y": '), y.cast("string"), F.lit('}, "Bad Machine": {"y": 1}}</tool_response>\n'),
        F.when(d % 11 > 0, F.concat(F.lit('INPUT_VECTOR: "'), given, F.lit('"\n'))).otherwise(""), F.lit('EXPECTED_OUTPUT: "y: '), F.when(d % 5 > 0, y).otherwise(1 - y).cast("string"), F.lit('"\nDETECTED_FAULTS: "'),
        F.when(d % 2 == 0, F.upper("fault")).otherwise("sa9 q"), F.lit('"'),
    )
    rows = problems.join(maps, "design").select("design", completion.alias("c"), F.split("fault", " ").alias("f"), "good", "bad")
    inputs = F.array(*(F.lit(f"a{i}") for i in range(4)))
    scored = rows.select("design", rewards.components(F.col("c"), F.get("f", F.lit(0)), F.get("f", F.lit(1)), F.col("good"), F.col("bad"), inputs, F.array(F.lit("y"))).alias("m"))
    shown = {"detection": "detection", "activation": "activation", "fidelity": "fidelity", "format": "format", "compliance": "format_compliance_logonly", "table_accuracy": "pred_vs_fault_sim_acc_logonly", "mention": "fault_mention_logonly"}
    scalar = F.round(sum((F.element_at("m", k) * w for k, w in rewards.profile("full").items()), F.lit(0.0)), 9)
    return scored.select("design", *(F.element_at("m", k).alias(n) for n, k in shown.items()), rewards.accepted(F.col("m"), "full_accuracy").alias("accepted"), scalar.alias("scalar"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY sha256('9:' || doc_id), doc_id) AS position FROM documents""")
def named_order(spark, sf_dir):
    """An order by its name."""
    return strategies.ordered(table(spark, sf_dir, "documents").select("doc_id", "lang"), "random", "lang", "doc_id", 9).select("doc_id", "position")


@query(f"""SELECT conv_id, turn, 0.0::DOUBLE AS answered, {WORDS}::DOUBLE AS length FROM conversations WHERE role = 'assistant'""")
def named_scores(spark, sf_dir):
    """Scores by their names."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("completion"))
    return strategies.scored(turns, ["answered", "length"]).drop("completion")


@query("""SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY sha256('12:' || doc_id), doc_id LIMIT 40""")
def eligible_sample(spark, sf_dir):
    """A sample of what a predicate that is handed in lets through."""
    return records.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 12, 40, lambda df: df.where("lang = 'en'")).select("doc_id")


@query("""WITH c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS came FROM documents), l AS (SELECT doc_id, came, came + CAST(floor(CAST(CAST('0x' || substr(sha256('4:' || doc_id), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 * 256) AS BIGINT) AS leaves FROM c)
    SELECT doc_id, row_number() OVER (ORDER BY leaves, came) AS position FROM l""")
def buffered_shuffle(spark, sf_dir):
    return records.buffered_shuffle(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "doc_id", 4, 256)
