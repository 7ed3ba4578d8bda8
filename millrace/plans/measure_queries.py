"""Further reports: design summaries, component means, lift, coverage bounds, bit accuracy, classes, samples, candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import documents, keys, numbers, overlap, signals, text
from ..operators import joins, ranking, records, statistics
from .registry import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"


@query(f"""WITH d AS (SELECT source, lang, doc_id, {WORDS} AS n FROM documents), c AS (SELECT source, lang, count(*) AS k, min(doc_id) AS first FROM d GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k DESC, first) AS r, sum(k) OVER (PARTITION BY source) AS t FROM c),
    s AS (SELECT source, count(*) AS n_records, count(*) FILTER (n % 2 = 0) AS sa0, count(*) FILTER (n % 2 = 1) AS sa1, count(*) FILTER (n = 0) AS n_zero, count(*) FILTER (n >= 10) AS n_ten,
        CAST(round_even(quantile_cont(n, 0.5), 0) AS BIGINT) AS median, CAST(round_even(quantile_cont(n, 0.9), 0) AS BIGINT) AS p90, max(n) AS longest FROM d GROUP BY source)
    SELECT s.*, string_agg(lang || ' ' || printf('%.1f', 100.0 * k / t), ', ' ORDER BY r) FILTER (r <= 2) AS top FROM s JOIN r USING (source) GROUP BY ALL""")
def design_summaries(spark, sf_dir):
    """Per design: records, faults by kind, lengths, and the most frequent tokens (ties in order of appearance) with their share."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", text.token_count(F.col("text")).alias("n"))
    counts = docs.groupBy("source", "lang").agg(F.count("*").alias("k"), F.min("doc_id").alias("first"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("k"), "first"))).withColumn("t", F.sum("k").over(Window.partitionBy("source")))
    listed = F.array_sort(F.collect_list(F.struct("r", F.format_string("%s %.1f", "lang", F.bround(100.0 * F.col("k") / F.col("t"), 1)).alias("s"))))
    top = ranked.where("r <= 2").groupBy("source").agg(F.array_join(F.transform(listed, lambda x: x["s"]), ", ").alias("top"))
    own = docs.groupBy("source").agg(
        F.count("*").alias("n_records"), F.count_if(F.col("n") % 2 == 0).alias("sa0"), F.count_if(F.col("n") % 2 == 1).alias("sa1"), F.count_if(F.col("n") == 0).alias("n_zero"), F.count_if(F.col("n") >= 10).alias("n_ten"),
        numbers.rounded_percentile("n", 0.5).alias("median"), numbers.rounded_percentile("n", 0.9).alias("p90"), F.max("n").alias("longest"),
    )
    return own.join(top, "source")


@query("""SELECT event_type, avg(CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 5 > 0 THEN value ELSE 0 END END) AS mean_value, count(*) AS n FROM events GROUP BY ALL""")
def component_means(spark, sf_dir):
    """Means of reward components: not-a-number is left out, an absent component counts as 0."""
    components = F.map_filter(F.create_map(F.lit("value"), F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value"))), lambda k, v: (F.col("event_id") % 5 > 0) | F.isnan(v))
    v = F.coalesce(F.try_element_at(components, F.lit("value")), F.lit(0.0))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(F.when(~F.isnan(v), v)).alias("mean_value"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id // 64 AS batch, user_id FROM events), f AS (SELECT user_id, min(batch) AS batch FROM e GROUP BY ALL), n AS (SELECT batch, count(*) AS fresh FROM f GROUP BY ALL),
    b AS (SELECT batch, count(DISTINCT user_id) AS n_distinct FROM e GROUP BY ALL)
    SELECT batch, n_distinct, CAST(sum(coalesce(fresh, 0)) OVER (ORDER BY batch) AS BIGINT) AS n_so_far FROM b LEFT JOIN n USING (batch)""")
def batch_diversity(spark, sf_dir):
    """Distinct designs in each batch, and so far: a design counts in the batch of its first sight."""
    events = table(spark, sf_dir, "events").select(F.expr("event_id div 64").alias("batch"), "user_id")
    own = events.groupBy("batch").agg(F.countDistinct("user_id").alias("n_distinct"))
    fresh = events.groupBy("user_id").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count("*").alias("fresh"))
    steps = own.join(fresh, "batch", "left").withColumn("fresh", F.coalesce("fresh", F.lit(0).cast("long")))
    return records.running_sum(steps, ["batch"], "fresh", "n_so_far").select("batch", "n_distinct", "n_so_far")


@query("""WITH g AS (SELECT l_suppkey, l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS c, avg(l_discount) AS p FROM lineitem GROUP BY ALL HAVING count(*) >= 2 AND l_orderkey % 3 > 0),
    v AS (SELECT l_suppkey, CASE WHEN n - c < 2 THEN 1.0 ELSE 1 - ((n - c) / n) * ((n - c - 1) / (n - 1)) END AS d, 1 - (1 - p) ** 2 AS r FROM g), m AS (SELECT l_suppkey, avg(d - r) AS gap FROM v GROUP BY ALL)
    SELECT (SELECT count(*) FROM v) AS n_paired, (SELECT avg(r) FROM v) AS random_2, (SELECT avg(d) - avg(r) FROM v) AS lift, avg(gap) AS macro_lift FROM m""")
def lift_over_random(spark, sf_dir):
    """pass@2 less what two uniform vectors would detect, over rows that know both; mean of rows and mean of circuit means."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("c"), F.avg("l_discount").alias("p"))
    return statistics.lift_over_random(g.where("n >= 2 and l_orderkey % 3 > 0"), "l_suppkey", "n", "c", "p", 2)


_GRAMS = r"regexp_extract_all(lower({}), '[a-z0-9]+')"


def _sql_rouge(n: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""SELECT page_id, side, g, count(*) AS k FROM (SELECT page_id, side, unnest(list_transform(generate_series(1, len(w) - {n - 1}), lambda i: {gram})) AS g FROM w WHERE len(w) >= {n}) GROUP BY ALL"""


@query(f"""WITH w AS (SELECT page_id, 'a' AS side, {_GRAMS.format("substr(html, 1, 400)")} AS w FROM pages UNION ALL SELECT page_id, 'b', {_GRAMS.format("substr(html, 201, 400)")} FROM pages),
    g1 AS ({_sql_rouge(1)}), g2 AS ({_sql_rouge(2)}),
    h1 AS (SELECT page_id, sum(CASE WHEN side = 'a' THEN m END) AS h, any_value(t) AS t FROM (SELECT page_id, side, g, CASE WHEN count(*) OVER (PARTITION BY page_id, g) = 2 THEN min(k) OVER (PARTITION BY page_id, g) ELSE 0 END AS m, sum(k) OVER (PARTITION BY page_id) AS t FROM g1) GROUP BY ALL),
    h2 AS (SELECT page_id, sum(CASE WHEN side = 'a' THEN m END) AS h, any_value(t) AS t FROM (SELECT page_id, side, g, CASE WHEN count(*) OVER (PARTITION BY page_id, g) = 2 THEN min(k) OVER (PARTITION BY page_id, g) ELSE 0 END AS m, sum(k) OVER (PARTITION BY page_id) AS t FROM g2) GROUP BY ALL)
    SELECT page_id, coalesce(2.0 * h1.h / h1.t, 0.0) AS rouge_1, coalesce(2.0 * h2.h / h2.t, 0.0) AS rouge_2 FROM pages LEFT JOIN h1 USING (page_id) LEFT JOIN h2 USING (page_id)""")
def rouge_scores(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.substring("html", 1, 400).alias("a"), F.substring("html", 201, 400).alias("b"))
    return pages.select("page_id", overlap.rouge_n(F.col("a"), F.col("b"), 1).alias("rouge_1"), overlap.rouge_n(F.col("a"), F.col("b"), 2).alias("rouge_2"))


@query()
def bleu_and_longest(spark, sf_dir):
    """Corpus BLEU and mean ROUGE-L of answers against the turn before; the tests hold both against plain versions."""
    turns = table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    both = turns.where("role = 'assistant'").join(before, ["conv_id", "turn"])
    scored = both.select(overlap.bleu_counts(F.col("reference"), F.col("text")).alias("c"), overlap.rouge_l(F.col("reference"), F.col("text")).alias("l"))
    return scored.agg(F.count("*").alias("n"), overlap.corpus_bleu(F.col("c")).alias("bleu"), F.avg("l").alias("rouge_l"))


@query("""WITH v AS (SELECT o_custkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS v FROM orders)
    SELECT o_custkey, count(*) AS n, (count(DISTINCT v) + least(count(*) FILTER (v IS NULL), 1)) / count(*) AS diversity, count(v) / count(*) AS validity FROM v GROUP BY ALL""")
def output_diversity(spark, sf_dir):
    """Distinct answers to a prompt, all unreadable ones as one, and the share of readable ones."""
    v = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").withColumn("v", v).groupBy("o_custkey").agg(
        F.count("*").alias("n"), ((F.countDistinct("v") + F.least(F.count_if(F.col("v").isNull()), F.lit(1))) / F.count("*")).alias("diversity"), (F.count("v") / F.count("*")).alias("validity")
    )


@query("""WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, p_type) AS up, row_number() OVER (ORDER BY n, p_type DESC) AS down FROM c),
    x AS (SELECT a.p_type, a.n, b.share AS w FROM r a JOIN r b ON a.up = b.down), m AS (SELECT avg(w) AS a, stddev_pop(w) AS s FROM x), z AS (SELECT p_type, n, (w - a) / (s + 0.001) AS z FROM x, m)
    SELECT p_type, n, round(z + max(z) OVER () - min(z) OVER (), 9) AS weight FROM z""")
def class_weights(spark, sf_dir):
    return statistics.class_weights(table(spark, sf_dir, "part"), "p_type").select("p_type", "n", F.round("weight", 9).alias("weight"))


@query("""WITH m AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN l_discount END) AS a, avg(CASE WHEN l_linestatus = 'O' AND l_quantity > 45 THEN l_tax END) AS b, avg(l_discount) AS c FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, (coalesce(0.45 * a, 0) + coalesce(0.35 * b, 0) + 0.2 * c) / (CASE WHEN a IS NULL THEN 0 ELSE 0.45 END + CASE WHEN b IS NULL THEN 0 ELSE 0.35 END + 0.2) AS score,
        0.45 * c + 0.25 * c + 0.2 * c + 0.1 * exp(-least(l_suppkey, 20.0)) AS composite FROM m""")
def defined_scores(spark, sf_dir):
    """A weighted mean over the metrics that are defined, and a composite with a bounded loss."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.avg(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), F.col("l_discount"))).alias("a"),
        F.avg(F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45), F.col("l_tax"))).alias("b"), F.avg("l_discount").alias("c"),
    )
    return lines.select("l_suppkey", numbers.weighted_defined({"a": 0.45, "b": 0.35, "c": 0.2}).alias("score"), numbers.alignment_score(F.col("c"), F.col("c"), F.col("c"), F.col("l_suppkey").cast("double")).alias("composite"))


@query("""WITH c AS (SELECT l_orderkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag = 'R' END AS d FROM lineitem), f AS (SELECT l_orderkey, l_suppkey, coalesce(bool_or(d), false) AS lo, bool_or(coalesce(d, true)) AS hi FROM c GROUP BY ALL)
    SELECT l_orderkey, count(*) AS n_faults, avg(lo::INT) AS low, avg(hi::INT) AS high FROM f GROUP BY ALL""")
def coverage_bounds(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("d", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R"))
    return ranking.coverage_bounds(lines, "l_orderkey", "l_suppkey", "d")


@query("""SELECT CASE WHEN p_size <= 10 THEN 'easy' WHEN p_size <= 30 THEN 'medium' ELSE 'hard' END AS bin, l_returnflag AS polarity, CASE WHEN l_tax = 0 THEN 'zeros' ELSE 'other' END AS kind, count(*) AS slots,
    count(*) FILTER (l_linestatus = 'O') AS det, count(*) FILTER (l_linestatus = 'O') / count(*) AS rate, sum(CASE WHEN l_discount > 0 THEN 1 ELSE 0 END)::BIGINT AS act_n,
    CASE WHEN count(*) FILTER (l_discount > 0) > 0 THEN count(*) FILTER (l_discount > 0.05) / count(*) FILTER (l_discount > 0) END AS act_rate FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def bin_counters(spark, sf_dir):
    """Counters by difficulty bin, polarity and kind of vector, with ratios that are null on nothing."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") <= 10, "easy").when(F.col("p_size") <= 30, "medium").otherwise("hard").alias("bin"))
    lines = table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    g = lines.groupBy("bin", F.col("l_returnflag").alias("polarity"), F.when(F.col("l_tax") == 0, "zeros").otherwise("other").alias("kind"))
    c = g.agg(F.count("*").alias("slots"), F.count_if(F.col("l_linestatus") == "O").alias("det"), F.count_if(F.col("l_discount") > 0).alias("act_n"), F.count_if(F.col("l_discount") > 0.05).alias("act"))
    return c.select("bin", "polarity", "kind", "slots", "det", numbers.ratio(F.col("det"), F.col("slots")).alias("rate"), "act_n", numbers.ratio(F.col("act"), F.col("act_n")).alias("act_rate"))


_BITS = "lpad(bin(o_orderkey % 32), 5, '0')"


@query(f"""WITH p AS (SELECT o_custkey, {_BITS} AS b FROM orders), c AS (SELECT o_custkey, b, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT o_custkey, max(n) / sum(n) AS exact, count(*) AS n_patterns FROM c GROUP BY ALL),
    i AS (SELECT o_custkey, k, avg(substr(b, k, 1)::INT) AS a FROM p, generate_series(1, 5) AS s(k) GROUP BY ALL), j AS (SELECT o_custkey, avg(greatest(a, 1 - a)) AS per_bit, count(*) FILTER (a > 0 AND a < 1) AS n_variable FROM i GROUP BY ALL)
    SELECT * FROM m JOIN j USING (o_custkey)""")
def output_baselines(spark, sf_dir):
    """How right the most frequent output, and the most frequent value of each bit, would be; bits that vary at all."""
    bits = F.lpad(F.bin(F.col("o_orderkey") % 32), 5, "0")
    return statistics.output_baselines(table(spark, sf_dir, "orders").select("o_custkey", bits.alias("b")), "o_custkey", "b", 5)


@query(f"""WITH b AS (SELECT CASE WHEN o_totalprice <= 2048 THEN 'le_2048' WHEN o_totalprice <= 50000 THEN 'le_50000' ELSE 'more' END AS bucket, bit_count(xor(CAST(o_orderkey % 32 AS INTEGER), CAST(o_custkey % 32 AS INTEGER))) AS wrong FROM orders)
    SELECT bucket, count(*) AS slots, CAST(5 * count(*) AS BIGINT) AS bits, sum(5 - wrong) / (5 * count(*)) AS micro, avg((5 - wrong) / 5) AS macro, avg((wrong = 0)::INT) AS exact FROM b GROUP BY ALL""")
def bit_accuracy(spark, sf_dir):
    """Right bits over all bits, mean share of right bits, whole vectors right, by length."""
    bucket = F.when(F.col("o_totalprice") <= 2048, "le_2048").when(F.col("o_totalprice") <= 50000, "le_50000").otherwise("more")
    bits = lambda c: F.lpad(F.bin(F.col(c) % 32), 5, "0")
    wrong = signals.hamming(bits("o_orderkey"), bits("o_custkey"))
    g = table(spark, sf_dir, "orders").select(bucket.alias("bucket"), wrong.alias("w"), F.lit(5).alias("k")).groupBy("bucket")
    return g.agg(F.count("*").alias("slots"), F.sum("k").alias("bits"), (F.sum((1 - F.col("w")) * F.col("k")) / F.sum("k")).alias("micro"), F.avg(1 - F.col("w")).alias("macro"), F.avg((F.col("w") == 0).cast("int")).alias("exact"))


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM c)
    SELECT p_brand, count(*) AS n_unique, string_agg(p_type || ' ' || n, ', ' ORDER BY r) FILTER (r <= 3) AS top, count(*) FILTER (n >= 4) AS n_high FROM r GROUP BY ALL""")
def template_frequencies(spark, sf_dir):
    """Distinct templates, the three most frequent, and how many have a high count."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return statistics.most_common(counts, "p_brand", "p_type", "n", 3, high=4)


@query("""WITH s AS (SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS t, source, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split FROM documents)
    SELECT split, count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count(DISTINCT source) AS n_sources, count(DISTINCT t) AS n_texts, count(DISTINCT CASE WHEN t IN (SELECT t FROM s WHERE split = 'train') THEN t END) AS texts_in_train,
        count(DISTINCT CASE WHEN source IN (SELECT source FROM s WHERE split = 'train') THEN source END) AS sources_in_train FROM s GROUP BY split""")
def split_audit(spark, sf_dir):
    """Rows and identities of each split, and how many of each identity the training split has too."""
    digest = F.sha2(F.replace("text", F.lit("\r\n"), F.lit("\n")), 256)
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "validation").otherwise("test")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", digest.alias("text"), split.alias("split"))
    return statistics.split_audit(docs, "split", "train", {"ids": "doc_id", "sources": "source", "texts": "text"}).select("split", "n_rows", "n_ids", "n_sources", "n_texts", "texts_in_train", "sources_in_train")


@query("""SELECT l_orderkey, string_agg(base || ':' || width, ',' ORDER BY base) AS buses FROM (SELECT l_orderkey, 'p' || l_returnflag AS base, max(l_linenumber) + 1 AS width FROM lineitem GROUP BY ALL UNION ALL SELECT DISTINCT l_orderkey, 'clk', 1 FROM lineitem) GROUP BY ALL""")
def bus_groups(spark, sf_dir):
    names = F.concat(F.collect_list(F.concat(F.lit("p"), "l_returnflag", F.lit("["), F.col("l_linenumber").cast("string"), F.lit("]"))), F.array(F.lit("clk")))
    widths = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(names.alias("names")).select("l_orderkey", signals.bus_widths(F.col("names")).alias("w"))
    return widths.select("l_orderkey", F.array_join(F.transform(F.array_sort(F.map_entries("w")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("buses"))


@query("""SELECT l_suppkey, count(*) FILTER (l_partkey % 2 = l_orderkey % 2) AS n_unchanged, avg((l_partkey % 2 = l_orderkey % 2 AND l_returnflag = 'R')::INT) AS detected, avg((l_partkey % 2 = l_orderkey % 2)::INT) AS known FROM lineitem GROUP BY ALL""")
def first_proposals(spark, sf_dir):
    """First tool arguments against final answers: an unchanged stimulus takes over the measured outcome, a changed one is unknown."""
    blank = lambda b: F.concat(F.lit("<parameter=input_vector>\nx: "), (F.col(b) % 2).cast("string"), F.lit("\n</parameter></tool_call> later <parameter=input_vector>x: 9</parameter>"))
    first = text.assignment(F.regexp_extract(F.substring_index(blank("l_partkey"), "</tool_call>", 1), r"(?s)<parameter=input_vector>\s*(.*?)\s*</parameter>", 1))
    final = text.assignment(F.concat(F.lit("x: "), (F.col("l_orderkey") % 2).cast("string")))
    same = F.coalesce(F.element_at(first, "x") == F.element_at(final, "x"), F.lit(False))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", same.alias("same"), (same & (F.col("l_returnflag") == "R")).alias("d"))
    return lines.groupBy("l_suppkey").agg(F.count_if("same").alias("n_unchanged"), F.avg(F.col("d").cast("int")).alias("detected"), F.avg(F.col("same").cast("int")).alias("known"))


@query("""SELECT event_id, 8 * (1 + event_id % 3) * 4 AS sequences, greatest(1, 8 * (1 + event_id % 3) * 4 // 6) AS prompts_per_step, 100 + event_id * greatest(1, 8 * (1 + event_id % 3) * 4 // 6) AS cumulative, greatest(0, CAST(json_extract(props, '$.k') AS BIGINT) - 50) AS restored FROM events""")
def consumed_rows(spark, sf_dir):
    """What a run has consumed at a step, and the counter that a later run skips by, never below 0."""
    events = table(spark, sf_dir, "events")
    state = statistics.consumed(F.lit(8), 1 + F.col("event_id") % 3, F.lit(4), F.lit(6), F.col("event_id"), F.lit(100))
    held = F.to_json(F.struct((F.get_json_object("props", "$.k").cast("long") - 50).alias("cumulative_skip_buffer_size")))
    return events.select("event_id", *state, statistics.skip_counter(held).alias("restored"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'unknown' WHEN p_size % 7 = 0 THEN 'proven' WHEN p_size / 64.0 >= 0.25 THEN 'easy_p>=0.25' WHEN p_size / 64.0 >= 0.0625 THEN 'medium_0.0625<=p<0.25' ELSE 'hard_0.00390625<=p<0.0625' END AS difficulty,
    CASE WHEN p_size % 4 = 0 THEN 'po' WHEN p_size % 4 = 1 THEN 'pi' WHEN p_size % 4 = 2 THEN 'po' ELSE 'internal' END AS site,
    CASE WHEN p_size < 2 THEN 'X1' WHEN p_size < 3 THEN 'X2' WHEN p_size < 4 THEN 'X3' WHEN p_size < 6 THEN 'X4' WHEN p_size < 8 THEN 'X6' WHEN p_size < 12 THEN 'X8' WHEN p_size < 16 THEN 'X12' ELSE 'X16_PLUS' END AS drive,
    'NAND' || (p_size % 8) AS cell, CASE WHEN p_size % 8 = 0 THEN 'UNKNOWN' WHEN p_size % 8 >= 6 THEN '6_PLUS' ELSE (p_size % 8)::VARCHAR END AS inputs, 'NAND' AS family FROM part WHERE p_size > 0""")
def fault_classes(spark, sf_dir):
    """Difficulty, site, drive strength, inputs and family of a fault's cell."""
    part = table(spark, sf_dir, "part").where("p_size > 0")
    n = F.col("p_size") % 8
    cell = F.concat(F.lit("NAND"), n.cast("string"), F.lit("x"), F.col("p_size").cast("string"), F.lit("_ASAP7_75t_R"))
    net = F.element_at(F.array(F.lit("y"), F.lit("a"), F.lit("y_82"), F.lit("w")), (F.col("p_size") % 4 + 1).cast("int"))
    status = F.when(F.col("p_size") % 5 == 0, "failed").otherwise("ok")
    base = signals.base_cell(cell)
    return part.select(
        "p_partkey", signals.difficulty_class(status, F.when(F.col("p_size") % 7 == 0, "proven"), F.col("p_size") / 64.0).alias("difficulty"),
        signals.site_class(net, F.array(F.lit("a"), F.lit("y[82]")), F.array(F.lit("y"), F.lit("y[82]"))).alias("site"), signals.drive_class(signals.drive_value(cell)).alias("drive"),
        base.alias("cell"), signals.input_class(n).alias("inputs"), signals.family(base, F.create_map(F.lit("NAND"), F.lit("NAND"))).alias("family"),
    )


@query("""SELECT p_partkey, list_filter([1, 2, 4, 8, 16], lambda h: p_size % h = 0) AS choices FROM part""")
def compatible_choices(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.filter(F.array(*(F.lit(h) for h in (1, 2, 4, 8, 16))), lambda h: F.col("p_size") % h == 0).alias("choices"))


@query("""SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 7""")
def sample_listing(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(7)


@query("""WITH f AS (SELECT l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem) ORDER BY sha256('3:' || l_partkey), l_partkey LIMIT 20),
    r AS (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY sha256('3:' || l_orderkey), l_orderkey) AS r FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) JOIN f USING (l_partkey)) SELECT l_partkey, l_orderkey FROM r WHERE r <= 4""")
def file_sample(spark, sf_dir):
    """A uniform sample of files, then at most four rows of each."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct()
    files = rows.select("l_partkey").distinct().orderBy(keys.seeded_order(3, F.col("l_partkey")), "l_partkey").limit(20)
    order = Window.partitionBy("l_partkey").orderBy(keys.seeded_order(3, F.col("l_orderkey")), "l_orderkey")
    return rows.join(F.broadcast(files), "l_partkey").withColumn("r", F.row_number().over(order)).where("r <= 4").drop("r")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS a, l_linestatus = 'O' AS d, l_discount AS s FROM lineitem)
    SELECT l_orderkey, arg_max(l_linenumber, (a, d, s, l_linenumber, l_partkey)) AS best, max(CASE WHEN a THEN 1.0 WHEN d THEN 0.8 ELSE 0.2 END)::DOUBLE AS value FROM c GROUP BY ALL""")
def best_candidates(spark, sf_dir):
    """The best candidate by acceptance, detection, then score, and what a search takes it to be worth."""
    a, d = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    worth = F.when(a, 1.0).when(d, 0.8).otherwise(0.2)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct(a, d, "l_discount", "l_linenumber", "l_partkey")).alias("best"), F.max(worth).alias("value"))


@query()
def surviving_candidates(spark, sf_dir):
    """The best vector, then by quality and distance to those kept; one group a customer.  A plain version is in the tests."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("quality"), "o_totalprice", F.lpad(F.bin(F.col("o_orderkey") % 64), 6, "0").alias("vector"))
    return ranking.survivors(orders, "o_custkey", "o_orderkey", ["quality"], "o_totalprice", "vector", 4)


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3""")
def recent_checkpoints(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("age")).where("age <= 3")


@query("""SELECT o_orderkey, length(rtrim(o_orderkey::VARCHAR, '0')) AS n, CASE WHEN length(rtrim(o_orderkey::VARCHAR, '0')) < 4 THEN length(rtrim(o_orderkey::VARCHAR, '0')) ELSE -1 END AS bounded, rpad(o_orderkey::VARCHAR, 12, '0') AS padded FROM orders""")
def stripped_lengths(spark, sf_dir):
    """Length without the padding at the end, -1 for what is too long, and padding to a common length."""
    key = F.col("o_orderkey").cast("string")
    n = text.stripped_length(F.split(F.regexp_replace(key, "(.)", "$1 "), " "), F.lit("0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", n.cast("long").alias("n"), F.when(n < 4, n).otherwise(-1).cast("long").alias("bounded"), F.rpad(key, 12, "0").alias("padded"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 7 > 0 THEN value >= 1 ELSE event_id % 7 = 0 AND value >= 1 AND event_id % 2 = 1 END AS detected, (value - event_id % 3) > 0 AS positive,
    value * 1.0 + 0.25 * (event_id % 3) AS scalar, event_type || '=' || value::VARCHAR AS kept FROM events""")
def acceptance_modes(spark, sf_dir):
    """Acceptance by detection (also under its logged name) or by positive reward, the weighted scalar, and the requested keys only."""
    e = F.col("event_id")
    components = F.map_filter(F.create_map(F.lit("detection"), F.when((e % 2 == 0) & (e % 7 > 0), F.col("value")), F.lit("detection_logonly"), F.when((e % 2 == 1) & (e % 7 == 0), F.col("value"))), lambda k, v: v.isNotNull())
    scored = F.create_map(F.lit("detection"), F.col("value"), F.lit("activation"), (e % 3).cast("double"), F.lit("note_logonly"), F.lit(99.0), F.lit("broken"), F.lit(float("nan")))
    kept = F.map_filter(F.create_map("event_type", F.col("value"), F.lit("other"), F.lit(0.0)), lambda k, v: k == F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", documents.accepted(components, "detection").alias("detected"), (F.col("value") - e % 3 > 0).alias("positive"), documents.weighted_scalar(scored, {"detection": 1.0, "activation": 0.25}).alias("scalar"),
        F.array_join(F.transform(F.map_entries(kept), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("kept"),
    )


@query("""SELECT o_totalprice, o_orderkey, o_custkey FROM orders WHERE NOT (o_totalprice > 1000 AND o_orderkey % 3 > 0 AND o_orderstatus <> 'F')""")
def failing_checks(spark, sf_dir):
    """Rows that fail any of several flags; columns in a stated order, an error if one is missing."""
    flags = {"price": F.col("o_totalprice") > 1000, "key": F.col("o_orderkey") % 3 > 0, "state": F.col("o_orderstatus") != "F"}
    rows = table(spark, sf_dir, "orders").withColumns({f"ok_{k}": v for k, v in flags.items()})
    return joins.selected(rows.where("not (ok_price and ok_key and ok_state)"), ["o_totalprice", "o_orderkey", "o_custkey"])


@query("""SELECT c_custkey, CASE WHEN c_acctbal * 1000 >= 1048576 THEN printf('%.4f MB', c_acctbal * 1000 / 1048576) WHEN c_acctbal * 1000 >= 1024 THEN printf('%.4f KB', c_acctbal * 1000 / 1024) ELSE printf('%.4f bytes', c_acctbal * 1000) END AS size,
    CASE WHEN c_custkey * 97 >= 86400 THEN (c_custkey * 97 // 86400) || ' days, ' ELSE '' END || printf('%02d:%02d:%02d', (c_custkey * 97 // 3600) % 24, (c_custkey * 97 // 60) % 60, (c_custkey * 97) % 60) AS lasted FROM customer WHERE c_acctbal > 0""")
def readable_quantities(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return customers.select("c_custkey", documents.human_bytes(F.col("c_acctbal") * 1000).alias("size"), documents.days_to_seconds(F.col("c_custkey") * 97).alias("lasted"))


_HEX = "concat(" + ", ".join(f"CASE substr(sha256('4:' || s_suppkey), {i}, 1) " + " ".join(f"WHEN '{h:x}' THEN '{h:04b}'" for h in range(16)) + " END" for i in (1, 2, 3)) + ")"


@query(f"""WITH v AS (SELECT s_suppkey, substr({_HEX}, 1, 10) AS b FROM supplier)
    SELECT s_suppkey, b AS bits, 'n0: ' || substr(b, 1, 1) || ', n1: ' || substr(b, 2, 1) AS answer, reverse(b) AS mirrored, substr(b, 1, 1) = '1' AND substr(b, 2, 1) = '1' AS both, (length(replace(b, '0', '')) % 2)::INT AS parity,
        1 - (length(replace(b, '0', '')) > 0)::INT AS none, length(replace(b, '0', '')) / 10 AS distance FROM v""")
def bit_vectors(spark, sf_dir):
    """Fixed random vectors, their text, their buses in reverse, gates over them and distances."""
    bits = signals.random_bits(4, F.col("s_suppkey"), 10)
    names = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("b["), i.cast("string"), F.lit("]")))
    mirrored = F.array_join(F.transform(signals.reversed_buses(signals.named_bits(names, F.col("bits"))), lambda p: p["bit"].cast("string")), "")
    each = F.filter(F.split("bits", ""), lambda b: b != "")
    two = F.array(F.lit("n0"), F.lit("n1"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", bits.alias("bits")).select(
        "s_suppkey", "bits", signals.answer_text(two, F.left("bits", F.lit(2))).alias("answer"), mirrored.alias("mirrored"), (signals.gate("and", F.slice(each, 1, 2)) == 1).alias("both"),
        signals.gate("xor", each).alias("parity"), signals.gate("nor", each).alias("none"), signals.hamming(F.col("bits"), F.lit("0" * 10)).alias("distance"),
    )
