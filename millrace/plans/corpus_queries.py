"""Corpus preparation: filters, first occurrences, quotas, splits, samples, orders, overlap, on documents and its peers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import records, statistics
from .registry import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"
UNIT = "CAST(CAST('0x' || substr(sha256('42:' || {}), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"
SPLIT = f"CASE WHEN {UNIT.format('text')} < 0.8 / 1.0 THEN 'train' WHEN {UNIT.format('text')} < 0.9 THEN 'validation' ELSE 'test' END"
FIRSTS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"


@query(f"""SELECT split, count(*) AS n_rows, count(DISTINCT source) AS n_sources FROM (
    SELECT source, {SPLIT} AS split FROM ({FIRSTS}) WHERE {WORDS} < 2048) GROUP BY split""")
def corpus_split_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source").where(text.token_count(F.col("text")) < 2048)
    split = records.first_occurrence(docs, ["text"], ["doc_id"]).withColumn("split", keys.hash_split(42, F.col("text")))
    return split.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"))


@query(f"SELECT doc_id, source FROM ({FIRSTS})")
def first_occurrences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", keys.sha256("text").alias("digest"))
    return records.first_occurrence(docs, ["digest"], ["doc_id"]).select("doc_id", "source")


@query(f"SELECT doc_id, source, lang, {SPLIT.replace('text', 'source')} AS split FROM documents")
def split_by_group(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", keys.hash_split(42, F.col("source")).alias("split"))


@query(f"""SELECT state, count(*) AS n FROM (SELECT CASE WHEN len(regexp_extract_all(text, '[.]')) IN (1, 5, 84) THEN 'gate'
    WHEN {WORDS} >= 500 THEN 'length' ELSE 'ok' END AS state FROM documents) GROUP BY state""")
def classify_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text")
    state = records.tri_state(~F.regexp_count("text", F.lit("[.]")).isin(1, 5, 84), text.token_count(F.col("text")), 500)
    return docs.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, {WORDS} < 200 AS short, {WORDS} < 1000 AS medium FROM documents""")
def dual_thresholds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.token_count(F.col("text")).alias("n"))
    return docs.select("doc_id", (F.col("n") < 200).alias("short"), (F.col("n") < 1000).alias("medium"))


@query("""SELECT conv_id, count(*) AS n_prompt_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations
    WHERE role NOT IN ('assistant', 'tool') GROUP BY conv_id""")
def prompt_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where(~F.col("role").isin("assistant", "tool"))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_prompt_turns"), F.sum(F.length("text")).alias("n_chars"))


@query("""SELECT d.doc_id, d.source, d.lang FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1""")
def score_gate(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(good, "doc_id", "left_semi")


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS n_tokens FROM documents),
    m AS (SELECT n_tokens FROM w GROUP BY n_tokens ORDER BY count(*) DESC, n_tokens LIMIT 1)
    SELECT doc_id, n_tokens FROM w WHERE n_tokens IN (SELECT n_tokens FROM m)""")
def modal_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))
    return records.modal_length(docs, "n_tokens")


@query("""SELECT doc_id FROM documents ORDER BY doc_id LIMIT 300 OFFSET 100""")
def quota_window(spark, sf_dir):
    return records.skip_take(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 100, 300)


@query(f"""WITH ok AS (SELECT doc_id, text FROM documents WHERE {WORDS} < 1000),
    sft AS (SELECT doc_id FROM ok ORDER BY doc_id LIMIT 200),
    grpo AS (SELECT min(doc_id) AS doc_id FROM ok GROUP BY text ORDER BY 1 LIMIT 150 OFFSET 50)
    SELECT doc_id, 'sft' AS part FROM sft UNION ALL SELECT doc_id, 'grpo' FROM grpo""")
def two_quotas(spark, sf_dir):
    ok = table(spark, sf_dir, "documents").where(text.token_count(F.col("text")) < 1000)
    sft = records.skip_take(ok.select("doc_id"), ["doc_id"], 0, 200).withColumn("part", F.lit("sft"))
    unique = ok.groupBy(keys.sha256("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return sft.unionByName(records.skip_take(unique, ["doc_id"], 50, 150).withColumn("part", F.lit("grpo")))


@query("""SELECT doc_id, source FROM documents ORDER BY sha256('17:' || doc_id), doc_id LIMIT 100""")
def uniform_sample(spark, sf_dir):
    return records.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 17, 100)


@query("""SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('17:' || doc_id), doc_id) AS t FROM documents)
    ORDER BY t, sha256('17:' || source || '|' || lang), doc_id LIMIT 120""")
def stratified_sample(spark, sf_dir):
    return records.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 17, 120)


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('5:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 4""")
def per_source_sample(spark, sf_dir):
    return records.per_group_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", 5, 4)


_INTERLEAVE = """WITH g AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS group_order FROM documents GROUP BY lang),
    r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
    SELECT doc_id, lang, g.group_order, {} AS slot FROM r JOIN g USING (lang)"""


@query(_INTERLEAVE.format("(rn - 0.5) / n"))
def even_interleave(spark, sf_dir):
    return records.interleave(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"]).select("doc_id", "lang", "group_order", "slot")


@query(_INTERLEAVE.format("CAST(rn AS DOUBLE)"))
def round_robin(spark, sf_dir):
    return records.interleave(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], "round_robin").select("doc_id", "lang", "group_order", "slot")


@query("""SELECT window_no, count(DISTINCT source) AS n_distinct, count(*) AS n_rows FROM
    (SELECT source, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS window_no FROM documents) GROUP BY window_no HAVING count(*) = 64 OR window_no = 0""")
def diversity_windows(spark, sf_dir):
    return records.window_distinct(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 64)


@query("""WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT max(n) AS top FROM g),
    r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('0:' || doc_id), doc_id) AS rn FROM documents)
    SELECT doc_id, lang, unnest(generate_series(1, (top - rn) // n + 1)) AS copy FROM r JOIN g USING (lang), t""")
def balanced_groups(spark, sf_dir):
    return records.balance(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", "copy")


@query(f"""WITH s AS (SELECT source, text, {SPLIT.replace('text', 'doc_id')} AS split FROM documents),
    a AS (SELECT DISTINCT text FROM s WHERE split = 'train'), b AS (SELECT DISTINCT text FROM s WHERE split = 'test')
    SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (text)) AS n_both,
        100.0 * (SELECT count(*) FROM a JOIN b USING (text)) / (SELECT count(*) FROM b) AS percent""")
def split_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(keys.sha256("text").alias("digest"), keys.hash_split(42, F.col("doc_id")).alias("split"))
    return records.overlap(docs.where("split = 'train'"), docs.where("split = 'test'"), ["digest"]).withColumn("percent", F.col("percent").cast("double"))


@query(f"""WITH h AS (SELECT doc_id, sha256(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g')) AS net, {SPLIT.replace('text', 'doc_id')} AS split FROM documents)
    SELECT doc_id FROM h WHERE split = 'train' AND net NOT IN (SELECT net FROM h WHERE split = 'test')""")
def holdout_by_alias(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", keys.aliases(F.col("text"), F.col("doc_id")).alias("names"), keys.hash_split(42, F.col("doc_id")).alias("split"))
    return records.without_holdout(docs.where("split = 'train'"), docs.where("split = 'test'"), "doc_id", "names").select("doc_id")


@query("""SELECT s.conv_id, s.turn, c.conv_id IS NULL AS missing FROM
    (SELECT conv_id, unnest(generate_series(0, 7)) AS turn FROM (SELECT DISTINCT conv_id FROM conversations)) s
    LEFT JOIN conversations c ON c.conv_id = s.conv_id AND c.turn = s.turn""")
def expected_slots(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return records.fill_slots(turns.select("conv_id").distinct(), turns, ["conv_id"], 8, "turn").select("conv_id", F.col("turn").cast("long").alias("turn"), "missing")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS r, count(*) OVER () AS k FROM c)
    SELECT max(k) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows, max(CASE WHEN r = k // 2 + 1 THEN n END) AS middle_count,
        sum(CASE WHEN r <= 1 THEN n END) / sum(n) AS top1_share, sum(CASE WHEN r <= 3 THEN n END) / sum(n) AS top3_share, sum(CASE WHEN r <= 10 THEN n END) / sum(n) AS top10_share FROM r""")
def source_shares(spark, sf_dir):
    return statistics.top_shares(table(spark, sf_dir, "documents").select("source"), "source")


@query("""SELECT sha1(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 2""")
def repeated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha1("text").alias("digest")).agg(F.count("*").alias("n")).where("n >= 2")


@query(f"""SELECT lang, count(*) AS n, avg({WORDS}) AS mean, coalesce(stddev_samp({WORDS}), 0) AS std, min({WORDS}) AS minimum, quantile_cont({WORDS}, 0.25) AS q1,
    quantile_cont({WORDS}, 0.5) AS median, quantile_cont({WORDS}, 0.75) AS q3, max({WORDS}) AS maximum FROM documents GROUP BY lang""")
def length_boxes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", text.token_count(F.col("text")).alias("n_tokens"))
    return statistics.box_statistics(docs, ["lang"], "n_tokens")


@query("""SELECT doc_id // 512 AS buffer, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS fingerprint, count(*) AS n_rows FROM documents GROUP BY 1""")
def buffer_fingerprint(spark, sf_dir):
    """The ordered fingerprint of every training buffer of 512 consecutive ids; a buffer bounds each group."""
    rows = table(spark, sf_dir, "documents").select(F.expr("doc_id div 512").alias("buffer"), "doc_id", keys.sha256("text").alias("digest"))
    listed = F.array_sort(F.collect_list(F.struct("doc_id", "digest")))
    return rows.groupBy("buffer").agg(F.sha2(F.array_join(F.transform(listed, lambda r: r.digest), "\n"), 256).alias("fingerprint"), F.count("*").alias("n_rows"))


@query("""SELECT b.item_id, count(d.doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d ON sha256(d.text) = sha256(b.text) GROUP BY b.item_id""")
def benchmark_contamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", keys.sha256("text").alias("digest"))
    items = table(spark, sf_dir, "benchmark").select("item_id", keys.sha256("text").alias("digest"))
    return items.join(docs, "digest", "left").groupBy("item_id").agg(F.count("doc_id").alias("n_docs"))


@query("""SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS short_id, CAST(CAST('0x' || substr(sha256('9:' || doc_id), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS draw FROM documents
    WHERE CAST(CAST('0x' || substr(sha256('9:' || doc_id), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 < 0.05""")
def bernoulli_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("draw", keys.unit_interval(9, F.col("doc_id"))).where("draw < 0.05")
    return docs.select("doc_id", keys.short_id("text").alias("short_id"), "draw")
