"""Text, JSON and map operators, on documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, numbers, text
from ..operators import statistics
from .registry import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT source, {WORDS} AS w FROM documents),
    g AS (SELECT source, unnest(CASE WHEN len(w) >= 2 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS g FROM w)
    SELECT source, count(*) AS n_grams, count(DISTINCT g) AS n_distinct, count(DISTINCT g) / count(*) AS distinct_2 FROM g GROUP BY source""")
def distinct_n(spark, sf_dir):
    grams = table(spark, sf_dir, "documents").select("source", F.explode(text.ngrams(text.tokens(F.col("text")), 2)).alias("g"))
    counts = grams.groupBy("source", "g").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum("n").alias("n_grams"), F.count("*").alias("n_distinct"))
    return counts.withColumn("distinct_2", F.col("n_distinct") / F.col("n_grams"))


@query(f"""SELECT lang, avg(CASE WHEN len({WORDS}) > 0 THEN 1 - len(list_distinct({WORDS})) / len({WORDS}) END) AS repetition FROM documents GROUP BY lang""")
def repetition_rate(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg(text.repetition(text.tokens(F.col("text")))).alias("repetition"))


@query(f"""WITH n AS (SELECT len({WORDS}) AS n FROM documents), s AS (SELECT count(*) AS k, avg(n) AS mean, quantile_cont(n, 0.5) AS median, stddev_pop(n) AS std, min(n) AS lo, max(n) AS hi, quantile_cont(n, 0.95) AS p95, count(DISTINCT n) AS d FROM n),
    b AS (SELECT *, least(50, greatest(10, d // 2)) AS bins FROM s), h AS (SELECT least(bins - 1, CAST(floor((n - lo) * bins / greatest(hi - lo, 1)) AS BIGINT)) AS bin, count(*) AS n FROM n, b GROUP BY 1)
    SELECT bin, h.n, k, round(mean, 2) AS mean, round(median, 2) AS median, round(std, 2) AS std, round(p95, 2) AS p95 FROM h, b""")
def length_histogram(spark, sf_dir):
    """Lengths in equal bins, as many as half the distinct lengths, from 10 to 50, beside their statistics."""
    lengths = table(spark, sf_dir, "documents").select(text.token_count(F.col("text")).alias("n"))
    return statistics.histogram(lengths, "n")


@query(r"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS token FROM documents) GROUP BY token HAVING count(*) >= 20""")
def token_vocabulary(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("token"))
    return found.groupBy("token").agg(F.count("*").alias("n")).where("n >= 20")


@query("""SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?s)<a href=')) AS n_links FROM pages""")
def page_tags(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.coalesce(F.get(text.tagged(F.col("html"), "title"), F.lit(0)), F.lit("")).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("n_links"))


@query(f"""SELECT doc_id, CASE WHEN len({WORDS}) <= 12 THEN array_to_string({WORDS}, ' ') ELSE array_to_string(({WORDS})[1:12], ' ') || ' ...' END AS short FROM documents""")
def truncated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_words(F.col("text"), 12).alias("short"))


@query("""SELECT doc_id, sha256(array_to_string(list_sort(string_split(text, chr(10))), chr(10))) AS digest FROM documents""")
def canonical_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.sorted_lines(F.col("text")), 256).alias("digest"))


@query("""WITH k AS (SELECT event_type, unnest(json_keys(props)) AS key, props FROM events) SELECT event_type, key, count(*) AS n FROM k GROUP BY ALL""")
def property_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return events.groupBy("event_type", "key").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), y AS (
    SELECT 'all' AS label, n FROM x UNION ALL SELECT 'role:' || role, n FROM x UNION ALL SELECT CASE WHEN n <= 256 THEN 'len:<=256' WHEN n <= 1024 THEN 'len:<=1024' ELSE 'len:>1024' END, n FROM x)
    SELECT label, count(*) AS n_turns, CAST(sum(n) AS BIGINT) AS n_chars FROM y GROUP BY label""")
def overlapping_strata(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("role", F.length("text").alias("n"))
    bucket = F.when(F.col("n") <= 256, "len:<=256").when(F.col("n") <= 1024, "len:<=1024").otherwise("len:>1024")
    each = turns.withColumn("label", F.explode(F.array(F.lit("all"), F.concat(F.lit("role:"), "role"), bucket)))
    return each.groupBy("label").agg(F.count("*").alias("n_turns"), F.sum("n").alias("n_chars"))


@query("""SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS shape FROM conversations GROUP BY conv_id""")
def conversation_shapes(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r.role), ">").alias("shape"))


@query("""SELECT l_orderkey, CASE WHEN count(*) > 0 THEN array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') END AS numbers FROM lineitem GROUP BY ALL""")
def line_number_lists(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("x"))
    return lines.select("l_orderkey", F.array_join(F.col("x").cast("array<string>"), ",").alias("numbers"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), i AS (SELECT l_orderkey, n, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS island FROM d),
    r AS (SELECT l_orderkey, min(n) AS a, max(n) AS b FROM i GROUP BY l_orderkey, island)
    SELECT l_orderkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '..' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY l_orderkey""")
def integer_ranges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("x"))
    return lines.select("l_orderkey", text.integer_ranges(F.col("x")).alias("ranges"))


@query("""SELECT c_custkey, regexp_replace(c_name || '/' || c_mktsegment, '[^A-Za-z0-9_-]', '_', 'g') AS safe, substr(sha256(c_name), 1, 16) AS short_id, sha1(c_name) AS sha FROM customer""")
def names_and_digests(spark, sf_dir):
    name = F.concat_ws("/", "c_name", "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", text.safe_name(name).alias("safe"), keys.short_id("c_name").alias("short_id"), F.sha1("c_name").alias("sha"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 0 THEN '0' WHEN p_size <= 4 THEN '1..4' WHEN p_size <= 16 THEN '5..16' WHEN p_size <= 32 THEN '17..32' ELSE '>32' END AS size_bin,
    CASE WHEN p_size / 64.0 = 0 THEN '0' WHEN p_size / 64.0 <= 1 / 256 THEN '(0,0.00390625]' WHEN p_size / 64.0 <= 1 / 16 THEN '(0.00390625,0.0625]' WHEN p_size / 64.0 <= 0.25 THEN '(0.0625,0.25]'
        WHEN p_size / 64.0 <= 0.5 THEN '(0.25,0.5]' WHEN p_size / 64.0 <= 1 THEN '(0.5,1]' ELSE 'unknown' END AS probability_bin FROM part""")
def bins(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", numbers.numeric_bin(F.col("p_size"), [0, 4, 16, 32]).alias("size_bin"), numbers.probability_bin(F.col("p_size") / 64.0).alias("probability_bin"))


@query(f"""SELECT lang, CAST(round_even(coalesce(quantile_cont(len({WORDS}), 0.9), 0), 0) AS BIGINT) AS p90, CAST(round_even(coalesce(quantile_cont(len({WORDS}), 0.5), 0), 0) AS BIGINT) AS p50 FROM documents GROUP BY lang""")
def rounded_percentiles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", text.token_count(F.col("text")).alias("n"))
    return docs.groupBy("lang").agg(numbers.rounded_percentile("n", 0.9).alias("p90"), numbers.rounded_percentile("n", 0.5).alias("p50"))


@query(r"""SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(text, '\.$')) AS ends_well, count(*) FILTER (contains(text, chr(10))) AS many_lines, avg(regexp_matches(text, '\.$')::INT) AS share FROM conversations GROUP BY role""")
def format_compliance(spark, sf_dir):
    ends = F.col("text").rlike(r"\.\z")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(ends).alias("ends_well"), F.count_if(F.contains("text", F.lit("\n"))).alias("many_lines"), F.avg(ends.cast("int")).alias("share"))
