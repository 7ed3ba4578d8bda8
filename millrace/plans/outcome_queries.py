"""Outcome statistics: pass@k, micro and macro means, strata, intervals, advantages, ranking, coverage, on orders and lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import ranking, statistics
from .registry import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, n, c, c::DOUBLE / n AS pass_1, CASE WHEN n < 2 THEN NULL WHEN n - c < 2 THEN 1.0 ELSE 1 - ((n - c) / n) * ((n - c - 1) / (n - 1)) END AS pass_2,
        CASE WHEN n < 4 THEN NULL WHEN n - c < 4 THEN 1.0 ELSE 1 - ((n - c) / n) * ((n - c - 1) / (n - 1)) * ((n - c - 2) / (n - 2)) * ((n - c - 3) / (n - 3)) END AS pass_4 FROM g""")
def pass_at_k(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("c"))
    return g.select("l_orderkey", "n", "c", *(numbers.pass_at_k(F.col("n"), F.col("c"), k).alias(f"pass_{k}") for k in (1, 2, 4)))


@query("""WITH p AS (SELECT l_suppkey, l_orderkey, avg((l_returnflag = 'R')::INT) AS p, sum((l_returnflag = 'R')::INT) AS s, count(*) AS k FROM lineitem GROUP BY ALL),
    c AS (SELECT l_suppkey, avg(p) AS c, sum(s) AS s, sum(k) AS k, count(*) AS n FROM p GROUP BY ALL)
    SELECT sum(s) / sum(k) AS micro, avg(c) AS macro, CAST(sum(n) AS BIGINT) AS n_problems, count(*) AS n_circuits FROM c""")
def micro_macro(spark, sf_dir):
    return statistics.micro_macro(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey", (F.col("l_returnflag") == "R").cast("int"))


@query("""WITH g AS (SELECT l_shipmode_, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS c FROM (SELECT l_linestatus AS l_shipmode_, l_returnflag FROM lineitem) GROUP BY ALL)
    SELECT l_shipmode_ AS l_linestatus, n, c, greatest(0.0, (c::DOUBLE / n + 3.8414588206941236 / (2 * n) - 1.959963984540054 * sqrt((c::DOUBLE / n) * (1 - c::DOUBLE / n) / n + 3.8414588206941236 / (4.0 * n * n))) / (1 + 3.8414588206941236 / n)) AS low,
        least(1.0, (c::DOUBLE / n + 3.8414588206941236 / (2 * n) + 1.959963984540054 * sqrt((c::DOUBLE / n) * (1 - c::DOUBLE / n) / n + 3.8414588206941236 / (4.0 * n * n))) / (1 + 3.8414588206941236 / n)) AS high FROM g""")
def wilson_interval(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("c"))
    low, high = numbers.wilson(F.col("c"), F.col("n"))
    return g.select("l_linestatus", "n", "c", low.alias("low"), high.alias("high"))


_BIN = "CASE WHEN p_size <= 1 THEN '0..1' WHEN p_size <= 5 THEN '2..5' WHEN p_size <= 20 THEN '6..20' ELSE '>20' END"


@query(f"""WITH p AS (SELECT *, {_BIN} AS size_bin FROM part), x AS (
    SELECT 'all' AS dimension, 'all' AS label, p_retailprice AS v FROM p UNION ALL SELECT 'brand', p_brand, p_retailprice FROM p
    UNION ALL SELECT 'type', p_type, p_retailprice FROM p UNION ALL SELECT 'size', size_bin, p_retailprice FROM p UNION ALL SELECT 'brand_size', p_brand || '|' || size_bin, p_retailprice FROM p)
    SELECT dimension, label, count(*) AS n, avg(v) AS mean, max(v) AS top FROM x GROUP BY ALL""")
def stratified_report(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("size_bin", numbers.numeric_bin(F.col("p_size"), [1, 5, 20]))
    dims = {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("size_bin"), "brand_size": F.concat_ws("|", "p_brand", "size_bin")}
    return statistics.stratified_report(part, dims, {"n": F.count("*"), "mean": F.avg("p_retailprice"), "top": F.max("p_retailprice")})


@query("""WITH g AS (SELECT l_orderkey, max(l_discount) - min(l_discount) AS r, stddev_pop(l_discount) AS sd, count(*) FILTER (l_returnflag = 'R') AS h, count(*) AS n, max(l_tax) - min(l_tax) > 1e-8 OR max(l_quantity % 3) - min(l_quantity % 3) > 1e-8 AS v FROM lineitem GROUP BY ALL)
    SELECT count(*) AS n_groups, avg((r <= 1e-8)::INT) AS degenerate, avg((h = 0)::INT) AS all_fail, avg((h = n)::INT) AS all_pass, avg((h >= 1)::INT) AS solved, sum(h) / sum(n) AS pass_at_1, avg(h) AS mean_detected,
        avg(sd) AS mean_std, avg(r) AS mean_range, avg(CASE WHEN h = 0 THEN v::INT END) AS rescuable FROM g""")
def group_diagnostics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_tax", (F.col("l_quantity") % 3).alias("q"), (F.col("l_returnflag") == "R").cast("int").alias("d"))
    return statistics.group_diagnostics(lines, "l_orderkey", "l_discount", "d", ["l_tax", "q"])


@query("""WITH last AS (SELECT o_custkey, o_orderpriority, arg_max(o_totalprice, o_orderkey) AS m FROM orders GROUP BY ALL)
    SELECT o_custkey, quantile_cont(m, 0.5) AS median, count(*) AS n_seeds FROM last GROUP BY ALL HAVING count(*) >= 3""")
def median_of_seeds(spark, sf_dir):
    return statistics.median_of_seeds(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", 3)


@query("""WITH z AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN stddev_samp(l_quantity) OVER w > 1e-4 THEN (l_quantity - avg(l_quantity) OVER w) / (stddev_samp(l_quantity) OVER w + 1e-4) ELSE 0 END
        + CASE WHEN stddev_samp(l_discount) OVER w > 1e-4 THEN 0.5 * (l_discount - avg(l_discount) OVER w) / (stddev_samp(l_discount) OVER w + 1e-4) ELSE 0 END AS s
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)), m AS (SELECT avg(s) AS a, stddev_samp(s) AS d FROM z)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((s - a) / (d + 1e-4), 6) + 0.0 AS advantage FROM z, m""")
def grouped_advantages(spark, sf_dir):
    out = ranking.z_advantages(table(spark, sf_dir, "lineitem"), "l_orderkey", {"l_quantity": 1.0, "l_discount": 0.5})
    return out.select(*LINE, (F.round("advantage", 6) + 0.0).alias("advantage"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN stddev_pop(l_tax) OVER w > 1e-6 THEN (l_tax - avg(l_tax) OVER w) / (stddev_pop(l_tax) OVER w + 1e-6) ELSE 0 END, 6) + 0.0 AS advantage
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def relative_advantages(spark, sf_dir):
    return ranking.relative_advantages(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_tax").select(*LINE, (F.round("advantage", 6) + 0.0).alias("advantage"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS up, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    q AS (SELECT *, n - up + 1 AS down FROM r WHERE n >= 4), t AS (SELECT q.*, k FROM q, generate_series(0, 4) AS s(k) WHERE up <= k OR down <= 4 - k),
    v AS (SELECT o_custkey, k, round(var_pop(o_totalprice), 9) AS v FROM t GROUP BY ALL),
    b AS (SELECT o_custkey, k AS best FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC, abs(2 * k - 4), k DESC) AS p FROM v) WHERE p = 1)
    SELECT o_custkey, o_orderkey FROM q JOIN b USING (o_custkey) WHERE up <= best OR down <= 4 - best""")
def spread_subset(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.spread_subset(orders, "o_custkey", "o_totalprice", "o_orderkey", 4).where("keep").select("o_custkey", "o_orderkey")


@query("""WITH r AS (SELECT l_suppkey, (l_returnflag = 'R')::INT AS y, row_number() OVER w AS r, sum((l_returnflag = 'R')::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS h FROM lineitem
        WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey))
    SELECT l_suppkey, avg(CASE WHEN y = 1 THEN h / r END) AS average_precision, CAST(sum(y) AS BIGINT) AS n_positive FROM r GROUP BY ALL""")
def average_precision(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return ranking.average_precision(lines, ["l_suppkey"], "l_extendedprice", "y", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("""WITH b AS (SELECT l_linestatus, l_quantity, sum((l_returnflag = 'R')::INT) AS p, sum((l_returnflag <> 'R')::INT) AS n FROM lineitem GROUP BY ALL),
    w AS (SELECT l_linestatus, p, n, p * (coalesce(sum(n) OVER (PARTITION BY l_linestatus ORDER BY l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS w FROM b)
    SELECT l_linestatus, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(w) / (sum(p) * sum(n)) END AS auc, CAST(sum(p) AS BIGINT) AS n_positive, CAST(sum(n) AS BIGINT) AS n_negative FROM w GROUP BY ALL""")
def roc_auc(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return ranking.roc_auc(lines, ["l_linestatus"], "l_quantity", "y")


@query("""SELECT l_suppkey, CASE WHEN count(*) FILTER (l_quantity >= 25 OR l_returnflag = 'R') = 0 THEN 1.0
    ELSE count(*) FILTER (l_quantity >= 25 AND l_returnflag = 'R') / count(*) FILTER (l_quantity >= 25 OR l_returnflag = 'R') END AS iou FROM lineitem GROUP BY ALL""")
def threshold_iou(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(ranking.iou(F.col("l_quantity") >= 25, F.col("l_returnflag") == "R").alias("iou"))


@query("""WITH f AS (SELECT l_suppkey, l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL), c AS (SELECT l_suppkey, l_orderkey, count(*) AS fresh FROM f GROUP BY ALL),
    s AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)
    SELECT l_suppkey, l_orderkey, CAST(sum(coalesce(fresh, 0)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS covered FROM s LEFT JOIN c USING (l_suppkey, l_orderkey)""")
def coverage_curve(spark, sf_dir):
    return ranking.coverage_curve(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey"), "l_suppkey", "l_orderkey", "l_partkey")


@query("""WITH k AS (SELECT s_suppkey, count(DISTINCT l_partkey) AS k FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) ON l_suppkey = s_suppkey GROUP BY ALL)
    SELECT count(*) AS n_faults, avg((k >= 1)::INT) AS n_detect_1, avg((k >= 2)::INT) AS n_detect_2, avg((k >= 4)::INT) AS n_detect_4, avg((k >= 8)::INT) AS n_detect_8 FROM k""")
def detection_fractions(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey")
    return ranking.detection_fractions(table(spark, sf_dir, "supplier"), hits, "s_suppkey", "l_partkey")


@query("""WITH RECURSIVE s AS (SELECT l_orderkey % 50 AS circuit, l_orderkey AS o, list(DISTINCT l_suppkey) AS items FROM lineitem GROUP BY ALL),
    c AS (SELECT circuit, list({'o': o, 'items': items}) AS sets, list_distinct(flatten(list(items))) AS universe FROM s GROUP BY circuit),
    r AS (SELECT circuit, 0 AS step, NULL::BIGINT AS l_orderkey, universe AS rest FROM c UNION ALL
        SELECT circuit, step + 1, x.o, list_filter(rest, lambda i: NOT list_contains(x.items, i)) FROM (
            SELECT r.circuit, step, rest, list_sort(list_transform(sets, lambda p: {'n': -len(list_intersect(p.items, rest)), 'o': p.o, 'items': p.items}))[1] AS x FROM r JOIN c USING (circuit) WHERE len(rest) > 0))
    SELECT circuit, step, l_orderkey FROM r WHERE step > 0""")
def greedy_cover(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("circuit"), "l_orderkey", "l_suppkey")
    return ranking.greedy_cover(lines, "circuit", "l_orderkey", "l_suppkey")


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders) WHERE p = 1)
    SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM b ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def top_configurations(spark, sf_dir):
    return ranking.top_k(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_totalprice", 10, "o_custkey", ["o_orderkey"])


@query("""SELECT event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap_us, value - lag(value) OVER w AS change, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running_total, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS running_n
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def metric_gaps(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", (us - F.lag(us).over(w)).alias("gap_us"), (F.col("value") - F.lag("value").over(w)).alias("change"), F.round(F.sum("value").over(so_far), 2).alias("running_total"), F.count("*").over(so_far).alias("running_n")
    )


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
    m AS (SELECT user_id, avg(CASE WHEN r <= 5 THEN value END) AS newest, avg(CASE WHEN r BETWEEN 6 AND 10 THEN value END) AS older, count(*) AS n FROM r GROUP BY ALL)
    SELECT user_id, n, CASE WHEN n < 6 THEN false ELSE older - newest < 0.5 END AS plateau FROM m""")
def loss_plateau(spark, sf_dir):
    r = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    m = r.groupBy("user_id").agg(F.avg(F.when(F.col("r") <= 5, F.col("value"))).alias("newest"), F.avg(F.when(F.col("r").between(6, 10), F.col("value"))).alias("older"), F.count("*").alias("n"))
    return m.select("user_id", "n", F.when(F.col("n") < 6, False).otherwise(F.col("older") - F.col("newest") < 0.5).alias("plateau"))


@query("""WITH w(name, low, high) AS (VALUES ('early', 0, 2000), ('middle', 1000, 6000), ('late', 5000, 100000000))
    SELECT name, event_type, count(*) AS n, avg(value) AS mean, min(value) AS lowest, max(value) AS highest FROM events JOIN w ON event_id BETWEEN low AND high GROUP BY ALL""")
def step_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    names = F.array_compact(F.array(*(F.when(F.col("event_id").between(a, b), n) for n, a, b in (("early", 0, 2000), ("middle", 1000, 6000), ("late", 5000, 100000000)))))
    return events.withColumn("name", F.explode(names)).groupBy("name", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query("""WITH p AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS a, avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS b FROM orders GROUP BY ALL)
    SELECT count(*) FILTER (b > a) AS improved, count(*) FILTER (b < a) AS worsened, count(*) FILTER (b = a) AS unchanged, avg(b - a) AS mean_delta FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_deltas(spark, sf_dir):
    price = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(price("F").alias("a"), price("O").alias("b")).where("a is not null and b is not null")
    return p.agg(F.count_if(F.col("b") > F.col("a")).alias("improved"), F.count_if(F.col("b") < F.col("a")).alias("worsened"), F.count_if(F.col("b") == F.col("a")).alias("unchanged"), F.avg(F.col("b") - F.col("a")).alias("mean_delta"))


@query("""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_linestatus = 'F') AS filled,
    CASE WHEN count(*) > 0 THEN count(*) FILTER (l_linestatus = 'O') / count(*) END AS open_share FROM lineitem GROUP BY ALL""")
def confusion(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count_if(F.col("l_linestatus") == "F").alias("filled"), F.count("*").alias("n"))
    return lines.select("l_returnflag", "open", "filled", numbers.ratio(F.col("open"), F.col("n")).alias("open_share"))


_POISSON = [0.36787944117144233]
for _k in range(1, 12):
    _POISSON.append(_POISSON[-1] / _k)
_DRAW = " + ".join(f"(u >= {sum(_POISSON[: k + 1])!r})::INT" for k in range(12))


@query(f"""WITH m AS (SELECT l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL),
    d AS (SELECT rep, m, CAST(CAST('0x' || substr(sha256('7:' || rep || ':' || l_suppkey), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS u FROM m, generate_series(0, 499) AS s(rep)),
    r AS (SELECT rep, sum(m * ({_DRAW})) / sum({_DRAW}) AS m FROM d GROUP BY rep)
    SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, count(m) AS repeats FROM r""")
def bootstrap_interval(spark, sf_dir):
    """Over circuit means, one row a supplier."""
    means = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m"))
    return statistics.bootstrap_interval(means, "l_suppkey", "m", repeats=500, seed=7)


@query("""WITH t AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT label, vec_id AS other FROM (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label)),
    q AS (SELECT t.vec_id, list_transform(list_zip(t.e, o.e), lambda p: p[1] * 0.5 + p[2]) AS a, o.e AS b, t.e FROM t JOIN c USING (label) JOIN t o ON o.vec_id = c.other),
    s AS (SELECT q.vec_id AS query, t.vec_id AS target, greatest(round(list_dot_product(q.a, t.e), 9), round(list_dot_product(q.b, t.e), 9)) AS s FROM q, t),
    r AS (SELECT query, target, row_number() OVER (PARTITION BY query ORDER BY s DESC, target) AS f, row_number() OVER (PARTITION BY target ORDER BY s DESC, query) AS b FROM s), o AS (SELECT * FROM r WHERE query = target),
    m AS (SELECT avg((f <= 1)::INT) AS forward_recall_1, avg((f <= 5)::INT) AS forward_recall_5, avg(1 / f) AS forward_mrr, avg((b <= 1)::INT) AS backward_recall_1, avg((b <= 5)::INT) AS backward_recall_5, avg(1 / b) AS backward_mrr FROM o)
    SELECT *, (forward_recall_1 + backward_recall_1) / 2 AS mean_recall_1, (forward_recall_5 + backward_recall_5) / 2 AS mean_recall_5, (forward_mrr + backward_mrr) / 2 AS mean_mrr FROM m""")
def batch_retrieval(spark, sf_dir):
    """Each item against all: a query has two vectors, one that leans to its label's first item and that item itself."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    first = rows.groupBy("label").agg(F.min_by("e", "vec_id").alias("o"))
    queries = rows.join(first, "label").select("vec_id", F.array(F.zip_with("e", "o", lambda p, q: p * 0.5 + q), F.col("o")).alias("slots"))
    return ranking.retrieval(queries, rows, "vec_id", "slots", "e")
