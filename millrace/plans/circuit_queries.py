"""Netlists and circuits, on a circuit that each customer's orders spell, and on the orders-lines-suppliers graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import signals, text
from ..operators import circuit, netlist, statistics
from .registry import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

CELLS = ("AND2", "OR2", "XOR2", "NAND2", "NOR2")

#: The gates that ``designs`` spells, as rows: design, number k of n, the nets at A (x) and B (z), cell; a net is -1 to -4 for the
#: inputs a0 to a3, its number for w1 to wn, and 0 for the output y, which repeats wn.
GATES = """g AS (SELECT d, k, n, CASE WHEN o % 4 = 0 OR k = 1 THEN -1 - (o // 4) % 4 ELSE k - 1 END AS x, CASE WHEN o % 3 = 0 AND k > 2 THEN k - 2 ELSE -1 - o % 4 END AS z, o % 5 AS c, o
    FROM (SELECT o_custkey AS d, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders))"""
NAME = "CASE WHEN {0} < 0 THEN 'a' || (-1 - {0}) WHEN {0} = 0 THEN 'y' ELSE 'w' || {0} END"
PICK = "CASE WHEN {0} < 0 THEN (CASE WHEN {0} = f THEN s * 65535 ELSE [43690, 52428, 61680, 65280][-{0}] END) ELSE vals[{0}] END"
CELL = "CASE c WHEN 0 THEN {0} & {1} WHEN 1 THEN {0} | {1} WHEN 2 THEN xor({0}, {1}) WHEN 3 THEN 65535 - ({0} & {1}) ELSE 65535 - ({0} | {1}) END"
#: Sixteen lanes, one a pattern of the inputs, of the good machine (f null) and of each faulty one: (d, f, s, vals, y).
MACHINES = f"""u AS (SELECT DISTINCT d, n FROM g), faults AS (SELECT d, n, f, s FROM u, (SELECT unnest([0, 1]) AS s), (SELECT unnest(generate_series(-4, 400)) AS f) WHERE f <= n UNION ALL SELECT d, n, NULL, NULL FROM u),
    r AS (SELECT d, n, f, s, 0::BIGINT AS k, []::BIGINT[] AS vals FROM faults UNION ALL
        SELECT d, n, f, s, k, list_append(vals, CASE WHEN k = f THEN s * 65535 ELSE {CELL.format('x', 'z')} END) FROM
            (SELECT r.d, r.n, f, s, g.k, c, vals, {PICK.format('g.x')} AS x, {PICK.format('g.z')} AS z FROM r JOIN g ON g.d = r.d AND g.k = r.k + 1)),
    m AS (SELECT d, n, f, s, vals, CASE WHEN f = 0 THEN s * 65535 ELSE vals[n] END AS y FROM r WHERE k = n)"""
GOOD = "CASE WHEN {0} < 0 THEN [43690, 52428, 61680, 65280][-{0}] WHEN {0} = 0 THEN y ELSE vals[{0}] END"


def designs(spark, sf_dir):
    """(design, netlist): one circuit a customer, one gate an order, over four inputs.  A customer's orders bound a text."""
    orders = F.array_sort(F.collect_list("o_orderkey"))
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("design")).agg(orders.alias("o"))
    text = lambda c: c.cast("string")

    def gate(o, i):
        k = i + 1
        x = F.when((o % 4 == 0) | (k == 1), F.concat(F.lit("a"), text(F.floor(o / 4) % 4))).otherwise(F.concat(F.lit("w"), text(k - 1)))
        z = F.when((o % 3 == 0) & (k > 2), F.concat(F.lit("w"), text(k - 2))).otherwise(F.concat(F.lit("a"), text(o % 4)))
        cell = F.element_at(F.array(*(F.lit(c) for c in CELLS)), (o % 5 + 1).cast("int"))
        return F.concat(cell, F.lit(" g"), text(k), F.lit("(.A("), x, F.lit("), .B("), z, F.lit("), .Y(w"), text(k), F.lit("));"))

    n = F.size("o")
    wires = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("w"), text(k))), ", ")
    parts = [F.lit("module m(a0, a1, a2, a3, y);\ninput a0, a1, a2, a3;\noutput y;\nwire "), wires, F.lit(";\n"), F.array_join(F.transform("o", gate), "\n"), F.lit("\nBUF gy(.A(w"), text(n), F.lit("), .Y(y));\nendmodule")]
    return own.select("design", F.concat(*parts).alias("netlist"))


@query(f"""WITH RECURSIVE {GATES}, {MACHINES}, good AS (SELECT * FROM m WHERE f IS NULL),
    p AS (SELECT m.d, m.n, m.f, m.s, xor({GOOD.format('m.f').replace('y', 'good.y').replace('vals', 'good.vals')}, m.s * 65535) AS active, xor(good.y, m.y) AS seen FROM m JOIN good ON good.d = m.d WHERE m.f IS NOT NULL),
    q AS (SELECT *, bit_count(active) AS a, bit_count(active & seen) AS h FROM p)
    SELECT d::VARCHAR AS design, {NAME.format('f')} AS net, s AS stuck_at, a / 16 AS p_active, CASE WHEN a > 0 THEN h / a END AS p_observe, h / 16 AS p_detect, CASE WHEN h > 0 THEN -log2(h / 16) + 0.0 END AS bits, true AS exact,
        CASE WHEN h > 0 THEN 'ok' ELSE 'proven_undetectable_exhaustive' END AS status FROM q""")
def fault_testability(spark, sf_dir):
    """Exhaustive simulation of every fault of every net."""
    found = circuit.testability(designs(spark, sf_dir))
    return found.select("design", "net", "stuck_at", "p_active", "p_observe", "p_detect", (F.col("bits") + 0.0).alias("bits"), "exact", "status")


_CC = """CASE c WHEN 0 THEN {m} + 1 WHEN 1 THEN {s} + 1 WHEN 2 THEN least(x0 + z{p}, x1 + z{q}) + 1 WHEN 3 THEN {t} + 1 ELSE {u} + 1 END"""


@query(f"""WITH RECURSIVE {GATES}, r AS (SELECT DISTINCT d, n, 0::BIGINT AS k, []::DOUBLE[] AS c0, []::DOUBLE[] AS c1 FROM g UNION ALL
        SELECT d, n, k, list_append(c0, {_CC.format(m='least(x0, z0)', s='x0 + z0', p=0, q=1, t='x1 + z1', u='least(x1, z1)')}), list_append(c1, {_CC.format(m='x1 + z1', s='least(x1, z1)', p=1, q=0, t='least(x0, z0)', u='x0 + z0')}) FROM
            (SELECT r.d, r.n, g.k, c, c0, c1, CASE WHEN x < 0 THEN 1 ELSE c0[x] END AS x0, CASE WHEN x < 0 THEN 1 ELSE c1[x] END AS x1, CASE WHEN z < 0 THEN 1 ELSE c0[z] END AS z0, CASE WHEN z < 0 THEN 1 ELSE c1[z] END AS z1
            FROM r JOIN g ON g.d = r.d AND g.k = r.k + 1)),
    e AS (SELECT * FROM r WHERE k = n)
    SELECT d::VARCHAR AS design, 'w' || i AS net, c0[i] AS cc0, c1[i] AS cc1 FROM e, generate_series(1, 400) AS s(i) WHERE i <= n
    UNION ALL SELECT d::VARCHAR, 'y', c0[n] + 1, c1[n] + 1 FROM e UNION ALL SELECT d::VARCHAR, 'a' || i, 1, 1 FROM e, generate_series(0, 3) AS s(i)""")
def forcing_costs(spark, sf_dir):
    """The least cost of forcing each net to 0 and to 1."""
    found = circuit.testability(designs(spark, sf_dir))
    return found.where("stuck_at = 0").select("design", "net", "cc0", "cc1")


@query(f"""WITH {GATES}, pins AS (SELECT d, k, x AS net FROM g UNION ALL SELECT d, k, z FROM g)
    SELECT d AS design, 'w' || net AS net, CAST(net - 1 AS INTEGER) AS src, CAST(k - 1 AS INTEGER) AS dst FROM pins WHERE net > 0 UNION ALL SELECT DISTINCT d, 'w' || n, CAST(n - 1 AS INTEGER), CAST(n AS INTEGER) FROM g""")
def netlist_edges(spark, sf_dir):
    return netlist.edges(netlist.gates(designs(spark, sf_dir)), netlist.library(spark))


@query(f"""WITH {GATES} SELECT d AS design, 'wire' AS direction, 'w' || k AS net FROM g UNION ALL SELECT DISTINCT d, 'output', 'y' FROM g UNION ALL SELECT DISTINCT d, 'input', 'a' || i FROM g, generate_series(0, 3) AS s(i)""")
def netlist_ports(spark, sf_dir):
    return netlist.ports(designs(spark, sf_dir))


@query(f"""WITH RECURSIVE {GATES}, r AS (SELECT DISTINCT d, n, 0::BIGINT AS k, []::BIGINT[] AS f FROM g UNION ALL
        SELECT r.d, r.n, g.k, list_append(f, greatest(CASE WHEN x > 0 THEN f[x] + 1 ELSE 0 END, CASE WHEN z > 0 THEN f[z] + 1 ELSE 0 END)) FROM r JOIN g ON g.d = r.d AND g.k = r.k + 1),
    p AS (SELECT d, k, x AS net FROM g UNION ALL SELECT d, k, z FROM g), used AS (SELECT d, net AS k FROM p WHERE net > 0 UNION SELECT d, k FROM p WHERE net > 0 UNION SELECT d, n FROM g),
    e AS (SELECT *, f[n] + 1 AS last FROM r WHERE k = n), v AS (SELECT e.d, used.k - 1 AS node, f[used.k] AS forward, last, list_max(list_append(list_transform((SELECT list(u2.k) FROM used u2 WHERE u2.d = e.d), lambda j: f[j]), last)) AS top FROM e JOIN used ON used.d = e.d)
    SELECT d AS design, CAST(node AS INTEGER) AS node, forward, forward / greatest(1, top) AS forward_share FROM v UNION ALL SELECT DISTINCT e.d, CAST(e.n AS INTEGER), e.last, e.last / greatest(1, top) FROM e JOIN v ON v.d = e.d""")
def netlist_depths(spark, sf_dir):
    found = netlist.depths(netlist.edges(netlist.gates(designs(spark, sf_dir)), netlist.library(spark)))
    return found.select("design", "node", "forward", "forward_share")


@query(f"""WITH RECURSIVE {GATES}, r AS (SELECT DISTINCT d, n, 0::BIGINT AS k, []::BIGINT[] AS f FROM g UNION ALL
        SELECT r.d, r.n, g.k, list_append(f, 1 + greatest(CASE WHEN x > 0 THEN f[x] ELSE 0 END, CASE WHEN z > 0 THEN f[z] ELSE 0 END)) FROM r JOIN g ON g.d = r.d AND g.k = r.k + 1),
    e AS (SELECT * FROM r WHERE k = n), p AS (SELECT d, x AS net FROM g UNION ALL SELECT d, z FROM g UNION ALL SELECT DISTINCT d, n FROM g), c AS (SELECT d, net, count(*) AS k FROM p GROUP BY ALL),
    nets AS (SELECT d, n, f, unnest(generate_series(-4, n)) AS net FROM e)
    SELECT nets.d::VARCHAR AS design, {NAME.format('nets.net')} AS net, CASE WHEN nets.net < 0 THEN 'primary_input' WHEN nets.net = 0 THEN 'primary_output' ELSE 'internal' END AS location, CAST(n + 1 AS INTEGER) AS gate_count, CAST(f[n] + 1 AS INTEGER) AS circuit_depth,
        CAST(CASE WHEN nets.net < 0 THEN 0 WHEN nets.net = 0 THEN f[n] + 1 ELSE f[nets.net] END AS INTEGER) AS site_depth, CAST(coalesce(c.k, 0) AS INTEGER) AS fanout, 16::BIGINT AS trials FROM nets LEFT JOIN c ON c.d = nets.d AND c.net = nets.net""")
def site_structure(spark, sf_dir):
    """Where each net stands in its circuit."""
    found = circuit.testability(designs(spark, sf_dir)).where("stuck_at = 0")
    return found.select("design", "net", "location", "gate_count", "circuit_depth", "site_depth", "fanout", "trials")


@query(f"""WITH {GATES}, pins AS (SELECT d, x AS net FROM g UNION ALL SELECT d, z FROM g UNION ALL SELECT DISTINCT d, n FROM g), c AS (SELECT d, {NAME.format('net')} AS net, count(*) AS k FROM pins GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY k DESC, net) AS r FROM c) SELECT d AS design, count(*) FILTER (k >= 4) AS n_high, string_agg(net || ' ' || k, ', ' ORDER BY r) FILTER (r <= 5 AND k >= 4) AS top FROM r GROUP BY d""")
def high_fanout_nets(spark, sf_dir):
    """Nets that four pins and more read: how many, and the first five."""
    cells = netlist.library(spark).select("cell", "pin")
    readers = netlist.gates(designs(spark, sf_dir)).join(cells, ["cell", "pin"], "left_anti").groupBy("design", "net").agg(F.count("*").alias("k"))
    ranked = readers.withColumn("r", F.row_number().over(Window.partitionBy("design").orderBy(F.desc("k"), "net")))
    listed = F.array_sort(F.collect_list(F.when((F.col("r") <= 5) & (F.col("k") >= 4), F.struct("r", F.concat_ws(" ", "net", F.col("k").cast("string")).alias("s")))))
    return ranked.groupBy("design").agg(F.count_if(F.col("k") >= 4).alias("n_high"), F.nullif(F.array_join(F.transform(listed, lambda x: x["s"]), ", "), F.lit("")).alias("top"))


_BIN = "CASE WHEN {0} <= 0 THEN '0' WHEN {0} <= 1 THEN '1' WHEN {0} <= 2 THEN '2' WHEN {0} <= 4 THEN '3..4' WHEN {0} <= 8 THEN '5..8' WHEN {0} <= 16 THEN '9..16' ELSE '>16' END"


@query(f"""WITH RECURSIVE {GATES}, {MACHINES}, good AS (SELECT * FROM m WHERE f IS NULL),
    p AS (SELECT m.d, m.n, m.f, m.s, xor({GOOD.format('m.f').replace('y', 'good.y').replace('vals', 'good.vals')}, m.s * 65535) AS active, xor(good.y, m.y) AS seen FROM m JOIN good ON good.d = m.d WHERE m.f IS NOT NULL),
    q AS (SELECT *, bit_count(active) / 16 AS pa, bit_count(active & seen) / 16 AS pd FROM p),
    l AS (SELECT pd, pa, 'sa' || s AS fault_type, CASE WHEN f < 0 THEN 'primary_input' WHEN f = 0 THEN 'primary_output' ELSE 'internal' END AS location_class,
        CASE WHEN pd = 0 THEN 'proven_undetectable_exhaustive' WHEN pd >= 0.25 THEN 'easy_p>=0.25' WHEN pd >= 0.0625 THEN 'medium_0.0625<=p<0.25' ELSE 'hard_0.00390625<=p<0.0625' END AS difficulty,
        CASE WHEN n + 1 <= 2 THEN '2' WHEN n + 1 <= 4 THEN '3..4' WHEN n + 1 <= 8 THEN '5..8' WHEN n + 1 <= 16 THEN '9..16' WHEN n + 1 <= 32 THEN '17..32' ELSE '33..64' END AS gate_count FROM q),
    x AS (SELECT 'all' AS dimension, 'all' AS label, pd FROM l UNION ALL SELECT 'fault_type', fault_type, pd FROM l UNION ALL SELECT 'location_class', location_class, pd FROM l UNION ALL SELECT 'difficulty', difficulty, pd FROM l
        UNION ALL SELECT 'gate_count', gate_count, pd FROM l UNION ALL SELECT 'num_inputs', '3..4', pd FROM l UNION ALL SELECT 'num_outputs', '1', pd FROM l UNION ALL SELECT 'num_inputs_difficulty', '3..4|' || difficulty, pd FROM l
        UNION ALL SELECT 'num_outputs_difficulty', '1|' || difficulty, pd FROM l UNION ALL SELECT 'input_output_counts', '3..4|1', pd FROM l UNION ALL SELECT 'type_location_difficulty', fault_type || '|' || location_class || '|' || difficulty, pd FROM l)
    SELECT dimension, label, count(*) AS problems, avg(pd) AS random_detection FROM x GROUP BY ALL""")
def difficulty_report(spark, sf_dir):
    """Problems and how often a random vector detects, by the dimensions of a difficulty report; those that SQL shows here."""
    shown = ("fault_type", "location_class", "difficulty", "gate_count", "num_inputs", "num_outputs", "num_inputs_difficulty", "num_outputs_difficulty", "input_output_counts", "type_location_difficulty")
    strata = statistics.difficulty_strata()
    return statistics.stratified_report(circuit.testability(designs(spark, sf_dir)), {k: strata[k] for k in shown}, {"problems": F.count("*"), "random_detection": F.avg("p_detect")})


def _problems(spark, sf_dir):
    """One fault and one vector a design: net w1 or the last input, the vector and the polarity by the customer's number."""
    d = F.col("design")
    bits = F.reverse(F.lpad(F.bin(d % 16), 4, "0"))
    fault = F.concat(F.when(d % 2 == 0, "sa0 ").otherwise("sa1 "), F.when(d % 3 == 0, "a3").otherwise("w1"))
    return designs(spark, sf_dir).select("design", "netlist", bits.alias("vector"), fault.alias("fault"))


_ONE = f"""WITH RECURSIVE {GATES}, {MACHINES}, good AS (SELECT * FROM m WHERE f IS NULL),
    p AS (SELECT m.d, m.n, m.f, m.s, xor(good.y, m.y) AS seen, good.vals AS gv, good.y AS gy, m.vals AS bv, m.y AS byy FROM m JOIN good ON good.d = m.d WHERE m.s = m.d % 2 AND m.f = CASE WHEN m.d % 3 = 0 THEN -4 ELSE 1 END)"""


@query(f"""{_ONE}, x AS (SELECT d, (seen >> (d % 16)::INT) & 1 = 1 AS hit, list_filter([0, 1, 2, 3], lambda i: (seen >> (d % 16)::INT) & 1 = 1 AND (seen >> xor((d % 16)::INT, (1 << i)::INT)) & 1 = 0) AS l FROM p)
    SELECT d AS design, hit AS detected, CAST(len(l) AS INTEGER) AS n_decisive, array_to_string(list_transform(l, lambda i: 'a' || i), ',') AS decisive FROM x""")
def decisive_bits(spark, sf_dir):
    """Inputs of which a flip alone loses a detection."""
    return circuit.decisive_bits(_problems(spark, sf_dir), ["design"])


@query(f"""{_ONE}, nets AS (SELECT d, unnest(generate_series(-4, n)) AS net FROM p)
    SELECT p.d AS design, {NAME.format('net')} AS net, CAST((({GOOD.format('net').replace('vals', 'gv').replace('y', 'gy')}) >> (p.d % 16)::INT) & 1 AS INTEGER) AS good,
        CAST(((CASE WHEN net = f THEN s * 65535 WHEN net < 0 THEN [43690, 52428, 61680, 65280][-net] WHEN net = 0 THEN byy ELSE bv[net] END) >> (p.d % 16)::INT) & 1 AS INTEGER) AS bad, net < 0 AS is_pi, net = 0 AS is_po FROM p JOIN nets ON nets.d = p.d""")
def replayed_machines(spark, sf_dir):
    """The good and the faulty machine, net by net."""
    return circuit.replayed(_problems(spark, sf_dir), ["design"])


@query(f"""{_ONE} SELECT d AS design, (seen >> (d % 16)::INT) & 1 = 1 AS detected, ((({GOOD.format('f').replace('vals', 'gv').replace('y', 'gy')}) >> (d % 16)::INT) & 1) <> s AS activated FROM p""")
def replayed_outcomes(spark, sf_dir):
    """Detection at the outputs and activation at the site, from replayed machines."""
    machines = circuit.replayed(_problems(spark, sf_dir), ["design"])
    maps = machines.groupBy("design").agg(*(F.map_from_entries(F.collect_list(F.when(keep, F.struct("net", c)))).alias(n) for n, c, keep in (("good", "good", F.lit(True)), ("bad", "bad", F.lit(True)), ("good_out", "good", F.col("is_po")), ("bad_out", "bad", F.col("is_po")))))
    d = F.col("design")
    return maps.select("design", signals.differs(F.col("good_out"), F.col("bad_out")).alias("detected"), signals.activated(F.col("good"), F.col("bad"), F.when(d % 3 == 0, "a3").otherwise("w1"), (d % 2).cast("int")).alias("activated"))


@query(f"""WITH {GATES}, nets AS (SELECT d, 'w' || k AS net FROM g UNION ALL SELECT DISTINCT d, 'y' FROM g UNION ALL SELECT DISTINCT d, 'a' || i FROM g, generate_series(0, 3) AS s(i)) SELECT d AS design, p || net AS fault FROM nets, (SELECT unnest(['sa0 ', 'sa1 ']) AS p)""")
def fault_universe(spark, sf_dir):
    return netlist.fault_universe(netlist.ports(designs(spark, sf_dir)))


@query(f"""WITH {GATES}, pins AS (SELECT d, k - 1 AS idx, CAST(k = 1 AS INTEGER) AS drives, CAST(x = 1 OR z = 1 AS INTEGER) AS reads FROM g UNION ALL SELECT d, n, 0, 1 FROM (SELECT DISTINCT d, n FROM g WHERE n = 1))
    SELECT d AS design, CAST(idx AS INTEGER) AS idx, drives, reads, CAST(1 - d % 2 AS INTEGER) AS sa0, CAST(d % 2 AS INTEGER) AS sa1 FROM pins WHERE drives + reads > 0""")
def site_features(spark, sf_dir):
    """Gates that drive or read the net of a design's fault, here w1."""
    texts = designs(spark, sf_dir)
    faults = texts.select("design", (F.col("design") % 2).cast("int").alias("stuck_at"), F.lit("w1").alias("net"))
    return netlist.site_features(netlist.gates(texts), netlist.library(spark), faults)


@query(f"""WITH {GATES} SELECT d AS design, CAST(k - 1 AS INTEGER) AS idx, ['AND2', 'OR2', 'XOR2', 'NAND2', 'NOR2'][c + 1] AS cell, ['AND', 'OR', 'XOR', 'NAND', 'UNKNOWN'][c + 1] AS family, 'X1' AS drive, '2' AS inputs, 1 AS outputs FROM g
    UNION ALL SELECT DISTINCT d, CAST(n AS INTEGER), 'BUF', 'UNKNOWN', 'X1', '1', 1 FROM g""")
def gate_attributes(spark, sf_dir):
    families = F.create_map(*(F.lit(x) for c in ("AND", "OR", "XOR", "NAND") for x in (c, c)))
    found = netlist.gate_attributes(netlist.gates(designs(spark, sf_dir)), netlist.library(spark), families)
    return found.select("design", "idx", "cell", "family", "drive", "inputs", "outputs")


@query("""SELECT p_partkey AS node, CAST(floor(log2(p_partkey)) AS INTEGER) AS level FROM part WHERE p_partkey > 0""")
def topological_levels(spark, sf_dir):
    """Levels of a dependency graph: each part needs the one of half its number."""
    parts = table(spark, sf_dir, "part").where("p_partkey > 1")
    return netlist.topological_levels(parts.select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst")))


@query(f"""{_ONE.replace('m.s = m.d % 2 AND m.f = CASE WHEN m.d % 3 = 0 THEN -4 ELSE 1 END', 'm.s = 0 AND m.f = 1')}, t AS (SELECT d, slot, seen, (('0x' || substr(sha256('11:' || d || ':' || slot), 1, 1))::INT) AS v FROM p, generate_series(0, 5) AS q(slot)),
    h AS (SELECT d, slot, (seen >> (((v & 1) << 3) | ((v & 2) << 1) | ((v & 4) >> 1) | ((v & 8) >> 3))) & 1 = 1 AS hit FROM t)
    SELECT d AS design, min(CASE WHEN hit THEN slot END) AS first_hit, count(*) FILTER (hit) AS n_hits, count(*) AS n_slots FROM h GROUP BY d""")
def random_baseline(spark, sf_dir):
    """Fixed random vectors, six a problem, and the first that detects, where a search would stop."""
    slots = designs(spark, sf_dir).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))).withColumn("fault", F.lit("sa0 w1"))
    drawn = slots.withColumn("vector", signals.random_bits(11, F.concat_ws(":", F.col("design").cast("string"), F.col("slot").cast("string")), 4))
    found = circuit.decisive_bits(drawn, ["design", "slot"])
    return found.groupBy("design").agg(F.min(F.when(F.col("detected"), F.col("slot"))).alias("first_hit"), F.count_if("detected").alias("n_hits"), F.count("*").alias("n_slots"))


@query("""WITH e AS (SELECT l_orderkey AS design, l_partkey AS src, l_suppkey AS dst FROM lineitem),
    n AS (SELECT design, src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT design, dst, 1, 0 FROM e)
    SELECT design, node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, log2(1.0 + sum(i)) AS log_in, log2(1.0 + sum(o)) AS log_out FROM n GROUP BY ALL""")
def node_degrees(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("design"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return netlist.degrees(lines)


@query("""SELECT s_nationkey, n_name, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""")
def dimension_lookup(spark, sf_dir):
    nations, suppliers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    joined = lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"]).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("s_nationkey", "n_name").agg(F.count("*").alias("n_lines"), F.countDistinct("l_partkey").alias("n_parts"))


@query("""SELECT p_brand, p_type, list_sort(list(p_partkey)) AS members, count(*) AS n FROM part GROUP BY ALL""")
def attribute_groups(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list("p_partkey")).alias("members"), F.count("*").alias("n"))


@query("""SELECT p_partkey, 'sa' || (p_size % 2) || ' ' || p_brand AS fault, p_size % 2 AS stuck_at, p_brand AS net, 'sa' || (1 - p_size % 2) || ' ' || p_brand AS opposite FROM part""")
def fault_strings(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("sa"), (F.col("p_size") % 2).cast("string"), F.lit(" "), "p_brand").alias("fault"))
    parsed = part.withColumn("f", text.parse_fault(F.col("fault")))
    return parsed.select("p_partkey", "fault", "f.stuck_at", "f.net", text.opposite_fault(F.col("fault")).alias("opposite"))


@query("""SELECT l_orderkey, a.l_suppkey AS left_supplier, b.l_suppkey AS right_supplier, count(*) AS n FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY ALL""")
def pairs_within(spark, sf_dir):
    """Unordered pairs within a problem, whose few completions bound each group."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    a, b = lines.withColumnRenamed("l_suppkey", "left_supplier"), lines.withColumnRenamed("l_suppkey", "right_supplier")
    return a.join(b, "l_orderkey").where("left_supplier < right_supplier").groupBy("l_orderkey", "left_supplier", "right_supplier").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT o_custkey AS design FROM orders WHERE o_custkey % 7 > 0""")
def usable_designs(spark, sf_dir):
    """Designs that compile; every seventh lacks the driver of its output."""
    texts = designs(spark, sf_dir)
    broken = F.replace("netlist", F.lit("BUF gy("), F.lit("// BUF gy("))
    return circuit.usable(texts.withColumn("netlist", F.when(F.col("design") % 7 == 0, broken).otherwise(F.col("netlist")))).where("reason is null").select("design")


@query(f"""WITH RECURSIVE {GATES}, r AS (SELECT DISTINCT d, n, 0::BIGINT AS k, []::BIGINT[] AS f FROM g UNION ALL
        SELECT r.d, r.n, g.k, list_append(f, 1 + greatest(CASE WHEN x > 0 THEN f[x] ELSE 0 END, CASE WHEN z > 0 THEN f[z] ELSE 0 END)) FROM r JOIN g ON g.d = r.d AND g.k = r.k + 1),
    e AS (SELECT d, n, greatest(list_max(f), f[n] + 1) AS depth FROM r WHERE k = n), c AS (SELECT d, ['AND2', 'OR2', 'XOR2', 'NAND2', 'NOR2'][c + 1] AS cell, count(*) AS k FROM g GROUP BY ALL UNION ALL SELECT DISTINCT d, 'BUF', 1 FROM g),
    q AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY k DESC, cell) AS r FROM c), x AS (SELECT q.d, string_agg(cell || ' (' || printf('%.1f', round(100.0::DOUBLE * k / (n + 1), 1)) || '%)', ', ' ORDER BY r) AS mix FROM q JOIN e ON e.d = q.d WHERE r <= 5 GROUP BY q.d)
    SELECT e.d AS design, 'This combinational ASAP7 standard-cell netlist exposes 4 primary input bits (a0, a1, a2, and a3) and 1 primary output bits (y). The implementation uses ' || (n + 1) || ' cells, dominated by ' || mix
        || '; the longest combinational path traverses ' || depth || ' levels of logic.' AS description FROM e JOIN x ON x.d = e.d""")
def design_descriptions(spark, sf_dir):
    texts = designs(spark, sf_dir)
    return netlist.descriptions(netlist.gates(texts), netlist.library(spark), netlist.ports(texts))
