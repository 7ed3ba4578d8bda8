"""Hand-computed cases of the engine's own operators."""

from __future__ import annotations

import itertools
import random
import time

import pytest
from millrace.functions import keys, numbers, text
from millrace.operators import circuit, netlist, ranking, records, statistics
from pyspark.sql import functions as F

# Fixed golden cases.
DESIGNS = [
    ("and", "module m(a, b, y);\ninput a, b;\noutput y;\nAND2 g(.A(a), .B(b), .Y(y));\nendmodule"),
    ("xor_reconvergent", "module m(a, y);\ninput a;\noutput y;\nwire w;\nBUF g0(.A(a), .Y(w));\nXOR2 g1(.A(a), .B(w), .Y(y));\nendmodule"),
    ("mux", "module m(a, b, s, y);\ninput a, b, s;\noutput y;\nMUX2 g(.A(a), .B(b), .S(s), .Y(y));\nendmodule"),
    ("adder", "module m(a, b, s, co);\ninput [1:0] a;\ninput [1:0] b;\noutput [1:0] s;\noutput co;\nwire c;\nHA g0(.A(a[0]), .B(b[0]), .S(s[0]), .C(c));\nFA g1(.A(a[1]), .B(b[1]), .CI(c), .S(s[1]), .CO(co));\nendmodule"),
    ("cyclic", "module m(a, y);\ninput a;\noutput y;\nAND2 g0(.A(a), .B(y), .Y(y));\nendmodule"),
]


def designs(spark):
    return spark.createDataFrame(DESIGNS, "design string, netlist string")


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n,c,k,want", [(10, 2, 2, 1 - 28 / 45), (5, 0, 5, 0.0), (5, 1, 5, 1.0), (1, 1, 2, None), (4, 4, 1, 1.0)])
def test_pass_at_k(spark, n, c, k, want):
    got = one(spark, numbers.pass_at_k(F.col("n"), F.col("c"), k), n=n, c=c)
    assert got == (None if want is None else pytest.approx(want))


def test_micro_and_macro(spark):
    rows = [("large", f"p{i}", 1.0) for i in range(9)] + [("small", "q", 0.0)]
    r = statistics.micro_macro(spark.createDataFrame(rows, "circuit string, problem string, u double"), "circuit", "problem", F.col("u")).first()
    assert (r["micro"], r["macro"], r["n_problems"], r["n_circuits"]) == (pytest.approx(0.9), 0.5, 10, 2)


def test_coverage(spark):
    rows = [("c", 0, "a"), ("c", 1, "a"), ("c", 2, "b"), ("c", 3, "a"), ("c", 3, "b")]
    df = spark.createDataFrame(rows, "circuit string, pattern int, fault string")
    assert [r["covered"] for r in ranking.coverage_curve(df, "circuit", "pattern", "fault").orderBy("pattern").collect()] == [1, 1, 2, 2]
    assert [r["pattern"] for r in ranking.greedy_cover(df, "circuit", "pattern", "fault").collect()] == [3]


def test_greedy_cover_of_many_patterns(spark):
    # each step takes one of 20,000 patterns: trying all of them at every step takes minutes
    pairs = spark.range(20_000).select(F.lit("c").alias("circuit"), (20_000 - F.col("id")).alias("pattern"), F.explode(F.array("id", F.lit(-1), F.lit(None).cast("long"))).alias("fault"))
    start = time.monotonic()
    rows = sorted((r["step"], r["pattern"]) for r in ranking.greedy_cover(pairs, "circuit", "pattern", "fault").collect())
    assert rows == [(i, i) for i in range(1, 20_001)] and time.monotonic() - start < 60


def test_greedy_cover_against_all_tries(spark):
    rng = random.Random(5)
    data = [(c, p, rng.choice("abcdefghijklmnopqrst") + str(c % 2)) for c in range(6) for p in range(30) for _ in range(rng.randint(1, 8))] + [(1, None, "z"), (2, 3, None)]
    rows = ranking.greedy_cover(spark.createDataFrame(data, "circuit int, pattern int, fault string"), "circuit", "pattern", "fault").collect()
    want = []
    for c in range(6):
        sets = {p: {f for d, q, f in data if (d, q) == (c, p) and f is not None} for p in range(30)}
        left, step = set().union(*sets.values()), 0
        while left:
            step, best = step + 1, min(sets, key=lambda p: (-len(sets[p] & left), p))
            left -= sets[best]
            want.append((c, step, best))
    assert sorted(tuple(r) for r in rows) == want


def test_sample_of_repeated_records(spark):
    data = [(f"n{i}", f"sa{j} x", k) for k in range(2) for i in range(50) for j in range(2)]
    df = spark.createDataFrame(data, "netlist string, fault string, ord int")
    unique = records.first_occurrence(df, ["netlist", "fault"], ["ord"]).withColumn("key", F.concat_ws("|", "netlist", "fault"))
    assert unique.count() == 100 and {r["ord"] for r in unique.collect()} == {0}
    a, b = (sorted(r["key"] for r in records.seeded_sample(unique, "key", 17, 10).collect()) for _ in range(2))
    assert a == b and len(a) == 10 and a != sorted(r["key"] for r in unique.orderBy("key").limit(10).collect())
    assert records.seeded_sample(unique, "key", 17, -1).count() == 100


def test_testability(spark):
    rows = {(r["design"], r["net"], r["stuck_at"]): r for r in circuit.testability(designs(spark)).collect()}
    y0, y1, a0 = rows["and", "y", 0], rows["and", "y", 1], rows["and", "a", 0]
    assert (y0["cc0"], y0["cc1"], a0["co"], y0["p_detect"], y1["p_detect"]) == (2, 3, 2, 0.25, 0.75)
    assert (a0["p_active"], a0["p_observe"], a0["p_detect"]) == (0.5, 0.5, 0.25)
    assert rows["xor_reconvergent", "a", 0]["status"] == "proven_undetectable_exhaustive"
    assert (rows["mux", "y", 0]["cc0"], rows["mux", "y", 0]["cc1"], rows["mux", "a", 0]["co"], rows["mux", "s", 0]["co"]) == (3, 3, 2, 3)
    assert rows["cyclic", None, None]["status"].startswith("rejected")


@pytest.mark.parametrize("bad", ["", "module m(a);\ninput a;\nendmodule", "input a;\noutput y;\nFOO g(.A(a), .Y(y));", "input a;\noutput y;\nBUF g(.A(b), .Y(y));", "input a;\noutput y;\nBUF g(.A(a), .Y(y));\nINV h(.A(a), .Y(y));", "input a, b;\noutput y;\nAND2 g(.A(a), .Y(y));"])
def test_malformed_netlists(bad):
    with pytest.raises(circuit.Rejected):
        circuit.Circuit(bad)


def test_packed_simulation_is_the_truth_table():
    c = circuit.Circuit(dict(DESIGNS)["adder"])
    values, lanes, exact = c.lanes(0, 12, "x")
    nets = c.simulate(values, (1 << lanes) - 1)
    assert exact and lanes == 16
    for lane in range(lanes):
        bit = lambda n: nets[n] >> lane & 1
        assert bit("s[0]") + 2 * bit("s[1]") + 4 * bit("co") == bit("a[0]") + 2 * bit("a[1]") + bit("b[0]") + 2 * bit("b[1]")


def test_netlist_tables(spark):
    texts = designs(spark)
    ports = {(r["design"], r["net"]) for r in netlist.ports(texts).collect()}
    assert ("adder", "a[1]") in ports and ("adder", "a") not in ports and ("mux", "s") in ports
    edges = netlist.edges(netlist.gates(texts), netlist.library(spark))
    assert {(r["design"], r["net"], r["src"], r["dst"]) for r in edges.collect()} == {("xor_reconvergent", "w", 0, 1), ("adder", "c", 0, 1), ("cyclic", "y", 0, 0)}
    depth = {(r["design"], r["node"]): (r["forward"], r["backward"]) for r in netlist.depths(edges).collect()}
    assert depth["adder", 0] == (0, 1) and depth["adder", 1] == (1, 0) and depth["cyclic", 0] == (0, 0)


def test_advantages(spark):
    rows = [(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0), (1, 2, 0.0, 0.0), (1, 3, 1.0, 1.0), (2, 4, None, None)]
    got = {r["k"]: r["advantage"] for r in ranking.z_advantages(spark.createDataFrame(rows, "g int, k int, a double, b double"), "g", {"a": 1.0, "b": 1.0}).collect()}
    own = [got[i] for i in range(4)]
    assert sum(own) == pytest.approx(0, abs=1e-9) and abs(got[2]) > abs(got[0]) and got[4] == 0
    same = spark.createDataFrame([(0, 1.0), (0, 1.0)], "g int, r double")
    assert {r["advantage"] for r in ranking.relative_advantages(same, "g", "r").collect()} == {0.0}


def test_ranking_edges(spark):
    make = lambda rows: spark.createDataFrame([("g", i, *r) for i, r in enumerate(rows)], "g string, i int, s double, y int")
    ap = lambda rows: ranking.average_precision(make(rows), ["g"], "s", "y", ["i"]).first()["average_precision"]
    auc = lambda rows: ranking.roc_auc(make(rows), ["g"], "s", "y").first()["auc"]
    assert ap([(0.1, 0)]) is None and ap([(0.1, 1), (0.2, 1)]) == 1 and auc([(0.1, 1)]) is None and auc([(0.1, 0), (0.9, 1)]) == 1 and auc([(0.5, 0), (0.5, 1)]) == 0.5
    rng = random.Random(0)
    rows = [(rng.randrange(6) / 5, rng.randrange(2)) for _ in range(60)]
    pairs = [(a, b) for a, x in rows for b, y in rows if x and not y]
    assert auc(rows) == pytest.approx(sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs))


def test_spread_subset_is_the_best(spark):
    rng = random.Random(3)
    data = [(g, i, float(rng.randrange(8))) for g in range(12) for i in range(rng.randrange(4, 8))]
    kept = ranking.spread_subset(spark.createDataFrame(data, "g int, i int, s double"), "g", "s", "i", 4).where("keep").collect()
    var = lambda x: sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x)
    for g in range(12):
        own = [s for h, _, s in data if h == g]
        mine = [r["s"] for r in kept if r["g"] == g]
        assert len(mine) == 4 and var(mine) == pytest.approx(max(var(c) for c in itertools.combinations(own, 4)))


def test_top_configurations(spark):
    rows = [("a", s, v, s) for s, v in enumerate((0.6, 0.8, 0.7))] + [("b", s, v, s) for s, v in enumerate((0.9, 0.4, 0.5))]
    m = statistics.median_of_seeds(spark.createDataFrame(rows, "config string, seed int, score double, ord int"), "config", "seed", "ord", "score", 3).orderBy(F.desc("median"))
    assert [(r["config"], r["median"], r["n_seeds"]) for r in m.collect()] == [("a", 0.7, 3), ("b", 0.5, 3)]


def test_assignments(spark):
    texts = ["a: 1, b: 0", "a: 1, a: 0", "a: X", "", None, "a: True", "a:1"]
    got = [r["m"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(text.assignment(F.col("t")).alias("m")).collect()]
    assert got == [{"a": 1, "b": 0}, None, None, None, None, None, {"a": 1}]


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, text.integer_ranges(x), x=[3, 1, 2, 7, 7]) == "1..3, 7"
    assert one(spark, text.bus_width(x), x="input [6:2] a") == 5 and one(spark, text.bus_width(x), x="input a") == 1
    assert one(spark, text.final_part(x), x="<think>input: a</think>ok<tool_response>r</tool_response>end") == "end"
    assert one(spark, text.parse_fault(x), x="SA1 n[3]").asDict() == {"stuck_at": 1, "net": "n[3]"} and one(spark, text.parse_fault(x), x="stuck") is None
    assert one(spark, text.csv_tokens(x), x=" a, ,b ,") == ["a", "b"] and one(spark, text.ngrams(text.tokens(x), 2), x="a b  c") == ["a b", "b c"]
    assert one(spark, numbers.numeric_bin(x, [1, 5]), x=9) == ">5" and one(spark, numbers.probability_bin(x), x=0.2) == "(0.0625,0.25]"


def test_split_is_by_group(spark):
    split = spark.createDataFrame([("d1",), ("d1",), ("d2",), ("d3",)], "d string").withColumn("s", keys.hash_split(42, F.col("d")))
    assert split.distinct().count() == 3 and {r["s"] for r in split.collect()} <= {"train", "validation", "test"}


def test_windows_and_ranks(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "i int, g int").repartition(5)
    assert sorted((r["i"], r["rank"]) for r in records.ranked(df, ["i"]).collect()) == [(i, i + 1) for i in range(100)]
    assert records.window_distinct(df, "g", ["i"], 40).count() == 2
    assert [r["i"] for r in records.skip_take(df, ["i"], 3, 0).collect()] == list(range(3, 100)) and records.ranked(df.limit(0), ["i"]).count() == 0


def test_difficulty_strata(spark):
    rows = circuit.testability(designs(spark)).where("design = 'mux'")
    strata = statistics.difficulty_strata()
    assert len(strata) == 20
    got = {r["dimension"]: r["label"] for r in statistics.stratified_report(rows.where("net = 's' and stuck_at = 0"), strata, {"n": F.count("*")}).collect()}
    assert got["observability_cost"] == "3..4" and got["activation_cost"] == "0..1" and got["scoap_cost"] == "3..4" and got["location_class"] == "primary_input" and got["distance_to_output"] == "1"
    assert got["input_output_counts"] == "3..4|1" and got["activation_probability"] == "(0.25,0.5]" and got["type_location_difficulty"].startswith("sa0|primary_input|")
    one = circuit.testability(designs(spark)).where("design = 'xor_reconvergent' and net = 'y' and stuck_at = 0").first()
    assert one["reconvergent"] == 1 and one["support"] == 1 and one["site_depth"] == 2 and one["expected_vectors"] is None and (one["p_detect_low"], one["p_detect_high"]) == (0.0, 0.0)
