"""Netlist text to tables: gates, nets, edges, structural features, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chat import filled
from ..functions.signals import base_cell, drive_class, drive_value, family, input_class
from ..functions.text import listed
from ..sources.staging import stage_table

# Cells with the Boolean expression of each output over their input pins.
LIBRARY = {
    "INV": {"Y": "~A"}, "BUF": {"Y": "A"}, "AND2": {"Y": "A & B"}, "OR2": {"Y": "A | B"}, "NAND2": {"Y": "~(A & B)"}, "NOR2": {"Y": "~(A | B)"},
    "XOR2": {"Y": "A ^ B"}, "XNOR2": {"Y": "~(A ^ B)"}, "AND3": {"Y": "A & B & C"}, "OR3": {"Y": "A | B | C"}, "NAND3": {"Y": "~(A & B & C)"}, "NOR3": {"Y": "~(A | B | C)"},
    "MUX2": {"Y": "(A & ~S) | (B & S)"}, "AOI21": {"Y": "~((A & B) | C)"}, "OAI21": {"Y": "~((A | B) & C)"}, "HA": {"S": "A ^ B", "C": "A & B"},
    "FA": {"S": "A ^ B ^ CI", "CO": "(A & B) | (A & CI) | (B & CI)"},
}

GATE = r"(?m)^\s*(?!module\b|input\b|output\b|wire\b|assign\b|endmodule\b)([A-Za-z_]\w*)\s+([A-Za-z_]\w*)\s*\(\s*(\.[^;]*)\)\s*;"
PIN = r"\.\s*(\w+)\s*\(\s*([^()\s]+)\s*\)"


def library(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(cell, pin, expr): the output pins of every cell; from a JSON file of {cell: {pin: expr}} where a path is given."""
    if path is not None:
        text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
        return text.select(F.explode("m").alias("cell", "pins")).select("cell", F.explode("pins").alias("pin", "expr"))
    return spark.createDataFrame([(c, p, e) for c, pins in LIBRARY.items() for p, e in pins.items()], "cell string, pin string, expr string")


def gates(designs: DataFrame, design: str = "design", text: str = "netlist") -> DataFrame:
    """(design, idx, cell, inst, pin, net): one row per connected pin, idx in order of appearance."""
    found = F.regexp_extract_all(F.col(text), F.lit(GATE), F.lit(0))
    each = designs.select(design, F.posexplode(found).alias("idx", "gate"))
    part = lambda i: F.regexp_extract("gate", GATE, i)
    named = each.select(design, "idx", part(1).alias("cell"), part(2).alias("inst"), F.regexp_extract_all(part(3), F.lit(PIN), F.lit(0)).alias("pins"))
    return named.select(design, "idx", "cell", "inst", F.explode("pins").alias("p")).select(
        design, "idx", "cell", "inst", F.regexp_extract("p", PIN, 1).alias("pin"), F.regexp_extract("p", PIN, 2).alias("net")
    )


def ports(designs: DataFrame, design: str = "design", text: str = "netlist") -> DataFrame:
    """(design, direction, net): declared inputs, outputs and wires, a range as one net a bit."""
    shape = r"(?m)^\s*(input|output|wire)\s+([^;]+);"
    each = designs.select(design, F.explode(F.regexp_extract_all(F.col(text), F.lit(shape), F.lit(0))).alias("d"))
    body = F.regexp_extract("d", shape, 2)
    bounds = [F.regexp_extract(body, r"\[\s*(\d+)\s*:\s*(\d+)\s*\]", i) for i in (1, 2)]
    named = each.select(design, F.regexp_extract("d", shape, 1).alias("direction"), *(F.nullif(b, F.lit("")).cast("int").alias(n) for b, n in zip(bounds, ("msb", "lsb"))), F.explode(F.split(F.regexp_replace(body, r"\[[^\]]*\]", ""), ",")).alias("name"))
    bits = F.when(F.col("msb").isNull(), F.array(F.trim("name"))).otherwise(F.transform(F.sequence(F.least("msb", "lsb"), F.greatest("msb", "lsb")), lambda i: F.concat(F.trim("name"), F.lit("["), i.cast("string"), F.lit("]"))))
    return named.select(design, "direction", F.explode(bits).alias("net")).where("net <> ''")


def edges(pins: DataFrame, cells: DataFrame, design: str = "design") -> DataFrame:
    """(design, net, src, dst): every driver of a net to every reader of it, duplicates kept.  A pin drives if the cell's
    library entry has it as an output; pins of unknown cells drive if they are called as outputs usually are."""
    usual = F.col("pin").isin("Y", "Z", "Q", "QN", "S", "CO", "OUT", "O")
    known = cells.select("cell").distinct().withColumn("known", F.lit(True))
    marked = pins.join(cells.select("cell", "pin").withColumn("drives", F.lit(True)), ["cell", "pin"], "left").join(known, "cell", "left")
    out = F.coalesce("drives", F.when(F.col("known"), F.lit(False)), usual)
    marked = marked.withColumn("out", out)
    drivers = marked.where("out").select(design, "net", F.col("idx").alias("src"))
    return drivers.join(marked.where("not out").select(design, "net", F.col("idx").alias("dst")), [design, "net"])


def degrees(links: DataFrame, design: str = "design") -> DataFrame:
    """(design, node, fan_in, fan_out, log2 of one plus each)."""
    ends = links.select(design, F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(links.select(design, F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    d = ends.groupBy(design, "node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return d.withColumns({"log_in": F.log2(1.0 + F.col("fan_in")), "log_out": F.log2(1.0 + F.col("fan_out"))})


def depths(links: DataFrame, design: str = "design") -> DataFrame:
    """(design, node, forward, backward, forward_share, backward_share): longest paths from a source and to a sink, also as
    shares of the design's longest.  A node on a cycle, or behind one, has the longest path that reaches it from outside, 0
    without any.

    A longest path needs the whole design in order, so each design is one group; designs, not rows, are the parallel unit.
    """
    kind = dict(links.dtypes)[design]

    def longest(rows):
        import pandas as pd

        def levels(pairs, nodes):
            after, waits, level = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
            for a, b in pairs:
                after.setdefault(a, []).append(b)
                waits[b] += 1
            ready = [n for n, k in waits.items() if not k]
            while ready:
                n = ready.pop()
                for m in after.get(n, ()):
                    level[m] = max(level[m], level[n] + 1)
                    waits[m] -= 1
                    if not waits[m]:
                        ready.append(m)
            return level

        pairs = list(zip(rows["src"], rows["dst"]))
        nodes = sorted({n for p in pairs for n in p})
        found = levels(pairs, nodes), levels([(b, a) for a, b in pairs], nodes)
        tops = [max(1, *f.values()) for f in found]
        out = {design: rows[design].iloc[0], "node": nodes}
        for name, f, top in zip(("forward", "backward"), found, tops):
            out[name] = [f[n] for n in nodes]
            out[f"{name}_share"] = [f[n] / top for n in nodes]
        return pd.DataFrame(out)[[design, "node", "forward", "backward", "forward_share", "backward_share"]]

    return links.groupBy(design).applyInPandas(longest, f"{design} {kind}, node int, forward bigint, backward bigint, forward_share double, backward_share double")


def site_features(pins: DataFrame, cells: DataFrame, faults: DataFrame, design: str = "design") -> DataFrame:
    """(design, idx, drives, reads, sa0, sa1) of the gates at each design's fault (columns stuck_at, net)."""
    outs = cells.select("cell", "pin").withColumn("__out", F.lit(True))
    own = pins.join(faults, [design, "net"]).join(outs, ["cell", "pin"], "left").withColumn("__out", F.coalesce("__out", F.lit(False)))
    return own.groupBy(design, "idx").agg(
        F.max(F.col("__out").cast("int")).alias("drives"), F.max((~F.col("__out")).cast("int")).alias("reads"),
        F.max((F.col("stuck_at") == 0).cast("int")).alias("sa0"), F.max((F.col("stuck_at") == 1).cast("int")).alias("sa1"),
    )


def fault_universe(declared: DataFrame, design: str = "design") -> DataFrame:
    """Both faults of every declared net."""
    nets = declared.select(design, "net").distinct()
    return nets.select(design, F.explode(F.array(F.lit("sa0 "), F.lit("sa1 "))).alias("p"), "net").select(design, F.concat("p", "net").alias("fault"))


def gate_attributes(pins: DataFrame, cells: DataFrame, families: Column, design: str = "design") -> DataFrame:
    """(design, idx, cell, base, family, drive, inputs, outputs) of each gate; a cell that the table lacks is UNKNOWN."""
    outs = cells.select("cell", "pin").withColumn("__out", F.lit(True))
    known = cells.select("cell").distinct().withColumn("__known", F.lit(True))
    marked = pins.join(outs, ["cell", "pin"], "left").join(known, "cell", "left")
    own = marked.groupBy(design, "idx", "cell").agg(F.count_if(F.col("__out").isNull()).alias("n_in"), F.count("__out").alias("n_out"), F.max("__known").alias("__known"))
    base = base_cell(F.col("cell"))
    unknown = F.col("__known").isNull()
    return own.select(
        design, "idx", "cell", base.alias("base"), F.when(unknown, "UNKNOWN").otherwise(family(base, families)).alias("family"),
        F.when(unknown, "UNKNOWN").otherwise(drive_class(drive_value(F.col("cell")))).alias("drive"), F.when(unknown, "UNKNOWN").otherwise(input_class(F.col("n_in"))).alias("inputs"),
        F.when(unknown, 0).otherwise(F.col("n_out")).cast("int").alias("outputs"),
    )


def topological_levels(links: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, level) of a graph (src before dst): the longest path from a source.  Each round settles the nodes all of whose
    predecessors are settled; ValueError where a cycle stops that.  Rounds are the graph's depth."""
    links = stage_table(links.select("src", "dst").distinct(), "links")
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    done = stage_table(nodes.join(links, F.col("node") == F.col("dst"), "left_anti").select("node", F.lit(0).alias("level")), "levels")
    waiting = stage_table(nodes.join(done, "node", "left_anti"), "waiting")
    for level in range(1, most):
        if waiting.isEmpty():
            return done
        blocked = links.join(waiting, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
        free = stage_table(waiting.join(blocked, "node", "left_anti").select("node", F.lit(level).alias("level")), "free")
        if free.isEmpty():
            break
        done = done.union(free)
        waiting = stage_table(waiting.join(free, "node", "left_anti"), "waiting")
    raise ValueError("a cycle, or a deeper graph than that")


# The sentences of a description.
INTERFACE = "This combinational ASAP7 standard-cell netlist exposes {n_in} primary input bits ({inputs}) and {n_out} primary output bits ({outputs})."
IMPLEMENTATION = " The implementation uses {n_gates} cells, dominated by {mix}; the longest combinational path traverses {depth} levels of logic."


def descriptions(pins: DataFrame, cells: DataFrame, declared: DataFrame, design: str = "design", most: int = 8) -> DataFrame:
    """(design, description): the interface and the implementation of each design in two sentences; ports and cells beyond ``most`` and
    five are only counted."""
    names = lambda direction: F.array_sort(F.collect_list(F.when(F.col("direction") == direction, F.col("net"))))
    sides = declared.groupBy(design).agg(names("input").alias("i"), names("output").alias("o"))
    shown = lambda c: F.when(F.size(c) <= most, listed(F.col(c))).otherwise(F.concat(listed(F.slice(c, 1, most)), F.lit(", ... (+"), (F.size(c) - most).cast("string"), F.lit(" more)")))
    gates_of = pins.select(design, "idx", "cell").distinct()
    counts = gates_of.groupBy(design, base_cell(F.col("cell")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy(design).agg(F.sum("n").alias("n_gates"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "cell"))).alias("m"))
    share = lambda e: F.concat(e["cell"], F.lit(" ("), F.format_string("%.1f", F.round(-100.0 * e["k"] / F.col("n_gates"), 1)), F.lit("%)"))
    mixed = mixed.select(design, "n_gates", F.array_join(F.transform(F.slice("m", 1, 5), share), ", ").alias("mix"))
    longest = depths(edges(pins, cells, design), design).groupBy(design).agg((F.max("forward") + 1).alias("depth"))
    rows = sides.join(mixed, design).join(longest, design, "left")
    values = {"n_in": F.size("i"), "inputs": shown("i"), "n_out": F.size("o"), "outputs": shown("o"), "n_gates": F.col("n_gates"), "mix": F.col("mix"), "depth": F.coalesce("depth", F.lit(1))}
    return rows.select(design, filled(F.lit(INTERFACE + IMPLEMENTATION), values).alias("description"))
