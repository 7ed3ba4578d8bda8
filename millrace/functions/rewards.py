"""Reward components of a completion against a simulated problem, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chat, signals, text
from .text import let

# The objectives with their weights, by profile.
OBJECTIVES = {"detection": 1.0, "activation": 0.25, "fidelity": 0.20, "format": 0.05}
PROFILES = {"detection": ("detection", "format"), "po": ("detection", "fidelity", "format"), "full": tuple(OBJECTIVES)}
HIDDEN = "_logonly"


def profile(name: str) -> dict[str, float]:
    """The objectives of a profile with their weights."""
    if name not in PROFILES:
        raise ValueError(f"no profile {name}")
    return {k: OBJECTIVES[k] for k in PROFILES[name]}


def field(completion: Column, name: str) -> Column:
    """The first ``NAME: "..."`` of a text; null without."""
    shape = rf'(?s){name}:\s"(.*?)"'
    return F.when(completion.rlike(shape), F.regexp_extract(completion, shape, 1))


def answer(completion: Column) -> Column:
    """struct(input, expected) of the fields after the last tool response and thought, each given exactly once; else null."""
    final = text.final_part(completion)

    def once(name: str) -> Column:
        found = F.regexp_extract_all(final, F.lit(rf'\b{name}:\s*"([^"]*)"'), F.lit(1))
        return F.when(F.size(found) == 1, text.assignment(F.get(found, F.lit(0))))

    return F.struct(once("INPUT_VECTOR").alias("input"), once("EXPECTED_OUTPUT").alias("expected"))


def simulation_table(completion: Column) -> Column:
    """map machine -> map net -> bit of a completion's own table: its JSON tool response where it has both machines, else the first
    Markdown table with three columns (net, good, bad); null without."""
    from_json = chat.tool_response(completion, "map<string,int>")

    def legacy(rows: Column) -> Column:
        body = F.filter(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.size(r) == 3)
        names = F.transform(body, lambda r: F.get(r, F.lit(0)))
        bits = lambda k: F.transform(body, lambda r: F.get(r, F.lit(k)).try_cast("int"))
        unique = F.size(F.array_distinct(names)) == F.size(names)
        return F.when((F.size(body) > 0) & unique, F.create_map(F.lit("Good Machine"), F.map_from_arrays(names, bits(1)), F.lit("Bad Machine"), F.map_from_arrays(names, bits(2))))

    has_both = F.map_contains_key(from_json, "Good Machine") & F.map_contains_key(from_json, "Bad Machine")
    return F.coalesce(F.when(has_both, from_json), let(chat.table_rows(completion), legacy))


def table_accuracy(table: Column, good: Column, bad: Column, outputs: Column) -> Column:
    """Share of the outputs' values, in both machines, that a table has right, of those that both know; null where there are none."""

    def shares(t: Column) -> Column:
        pairs = F.flatten(
            F.transform(
                outputs,
                lambda o: F.array(
                    F.struct(F.try_element_at(F.try_element_at(t, F.lit("Good Machine")), o).alias("a"), F.try_element_at(good, o).alias("b")),
                    F.struct(F.try_element_at(F.try_element_at(t, F.lit("Bad Machine")), o).alias("a"), F.try_element_at(bad, o).alias("b")),
                ),
            )
        )
        known = F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull())
        return F.when(F.size(known) > 0, F.size(F.filter(known, lambda p: p["a"] == p["b"])) / F.size(known))

    return let(table, shares)


def components(completion: Column, fault: Column, net: Column, good: Column, bad: Column, inputs: Column, outputs: Column) -> Column:
    """map of seventeen components.  ``good`` and ``bad``: simulated maps net -> bit of both machines (null: the simulation
    failed); fidelity and format count only with a detection."""
    vector, expected, named = (field(completion, n) for n in ("INPUT_VECTOR", "EXPECTED_OUTPUT", "DETECTED_FAULTS"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    has = lambda c: flag(c.isNotNull() & (c != ""))
    shape = (flag(completion.rlike(r"(?s)<think>.*?</think>")) + flag(completion.rlike(chat.TOOL_CALL)) + flag(completion.rlike(chat.TOOL_RESPONSE)) + has(vector) + has(expected) + has(named)) / 6
    table = simulation_table(completion)
    stuck = F.substring(fault, -1, 1).cast("int")
    asked = fault.isNotNull() & net.isNotNull() & F.coalesce(vector != "", F.lit(False))
    valid = asked & good.isNotNull() & bad.isNotNull()
    of = lambda m: F.map_filter(m, lambda k, v: F.array_contains(outputs, k))
    when = lambda c: F.when(valid, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    detected, active = flag(signals.differs(of(good), of(bad))), flag(signals.activated(good, bad, net, stuck))
    po = F.coalesce(signals.matched_share(text.assignment(expected), of(good)), F.lit(0.0))
    pi = F.coalesce(signals.complete_share(text.assignment(vector), inputs), F.lit(0.0))
    mention = chat.mentions(named, fault, net)
    values = {
        "detection": when(detected), "activation": when(active), "fidelity": when(detected * po), "format": when(detected * (0.5 * shape + 0.5 * pi)),
        "format_compliance": shape, "pi_completeness": when(pi), "tool_response_fidelity": when(table_accuracy(chat.tool_response(completion, "map<string,int>"), good, bad, outputs)),
        "fault_mention": when(mention), "sim_table_present": flag(table.isNotNull()), "pred_vs_fault_sim_acc": when(table_accuracy(table, good, bad, outputs)),
        "fault_detected_by_pred_input_vector_acc": when(detected), "fault_site_activated_acc": when(active), "expected_output_acc": when(flag(po >= 0.999)),
        "input_vector_acc": when(flag(pi >= 0.999)), "detected_faults_acc": when(flag(mention >= 0.99)), "simulation_valid": flag(valid),
        "simulator_error": flag(asked & (good.isNull() | bad.isNull())),
    }
    return F.create_map(*(x for name, v in values.items() for x in (F.lit(name if name in OBJECTIVES else name + HIDDEN), v)))


def accepted(scored: Column, mode: str = "fault_detected") -> Column:
    """Whether a map of components is accepted: detected, right in all fields (full_accuracy), or with a positive sum."""
    at = lambda n: F.coalesce(F.try_element_at(scored, F.lit(n)), F.try_element_at(scored, F.lit(n + HIDDEN)), F.lit(0.0)) >= 1
    detected = at("fault_detected_by_pred_input_vector_acc")
    if mode == "fault_detected":
        out = detected
    elif mode == "full_accuracy":
        out = detected & at("input_vector_acc") & at("expected_output_acc") & at("detected_faults_acc")
    elif mode == "positive_reward":
        out = F.aggregate(F.map_values(scored), F.lit(0.0), lambda a, v: a + v) > 0
    else:
        raise ValueError(f"no mode {mode}")
    return out & (F.coalesce(F.try_element_at(scored, F.lit("search_failure" + HIDDEN)), F.lit(0.0)) == 0)
