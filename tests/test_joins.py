"""What validated joins, manifests and circuits refuse, and plain versions of what has no SQL."""

from __future__ import annotations

import itertools

import pytest
from millrace.functions import chat, documents, overlap, rewards, signals, text
from millrace.operators import circuit, joins, netlist, ranking
from millrace.sources import manifests, readers, writers
from millrace.streaming import pipelines
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_checked_join_refuses(spark):
    left = frame(spark, [(1, "f"), (2, "g")], "k int, fault string")
    good = frame(spark, [(1, "f"), (2, "g")], "k int, fault string")
    assert joins.checked_join(left, good, ["k"], same=["fault"], left_unique=True, cover_right=True).count() == 2
    for right, options in (
        (frame(spark, [(1, "f")], "k int, fault string"), {}),
        (good.union(good), {}),
        (frame(spark, [(1, "f"), (2, "other")], "k int, fault string"), {"same": ["fault"]}),
        (good.union(frame(spark, [(3, "h")], "k int, fault string")), {"cover_right": True}),
    ):
        with pytest.raises(joins.Unmet):
            joins.checked_join(left, right, ["k"], **options)
    with pytest.raises(joins.Unmet):
        joins.checked_join(left.union(left), good, ["k"], left_unique=True)


def test_pairs_slots_and_layouts_refuse(spark):
    a = frame(spark, [(1, "x", True), (2, "x", False), (3, "y", True)], "k int, c string, d boolean")
    b = frame(spark, [(1, "x", False), (2, "x", False), (3, "y", True)], "k int, c string, d boolean")
    assert {r["c"]: r["d"] for r in joins.paired_difference(a, b, "k", "c", ["d"]).collect()} == {"x": -0.5, "y": 0.0}
    for other in (b.where("k < 3"), b.union(b), b.withColumn("c", F.lit("z"))):
        with pytest.raises(joins.Unmet):
            joins.paired_difference(a, other, "k", "c", ["d"])
    problems = frame(spark, [("p",), ("q",)], "p string")
    slots = frame(spark, [("p", 0), ("p", 1), ("q", 0), ("q", 1)], "p string, slot int")
    assert joins.require_slots(slots, problems, ["p"], "slot", 2).count() == 4
    for bad in (slots.where("not (p = 'q' and slot = 0)"), slots.union(slots), slots.withColumn("slot", F.col("slot") + 1), slots.withColumn("p", F.lit("r"))):
        with pytest.raises(joins.Unmet):
            joins.require_slots(bad, problems, ["p"], "slot", 2)
    joins.require_layout(8, 2, 4, 1)
    for layout in ((8, 3, 4, 1), (5, 2, 4, 1), (0, 2, 4, 1)):
        with pytest.raises(joins.Unmet):
            joins.require_layout(*layout)
    with pytest.raises(joins.Unmet):
        joins.one_identity(frame(spark, [(1, "a"), (1, "b")], "g int, i string"), "g", "i")
    with pytest.raises(joins.Unmet):
        joins.selected(slots, ["slot", "missing"])


def test_manifests(spark, tmp_path):
    rows = frame(spark, [(1, "a", 0.5), (2, None, 1.5)], "k int, t string, _difficulty double")
    path = str(tmp_path / "manifest")
    manifests.save(rows, path, 3, "uniform")
    back = manifests.load(spark, path, 3, ["k"])
    assert back.columns == ["k", "t"] and back.count() == 2
    assert manifests.checksum(back.repartition(7)) == manifests.checksum(back)
    assert manifests.checksum(back.withColumn("k", F.col("k") + 1)) != manifests.checksum(back)
    with pytest.raises(ValueError):
        manifests.load(spark, path, 4, ["k"])
    with pytest.raises(Exception, match="exist"):
        manifests.save(rows, path, 3)
    back.union(back).write.parquet(str(tmp_path / "twice/rows"))
    assert manifests.trial_path("s3://x/", "study", "stage", 7, 3) == "s3://x/study/stage/trial-00007/seed-3"
    shown = manifests.markdown_table(frame(spark, [("a", 0.5, 1), ("b", None, 2), ("c", float("nan"), 3)], "n string, v double, i int"), ["n"])
    assert shown.split("\n")[2:] == ["| a | 0.500 | 1 |", "| b | - | 2 |", "| c | - | 3 |"]


def test_chat_dialects(spark):
    call = '<tool_call>\n{"name": "sim", "arguments": "{\\"a\\": 1}"}\n</tool_call>'
    xml = "<tool_call><function=sim><parameter=a>\n[1, 2]\n</parameter><parameter=b> x\"y </parameter></function></tool_call>"
    chatml = f"<|im_start|>system\nBe good.\n\n# Tools\n\nmany<|im_end|>\n<|im_start|>user\n hi <|im_end|>\n<|im_start|>assistant\nok {call}{xml}<|im_end|>\n<|im_start|>user\n<tool_response>\n r1 \n</tool_response><tool_response>r2</tool_response><|im_end|>\n<|im_start|>assistant\n"
    got = one(spark, chat.messages(F.col("t")), t=chatml)
    assert [(m["role"], m["content"]) for m in got] == [("system", "Be good."), ("user", "hi"), ("assistant", "ok"), ("tool", "r1"), ("tool", "r2")]
    assert [(c["name"], c["arguments"]) for c in got[2]["tool_calls"]] == [("sim", '{"a": 1}'), ("sim", '{"a":[1, 2],"b":"x\\"y"}')]
    closed = one(spark, chat.messages(chat.without_opening(F.col("t"))), t=chatml)
    assert closed == got
    llama = "<<SYS>>\nrules\n<</SYS>>\n\n[INST] q1 [/INST] a1 [INST] q2 [/INST]"
    assert [(m["role"], m["content"]) for m in one(spark, chat.messages(F.col("t")), t=llama)] == [("system", "rules"), ("user", "q1"), ("assistant", "a1"), ("user", "q2")]
    wide = "sys <｜User｜ hi <｜Assistant｜ yo <｜end▁of▁sentence｜"
    assert [(m["role"], m["content"]) for m in one(spark, chat.messages(F.col("t")), t=wide)] == [("system", "sys"), ("user", "hi"), ("assistant", "yo")]
    granite = "<|start_of_role|>system<|end_of_role|>Now. You are a helpful assistant with access to the following tools. x<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>done<|end_of_text|>"
    assert [(m["role"], m["content"]) for m in one(spark, chat.messages(F.col("t")), t=granite)] == [("system", "Now."), ("assistant", "done")]
    assert one(spark, chat.messages(F.col("t")), t="no marks") is None and one(spark, chat.detect(F.col("t")), t="<|im_start|>") == "chatml"
    for dialect in chat.DIALECTS:
        assert [(m["role"], m["content"]) for m in one(spark, chat.answer_messages(F.col("t"), F.lit(dialect)), t=" fine ")] == [("assistant", "fine")]
    assert one(spark, chat.with_thought_prefix(F.lit("x"), F.lit(True))) == "<think>\nx"


def test_templates_and_escapes(spark):
    template = "1. **Setup**: {fault_net}\n2. **Backtrack**: {backtrack_gates}\n3. **Other** {unknown}"
    fields = {"fault_net": F.lit("n1"), "backtrack_gates": F.lit(" ")}
    want = "1. **Setup**: n1\n2. **Backtrack**: No intermediate gate-level backtracking or side-input conditioning is needed — the fault path from n1 to the outputs is direct.\n3. **Other** {unknown}"
    assert one(spark, chat.reasoning(F.lit(template), fields)) == want
    assert one(spark, chat.unescaped(F.col("t")), t=r"a\n\t\\ \' \" é \q" + "\\") == 'a\n\t\\ \' " é \\q\\'
    assert one(spark, signals.compact_signals(F.array(*(F.lit(x) for x in ("d[3]", "d[0]", "d[1]", "u/n7", "clk", "u/n8", "clk"))))) == "d[0..1, 3], u/n[7..8], clk"


def test_answers_and_rewards(spark):
    said = 'INPUT_VECTOR: "z: 1" <think>INPUT_VECTOR: "a: 0"</think> INPUT_VECTOR: "a: 1, b: 0" EXPECTED_OUTPUT: "y: 1" EXPECTED_OUTPUT: "y: 0"'
    got = one(spark, rewards.answer(F.col("t")), t=said)
    assert got["input"] == {"a": 1, "b": 0} and got["expected"] is None
    for bad in ("a: 1, a: 0", "a: X", "", "a: 1 b: 0", "a"):
        assert one(spark, text.assignment(F.col("t")), t=bad) is None
    table = "| ID | Good | Bad |\n|---|---|---|\n| y | 1 | 0 |\n| z | x | 1 |\n"
    found = one(spark, rewards.simulation_table(F.col("t")), t=table)
    assert found == {"Good Machine": {"y": 1, "z": None}, "Bad Machine": {"y": 0, "z": 1}}
    bits = lambda **m: F.create_map(*(F.lit(x) for k, v in m.items() for x in (k, v)))
    nets = F.array(F.lit("y"))
    scored = one(spark, rewards.components(F.col("t"), F.lit("sa0"), F.lit("w"), bits(y=1, w=1), bits(y=0, w=0), F.array(F.lit("a")), nets), t='INPUT_VECTOR: "a: 1" EXPECTED_OUTPUT: "y: 1" DETECTED_FAULTS: "SA0 w"')
    assert len(scored) == 17 and scored["detection"] == scored["activation"] == scored["fidelity"] == 1 and scored["format"] == 0.75
    none = one(spark, rewards.components(F.col("t"), F.lit("sa0"), F.lit("w"), bits(y=1, w=1), bits(y=0, w=0), F.array(F.lit("a")), nets), t="nothing")
    assert set(none.values()) == {0.0}
    m = F.create_map(F.lit("fault_detected_by_pred_input_vector_acc_logonly"), F.lit(1.0), F.lit("input_vector_acc"), F.lit(0.0))
    assert [one(spark, rewards.accepted(m, mode)) for mode in ("fault_detected", "full_accuracy", "positive_reward")] == [True, False, True]
    with pytest.raises(ValueError):
        rewards.accepted(m, "other")
    with pytest.raises(ValueError):
        rewards.profile("other")


def test_overlap_of_texts(spark):
    pairs = [("the cat sat on the mat", "the cat sat on a mat"), ("a b c d e f", "a b x d e f"), ("one two", "three four five six")]
    df = frame(spark, pairs, "r string, c string")
    got = df.select(overlap.bleu_counts(F.col("r"), F.col("c")).alias("k")).agg(overlap.corpus_bleu(F.col("k")).alias("b")).first()["b"]
    assert got == pytest.approx(overlap.plain_bleu(pairs))
    scores = [r["l"] for r in df.select(overlap.rouge_l(F.col("r"), F.col("c")).alias("l")).collect()]
    assert scores == [pytest.approx(10 / 12), pytest.approx(10 / 12), 0.0]


def test_survivors(spark):
    rows = [("g", i, i % 2, float(i), format(i * 5 % 16, "04b")) for i in range(12)] + [("h", 50, 1, 1.0, "0000")]
    df = frame(spark, rows, "g string, k long, q int, s double, v string")
    got = sorted((r["g"], r["place"], r["k"]) for r in ranking.survivors(df, "g", "k", ["q"], "s", "v", 4).collect())
    best = {}
    for g, k, q, s, v in rows:
        if g == "g":
            best[v] = max(best.get(v, (-1, -1, 0, 0)), (q, s, -k, k))
    pool = sorted(((q, s, k, v) for v, (q, s, _, k) in best.items()), reverse=True)
    kept = [pool.pop(0)]
    while len(kept) < 4:
        far = lambda c: min(sum(a != b for a, b in zip(c[3], d[3])) for d in kept)
        nxt = max(pool, key=lambda c: (c[0], far(c), c[1]))
        kept.append(nxt)
        pool.remove(nxt)
    assert got == [("g", i + 1, c[2]) for i, c in enumerate(kept)] + [("h", 1, 50)]


def test_circuit_aliases_constants_and_flips():
    source = "module m(a, b, y);\ninput a, b;\noutput y, z;\nwire w, v;\nassign v = w;\nassign z = 1'b1;\nAND2 g(.A(a), .B(b), .Y(w));\nTIELogic0 t(.Y(k));\nOR2 h(.A(v), .B(k), .Y(y));\nendmodule"
    c = circuit.Circuit(source)
    for a, b in itertools.product((0, 1), repeat=2):
        values = {n: g for n, g, *_ in c.machines({"a": a, "b": b}, (0, "w"))}
        assert values["y"] == (a & b) and values["z"] == 1
    assert c.decisive({"a": 1, "b": 1}, (0, "v")) == (True, ["a", "b"]) and c.decisive({"a": 0, "b": 1}, (0, "w")) == (False, [])
    assert c.scoap()["y"][1] == 4
    for bad in ("assign a = b;", "AND2 x(.A(a), .B(b), .Y(a));", "NOPE x(.A(a), .Y(q));", "AND2 x(.A(y), .B(b), .Y(w));"):
        with pytest.raises(circuit.Rejected):
            circuit.Circuit(source.replace("wire w, v;", f"wire w, v;\n{bad}"))
    with pytest.raises(circuit.Rejected):
        circuit.Circuit(source, {"AND2": {"Y": "A & B"}})


def test_levels_and_cells(spark, tmp_path):
    edges = frame(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("a", "d")], "src string, dst string")
    assert {r["node"]: r["level"] for r in netlist.topological_levels(edges).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    with pytest.raises(ValueError):
        netlist.topological_levels(edges.union(frame(spark, [("d", "a")], "src string, dst string")))
    (tmp_path / "cells.json").write_text('{"BUFx2": {"Y": "A"}, "HAx1": {"CON": "~(A & B)", "SN": "~(A ^ B)"}}')
    assert sorted((r["cell"], r["pin"]) for r in netlist.library(spark, str(tmp_path / "cells.json")).collect()) == [("BUFx2", "Y"), ("HAx1", "CON"), ("HAx1", "SN")]
    drives = {"INVxp33_ASAP7_75t_R": 0.33, "INVx1p5_X": 1.5, "FAx2p67DC": 2.67, "NAND2x1_A": 1.0, "TIE": 1.0}
    got = spark.createDataFrame([(k,) for k in drives], "c string").select("c", signals.drive_value(F.col("c")).alias("v"), signals.base_cell(F.col("c")).alias("b")).collect()
    assert {r["c"]: r["v"] for r in got} == drives and {r["b"] for r in got} == {"INV", "FA", "NAND2", "TIE"}


def test_framed_logs_and_whole_files(spark, tmp_path):
    records = [b"one", b"x" * 70_000, b"", b"last"]
    out = b""
    for r in records:  # as writers of such logs cut records at blocks
        first = True
        while True:
            left = readers.BLOCK - len(out) % readers.BLOCK
            if left < readers.HEADER:
                out += b"\0" * left
                continue
            part, r = r[: left - readers.HEADER], r[left - readers.HEADER :]
            kind = 1 if first and not r else 2 if first else 3 if r else 4
            out += b"\0" * 4 + len(part).to_bytes(2, "little") + bytes([kind]) + part
            first = False
            if not r:
                break
    assert list(readers.framed_records(out)) == records and list(readers.framed_records(out[:-1])) == records[:-1]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.bin").write_bytes(out[:-2])
    got = readers.framed_log(spark, str(tmp_path / "log")).orderBy("record_no").collect()
    assert [bytes(r["data"]) for r in got] == records[:-1]
    df = spark.range(3)
    target = str(tmp_path / "whole")
    writers.whole_json(df, target, exclusive=True)
    with pytest.raises(FileExistsError):
        writers.whole_json(df, target, exclusive=True)
    writers.whole_json(df.where("id = 0"), target)
    assert spark.read.json(target).count() == 1


def test_streams_go_on_and_log(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(5).coalesce(1).write.parquet(str(src))
    folder = f"file://{tmp_path}/out"
    stream = lambda: pipelines.files(spark, str(src))
    assert pipelines.drain(stream(), folder, name="n").count() == 5
    spark.range(5, 9).coalesce(1).write.mode("append").parquet(str(src))
    assert sorted(r["id"] for r in pipelines.drain(stream(), folder, name="n").collect()) == list(range(9))
    writers.metrics(stream(), str(tmp_path / "metrics"), str(tmp_path / "progress")).awaitTermination()
    assert spark.read.json(str(tmp_path / "metrics")).count() == 9


def test_balanced_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Unnamed: 0,k,g\n" + "\n".join(f"{i},{i},{'a' if i % 5 else 'b'}" for i in range(200)))
    rows = readers.balanced_csv(spark, str(tmp_path / "d.csv"), "g", "k")
    counts = {(r["split"], r["g"]): r["count"] for r in rows.groupBy("split", "g").count().collect()}
    assert counts["train", "a"] == counts["train", "b"] and rows.where("split <> 'train'").count() == rows.where("split <> 'train'").select("k").distinct().count()


def test_documents(spark):
    assert one(spark, documents.canonical(F.col("t")), t='{"b": [1, {"z": "é😀"}], "a": null}') == '{"a":null,"b":[1,{"z":"\\u00e9\\ud83d\\ude00"}]}'
    assert one(spark, documents.canonical(F.col("t")), t="{broken") is None
    assert one(spark, documents.human_bytes(F.lit(1536))) == "1.5000 KB" and one(spark, documents.days_to_seconds(F.lit(93784))) == "1 days, 02:03:04"
