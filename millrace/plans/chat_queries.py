"""Chat text, tool calls, tables, templates and signal names, on conversations, events, parts and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat, signals
from .registry import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _turns(spark, sf_dir):
    """One row a conversation, with its turns in order: an array that one conversation bounds."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))


@query(f"""SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'chatml' WHEN 1 THEN 'granite' WHEN 2 THEN 'llama' ELSE 'deepseek_r1' END AS dialect,
    CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position, role, {STRIP.format('text')} AS content FROM conversations""")
def chat_round_trip(spark, sf_dir):
    """Conversations rendered in one of four dialects with an open answer at the end, then cut, detected and parsed back."""
    names = F.array(*(F.lit(d) for d in chat.DIALECTS))
    chats = _turns(spark, sf_dir).withColumn("wanted", F.get(names, (F.col("conv_id") % 4).cast("int")))
    texts = chats.withColumn("chat", chat.open_prompt(chat.render(F.col("turns"), F.col("wanted")), F.col("wanted")))
    closed = texts.select("conv_id", chat.without_opening(F.col("chat")).alias("chat"))
    parsed = closed.select("conv_id", chat.detect(F.col("chat")).alias("dialect"), F.posexplode(chat.messages(F.col("chat"))).alias("position", "m"))
    return parsed.select("conv_id", "dialect", "position", "m.role", "m.content")


@query(f"""SELECT conv_id, turn, {STRIP.format('text')} AS content FROM conversations WHERE role = 'assistant'""")
def bare_answers(spark, sf_dir):
    """Bare completions, wrapped in each dialect in turn and parsed."""
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    dialect = F.get(F.array(*(F.lit(d) for d in chat.DIALECTS)), ((F.col("conv_id") + F.col("turn")) % 4).cast("int"))
    return answers.select("conv_id", "turn", F.get(chat.answer_messages(F.col("text"), dialect), F.lit(0))["content"].alias("content"))


@query("""SELECT event_id, event_type AS name, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 2 END AS n_calls,
    CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'before' END AS rest FROM events""")
def tool_calls(spark, sf_dir):
    """Calls in JSON (arguments as an object or as a string) and in XML, beside broken ones, which don't count."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    args = F.col("props")
    quoted = F.to_json(F.struct(args.alias("a")))
    as_text = F.substr(quoted, F.lit(6), F.length(quoted) - 6)
    call = lambda a: F.concat(F.lit('<tool_call>\n{"name": "'), "event_type", F.lit('", "arguments": '), a, F.lit("}\n</tool_call>"))
    xml = F.concat(F.lit("<tool_call><function="), "event_type", F.lit(">\n<parameter=k>\n"), F.get_json_object(args, "$.k"), F.lit("\n</parameter></function></tool_call>"))
    broken = F.lit("<tool_call>{broken</tool_call>")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("before "), call(args), broken, call(as_text))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("before"), xml, call(args))).otherwise(F.concat(xml, broken))
    parsed = events.select("event_id", F.get(chat.messages(F.concat(F.lit(chat.IM_START + "assistant\n"), text, F.lit(chat.IM_END))), F.lit(0)).alias("m"))
    first = F.get(F.col("m.tool_calls"), F.lit(0))
    return parsed.select("event_id", first["name"].alias("name"), F.get_json_object(first["arguments"], "$.k").cast("long").alias("k"), F.size("m.tool_calls").alias("n_calls"), F.col("m.content").alias("rest"))


@query("""WITH t AS (SELECT conv_id, count(*) AS n_messages, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS whole,
        coalesce(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (role NOT IN ('assistant', 'tool')), '') || '<|im_start|>assistant' || chr(10) AS prompt
        FROM conversations GROUP BY conv_id)
    SELECT conv_id, n_messages, sha256(whole) AS text_sha, sha256(prompt) AS prompt_sha, len(list_filter(string_split_regex(prompt, '\\s+'), lambda x: x <> '')) AS prompt_tokens FROM t""")
def training_formats(spark, sf_dir):
    """Records as messages, as one text and as a prompt that asks for an answer, with the prompt's length."""
    shaped = _turns(spark, sf_dir).withColumns({"messages": F.col("turns"), "prompt_turns": F.filter("turns", lambda t: ~t["role"].isin("assistant", "tool"))})
    chatml = F.lit("chatml")
    texts = shaped.select("conv_id", F.size("messages").cast("long").alias("n_messages"), chat.render(F.col("messages"), chatml).alias("text"), chat.open_prompt(chat.render(F.col("prompt_turns"), chatml), chatml).alias("prompt"))
    words = F.filter(F.split("prompt", r"\s+"), lambda w: w != "")
    return texts.select("conv_id", "n_messages", F.sha2("text", 256).alias("text_sha"), F.sha2("prompt", 256).alias("prompt_sha"), F.size(words).cast("long").alias("prompt_tokens"))


TEMPLATE = "Analysis of {fault_net}:\n1. **Fault Excitation**: {fault_net} is driven to {excitation_value}.\n2. **Propagation:** through {propagation_gates} .\n3. **Odd Step**: by {backtrack_gates}\n4. **Close** done  "


@query("""SELECT p_partkey, sha256('Analysis of ' || p_name || ':' || chr(10) || '1. **Fault Excitation**: ' || p_name || ' is driven to ' || (p_size % 2) || '.' || chr(10)
    || CASE WHEN p_size % 3 = 0 THEN '2. **Propagation**: The fault effect at ' || p_name || ' propagates directly to the primary outputs (' || p_type || ') without requiring intermediate gate-level path sensitization.'
        ELSE '2. **Propagation:** through ' || p_brand || ' .' END || chr(10)
    || CASE WHEN p_size % 5 = 0 THEN '3. **Odd Step**: This step is handled implicitly for the stuck-at fault on ' || p_name || ' in module ' || p_brand || ', as the fault path is direct.' ELSE '3. **Odd Step**: by ' || p_type END || chr(10)
    || '4. **Close** done') AS digest FROM part""")
def reasoning_templates(spark, sf_dir):
    fields = {
        "fault_net": F.col("p_name"), "excitation_value": F.col("p_size") % 2, "primary_observation_nets": F.col("p_type"), "module_name": F.col("p_brand"), "fault_model_long": F.lit("stuck-at"),
        "propagation_gates": F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_brand")), "backtrack_gates": F.when(F.col("p_size") % 5 != 0, F.col("p_type")),
    }
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(chat.reasoning(F.lit(TEMPLATE), fields), 256).alias("digest"))


@query("""SELECT r_name, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS INTEGER) AS i, n_nationkey::VARCHAR AS id, n_name AS good, 'x' AS bad FROM nation JOIN region ON r_regionkey = n_regionkey""")
def markdown_tables(spark, sf_dir):
    """A table in a text, back as rows."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda n: F.concat(F.lit("| "), n["n_nationkey"].cast("string"), F.lit(" |"), n["n_name"], F.lit(" | x |")))
    texts = nations.groupBy("r_name").agg(F.concat(F.lit("See:\n| ID | Good Machine | Bad Machine |\n|----|---|---|\n"), F.array_join(lines, "\n"), F.lit("\nend")).alias("text"))
    rows = texts.select("r_name", F.posexplode(chat.table_rows(F.col("text"))).alias("i", "cells")).where("i > 0")
    return rows.select("r_name", "i", *(F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(("id", "good", "bad"))))


@query("""SELECT n_regionkey, 'N' || n_nationkey AS net, CAST(n_nationkey % 2 AS INTEGER) AS good, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 1 END AS bad FROM nation""")
def tool_response_rows(spark, sf_dir):
    """Simulation tables in tool responses, one map a machine, back as rows; an unknown bit is null."""
    each = F.array_sort(F.collect_list("n_nationkey"))
    member = lambda value: F.array_join(F.transform(each, lambda n: F.concat(F.lit('"N'), n.cast("string"), F.lit('": '), value(n))), ", ")
    good, bad = member(lambda n: (n % 2).cast("string")), member(lambda n: F.when(n % 3 == 0, "null").otherwise("1"))
    texts = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit('answer <tool_response>\n{"Good Machine": {'), good, F.lit('}, "Bad Machine": {'), bad, F.lit("}}\n</tool_response> end")).alias("text"))
    machines = texts.select("n_regionkey", chat.tool_response(F.col("text"), "map<string,int>").alias("m"))
    rows = machines.select("n_regionkey", F.explode(F.element_at("m", "Good Machine")).alias("net", "good"), "m")
    return rows.select("n_regionkey", "net", "good", F.element_at(F.element_at("m", "Bad Machine"), F.col("net")).alias("bad"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), i AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM l),
    r AS (SELECT l_orderkey, min(n) AS a, max(n) AS b FROM i GROUP BY l_orderkey, g), x AS (SELECT l_orderkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '..' || b END, ', ' ORDER BY a) AS s, sum(b - a + 1) AS k, min(a) AS m FROM r GROUP BY l_orderkey)
    SELECT l_orderkey, 'x[' || s || '], ' || CASE WHEN k = 1 THEN 'u/n' || m ELSE 'u/n[' || s || ']' END || ', clk' AS names FROM x""")
def compact_signals(spark, sf_dir):
    numbers = F.array_sort(F.collect_list("l_linenumber")).alias("n")
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(numbers)
    named = lambda before, after: F.transform("n", lambda n: F.concat(F.lit(before), n.cast("string"), F.lit(after)))
    tokens = F.concat(F.array(F.lit("clk")), named("x[", "]"), named("u/n", ""), F.array(F.lit("clk")))
    return orders.select("l_orderkey", signals.compact_signals(tokens).alias("names"))


@query("""WITH b AS (SELECT s_suppkey, unnest(generate_series(0, CAST(s_suppkey % 40 AS BIGINT))) AS i FROM supplier), v AS (SELECT *, (i * i + s_suppkey) % 3 = 0 AS one FROM b),
    o AS (SELECT s_suppkey, i, i - row_number() OVER (PARTITION BY s_suppkey ORDER BY i) AS g FROM v WHERE one), r AS (SELECT s_suppkey, min(i) AS a, max(i) AS z FROM o GROUP BY s_suppkey, g),
    s AS (SELECT s_suppkey, string_agg(CASE WHEN a = z THEN a::VARCHAR ELSE a || '..' || z END, ', ' ORDER BY a) AS ones FROM r GROUP BY s_suppkey),
    t AS (SELECT s_suppkey, count(*) AS k, string_agg('y[' || i || ']: ' || one::INT, ', ' ORDER BY i) AS plain FROM v GROUP BY s_suppkey)
    SELECT s_suppkey, CASE WHEN k + 1 < 24 THEN plain || ', en: 1' ELSE 'y[0..' || (k - 1) || '] ones={' || coalesce(ones, '-') || '}, en: 1' END AS answer FROM t LEFT JOIN s USING (s_suppkey)""")
def compact_assignments(spark, sf_dir):
    bit = lambda i: F.when((i * i + F.col("s_suppkey")) % 3 == 0, 1).otherwise(0)
    bus = F.transform(F.sequence(F.lit(0).cast("long"), F.col("s_suppkey") % 40), lambda i: F.struct(F.concat(F.lit("y["), i.cast("string"), F.lit("]")).alias("name"), bit(i).alias("bit")))
    pairs = F.concat(bus, F.array(F.struct(F.lit("en").alias("name"), F.lit(1).alias("bit"))))
    return table(spark, sf_dir, "supplier").select("s_suppkey", signals.compact_assignment(pairs).alias("answer"))


@query("""SELECT event_id, 'd' || event_id AS doc_id, 'module m' || user_id || ';' || chr(10) || chr(9) || 'wire ''w''; // é \\ end' AS netlist FROM events""")
def recovered_records(spark, sf_dir):
    """Ids and netlists out of prompts that quote them, with escapes, in either kind of quotes."""
    events = table(spark, sf_dir, "events")
    body = F.concat(F.lit("module m"), F.col("user_id").cast("string"), F.lit(r";\n\twire \'w\'; // é \\ end"))
    single = F.concat(F.lit("Use {'doc_id': 'd"), F.col("event_id").cast("string"), F.lit(" ', 'netlist': '"), body, F.lit("'} now"))
    double = F.concat(F.lit('Use {"netlist" : "'), body, F.lit('", "doc_id":"d'), F.col("event_id").cast("string"), F.lit('"}'))
    prompt = F.when(F.col("event_id") % 2 == 0, single).otherwise(double)
    return events.select("event_id", chat.recovered_record(prompt).alias("r")).select("event_id", "r.doc_id", "r.netlist")


@query(f"""SELECT conv_id, turn, {STRIP.format('text')} AS asked, CASE WHEN turn % 2 = 0 THEN '<think>' || text END AS second, CASE WHEN turn % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS mention FROM conversations""")
def text_parts(spark, sf_dir):
    """What stands between tags, behind a delimiter, and whether a fault is mentioned, whatever its spacing."""
    turns = table(spark, sf_dir, "conversations")
    whole = F.concat(F.lit("sys<user>\n"), "text", F.lit("\n</user> rest"))
    cut = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("call@@"), "text", F.lit("@@more"))).otherwise(F.col("text"))
    said = F.when(F.col("turn") % 3 == 0, "SA1 n[3]").when(F.col("turn") % 3 == 1, "detects  SA0\n N[3] too").otherwise("sa 0n[3]")
    return turns.select("conv_id", "turn", chat.between(whole, "<user>", "</user>").alias("asked"), chat.second_part(cut, "@@", "<think>").alias("second"), chat.mentions(said, F.lit("sa0"), F.lit("n[3]")).alias("mention"))
