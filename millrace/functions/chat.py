"""Chat text as columns: dialects, rendering, messages, tool calls, tool responses, tables, reasoning templates.

White space is the ASCII one.  Nulls give nulls.  Everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# The markers of the four dialects and what templates add for tools.
IM_START, IM_END = "<|im_start|>", "<|im_end|>"
ROLE_START, ROLE_END, TEXT_END = "<|start_of_role|>", "<|end_of_role|>", "<|end_of_text|>"
INST_START, INST_END, SYS_START, SYS_END = "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"
WIDE_USER, WIDE_ASSISTANT, WIDE_END = "<｜User｜", "<｜Assistant｜", "<｜end▁of▁sentence｜"
TOOLS_HEADING = "# Tools\n\n"
TOOLS_SENTENCE = "You are a helpful assistant with access to the following tools."
DIALECTS = ("chatml", "granite", "llama", "deepseek_r1")

TOOL_CALL = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"
TOOL_RESPONSE = r"(?s)<tool_response>\s*(.*?)\s*</tool_response>"
MESSAGES = "array<struct<role: string, content: string, tool_calls: array<struct<name: string, arguments: string>>>>"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+\z", "")


def strip_end(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+\z", "")


def blank_as_null(x: Column) -> Column:
    return F.when(x != "", x)


def detect(text: Column) -> Column:
    """The dialect of a chat text by its markers; null where there are none."""
    has = lambda m: F.contains(text, F.lit(m))
    return (
        F.when(has(ROLE_START) & has(ROLE_END), "granite")
        .when(has(IM_START) & has(IM_END), "chatml")
        .when(has(INST_START) & has(INST_END), "llama")
        .when(has(WIDE_USER) | has(WIDE_ASSISTANT) | has(WIDE_END), "deepseek_r1")
        .when(has(IM_START), "chatml")
        .when(has(ROLE_START), "granite")
    )


def json_or_text(value: Column) -> Column:
    """JSON text of a value: the value itself if it is a JSON object or array, else a JSON string."""
    quoted = F.to_json(F.struct(value.alias("v")))
    is_json = value.rlike(r"^\s*[\[{]") & F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v").isNotNull()
    return F.when(is_json, strip(value)).otherwise(F.substr(quoted, F.lit(6), F.length(quoted) - 6))


def tool_call(inner: Column) -> Column:
    """struct(name, arguments as JSON text) of what stands inside a tool call, JSON or XML; null if it is neither."""

    def parsed(blob: Column) -> Column:
        arguments = F.get_json_object(blob, "$.arguments")
        as_json = F.struct(F.get_json_object(blob, "$.name").alias("name"), F.when(arguments.startswith("{"), arguments).otherwise("{}").alias("arguments"))
        shape, parameter = r"(?s)<function=([^>\s]+)>(.*?)</function>", r"(?s)<parameter=([^>\s]+)>\s*(.*?)\s*</parameter>"
        body = F.regexp_extract(blob, shape, 2)
        names, values = (F.regexp_extract_all(body, F.lit(parameter), F.lit(i)) for i in (1, 2))
        pairs = F.zip_with(names, values, lambda n, v: F.concat(json_or_text(n), F.lit(":"), json_or_text(v)))
        as_xml = F.struct(F.regexp_extract(blob, shape, 1).alias("name"), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("arguments"))
        return F.when(blob.startswith("{") & F.get_json_object(blob, "$.name").isNotNull(), as_json).when(blob.rlike(shape), as_xml)

    return let(strip(inner), parsed)


def tool_calls(text: Column) -> Column:
    """Every tool call of a text that can be read, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(TOOL_CALL), F.lit(1)), tool_call), lambda c: c.isNotNull())


def _message(role: Column | str, content: Column | None, calls: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        (F.lit(role) if isinstance(role, str) else role).alias("role"),
        (none.cast("string") if content is None else content).alias("content"),
        (none if calls is None else calls).cast("array<struct<name: string, arguments: string>>").alias("tool_calls"),
    )


def _finish(block: Column) -> Column:
    """Messages of one block (role, content): tool responses of a user turn are tool messages, an assistant's calls are apart."""
    role, content = block["role"], block["content"]
    calls = tool_calls(content)
    plain = blank_as_null(strip(F.regexp_replace(content, TOOL_CALL, "")))
    answers = F.regexp_extract_all(content, F.lit(TOOL_RESPONSE), F.lit(1))
    none = F.array().cast(MESSAGES)
    return (
        F.when(role == "system", F.when(content != "", F.array(_message("system", content))).otherwise(none))
        .when(role == "assistant", F.array(_message("assistant", plain, F.when(F.size(calls) > 0, calls))))
        .when((role == "user") & (F.size(answers) > 0), F.transform(answers, lambda a: _message("tool", strip(a))))
        .when(role == "user", F.array(_message("user", strip(content))))
        .otherwise(none)
    )


def _blocks(text: Column, end: str, shape: str, system: Callable[[Column], Column]) -> Column:
    """(role, content) of texts whose turns end with a marker and begin as ``shape`` has it."""
    parts = F.transform(F.split(text, f"\\Q{end}\\E"), strip)
    found = F.filter(parts, lambda p: p.rlike(shape))
    pair = lambda p: F.struct(strip(F.regexp_extract(p, shape, 1)).alias("role"), F.regexp_extract(p, shape, 2).alias("content"))
    cleaned = lambda b: F.struct(b["role"].alias("role"), F.when(b["role"] == "system", system(b["content"])).otherwise(b["content"]).alias("content"))
    return F.transform(F.transform(found, pair), cleaned)


def _chatml(text: Column) -> Column:
    def system(c: Column) -> Column:
        return F.when(F.contains(c, F.lit("\n\n" + TOOLS_HEADING)), F.substring_index(c, "\n\n" + TOOLS_HEADING, 1)).when(c.startswith(TOOLS_HEADING), "").otherwise(c)

    return _blocks(text, IM_END, r"(?s)<\|im_start\|>(.*?)\n(.*)", system)


def _granite(text: Column) -> Column:
    def system(c: Column) -> Column:
        return F.when(F.contains(c, F.lit(TOOLS_SENTENCE)), strip_end(F.substring_index(c, TOOLS_SENTENCE, 1))).otherwise(c)

    return _blocks(text, TEXT_END, r"(?s)<\|start_of_role\|>(.*?)<\|end_of_role\|>(.*)", system)


def _pair(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


_PAIRS = "array<struct<role: string, content: string>>"


def _llama(text: Column) -> Column:
    shape = r"(?s)<<SYS>>\s*(.*?)\s*<</SYS>>"
    has_system = text.rlike(shape)
    head = F.when(has_system, F.array(_pair("system", strip(F.regexp_extract(text, shape, 1))))).otherwise(F.array().cast(_PAIRS))
    rest = F.when(has_system, strip(F.regexp_replace(text, r"(?s)\A(.*?)<<SYS>>.*?<</SYS>>", "$1"))).otherwise(text)
    turn = r"(?s)\[INST\]\s*(.*?)\s*\[/INST\]\s*(.*?)(?=\[INST\]|$)"
    asked, answered = (F.transform(F.regexp_extract_all(rest, F.lit(turn), F.lit(i)), strip) for i in (1, 2))
    both = F.zip_with(asked, answered, lambda u, a: F.filter(F.array(_pair("user", u), _pair("assistant", a)), lambda b: b["content"] != ""))
    return F.concat(head, F.flatten(both))


def _deepseek(text: Column) -> Column:
    parts = F.split(text, f"(?={WIDE_USER}|{WIDE_ASSISTANT})")

    def block(p: Column) -> Column:
        role = F.when(p.startswith(WIDE_USER), "user").when(p.startswith(WIDE_ASSISTANT), "assistant").otherwise("system")
        content = strip(F.when(p.startswith(WIDE_USER), F.substr(p, F.lit(len(WIDE_USER) + 1))).when(p.startswith(WIDE_ASSISTANT), F.substr(p, F.lit(len(WIDE_ASSISTANT) + 1))).otherwise(p))
        ended = (role != "system") & content.endswith(WIDE_END)
        content = F.when(ended, strip(F.left(content, F.length(content) - len(WIDE_END)))).otherwise(content)
        return F.struct(role.alias("role"), content.alias("content"))

    return F.transform(parts, block)


def messages(text: Column, dialect: Column | str | None = None) -> Column:
    """MESSAGES of a chat text; the dialect is detected unless given; null where it is unknown."""
    kind = detect(text) if dialect is None else F.lit(dialect) if isinstance(dialect, str) else dialect
    blocks = F.when(kind == "chatml", _chatml(text)).when(kind == "granite", _granite(text)).when(kind == "llama", _llama(text)).when(kind == "deepseek_r1", _deepseek(text))
    return F.flatten(F.transform(blocks, _finish))


def render(turns: Column, dialect: Column) -> Column:
    """A chat text of ``turns``, an array of (role, content), in the dialect."""
    joined = lambda each: F.array_join(F.transform(turns, each), "")
    chatml = joined(lambda t: F.concat(F.lit(IM_START), t["role"], F.lit("\n"), t["content"], F.lit(f"{IM_END}\n")))
    granite = joined(lambda t: F.concat(F.lit(ROLE_START), t["role"], F.lit(ROLE_END), t["content"], F.lit(f"{TEXT_END}\n")))
    llama = joined(
        lambda t: F.when(t["role"] == "system", F.concat(F.lit(f"{SYS_START}\n"), t["content"], F.lit(f"\n{SYS_END}\n\n")))
        .when(t["role"] == "user", F.concat(F.lit(f"{INST_START} "), t["content"], F.lit(f" {INST_END}")))
        .otherwise(F.concat(F.lit(" "), t["content"], F.lit(" ")))
    )
    wide = joined(
        lambda t: F.when(t["role"] == "system", t["content"])
        .when(t["role"] == "user", F.concat(F.lit(WIDE_USER), t["content"]))
        .otherwise(F.concat(F.lit(WIDE_ASSISTANT), t["content"], F.lit(WIDE_END)))
    )
    return F.when(dialect == "chatml", chatml).when(dialect == "granite", granite).when(dialect == "llama", llama).when(dialect == "deepseek_r1", wide)


#: What a generation prompt adds at the end, longest first.
OPENINGS = {
    "chatml": (f"{IM_START}assistant\n<think></think>", f"{IM_START}assistant\n<think>\n", f"{IM_START}assistant\n"),
    "granite": (f"{ROLE_START}assistant{ROLE_END}",),
    "deepseek_r1": (WIDE_ASSISTANT,),
}


def open_prompt(text: Column, dialect: Column) -> Column:
    """The text with the opening of an assistant turn at its end."""
    out = text
    for name, (*_, plain) in OPENINGS.items():
        out = F.when(dialect == name, F.concat(text, F.lit(plain))).otherwise(out)
    return out


def without_opening(text: Column) -> Column:
    """A prompt without the exact opening of an assistant turn at its end; begun answers stay."""
    out = F.when(F.lit(False), text)
    for opening in sorted((o for group in OPENINGS.values() for o in group), key=len, reverse=True):
        out = out.when(text.endswith(opening), F.left(text, F.length(text) - len(opening)))
    return out.otherwise(text)


def with_thought_prefix(completion: Column, thinking: Column) -> Column:
    """A completion with the thought opening that the template, not the model, wrote."""
    return F.concat(F.when(thinking, "<think>\n").otherwise("<think></think>"), completion)


def wrapped_answer(completion: Column, dialect: Column) -> Column:
    """A bare completion as a chat text with one assistant turn."""
    return (
        F.when(dialect == "granite", F.concat(F.lit(f"{ROLE_START}assistant{ROLE_END}"), completion, F.lit(TEXT_END)))
        .when(dialect == "llama", F.concat(F.lit(f"{INST_START} \n{INST_END} "), completion))
        .when(dialect == "deepseek_r1", F.concat(F.lit(WIDE_ASSISTANT), completion, F.lit(WIDE_END)))
        .otherwise(F.concat(F.lit(f"{IM_START}assistant\n"), completion, F.lit(IM_END)))
    )


def answer_messages(completion: Column, dialect: Column) -> Column:
    """The assistant messages of a bare completion."""
    return F.filter(messages(wrapped_answer(completion, dialect), dialect), lambda m: m["role"] == "assistant")


def table_rows(text: Column) -> Column:
    """The first Markdown table of a text as an array of rows of trimmed cells, the heading first; empty without a table."""
    table = F.regexp_extract(text, r"(\|[^\n]*\|\n\|[-| ]+\|\n(?:\|[^\n]*\|\n?)*)", 1)
    lines = F.filter(F.transform(F.split(table, "\n"), strip), lambda x: x.startswith("|") & ~x.rlike(r"^[-| ]*\z"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+\z", ""), r"\|"), strip))


def tool_response(text: Column, fields: str) -> Column:
    """The first tool response that is a JSON object, as a map from its names to ``fields``; null where it can't be read."""
    blob = F.regexp_extract(text, r"(?s)<tool_response>\s*(\{.*?\})\s*</tool_response>", 1)
    return F.from_json(F.nullif(blob, F.lit("")), f"map<string,{fields}>", {"allowSingleQuotes": "true"})


def between(text: Column, before: str, after: str) -> Column:
    """What stands between two tags, stripped."""
    return strip(F.substring_index(F.substring_index(text, after, 1), before, -1))


def second_part(text: Column, mark: str, prefix: str) -> Column:
    """``prefix`` and what follows the first mark up to the next; null without the mark."""
    return F.concat(F.lit(prefix), F.get(F.split(text, f"\\Q{mark}\\E"), F.lit(1)))


# The fields that may be empty, and what stands for a step that needs one, by words of its title.
OPTIONAL = ("propagation_gates", "backtrack_gates", "primary_controlling_nets", "non_controlling_nets")
REPLACEMENTS = (
    (
        ("excitation", "setup", "activation", "input justification", "value assignment", "logic justification"),
        "The {fault_model_long} fault on {fault_net} is excited by driving the net to {excitation_value} through the combined primary input assignments.",
    ),
    (
        ("propagation", "sensitiz", "path selection", "d-frontier drive", "forward propagation", "d-frontier maintenance", "gate-level", "gate constraint"),
        "The fault effect at {fault_net} propagates directly to the primary outputs ({primary_observation_nets}) without requiring intermediate gate-level path sensitization.",
    ),
    (
        ("backtrack", "side-input", "justification of", "recursive", "conditioning"),
        "No intermediate gate-level backtracking or side-input conditioning is needed — the fault path from {fault_net} to the outputs is direct.",
    ),
    (
        ("implication", "conflict", "consistency", "resolution"),
        "The primary input assignments are logically consistent with no conflicts along the fault propagation path.",
    ),
)
IMPLICIT = "This step is handled implicitly for the {fault_model_long} fault on {fault_net} in module {module_name}, as the fault path is direct."
_FIELD = r"\{(\w+)\}"


def filled(template: Column, fields: dict[str, Column]) -> Column:
    """The template with its ``{name}`` fields; as it is where it names one that isn't given."""
    known = F.array(*(F.lit(n) for n in fields))
    out = template
    for name, value in fields.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.when(F.size(F.array_except(F.regexp_extract_all(template, F.lit(_FIELD), F.lit(1)), known)) == 0, out).otherwise(template)


def reasoning(template: Column, fields: dict[str, Column], optional: tuple[str, ...] = OPTIONAL, replacements: tuple = REPLACEMENTS, implicit: str = IMPLICIT) -> Column:
    """A template of numbered steps ``N. **Title** ...``, each filled; a step that names an empty optional field becomes its
    number, title and the first replacement that has a word of the title."""
    empty = F.array_compact(F.array(*(F.when(strip(F.coalesce(fields[n].cast("string") if n in fields else F.lit(""), F.lit(""))) == "", F.lit(n)) for n in optional)))
    header = r"^(\d+)\.\s+\*\*([^*]+)\*\*"

    def step(s: Column) -> Column:
        title = F.regexp_replace(strip(F.regexp_extract(s, header, 2)), r":+\z", "")
        low, body = F.lower(title), F.when(F.lit(False), "")
        for words, text in replacements:
            any_word = F.lit(False)
            for w in words:
                any_word = any_word | F.contains(low, F.lit(w))
            body = body.when(any_word, F.lit(text))
        generic = F.concat(F.regexp_extract(s, header, 1), F.lit(". **"), title, F.lit("**: "), filled(body.otherwise(F.lit(implicit)), fields))
        lacks = F.arrays_overlap(F.regexp_extract_all(s, F.lit(_FIELD), F.lit(1)), empty)
        return F.when(lacks & s.rlike(header), generic).otherwise(filled(strip_end(s), fields))

    steps = F.filter(F.split(strip(template), r"(?=\d+\.\s+\*\*)"), lambda s: strip(s) != "")
    return F.array_join(F.transform(steps, step), "\n")


def mentions(text: Column, fault: Column, net: Column) -> Column:
    """1.0 where a text names the fault, whatever the case and the white space."""
    low = F.regexp_replace(F.lower(text), r"\s+", " ")
    whole = F.concat(F.lower(fault), F.lit(" "), F.lower(net))
    hit = F.contains(low, whole) | F.contains(F.replace(low, F.lit(" "), F.lit("")), F.concat(F.lower(fault), F.lower(net)))
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)


def unescaped(text: Column) -> Column:
    r"""\n, \t, \r, \', \", \\ and \uXXXX as the characters that they stand for."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\.|[^\\]+|\\)"), F.lit(1))
    simple = F.create_map(*(F.lit(x) for pair in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\'", "'"), ('\\"', '"'), ("\\\\", "\\")) for x in pair))

    def one(p: Column) -> Column:
        code = F.conv(F.substr(p, F.lit(3)), 16, 10).cast("int")
        return F.when(p.rlike(r"^\\[ux][0-9a-fA-F]"), F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")).otherwise(F.coalesce(F.try_element_at(simple, p), p))

    return F.array_join(F.transform(pieces, one), "")


def recovered_record(prompt: Column) -> Column:
    """struct(doc_id, netlist) of a prompt that holds them as quoted fields, single or double quotes."""
    quoted = lambda name: rf"""(?is)['"]?{name}['"]?\s*:\s*(?:'((?:\\.|[^'\\])*)'|"((?:\\.|[^"\\])*)")"""

    def field(name: str) -> Column:
        one, two = (F.regexp_extract(prompt, quoted(name), i) for i in (1, 2))
        return F.when(prompt.rlike(quoted(name)), unescaped(F.when(one != "", one).otherwise(two)))

    return F.struct(strip(field("doc_id")).alias("doc_id"), field("netlist").alias("netlist"))
