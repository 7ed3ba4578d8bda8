"""Chat formatting by grammar round trip.

Grammar of a formatted conversation, one turn after another::

    turn := "### " role ":\\n" text "</turn>\\n"

Inside a role or text a backslash makes the next character ordinary, and an unescaped control string ends it; so a
deterministic parser finds the turns.  Each turn is first rendered as it is and parsed; if what comes back differs, or
does not parse, its conflicting strings are escaped and it is parsed again until the source comes back.

Turns of a conversation are taken in the order of turn, role, text (nulls first), so ties and repeated rows have a fixed
place; a repeated row is a turn of its own.  Null role and text count as empty.  Rows with a null conversation id form
one conversation.  Turns stream through sorted partitions: memory holds one turn, however long the conversation.  Only the
four named columns are read.  An empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns

OPEN, CLOSE, AFTER_ROLE = "### ", "</turn>", ":\n"
_IN_TEXT = re.compile(r"\\|### |</turn>")
_IN_ROLE = re.compile(r"\\|### |</turn>|:|\n")
_STOPS = re.compile(r"\\(.)|(### |</turn>)", re.S)
_ROLE_STOPS = re.compile(r"\\(.)|(:\n|### |</turn>|\n)", re.S)


class Unparsable(ValueError):
    """The text is no formatted conversation."""


def _field(text: str, at: int, stops: re.Pattern[str], end: str) -> tuple[str, int, int]:
    """(unescaped value, position of what ended it, position after that) of a field that ``end`` ends."""
    parts, start = [], at
    while m := stops.search(text, at):
        parts.append(text[at : m.start()])
        if m[2] is None:
            parts.append(m[1])
            at = m.end()
        elif m[2] == end:
            return "".join(parts), m.start(), m.end()
        else:
            raise Unparsable(f"{m[2]!r} at {m.start()}, in a field from {start}")
    raise Unparsable(f"a field from {start} doesn't end")


def parse_turn(text: str, at: int = 0) -> tuple[str, str, tuple[int, int], int]:
    """(role, text, range of the rendered text, position after the turn) of the turn at ``at``."""
    if not text.startswith(OPEN, at):
        raise Unparsable(f"no turn at {at}")
    role, _, start = _field(text, at + len(OPEN), _ROLE_STOPS, AFTER_ROLE)
    said, stop, at = _field(text, start, _STOPS, CLOSE)
    if not text.startswith("\n", at):
        raise Unparsable(f"no line end at {at}")
    return role, said, (start, stop), at + 1


def parse(text: str) -> list[tuple[str, str]]:
    """All turns (role, text) of a formatted conversation."""
    at, turns = 0, []
    while at < len(text):
        role, said, _, at = parse_turn(text, at)
        turns.append((role, said))
    return turns


def render_turn(role: str, text: str) -> tuple[str, tuple[int, int]]:
    """The rendered turn and the range of its text, escaped as far as the parser needs it to give the turn back."""
    tries = ((role, text), (role, _IN_TEXT.sub(r"\\\g<0>", text)), (_IN_ROLE.sub(r"\\\g<0>", role), _IN_TEXT.sub(r"\\\g<0>", text)))
    for r, t in tries:
        out = f"{OPEN}{r}{AFTER_ROLE}{t}{CLOSE}\n"
        try:
            back = parse_turn(out)
        except Unparsable:
            continue
        if (back[0], back[1], back[3]) == (role, text, len(out)):
            return out, back[2]
    raise AssertionError(f"no escape gives back {role!r}, {text!r}")


def ordered(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, with each conversation whole and in order within one partition."""
    rows = own_columns(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")})
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


RENDERED = "position bigint, formatted string, text_from bigint, text_to bigint, under_loss boolean"


def render(turns: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",), **columns: str) -> DataFrame:
    """One row per turn: conv_id, its place, its part of the formatted text, the range of its text in the part (code
    points), and whether that range is under the loss mask.  The parts in order make up the formatted conversation."""
    rows = ordered(turns, **columns)
    kind = rows.schema["conv"].dataType.simpleString()

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        place = 0
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
                place = place + 1 if (conv,) == last else 0
                last = (conv,)
                part, (start, stop) = render_turn(role, text)
                for column, v in zip(out, (place, part, start, stop, role in loss_roles)):
                    column.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *(pa.array(c, t) for c, t in zip(out, kinds))], ["conv", *(x.split()[0] for x in RENDERED.split(", "))])

    return rows.mapInArrow(formatted, f"conv {kind}, {RENDERED}").withColumnRenamed("conv", columns.get("conv_col", "conv_id"))


DIGESTS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(rendered: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation: id and DIGESTS, read back from the rows of ``render``, in whose order it relies."""
    kind = rendered.schema[conv_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        state: list | None = None

        def result(states: list[list]) -> pa.RecordBatch:
            columns = zip(*([n, a.hexdigest(), k, b.hexdigest(), c] for _, n, a, k, b, c in states))
            ids = pa.array([s[0] for s in states], id_type)
            return pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), t) for c, t in zip(columns, kinds))], [conv_col, *names])

        id_type = None
        for batch in batches:
            id_type, done = batch.column(conv_col).type, []
            for conv, part, start, stop, loss in zip(*(batch.column(c).to_pylist() for c in (conv_col, "formatted", "text_from", "text_to", "under_loss"))):
                if state is None or conv != state[0]:
                    if state:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, span, end = parse_turn(part)
                if end != len(part) or span != (start, stop):
                    raise AssertionError("a part is not one turn")
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if loss:
                    said, _, _ = _field(part[start:stop] + CLOSE, 0, _STOPS, CLOSE)
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(part)
            if done:
                yield result(done)
        if state:
            yield result([state])

    return rendered.mapInArrow(read, f"`{conv_col}` {kind}, {DIGESTS}")
