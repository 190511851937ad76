"""Operator 4: chat formatting with a grammar round trip.

A conversation is rendered as

    <s> turn* </s>
    turn := [INST]ROLE[/INST]TEXT[END]

with one turn per row, in order of ``turn``. The parser is deterministic: it
cuts the rendered text at the control strings and nowhere else. A control
string whose second character follows one or more backslashes (``<\\/s>``) is
text; the parser takes one backslash away.

Rendering starts with the texts as they are. The rendered conversation is
parsed again and the recovered turns are compared with the source; a turn
that comes back different, or breaks the parse, has its control strings
escaped by one more backslash each, and the conversation is rendered again,
until the round trip is identical. Each turn is escaped at most once and a
fully escaped conversation always round-trips, so this ends.

The loss mask covers the texts of assistant turns, without the control
strings around them.

Defined results: null text and null role are empty; turns are ordered by
``turn`` (nulls first), then role, then text, and repeated rows are repeated
turns; rows with a null conv_id are one conversation; other columns are not
read; an empty table gives an empty result. One conversation is one rendered
text, put together from its turns; a conversation of any length is one row.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.llm.common import prepare, text_or_empty

BEGIN, OPEN, SAY, END, FINISH = "<s>", "[INST]", "[/INST]", "[END]", "</s>"
#: Any control string, with the backslashes that mark it as text.
_CONTROL = re.compile(r"<(\\*)(s>|/s>)|\[(\\*)(INST\]|/INST\]|END\])")
#: The same as one pattern of Java and DuckDB regular expressions.
CONTROL_SQL = r"(<\\*/?s>|\[\\*(?:/?INST|END)\])"


def escape(text: str) -> str:
    """One more backslash in every control string; :func:`unescape` undoes it."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """One backslash less in every control string that has any."""
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def render(turns: list[tuple[str, str]]) -> str:
    """The conversation of (role, text) turns whose texts are escaped already."""
    return BEGIN + "".join(f"{OPEN}{role}{SAY}{text}{END}" for role, text in turns) + FINISH


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered conversation, None where it breaks the grammar."""
    marks = [(m[0], m.start(), m.end()) for m in _CONTROL.finditer(formatted) if m[0][1] != "\\"]
    expected = [BEGIN, *[OPEN, SAY, END] * ((len(marks) - 2) // 3), FINISH]
    if [m[0] for m in marks] != expected or marks[0][1] != 0 or marks[-1][2] != len(formatted):
        return None
    turns, at = [], marks[0][2]
    for k in range(1, len(marks) - 1, 3):
        (_, a, b), (_, c, d), (_, e, f) = marks[k:k + 3]
        if a != at:
            return None
        turns.append((unescape(formatted[b:c]), unescape(formatted[d:e])))
        at = f
    return turns if at == marks[-1][1] else None


def round_trip(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str]]]:
    """The rendered conversation, and the turns read back from it."""
    sent = list(turns)
    escaped = [False] * len(turns)
    while True:
        formatted = render(sent)
        back = parse(formatted)
        if back == turns:
            return formatted, back
        # the turns that come back different; each turn alone where the parse broke
        bad = [k for k, t in enumerate(turns) if not escaped[k] and (back[k] != t if back is not None and len(back) == len(turns) else parse(render([sent[k]])) != [t])]
        for k in bad or [k for k, done in enumerate(escaped) if not done]:
            sent[k] = (escape(turns[k][0]), escape(turns[k][1]))
            escaped[k] = True


def loss_spans(formatted: str, role: str = "assistant") -> list[tuple[int, int]]:
    """Spans of the rendered text that the loss covers."""
    marks = [m for m in _CONTROL.finditer(formatted) if m[0][1] != "\\"]
    return [(b.end(), c.start()) for a, b, c in zip(marks[1::3], marks[2::3], marks[3::3]) if unescape(formatted[a.end():b.start()]) == role]


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, n_turns, loss array<struct<start,stop>>).

    Turns are put in order by a sort on (conv_id, turn) within hash partitions
    and stream through the formatter, one conversation at a time.
    """
    prepare(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    names = ["conv_id", "formatted", "n_turns", "loss"]
    turns = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text_or_empty().alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        held, key, some = [], None, False
        done: list[tuple] = []

        def close():
            formatted, back = round_trip(held)
            done.append((key, formatted, len(back), [{"start": a, "stop": b} for a, b in loss_spans(formatted)]))

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if some and conv != key:
                    close()
                    held = []
                key, some = conv, True
                held.append((role, text))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (id_type, pa.string(), pa.int64(), pa.list_(span)))], names)
                done = []
        if some:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (id_type, pa.string(), pa.int64(), pa.list_(span)))], names)

    return ordered.mapInArrow(run, f"conv_id {kind}, formatted string, n_turns long, loss array<struct<start:long,stop:long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of the turns and of the text under the loss mask,
    read back from the rendered conversations."""
    prepare(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns = parse(text)
                learnt = "".join(unescape(text[s["start"]:s["stop"]]) for s in loss)
                out.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                            len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))],
                                             ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
