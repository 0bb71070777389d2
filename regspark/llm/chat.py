"""Chat formatting with a grammar round trip.

Grammar of the rendered text::

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

A deterministic parser reads a rendered turn back. A turn is first rendered as it is; if
the parser does not return the same role and text, its control strings are escaped by
one backslash more inside their bars (``<|im_end|>`` becomes ``<|\\im_end|>``, and a
string that already has backslashes gets another), line breaks of the role likewise
(``\\n`` as backslash n), and the result is parsed again. Escaping is reversible for every
text, so this ends after one step. The loss mask covers the text of assistant turns.

Turns are rows throughout: a conversation of any length is read in order by one task
that holds one turn at a time. Defined cases: null text and null role are empty; null
conv_id is a conversation of its own; turns are ordered by turn (null first), then role,
then text, and repeated rows are repeated turns; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from regspark.llm.common import as_batch

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
ESCAPED = re.compile(r"<\|(\\*)\\(im_start|im_end)\|>")


def escape(t: str) -> str:
    return CONTROL.sub(r"<|\\\1\2|>", t)


def unescape(t: str) -> str:
    return ESCAPED.sub(r"<|\1\2|>", t)


def escape_role(r: str) -> str:
    return escape(r.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(r: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(r))


def render(role: str, text: str, raw: bool = False) -> str:
    if raw:
        return f"{START}{role}\n{text}{END}\n"
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the text's characters) of each turn; ValueError if outside the grammar."""
    out, at = [], 0
    while at < len(rendered):
        line = rendered.find("\n", at)
        if not rendered.startswith(START, at) or line < 0:
            raise ValueError(f"no turn at {at}")
        stop = rendered.find(END, line)
        head, body = rendered[at + len(START):line], rendered[line + 1:stop]
        if stop < 0 or rendered[stop + len(END):stop + len(END) + 1] != "\n" or START in body or START in head or END in head:
            raise ValueError(f"unclosed or nested turn at {at}")
        out.append((unescape_role(head), unescape(body), line + 1, stop))
        at = stop + len(END) + 1
    return out


def format_turn(role: str, text: str) -> str:
    """Rendered text whose parse is exactly this turn: as it is if that holds, else escaped."""
    for raw in (True, False):
        rendered = render(role, text, raw)
        try:
            if [(r, t) for r, t, _, _ in parse(rendered)] == [(role, text)]:
                return rendered
        except ValueError:
            pass
    raise AssertionError("escaping is not reversible for this turn")


FORMATTED = T.StructType([T.StructField("rendered", T.StringType()), T.StructField("loss_start", T.LongType()),
                          T.StructField("loss_end", T.LongType())])


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """One row per turn, in order within its partition: conv_id, turn, rendered text and, for assistant
    turns, the range of its characters under the loss mask (else null). A conversation's rows lie together."""
    rows = turns.select(turns[conv].alias("conv_id"), turns[turn].alias("turn"),
                        F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    out_type = T.StructType([*ordered.schema.fields[:2], *FORMATTED.fields])

    def write(batches):
        schema = to_arrow_schema(out_type)
        for b in batches:
            done, first, last = [], [], []
            for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                done.append(format_turn(r, t))
                _, _, i, j = parse(done[-1])[0]
                first.append(i if r == "assistant" else None)
                last.append(j if r == "assistant" else None)
            yield as_batch(schema, b.column(0), b.column(1), done, first, last)

    return ordered.mapInArrow(write, out_type)


EXAMPLE = T.StructType([T.StructField("text", T.StringType()), T.StructField("loss", T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def examples(formatted: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, its rendered text and the ranges of characters under the loss mask.
    The turns of a conversation follow each other, as ``format_conversations`` gives them."""
    out_type = T.StructType([formatted.schema["conv_id"], *EXAMPLE.fields])

    def join(batches):
        schema, now, size = to_arrow_schema(out_type), None, 0
        turns: list = []
        ranges: list = []
        for b in batches:
            out: list = []
            for conv, rendered, i, j in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if turns and conv != now:
                    out.append((now, "".join(turns), ranges))
                    turns, ranges, size = [], [], 0
                now = conv
                if i is not None and i < j:
                    ranges.append({"start": size + i, "end": size + j})
                turns.append(rendered)
                size += len(rendered)
            if out:
                yield as_batch(schema, *map(list, zip(*out, strict=True)))
        if turns:
            yield as_batch(schema, [now], ["".join(turns)], [ranges])

    return formatted.mapInArrow(join, out_type)


def digests(formatted: DataFrame) -> DataFrame:
    """Read the formatted conversations back: one row of digests each; streams over rows, one turn at a time."""
    out_type = T.StructType([formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()),
                             T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                             T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def read(batches):
        schema, now, open_ = to_arrow_schema(out_type), None, False
        n = loss = chars = 0
        turns, masked = hashlib.sha256(), hashlib.sha256()
        for b in batches:
            out: list = []
            for conv, rendered, i, j in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if not open_ or conv != now:
                    if open_:
                        out.append((now, n, turns.hexdigest(), loss, masked.hexdigest(), chars))
                    now, open_, n, loss, chars = conv, True, 0, 0, 0
                    turns, masked = hashlib.sha256(), hashlib.sha256()
                for role, text, _, _ in parse(rendered):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                if i is not None:
                    under = unescape(rendered[i:j])
                    loss += len(under)
                    masked.update(under.encode())
                chars += len(rendered)
            if out:
                yield as_batch(schema, *map(list, zip(*out, strict=True)))
        if open_:
            yield as_batch(schema, [now], [n], [turns.hexdigest()], [loss], [masked.hexdigest()], [chars])

    return formatted.mapInArrow(read, out_type)
