"""Conversations formatted by a compiled template, with the spans a loss counts.

Rows are spread by conversation and sorted by turn, and each task renders as it reads: the template's loop takes the
turns from the sorted rows one at a time, and long conversations leave in parts cut between turns. So a conversation
with very many turns costs time in its task, as its order demands, but no memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.common import table
from stackloom.llm.template_compiler import compile_template

#: Text inside a turn never holds these as they are.
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "<|role|>", "<|text|>", "<|end|>")

TEMPLATE = """{% for turn in messages %}{% if turn.role == 'user' %}[INST] {{ turn.text | escape }} [/INST]{% elif turn.role == 'assistant' %}\
{% generation %}{{ turn.text | escape }}{% endgeneration %}</s>{% else %}\
<|role|>{{ turn.role | escape }}<|text|>{{ turn.text | escape }}<|end|>{% endif %}{% endfor %}"""

#: Characters after which a part of a long conversation ends, at the next turn.
PART_CHARS = 1 << 20

_ESCAPE = re.compile(r"([\[<])(\\*)(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_UNESCAPE = re.compile(r"([\[<])\\(\\*)(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")


def escape(text: str) -> str:
    """A backslash more after the first character of each control string, however many it has already."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _UNESCAPE.sub(r"\1\2", text)


SCHEMA = "conv_id {id}, part long, formatted string, loss_spans array<struct<start:bigint,stop:bigint>>"


def format_conversations(turns: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS,
                         filters: dict[str, Callable[[str], str]] | None = None) -> DataFrame:
    """(conv_id, part, formatted, loss_spans): each conversation's turns through ``template``.

    ``turns`` has conv_id, turn, role, text; other columns are not used. Spans are code point offsets into ``formatted``
    of what the template marks as generated; an empty generated text has no span. Turns go in the order of ``turn``
    (nulls first), ties by role, then text. Null role and text are empty; rows with a null conv_id are one conversation.
    Repeated rows are turns of their own. No rows, no result. A conversation has one part unless it is longer than
    ``part_chars``; parts are cut between turns, and a template that looks at ``loop`` sees the whole conversation.
    """
    if "messages" not in template:
        raise ValueError("the template has no messages")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape} | (filters or {}))
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
        row = next(rows, None)
        out: list[tuple] = []
        while row is not None:
            conv, state = row[0], {"row": row, "turns": 0}

            def messages(conv=conv, state=state):
                while state["row"] is not None and state["row"][0] == conv:
                    state["turns"] += 1
                    yield {"role": state["row"][1] or "", "text": state["row"][2] or ""}
                    state["row"] = next(rows, None)

            part, pieces, spans, at, seen, source = 0, [], [], 0, 0, messages()
            for text, generated in render(messages=source):
                # the loop is one turn ahead: a new turn begins when the count has moved on
                if at >= part_chars and state["turns"] != seen:
                    out.append((conv, part, "".join(pieces), spans))
                    yield _batch(out, kind_pa)
                    out, part, pieces, spans, at = [], part + 1, [], [], 0
                seen = state["turns"]
                if generated:
                    if spans and spans[-1]["stop"] == at:
                        spans[-1]["stop"] = at + len(text)
                    else:
                        spans.append({"start": at, "stop": at + len(text)})
                pieces.append(text)
                at += len(text)
            for _ in source:  # turns that the template hasn't asked for
                pass
            out.append((conv, part, "".join(pieces), spans))
            row = state["row"]
            if sum(len(x[2]) for x in out[-64:]) > part_chars or len(out) >= 4096:
                yield _batch(out, kind_pa)
                out = []
        if out:
            yield _batch(out, kind_pa)

    kind_pa = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    placed = (turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
              .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"))
    return placed.mapInArrow(run, SCHEMA.format(id=kind))


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), span))],
                                      names=["conv_id", "part", "formatted", "loss_spans"])


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in text that ``TEMPLATE`` made."""
    at = 0
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            stop = formatted.index("[/INST]", at)
            yield "user", unescape(formatted[at + 7 : stop - 1])
            at = stop + 7
        elif formatted.startswith("<|role|>", at):
            middle, stop = formatted.index("<|text|>", at), formatted.index("<|end|>", at)
            yield unescape(formatted[at + 8 : middle]), unescape(formatted[middle + 8 : stop])
            at = stop + 7
        else:
            stop = formatted.index("</s>", at)
            yield "assistant", unescape(formatted[at:stop])
            at = stop + 4


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the turns and of the loss text, read back from the formatted conversations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr("cast(-1 AS bigint) AS conv_id", "cast(id AS bigint) AS turn",
                                      "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    formatted = format_conversations(turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").union(probe))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of a conversation come one after the other, in order."""
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out, now = [], None
        for b in batches:
            for conv, part, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                if part == 0:
                    if now:
                        out.append(finish(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse_turns(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode())
                for s in spans:
                    loss = unescape(text[s["start"] : s["stop"]])
                    now[3] += len(loss)
                    now[4].update(loss.encode())
                now[5] += len(text)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if now:
            out.append(finish(now))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    def finish(x: list) -> tuple:
        return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

    return formatted.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                        "formatted_chars long")


QUERIES = {"op7_chat_format": op7_chat_format}
