"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

Nodes of the DAG are (row, state of the role grammar), edges are edits: keep, rerole, delete, insert. A path's weight is one
integer: its cost in the high digits, and below them the letters of its edits, one digit of fixed width each from the highest place
on, zeros after the last. So the least integer is the cheapest path, and among the cheapest that whose letters come
first in ASCII order, the shorter of two where one begins with the other. Weights are taken from the last row back: an edit is put
before the letters of the rest by moving them down one place.

A node's edits have different letters, and each leads to one node, so letters of one node are told apart by the first of them.
Hence a fixed number of places (``PLACES``) is exact however long a conversation is: letters moved out at the lower end
never decide.

On Spark, rows are spread by conversation and sorted; each row comes twice, first without its text. So a task knows the edits
before the texts stream past: it holds the edits and a digest for each row of one conversation, no texts. (The result has a digest
of the whole repaired conversation, so its rows stream through one task in any case.)
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.common import table, text_slices

# Costs, the order of the letters, the roles of the grammar (s?(ua)+)?
COSTS = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED_COST = 1
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPT = (START, ASSISTANT)
#: The state after a user or assistant turn, whichever may come next; an inserted or reroled turn is that one.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: The initial of a role to the states it may be kept in.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAME = {USER: "user", ASSISTANT: "assistant"}

#: Letters a weight has room for, of 3 bits each.
PLACES = 128
_LOW = 3 * PLACES
_NEVER = 1 << (_LOW + 64)

#: Kinds of rows: initial (s, u, a, other) by fault (none, truncated, must go).
INITIALS = "sua"
SOUND, TRUNCATED, FORCED = range(3)

EDITS = ("conv_id {id}, seq long, turn long, edit string, fault string, old_role string, role string, text string, cost int")


def _put(letter: str, cost: int, rest: int) -> int:
    """The weight of an edit and what follows it."""
    high, low = rest >> _LOW, rest & ((1 << _LOW) - 1)
    return (high + cost << _LOW) | (DIGIT[letter] << _LOW - 3) | (low >> 3)


def cheapest_edits(kinds: bytes) -> str:
    """Letters of the least-weight path for rows of the given kinds (3 * initial + fault, see ``kind_of``)."""
    rest = [0 if q in ACCEPT else _NEVER for q in range(4)]
    chosen = []
    for i in range(len(kinds), -1, -1):
        edges: list[dict[str, int]] = [{} for _ in range(4)]
        if i == len(kinds):
            for q in ACCEPT:
                edges[q][""] = 0
        else:
            initial, fault = divmod(kinds[i], 3)
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            for q in range(4):
                edges[q]["D"] = _put("D", COSTS["D"], rest[q])
                if fault != FORCED:
                    edges[q]["R"] = _put("R", COSTS["R"] + more, rest[NEXT[q]])
                    to = KEEP[INITIALS[initial]].get(q) if initial < 3 else None
                    if to is not None:
                        edges[q]["K"] = _put("K", COSTS["K"] + more, rest[to])
        # at most two inserts in a row: a third is back at a state there was before, at more cost
        plain = [min(x.values(), default=_NEVER) for x in edges]
        once = [min(plain[q], _put("I", COSTS["I"], plain[NEXT[q]])) for q in range(4)]
        for q in range(4):
            edges[q]["I"] = _put("I", COSTS["I"], once[NEXT[q]])
        chosen.append([min(x, key=x.get) for x in edges])
        rest = [min(x.values()) for x in edges]
    chosen.reverse()
    out, q, i = [], START, 0
    while letter := chosen[i][q]:
        out.append(letter)
        if letter != "D":
            q = KEEP[INITIALS[kinds[i] // 3]][q] if letter == "K" else NEXT[q]
        i += letter != "I"
    return "".join(out)


_known_edits = functools.lru_cache(maxsize=1 << 16)(cheapest_edits)


def kind_of(role: str, fault: int) -> int:
    return 3 * ("sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3) + fault


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, turn, edit, fault, old_role, role, text, cost): the edits of every conversation, in order.

    ``turns`` has conv_id, turn, role, text; other columns are not used. Rows go in the order of ``turn`` (nulls first), ties
    by role, then by a digest of role and text. Null role and text are one space; rows with a null conv_id are one conversation. ``fault`` is
    the first of blank, duplicate (the same role and text before) and truncated, or null. A role with another initial than s, u or a, or
    with none, can't be kept. ``edit`` is K, R, D or I; inserted
    rows have no turn, fault and old_role, and an empty text; of deleted ones role is null. ``cost`` is that of the edit. No
    rows, no result. Very long texts pass as they are; repeated rows are duplicates.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    space = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"),
                        F.coalesce("text", space).alias("text"))
    end = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1)
    rows = rows.select("*", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
                       F.when(end == "", 2).when(end.isin(".", "!", "?"), 0).otherwise(1).alias("state"))
    twice = rows.select("conv_id", "turn", "role", "digest", "state", F.explode(F.array(F.lit(False), F.lit(True))).alias("full"), "text")
    placed = (twice.withColumn("text", F.when(F.col("full"), F.col("text")))
              .repartition("conv_id").sortWithinPartitions("conv_id", "full", "turn", "role", "digest"))
    kind_pa = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    types = [kind_pa, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
    names = [x.split()[0] for x in EDITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for row in _edits(r for b in text_slices(batches, "text") for r in zip(*(c.to_pylist() for c in b.columns))):
            out.append(row)
            held += len(row[7]) + 64
            if held > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return placed.mapInArrow(run, EDITS.format(id=kind))


FAULTS = {b"": None, b"B": "blank", b"2": "duplicate", b"T": "truncated"}


def _edits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of ``repair`` from sorted ones: all of a conversation without texts, then all with them."""
    row = next(rows, None)
    while row is not None:
        conv, kinds, faults, seen = row[0], bytearray(), bytearray(), set()
        while row is not None and row[0] == conv and not row[5]:
            _, _, role, digest, state, _, _ = row
            fault = b"B" if state == 2 else b"2" if digest in seen else b"T" if state else b"-"
            seen.add(digest)
            faults += fault
            kinds.append(kind_of(role, SOUND if fault == b"-" else TRUNCATED if fault == b"T" else FORCED))
            row = next(rows, None)
        del seen
        edits = (_known_edits if len(kinds) <= 64 else cheapest_edits)(bytes(kinds))
        q, i = START, 0
        for seq, letter in enumerate(edits):
            if letter == "I":
                q = NEXT[q]
                yield conv, seq, None, "I", None, None, NAME[q], "", COSTS["I"]
                continue
            _, turn, role, _, _, _, text = row
            fault = FAULTS.get(bytes(faults[i : i + 1]))
            cost = COSTS[letter] + (TRUNCATED_COST if fault == "truncated" and letter != "D" else 0)
            if letter != "D":
                q = KEEP[role[:1]][q] if letter == "K" else NEXT[q]
            yield conv, seq, turn, letter, fault, role, role if letter == "K" else NAME[q] if letter == "R" else None, text, cost
            i += 1
            row = next(rows, None)


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): a twentieth of the rows each dropped, emptied, without sentence ends, repeated, or a user's.

    Which ones, a checksum of conversation and turn decides. Null role and text, and nulls in the checksum's text, are one space.
    """
    space = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                        (F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                                          F.coalesce(F.col("turn").cast("string"), space))) % 20).alias("draw"))
    draw = F.col("draw")
    return rows.filter("draw <> 0").select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


RESULT = ("conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def digests(edits: DataFrame) -> DataFrame:
    """One row of ``RESULT`` per conversation, from the rows of ``repair`` as they come (in order, each conversation in one piece)."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    kind_pa = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    types = [kind_pa, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] == 0:
                    if now:
                        out.append(now.result())
                    now = _Digest(row[0])
                now.add(*row[2:])
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if now:
            out.append(now.result())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return edits.mapInArrow(run, RESULT.format(id=kind))


class _Digest:
    """What the query returns of one conversation, row by row."""

    def __init__(self, conv):
        self.conv, self.first, self.last, self.turns = conv, None, None, 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.cost, self.audit, self.before, self.sha, self.kept = 0, 0, bytearray(), None, hashlib.sha256(), 0

    def add(self, turn, edit, fault, old_role, role, text, cost) -> None:
        self.audit += edit.encode()
        self.cost += cost
        if edit != "I":
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
            if self.before is not None and self.before + old_role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = old_role[:1]
            if fault:
                self.counts[fault] += 1
        if edit != "D":
            self.sha.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode())
            self.kept += 1

    def result(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest())


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least cost, edits and the digest of the repaired text of every conversation, after damage."""
    turns = table(spark, sf_dir, "conversations")
    found = digests(repair(damage(turns)))
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    joined = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(F.col("id").alias("conv_id"),
                         *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
