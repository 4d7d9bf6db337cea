"""Chat formatting by grammar round trip.

A conversation is rendered with a fixed template, the result is read back by a deterministic parser, and
what it recovers is compared with the source. Turns whose content conflicts with the grammar are
escaped, and the conversation is rendered again, until the two are identical.

    conversation = "<s>" turn*
    turn         = "[INST] " text " [/INST]"               role user
                 | "[SYS] " text " [/SYS]"                 role system
                 | " " text " </s>"                        role assistant
                 | "[ROLE] " role " [=] " text " [/ROLE]"  any other role

In a text, k backslashes before a control string stand for the text's k - 1 backslashes and that string;
a control string without one is the template's own. Markers are set off by spaces, so neither a text's
last backslash nor part of a control string can merge with them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import id_type, map_batches

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[=]")
CONTROL = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROLS)) + ")")
OPEN, CLOSE = {"user": "[INST] ", "system": "[SYS] ", "assistant": " "}, {"user": " [/INST]", "system": " [/SYS]", "assistant": " </s>"}


class GrammarError(ValueError):
    pass


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    start: int = -1  # of the text as it stands in the output
    end: int = -1


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + "\\" + m[2], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1][1:] + m[2], text)


def render_turn(role: str, text: str, escaped: bool) -> str:
    if escaped:
        role, text = role if role in OPEN else escape(role), escape(text)
    if role in OPEN:
        return OPEN[role] + text + CLOSE[role]
    return f"[ROLE] {role} [=] {text} [/ROLE]"


def _until(line: str, at: int, mark: str) -> tuple[int, int]:
    """Where the next control string of the template begins, which must be mark after a space, and where it ends."""
    for m in CONTROL.finditer(line, at):
        if not m[1]:
            if m[2] != mark or m.start() == at or line[m.start() - 1] != " ":
                raise GrammarError(f"{m[2]} where {mark} should be, at {m.start()}")
            return m.start() - 1, m.end()
    raise GrammarError(f"no {mark} after {at}")


def parse_turns(line: str, at: int = 0) -> Iterator[Turn]:
    while at < len(line):
        role = next((r for r, mark in OPEN.items() if line.startswith(mark, at)), "")
        if role:
            start = at + len(OPEN[role])
            mark = CLOSE[role][1:]
        elif line.startswith("[ROLE] ", at):
            end, start = _until(line, at + 7, "[=]")
            role, mark = unescape(line[at + 7 : end]), "[/ROLE]"
            if line[start : start + 1] != " ":
                raise GrammarError(f"no space at {start}")
            start += 1
        else:
            raise GrammarError(f"no turn at {at}")
        end, at = _until(line, start, mark)
        yield Turn(role, unescape(line[start:end]), start, end)


def parse(line: str) -> list[Turn]:
    """The turns of a formatted conversation, with the places of their texts."""
    if not line.startswith("<s>"):
        raise GrammarError("no <s>")
    return list(parse_turns(line, 3))


def _same(found: list[Turn], turns: list[tuple[str, str]]) -> bool:
    return [(t.role, t.text) for t in found] == turns


def _conflicts(turn: tuple[str, str]) -> bool:
    try:
        return not _same(list(parse_turns(render_turn(*turn, False))), [turn])
    except GrammarError:
        return True


def format_conversation(turns: list[tuple[str, str]]) -> tuple[str, list[Turn]]:
    """The formatted text and what the parser reads back from it, which equals turns."""
    escaped = [False] * len(turns)
    while True:
        line = "<s>" + "".join(render_turn(role, text, e) for (role, text), e in zip(turns, escaped))
        try:
            if _same(found := parse(line), turns):
                return line, found
        except GrammarError:
            pass
        more = [e or _conflicts(t) for t, e in zip(turns, escaped)]
        if more == escaped:
            more = [True] * len(turns)
            if all(escaped):
                raise GrammarError("the round trip fails with everything escaped")
        escaped = more


def needs_escape(role: str, text: str) -> bool:
    """Whether a turn conflicts with the grammar as it stands; if so, the escaped one is proved to come back identical.

    The parser reads turn after turn and never looks behind a turn's end, so a conversation comes back identical
    if and only if each of its turns does alone.
    """
    if not _conflicts((role, text)):
        return False
    if not _same(list(parse_turns(render_turn(role, text, True))), [(role, text)]):
        raise GrammarError("the round trip fails with everything escaped")
    return True


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; null roles and texts are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return conversations.select("conv_id", "turn", text("role"), text("text"))


def grouped(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, role, text) by turn, then role and text; null turns come first."""
    return turns_of(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


class Digest:
    """What is kept of a conversation while its formatted turns pass by, however many they are."""

    def __init__(self, conv_id: object):
        self.conv_id, self.n, self.loss_chars, self.chars = conv_id, 0, 0, len("<s>")
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str) -> None:
        """Read a formatted turn back."""
        self.chars += len(piece)
        for t in parse_turns(piece):
            self.n += 1
            self.turns.update(f"{t.role}\n{t.text}\n".encode())
            if t.role == "assistant":
                shown = unescape(piece[t.start : t.end])
                self.loss_chars += len(shown)
                self.loss.update(shown.encode())

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(conversations: DataFrame) -> DataFrame:
    """The "digests" of formatted().

    Turns are rendered, read back, compared and escaped where they are read, so the work on a conversation that
    holds a third of all rows is spread over all tasks. A sort on (conv_id, turn), which can spill, then brings
    them in order past a task that formats one turn after another and holds none of the others.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            escaped = [needs_escape(*t) for t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(escaped, pa.bool_())], ["conv_id", "turn", "role", "text", "escaped"])

    def rows(found: list[Digest], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*(d.row() for d in found)))
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None
        for batch in batches:
            done, kind = [], batch.column(0).type
            for conv_id, role, text, escaped in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if now is None or now.conv_id != conv_id:
                    done += [now] if now else []
                    now = Digest(conv_id)
                now.add(render_turn(role, text, escaped))
            if done:
                yield rows(done, kind)
        if now:
            yield rows([now], kind)

    kind, turn = id_type(conversations, "conv_id"), id_type(conversations, "turn")
    ready = map_batches(turns_of(conversations), decide, f"conv_id {kind}, turn {turn}, role string, text string, escaped boolean")
    ordered = ready.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_batches(ordered, run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def formatted(conversations: DataFrame, output: str = "digests") -> DataFrame:
    """Format whole conversations (conv_id, turn, role, text).

    output "text": conv_id, formatted, turns (role, text, start, end: read back from it), loss_spans (start
    and end of the assistant's texts in it); here a conversation is one value and held whole by its task.
    "digests": conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from what the parser
    reads back; conversations may be of any size. Turns are in order of turn (nulls first), then role and text.
    Null texts and roles are empty; repeated rows are turns of their own; rows with a null conv_id form one
    conversation; other columns are ignored; an empty table gives an empty table.
    """
    if output == "digests":
        return digests(conversations)
    if output != "text":
        raise ValueError(f"unknown output {output}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        turn = pa.struct([("role", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            found = [format_conversation([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
            columns = [
                pa.array([x[0] for x in found], pa.string()),
                pa.array([[vars(t) for t in x[1]] for x in found], pa.list_(turn)),
                pa.array([[{"start": t.start, "end": t.end} for t in x[1] if t.role == "assistant"] for x in found], pa.list_(span)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["conv_id", "formatted", "turns", "loss_spans"])

    schema = "formatted string, turns array<struct<role:string,text:string,start:int,end:int>>, loss_spans array<struct<start:int,end:int>>"
    return map_batches(grouped(conversations), run, f"conv_id {id_type(conversations, 'conv_id')}, {schema}")
