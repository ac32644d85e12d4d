"""Chat formatting with a grammar round trip: rendered turns are parsed back and escaped until they agree."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The template. A turn is  OPEN role SEP text CLOSE ; a backslash makes the next character plain.
OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
CONTROL = ("### ", "</turn>")
TURN = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("escaped", pa.bool_())])
DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class Conflict(ValueError):
    """The text is no sequence of turns of the grammar."""


def _plain(text: str, at: int, stop: str, taboo: tuple[str, ...]) -> tuple[str, int]:
    """Unescaped text from ``at`` to the next ``stop``, and the place after it."""
    out = []
    while at < len(text):
        mark = min((p for p in (text.find(s, at) for s in ("\\", stop, *taboo)) if p >= 0), default=-1)
        if mark < 0:
            break
        out.append(text[at:mark])
        if text[mark] == "\\":
            if mark + 1 == len(text):
                break
            out.append(text[mark + 1])
            at = mark + 2
        elif text.startswith(stop, mark):
            return "".join(out), mark + len(stop)
        else:
            raise Conflict(f"control string inside a text at {mark}")
    raise Conflict("turn without end")


def parse(text: str) -> list[tuple[str, str]]:
    """Turns (role, text) of a formatted conversation; ``Conflict`` if it doesn't follow the grammar."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise Conflict(f"no turn begins at {at}")
        role, at = _plain(text, at + len(OPEN), SEP, (CLOSE,))
        body, at = _plain(text, at, CLOSE, CONTROL)
        turns.append((role, body))
    return turns


def _escape(text: str, control: tuple[str, ...] = CONTROL) -> str:
    text = text.replace("\\", "\\\\")
    for c in control:
        text = text.replace(c, "\\" + c)
    return text


def render_turn(role: str, text: str) -> tuple[str, bool]:
    """The formatted turn, and whether it had to be escaped: plain first, then text, then role and text."""
    for r, t, escaped in ((role, text, False), (role, _escape(text), True), (_escape(role, (SEP, CLOSE)), _escape(text), True)):
        out = OPEN + r + SEP + t + CLOSE
        try:
            if parse(out) == [(role, text)]:
                return out, escaped
        except Conflict:
            pass
    raise Conflict(f"turn of role {role!r} has no form that reads back")


def _render(batches):
    for b in batches:
        made = [render_turn(r or "", t or "") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
        roles = [r or "" for r in b.column("role").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(roles, pa.string()),
                                          pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.bool_())], schema=TURN)


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, escaped) per row; a conversation is its turns' ``formatted`` in order.

    Null roles and texts are empty. A turn is verified alone: the grammar puts every turn between its own
    marks, so turns that read back one by one also do so in a row.
    """
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(
        _render, "conv_id bigint, turn bigint, role string, formatted string, escaped boolean")


def _digest(batches):
    """Fold rows sorted by conversation; only one conversation's running hashes are held."""
    state, conv, done = None, None, []

    def close():
        n, turns, chars, loss, size = state
        done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    for b in batches:
        for c, text in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist()):
            if state is None or c != conv:
                if state is not None:
                    close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
                if role == "assistant":
                    state[2] += len(body)
                    state[3].update(body.encode())
            state[4] += len(text)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), DIGEST)], schema=DIGEST)
            done = []
    if state is not None:
        close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), DIGEST)], schema=DIGEST)


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of every conversation, recovered from the formatted text alone.

    Turns go in order of turn, then role, then text, nulls first; repeated rows all count. A digest
    needs the turns of one conversation in order, so they stream through one task, without being gathered.
    """
    # a repeated turn number is ordered by the formatted text, which starts with the role
    ordered = turns.select("conv_id", "turn", "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted").mapInArrow(
        _digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
