r"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation (a sequence of turns):

    turn      := assistant | other
    assistant := "<s>" name "\n" text "</s>"
    other     := "[INST]" name "\n" text "[/INST]"

A control string is ``<s>``, ``</s>``, ``[INST]`` or ``[/INST]``, or one of these
with backslashes after its first character.  Escaping adds one backslash to each
control string inside a text, unescaping takes one away, so it is reversible for
every text.  Texts are first rendered as they are; the parser reads the result
back, and every turn that doesn't come back equal, or whose text holds a control
string of any kind, is escaped and parsed again, so no raw control string is left
inside a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONTROL = re.compile(r"([<\[])(\\*)(/?)(s>|INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?)(s>|INST\])")
_TURN = re.compile(r"(<s>|\[INST\])")
LOSS_ROLE = "assistant"
FORMATTED = "conv_id long, position long, segment string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3\4", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3\4", text)


def _name(role: str | None) -> str:
    """A role on one line; null is told from the empty role."""
    return "\\0" if role is None else escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(name: str) -> str | None:
    if name == "\\0":
        return None
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name))


def render_turn(role: str | None, text: str) -> tuple[str, int, int]:
    """The turn and the bounds of its text, in code points."""
    head, tail = ("<s>", "</s>") if role == LOSS_ROLE else ("[INST]", "[/INST]")
    head += _name(role) + "\n"
    return head + text + tail, len(head), len(head) + len(text)


def parse(formatted: str) -> list[tuple[str | None, str, int, int]] | None:
    """(role, text, bounds of the text) of each turn; None if it is no sentence."""
    turns, at = [], 0
    while at < len(formatted):
        opened = _TURN.match(formatted, at)
        line = formatted.find("\n", at)
        if not opened or line < 0:
            return None
        end = formatted.find("</s>" if opened[1] == "<s>" else "[/INST]", line + 1)
        if end < 0:
            return None
        role = _role(formatted[opened.end() : line])
        if (role == LOSS_ROLE) != (opened[1] == "<s>"):
            return None
        turns.append((role, unescape(formatted[line + 1 : end]), line + 1, end))
        at = end + (4 if opened[1] == "<s>" else 7)
    return turns


def round_trip(role: str | None, text: str) -> tuple[str, int, int]:
    """Render a turn, parse it, and escape until it comes back identical."""
    for shown in (text, escape(text)):
        segment, start, end = render_turn(role, shown)
        back = parse(segment)
        raw = shown is text and _CONTROL.search(text) is not None
        if not raw and back is not None and len(back) == 1 and back[0][:2] == (role, text):
            return segment, start, end
    raise ValueError("a turn does not survive its escaped form")


def _render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns in order to formatted segments; a batch's turns are also parsed together."""
    conv, at = object(), 0
    for batch in batches:
        rows, run = [], []
        for conv_id, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
            conv_id = None if pd.isna(conv_id) else int(conv_id)
            if conv_id != conv:
                _verify(run)
                conv, at, run = conv_id, 0, []
            segment, start, end = round_trip(role, text or "")
            loss = role == LOSS_ROLE
            rows.append((conv_id, at, segment, start if loss else None, end if loss else None))
            run.append((role, text or "", segment))
            at += 1
        _verify(run)
        out = pd.DataFrame(rows, columns=["conv_id", "position", "segment", "loss_start", "loss_end"])
        yield out.astype({"conv_id": "Int64", "loss_start": "Int64", "loss_end": "Int64"})


def _verify(run: list[tuple[str | None, str, str]]) -> None:
    """Turns side by side must parse to the same turns as one by one."""
    if run and [x[:2] for x in parse("".join(s for *_, s in run)) or ()] != [(r, t) for r, t, _ in run]:
        raise ValueError("neighbouring turns do not parse back")


def format_conversations(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """Formatted segments of each conversation, in turn order.

    One row for each turn: ``segment`` and, for assistant turns, the bounds of
    the text that is under the loss mask (code points in the segment).  The
    segments of a conversation follow each other in one partition; joined they
    are its formatted text.  A conversation of any length streams through: no
    task holds more than a batch of turns.

    Null text is empty, null roles come back as null, a null conv_id is one
    conversation, null turns come last, repeated rows and equal turns are all kept
    (ordered by role and text), an empty table gives no rows, further columns are
    ignored.
    """
    kept = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = kept.repartition("conv_id") if partitions is None else kept.repartition(partitions, "conv_id")
    order = dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), "role", "text")
    return order.select("conv_id", "role", "text").mapInPandas(_render, FORMATTED)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Read formatted segments back; running digests, one row for each conversation."""
    conv, state, out = object(), None, []

    def close() -> None:
        if state is not None:
            out.append((conv, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

    for batch in batches:
        for conv_id, position, segment, start, end in zip(batch["conv_id"], batch["position"], batch["segment"], batch["loss_start"], batch["loss_end"], strict=True):
            conv_id = None if pd.isna(conv_id) else int(conv_id)
            if conv_id != conv:
                close()
                conv, state = conv_id, {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
            if position != state["n"]:
                raise ValueError("the segments of a conversation are not in order")
            for role, text, *_ in parse(segment):
                state["n"] += 1
                state["turns"].update(f"{role or ''}\n{text}\n".encode("utf-8", "surrogatepass"))
            if not pd.isna(start):
                masked = unescape(segment[int(start) : int(end)])
                state["loss_chars"] += len(masked)
                state["loss"].update(masked.encode("utf-8", "surrogatepass"))
            state["chars"] += len(segment)
        yield _rows(out)
        out.clear()
    close()
    yield _rows(out)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[c.split()[0] for c in DIGESTS.split(", ")]).astype({"conv_id": "Int64"})


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from ``format_conversations``.

    Takes its output as it is: the segments of a conversation in order in one
    partition; segments that are out of order or missing are an error.
    """
    return formatted.mapInPandas(_digest, DIGESTS)


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
s AS (
  SELECT *, coalesce(role = 'assistant', false) AS loss,
         regexp_replace(text, '([<\[])(\\*)(/?)(s>|INST\])', '\1\2\\\3\4', 'g') AS shown
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (loss), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (loss), '')) AS loss_sha256,
       sum(length(shown) + length(coalesce(role, '..')) + CASE WHEN loss THEN 8 ELSE 14 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
