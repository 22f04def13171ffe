"""Chat formatting of typed content parts, and reading the result back.

A turn is ``### Role:`` and a line break, its body, ``</turn>`` and a line break. A visitor flattens the parts of a turn
in order: text is escaped, other parts become placeholders ``<|image:3|>`` numbered through the conversation, with
the reference and the number of tokens that each expands to recorded beside the text.

Inside texts a backslash is doubled, a ``#`` after a ``#`` and the sign after ``<`` in ``</`` and ``<|`` get a backslash
before them, also where one part ends and the next begins. So neither a marker nor a placeholder can appear in a body,
and dropping each backslash that stands before a character gives the text back.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Roles as the template writes them; any other is marked with @ and percent-encoded.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
LEARNT = "assistant"
#: Code points after which a long conversation goes on in another row.
CHUNK = 1 << 20
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512

_ESCAPE = re.compile(r"\\|(?<=#)#|(?<=<)[/|]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ([^:\n]*):\n(.*?)</turn>\n", re.S)
_PLACE = re.compile(r"<\|(image|audio|document|other):([0-9]+)\|>")


def escape(text: str, before: str = "") -> str:
    """``before``: the character that the text follows, which decides about its first one."""
    every = _ESCAPE.sub(lambda m: "\\" + m[0], before + text)
    return every[1 + (before == "\\") :] if before else every


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def role_mark(role: str) -> str:
    return ROLES.get(role) or "@" + quote(role, safe=" ")


def role_of(mark: str) -> str:
    return unquote(mark[1:]) if mark[:1] == "@" else {v: k for k, v in ROLES.items()}[mark]


class Flattener:
    """Visits the parts of a conversation in order and collects text, learnt spans and attachments of a chunk."""

    def __init__(self):
        self.seen = 0
        self.start_chunk()

    def start_chunk(self) -> None:
        self.out, self.size, self.turns, self.loss, self.attachments = [], 0, 0, [], []

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def turn(self, role: str, parts: list[dict]) -> None:
        self._put(f"### {role_mark(role)}:\n")
        self.before = ""
        for part in parts:
            start, kind = self.size, str(part.get("type") or "text")
            getattr(self, f"visit_{kind}" if kind in VISITED else "visit_other")(part)
            if role == LEARNT and kind == "text" and self.size > start:
                self.loss.append((start, self.size))
        self._put("</turn>\n")
        self.turns += 1

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        text = "" if text is None else writable(text) if isinstance(text, str) else json.dumps(text)
        self._put(escape(text, self.before))
        self.before = text[-1:] or self.before

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil(max(1, number(part, "width")) / IMAGE_PATCH) * math.ceil(max(1, number(part, "height")) / IMAGE_PATCH)
        self._attach("image", part, tiles)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(max(0, number(part, "seconds")) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, PAGE_TOKENS * int(max(1, number(part, "pages"))))

    def visit_other(self, part: dict) -> None:
        self._attach("other", {"ref": json.dumps(part, sort_keys=True)}, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.seen += 1
        self.attachments.append({"number": self.seen, "type": kind, "ref": writable(str(part.get("ref") or "")), "tokens": min(int(tokens), MOST_TOKENS), "at": self.size})
        self._put(f"<|{kind}:{self.seen}|>")
        self.before = ""


#: Types with a visitor of their own; all others are attachments of type other.
VISITED = ("text", "image", "audio", "document")
MOST_TOKENS = (1 << 63) - 1


def writable(text: str) -> str:
    """With a question mark for each half of a surrogate pair that JSON escapes left alone."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def number(part: dict, name: str) -> float:
    """The field as a number; zero where it is none."""
    found = part.get(name)
    return found if isinstance(found, (int, float)) and math.isfinite(found) else 0


def parts_of(written: str) -> list[dict]:
    """Parts from JSON: a list, in which a string is a text part; anything else is one text part, as it is written."""
    try:
        found = json.loads(written)
    except ValueError:
        found = None
    if not isinstance(found, list):
        return [{"type": "text", "text": written}]
    return [x if isinstance(x, dict) else {"type": "text", "text": x} for x in found if x is not None]


def parse(text: str) -> list[tuple[str, list[tuple[str, str | int]]]]:
    """Turns of a formatted text: the role, and its parts as ("text", text) or (type, number)."""
    turns, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        parts, last, body = [], 0, found[2]
        for m in _PLACE.finditer(body):
            if m.start() > last:
                parts.append(("text", unescape(body[last : m.start()])))
            parts.append((m[1], int(m[2])))
            last = m.end()
        if last < len(body):
            parts.append(("text", unescape(body[last:])))
        turns.append((role_of(found[1]), parts))
        at = found.end()
    return turns


_PARTS = pa.list_(pa.struct([("number", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("at", pa.int64())]))
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FORMATTED = "conv_id long, chunk int, text string, n_turns long, loss array<struct<start:long,end:long>>, attachments array<struct<number:long,type:string,ref:string,tokens:long,at:long>>"


def format_conversations(rows: DataFrame, chunk: int = CHUNK, parts: str | None = None) -> DataFrame:
    """Conversations as text, from ``conv_id, turn, role`` and ``text``, or the column that ``parts`` names (a JSON list
    of typed parts; where it is null, the text counts).

    Returns ``conv_id, chunk, text, n_turns, loss, attachments``; spans count code points of the chunk. Turns come by
    ``turn``, then role, text. A conversation is one chunk unless it is longer than ``chunk``; it is then written in
    several, cut between turns, and never held whole: rows stream by in order. Null texts are empty, a null role is
    the empty role, null turns come first, rows without conv_id are one conversation; repeated rows are repeated
    turns. What is not a list is one text; a part of a type that is not known is an attachment of type other, its JSON
    the reference; a null type is text; numbers that are none count as zero; lone surrogates become question marks. Other columns are not read.
    """
    parts = F.lit(None).cast("string") if parts is None else F.col(parts).cast("string")
    text = F.col("text").cast("string") if "text" in rows.columns else F.lit(None).cast("string")
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), parts.alias("parts"))
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "parts")

    def run(batches):
        now, number, flat, ready = None, 0, None, []

        def close():
            nonlocal number
            ready.append((now, number, "".join(flat.out), flat.turns, [{"start": a, "end": b} for a, b in flat.loss], flat.attachments))
            number += 1
            flat.start_chunk()

        def emit():
            columns = list(zip(*ready))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), _LOSS, _PARTS)
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "chunk", "text", "n_turns", "loss", "attachments"])

        for batch in batches:
            for conv, role, text, parts in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if flat is None or conv != now:
                    if flat is not None and flat.turns:
                        close()
                    now, number, flat = conv, 0, Flattener()
                flat.turn(role, [{"type": "text", "text": text}] if parts is None else parts_of(parts))
                if flat.size >= chunk:
                    close()
            if ready:
                yield emit()
        if flat is not None and flat.turns:
            close()
        if ready:
            yield emit()

    return ordered.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from its formatted chunks alone: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``. Texts are hashed as they stream by."""
    ordered = formatted.select("conv_id", "chunk", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        begun, now, state, ready = False, None, None, []

        def fresh():
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        def close():
            ready.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def emit():
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*ready), kinds)]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for conv, text, loss in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if not begun or conv != now:
                    if begun:
                        close()
                    begun, now, state = True, conv, fresh()
                for role, parts in parse(text):
                    said = "".join(p for kind, p in parts if kind == "text")
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    learnt = unescape(text[span["start"] : span["end"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if ready:
                yield emit()
        if begun:
            close()
        if ready:
            yield emit()

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
