"""Operator 11: chat formatting with typed content parts.

A message is a row with a role and content parts: structs of ``kind`` (text, image, audio, document), ``text``,
``ref`` (where an attachment lies) and its measures ``width``, ``height``, ``seconds``, ``pages``. A visitor flattens
the parts in order: text is escaped, any other part becomes a placeholder, and its reference, its place and the
number of tokens that it will expand to are recorded. The template is

    <|im_start|>role, a line feed, content, <|im_end|>, a line feed

Control strings begin with ``<|``. Inside roles and texts each ``<``, any backslashes and ``|`` get one more backslash,
so that no control string is left there; removing one undoes it. Line feeds and backslashes of roles are escaped too.
The loss mask covers the escaped texts of the assistant's messages and nothing else.

Messages are dealt by conversation and sorted by turn; a task streams through them and holds one chunk. A
conversation is one row, or several consecutive ones if its formatted text is longer than ``chunk_chars``: chunks
end between messages, ``start`` is a chunk's offset in the conversation, and ``last`` marks the final one. So a
conversation of any length is written whole in bounded memory.

Null texts, null roles and null or empty part lists count as empty; a part of null kind is text; a part of another
kind is a ``file`` of no tokens; missing measures count as one unit. A null conversation id is a conversation of its
own. Turns that repeat or are null are kept, nulls first, ordered by role and the text of the parts. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigfield.runtime import ship

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = "<|{}|>"

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_SLOT = re.compile(r"<\|(?:image|audio|document|file)\|>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Expansion:
    """How many tokens an attachment stands for."""

    patch: int = 28
    audio_per_second: float = 25.0
    page: int = 256


@dataclass
class Flattener:
    """Visits the parts of one message in order."""

    rules: Expansion
    out: list[str] = field(default_factory=list)
    length: int = 0
    texts: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part["kind"] or "text"
        getattr(self, f"visit_{kind}" if kind in ("text", "image", "audio", "document") else "visit_file")(part)

    def visit_text(self, part: dict) -> None:
        shown = escape(part["text"] or "")
        if shown:
            self.texts.append((self.length, self.length + len(shown)))
            self._put(shown)

    def visit_image(self, part: dict) -> None:
        side = lambda n: max(1, math.ceil((n or 0) / self.rules.patch))
        self._attach("image", part, side(part["width"]) * side(part["height"]))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part["seconds"] or 0) * self.rules.audio_per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part["pages"] or 0) * self.rules.page)

    def visit_file(self, part: dict) -> None:
        self._attach("file", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part["ref"], "at": self.length, "n_tokens": tokens})
        self._put(PLACEHOLDER.format(kind))

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)


_SPANS = "array<struct<start:bigint,end:bigint>>"
_ATTACHED = "array<struct<kind:string,ref:string,at:bigint,n_tokens:bigint>>"


@dataclass
class _Chunk:
    key: object
    number: int = 0
    start: int = 0
    length: int = 0
    out: list[str] = field(default_factory=list)
    loss: list[dict] = field(default_factory=list)
    attached: list[dict] = field(default_factory=list)

    def add(self, role: str, parts: list[dict], rules: Expansion) -> None:
        head = f"{START}{escape_role(role)}\n"
        seen = Flattener(rules)
        for part in parts:
            seen.visit(part)
        base = self.length + len(head)
        if role == "assistant":
            self.loss += [{"start": base + a, "end": base + b} for a, b in seen.texts]
        self.attached += [x | {"at": base + x["at"]} for x in seen.attachments]
        self.out += [head, *seen.out, END, "\n"]
        self.length = base + seen.length + len(END) + 1

    def row(self, last: bool) -> dict:
        return {"conv_id": self.key, "chunk": self.number, "last": last, "start": self.start, "text": "".join(self.out), "loss": self.loss, "attachments": self.attached}

    def next(self) -> _Chunk:
        return _Chunk(self.key, self.number + 1, self.start + self.length)


def as_parts(text: Column) -> Column:
    """One text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), *(F.lit(None).alias(x) for x in ("ref", "width", "height", "seconds", "pages")))).cast(PARTS)


def format_chat(messages: DataFrame, rules: Expansion | None = None, chunk_chars: int = 1 << 20, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """Rows of (conv_id, chunk, last, start, text, loss spans, attachments); spans and places are code points
    of the chunk's text."""
    ship(messages.sparkSession)
    rules = rules or Expansion()
    parts = F.filter(F.coalesce(F.col(parts_col).cast(PARTS), F.array().cast(PARTS)), lambda x: x.isNotNull())
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts").select("conv_id", "role", "parts")
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T._parse_datatype_string(f"chunk int, last boolean, start bigint, text string, loss {_SPANS}, attachments {_ATTACHED}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, chunk, done, size = None, None, [], 0
        for b in batches:
            if shape is None:
                shape = pa.schema([b.schema.field("conv_id"), ("chunk", pa.int32()), ("last", pa.bool_()), ("start", pa.int64()), ("text", pa.string()), ("loss", _arrow(_SPANS_ARROW)), ("attachments", _arrow(_ATTACHED_ARROW))])
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                for key, role, content in zip(*(piece.column(k).to_pylist() for k in range(3))):
                    if chunk is not None and (key != chunk.key or chunk.length >= chunk_chars):
                        done.append(chunk.row(key != chunk.key))
                        size += chunk.length
                        chunk = chunk.next() if key == chunk.key else None
                    if size >= chunk_chars:
                        yield pa.RecordBatch.from_pylist(done, shape)
                        done, size = [], 0
                    chunk = chunk or _Chunk(key)
                    chunk.add(role, content, rules)
        if chunk is not None:
            yield pa.RecordBatch.from_pylist([*done, chunk.row(True)], shape)

    return dealt.mapInArrow(run, schema)


_SPANS_ARROW = [("start", pa.int64()), ("end", pa.int64())]
_ATTACHED_ARROW = [("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("n_tokens", pa.int64())]


def _arrow(fields: list[tuple]) -> pa.DataType:
    return pa.list_(pa.struct(fields))


def read_turns(chunk: str) -> list[tuple[str, str]]:
    """Roles and contents of formatted text; contents are still escaped, with placeholders."""
    return [(unescape_role(r), c) for r, c in _TURN.findall(chunk)]


def text_parts(content: str) -> str:
    """The text of a formatted content, without its placeholders."""
    return "".join(map(unescape, _SLOT.split(content)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of consecutive chunks, one conversation at a time."""
    out: list[tuple] = []
    shape, state = None, None
    for b in batches:
        shape = shape or pa.schema([b.schema.field("conv_id"), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("attached_tokens", pa.int64())])
        for at in range(0, b.num_rows, 256):
            piece = b.slice(at, 256)
            for key, number, last, text, loss, attached in zip(*(piece.column(x).to_pylist() for x in ("conv_id", "chunk", "last", "text", "loss", "attachments"))):
                if number == 0:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, content in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{text_parts(content)}\n".encode())
                for x in loss:
                    said = unescape(text[x["start"] : x["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] += sum(x["n_tokens"] for x in attached)
                if last:
                    out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)
            out = []


def read_chat(chunks: DataFrame) -> DataFrame:
    """Per conversation, from formatted chunks alone: turns and their digest, the text under the loss mask and
    its digest, code points of the formatted text and tokens of attachments. Only conversations of several
    chunks are dealt anew."""
    ship(chunks.sparkSession)
    needed = chunks.select("conv_id", "chunk", "last", "text", "loss", "attachments")
    whole = (F.col("chunk") == 0) & F.col("last")
    rest = needed.where(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    kind = [T.StructField("conv_id", chunks.schema["conv_id"].dataType), *T._parse_datatype_string("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, attached_tokens bigint").fields]
    return needed.where(whole).mapInArrow(_read, T.StructType(kind)).union(rest.mapInArrow(_read, T.StructType(kind)))
