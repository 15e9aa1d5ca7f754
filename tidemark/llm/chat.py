"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. A visitor flattens them in order: text is escaped, an image, audio or document
part becomes a placeholder. For each attachment it records the reference, the placeholder's place and the tokens the
placeholder expands to. Turns are formatted one by one; the running length along a conversation places them, and the
formatted turns of a conversation are joined in order. The loss mask holds the text parts of assistant turns.

Template: ``<|im_start|>`` role ``<|sep|>`` content ``<|im_end|>``. Inside texts and roles ``\\``, ``<`` and
``[`` are written as a backslash and a letter, so no control string (``<|im_end|>``, ``</s>``, ``[INST]`` ...) is left in
them, also not across two parts, and reading the pairs back restores the text.

Cases: a null text or part list is an empty text; a null role is empty; turns are ordered by turn (null first), then role
and content; repeated turns are kept; rows with a null conversation id form one conversation; an unknown part type becomes
a document placeholder; an empty table gives no rows. Input columns other than those named are not carried.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The template's control strings, and what stands for their first characters inside a text.
START, SEP, STOP = "<|im_start|>", "<|sep|>", "<|im_end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
TURN = re.compile(r"<\|im_start\|>(.*?)<\|sep\|>(.*?)<\|im_end\|>", re.DOTALL)

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
FLAT = (
    "struct<segment: string, loss: array<struct<start: long, end: long>>,"
    " attachments: array<struct<kind: string, ref: string, start: long, tokens: long>>>"
)


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: ESCAPES[m.group()], text)


def unescape(text: str) -> str:
    plain = {v: k for k, v in ESCAPES.items()}
    return re.sub(r"\\[\\lb]", lambda m: plain[m.group()], text)


class Flattener:
    """Visits the parts of one turn in order."""

    def __init__(self, role: str, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 258):
        self.role, self.patch, self.audio_rate, self.page_tokens = role, patch, audio_rate, page_tokens
        self.pieces, self.length = [], 0
        self.loss: list[dict] = []
        self.attachments: list[dict] = []
        self.put(START + escape(role) + SEP)

    def put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        start = self.length
        self.put(escape(part["text"] or ""))
        if self.role == "assistant" and self.length > start:
            self.loss.append({"start": start, "end": self.length})

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.ceil((part["width"] or 0) / self.patch) * math.ceil((part["height"] or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part["seconds"] or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part["pages"] or 0) * self.page_tokens)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part["ref"], "start": self.length, "tokens": tokens})
        self.put(PLACEHOLDER[kind])

    def done(self) -> dict:
        self.put(STOP)
        return {"segment": "".join(self.pieces), "loss": self.loss, "attachments": self.attachments}


def _flattened(roles: pa.Array, parts: pa.Array) -> pa.Array:
    out = []
    for role, turn in zip(roles.to_pylist(), parts.to_pylist(), strict=True):
        visitor = Flattener(role or "")
        for part in turn or []:
            visitor.visit(part)
        out.append(visitor.done())
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    item = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())])
    return pa.array(out, pa.struct([("segment", pa.string()), ("loss", pa.list_(span)), ("attachments", pa.list_(item))]))


def text_part(text: Column) -> Column:
    """A content of one text part."""
    rest = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *rest))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans`` (start, end), ``attachments``
    (kind, ref, start, tokens) and ``expanded_tokens``; places are code points of ``formatted``.

    A conversation is one output row, so its turns meet in one task in the end; they are formatted before they meet.
    """
    parts = F.col(parts_col) if parts_col else text_part(F.col(text_col))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts")
    ).withColumn("flat", F.arrow_udf(_flattened, FLAT)("role", "parts"))
    along = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "flat.segment")
    size = F.char_length("flat.segment").cast("long")
    placed = rows.select(
        "conv_id", "flat", (F.sum(size).over(along.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("at")
    )
    moved = placed.select(
        "conv_id",
        F.struct(
            "at",
            F.col("flat.segment").alias("segment"),
            F.transform("flat.loss", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["end"] + F.col("at")).alias("end"))).alias("loss"),
            F.transform(
                "flat.attachments",
                lambda a: F.struct(a["kind"].alias("kind"), a["ref"].alias("ref"), (a["start"] + F.col("at")).alias("start"), a["tokens"].alias("tokens")),
            ).alias("attachments"),
        ).alias("s"),
    )
    joined = moved.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    out = joined.select(
        "conv_id",
        F.array_join("s.segment", "").alias("formatted"),
        F.flatten("s.loss").alias("loss_spans"),
        F.flatten("s.attachments").alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    return out.withColumn("expanded_tokens", tokens)


READ = "struct<n_turns: long, turns_sha256: string, loss_chars: long, loss_sha256: string>"


def read_back(formatted: Column, loss_spans: Column) -> Column:
    """What a reader of the output finds: the turns it holds, and the text under the loss mask."""
    return F.arrow_udf(_read_back, READ)(formatted, loss_spans)


def _read_back(formatted: pa.Array, loss_spans: pa.Array) -> pa.Array:
    out = []
    for text, mask in zip(formatted.to_pylist(), loss_spans.to_pylist(), strict=True):
        turns, at = [], 0
        while found := TURN.match(text, at):
            turns.append(found.groups())
            at = found.end()
        if at != len(text):
            raise ValueError(f"not a turn at {at}")
        whole = "".join(f"{unescape(role)}\n{unescape(body)}\n" for role, body in turns)
        learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in mask)
        out.append(
            {
                "n_turns": len(turns),
                "turns_sha256": sha256(whole.encode()).hexdigest(),
                "loss_chars": len(learnt),
                "loss_sha256": sha256(learnt.encode()).hexdigest(),
            }
        )
    kind = pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())])
    return pa.array(out, kind)
