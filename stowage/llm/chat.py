"""Chat formatting of typed content parts.

A message is a list of parts: text, image, audio or document. A visitor flattens them in order. Text is escaped, so
that no text can look like a control string; any other part becomes a numbered placeholder, its reference is
recorded with the placeholder's place, and the tokens it will expand to are counted.

Every turn is formatted on its own, so a conversation of any length is spread over tasks. Only its digests need the
turns in order, and a task that reads them back keeps no more than the running state.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.batches import column, slices

START, STOP = "### ", "</turn>\n"
CONTROL = re.compile(r"\\|###|</turn>|<\|")
ESCAPED = re.compile(r"\\(\\|###|</turn>|<\||n)")
LEARNED_ROLE = "assistant"
PART = "struct<type:string,text:string,ref:string,amount:double>"


def escape(text: str) -> str:
    """``text`` with a backslash before each control string and each backslash."""
    return CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role).replace("\n", "\\n")


@dataclass(frozen=True)
class TokenCosts:
    """How many tokens a part expands to; ``amount`` is pixels, seconds or pages."""

    pixels_per_token: float = 784.0
    least_image: int = 4
    tokens_per_second: float = 25.0
    tokens_per_page: float = 1024.0


@dataclass
class Flattener:
    """Visits the parts of one message in order."""

    costs: TokenCosts = field(default_factory=TokenCosts)
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def visit(self, part: dict) -> None:
        """Dispatch on the part's type; a null type is text, an unknown one an error."""
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown content part {kind!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self._put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tokens = max(self.costs.least_image, math.ceil((part.get("amount") or 0) / self.costs.pixels_per_token))
        self._attach("image", part, tokens)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("amount") or 0) * self.costs.tokens_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, math.ceil((part.get("amount") or 0) * self.costs.tokens_per_page))

    def _put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        placeholder = f"<|{kind}:{len(self.attachments)}|>"
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "place": self.length, "tokens": tokens})
        self._put(placeholder)


ATTACHMENT = "struct<kind:string,ref:string,place:bigint,tokens:bigint>"
FORMATTED = f"formatted string, loss_start bigint, loss_end bigint, attachments array<{ATTACHMENT}>, expanded_tokens bigint"


def format_turn(role: str | None, parts: list[dict] | None, costs: TokenCosts) -> tuple:
    """``(formatted, loss_start, loss_end, attachments, expanded_tokens)``; the loss lies on an assistant's content."""
    flat = Flattener(costs)
    for part in parts or []:
        flat.visit(part)
    head, content = f"{START}{escape_role(role or '')}:\n", "".join(flat.pieces)
    learned = role == LEARNED_ROLE
    tokens = sum(a["tokens"] for a in flat.attachments)
    return (head + content + STOP, len(head) if learned else None, len(head) + len(content) if learned else None, flat.attachments, tokens)


def format_turns(turns: DataFrame, costs: TokenCosts | None = None) -> DataFrame:
    """``turns(conv_id, turn, role, parts)`` formatted: ``(conv_id, turn, formatted, loss_start, loss_end, ...)``.

    A conversation's text is its rows' ``formatted`` in order of turn; the loss mask covers the code points from
    ``loss_start`` up to ``loss_end`` of a row, for assistants alone. Rows are range-sorted by conversation and turn, so that
    one huge conversation is spread over tasks. A null role or text is empty, null parts are no parts, and a null
    ``conv_id`` is a conversation of its own. Rows with equal turns are ordered by their formatted text, null turns come
    first. Other columns are dropped. An empty input gives no rows; a part of unknown type is an error.
    """
    costs = costs or TokenCosts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [format_turn(r, p, costs) for r, p in zip(column(batch, "role"), column(batch, "parts"), strict=True)]
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            attachment = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())])
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(attachment), pa.int64())
            arrays = [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            names = ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "parts")
    formatted = rows.mapInArrow(run, f"conv_id bigint, turn bigint, {FORMATTED}")
    return formatted.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "formatted")


def text_parts(conversations: DataFrame) -> DataFrame:
    """Rows whose message is one text, in the form that :func:`format_turns` takes."""
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount"))
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and content (placeholders left in) of a formatted turn; an error if it isn't exactly one turn."""
    head, colon, rest = formatted[len(START) :].partition(":\n")
    content = rest[: -len(STOP)]
    inside = ESCAPED.sub("\0", f"{head}\n{content}")
    if not (formatted.startswith(START) and colon and rest.endswith(STOP)) or "###" in inside or "</turn>" in inside:
        raise ValueError(f"no single turn: {formatted[:80]!r}")
    return unescape(head), unescape(content)


@dataclass
class _Digest:
    """What is kept of a conversation while its turns pass by."""

    conv_id: int | None
    turns: int = 0
    chars: int = 0
    learned: int = 0
    whole: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        role, content = parse_turn(formatted)
        self.turns += 1
        self.chars += len(formatted)
        self.whole.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
        if start is not None:
            text = unescape(formatted[start:end])
            self.learned += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.whole.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation of :func:`format_turns`' output, read turn by turn in a stream.

    A task sorts its conversations and keeps one running digest, so no conversation is ever held as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in slices(batches, "formatted"):
            names = ("conv_id", "formatted", "loss_start", "loss_end")
            for conv_id, *rest in zip(*(column(batch, n) for n in names), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv_id)
                now.add(*rest)
            if len(done) >= 1000:
                yield _digest_batch(done)
                done = []
        if now is not None:
            yield _digest_batch([*done, now.row()])

    rows = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(run, DIGESTS)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = [f.split()[0] for f in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
