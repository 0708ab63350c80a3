r"""Chat formatting with typed content parts.

A turn is written ``<|turn|>role<|text|>body<|end|>``.  Inside roles and texts ``\`` becomes ``\\`` and ``<|``
becomes ``<\|``, so that no text can hold a mark, and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, BODY, STOP = "<|turn|>", "<|text|>", "<|end|>"
#: Placeholders of attachments; a text cannot hold them unescaped.
PLACES = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens that a placeholder expands to: for an image a patch of so many pixels a side, for audio so many
#: milliseconds, for a document so many a page.
PATCH, AUDIO_MS, PAGE_TOKENS = 28, 40, 512
PART = "struct<type:string,text:string,uri:string,width:int,height:int,duration_ms:bigint,pages:int>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Flattener:
    """Visitor over the parts of one turn: text is escaped, other parts become placeholders in order.

    Texts side by side are escaped as one, since a mark may begin in one part and end in the next.

    ``attachments`` records each part's type, reference and place in the flat text (code points), ``tokens``
    what the placeholders expand to.  A part of unknown or null type is visited as text; null measures count
    as one patch, frame or page.
    """

    def __init__(self) -> None:
        self.flat: list[str] = []
        self.open: list[str] = []
        self.length = 0
        self.attachments: list[dict] = []
        self.tokens = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.open.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        across, down = (-(-max(1, part.get(side) or 1) // PATCH) for side in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, -(-max(1, part.get("duration_ms") or 1) // AUDIO_MS))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * PAGE_TOKENS)

    def close(self) -> None:
        """Write the texts since the last placeholder."""
        self._add(escape("".join(self.open)))
        self.open.clear()

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.close()
        self.attachments.append({"type": kind, "uri": part.get("uri"), "at": self.length, "tokens": tokens})
        self.tokens += tokens
        self._add(PLACES[kind])

    def _add(self, text: str) -> None:
        self.flat.append(text)
        self.length += len(text)


def render(turns: list[tuple[str, list[dict]]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]], list[dict], int]:
    """Formatted string, loss spans (start, end in code points), attachments and expanded tokens."""
    out: list[str] = []
    at, spans, attachments, tokens = 0, [], [], 0
    for role, parts in turns:
        visitor = Flattener()
        for part in parts:
            visitor.visit(part)
        visitor.close()
        head = f"{TURN}{escape(role)}{BODY}"
        start = at + len(head)
        if role == learn:
            spans.append((start, start + visitor.length))
        attachments += [a | {"at": a["at"] + start} for a in visitor.attachments]
        tokens += visitor.tokens
        out += [head, *visitor.flat, STOP]
        at = start + visitor.length + len(STOP)
    return "".join(out), spans, attachments, tokens


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; placeholders stay as they are."""
    found = []
    for turn in formatted.split(TURN)[1:]:
        role, _, body = turn.partition(BODY)
        found.append((unescape(role), unescape(body[: -len(STOP)])))
    return found


OUT = "conv_id long, n_turns long, formatted string, loss array<struct<start:bigint,end:bigint>>, attachments array<struct<type:string,uri:string,at:bigint,tokens:bigint>>, attachment_tokens long"


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id, n_turns, formatted, loss, attachments, attachment_tokens``.

    ``turns`` has ``conv_id, turn, role, parts`` (an array of ``PART``).  Turns come in order of ``turn``, then
    role and parts; null turns come first and a null conv_id is a conversation of its own.  Null roles and
    texts count as empty, null parts as none, and repeated rows stay.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.col("parts").cast(f"array<{PART}>").alias("parts")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for conv, turns in zip(batch.column(0), batch.column(1), strict=True):
                turns = turns.as_py()
                text, spans, attachments, tokens = render([(t["role"], [p for p in t["parts"] or [] if p]) for t in turns])
                made.append({"conv_id": conv.as_py(), "n_turns": len(turns), "formatted": text, "loss": [{"start": a, "end": b} for a, b in spans], "attachments": attachments, "attachment_tokens": tokens})
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)

    place = pa.struct([("type", pa.string()), ("uri", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("attachments", pa.list_(place)), ("attachment_tokens", pa.int64())])
    return whole.mapInArrow(run, OUT)


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted strings back gives, as counts and SHA-256 digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                text = row["formatted"]
                turns = read_back(text)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in row["loss"])
                made.append({"conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": _sha(whole), "loss_chars": len(learned), "loss_sha256": _sha(learned), "formatted_chars": len(text)})
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
