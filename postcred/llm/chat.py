"""Chat formatting with typed content parts.

A turn's content is a list of typed parts.  A visitor flattens it: text is escaped, images, audio and documents become
placeholders in their order, each with a record of its attachment reference and of the tokens it expands to.  Turns
are marked by control strings; inside texts and roles every control string (this template's and those of common others)
is broken by a backslash after its first character, and backslashes are doubled, so reading back gives the exact text.
The loss mask covers the assistant's text and nothing between.

Rows are dealt by ranges of (conversation, turn, role, text hash), so a conversation of any length spreads over many tasks; each
task streams its range and writes segments of about 1 MB, cut between turns.  A conversation that lies inside one task is read back
there; only the segments of conversations cut by a task border meet again, in order, one at a time.

Defined results: null texts and roles count as empty; null conversations form one conversation; null turns come first;
turns of equal number are ordered by role, then by the text's 64-bit hash; repeated rows are turns each.  Parts of an unknown or null
kind become ``attachment`` placeholders of no tokens; null parts are left out; missing sizes count as one patch, second or page.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
KINDS = ("image", "audio", "document", "attachment")
#: Control strings of other chat templates (fixed values); every ``<|`` counts as the start of one as well.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
TRAINED = "assistant"
SEGMENT_CHARS = 1 << 20

PARTS = "array<struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ATTACHMENT = pa.list_(pa.struct([("turn", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("at", pa.int64())]))

_BREAK = re.compile(r"\\|<(?=\||" + "|".join(re.escape(c[1:]) for c in FOREIGN if c[0] == "<") + r")|\[(?="
                    + "|".join(re.escape(c[1:]) for c in FOREIGN if c[0] == "[") + ")")
_BACK = re.compile(r"\\(\\?)")
_MARK = re.compile(r"<\|(im_start|im_sep|im_end|" + "|".join(KINDS) + r")\|>")


def escape(text: str) -> str:
    if "\\" not in text and "<" not in text and "[" not in text:
        return text
    return _BREAK.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


class PartVisitor:
    """Flattens typed parts; a subclass may price or accept further kinds by a ``visit_<kind>`` method."""

    def __init__(self, patch: int = 28, tokens_per_second: float = 25.0, tokens_per_page: int = 256):
        self.patch, self.tokens_per_second, self.tokens_per_page = patch, tokens_per_second, tokens_per_page

    def flatten(self, parts: list[dict]) -> tuple[list[tuple[str, bool]], list[tuple[str, str | None, int]]]:
        """Pieces (formatted text, is text) and attachments (kind, ref, tokens), both in order; neighbouring texts are one piece."""
        pieces: list[tuple[str, bool]] = []
        attached: list[tuple[str, str | None, int]] = []
        texts: list[str] = []
        for part in [p for p in parts if p is not None] + [None]:
            if part is not None and part.get("kind") == "text":
                texts.append(part.get("text") or "")
                continue
            if texts:  # together: a control string could run over the border of two parts
                pieces.append((escape("".join(texts)), True))
                texts = []
            if part is not None:
                kind = part.get("kind") if part.get("kind") in KINDS else "attachment"
                tokens = getattr(self, f"visit_{kind}")(part)
                pieces.append((f"<|{kind}|>", False))
                attached.append((kind, part.get("ref"), tokens))
        return pieces, attached

    def visit_image(self, part: dict) -> int:
        return math.prod(max(1, math.ceil((part.get(side) or 1) / self.patch)) for side in ("width", "height"))

    def visit_audio(self, part: dict) -> int:
        return max(1, math.ceil((part.get("seconds") or 1) * self.tokens_per_second))

    def visit_document(self, part: dict) -> int:
        return max(1, part.get("pages") or 1) * self.tokens_per_page

    def visit_attachment(self, part: dict) -> int:
        return 0


class Segment:
    """Formatted turns of one conversation under construction."""

    def __init__(self, conv, first_turn: int, opens: bool):
        self.conv, self.first_turn, self.opens = conv, first_turn, opens
        self.out, self.size, self.turns, self.spans, self.attached = [], 0, 0, [], []

    def add(self, role: str, parts: list[dict], visitor: PartVisitor) -> None:
        pieces, attached = visitor.flatten(parts)
        self._put(START + escape(role) + SEP)
        records = iter(attached)
        for piece, is_text in pieces:
            if not is_text:
                kind, ref, tokens = next(records)
                self.attached.append({"turn": self.first_turn + self.turns, "kind": kind, "ref": ref, "tokens": tokens, "at": self.size})
            elif role == TRAINED and piece:
                self.spans.append({"start": self.size, "end": self.size + len(piece)})
            self._put(piece)
        self._put(END)
        self.turns += 1

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)


def read_turns(formatted: str) -> list[tuple[str, str, list[str]]]:
    """(role, text, kinds of the placeholders) of each turn of a formatted string."""
    turns, at, role, texts, kinds = [], 0, "", [], []
    for m in _MARK.finditer(formatted):
        before, mark = formatted[at:m.start()], m.group(1)
        at = m.end()
        if mark == "im_start":
            texts, kinds = [], []
        elif mark == "im_sep":
            role = unescape(before)
        else:
            texts.append(unescape(before))
            if mark == "im_end":
                turns.append((role, "".join(texts), kinds))
            else:
                kinds.append(mark)
    return turns


def typed_parts(content: Column, kind: T.DataType) -> Column:
    """A content column as ``PARTS``: a string is one text part; fields that an array of structs lacks are null."""
    wanted = [f.split(":") for f in PARTS[len("array<struct<"):-2].split(",")]
    if isinstance(kind, T.ArrayType):
        has = set(kind.elementType.fieldNames())
        return F.transform(content, lambda p: F.when(p.isNotNull(), F.struct(*[
            (p[n] if n in has else F.lit(None)).cast(t).alias(n) for n, t in wanted])))
    only = {"kind": F.lit("text"), "text": content.cast("string")}
    return F.array(F.struct(*[only.get(n, F.lit(None)).cast(t).alias(n) for n, t in wanted]))


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                content_col: str = "text", visitor: PartVisitor | None = None, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Segments (conv, seq, opens, closes, formatted, n_turns, spans, attachments).

    Those of a conversation follow each other by ``seq``.  ``spans`` is the loss mask and ``attachments`` the records in
    order, both in code points from the segment's start.  ``opens`` and ``closes`` say whether the segment is known to be the
    conversation's first and last (the first and last of a task are not known to be).
    """
    visitor = visitor or PartVisitor()
    kind = messages.schema[conv_col].dataType.simpleString()
    rows = messages.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        typed_parts(F.col(f"`{content_col}`"), messages.schema[content_col].dataType).alias("parts"))
    rows = rows.withColumn("h", F.xxhash64("parts")).withColumn("row", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "h", "row"]  # the row number lets equal rows be dealt apart
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    only_text = not isinstance(messages.schema[content_col].dataType, T.ArrayType)
    rows = rows.select("conv", "role", F.coalesce(F.col("parts")[0]["text"], F.lit("")).alias("text") if only_text else "parts")

    def run(batches):
        from pyspark import TaskContext
        seq, held, kind_of = TaskContext.get().partitionId() << 32, 0, None
        done: list[tuple[Segment, bool]] = []
        now: Segment | None = None
        for b in batches:
            kind_of = b.schema.field(0).type
            contents = b.column(2).to_pylist()
            if only_text:
                contents = [[{"kind": "text", "text": t}] for t in contents]
            for conv, role, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), contents):
                whole = now is not None and now.conv != conv
                if now is None:
                    now = Segment(conv, 0, False)
                elif whole or now.size >= segment_chars:
                    done.append((now, whole))
                    held += now.size
                    now = Segment(conv, 0 if whole else now.first_turn + now.turns, whole)
                    if held >= segment_chars:
                        yield _segments(done, seq, kind_of)
                        seq, held, done = seq + len(done), 0, []
                now.add(role, parts or [], visitor)
        if now is not None:
            yield _segments(done + [(now, False)], seq, kind_of)
    return rows.mapInArrow(run, f"conv {kind}, seq long, opens boolean, closes boolean, formatted string, n_turns long, "
                                "spans array<struct<start:long,end:long>>, attachments array<struct<turn:long,kind:string,ref:string,tokens:long,at:long>>")


def _segments(done: list[tuple[Segment, bool]], first: int, conv_type: pa.DataType) -> pa.RecordBatch:
    cols = [pa.array([s.conv for s, _ in done], conv_type), pa.array(range(first, first + len(done)), pa.int64()),
            pa.array([s.opens for s, _ in done]), pa.array([c for _, c in done]), pa.array(["".join(s.out) for s, _ in done], pa.string()),
            pa.array([s.turns for s, _ in done], pa.int64()), pa.array([s.spans for s, _ in done], SPAN), pa.array([s.attached for s, _ in done], ATTACHMENT)]
    return pa.RecordBatch.from_arrays(cols, ["conv", "seq", "opens", "closes", "formatted", "n_turns", "spans", "attachments"])


class _Digest:
    """What one conversation's segments say, fed in order."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.attached = self.expanded = 0

    def feed(self, formatted: str, spans: list[dict], attachments: list[dict]) -> None:
        for role, text, _ in read_turns(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for s in spans:
            text = unescape(formatted[s["start"]:s["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)
        self.attached += len(attachments)
        self.expanded += sum(a["tokens"] for a in attachments)

    def row(self) -> tuple:
        return (self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attached, self.expanded)


FIGURES = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]
FIGURE_TYPES = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"
_FIGURE_ARROW = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, read from the formatted segments alone: turns, their digest, the text under the mask, sizes."""
    kind = segments.schema["conv"].dataType.simpleString()

    def here(batches):
        """A conversation in one segment is read where it lies; the others keep their segments."""
        for b in batches:
            convs, seqs = b.column(0), b.column(1)
            figures, rest = [], []
            for opens, closes, text, spans, attached in zip(*[b.column(i).to_pylist() for i in (2, 3, 4, 6, 7)]):
                if opens and closes:
                    d = _Digest(None)
                    d.feed(text, spans, attached)
                    figures.append(d.row())
                    rest.append((None, None, None))
                else:
                    figures.append((None,) * len(FIGURES))
                    rest.append((text, spans, attached))
            cols = [pa.array(c, t) for c, t in zip(zip(*figures), _FIGURE_ARROW)] if figures else [pa.array([], t) for t in _FIGURE_ARROW]
            more = [pa.array(list(c), t) for c, t in zip(zip(*rest), (pa.string(), SPAN, ATTACHMENT))] if rest else \
                [pa.array([], t) for t in (pa.string(), SPAN, ATTACHMENT)]
            yield pa.RecordBatch.from_arrays([convs, seqs, *cols, *more], ["conv", "seq", *FIGURES, "formatted", "spans", "attachments"])

    def chained(batches):
        now: _Digest | None = None
        conv_type = None
        for b in batches:
            out: list[tuple] = []
            conv_type = b.schema.field(0).type
            for i in range(b.num_rows):
                conv, n = b.column(0)[i].as_py(), b.column(2)[i].as_py()
                if n is not None:
                    out.append((conv, *[b.column(2 + k)[i].as_py() for k in range(len(FIGURES))]))
                    continue
                if now is not None and now.conv != conv:
                    out.append((now.conv, *now.row()))
                    now = None
                now = now or _Digest(conv)
                now.feed(*[b.column(2 + len(FIGURES) + k)[i].as_py() for k in range(3)])
            yield _figures(out, conv_type)
        if now is not None:
            yield _figures([(now.conv, *now.row())], conv_type)

    held = segments.mapInArrow(here, f"conv {kind}, seq long, {FIGURE_TYPES}, formatted string, spans array<struct<start:long,end:long>>, "
                                     "attachments array<struct<turn:long,kind:string,ref:string,tokens:long,at:long>>")
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.repartition(n, "conv").sortWithinPartitions("conv", "seq").mapInArrow(chained, f"conv {kind}, {FIGURE_TYPES}")


def _figures(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * (1 + len(FIGURES))
    return pa.RecordBatch.from_arrays([pa.array(list(cols[0]), conv_type), *[pa.array(list(c), t) for c, t in zip(cols[1:], _FIGURE_ARROW)]], ["conv", *FIGURES])


def op13_chat_formatting(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(given.unionByName(extra))).withColumnRenamed("conv", "conv_id")


_COUNTED = ["chr(92)", "'<|'", *[f"'{c}'" for c in FOREIGN]]


def _escaped_length(col: str) -> str:
    return f"length({col}) + " + " + ".join(f"(length({col}) - length(replace({col}, {c}, ''))) // length({c})" for c in _COUNTED)


OP13_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = '{TRAINED}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{TRAINED}'), '')) AS loss_sha256,
       sum({len(START + SEP + END)} + {_escaped_length('role')} + {_escaped_length('text')})::BIGINT AS formatted_chars,
       0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM rows GROUP BY conv_id
"""
