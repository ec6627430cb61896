"""Chat formatting with typed content parts (operator 6).

A message is a role and an ordered list of typed parts: text, image, audio or
document. A visitor flattens the parts into one string: texts are escaped, other
parts become placeholders such as ``<|image:0|>``, numbered within the turn, and are
recorded as attachments with the number of tokens they expand to. A turn reads

    ### role: content</turn>

and a line break. Texts and roles can hold any of these control strings: a backslash
is put before every backslash, every ``#`` of a run of three or more, and every ``<``
that begins ``</turn>`` or a placeholder (and, in roles, every colon); ``read_turns``
takes them off again. The loss mask is a list of spans of the formatted turn: the
texts of assistant turns, without placeholders.

Each turn is formatted by itself, so a conversation's size does not matter; its
formatted text is its turns' in order of (turn, role, text). ``read_conversations``
streams turns sorted by conversation through one parser and one running digest per
conversation: nothing but the current turn is held. A digest is sequential, so one
conversation's turns pass through one task.

Edge cases: a null text, part list or part is empty; a null role is the empty role;
unknown part types become ``<|document|>``-like placeholders of their own name's
kind ``other``; a null turn comes first; repeated rows are turns like others; null
conversation ids form one conversation; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

#: Tokens that placeholders expand to: an image patch of PATCH x PATCH pixels, a second of sound, a page.
PATCH, SECOND_TOKENS, PAGE_TOKENS = 28, 25, 512
KINDS = ("image", "audio", "document", "other")
PARTS_DDL = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
TURN_END = "</turn>"
_CONTROL = re.compile(r"\\|#{3,}|<(?=/turn>|\|(?:image|audio|document|other):)")
_ROLE_CONTROL = re.compile(r"[\\:]|#{3,}|<(?=/turn>|\|(?:image|audio|document|other):)")
_TURN = re.compile(r"### ((?:\\.|[^\\:]++)*+): ((?:\\.|[^\\<]++|<(?!/turn>))*+)</turn>\n", re.S)
_PLACEHOLDER = re.compile(r"(\\.)|<\|(image|audio|document|other):(\d+)\|>", re.S)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "".join("\\" + c for c in m[0]), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass
class Flattener:
    """Visits a message's parts in order; a method per kind."""

    pieces: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    at: int = 0
    pending: str = ""

    def visit(self, part: dict | None) -> None:
        if part:
            getattr(self, f"visit_{part['type']}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.pending += part["text"] or ""  # texts side by side could form a control string

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part["width"] or 0) / PATCH) * math.ceil((part["height"] or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part["seconds"] or 0) * SECOND_TOKENS))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part["pages"] or 0) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 1)

    def _emit(self, s: str) -> None:
        self.pieces.append(s)
        self.at += len(s)

    def flush(self) -> None:
        if self.pending:
            s = escape(self.pending)
            self.spans.append((self.at, len(s)))
            self._emit(s)
            self.pending = ""

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.flush()
        self.attachments.append({"kind": kind, "ref": part["ref"], "position": self.at, "tokens": max(1, tokens)})
        self._emit(f"<|{kind}:{len(self.attachments) - 1}|>")


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """The formatted turn, the spans under the loss mask, and the attachments (positions in the formatted turn)."""
    f = Flattener()
    f._emit(f"### {escape(role or '', _ROLE_CONTROL)}: ")
    for part in parts or []:
        f.visit(part)
    f.flush()
    f._emit(TURN_END + "\n")
    return "".join(f.pieces), f.spans if role == "assistant" else [], f.attachments


def read_turns(formatted: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of each turn in a formatted text; a part is ("text", text) or (kind, number)."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at character {at}")
        parts, done, body = [], 0, m[2]
        for p in _PLACEHOLDER.finditer(body):
            if p[1] is None:
                if p.start() > done:
                    parts.append(("text", unescape(body[done : p.start()])))
                parts.append((p[2], p[3]))
                done = p.end()
        if done < len(body):
            parts.append(("text", unescape(body[done:])))
        out.append((unescape(m[1]), parts))
        at = m.end()
    return out


FORMATTED_DDL = "conv_id long, turn long, role string, formatted string, spans array<struct<start:int,length:int>>, attachments array<struct<kind:string,ref:string,position:int,tokens:int>>, attachment_tokens long"
_SPAN = pa.struct([("start", pa.int32()), ("length", pa.int32())])
_ATTACHMENT = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int32()), ("tokens", pa.int32())])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [format_turn(role, parts) for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), batch.column(2), pa.array([r[0] for r in rows], pa.string()),
            pa.array([[{"start": a, "length": n} for a, n in r[1]] for r in rows], pa.list_(_SPAN)), pa.array([r[2] for r in rows], pa.list_(_ATTACHMENT)),
            pa.array([sum(a["tokens"] for a in r[2]) for r in rows], pa.int64()),
        ], names=["conv_id", "turn", "role", "formatted", "spans", "attachments", "attachment_tokens"])


def format_messages(messages: DataFrame) -> DataFrame:
    """One row per message (conv_id, turn, role, parts): formatted, spans, attachments, attachment_tokens."""
    tune(messages.sparkSession)
    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("parts").cast(PARTS_DDL)).mapInArrow(
        _format,
        FORMATTED_DDL,
    )


def text_messages(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as messages of one text part."""
    nothing = "cast(null as string) as ref, cast(null as int) as width, cast(null as int) as height, cast(null as double) as seconds, cast(null as int) as pages"
    return turns.selectExpr("conv_id", "turn", "role", f"array(struct('text' as type, coalesce(text, '') as text, {nothing})) as parts")


CONVERSATION_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CONVERSATION_DDL.split(", ")]
    now, done = None, []

    def close() -> None:
        if now is not None:
            done.append([now["conv"], now["n"], now["turns"].hexdigest(), now["loss_n"], now["loss"].hexdigest(), now["chars"]])

    def out() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [[]] * 6
        made = pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if "sha256" in n else pa.int64()) for c, n in zip(cols, names, strict=True)],
            names=names,
        )
        done.clear()
        return made

    for batch in batches:
        for conv, formatted, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if now is None or now["conv"] != conv:
                close()
                now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "chars": 0}
            for role, parts in read_turns(formatted):
                text = "".join(x for kind, x in parts if kind == "text")
                now["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now["n"] += 1
            for s in spans or []:
                text = unescape(formatted[s["start"] : s["start"] + s["length"]])
                now["loss"].update(text.encode("utf-8", "surrogatepass"))
                now["loss_n"] += len(text)
            now["chars"] += len(formatted)
        if len(done) >= 1000:
            yield out()
    close()
    yield out()


def read_conversations(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from formatted turns.

    Turns of one number and role are in order of their texts: what stands between the
    turn's head, which is the same for all of them, and its end, without escapes.
    """
    body = F.substring("formatted", F.lit(1), F.char_length("formatted") - len(TURN_END + "\n"))
    text = F.regexp_replace(body, r"(?s)\\(.)", "$1")
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), text)
    return dealt.select("conv_id", "formatted", "spans").mapInArrow(_digest, CONVERSATION_DDL)


PROBE = r"\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_conversations(format_messages(text_messages(turns.unionByName(probe))))


_ADDED = r"""len(regexp_extract_all({x}, '{one}')) + coalesce(list_sum(list_transform(regexp_extract_all({x}, '#{{3,}}'), lambda r: length(r))), 0)
      + len(regexp_extract_all({x}, '</turn>|<\|(?:image|audio|document|other):'))"""
ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), f AS (
  SELECT *, length(role) + length(text) + 14
    + {_ADDED.format(x="role", one=r"[\\:]")}
    + {_ADDED.format(x="text", one=r"\\")} AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
