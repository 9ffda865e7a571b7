"""Chat formatting with a grammar round trip.

Template: a user's turn is ``<s>[INST] text [/INST]``, an assistant's
``[ANSWER] text </s>``, any other role's ``<s>[ROLE] role [:] text [/ROLE]``. A
deterministic parser reads each rendered turn back; a turn that does not come back
as it was has its content escaped (a backslash before each backslash and each
control string) and is parsed again, so that rendering and parsing are inverse.

Since the parser consumes turns from left to right and each turn ends at its own
unescaped closing mark, a conversation comes back exactly when each of its turns
does. Turns are therefore rendered and checked one at a time, wherever they are, and
a conversation of any length is streamed in turn order in bounded memory: only its
running digests are kept.

Defined cases: null text counts as empty, null role as the empty role, and a null
conversation id is one conversation; a null turn number sorts first; rows with the
same turn number are ordered by role, then text; repeated rows stay; an empty table
gives an empty result (the query still adds its own conversation); other columns
are carried along or not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ._common import arrow_map, table

ASSISTANT = "assistant"
MARKS = {"user": ("<s>[INST] ", " [/INST]"), ASSISTANT: ("[ANSWER] ", " </s>")}
OTHER = ("<s>[ROLE] ", " [/ROLE]")
SEPARATOR = " [:] "  # between the name and the text of any other role
CONTROLS = ("<s>[INST]", "<s>[ROLE]", "<s>", "</s>", "[INST]", "[/INST]", "[ANSWER]", "[ROLE]", "[/ROLE]", "[:]")
_CONTROL = "|".join(map(re.escape, CONTROLS))
_TO_ESCAPE = re.compile(rf"\\|{_CONTROL}")
#: What the parser takes as one unit inside content: an escaped backslash or control string, or a bare one.
_UNIT = re.compile(rf"\\\\|\\(?:{_CONTROL})|{_CONTROL}")


class GrammarError(ValueError):
    """The text is no conversation of this template."""


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def render_turn(role: str, text: str, escaped: bool) -> str:
    if escaped:
        role, text = (role if role in MARKS else escape(role)), escape(text)
    start, end = MARKS.get(role, OTHER)
    return start + (text if role in MARKS else role + SEPARATOR + text) + end


def _content(s: str, at: int, close: str) -> tuple[str, int]:
    """Unescaped content from ``at`` up to the first bare closing mark, and the place behind that mark."""
    parts: list[str] = []
    mark = close.strip()
    for m in _UNIT.finditer(s, at):
        if m[0][0] == "\\":
            parts += [s[at : m.start()], m[0][1:]]
            at = m.end()
        elif m[0] == mark:
            parts.append(s[at : m.start()])
            lead, trail = close[: len(close) - len(close.lstrip())], close[len(close.rstrip()) :]
            text = "".join(parts)
            if not text.endswith(lead) or not s.startswith(trail, m.end()):
                raise GrammarError(f"bad closing mark at {m.start()}")
            return text[: len(text) - len(lead)], m.end() + len(trail)
        else:
            raise GrammarError(f"bare control string at {m.start()}")
    raise GrammarError("no closing mark")


def parse_turn(s: str, at: int = 0) -> tuple[str, str, int]:
    """Role, text and end of the turn that begins at ``at``."""
    for role, (start, end) in MARKS.items():
        if s.startswith(start, at):
            text, at = _content(s, at + len(start), end)
            return role, text, at
    if not s.startswith(OTHER[0], at):
        raise GrammarError(f"no turn at {at}")
    role, at = _content(s, at + len(OTHER[0]), SEPARATOR)
    text, at = _content(s, at, OTHER[1])
    return role, text, at


def parse(s: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(s):
        role, text, at = parse_turn(s, at)
        turns.append((role, text))
    return turns


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """The rendered turn, and role and text as parsed from it; escaped only where the plain form does not come back."""
    for escaped in (False, True):
        out = render_turn(role, text, escaped)
        try:
            got = parse_turn(out)
        except GrammarError:
            continue
        if got == (role, text, len(out)):
            return out, got[0], got[1]
    raise GrammarError(f"a turn of role {role!r} does not come back")


def render(turns: list[tuple[str, str]]) -> str:
    """A conversation in the template; ``parse`` gives the turns back."""
    return "".join(format_turn(role, text)[0] for role, text in turns)


def format_turns(turns: DataFrame) -> DataFrame:
    """Every turn in the template: ``formatted``, role and text as parsed from it, and ``in_loss``, whether its text is under the loss mask.

    A conversation's formatted text is its turns' in order; other columns are kept.
    """
    columns = turns.columns
    role_at, text_at = columns.index("role"), columns.index("text")
    told = turns.withColumns({"role": F.col("role").cast("string"), "text": F.col("text").cast("string")})
    schema = StructType([*told.schema.fields, StructField("formatted", StringType()), StructField("in_loss", BooleanType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [format_turn(role or "", text or "") for role, text in zip(batch.column(role_at).to_pylist(), batch.column(text_at).to_pylist(), strict=True)]
        kept = list(batch.columns)
        kept[role_at], kept[text_at] = (pa.array([d[k] for d in done], pa.string()) for k in (1, 2))
        return pa.RecordBatch.from_arrays([*kept, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] == ASSISTANT for d in done])], names=[*columns, "formatted", "in_loss"])

    return arrow_map(told, run, schema)


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, chars: int, in_loss: bool) -> None:
        self.turns += 1
        self.chars += chars
        self.all.update(f"{role}\n{text}\n".encode())
        if in_loss:
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and turn; one running digest is open at a time."""
    now: _Digest | None = None
    for batch in batches:
        done = []
        for conv_id, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv_id)
            now.add(*turn)
        if done:
            yield _packed(done)
    if now is not None:
        yield _packed([now.row()])


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted turns.

    Formatting and parsing run before the shuffle, where a conversation's turns are
    spread over tasks; only the digests, which are sequential by nature, need its
    turns in order.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    told = format_turns(rows).select("conv_id", "turn", "role", "text", F.length("formatted").alias("chars"), "in_loss")
    dealt = told.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text", "chars", "in_loss").mapInArrow(_streamed, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, ASSISTANT, told)], "conv_id long, turn long, role string, text string")
    return format_conversations(turns.unionByName(own))


_SQL_UNIT = r"\\|<s>\[INST\]|<s>\[ROLE\]|<s>|</s>|\[INST\]|\[/INST\]|\[ANSWER\]|\[ROLE\]|\[/ROLE\]|\[:\]"
#: Roles hold no control strings here. A text is escaped where it holds a control string or two backslashes.
OP2_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, CASE WHEN regexp_matches(text, '{_SQL_UNIT.removeprefix(chr(92) * 2 + "|")}') OR contains(text, '\\')
                THEN length(text) + len(regexp_extract_all(text, '{_SQL_UNIT}')) ELSE length(text) END + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 14 ELSE 23 + length(role) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
