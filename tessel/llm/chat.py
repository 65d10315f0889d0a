"""Chat formatting held by a grammar round trip.

A conversation is rendered turn by turn as `### role: text</turn>` and a newline. Inside a text a backslash makes the character after it
plain. A deterministic parser reads what was rendered; where what it recovers is not the source, the turn's conflicting content is
escaped further and read again, until both are identical:

    0  nothing is escaped                    2  control strings and backslashes are
    1  control strings are                   3  every character is that a control string or an escape can begin with

What is rendered at step 3 parses to its source whatever it holds, so the search ends. A turn that parses alone to itself, with nothing left,
does so in any conversation, since the parser takes turns from left to right and looks at nothing beyond the end of one.

turns() gives a row for each turn, so that no conversation is a value in memory; the conversation's text is their `rendered` in order.
read_back() parses that text again, as a stream fed piece by piece in order: a conversation passes one task (a digest over all its
turns has to be sequential), which holds a turn of it at a time.

Defined results: a null text is an empty one, a null role an empty role, a null conv_id a conversation of its own; null turns come first, and rows of the same
turn are ordered by role and rendered text, repeated rows staying as many turns; an empty table gives an empty one; other columns are not read. Any text can be formatted,
and texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import table

#: Fixed values of the template.
MARK, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"

#: What the parser accepts as a turn: escaped characters, or plain ones that begin no control string.
_TURN = re.compile(r"### ((?:[^\\:#<\n]++|\\.)*+): ((?:[^\\#<]++|\\.|#(?!##)|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ROLE = re.compile(r"[\\:#<\n]")
#: By step, what gets a backslash before it.
_STEPS = (None, re.compile(r"###|</turn>"), re.compile(r"###|</turn>|\\"), re.compile(r"[\\#<]"))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(text: str, at: int = 0) -> tuple[str, str, int, int, int] | None:
    """The turn that begins at a place of text: role and text as recovered, where its body begins and ends, and where the turn ends. None if no whole turn begins there."""
    found = _TURN.match(text, at)
    return (unescaped(found[1]), unescaped(found[2]), found.start(2), found.end(2), found.end()) if found else None


def render(role: str, text: str) -> tuple[str, int, int, int]:
    """A turn as rendered, where its body begins and ends, and the step of escaping at which it parses to its source."""
    head = MARK + _ROLE.sub(r"\\\g<0>", role) + AFTER_ROLE
    for step, conflict in enumerate(_STEPS):
        body = conflict.sub(r"\\\g<0>", text) if conflict else text
        rendered = head + body + END
        if parse(rendered) == (role, text, len(head), len(head) + len(body), len(rendered)):
            return rendered, len(head), len(head) + len(body), step
    raise AssertionError("a turn without a rendering")  # step 3 always parses


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rendered, body_start, body_end, step, loss): each turn of conversations (conv_id, turn, role, text). body_* are code points of rendered; loss tells whether the body is under the loss mask."""
    usable = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            role = batch.column("role").to_pylist()
            made = [render(r, t) for r, t in zip(role, batch.column("text").to_pylist())]
            more = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array([r == ASSISTANT for r in role], pa.bool_())], [*batch.schema.names, "rendered", "body_start", "body_end", "step", "loss"])

    return usable.mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, rendered string, body_start bigint, body_end bigint, step int, loss boolean")


class Reader:
    """A conversation read from pieces of its text: what the parser recovers, as digests."""

    def __init__(self) -> None:
        self.left, self.n, self.chars, self.loss_chars = "", 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str) -> None:
        self.chars += len(piece)
        self.left += piece
        at = 0
        while found := parse(self.left, at):
            role, text, start, end, after = found
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == ASSISTANT:
                masked = unescaped(self.left[start:end])
                self.loss_chars += len(masked)
                self.loss.update(masked.encode())
            at = after
        self.left = self.left[at:]

    def row(self) -> tuple:
        if self.left:
            raise ValueError(f"a conversation ends in {len(self.left)} characters that are no turn")
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, parsed from the rendered text of turns() alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, of, done = None, None, []
        for batch in batches:
            for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("rendered").to_pylist()):
                if reader is None or conv != of:
                    if reader is not None:
                        done.append((of, *reader.row()))
                    reader, of = Reader(), conv
                reader.feed(piece)
            if done:
                yield _batch(done, names)
                done = []
        if reader is not None:
            yield _batch([(of, *reader.row())], names)

    ordered = rendered.select("conv_id", "turn", "role", "rendered").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "rendered").select("conv_id", "rendered")
    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


#: A conversation whose texts hold control strings and escapes.
PROBE = (-7, ("user", "assistant"), r"\### Assistant: </turn> ok")


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, roles, text = PROBE
    probe = spark.createDataFrame([(conv, k, role, text) for k, role in enumerate(roles)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)))


_COUNT = "CAST((length(text) - length(replace(text, '{0}', ''))) / {1} AS BIGINT)"
SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t.turn, t.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
), s AS (
  SELECT *, {_COUNT.format("###", 3)} + {_COUNT.format("</turn>", 7)} AS controls, {_COUNT.format(chr(92), 1)} AS slashes,
    length(text) - length(regexp_replace(text, '[\\#<]', '', 'g')) AS parts, length(role) - length(regexp_replace(role, '[\\:#<\n]', '', 'g')) AS in_role
  FROM c
), f AS (
  SELECT *, 4 + length(role) + in_role + 2 + length(text) + 8 + CASE WHEN regexp_matches(text, '(^|[^#])(###)+##?([^#]|$)') THEN parts ELSE controls + slashes END AS chars FROM s
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
