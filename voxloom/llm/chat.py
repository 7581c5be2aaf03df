"""Chat formatting in budgeted windows.

A conversation's turns are laid out in windows of at most ``budget`` tokens (words and marks). Prefix sums of the turns'
tokens choose how many new turns a window holds; spans never cut a turn, so a turn beyond the budget has a window of its
own. Every window begins with the conversation's system turn, if it opens with one, then repeats the last turns before
its new ones as far as ``history`` tokens reach. Only assistant texts among the new turns are under the loss mask: what
is repeated has been a target before.

Turns read ``<|turn|>role`` NEWLINE ``text<|end|>`` NEWLINE. Control strings inside texts and roles, those of other
templates too, get a backslash behind their first character; a string that has backslashes there already gets one more,
so that taking one away restores every text exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.scratch import saved

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
# Beginnings and endings of control strings, of this template and of public ones.
CONTROL = re.compile(r"(<)(\\*)(\||/?s>|</?SYS>>|/?unk>|/?pad>|start_of_turn>|end_of_turn>)|(\[)(\\*)(/?INST\])")
ESCAPED = re.compile(r"(<)\\(\\*)(\||/?s>|</?SYS>>|/?unk>|/?pad>|start_of_turn>|end_of_turn>)|(\[)\\(\\*)(/?INST\])")
TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.DOTALL)
WORD = r"[^\x20\x09-\x0D]+"

BUDGET, HISTORY = 1024, 256
#: Tokens of a turn's marks and role.
MARKS = 4
BATCH_CHARS = 4 << 20


def escaped(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[1] or m[4]}\\{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(lambda m: f"{m[1] or m[4]}{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def turn_text(role: str, text: str) -> tuple[str, int]:
    """The turn as formatted, and where its text begins."""
    head = OPEN + escaped(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    return head + escaped(text) + CLOSE, len(head)


def parsed(window: str) -> list[tuple[str, str]]:
    """The (role, text) of a window's turns."""
    plain_role = lambda r: re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(r))
    return [(plain_role(m[1]), unescaped(m[2])) for m in TURN.finditer(window)]


@dataclass
class Turn:
    role: str
    text: str
    #: tokens, marks included, and the prefix sum of tokens over the conversation up to this turn
    tokens: int
    total: int


def laid_out(turns: Iterable[Turn], budget: int, history: int) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """(window, repeated turns, loss spans) of a conversation.

    A window takes new turns as long as the prefix sums say that they fit. The turns come as a stream; what is held is a
    window, and the turns before it that a history can reach.
    """
    system: Turn | None = None
    past: list[Turn] = []
    repeated: list[Turn] = []
    new: list[Turn] = []
    room = 0
    for turn in turns:
        if not new and not past and turn.role == "system":
            system = turn
        if new and turn.total - new[0].total + new[0].tokens > room:
            yield _window(repeated, new)
            past = (past + [t for t in new if t is not system])[-(history // MARKS + 1) :]
            new = []
        if not new:
            opening = [system] if system and turn is not system else []
            spent = sum(t.tokens for t in opening)
            most = min(history, budget - spent - turn.tokens)  # history gives way where the new turn would not fit beside it
            back: list[Turn] = []
            for t in reversed(past):
                if t.tokens > most:
                    break
                back.append(t)
                most -= t.tokens
            repeated = opening + back[::-1]
            room = budget - sum(t.tokens for t in repeated)
        new.append(turn)
    if new:
        yield _window(repeated, new)


def _window(repeated: list[Turn], new: list[Turn]) -> tuple[str, int, list[tuple[int, int]]]:
    out, place, loss = [], 0, []
    for k, turn in enumerate(repeated + new):
        piece, begin = turn_text(turn.role, turn.text)
        if k >= len(repeated) and turn.role == "assistant":
            loss.append((place + begin, place + len(piece) - len(CLOSE)))
        out.append(piece)
        place += len(piece)
    return "".join(out), len(repeated), loss


def _conversations(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conversation, its rows as a stream) from rows that come sorted by conversation."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
    return groupby(rows, key=lambda row: row[0])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += size(row)
        if chars >= BATCH_CHARS or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_repeated", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def formatted(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The windows (conv_id, window, text, n_repeated, loss) of all conversations of ``turns`` (conv_id, turn, role, text).

    Turns go by ``turn``, null first; ties by role, then text. Null roles and texts are empty. Rows with a null conv_id are
    one conversation; repeated rows are turns of their own. Tokens are counted and summed up in Spark; rows are sorted
    there and streamed through the formatter, so that the longest conversation doesn't have to fit into memory. A turn of
    any length is laid out whole. Empty tables give empty results; other columns, whatever their names, don't matter.
    """

    def layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def windows() -> Iterator[tuple]:
            for conv, rows in _conversations(batches, ["conv_id", "role", "text", "tokens", "total"]):
                for k, (text, repeated, loss) in enumerate(laid_out((Turn(*r[1:]) for r in rows), budget, history)):
                    yield conv, k, text, repeated, [{"start": s, "end": e} for s, e in loss]

        yield from _batches(windows(), WINDOWS, lambda row: len(row[2]))

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long") + MARKS)
    order = ["turn", "role", "text"]
    summed = counted.withColumn("total", F.sum("tokens").over(Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ordered = summed.sortWithinPartitions("conv_id", *order)
    return ordered.mapInArrow(layout, "conv_id long, window long, text string, n_repeated long, loss array<struct<start:long,end:long>>")


def read_back(windows: DataFrame) -> DataFrame:
    """Each conversation's digests, from its windows alone: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple]:
            for conv, rows in _conversations(batches, ["conv_id", "text", "n_repeated", "loss"]):
                n_turns, said, chars, loss_chars, targets = 0, hashlib.sha256(), 0, 0, hashlib.sha256()
                for _, text, repeated, loss in rows:
                    chars += len(text)
                    for role, words in parsed(text)[repeated:]:
                        n_turns += 1
                        said.update(f"{role}\n{words}\n".encode())
                    for s in loss:
                        target = unescaped(text[s["start"] : s["end"]])
                        loss_chars += len(target)
                        targets.update(target.encode())
                yield conv, n_turns, said.hexdigest(), loss_chars, targets.hexdigest(), chars

        yield from _batches(conversations(), DIGESTS, lambda row: 0)

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Formats ``turns``, writes the windows, and reads the digests back from what was written."""
    return read_back(saved(formatted(turns, budget, history), "windows"))


#: The same rows in DuckDB's SQL. n_turns to loss_sha256 come from the table; formatted_chars lays the windows out by
#: recursion over their first turns.
SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS named FROM c),
t AS (SELECT *, row_number() OVER w AS i, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
             17 + len(text) + len(named) + len(regexp_extract_all(text, '<\\*(?:\||/?s>|</?SYS>>|/?unk>|/?pad>|start_of_turn>|end_of_turn>)|\[\\*/?INST\]'))
             + len(regexp_extract_all(named, '<\\*(?:\||/?s>|</?SYS>>|/?unk>|/?pad>|start_of_turn>|end_of_turn>)|\[\\*/?INST\]')) AS chars
      FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i)::BIGINT AS total, sum(chars) OVER (PARTITION BY conv_id ORDER BY i)::BIGINT AS sized FROM t),
s AS (SELECT conv_id, tokens AS s_tokens, chars AS s_chars FROM p WHERE i = 1 AND role = 'system'),
r AS (SELECT conv_id, 1::BIGINT AS first, 0::BIGINT AS chars FROM p WHERE i = 1
      UNION ALL
      SELECT r.conv_id, n.last + 1, r.chars + n.chars FROM r, LATERAL (
        WITH a AS (SELECT p.*, CASE WHEN r.first > 1 THEN coalesce(s_tokens, 0) ELSE 0 END AS o_tokens, CASE WHEN r.first > 1 THEN coalesce(s_chars, 0) ELSE 0 END AS o_chars, s_tokens IS NOT NULL AS has
                   FROM p LEFT JOIN s USING (conv_id) WHERE p.conv_id = r.conv_id AND p.i = r.first),
        b AS (SELECT a.*, coalesce((SELECT min(q.i) FROM p q WHERE q.conv_id = a.conv_id AND q.i < a.i AND q.i > CASE WHEN a.has THEN 1 ELSE 0 END
                                    AND a.total - a.tokens - q.total + q.tokens <= least(256, 1024 - a.o_tokens - a.tokens)), a.i) AS begin FROM a),
        e AS (SELECT b.*, b.total - b.tokens - coalesce((SELECT q.total - q.tokens FROM p q WHERE q.conv_id = b.conv_id AND q.i = b.begin), 0) AS back FROM b),
        z AS (SELECT e.*, greatest(e.i, (SELECT max(q.i) FROM p q WHERE q.conv_id = e.conv_id AND q.i >= e.i AND (q.i = e.i OR q.total - e.total + e.tokens <= 1024 - e.o_tokens - e.back))) AS last FROM e)
        SELECT z.last, z.o_chars + (SELECT q.sized FROM p q WHERE q.conv_id = z.conv_id AND q.i = z.last) - (SELECT q.sized - q.chars FROM p q WHERE q.conv_id = z.conv_id AND q.i = z.begin) AS chars FROM z) n
      WHERE r.first <= (SELECT max(q.i) FROM p q WHERE q.conv_id = r.conv_id)),
f AS (SELECT conv_id, max(chars)::BIGINT AS formatted_chars FROM r GROUP BY conv_id)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, formatted_chars
FROM p JOIN f USING (conv_id) GROUP BY conv_id, formatted_chars
"""
