"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the template.
END = "</turn>"
LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}

_CONTROL = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"[\\:\n]|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ROLES = {v: k for k, v in LABELS.items()}

EXAMPLES = "conv_id long, example long, text string, loss_start long, loss_end long"


def escape(text: str) -> str:
    """A backslash before each backslash and control string, so that texts can't open or close a turn."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends there. Other roles than the three known get an @."""
    label = LABELS.get(role) or "@" + _IN_ROLE.sub(lambda m: "\\" + m[0], role)
    head, body = f"### {label}: ", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str, int]]:
    """(role, text, start of the text) of each turn of a formatted example."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((_ROLES.get(m[1]) or unescape(m[1][1:]), unescape(m[2]), m.start(2)))
        at = m.end()
    return turns


def expand(turns: DataFrame) -> DataFrame:
    """One example per assistant turn (see EXAMPLES): all turns up to it, with the reply in [loss_start, loss_end) of text.

    If the last turn isn't the assistant's, a last example has all turns and nothing to learn (loss_start = loss_end).
    Turns are ordered by turn, role, text, nulls first; null roles and texts are empty; repeated rows are turns of
    their own; rows with a null conv_id form one conversation. Rows stream through sorted by conversation: a task
    holds one conversation's text, which an example needs anyway.
    """

    def run(batches):
        current, prefix, done, pending = None, "", 0, False
        out: list[tuple] = []

        def rest():
            if pending:
                out.append((current[0], done, prefix, len(prefix), len(prefix)))

        size = 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if current is None or current[0] != conv:
                    rest()
                    current, prefix, done, pending = (conv,), "", 0, False
                turn, start, end = format_turn(role, text)
                at = len(prefix)
                prefix += turn
                pending = role != "assistant"
                if not pending:
                    out.append((conv, done, prefix, at + start, at + end))
                    done += 1
                    size += len(prefix)
                if size > 4_000_000:
                    yield _batch(out)
                    out, size = [], 0
        rest()
        yield _batch(out)

    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, EXAMPLES)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "example", "text", "loss_start", "loss_end"])


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted examples alone; expects expand()'s order and partitions."""

    def run(batches):
        current, last, count = None, "", 0
        chars, loss = 0, hashlib.sha256()
        out: list[tuple] = []

        def close():
            if current is not None:
                turns = parse(last)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _ in turns).encode()).hexdigest()
                out.append((current[0], len(turns), digest, chars, loss.hexdigest(), count))

        for batch in batches:
            for conv, text, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if current is None or current[0] != conv:
                    close()
                    current, chars, loss, count = (conv,), 0, hashlib.sha256(), 0
                learned = unescape(text[start:end])
                chars, count, last = chars + len(learned), count + len(text), text
                loss.update(learned.encode())
        close()
        columns = list(zip(*out)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], turns.schema)
    return read_back(expand(turns.unionByName(extra)))


OP10_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length('### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
                ELSE '@' || regexp_replace(role, '[\\:\n]|###|</turn>', '\\\0', 'g') END || ': ' || regexp_replace(text, '\\|###|</turn>', '\\\0', 'g') || '</turn>' || chr(10)) AS n FROM t),
c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
