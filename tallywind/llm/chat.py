"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, then the
reply, of which alone the text is trainable. A conversation that does not end with a reply
gets one more example without a target, so that the output holds every turn.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn. Inside roles and texts, strings that
mark structure here or in common chat templates get a backslash after their first character
(one more if some are there already); :func:`unescape` takes it away again.

Rows are sorted by turn within their conversation and stream through a task, which holds the
rendered prefix of one conversation and one batch of output.

Defined cases: null role or text is empty; null turns come first, equal turns by role and
text; rows with null conv_id form one conversation; an empty table gives no example.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_MARK = re.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\])")
_FLUSH_CHARS = 4_000_000

EXAMPLES = "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long"
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long, n_examples long")


def escape(text: str) -> str:
    return _MARK.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text starts and ends."""
    head = f"{TURN}{escape(role)}{TEXT}"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered prefix."""
    turns = []
    for piece in text.split(TURN)[1:]:
        role, _, rest = piece.partition(TEXT)
        turns.append((unescape(role), unescape(rest.removesuffix(END))))
    return turns


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()),
                        ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
    rows: list[tuple] = []
    held = 0
    now, prefix, turns, examples, open_tail = object(), [], 0, 0, False
    length = 0

    def flush():
        nonlocal rows, held
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows, held = [], 0
        return out

    def add(start, end):
        nonlocal examples, held, prefix
        prefix = ["".join(prefix)]
        rows.append((now, examples, turns, prefix[0], start, end))
        examples += 1
        held += length

    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if conv != now:
                if open_tail:
                    add(length, length)
                now, prefix, turns, examples, length, open_tail = conv, [], 0, 0, 0, False
            piece, start, end = render(role or "", text or "")
            prefix.append(piece)
            turns += 1
            start, end, length = length + start, length + end, length + len(piece)
            open_tail = role != "assistant"
            if not open_tail:
                add(start, end)
            if held > _FLUSH_CHARS:
                yield flush()
    if open_tail:
        add(length, length)
    if rows:
        yield flush()


def expand(turns: DataFrame) -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text): conv_id, example (from 0), n_turns in
    its text, text, and the trainable characters [loss_start, loss_end); none for a tail.
    Examples of a conversation stand together in one partition, in order."""
    ship_by_value(__name__)
    rows = (turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"))
    return rows.mapInArrow(_expand, EXAMPLES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    done: list[tuple] = []
    now, last, state = object(), "", None

    def close():
        turns = parse(last)
        whole = hashlib.sha256()
        for role, text in turns:
            whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        done.append((now, len(turns), whole.hexdigest(), state[0], state[1].hexdigest(), state[2], state[3]))

    for batch in batches:
        for conv, text, start, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "text", "loss_start", "loss_end"))):
            if conv != now:
                if state:
                    close()
                now, state = conv, [0, hashlib.sha256(), 0, 0]
            last = text
            loss = unescape(text[start:end])
            state[0] += len(loss)
            state[1].update(loss.encode("utf-8", "surrogatepass"))
            state[2] += len(text)
            state[3] += 1
        if len(done) > 5000:
            yield _digests(done, names)
            done = []
    if state:
        close()
    if done:
        yield _digests(done, names)


def _digests(done: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples of :func:`expand`: its turns, the text
    under the loss masks, and the characters of all examples."""
    ship_by_value(__name__)
    return examples.mapInArrow(_digest, DIGESTS)


def control_case(turns: DataFrame) -> DataFrame:
    """Conversation -1, whose texts hold control strings of other templates."""
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(
        turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


#: The same from the conversations themselves, in DuckDB's SQL.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g') AS erole,
    regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g') AS etext FROM t),
s AS (
  SELECT *, 8 + length(erole) + 8 + length(etext) + 7 AS n,
    row_number() OVER w AS nr, count(*) OVER (PARTITION BY conv_id) AS cnt,
    sum(8 + length(erole) + 8 + length(etext) + 7) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nr) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR nr = cnt)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR nr = cnt) AS n_examples
FROM s GROUP BY conv_id
"""
