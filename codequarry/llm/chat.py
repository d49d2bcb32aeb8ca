"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. It is called on successive prefixes of a
conversation, and consecutive outputs are compared: when the longer one begins with the
shorter, what was added is the span of the new turn; when not, the template rewrites history,
and the conversation is reported with ``rewrites`` and no spans, since a loss mask over such an
output would lie. Inside a turn's span the text is found by rendering the turn once more with
another text and comparing from both sides: what both have in common is markup.

The template given here marks turns and escapes control strings inside roles and texts, so
the output can be read back exactly.

A conversation is one string in the end, so its turns meet in one task; tasks get whole
conversations, many at a time, and nothing grows beyond the longest conversation.

Defined results: a null role or text is empty. Turns are ordered by turn, ties by role and
text, rows without a turn first. Repeated rows are turns of their own. Rows without conv_id
form one conversation. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_schema

from .text import TaskCache

BATCH_CHARS = 8 << 20
_rendered = TaskCache()

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The strings that mark turns. A backslash before one makes it plain text.
_PROBES = ("a", "b", "c")
OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
TRAINED_ROLE = "assistant"
#: Characters that begin a control string, or an escape, inside a role or text.
_ESCAPED = {"\\": "\\\\", "#": "\\#", "<": "\\<", ":": "\\:"}
_TO_ESCAPED = str.maketrans(_ESCAPED)


def escape(value: str) -> str:
    """Make every control string plain text."""
    return value.translate(_TO_ESCAPED)


def unescape(value: str) -> str:
    """Undo :func:`escape`."""
    parts = value.split("\\")
    out, k = [parts[0]], 1
    while k < len(parts):
        if parts[k]:
            out.append(parts[k])
            k += 1
        else:  # an escaped backslash: the next part follows it as it is
            out.append("\\" + (parts[k + 1] if k + 1 < len(parts) else ""))
            k += 2
    return "".join(out)


def turn_template(turns: list[Turn]) -> str:
    """Every turn as ``### role: text </turn>`` on its own. Turns are kept as they were rendered
    last, since prefixes of one conversation ask for them again and again."""
    if len(_rendered) > 4096:
        _rendered.clear()
    held = _rendered.get
    return "".join([held(turn) or _rendered.setdefault(turn, _one_turn(*turn)) for turn in turns])


def _one_turn(role: str, said: str) -> str:
    return f"{OPEN}{escape(role)}{BETWEEN}{escape(said)}{CLOSE}"


@dataclass(frozen=True)
class Rendered:
    """Output and, by turn, the span of the turn and of its text; none if history is rewritten."""

    output: str
    spans: list[tuple[int, int]]
    texts: list[tuple[int, int]]
    rewrites: bool


def render(template: Template, turns: list[Turn]) -> Rendered:
    """Render prefix after prefix and locate every turn from what it adds."""
    before, spans, texts = template([]), [], []
    for k, (role, said) in enumerate(turns):
        now = template(turns[:k + 1])
        if not now.startswith(before):
            return Rendered(template(turns), [], [], True)
        spans.append((len(before), len(now)))
        # A text that begins and ends differently from this one shows where this one stands.
        other = next(c for c in _PROBES if c not in (said[:1], said[-1:]))
        probe = template([*turns[:k], (role, other)])
        head = _common(probe, now, len(before), min(len(probe), len(now)))
        texts.append((head, len(now) - _common_end(probe, now, min(len(probe), len(now)) - head)))
        before = now
    return Rendered(before, spans, texts, False)


def _common(a: str, b: str, start: int, stop: int) -> int:
    """First place from ``start`` on where the strings differ."""
    while start < stop:
        half = (start + stop + 1) // 2
        if a[start:half] == b[start:half]:
            start = half
        else:
            stop = half - 1
    return start


def _common_end(a: str, b: str, most: int) -> int:
    """Length of the longest common end of at most ``most`` characters."""
    low = 0
    while low < most:
        half = (low + most + 1) // 2
        if a[len(a) - half:] == b[len(b) - half:]:
            low = half
        else:
            most = half - 1
    return low


def format_conversations(conversations: DataFrame, template: Template = turn_template,
                         trained_role: str = TRAINED_ROLE) -> DataFrame:
    """``conv_id, output, turns array<struct<role, start, end, text_start, text_end, trained>>,
    rewrites`` for every conversation. Spans count code points of the output; ``trained``
    turns' text spans are the loss mask."""
    schema = T.StructType([
        T.StructField("conv_id", conversations.schema["conv_id"].dataType),
        T.StructField("output", T.StringType()),
        T.StructField("turns", T.ArrayType(T.StructType([
            T.StructField("role", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
            T.StructField("text_start", T.LongType()), T.StructField("text_end", T.LongType()), T.StructField("trained", T.BooleanType())]))),
        T.StructField("rewrites", T.BooleanType()),
    ])
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def one(conv_id, turns: list[Turn]) -> dict:
        r = render(template, turns)
        marks = [
            {"role": role, "start": s, "end": e, "text_start": a, "text_end": b, "trained": role == trained_role}
            for (role, _), (s, e), (a, b) in zip(turns, r.spans, r.texts)]
        return {"conv_id": conv_id, "output": r.output, "turns": marks, "rewrites": r.rewrites}

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come ordered by conversation; one may go on in the next batch.
        now, turns, done, size = None, [], [], 0
        for batch in batches:
            for conv_id, role, said in zip(*(c.to_pylist() for c in batch.columns)):
                if turns and conv_id != now:
                    done.append(one(now, turns))
                    size += len(done[-1]["output"])
                    turns = []
                now = conv_id
                turns.append((role, said))
                if size > BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(done, arrow)
                    done, size = [], 0
        if turns:
            done.append(one(now, turns))
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, schema)


def role_of(output: str, start: int, text_start: int) -> str:
    """The role of a turn of :func:`turn_template`, read from its markup."""
    return unescape(output[start + len(OPEN):text_start - len(BETWEEN)])


@arrow_udf(T.StructType([
    T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType())]))
def read_back(outputs: pa.Array, turns: pa.Array) -> pa.Array:
    """Digests of the turns, and of the text under the loss mask, read from formatted output."""
    rows = []
    for output, marks in zip(outputs.to_pylist(), turns.to_pylist()):
        said, learned = [], []
        for m in marks:
            plain = unescape(output[m["text_start"]:m["text_end"]])
            said.append(f"{role_of(output, m['start'], m['text_start'])}\n{plain}\n")
            if m["trained"]:
                learned.append(plain)
        loss = "".join(learned)
        rows.append({
            "n_turns": len(marks), "turns_sha256": hashlib.sha256("".join(said).encode()).hexdigest(),
            "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest()})
    return pa.array(rows, pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())]))
