"""Repair of the turn structure of conversations, by alignment with the alternating grammar.

A repaired conversation has the roles ``(s?(ua)+)?``. Turns are kept, given another role, deleted
or joined by inserted ones; the cheapest edits win, and of equally cheap ones the ASCII-least
audit. A target of a given length is a prefix of the alternating string, so
one Wagner-Fischer table, filled from the end, holds the costs for every feasible length with the same last
role. Its band follows Ukkonen: a cheap repair found by one greedy walk is the incumbent, and
no cell further from the diagonal than that cost allows can be part of a better one. For each length
that reaches the least cost the audit is traced back, and the audits are compared.

Long conversations are aligned in blocks of ``BLOCK`` turns by separate tasks: a block is
aligned for every role that may come before and after it, and the blocks of a conversation are
joined by the cheapest chain. This is exact, ties included: an insertion belongs to the turn
after it, so within a block no audit begins another one and comparing audits block by block compares
the whole ones. A conversation is partitioned by ranges of its turns for that; equal turns are merged
to one row with a count before the shuffle. The last step reads a conversation as a
stream, blocks first, then texts, and holds some bytes a turn, never its texts.

Defined results. Null roles and texts count as one space, null turns come first, null ids are one
conversation. Rows of one turn are ordered by role, then by the digest of the text. A turn is blank, or
else a duplicate (role and text seen earlier in the conversation), or else truncated. Roles are told by
their first character; an empty role fits nothing and cannot be kept. Ids that are asked for and have no rows get zeros, an empty audit and the
digest of nothing. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.checkpoints import cut
from ..plans.skew import spread_lookup

# Fixed values of the edit costs.
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
SPACES, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
LEGAL = ("su", "ua", "au")
ROLE = {"u": "user", "a": "assistant"}
BLOCK = 64
#: What has been written before a block: nothing, the system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
PAIRS = tuple((a, b) for a in range(4) for b in range(4) if (b >= a if a < 2 else b >= 2))
#: Cost and audit of what is still to be inserted after the last turn, by what was written last.
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
FAR = 1 << 40


def _other(role: str) -> str:
    return "a" if role == "u" else "u"


def greedy(roles: list[str], short: list[bool], first: str) -> tuple[int, int]:
    """Cost and length of keeping whatever fits as it comes, and deleting the rest."""
    cost, length, wanted = 0, 0, first
    for role, cut_short in zip(roles, short):
        if role == wanted and not cut_short:
            length, wanted = length + 1, _other(wanted)
        else:
            cost += DELETE
    return cost, length


def incumbent(roles: list[str], short: list[bool]) -> int:
    """A cost that some repair reaches for either first role and every kind of target: odd, or
    even and not empty. From three kept turns on, deleting one more gives the other parity;
    otherwise one turn gets a role behind an inserted one and the rest goes."""
    bound = 0
    for first in "ua":
        cost, length = greedy(roles, short, first)
        bound = max(bound, cost + DELETE if length >= 3 else DELETE * len(roles) + INSERT + REROLE + CUT_SHORT)
    return bound


class Table:
    """Costs of aligning the last i turns with the last j roles of the string ending in ``last``,
    insertions before turns only. Row i covers ``i - most/2 <= j <= i + most/5``."""

    def __init__(self, roles: list[str], short: list[bool], last: str, most: int):
        self.roles, self.short, self.last = roles, short, last
        self.below, self.above = most // DELETE, most // INSERT
        chars = (last, _other(last))
        self.rows, self.starts = [[0]], [0]
        for i in range(1, len(roles) + 1):
            role, extra = roles[-i], CUT_SHORT if short[-i] else 0
            low, high = max(0, i - self.below), i + self.above
            old, old_low = self.rows[-1], self.starts[-1]
            old_end, row, left = old_low + len(old), [], FAR
            for j in range(low, high + 1):
                best = left + INSERT
                if old_low <= j < old_end and old[j - old_low] + DELETE < best:
                    best = old[j - old_low] + DELETE
                if old_low < j <= old_end:
                    step = old[j - 1 - old_low] + extra + (0 if role == chars[(j - 1) % 2] else REROLE)
                    if step < best:
                        best = step
                row.append(best)
                left = best
            self.rows.append(row)
            self.starts.append(low)

    def cost(self, i: int, j: int) -> int:
        at = j - self.starts[i]
        return self.rows[i][at] if 0 <= at < len(self.rows[i]) else FAR

    def audit(self, i: int, j: int) -> str:
        """The ASCII-least of the cheapest edits of the last i turns to the last j roles."""
        out, n = [], len(self.roles)
        while i:
            cost, role = self.cost(i, j), self.roles[n - i]
            if self.cost(i - 1, j) + DELETE == cost:
                out.append("D")
                i -= 1
            elif j and self.cost(i, j - 1) + INSERT == cost:
                out.append("I")
                j -= 1
            else:
                out.append("K" if role == (self.last if j % 2 else _other(self.last)) else "R")
                i, j = i - 1, j - 1
        return "".join(out)


def align(roles: list[str], short: list[bool]) -> dict[tuple[int, int], tuple[int, str]]:
    """For every pair of PAIRS that can be had: the least cost and, of its audits, the ASCII-least one."""
    m = len(roles)
    gone = (DELETE * m, "D" * m)
    out = {(s, s): gone for s in range(4)}
    if not m:
        return out
    most = incumbent(roles, short)
    tables = {last: Table(roles, short, last, most) for last in "ua"}

    def offer(pair, lead_cost, lead, i, first, last):
        """Targets of all feasible lengths from ``first`` to ``last`` for the last i turns."""
        table = tables[last]
        low = table.starts[i]
        lengths = [j for j in range(max(low, 1), low + len(table.rows[i])) if (j % 2 == 1) == (first == last)]
        least = min((table.cost(i, j) for j in lengths), default=FAR)
        if least >= FAR or (pair in out and out[pair][0] < lead_cost + least):
            return
        for j in lengths:
            if table.cost(i, j) == least:
                found = (lead_cost + least, lead + table.audit(i, j))
                if pair not in out or found < out[pair]:
                    out[pair] = found

    for before, first in ((ASSISTANT, "u"), (SYSTEM, "u"), (USER, "a"), (NOTHING, "u")):
        for after, last in ((USER, "u"), (ASSISTANT, "a")):
            offer((before, after), 0, "", m, first, last)
    for p in range(m):
        if roles[p] == "s":  # the one place where a system turn may stay
            lead_cost, lead = DELETE * p + (CUT_SHORT if short[p] else 0), "D" * p + "K"
            rest = m - p - 1
            alone = (lead_cost + DELETE * rest, lead + "D" * rest)
            if (NOTHING, SYSTEM) not in out or alone < out[NOTHING, SYSTEM]:
                out[NOTHING, SYSTEM] = alone
            if rest:
                offer((NOTHING, USER), lead_cost, lead, rest, "u", "u")
                offer((NOTHING, ASSISTANT), lead_cost, lead, rest, "u", "a")
    return out


def _with_forced(audit: str, items: list[tuple[bool, int]]) -> str:
    """The audit of free turns with the forced deletions, (forced, copies) by item, put in."""
    out, at = [], 0
    for forced, copies in items:
        if forced:
            out.append("D" * copies)
            continue
        end = at
        while audit[end] == "I":
            end += 1
        out.append(audit[at:end + 1] + "D" * (copies - 1))
        at = end + 1
    return "".join(out)


class Block:
    """Turns of one conversation on their way into one block row."""

    def __init__(self):
        self.roles, self.short, self.items = [], [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.key = self.first_role = self.last_role = self.low = self.high = None

    def add(self, key, turn, role, blank, seen, short, copies):
        initial = role[:1]
        if self.key is None:
            self.key, self.first_role = key, initial
        elif self.last_role + initial not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1  # a turn and its copy are never a legal pair
        self.last_role = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        forced = blank or seen
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies if seen else copies - 1
        self.truncated += not forced and short
        self.items.append((forced, copies))
        if not forced:
            self.roles.append(initial)
            self.short.append(short)

    def row(self) -> dict:
        found = align(self.roles, self.short)
        fixed = DELETE * sum(copies if forced else copies - 1 for forced, copies in self.items)
        return {
            "costs": [found[p][0] + fixed if p in found else None for p in PAIRS],
            "audits": [_with_forced(found[p][1], self.items) if p in found else None for p in PAIRS],
            "free": "".join("f" * c if forced else "." + "f" * (c - 1) for forced, c in self.items),
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "first_role": self.first_role, "last_role": self.last_role, "turns": self.turns, "low": self.low, "high": self.high,
        }


def chain(blocks: list[dict]) -> tuple[int, list[str]]:
    """Least cost, and the audit of every block and of what is inserted at the end."""
    best, choice = [c for c, _ in CLOSING], []
    for b in reversed(blocks):
        new, picked = [FAR] * 4, [None] * 4
        for k, (start, end) in enumerate(PAIRS):
            if b["costs"][k] is None:
                continue
            offer = (b["costs"][k] + best[end], b["audits"][k])
            if picked[start] is None or offer < (new[start], b["audits"][picked[start]]):
                new[start], picked[start] = offer[0], k
        best = new
        choice.append(picked)
    state, audits = NOTHING, []
    for b, picked in zip(blocks, reversed(choice)):
        k = picked[state]
        audits.append(b["audits"][k])
        state = PAIRS[k][1]
    return best[NOTHING], [*audits, CLOSING[state][1]]


BLOCK_FIELDS = (
    "costs array<bigint>, audits array<string>, free string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first_role string, last_role string, turns bigint, low bigint, high bigint")
ORDER = ["turn", "role", "digest"]


def _blocks(batches):
    """Sorted turns in, one row per block out; a block ends with its conversation, or partition."""
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema  # noqa: F401

    now, conv = Block(), None
    ready = []

    def flush():
        nonlocal now
        if now.items:
            turn, role, digest = now.key
            ready.append({"conv": conv, "turn": turn, "role": role, "digest": digest, "block": now.row()})
        now = Block()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "digest", "blank", "seen", "short", "copies")]
        for c, turn, role, digest, blank, seen, short, copies in zip(*columns):
            if c != conv or len(now.items) == BLOCK:
                flush()
                conv = c
            now.add((turn, role, digest), turn, role, blank, seen, short, copies)
        if len(ready) >= 256:
            yield _block_batch(ready)
            ready.clear()
    flush()
    if ready:
        yield _block_batch(ready)


_block_struct = pa.struct([
    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("free", pa.string()),
    *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first_role", pa.string()),
    ("last_role", pa.string()), *((c, pa.int64()) for c in ("turns", "low", "high"))])
_block_schema = pa.schema([("conv", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("block", _block_struct)])


def _block_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_block_schema)


class Conversation:
    """One conversation of the last stream: its blocks, then its free turns in order."""

    def __init__(self, conv):
        self.conv, self.blocks, self.edits = conv, [], None

    def plan(self):
        self.cost, parts = chain(self.blocks)
        self.audit = "".join(parts)
        kept = len(self.audit) - self.audit.count("D")
        self.system, self.place, self.hash = kept % 2, 0, hashlib.sha256()
        self.edits = self._edits(parts)

    def _edits(self, parts):
        """Edits of free turns, and insertions, in order."""
        for b, audit in zip(self.blocks, parts):
            at = 0
            for edit in audit:
                if edit == "I":
                    yield edit
                else:
                    if b["free"][at] == ".":
                        yield edit
                    at += 1
        yield from parts[-1]

    def _write(self, role: str | None, text: bytes):
        """One repaired turn; without a role, the one that the grammar asks for."""
        role = role if role is not None else ROLE["u" if (self.place - self.system) % 2 == 0 else "a"]
        self.hash.update((b"\n" if self.place else b"") + role.encode() + b":" + text)
        self.place += 1
        return self.conv, self.place, role, text

    def turn(self, role: str, text: bytes):
        """Repaired turns up to and with this free turn."""
        for edit in self.edits:
            if edit == "I":
                yield *self._write(None, b""), edit
                continue
            if edit != "D":
                yield *self._write(role if edit == "K" else None, text), edit
            return

    def rest(self):
        if self.edits is None:
            self.plan()
        for edit in self.edits:
            if edit == "I":
                yield *self._write(None, b""), edit

    def summary(self) -> dict:
        total = {c: sum(b[c] for b in self.blocks) for c in ("blank", "duplicate", "truncated", "illegal")}
        turns, low, high = 0, None, None
        for before, b in zip([None, *self.blocks], self.blocks):
            total["illegal"] += before is not None and before["last_role"] + b["first_role"] not in LEGAL
            if b["low"] is not None:
                turns += b["turns"] - (b["low"] == high)
                low, high = b["low"] if low is None else low, b["high"]
        gaps = 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)
        return {"conv": self.conv, "gaps": gaps, **total, "cost": self.cost, "audit": self.audit, "sha256": self.hash.hexdigest()}


SUMMARY = [("conv", "string"), *((c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
           ("audit", "string"), ("sha256", "string")]
TURNS = [("conv", "string"), ("place", "bigint"), ("role", "string"), ("text", "binary"), ("edit", "string")]
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
BATCH_BYTES = 1 << 20


def _streamed(as_turns: bool):
    """Sorted rows of all phases in; repaired turns, or one summary per conversation, out."""
    columns = TURNS if as_turns else SUMMARY
    schema = pa.schema([(c, _ARROW[kind]) for c, kind in columns])

    def run(batches):
        now, ready, size = None, [], 0

        def take(made):
            nonlocal size
            for row in made:
                if as_turns:
                    ready.append(dict(zip(schema.names, row)))
                    size += len(row[3]) + 64

        def finish():
            nonlocal size
            if now is not None:
                take(now.rest())
                if not as_turns:
                    ready.append(now.summary())
                    size += len(now.audit) + 128

        for batch in batches:
            for conv, phase, role, text, block in zip(*(batch.column(c) for c in ("conv", "phase", "role", "text", "block"))):
                conv = conv.as_py()
                if now is None or conv != now.conv:
                    finish()
                    now = Conversation(conv)
                if phase.as_py() == 1:
                    now.blocks.append(block.as_py())
                elif phase.as_py() == 2:
                    if now.edits is None:
                        now.plan()
                    take(now.turn(role.as_py(), text.as_py()))
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(ready, schema=schema)
                    ready, size = [], 0
        finish()
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=schema)

    return run, ", ".join(f"{c} {kind}" for c, kind in columns)


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


class Repair:
    """Aligned conversations: ``summaries()`` and the repaired ``turns()``.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text``; ``ids`` (``conv_id``) are reported even
    where no row is left."""

    def __init__(self, rows: DataFrame, ids: DataFrame | None = None):
        self.type = rows.schema["conv_id"].dataType
        said = rows.select(
            _key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
        solid = F.rtrim("text", F.lit(SPACES))
        facts = said.withColumn("digest", F.sha2("text", 256)).withColumn("solid", solid).select(
            "conv", *ORDER, "text", (F.col("solid") == "").alias("blank"), (~F.right("solid", F.lit(1)).isin(*ENDS)).alias("short"))
        self.ids = (rows if ids is None else ids).select(_key(F.col("conv_id")).alias("conv")).distinct()
        # Each text of a role once, at its first turn: what a repaired conversation can hold.
        firsts = cut(
            facts.where("not blank").groupBy("conv", "role", "digest", "text")
            .agg(F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("unplaced"))
            .select("conv", "role", "digest", "text", F.expr("if(unplaced, null, least)").alias("first_turn")))
        slim = cut(facts.groupBy("conv", *ORDER, "blank", "short").agg(F.count(F.lit(1)).alias("copies")))
        seen = spread_lookup(
            slim.where("not blank"), firsts.drop("text"), ["conv", "role", "digest"], spread_by=["turn"],
        ).withColumn("seen", ~F.col("first_turn").eqNullSafe(F.col("turn"))).drop("first_turn")
        placed = cut(seen.unionByName(slim.where("blank").withColumn("seen", F.lit(False))))
        self.texts = firsts
        # Ranges of turns, not conversations, are dealt out, so a long one is aligned by many tasks.
        dealt = placed.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
        self.blocks = cut(dealt.mapInArrow(
            _blocks, f"conv string, turn bigint, role string, digest string, block struct<{BLOCK_FIELDS.replace(' ', ':').replace(',:', ',')}>"))

    def _stream(self, as_turns: bool) -> DataFrame:
        nothing = F.lit(None)
        kind = self.blocks.schema["block"].dataType
        asked = self.ids.select(
            "conv", F.lit(0).alias("phase"), nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"),
            nothing.cast("string").alias("digest"), nothing.cast("binary").alias("text"), nothing.cast(kind).alias("block"))
        blocks = self.blocks.select("conv", F.lit(1).alias("phase"), *ORDER, nothing.cast("binary").alias("text"), "block")
        texts = self.texts.select(
            "conv", F.lit(2).alias("phase"), F.col("first_turn").alias("turn"), "role", "digest",
            F.col("text").cast("binary").alias("text"), nothing.cast(kind).alias("block"))
        rows = asked.unionByName(blocks).unionByName(texts)
        run, schema = _streamed(as_turns)
        done = rows.repartition("conv").sortWithinPartitions("conv", "phase", *ORDER).mapInArrow(run, schema)
        conv = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(self.type)
        return done.select(conv.alias("conv_id"), *(c for c in done.columns if c != "conv"))

    def summaries(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256 of the repaired
        ``role:text`` lines."""
        return self._stream(False)

    def turns(self) -> DataFrame:
        """conv_id, place (from 1), role, text, edit (K, R or I) of every repaired turn."""
        return self._stream(True).withColumn("text", F.col("text").cast("string"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults planted by a checksum of id and turn, out of 20 kinds: 0 drops a row,
    1 empties its text, 2 takes its ends of sentences, 3 repeats it, 4 makes it a user's."""
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text"), space)
    return rows.withColumn("__kind", kind).where("__kind <> 0").select(
        "conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(F.coalesce(F.col("role"), space)).alias("role"),
        F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("__kind") == 3, 2).otherwise(1))).alias("__copy"),
    ).drop("__copy")
