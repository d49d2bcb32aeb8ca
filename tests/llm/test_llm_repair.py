"""Conversation repair against all edits of small conversations and a plain search of large ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codequarry.llm import repair
from codequarry.llm.queries import op13_repair

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
#: What may follow: state -> role initial -> state; the grammar is s?(ua)+ or nothing.
AUTOMATON = {"start": {"s": "opened", "u": "asked"}, "opened": {"u": "asked"}, "asked": {"a": "done"}, "done": {"u": "asked"}}
FULL = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def ordered(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest())
    return sorted(rows, key=key)


def faults(rows):
    """First fault of each row in order, or nothing."""
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_search(rows, found):
    """Least (cost, audit) of all edits, state by state of the grammar: one best per state, which is
    enough because later edits do not depend on what came before."""
    def insertions(states):
        states = dict(states)
        for _ in range(3):
            for state, (cost, audit, out) in list(states.items()):
                for role, to in AUTOMATON[state].items():
                    if role != "s":
                        offer = (cost + 5, audit + "I", out + [f"{FULL[role]}:"])
                        if to not in states or offer[:2] < states[to][:2]:
                            states[to] = offer
        return states

    states = insertions({"start": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, found):
        new = {}
        for state, (cost, audit, out) in states.items():
            offers = [(state, (cost + 2, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                for initial, to in AUTOMATON[state].items():
                    if role[:1] == initial:
                        offers.append((to, (cost + extra, audit + "K", out + [f"{role}:{text}"])))
                    if initial != "s":
                        offers.append((to, (cost + 1 + extra, audit + "R", out + [f"{FULL[initial]}:{text}"])))
            for to, offer in offers:
                if to not in new or offer[:2] < new[to][:2]:
                    new[to] = offer
        states = insertions(new)
    return min((s for state, s in states.items() if state in ("start", "done")), key=lambda s: s[:2])


def every_edit(rows, found, most_inserted=2):
    """Least (cost, audit) by trying all edits, a few insertions at each place."""
    best = None
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "u", "a"] for f in found]
    choices = [[e for e in c if e != "K" or r[2]] for r, c in zip(rows, choices)]  # no role, nothing to keep
    fills = ["".join(p) for k in range(most_inserted + 1) for p in itertools.product("ua", repeat=k)]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(fills, repeat=len(rows) + 1):
            roles, audit, cost = gaps[0], "I" * len(gaps[0]), 5 * len(gaps[0])
            for (_, _, role, _), f, e, gap in zip(rows, found, edits, gaps[1:]):
                roles += ("" if e == "D" else role[:1] if e == "K" else e) + gap
                audit += (e if e in "DK" else "R") + "I" * len(gap)
                cost += {"D": 2, "K": 0}.get(e, 1) + (5 if f == "truncated" and e != "D" else 0) + 5 * len(gap)
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def plain_summary(rows):
    rows = ordered(rows)
    found = faults(rows)
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    cost, audit, out = plain_search(rows, found)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest())


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def compare(spark, rows, ids=None, **how):
    done = repair.Repair(spark.createDataFrame(rows, SCHEMA), ids).summaries().collect()
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    expected = {c: plain_summary(part) for c, part in by_conversation(clean).items()}
    assert {r["conv_id"]: tuple(r)[1:] for r in done} == expected and len(done) == len(expected)


def test_query_equals_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    parts = by_conversation(plain_damage(rows))
    got = op13_repair(spark, SF).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {c: plain_summary(parts.get(c, [])) for c in {r[0] for r in rows}}
    assert len(got) == len({r[0] for r in rows})


initials_ = st.sampled_from(["system", "user", "assistant", "tool", "", "unnamed"])
turn_ = st.tuples(initials_, st.sampled_from(["a.", "b!", "cut", " ", "c?", "d.", "e"]))


def aligned(rows):
    """(cost, audit) by the module, from faults found here."""
    found = faults(rows)
    block, blocks = repair.Block(), []
    for (_, turn, role, text), f in zip(rows, found):
        block.add((turn, role, text), turn, role, f == "blank", f == "duplicate", f == "truncated", 1)
        if len(block.items) == repair.BLOCK:
            blocks.append(block.row())
            block = repair.Block()
    if block.items:
        blocks.append(block.row())
    cost, parts = repair.chain(blocks)
    return cost, "".join(parts)


@given(st.lists(turn_, max_size=3))
@settings(max_examples=120, deadline=None)
def test_equals_every_edit(turns):
    rows = [(1, i, *t) for i, t in enumerate(turns)]
    assert aligned(rows) == every_edit(rows, faults(rows))


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_blocks_change_nothing(block, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", block)
    random.seed(block)
    for _ in range(150):
        n, odd = random.randrange(0, 40), random.random()
        rows, role = [], "user"
        for i in range(n):
            role = {"user": "assistant"}.get(role, "user") if random.random() > odd * 0.6 else random.choice(["system", "user", "assistant", "tool"])
            rows.append((1, i, role, random.choice([f"t{i}.", f"t{i}.", f"t{i}", "same.", " "] if random.random() < odd else [f"x{i}!"])))
        assert aligned(rows) == plain_search(rows, faults(rows))[:2]


def test_table_band_keeps_every_best_cost():
    """The banded table next to one without a band, for lengths that any repair may need."""
    random.seed(4)
    for _ in range(60):
        m = random.randrange(1, 30)
        roles = [random.choice("uuaas") for _ in range(m)]
        short = [random.random() < 0.2 for _ in range(m)]
        most = repair.incumbent(roles, short)
        for last in "ua":
            slim, full = repair.Table(roles, short, last, most), repair.Table(roles, short, last, 10 * m + 50)
            for j in range(1, 2 * m + 4):
                if full.cost(m, j) <= most:
                    assert slim.cost(m, j) == full.cost(m, j) and slim.audit(m, j) == full.audit(m, j)


def test_odd_rows(spark):
    """Nulls in every column, no turn order, repeated rows, blank and empty conversations."""
    rows = [
        (1, None, "user", "hello."), (1, 0, "assistant", "hi."), (1, None, None, None), (None, 1, "user", "no id."), (None, None, "assistant", "early."),
        (2, 1, "user", "same."), (2, 1, "user", "same."), (2, 1, "user", "same."), (2, 2, "assistant", "ok"), (2, 9, "assistant", "ok."),
        (3, 5, "system", "rules."), (4, 1, "", ""), (4, 2, "tool", "x.\n\t "), (5, -(2 ** 62), "user", "far."), (5, 2 ** 62, "assistant", "far."),
        (6, 3, "user", "é\U0001f600."), (6, 4, "user", " "), (7, 1, "user", "a."), (7, 1, "assistant", "b."), (7, 1, "user", "a."),
    ]
    compare(spark, rows)


def test_ids_without_rows_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    ids = spark.createDataFrame([(8,), (8,), (None,)], "conv_id long")
    nothing = hashlib.sha256(b"").hexdigest()
    got = repair.Repair(empty, ids).summaries().collect()
    assert sorted(map(tuple, got), key=str) == sorted([(c, 0, 0, 0, 0, 0, 0, "", nothing) for c in (8, None)], key=str)
    assert repair.Repair(empty).summaries().count() == 0 and repair.Repair(empty).turns().count() == 0


def test_repaired_turns_tell_the_digest(spark):
    """The turns themselves obey the grammar and give the digest of the summary."""
    rows = spark.read.parquet(f"{SF}/conversations.parquet").withColumn("place", F.lit("own")).withColumn("conv", F.lit(0))
    fixed = repair.Repair(repair.damaged(rows))
    digest = {r["conv_id"]: (r["sha256"], r["audit"]) for r in fixed.summaries().collect()}
    parts = by_conversation([tuple(r) for r in fixed.turns().orderBy("conv_id", "place").collect()])
    for conv, (sha, audit) in digest.items():
        turns = parts.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(t[2][0] for t in turns))
        assert hashlib.sha256("\n".join(f"{t[2]}:{t[3]}" for t in turns).encode()).hexdigest() == sha
        assert "".join(t[4] for t in turns) == audit.replace("D", "") and [t[1] for t in turns] == list(range(1, len(turns) + 1))


def test_one_long_conversation_over_many_partitions(spark):
    """A conversation of a third of all rows, in ranges of several tasks, with one turn said over and over."""
    random.seed(1)
    rows = [(1, i, random.choice(["user", "assistant", "assistant", "user", "system"]), random.choice([f"t{i}.", f"t{i}.", "again.", "cut"])) for i in range(3000)]
    rows += [(1, 50, "user", "again.")] * 500 + [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(2, 700) for t in range(10)]
    random.shuffle(rows)
    compare(spark, rows)
