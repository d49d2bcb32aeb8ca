import random

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from codequarry.operators import history as H, verification as V


def test_blame_text(spark):
    good = ("0123456789abcdef 3 3 1\nauthor Ann B\nauthor-mail <a@b.c>\nauthor-time 1698765432\n"
            "author-tz +0000\nsummary  Fix it \nfilename a.py\n")
    texts = [good, "", "  ", "abc 1 1\nauthor x", "\n" + good, good.replace("1698765432", "x1"),
             "0123456 1 1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.b for r in df.select("i", H.parse_blame(F.col("t")).alias("b")).collect()}
    assert tuple(got[0]) == ("0123456789abcdef", "Ann B", "a@b.c", 1698765432, "Fix it")
    assert got[1] is got[2] is got[3] is got[4] is None
    assert got[5].ts_epoch == 0 and tuple(got[6]) == ("0123456", "", "", 0, "")


@pytest.mark.parametrize("width, levels", [(4, 2), (7, 1), (1000, 0), (3, 3)])
def test_version_before(spark, width, levels):
    rng = random.Random(width)
    versions = sorted({(rng.choice("aab"), rng.randint(0, 300)) for _ in range(120)})
    commits = sorted({(rng.choice("abc"), rng.randint(0, 320)) for _ in range(150)})
    want = {(f, s): max((v for g, v in versions if g == f and v < s), default=None) for f, s in commits}
    schema = "file string, seq long"
    got = H.version_before(spark.createDataFrame(commits, schema), spark.createDataFrame(versions, schema),
                           width=width, levels=levels)
    assert {(r.file, r.seq): r.before_seq for r in got.collect()} == want


def test_excerpt(spark):
    text = "\n".join(f"l{i}" for i in range(1, 31)) + "\n"
    rows = text.splitlines()
    df = spark.createDataFrame([(n, text) for n in (1, 5, 11, 12, 25, 30, 40, 41, 60)], "n int, t string")
    for r in df.select("n", H.excerpt(F.col("t"), F.col("n")).alias("x")).collect():
        assert r.x == "\n".join(rows[max(0, r.n - 11):min(len(rows), r.n + 10)]), r.n


def test_line_owner_last_change_wins(spark):
    df = spark.createDataFrame(
        [("a", 1, 3, "c1", 10, "x"), ("a", 2, 2, "c2", 20, "y"), ("a", 2, 5, "c3", 20, "z")],
        "file string, line_from int, line_to int, commit_id string, committed_at int, author string")
    got = {r.line_no: (r.commit_id, r.author) for r in H.line_owners(df).collect()}
    assert got == {1: ("c1", "x"), 2: ("c3", "z"), 3: ("c3", "z"), 4: ("c3", "z"), 5: ("c3", "z")}


_CHANGE = "repo string, file string, line_from int, line_to int, commit_id string, committed_at int, author string"


def test_owned_ranges_equal_line_by_line(spark):
    """Against a plain loop over all lines: overlaps, ties, gaps, null keys and reversed or
    missing ends, with ranges split small and with one file that has most changes."""
    rng = random.Random(5)
    rows = []
    for n in range(400):
        first = rng.randrange(-3, 300)
        repo, file = rng.choice([("r", "hot"), ("r", "hot"), ("r", "b"), (None, "hot"), ("r", None)])
        rows.append((repo, file, first, first + rng.choice([0, 0, 1, 2, 7, 64, 200]), f"c{n % 90}", rng.randrange(40), rng.choice("xy")))
    rows += [("r", "b", 900, 890, "back", 1, "x"), ("r", "b", None, 5, "none", 99, "x"), ("r", "b", 5, None, "none", 99, "x")]
    want = {}
    for repo, file, first, last, commit, at, author in rows:
        if first is not None and last is not None:
            for line in range(min(first, last), max(first, last) + 1):
                key = (repo, file, line)
                want[key] = max(want.get(key, (at, commit, author)), (at, commit, author))
    df = spark.createDataFrame(rows, _CHANGE)
    ranges = H.owned_ranges(df).collect()
    got = {}
    for r in ranges:
        for line in range(r.line_from, r.line_to + 1):
            assert (r.repo, r.file, line) not in got
            got[(r.repo, r.file, line)] = (r.committed_at, r.commit_id, r.author)
    assert got == want
    ends = {(r.repo, r.file, r.line_to): (r.committed_at, r.commit_id, r.author) for r in ranges}
    for r in ranges:  # as long as they can be
        assert ends.get((r.repo, r.file, r.line_from - 1)) != (r.committed_at, r.commit_id, r.author)
    lines = {(r.repo, r.file, r.line_no): (r.committed_at, r.commit_id) for r in H.line_owners(df).collect()}
    assert lines == {k: v[:2] for k, v in want.items()}
    assert H.owned_ranges(df.where("false")).count() == 0


def test_long_changes_are_few_rows(spark):
    """A change of a billion lines costs some tens of rows."""
    df = spark.createDataFrame(
        [("r", "a", 1, 2_000_000_000, "c1", 1, "x"), ("r", "a", 7, 1_000_000_007, "c2", 2, "y")], _CHANGE)
    got = sorted((r.line_from, r.line_to, r.commit_id) for r in H.owned_ranges(df).collect())
    assert got == [(1, 6, "c1"), (7, 1_000_000_007, "c2"), (1_000_000_008, 2_000_000_000, "c1")]
    nodes = df.select(F.size(H._tree_nodes(F.col("line_from").cast("long"), F.col("line_to").cast("long") + 1)).alias("n"))
    assert max(r.n for r in nodes.collect()) <= 62


def test_owned_ranges_across_small_blocks(spark, monkeypatch):
    """Changes over many blocks, ranges that go on behind an edge, and a plan in which nothing is joined."""
    monkeypatch.setattr(H, "OWNED_BLOCK", 16)
    rng = random.Random(11)
    rows = [("r", rng.choice("ab"), first, first + rng.choice([0, 3, 15, 16, 40, 90]), f"c{n % 9}", rng.randrange(5), "x")
            for n in range(120) for first in [rng.randrange(-40, 900)]]
    df = spark.createDataFrame(rows, _CHANGE)
    want = {(r.repo, r.file, r.line_no): (r.committed_at, r.commit_id) for r in H.line_owners(df).collect()}
    ranges = H.owned_ranges(df)
    assert "Join" not in ranges._jdf.queryExecution().optimizedPlan().toString()
    got, ends = {}, set()
    for r in ranges.collect():
        owner = (r.committed_at, r.commit_id)
        ends.add((r.file, r.line_to + 1, owner))
        got.update({("r", r.file, line): owner for line in range(r.line_from, r.line_to + 1)})
    assert got == want
    assert not any((r.file, r.line_from, (r.committed_at, r.commit_id)) in ends for r in ranges.collect())


def test_ranges_are_painted_in_lots(monkeypatch):
    """A group larger than a lot is reduced on the way; lots end inside groups and at their ends."""
    monkeypatch.setattr(H, "PAINT_ROWS", 6)
    rng = random.Random(3)
    rows = []
    for group, size in ((0, 1), (1, 40), (2, 6), (3, 200)):
        rows += [(group, first, first + rng.randrange(1, 30), 1 + n // 2, n == 0) for n in range(size) for first in [rng.randrange(60)]]
    names = ["block", "first", "stop", "rank", "fresh"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows[at:at + 4]), types)], names)
               for at in range(0, len(rows), 4)]
    want = {}
    for group, first, stop, rank, _ in rows:
        want.update({(group, line): rank for line in range(first, stop)})
    got = {}
    for row in (r for b in H._paint(iter(batches)) for r in b.to_pylist()):
        for line in range(row["first"], row["stop"]):
            assert (row["block"], line) not in got
            got[(row["block"], line)] = row["rank"]
    assert got == want


def test_short_changes_are_shuffled_once(spark):
    """All changes in one block of lines: one shuffle by file, no join, nothing stored."""
    df = spark.createDataFrame([("r", "a", 1, 3, "c1", 1, "x"), ("r", "a", 2, 2, "c2", 2, "y"), ("r", "b", 9, 7, "c1", 1, "x")], _CHANGE)
    ranges = H.owned_ranges(df)
    plan = ranges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = sorted((r.file, r.line_from, r.line_to, r.commit_id) for r in ranges.collect())
    assert got == [("a", 1, 1, "c1"), ("a", 2, 2, "c2"), ("a", 3, 3, "c1"), ("b", 7, 9, "c1")]


def test_story_of_an_issue(spark):
    lines = spark.createDataFrame(
        [("a.py", 1, 9, "0123456789", 5, 7, "Ann", "a@b", 86_400 * 3, "s" * 70)],
        "file string, line_from int, line_to int, commit_id string, committed_at int, "
        "commit_seq long, author string, author_mail string, ts_epoch long, summary string")
    versions = spark.createDataFrame([("a.py", 6, "old1\nold2"), ("a.py", 7, "new")], "file string, seq long, content string")
    issues = spark.createDataFrame([(1, "a.py", 2), (2, "a.py", 0), (3, "b.py", 2)], "issue_id int, file string, line_no int")
    got = {r.issue_id: r.archaeology for r in H.investigate(issues, lines, versions, 86_400 * 10).collect()}
    assert got[1].investigated and got[1].commit_hash == "01234567" and got[1].days_old == 7
    assert got[1].code_before == "old1\nold2" and got[1].had_safe_version
    assert got[1].insight == f"Bug introduced 1 week(s) ago by Ann in commit 01234567: '{'s' * 60}'"
    assert got[2].reason == "Issue missing file or line_number" and not got[2].investigated
    assert got[3].reason == "git blame returned no result for b.py:2" and got[3].had_safe_version is False


def test_test_output(spark):
    cases = {"5 passed": (True, 5, 0, 0), "3 passed, 2 failed": (True, 3, 2, 0),
             "1 passed, 1 failed, 2 errors": (True, 1, 1, 2), "no tests ran": (True, 0, 0, 0),
             "boom": (False, 0, 0, 0), "2 errors, 7 failed, 8 failed": (True, 0, 7, 2)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select("t", V.parse_test_output(F.col("t"), F.lit("z" * 900)).alias("r")).collect()
    for r in got:
        assert tuple(r.r)[:4] == cases[r.t] and len(r.r.output) == 600


def test_apply_patch_matches_replace_once(spark):
    rng = random.Random(8)
    data = [("".join(rng.choices("ab \n", k=rng.randint(0, 12))), "".join(rng.choices("ab ", k=rng.randint(0, 3))),
             rng.choice(["", " ", "X", "Xé\n"])) for _ in range(1500)]
    df = spark.createDataFrame(data, "c string, o string, f string")
    for r in df.select("*", V.apply_patch(F.col("c"), F.col("o"), F.col("f")).alias("p")).collect():
        old, new = r.o.strip(), r.f.strip()
        want = r.c.replace(old, new, 1) if old and new and old in r.c else None
        assert r.p == want


def test_advice_is_not_verified(spark):
    fixes = {"Taint path: a": False, "Manual review": False, "Convention violation: x": True, "x": True, None: True}
    df = spark.createDataFrame([(k,) for k in fixes], "f string")
    assert {r.f: r.n for r in df.select("f", V.needs_verification(F.col("f")).alias("n")).collect()} == fixes


def test_verdict_without_baseline_row(spark):
    patches = spark.createDataFrame([("p", "r", "x")], "issue_id string, repo string, suggested_fix string")
    none = spark.createDataFrame([], "repo string, stdout string, stderr string")
    runs = spark.createDataFrame([("p", "1 passed", "")], "issue_id string, stdout string, stderr string")
    v = V.verify(patches, none, runs).first().verification
    assert v.verified is None and v.baseline_pass == 0 and v.reason.startswith("No runnable")
