import os
import random

import pytest
from pyspark.sql import functions as F

from codequarry.config import AnalysisConfig
from codequarry.errors import SourceTreeError
from codequarry.operators import chunks as C, parse
from codequarry.sources import files as S
from codequarry.sources import results
from codequarry.sources.results import save_tree


def as_files(spark, sources):
    data = [("r", f"r/{k}", k, v) for k, v in sources.items()]
    return spark.createDataFrame(
        data, "repo string, file_path string, rel_path string, content string")


def functions_of(spark, **sources):
    return parse.functions(parse.parse_files(as_files(spark, sources)))


def test_breadth_first_order_and_flags(spark):
    src = (
        "@deco(1)\ndef a(x, *, k=1):\n    def inner():\n        pass\n    return inner\n\n\n"
        "class K:\n    async def m(self, y):\n        await y\n\n\ndef b():\n    return 1\n"
    )
    got = functions_of(spark, m=src).orderBy("func_seq").collect()
    # Depth by depth: a, b at the top; then m in the class and inner in a.
    assert [r.function_name for r in got] == ["a", "b", "inner", "m"]
    by = {r.function_name: r for r in got}
    assert by["a"].start_line == 2 and by["a"].code.startswith("def a")
    assert by["m"].is_method and by["m"].is_async and not by["b"].is_method
    assert by["inner"].is_nested and not by["m"].is_nested
    assert by["inner"].code == "    def inner():\n        pass"
    args = parse.function_args(parse.parse_files(as_files(spark, {"m": src})))
    assert {r.function_name: r.arguments for r in args.collect()} == {
        "a": ["x"], "inner": [], "b": []}


def test_bad_files_are_rows_not_failures(spark):
    bad = {"syntax": "def f(:\n", "nul": "x = 1\0", "deep": "(" * 5000 + ")" * 5000,
           "surrogate": "def ok():\n    return 1\n"}
    parsed = parse.parse_files(as_files(spark, bad))
    assert {r.rel_path for r in parse.parse_errors(parsed).collect()} == {
        "syntax", "nul", "deep"}
    assert [r.function_name for r in parse.functions(parsed).collect()] == ["ok"]


def test_each_file_is_parsed_once(spark):
    plan = functions_of(spark, m="def f(): pass")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def chunk_twin(code, start, name, path, low, high):
    """Plain loop with the same meaning."""
    code = code.strip()
    n = len(code.splitlines())
    if n < low:
        return []
    if n <= high:
        parts = [code]
    else:
        parts, held = [], []
        for line in code.splitlines():
            held.append(line)
            if not line.strip() and len(held) >= high:
                parts.append("\n".join(held).strip())
                held = []
        parts.append("\n".join(held).strip())
        parts = [p for p in parts if p]
    out = []
    for p in parts:
        out.append((name, start, start + len(p.splitlines()), p))
        start += len(p.splitlines())
    return out


def test_chunks_match_twin_on_random_text(spark):
    rng = random.Random(3)
    data = []
    for i in range(400):
        lines = [rng.choice(["", "  ", "x = 1", "    y", "\x0c", "\t"]) for _ in range(rng.randint(0, 40))]
        data.append((f"f{i}", "a.py", rng.randint(1, 99), rng.choice(["\n", "\r\n"]).join(lines)))
    df = spark.createDataFrame(data, "function_name string, file_path string, start_line int, code string")
    for high in (4, 10):
        got = C.chunk_functions(df, AnalysisConfig(max_chunk_lines=high, min_chunk_lines=3))
        have = sorted((r.function_name, r.start_line, r.end_line, r.code) for r in got.collect())
        want = sorted(c for n, p, s, code in data for c in chunk_twin(code, s, n, p, 3, high))
        assert have == want


def test_chunking_needs_no_shuffle(spark):
    plan = C.chunk_functions(functions_of(spark, m="def f(): pass"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_production_filter_is_a_substring_test(spark, rows):
    df = spark.createDataFrame(
        [("a/latest/x.py", "f"), ("a/src/x.py", "test_f"), ("a/src/x.py", "f"),
         ("a/src/conftest.py", "g"), ("a/src/y.py", "conftest_x")],
        "file_path string, function_name string")
    assert rows(C.production_chunks(df)) == [("a/src/x.py", "f")]
    assert rows(C.production_counts(df)) == [(1, 4)]


def test_code_lines(spark, rows):
    df = spark.createDataFrame([("a", "x\n\n  # no\n \t\n#\n y # z\n")], "id string, code string")
    assert rows(C.code_lines(df)) == [("a", 1, "x"), ("a", 6, " y # z")]


def make_tree(root):
    (root / "pkg" / "_private").mkdir(parents=True)
    (root / "tests").mkdir()
    (root / ".hidden").mkdir()
    (root / "pkg" / "__init__.py").write_text("def init(): pass\n")
    (root / "pkg" / "_private" / "_x.py").write_text("def x(): pass\n")
    (root / "pkg" / "crlf.py").write_bytes(b"def c():\r\n    return 1\r\n")
    (root / "pkg" / "bad.py").write_bytes(b"# \xff\ndef bad(): pass\n")
    (root / "pkg" / "note.txt").write_text("no")
    (root / "pkg" / "test_a.py").write_text("no")
    (root / "tests" / "a.py").write_text("no")
    (root / ".hidden" / "h.py").write_text("def h(): pass\n")


def test_scan_tree(spark, tmp_path):
    make_tree(tmp_path)
    raw = S.scan_tree(spark, str(tmp_path))
    assert sorted(r.rel_path for r in raw.select("rel_path").collect()) == [
        ".hidden/h.py", "pkg/__init__.py", "pkg/_private/_x.py", "pkg/bad.py", "pkg/crlf.py"]
    files, rejects = S.decode_strict(raw, "r")
    text = {r.rel_path: r.content for r in files.collect()}
    assert text["pkg/crlf.py"] == "def c():\n    return 1\n" and "pkg/bad.py" not in text
    assert [(r.rel_path, r.error) for r in rejects.collect()] == [("pkg/bad.py", "not valid UTF-8")]
    lossy = {r.rel_path: r.content for r in S.decode_lossy(raw, "r").collect()}
    assert lossy["pkg/bad.py"] == "# \ufffd\ndef bad(): pass\n"
    limited = S.scan_tree(spark, str(tmp_path), AnalysisConfig(max_file_bytes=20))
    assert "pkg/crlf.py" in {r.rel_path for r in S.decode_strict(limited, "r")[1].collect()}


def test_listing_runs_in_tasks(spark, tmp_path, monkeypatch):
    """The driver lists nothing, and the files are the same however little a task may list."""
    for i in range(40):
        folder = tmp_path / f"a{i % 3}" / f"b{i % 7}" / f"c{i}"
        folder.mkdir(parents=True)
        (folder / f"m{i}.py").write_text(f"x = {i}\n")
    (tmp_path / "a0" / "loop").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "a1" / "gone.py").symlink_to(tmp_path / "nowhere.py")
    listings, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda *folder: listings.append(str(folder)) or scandir(*folder))
    whole = {(r.file_path, r.length) for r in S.list_tree(spark, str(tmp_path)).collect()}
    assert len(whole) == 41 and not any(str(tmp_path) in folder for folder in listings)
    for entries in (1, 9):
        few = [(r.file_path, r.length) for r in S.list_tree(spark, str(tmp_path), entries=entries).collect()]
        assert len(few) == 41 and set(few) == whole
    raw = {r.rel_path: r for r in S.scan_tree(spark, f"file:{tmp_path}").collect()}
    assert bytes(raw["a1/b0/c7/m7.py"].body) == b"x = 7\n"
    assert raw["a1/gone.py"].body is None and raw["a1/gone.py"].read_error.startswith("unreadable")


def test_a_listing_asks_for_names_alone(spark, tmp_path, monkeypatch):
    """Sizes of a folder's files are asked for by other tasks than the one that lists it."""
    for i in range(30):
        (tmp_path / f"m{i}.py").write_text("x" * i)
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere.py")
    os.mkfifo(tmp_path / "pipe.py")
    assert {size for _, _, _, size in S._entries(None, str(tmp_path))} == {None}
    monkeypatch.setattr(S, "LIST_ENTRIES", 4)
    got = {os.path.basename(r.file_path): (r.length, r.read_error) for r in S.list_tree(spark, str(tmp_path)).collect()}
    assert got == {f"m{i}.py": (i, None) for i in range(30)} | {"gone.py": (0, None), "pipe.py": (0, None)}


def test_tree_written_and_read(spark, tmp_path):
    rows = [("a/__init__.py", "x = 1\n"), ("a/b/ü.py", "é\r\n"), ("none.py", None), (None, "lost"), ("a/note.txt", "n")]
    save_tree(spark.createDataFrame(rows, "rel_path string, content string"), str(tmp_path / "t"))
    got = {r.rel_path: bytes(r.body).decode() for r in S.scan_tree(spark, str(tmp_path / "t")).collect()}
    assert got == {"a/__init__.py": "x = 1\n", "a/b/ü.py": "é\r\n", "none.py": ""}
    (tmp_path / "empty").mkdir()
    assert S.scan_tree(spark, str(tmp_path / "empty")).collect() == []


def test_more_files_than_lie_in_a_tree_at_once(spark, tmp_path, monkeypatch):
    """Every file is written, listed and read, and no more than so many lie there at once."""
    monkeypatch.setattr(results, "TREE_FILES", 60)
    rows = [(f"a/b{i % 3}/ü{i}.py", f"x = {i}\n") for i in range(200)] + [("tests/t.py", "no"), ("a/n.txt", "no"), ("e.py", None), (None, "lost")]
    files = spark.createDataFrame(rows, "rel_path string, content string")
    most = []

    def read(root):
        most.append(sum(len(names) for _, _, names in os.walk(tmp_path / "t") if any(n.endswith((".py", ".txt")) for n in names)))
        return S.scan_tree(spark, root).select("rel_path", "length", "body")

    got = {r.rel_path: (r.length, bytes(r.body).decode()) for r in results.through_trees(files, str(tmp_path / "t"), read).collect()}
    want = {path: (len((text or "").encode()), text or "") for path, text in rows if path and path.endswith(".py") and not path.startswith("tests")}
    assert got == want
    assert len(most) > 4 and max(most) < 120  # trees are of about 15 files
    assert not [name for _, _, names in os.walk(tmp_path / "t") for name in names]


def test_few_or_no_files_are_one_tree(spark, tmp_path):
    read = lambda root: S.scan_tree(spark, root).select("rel_path")
    one = spark.createDataFrame([("a/b.py", "x\n")], "rel_path string, content string")
    assert results.through_trees(one, str(tmp_path / "one"), read).collect() == [("a/b.py",)]
    assert (tmp_path / "one" / "a" / "b.py").read_text() == "x\n"
    assert results.through_trees(one.where("false"), str(tmp_path / "none"), read).collect() == []


def test_scan_of_no_folder(spark, tmp_path):
    with pytest.raises(SourceTreeError):
        S.scan_tree(spark, str(tmp_path / "none"))
    (tmp_path / "f.py").write_text("")
    with pytest.raises(SourceTreeError):
        S.scan_tree(spark, str(tmp_path / "f.py"))


def test_exclusion_by_part_and_prefix(spark):
    paths = {"tests/a.py": True, "a/test/b.py": True, "latest/a.py": False, "test_a.py": True,
             "a/conftest.py": True, "contest.py": False, "a/.venv/b.py": True}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select("p", S.is_excluded(F.col("p")).alias("x")).collect()
    assert {r.p: r.x for r in got} == paths


def test_facts_are_built_in_lots(monkeypatch):
    """No more than a lot of texts is held as Python objects, whatever the batch; long texts are lots of their own."""
    import pyarrow as pa

    monkeypatch.setattr(parse, "LOT_ROWS", 3)
    monkeypatch.setattr(parse, "LOT_BYTES", 50)
    held = []

    class Lots(type(pa)):
        def __getattr__(self, name):
            return getattr(pa, name)

        def array(self, values, *kind):
            held.append(len(values))
            return pa.array(values, *kind)

    monkeypatch.setattr(parse, "pa", Lots("pa"))
    texts = [None, "x", "", "y" * 60, "z" * 49, "zz", "a", None, None, "b", "é" * 40]
    got = parse._in_lots(pa.array(texts), lambda x: [x], pa.list_(pa.string()))
    assert got.to_pylist() == [None if x is None else [x] for x in texts]
    assert max(held) <= 3 and sum(held) == len(texts)
    sliced = pa.array(["q"] * 5 + texts).slice(5)
    assert parse._in_lots(sliced, lambda x: [x], pa.list_(pa.string())).to_pylist() == got.to_pylist()
    assert parse._in_lots(pa.array([], pa.string()), len, pa.int64()).to_pylist() == []
