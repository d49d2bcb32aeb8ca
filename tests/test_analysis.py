import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from codequarry.config import AnalysisConfig
from codequarry.plans import analysis as A
from codequarry.streaming.index_stream import read_index

from .test_parse_and_chunks import make_tree
from .test_rules import SAMPLE

VIEW = """def view(request):
    x = request.args
    y = 1
    save_all(x)


def save_all(x):
    y = 2
    cursor.execute(x)
"""


def test_whole_run(spark):
    # The word "test" anywhere in a path marks a chunk as not production.
    tmp_path = Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    make_tree(tmp_path)
    (tmp_path / "pkg" / "sample.py").write_text(SAMPLE)
    (tmp_path / "pkg" / "view.py").write_text(VIEW)
    (tmp_path / "pkg" / "broken.py").write_text("def f(:\n")
    for i in range(12):
        (tmp_path / "pkg" / f"m{i}.py").write_text(f"def do_it{i}(a):\n    b = a\n    return b\n")
    files, rejects = A.read_tree(spark, str(tmp_path), "demo")
    assert [r.rel_path for r in rejects.collect()] == ["pkg/bad.py"]
    lines = spark.createDataFrame(
        [("pkg/sample.py", 1, 99, "c0ffee0000", 1, 5, "Ann", "a@b", 86_400, "start")],
        "file string, line_from int, line_to int, commit_id string, committed_at int, "
        "commit_seq long, author string, author_mail string, ts_epoch long, summary string")
    versions = spark.createDataFrame([("pkg/sample.py", 4, "before\n" * 30)], "file string, seq long, content string")
    first = A.analyze(files)
    prompts = first["prompts"].collect()
    assert len(prompts) == 2 and {p.kind for p in prompts} <= {"standard", "retrieval"}
    responses = spark.createDataFrame(
        [(p.issue_id, "# fix: x\ndef fixed(items=None):\n    return items", p.kind) for p in prompts[:1]],
        "issue_id string, response string, kind string")
    runs = spark.createDataFrame([(p.issue_id, "3 passed", "") for p in prompts], "issue_id string, stdout string, stderr string")
    base = spark.createDataFrame([("demo", "3 passed", "")], "repo string, stdout string, stderr string")
    out = A.analyze(files, AnalysisConfig(), A.Inputs(
        responses=responses, line_history=lines, versions=versions, as_of=86_400 * 3,
        root=str(tmp_path), baselines=base, test_runs=runs))

    issues = out["issues"].orderBy("seq").collect()
    kinds = {r.type for r in issues}
    assert {"mutable_default_argument", "bare_except_swallow", "taint_flow"} <= kinds
    assert [r.seq.stage for r in issues] == sorted(r.seq.stage for r in issues)
    told = [r for r in issues if r.type == "bare_except_swallow"][0]
    assert told.archaeology.author == "Ann" and told.archaeology.code_before.startswith("before\nbefore")
    assert told.file_line == told.line_number + 10
    assert [r.rel_path for r in out["parse_errors"].collect()] == ["pkg/broken.py"]
    patches = {r.issue_id: r for r in out["patches"].collect()}
    chosen = patches[prompts[0].issue_id]
    assert chosen.patch_source.startswith("llamacpp") and chosen.verification.verified
    assert len(patches) == len(issues)
    total = out["summary"].first()
    assert total.total_issues == len(issues)
    assert out["dashboard"].first().total_patches == len(patches)
    # Same files, same ids.
    assert {p.issue_id for p in prompts} <= set(patches)
    per_repo = A.analyze(files, per_repo=True)
    count = lambda t: sorted(map(tuple, t.groupBy("type").count().collect()))
    assert count(per_repo["issues"]) == count(first["issues"])
    saved = A.save(out, str(tmp_path / "out"), "issues", "index", "patches", "call_nodes")
    assert saved["issues"]["rows"] == len(issues) and saved["issues"]["high"] == sum(r.severity == "high" for r in issues)
    stories = sum(bool(r.archaeology and r.archaeology.investigated) for r in issues)
    assert saved["issues"]["with_history"] == stories >= out["history_counters"].first()["investigated"] > 0
    assert {k: saved["patches"][k] for k in ("verified", "rejected", "unverifiable")} == out["verification_counters"].first().asDict()
    flows = out["taint_counters"].first()
    assert (saved["call_nodes"]["sources"], saved["call_nodes"]["sinks"]) == (flows.sources, flows.sinks)
    assert spark.read.parquet(str(tmp_path / "out" / "issues")).count() == len(issues)
    assert read_index(spark, str(tmp_path / "out" / "index")).where(F.col("repo") == "demo").count() > 0
