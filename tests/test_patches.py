import random

from pyspark.sql import functions as F

from codequarry import fixed_values as fixed
from codequarry.operators import issues as I, patches as P


def clean_twin(text):
    text = text.strip()
    kept = "\n".join(x for x in text.splitlines() if not x.strip().startswith("```")).strip()
    return kept or text


def test_clean_response_matches_twin(spark):
    rng = random.Random(2)
    parts = ["```", "```python", " ``` ", "x = 1", "", "  y", "`a`"]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(0, 7))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", P.clean_response(F.col("t")).alias("c")).collect():
        assert r.c == clean_twin(r.t)


def test_response_check(spark):
    cases = {
        "def f():\n    return 1": True, "x = 1": False, "Use a list here instead": False,
        "  here's the fix you need": False, "def f(:\n    return 1": False,
        "def f():\n\treturn 1  # ok": True, "used = {1: 2, 3: 4}": True,
        "```\ndef f():\n    return 1\n```": True, "": False,
        "def a(self):\n    return 1\n  # dedent": True, "useful_name = [1, 2]": True,
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "response string")
    got = {r.response: r.is_valid for r in P.check_responses(df).collect()}
    assert got == {**cases, None: False}


def issue(spark, **values):
    base = dict.fromkeys(I.ISSUE_SCHEMA) | {
        "type": "eval_usage", "severity": "high", "function": "f", "file": "a.py",
        "line_number": 1, "file_line": 1, "code_snippet": "s", "chunk_id": "c", "message": "m"}
    base |= values
    schema = ", ".join(f"{k} {v}" for k, v in I.ISSUE_SCHEMA.items())
    return spark.createDataFrame([tuple(base[k] for k in I.ISSUE_SCHEMA)], schema)


def chunk_table(spark, *rows):
    return spark.createDataFrame(
        list(rows), "chunk_id string, function_name string, file_path string, start_line int, code string")


def test_last_chunk_wins_and_lost_issues_drop(spark):
    found = I.union(rules=issue(spark).unionByName(issue(spark, chunk_id="gone")),
                    taint=issue(spark, type="taint_flow", chunk_id="taint_a_b", code_snippet="def a"))
    chunks = chunk_table(spark, ("c", "old", "a.py", 1, "old"), ("c", "new", "b.py", 1, "new"))
    got = {r.chunk_id: (r.chunk_function, r.chunk_code) for r in P.with_chunks(found, chunks).collect()}
    assert got == {"c": ("new", "new"), "taint_a_b": ("f", "def a")}


def test_vectors_of_chunks_are_not_shuffled_for_issues(spark, monkeypatch):
    plans = []
    keep = P.keep_last_wide
    monkeypatch.setattr(P, "keep_last_wide", lambda df, *how: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, *how))
    chunks = chunk_table(spark, ("c", "old", "a.py", 1, "old")).withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>")).localCheckpoint()
    bare = chunk_table(spark, ("d", "bare", "a.py", 1, "bare")).withColumn("embedding", F.lit(None).cast("array<float>"))
    found = I.union(rules=issue(spark).unionByName(issue(spark, chunk_id="d")))
    got = {r.chunk_id: r.chunk_has_vector for r in P.with_chunks(found, chunks.union(bare)).collect()}
    assert got == {"c": True, "d": False}
    # The plan is read from the result down to the sources.
    assert 0 < plans[0].index("LeftSemi") < plans[0].index("size(")


def test_every_type_has_its_template(spark):
    for kind in [*fixed.PATCH_TEMPLATES, "dna_violation"]:
        work = P.with_chunks(I.union(rules=issue(spark, type=kind)), chunk_table(spark, ("c", "f", "a", 1, "x")))
        r = P.choose(work).first()
        assert r.patch_source == "rule_based" and "{" not in r.suggested_fix.replace("{'read'", "").replace("{user_input}", "")


def test_missing_values_in_templates(spark):
    chunks = chunk_table(spark, ("c", "f", "a", 1, "x"))

    def fix(**v):
        return P.choose(P.with_chunks(I.union(rules=issue(spark, **v)), chunks)).first().suggested_fix

    assert "'unknown' (score: N/A)" in fix(type="semantic_similarity_flag")
    assert "Taint path: source → sink" in fix(type="taint_flow")
    assert "(score: N/A)" in fix(type="statistical_anomaly")
    assert fix(type="dna_violation", subtype="docstring_coverage_violation").startswith(
        "Convention violation (docstring_coverage_violation):\nm\n")
    assert fix(type="other") == "No automated patch for 'other'. Manual review required."


def test_prompts(spark):
    work = P.with_chunks(
        I.union(rules=issue(spark).unionByName(issue(spark, type="taint_flow"))),
        chunk_table(spark, ("c", "fn", "d/a.py", 1, "code {message}")))
    only = P.prompts(work).collect()
    assert len(only) == 1
    assert "FUNCTION   : fn\n\nCODE TO FIX:\ncode {message}\n\nOUTPUT" in only[0].prompt
    similar = spark.createDataFrame(
        [("c", 2, "g", "b.py", 0.5, "x" * 500), ("c", 1, "h", "c.py", 0.985, "y")],
        "chunk_id string, n int, function string, file string, similarity double, code string")
    text = P.prompts(work, similar).first().prompt
    assert "Example 1 — h() in c.py (similarity: 98%):\n```python\ny\n```\n\nExample 2" in text
    assert "x" * 400 + "\n```\n\nRULES:" in text and "x" * 401 not in text
    assert "FILE     : a.py" in text


def test_union_order_and_ids(spark):
    found = I.union(taint=issue(spark, type="taint_flow"), rules=issue(spark).unionByName(issue(spark, line_number=2)))
    got = found.orderBy("seq").collect()
    assert [r.type for r in got] == ["eval_usage", "eval_usage", "taint_flow"]
    assert I.at_least(found, 0.1).count() == 0 and I.at_least(found, 0.0).count() == 3


def test_one_chunk_id_in_two_repos(spark):
    """Every join of chunks keeps the repositories apart."""
    from codequarry.operators import neighbours as N

    schema = "repo string, chunk_id string, function_name string, file_path string, start_line int, code string, embedding array<float>"
    both = spark.createDataFrame([
        ("r1", "c", "f", "a.py", 1, "one", [1.0, 0.0]), ("r2", "c", "f", "a.py", 1, "two", [0.0, 1.0]),
        ("r1", "d", "g", "a.py", 9, "near one", [0.9, 0.1]), ("r2", "d", "g", "a.py", 9, "near two", [0.1, 0.9])], schema)
    found = spark.createDataFrame([("r1", "i1", "c", "x"), ("r2", "i2", "c", "x")], "repo string, issue_id string, chunk_id string, type string").withColumns({
        "function": F.lit("f"), "file": F.lit("a.py"), "code_snippet": F.lit("")})
    assert {(r.issue_id, r.chunk_code) for r in P.with_chunks(found, both).collect()} == {("i1", "one"), ("i2", "two")}
    index = N.index_rows(both)
    assert {(r.repo, r.chunk_id, r.code) for r in index.collect()} == {
        ("r1", "c", "one"), ("r2", "c", "two"), ("r1", "d", "near one"), ("r2", "d", "near two")}
    assert N.new_rows(index, index.where("repo = 'r1'")).select("repo").distinct().collect()[0].repo == "r2"
    assert {(r.repo, r["rows"]) for r in N.index_size(index).collect()} == {(None, 4), ("r1", 2), ("r2", 2)}
    near = N.similar_functions(both.where("chunk_id = 'c'"), index, 1, within=("repo",)).collect()
    assert {(r.repo, r.chunk_id, r.code) for r in near} == {("r1", "c", "near one"), ("r2", "c", "near two")}
