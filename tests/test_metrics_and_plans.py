import os

import pytest
from pyspark.sql import functions as F

from codequarry.errors import CheckpointError
from codequarry.operators import metrics as M
from codequarry.plans import checkpoints as K, skew
from codequarry.sources.results import load_json, save_json, save_table
from codequarry.streaming.index_stream import read_index, stream_to_index


def issues(spark, rows):
    return spark.createDataFrame(
        rows, "seq int, type string, severity string, file string, confidence double")


def test_top_files_first_seen_breaks_ties(spark, rows):
    df = issues(spark, [(3, "t", None, "x/b.py", 0.9), (1, "t", "low", "y/c.py", None), (2, "t", "low", "x/a.py", 0.7),
                        (4, "t", "low", "z/a.py", 0.5), (5, None, "low", None, 0.49)])
    assert [tuple(r) for r in M.top_files(df, 3).collect()] == [("y/c.py", 1), ("x/a.py", 1), ("x/b.py", 1)]
    assert tuple(M.top_base_names(df, 1).first()) == ("a.py", 2)
    assert dict(rows(M.severity_counts(df))) == {"low": 4, "unknown": 1}
    assert dict(rows(M.type_counts(df))) == {"t": 4, "unknown": 1}
    assert dict(rows(M.confidence_buckets(df))) == {">=90%": 1, "70-89%": 1, "50-69%": 1, "<50%": 2}
    assert [r.seq for r in M.recent_issues(df, 3).collect()] == [3, 2, 4]


def test_empty_tables(spark):
    df = issues(spark, [])
    none = spark.createDataFrame([], "seq int, patch_source string, function string, file string, issue_type string, suggested_fix string")
    assert tuple(M.summary(df, df).first()) == (0, 0, 0.0)
    assert tuple(M.patch_metrics(df, none).first()) == (0, 0.0, 0, 0)
    full = df.withColumns({"function": F.lit("f"), "line_number": F.lit(1), "message": F.lit("m")})
    page = M.dashboard(df, full, none).first()
    assert page.has_results is False and page.top_files == []
    assert [b.bucket for b in page.conf_buckets] == [">=90%", "70-89%", "50-69%", "<50%"]


def test_spread_lookup_equals_join_with_a_hot_key(spark, rows):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left"):
        got = skew.spread_lookup(facts, lookup, ["k"], spread_by=["v"], how=how)
        assert rows(got, "k", "v", "w") == rows(facts.join(lookup, "k", how), "k", "v", "w")


def test_keep_last(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, n int, v string")
    assert rows(skew.keep_last(df, ["k"], F.col("n"))) == [("a", 3, "z"), ("b", 1, None)]


def test_cut_counts_while_writing(spark):
    df, n = K.cut_counted(spark.range(10), F.col("id") > 6)
    assert n == 3 and df.count() == 10
    assert K.cut_counted(spark.range(10).where("1 = 0"))[1] == 0


class Conf(dict):
    """Stands for the settings of a session on a cluster."""


def session_with(**settings):
    class Context:
        master, applicationId = "yarn", "app"
        getConf = staticmethod(lambda: Conf(settings))
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(settings), Context()

    return Session()


def test_shared_folder_is_taken_from_the_session():
    session = session_with(**{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert K.work_folder(session) == "hdfs:///shared/codequarry-app"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(CheckpointError):
        K.work_folder(session_with())


def test_results_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "type string, confidence double")
    save_json(df, str(tmp_path / "j"))
    save_table(df, str(tmp_path / "p"), "type")
    schema = "type string, confidence double"
    good, rejects = load_json(spark, str(tmp_path / "j"), schema)
    assert rows(good) == rows(df) and rejects.count() == 0
    assert rows(spark.read.parquet(str(tmp_path / "p")), "type", "confidence") == rows(df)
    assert load_json(spark, str(tmp_path / "none"), schema)[0].count() == 0
    (tmp_path / "array.json").write_text('[\n {"type": "x", "confidence": 0.5},\n {"type": "y"}\n]')
    (tmp_path / "broken.json").write_text("[ {")
    assert rows(load_json(spark, str(tmp_path / "array.json"), schema, array_file=True)[0]) == [("x", 0.5), ("y", None)]
    good, rejects = load_json(spark, str(tmp_path / "broken.json"), schema, array_file=True)
    assert good.count() == 0 and rejects.count() == 1
    (tmp_path / "lines.json").write_text('{"type": "x", "confidence": 0.5}\n{"type": "y", "confidence": "high"}\n{"ty')
    good, rejects = load_json(spark, str(tmp_path / "lines.json"), schema)
    assert rows(good) == [("x", 0.5)]
    assert sorted(r["_corrupt_record"] for r in rejects.collect()) == ['{"ty', '{"type": "y", "confidence": "high"}']


def test_index_from_a_stream(spark, tmp_path, rows):
    schema = ("repo string, chunk_id string, function_name string, file_path string, start_line int, "
              "code string, embedding array<float>")
    source, index = str(tmp_path / "in"), str(tmp_path / "index")

    def arrive(*data):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stream_to_index(stream, index, str(tmp_path / "cp")).awaitTermination()

    assert read_index(spark, index).count() == 0
    arrive(("r", "1", "f", "a.py", 1, "x", [1.0]), ("r", "2", "g", "a.py", 9, "y", None))
    arrive(("r", "1", "f", "a.py", 1, "changed", [2.0]), ("s", "3", "h", "b.py", 4, "z", [3.0]),
           ("s", "3", "h", "b.py", 5, "last", [4.0]))
    assert rows(read_index(spark, index), "repo", "chunk_id", "code", "start") == [
        ("r", "1", "x", "1"), ("s", "3", "last", "5")]


def test_stored_steps_can_be_removed(spark):
    step = K.cut(spark.range(5))
    folder = step.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    K.forget(step, spark.range(3))
    assert not os.path.exists(folder)
    K.forget(step)


def test_keep_last_wide_keeps_nulls(spark, rows):
    df = spark.createDataFrame(
        [("r", "a", None, None, "one"), ("r", "b", "f", None, "old"), ("r", "b", "f", 3, "last"), (None, "c", "f", 1, "no repo"),
         (None, "c", "e", 9, "earlier"), ("r", "c", "f", 1, "repo")],
        "repo string, chunk_id string, file_path string, start_line int, code string")
    got = skew.keep_last_wide(df, ["repo", "chunk_id"], ["file_path", "start_line"])
    assert rows(got, "repo", "chunk_id", "code") == sorted(
        [("r", "a", "one"), ("r", "b", "last"), (None, "c", "no repo"), ("r", "c", "repo")], key=repr)


def test_index_and_graph_keep_rows_with_nulls(spark, rows):
    from codequarry.operators import callgraph, neighbours, parse

    from .test_parse_and_chunks import as_files

    chunks = spark.createDataFrame(
        [("r", "a", "f", None, "g", "code", [1.0]), (None, "b", "f", 1, "g", "code", [1.0])],
        "repo string, chunk_id string, file_path string, start_line int, function_name string, code string, embedding array<double>")
    assert rows(neighbours.index_rows(chunks), "chunk_id", "start") == [("a", "0"), ("b", "1")]
    parsed = parse.parse_files(as_files(spark, {"/x/a.py": "def f():\n    return 1\n"})).withColumn("repo", F.lit(None).cast("string"))
    assert rows(callgraph.call_nodes(parsed), "repo", "name") == [(None, "f")]


def test_keep_last_wide_does_not_sort_wide_rows(spark, rows):
    """Equal orders are one row, a stored table is not stored again, and the text is in no
    aggregate and no sort."""
    df = spark.createDataFrame(
        [(k % 7, None if k % 11 == 0 else k % 5, f"text {k}") for k in range(500)], "k int, n int, code string")
    got = {r.k: r for r in skew.keep_last_wide(df, ["k"], ["n"]).collect()}
    assert len(got) == 7 and all(r.n == 4 and int(r.code[5:]) % 7 == k and int(r.code[5:]) % 5 == 4 for k, r in got.items())
    kept = K.cut(df)
    assert K.stored(kept) is kept and K.stored(df) is not df
    last = skew.keep_last_wide(kept, ["k"], ["n"], F.col("k") < 3)
    assert sorted(r.k for r in last.collect()) == [0, 1, 2]
    plan = last._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "first(" not in plan
    assert not [line for line in plan.splitlines() if ("Aggregate" in line or "Sort " in line) and "code" in line]
    assert skew.keep_last_wide(df.where("false"), ["k"], ["n"]).count() == 0
