"""Generations of a changing index against a dictionary kept by hand."""

import uuid

import pytest
from pyspark.sql import functions as F

from codequarry.plans.checkpoints import work_folder
from codequarry.streaming import changing_index as C

SCHEMA = "repo string, chunk_id string, code string, embedding array<float>, function_name string, file_path string, start_line int"


def chunks(spark, rows):
    return spark.createDataFrame([(repo, c, code, [1.0, 2.0], "f", "a.py", 1) for repo, c, code in rows], SCHEMA)


def now(spark, path, **which):
    return sorted(((r["repo"], r["chunk_id"], r["code"]) for r in C.read(spark, path, **which).collect()), key=repr)


def counts(df):
    return {(r["repo"], r["change"]): r["rows"] for r in df.collect()}


@pytest.fixture
def path(spark):
    return f"{work_folder(spark)}/changing-{uuid.uuid4().hex}"


def test_changed_new_gone_and_replayed(spark, path):
    assert now(spark, path) == []
    C.apply(chunks(spark, [("a", "1", "x"), ("a", "2", "y"), ("b", "1", "z"), (None, "9", "n")]), path, 1)
    first = [("a", "1", "x"), ("a", "2", "y"), ("b", "1", "z"), (None, "9", "n")]
    assert now(spark, path) == sorted(first, key=repr)
    second = chunks(spark, [("a", "1", "x2"), ("a", "3", "w")])
    for _ in range(2):
        assert counts(C.apply(second, path, 2, whole=True)) == {("a", "changed"): 1, ("a", "new"): 1, ("a", "gone"): 1}
    held = [("a", "1", "x2"), ("a", "3", "w"), ("b", "1", "z"), (None, "9", "n")]
    assert now(spark, path) == sorted(held, key=repr)
    assert C.generations(spark, path).count() == 7  # four, two and a tombstone, the replay once
    # A chunk may come back, and a batch that is not whole takes nothing away.
    assert counts(C.apply(chunks(spark, [("a", "2", "y"), (None, "9", "n")]), path, 3)) == {("a", "new"): 1, (None, "same"): 1}
    held.append(("a", "2", "y"))
    assert now(spark, path) == sorted(held, key=repr) and now(spark, path, repos=["b"]) == [("b", "1", "z")]
    C.compact(spark, path)
    assert now(spark, path) == sorted(held, key=repr) and C.generations(spark, path).count() == len(held)
    C.drop_old_bases(spark, path)
    assert counts(C.apply(chunks(spark, [("b", "1", "z"), ("b", "2", "q")]), path, 4)) == {("b", "same"): 1, ("b", "new"): 1}
    assert now(spark, path) == sorted([*held, ("b", "2", "q")], key=repr)


def test_unchanged_batch_writes_nothing(spark, path):
    rows = chunks(spark, [("a", str(i), "x") for i in range(20)])
    C.apply(rows, path, 1)
    C.apply(rows, path, 2)
    assert C.generations(spark, path).select("generation").distinct().collect() == [(1,)]


def test_nulls_and_repeated_ids(spark, path):
    rows = [("a", None, "x"), ("a", "1", None), ("b", "1", "old"), ("b", "1", "old")]
    C.apply(chunks(spark, rows), path, 1)
    C.apply(chunks(spark, []), path, 2)
    assert now(spark, path) == [("a", "1", ""), ("b", "1", "old")]
    no_vector = chunks(spark, [("c", "1", "x")]).withColumn("embedding", F.lit(None).cast("array<float>"))
    C.apply(no_vector, path, 3)
    assert now(spark, path, repos=["c"]) == []


def test_a_batch_reads_its_repositories_only(spark, path):
    C.apply(chunks(spark, [(f"r{i}", "1", "x") for i in range(5)]), path, 1)
    repos = chunks(spark, [("r3", "1", "x")]).select("repo")
    plan = C._of_repos(C.generations(spark, path), repos)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "r3" in plan.split("PartitionFilters")[1].split("]")[0]


def test_many_repositories_are_joined(spark, path, monkeypatch):
    monkeypatch.setattr(C, "MOST_NAMED", 2)
    rows = chunks(spark, [(r, "1", "x") for r in ("a", "b", "c", None)])
    C.apply(rows, path, 1)
    assert counts(C.apply(rows, path, 2)) == {(r, "same"): 1 for r in ("a", "b", "c", None)}


def test_stream(spark, path):
    folder = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    for n, batch in enumerate([[("a", "1", "x")], [("a", "1", "y"), ("a", "2", "z")]]):
        chunks(spark, batch).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = C.stream(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), path, f"{folder}/checkpoint")
        query.awaitTermination()
    assert now(spark, path) == [("a", "1", "y"), ("a", "2", "z")]
