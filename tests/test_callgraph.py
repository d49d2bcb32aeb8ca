import random

import pytest
from pyspark.sql import functions as F

from codequarry.operators import callgraph as G, parse

from .test_parse_and_chunks import as_files


def walk(graph, sinks, name, seen=(), path=()):
    """Depth-first search, call by call."""
    if name in seen:
        return []
    path = [*path, name]
    if name in sinks and len(path) > 1:
        return path
    for callee in graph.get(name, []):
        found = walk(graph, sinks, callee, {*seen, name}, path)
        if found:
            return found
    return []


def random_graphs(seed, count):
    """Many small graphs as one table, one per repo, cycles and self calls included."""
    rng = random.Random(seed)
    edges, nodes, want = [], [], set()
    for g in range(count):
        names = [f"n{i}" for i in range(rng.randint(2, 8))]
        graph = {
            n: [rng.choice(names + ["unknown"]) for _ in range(rng.randint(0, 4))] for n in names}
        sinks = {n for n in names if rng.random() < 0.2}
        sources = {n for n in names if rng.random() < 0.5}
        repo = f"g{g}"
        for n in names:
            nodes.append((repo, n, n in sources, n in sinks))
            edges += [(repo, n, c, i) for i, c in enumerate(graph[n])]
        for s in sources:
            path = walk(graph, sinks, s)
            if path:
                want.add((repo, s, tuple(path)))
    return edges, nodes, want


def tables(spark, edges, nodes):
    return (
        spark.createDataFrame(edges, "repo string, caller string, callee string, ordinal int"),
        spark.createDataFrame(nodes, "repo string, name string, is_source boolean, is_sink boolean"))


def paths_of(df):
    return {(r.repo, r.source, tuple(r.path)) for r in df.collect()}


def test_paths_equal_depth_first_search(spark):
    edges, nodes, want = random_graphs(11, 400)
    assert len(want) > 300
    assert paths_of(G.sink_paths(*tables(spark, edges, nodes))) == want


def test_paths_with_large_frontiers(spark, monkeypatch):
    """The same when no frontier counts as small."""
    from codequarry.plans import skew

    monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    edges, nodes, want = random_graphs(12, 60)
    assert paths_of(G.sink_paths(*tables(spark, edges, nodes))) == want


@pytest.mark.parametrize("small", [0, 200_000])
def test_rounds_of_the_search_are_not_written_again(spark, monkeypatch, small):
    """Along a loop of 12 calls a round finds one name; what is known is stored once in four rounds."""
    monkeypatch.setattr(G, "SMALL_ROWS", small, raising=False)
    monkeypatch.setattr(G, "MOST_ROUNDS", 4, raising=False)
    merged = []
    cut = G.cut
    monkeypatch.setattr(G, "cut", lambda df: merged.append(1) or cut(df))
    edges = [("r", f"n{i}", f"n{i - 1 if back else i + 1}", 1 - back) for i in range(12) for back in (0, 1) if i or not back]
    live = spark.createDataFrame(edges, "repo string, caller string, callee string, ordinal int").withColumn(
        "is_sink", F.col("callee") == "n12")
    got = G._search(live, spark.createDataFrame([("r", "n0")], "repo string, name string")).collect()
    assert [(r.source, list(r.path)) for r in got] == [("n0", [f"n{i}" for i in range(13)])]
    assert len(merged) <= 5


def test_search_alone_equals_depth_first_search(spark):
    edges, nodes, want = random_graphs(13, 150)
    e, n = tables(spark, edges, nodes)
    first = e.groupBy("repo", "caller", "callee").agg(F.min("ordinal").alias("ordinal"))
    live = G._live_edges(first, n)
    assert paths_of(G._search(live, n.where("is_source").select("repo", "name"))) == want


def test_no_sources_or_sinks(spark):
    e, n = tables(spark, [("r", "a", "b", 0)], [("r", "a", False, False), ("r", "b", False, True)])
    assert G.sink_paths(e, n).count() == 0
    e, n = tables(spark, [("r", "a", "b", 0)], [("r", "a", True, False), ("r", "b", False, False)])
    assert G.sink_paths(e, n).count() == 0


@pytest.mark.parametrize("partitions", ["1", "4", "64"])
def test_partition_count_does_not_matter(spark, partitions):
    edges, nodes, want = random_graphs(14, 20)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert paths_of(G.sink_paths(*tables(spark, edges, nodes))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


SOURCES = {
    "a.py": "def view(request):\n    x = request.args\n    helper(x)\n    other.save(x)\n\n\n"
            "def helper(x):\n    return clean(x)\n",
    "b.py": "def save(x):\n    cursor.execute(x)\n\n\ndef helper(x):\n    return lookup(x)\n",
    "a-b.py": "def save(x):\n    return x\n",
}


def test_taint_from_source_text(spark):
    parsed = parse.parse_files(as_files(spark, SOURCES))
    nodes, edges = G.call_nodes(parsed), G.call_edges(parsed)
    by = {r.name: r for r in nodes.collect()}
    # Files come in path order (r/a-b.py, r/a.py, r/b.py): the last definition counts.
    assert by["save"].file_path == "r/b.py" and by["helper"].file_path == "r/b.py"
    assert by["save"].is_sink and by["view"].is_source and not by["helper"].is_sink
    paths = G.sink_paths(edges, nodes)
    assert paths_of(paths) == {("r", "view", ("view", "save"))}
    issue = G.taint_issues(paths, nodes).first()
    assert issue.chunk_id == "taint_view_save" and issue.taint_path == "view → save"
    assert issue.sink_file == "r/b.py" and issue.sink_line == 1 and issue.file == "r/a.py"
    assert "via 1 call(s): view → save." in issue.message
    assert tuple(G.counters(nodes, paths).first()) == (1, 1, 1)
