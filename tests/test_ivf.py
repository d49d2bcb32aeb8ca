"""The inverted-file index against all products, and what a search reads."""

import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.operators import ivf, neighbours as N
from codequarry.plans.checkpoints import work_folder


def table(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<float>")


def clustered(n, width=12, centres=20, seed=2):
    random = np.random.default_rng(seed)
    middle = random.standard_normal((centres, width))
    return (middle[random.integers(0, centres, n)] + 0.25 * random.standard_normal((n, width))).astype(np.float32)


def built(spark, x, **how):
    return ivf.build(table(spark, x), f"{work_folder(spark)}/ivf-{uuid.uuid4().hex}", **how)


def queries(spark, x):
    return table(spark, x).withColumnRenamed("id", "query_id")


def hits(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["similarity"], 5)) for r in df.collect())


@pytest.fixture(scope="module")
def points():
    return clustered(900)


@pytest.fixture(scope="module")
def index(spark, points):
    return built(spark, points, cells=24)


def test_exact_search_equals_all_products(spark, points, index):
    some = queries(spark, points[:40])
    true = hits(N.nearest(some, table(spark, points), 7, packed=True))
    assert hits(index.search(some, 7, probes=2, exact=True)) == true
    assert hits(index.search(some, 7, probes=10 ** 6)) == true


def test_probes_reach_the_recall_that_is_asked_for(spark, points, index):
    some = queries(spark, points[::3])
    true = N.nearest(some, table(spark, points), 10, packed=True)
    probes = index.probes_for(0.95, 10)
    assert 1 <= probes < 12
    got = ivf.recall(index.search(some, 10, probes=probes), true).first()
    assert got["queries"] == 300 and got["neighbours"] == 3000 and got["found"] >= 2700


def test_scores_are_exact_and_rows_whole(spark, points, index):
    assert index.rows().count() == len(points)
    got = index.search(queries(spark, points[:5]), 4, probes=1).collect()
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    assert got and all(abs(unit[r["query_id"]] @ unit[r["id"]] - r["similarity"]) < 2e-6 for r in got)


def test_only_probed_cells_are_read(spark, points, index):
    probed = index._probed(index._asked(queries(spark, points[:1])), 2, False)
    wanted = {r["cell"] for r in probed.collect()}
    plan = index._hits(probed, 3)._jdf.queryExecution().toString()
    read = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert len(wanted) == 2 and any("cell" in p and all(str(c) in p for c in wanted) for p in read)


def test_large_cells_come_in_parts(spark, points, monkeypatch):
    monkeypatch.setattr(ivf, "PART_ROWS", 40)
    index = built(spark, points, cells=3)
    assert index.cells.agg(F.max("parts")).first()[0] > 3
    some = queries(spark, points[:20])
    assert hits(index.search(some, 5, exact=True)) == hits(N.nearest(some, table(spark, points), 5, packed=True))


def test_odd_vectors(spark):
    """Nulls, empty lists and other widths are left out; zero vectors and ties keep their order."""
    x = [[1, 0, 0], None, [0, 0, 0], [1, 0, 0], [], [0, 1, 0], [-1, 0, 0], [2, 0, 0], [1, 1]]
    index = built(spark, x, cells=3)
    usable = [(i, v) for i, v in enumerate(x) if v is not None and len(v) == 3]
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in usable], "id long, embedding array<float>")
    assert index.rows().count() == len(usable)
    got = hits(index.search(queries(spark, x), 4, probes=1, exact=True))
    assert got == hits(N.nearest(rows.withColumnRenamed("id", "query_id"), rows, 4, packed=True))


@pytest.mark.parametrize("x", [[], [None, []]])
def test_empty_index(spark, x):
    index = built(spark, x)
    assert index.search(queries(spark, [[1.0, 2.0]]), 3).count() == 0 and index.probes_for(0.9, 3) == 1


def test_string_ids(spark):
    rows = spark.createDataFrame([(f"c{i}", [float(i), 1.0]) for i in range(12)], "id string, embedding array<float>")
    index = ivf.build(rows, f"{work_folder(spark)}/ivf-{uuid.uuid4().hex}", cells=4)
    again = ivf.Index(spark, index.path, rows.schema["id"].dataType)
    got = again.search(rows.withColumnRenamed("id", "query_id"), 1, exact=True).collect()
    assert {r["query_id"] for r in got} == {f"c{i}" for i in range(12)} and all(r["similarity"] > 0.999 for r in got)
