"""Whitening against a dense eigendecomposition and exact whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import whitening
from codequarry.llm.queries import op11_whitening

SF = "/root/testdata/sf0.01"


def vectors(spark, rows, schema="vec_id long, embedding array<float>"):
    return spark.createDataFrame(rows, schema)


def plain(lists):
    """(fit list, dense covariance, eigenvalues falling, eigenvectors) of usable vectors."""
    width = max(map(len, lists))
    steps = [[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for v in lists]
    x = sorted(set(map(tuple, steps)))
    n, sums = len(x), [sum(col) for col in zip(*x)]
    c = (np.array(x, float) * n - np.array(sums, float)) / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    return steps, n, sums, values[::-1], turn[:, ::-1]


def test_query_equals_dense_decomposition(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    table = {r["vec_id"]: [float(c) for c in r["embedding"]] for r in table}
    ids = sorted(table)
    steps, n, sums, values, turn = plain([table[i] for i in ids])
    got = op11_whitening(spark, SF).toPandas()
    assert len(got) == 16 * len(ids) and set(got.n) == {n} and sorted(set(got.component)) == list(range(1, 17))
    far = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in zip(ids, steps)}
    assert dict(zip(got.vec_id, got.deviation)) == far
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    centred = np.array([[n * a - s for a, s in zip(x, sums)] for x in steps], float) / n
    plain_w = centred @ turn[:, :16] / np.sqrt(values[:16])
    sign = np.sign((plain_w * wide).sum(axis=0))
    assert np.abs(plain_w * sign - wide).max() < 1e-9
    shares = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(shares, values[:16] / values.sum(), rtol=1e-10)
    assert got.identity_error.max() < 1e-9


@pytest.mark.parametrize("spectrum", [
    np.linspace(40, 1, 90), np.r_[[1000.0, 999.0], np.full(88, 50.0)], np.r_[np.geomspace(1e6, 1e-3, 30), np.zeros(60)],
    50 + np.linspace(0.2, 0, 90), np.r_[np.full(40, 9.0), np.full(50, 1.0)],
])
def test_pairs_of_any_spectrum_are_certified(spectrum):
    """Steep, flat, tied and singular spectra: residuals at the level of rounding."""
    turn = np.linalg.qr(np.random.default_rng(3).standard_normal((90, 90)))[0]
    dense = (turn * spectrum) @ turn.T
    vectors_, values, worst = whitening.top_eigenpairs(lambda q: dense @ q, 90, 16)
    assert worst <= whitening.LOOSE
    assert np.allclose(values, np.sort(spectrum)[::-1][:16], rtol=0, atol=1e-9 * spectrum.max())
    assert np.abs(vectors_.T @ vectors_ - np.eye(16)).max() < 1e-12
    assert np.abs(dense @ vectors_ - vectors_ * values).max() <= 1e-10 * spectrum.max()


def odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 0.0, 0.0]), (5, [inf, 0.0, 0.0]),
        (6, [-inf, 1.0, 1.0]), (7, []), (8, [0.25]), (None, [3.0, 1.0, -1.0]), (9, [1.0, 2.0, 0.501]), (10, [-0.001, 0.0, 0.0]),
    ]
    return spark.createDataFrame(
        [(*r, "own", 1.5) for r in rows], "vec_id long, embedding array<float>, wh_values string, x double")


def test_odd_rows(spark):
    """Unusable vectors go; copies, short and empty vectors, null ids and clashing columns stay."""
    rows = odd_rows(spark)
    model = whitening.fit(rows)
    usable = [[1.0, 2.0, 0.5], [1.0, 2.0, 0.5], [], [0.25], [3.0, 1.0, -1.0], [1.0, 2.0, 0.501], [-0.001, 0.0, 0.0]]
    steps, n, sums, values, _ = plain(usable)
    assert model.n == n == 5 and model.sums.tolist() == [s - n * 1_000_000 for s in sums]
    assert np.allclose(model.values, values) and model.identity_error < 1e-9
    got = whitening.whitened(rows, model).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "10", "7", "8", "9", "None"]
    assert {r["x"] for r in got} == {1.5} and all(len(r["wh_values"]) == 3 for r in got)
    exact = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in steps]
    assert sorted(int(r["wh_deviation"]) for r in got) == sorted(exact)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    """Empty tables, empty vectors, one distinct vector: rows without components."""
    table = vectors(spark, rows)
    model = whitening.fit(table)
    assert len(model.values) == 0
    assert all(r["wh_values"] == [] and r["wh_deviation"] == 0 for r in whitening.whitened(table, model).collect())


def test_constant_dimensions_have_no_component(spark):
    table = vectors(spark, [(i, [float(i), 5.0, float(i % 3)]) for i in range(20)])
    model = whitening.fit(table)
    assert len(model.values) == 2 and model.identity_error < 1e-9


def test_huge_entries_stay_exact(spark):
    big = [(1, [1e30, 0.0]), (2, [-1e17, 3.0]), (3, [7.0, 1e9])]
    table = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    model = whitening.fit(table)
    edge = whitening.FARTHEST
    steps = [[edge, 0], [-64 * 10 ** 17, 192], [448, 64 * 10 ** 9]]
    assert [int(s) for s in model.sums] == [sum(col) for col in zip(*steps)]
    got = {r["vec_id"]: r["wh_deviation"] for r in whitening.whitened(table, model).collect()}
    exact = {i + 1: sum((3 * a - int(s)) ** 2 for a, s in zip(x, model.sums)) for i, x in enumerate(steps)}
    assert {i: (None if d is None else int(d)) for i, d in got.items()} == {i: (d if d < 10 ** 38 else None) for i, d in exact.items()}


def test_wide_vectors_and_copies(spark):
    """150 dimensions, a third of all rows one vector: the result of the distinct ones."""
    random = np.random.default_rng(5)
    some = [[float(v) for v in row] for row in random.standard_normal((400, 150)) * np.geomspace(8, 0.5, 150)]
    table = vectors(spark, [(i, v) for i, v in enumerate(some + [some[0]] * 200)]).repartition(7)
    model = whitening.fit(table)
    rounded = [[float(np.float32(c)) for c in v] for v in some]
    _, n, _, values, turn = plain(rounded)
    assert model.n == n == 400 and np.allclose(model.values, values[:16], rtol=1e-12)
    assert np.abs(np.abs((model.vectors * turn[:, :16]).sum(axis=0)) - 1).max() < 1e-10
    whole = whitening.whitened(table, model).select(F.size("wh_values").alias("k")).distinct().collect()
    assert [r["k"] for r in whole] == [16]
