import numpy as np
import pytest
from pyspark.sql import functions as F, types as t

from codequarry.functions.vectors import cosine
from codequarry.operators import embeddings, neighbours as N, outliers as O
from codequarry.config import AnalysisConfig
from codequarry.plans.quantile import exact_quantile

VEC = t.ArrayType(t.FloatType())


def table(spark, vectors, **columns):
    data = [
        (i, *[c[i] for c in columns.values()], None if v is None else [float(x) for x in v])
        for i, v in enumerate(vectors)
    ]
    schema = t.StructType(
        [t.StructField("id", t.LongType())]
        + [t.StructField(k, t.StringType()) for k in columns]
        + [t.StructField("embedding", VEC)])
    return spark.createDataFrame(data, schema)


def brute(q, x, k, same=None):
    """(query, id, similarity, rank) by plain matrix arithmetic."""
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    s = np.round(unit(q) @ unit(x).T, 6)
    out = []
    for i in range(len(q)):
        ids = [j for j in range(len(x)) if same is None or same(i, j)]
        ids.sort(key=lambda j: (-s[i, j], j))
        out += [(i, j, s[i, j], r + 1) for r, j in enumerate(ids[:k])]
    return out


def vectors(n, d, seed):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32).astype(np.float64)
    x[n // 2] = 0
    x[n // 3:n // 3 + 5] = x[0]  # equal rows: ties by id
    return x


def same_hits(df, want):
    got = sorted((r.query_id, r.id, round(r.similarity, 6), r["rank"]) for r in df.collect())
    want = sorted((a, b, round(float(c), 6), d) for a, b, c, d in want)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


@pytest.mark.parametrize("packed", [None, True])
def test_nearest_equals_brute_force(spark, packed, monkeypatch):
    monkeypatch.setattr(N, "PACK_ROWS", 7)
    q, x = vectors(40, 8, 1), vectors(150, 8, 2)
    df = N.nearest(table(spark, q).withColumnRenamed("id", "query_id"), table(spark, x), 5,
                   packed=packed)
    same_hits(df, brute(q, x, 5))


def test_nearest_within_groups_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(N, "PACK_ROWS", 16)
    x = vectors(240, 6, 3)
    group = ["hot" if i % 3 else f"g{i % 20}" for i in range(240)]
    df = table(spark, x, repo=group)
    out = N.nearest(df.withColumnRenamed("id", "query_id"), df, 4, within=("repo",))
    same_hits(out, brute(x, x, 4, lambda i, j: group[i] == group[j]))


def test_few_rows_leave_the_tasks(spark, monkeypatch):
    """k rows per query and block of the index, however many packs there are."""
    monkeypatch.setattr(N, "PACK_ROWS", 5)
    monkeypatch.setattr(N, "BLOCK_ROWS", 60)
    x = vectors(240, 6, 5)
    group = ["hot" if i % 4 else f"g{i % 20}" for i in range(240)]
    df = table(spark, x, repo=group)
    queries = df.withColumnRenamed("id", "query_id")
    # 180 rows in 3 blocks; five groups of 12 rows in one each.
    assert N._packed_hits(queries, df, 2, ["repo"]).count() == 180 * 3 * 2 + 60 * 2
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4)
    assert N._packed_hits(queries, df, 2, []).count() <= 240 * blocks * 2
    out = N.nearest(queries, df, 2, within=("repo",))
    same_hits(out, brute(x, x, 2, lambda i, j: group[i] == group[j]))


def test_packs_are_not_copied_for_the_pairs_they_are_in(spark, monkeypatch):
    """Without keys k rows per query and part of the index leave the tasks, whatever the number of shuffle
    partitions, and either side is dealt out once."""
    x = vectors(240, 6, 5)
    df = table(spark, x)
    queries = df.withColumnRenamed("id", "query_id")
    assert N._packed_hits(queries, df, 2, []).count() == 240 * 2
    plan = N._packed_hits(queries, df, 2, [])._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "explode" not in plan
    monkeypatch.setattr(N, "INDEX_PART_BYTES", 2_000)  # 240 rows of 24 bytes: three parts
    monkeypatch.setattr(N, "PACK_ROWS", 16)
    assert N._packed_hits(queries, df, 2, []).count() == 240 * 3 * 2
    same_hits(N.nearest(queries, df, 3, packed=True), brute(x, x, 3))


def test_packs_keep_types_and_repeated_ids(spark, monkeypatch):
    """Ids as text, queries in double, an id twice among the queries, equal index rows."""
    monkeypatch.setattr(N, "PACK_ROWS", 16)
    monkeypatch.setattr(N, "INDEX_PART_BYTES", 1_000)
    x = vectors(90, 5, 31)
    index = table(spark, x).withColumn("id", F.format_string("%03d", "id"))
    asked = table(spark, x[:40]).select(
        (F.col("id") % 39).alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    got = {(r.query_id, r["rank"]): (r.id, round(r.similarity, 6)) for r in N.nearest(asked, index, 3, packed=True).collect()}
    hits = brute(x[:40], x, 3)
    for q in range(39):
        own = sorted((-s, i) for a, i, s, _ in hits if a % 39 == q)[:3]
        assert [got[q, n + 1] for n in range(3)] == [(f"{i:03d}", round(float(-s), 6)) for s, i in own]
    assert len(got) == 39 * 3


def test_single_precision_hides_no_neighbour():
    """Scores that differ in the sixth digit only, many ties, and more rows than go on at first."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((3, 40))
    rows = N._unit_rows(centre[rng.integers(0, 3, 900)] + 2e-4 * rng.standard_normal((900, 40)))
    rows[500:560] = rows[20]
    ids = rng.permutation(900)
    units = N._unit_rows(centre.repeat(100, axis=0) + 1e-3 * rng.standard_normal((300, 40)))
    kept = []
    for begin, end in ((0, 70), (70, 71), (71, 600), (600, 900)):
        N._better(kept, units, rows[begin:end], ids[begin:end], 5)
    scores = np.round(units @ rows.T, N.SCORE_DIGITS)
    best = N._best(scores, ids, 5)
    got, got_ids = N._together(kept)
    assert (got_ids == ids[best]).all() and (got == np.take_along_axis(scores, best, 1)).all()


def test_rows_of_no_group_match_none(spark):
    x = vectors(30, 4, 11)
    group = [None if i % 3 == 0 else "a" for i in range(30)]
    df = table(spark, x, repo=group)
    out = N.nearest(df.withColumnRenamed("id", "query_id"), df, 3, within=("repo",))
    same_hits(out, [h for h in brute(x, x, 3, lambda i, j: group[i] == group[j] == "a")])


def test_best_columns_are_those_of_a_full_sort():
    rng = np.random.default_rng(12)
    for n, k in ((1, 3), (7, 7), (50, 4)):
        scores = np.round(rng.choice([-1.0, 0.25, 0.5, 1.0, np.nan], (9, n)), 6)
        ids = rng.permutation(n) * 3 - 5
        want = [sorted(range(n), key=lambda j: (-np.nan_to_num(row[j], nan=-2.0), ids[j]))[:k] for row in scores]
        assert N._best(scores, ids, k).tolist() == want


def test_products_are_bounded_and_keep_the_best(monkeypatch):
    """Pack by pack, a lot of queries at a time: ties by smaller id, rows that are no number, few index rows at first."""
    monkeypatch.setattr(N, "PRODUCT_ROWS", 7, raising=False)
    widest = []
    running = N._running
    monkeypatch.setattr(N, "_running", lambda kept, scores, ids, k: widest.append(len(scores)) or running(kept, scores, ids, k))
    rng = np.random.default_rng(4)
    units = N._unit_rows(rng.integers(-2, 3, (30, 3)))
    units[5] = np.nan
    ids = rng.permutation(200).astype(np.int64)
    rows = N._unit_rows(rng.integers(-2, 3, (200, 3)))
    rows[17] = np.nan
    kept = []
    for begin, end in ((0, 2), (2, 3), (3, 90), (90, 200)):
        N._better(kept, units, rows[begin:end], ids[begin:end], 4)
    scores = np.round(units @ rows.T, N.SCORE_DIGITS)
    best = N._best(scores, ids, 4)
    got, got_ids = N._together(kept)
    real = [n for n in range(30) if n != 5]
    assert (got_ids[real] == ids[best][real]).all() and np.isnan(got[5]).all()
    assert (got[real] == np.take_along_axis(scores, best, 1)[real]).all()
    assert max(widest) <= 7
    widest.clear()
    N._better(kept, units, np.zeros((9, 3)), np.arange(1000, 1009), 4)
    assert sum(widest) < 15  # others have four better ones


def test_hashed_search_finds_most_and_scores_exactly(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((20, 16)).repeat(15, axis=0)
    x = (centre + 0.1 * rng.standard_normal(centre.shape)).astype(np.float32).astype(float)
    df = table(spark, x)
    out = N.nearest(df.withColumnRenamed("id", "query_id"), df, 3, tables=8, bits=4)
    exact = {(a, b): c for a, b, c, _ in brute(x, x, 3)}
    got = {(r.query_id, r.id): r.similarity for r in out.collect()}
    found = set(exact) & set(got)
    assert len(found) / len(exact) > 0.9
    assert all(abs(exact[k] - got[k]) < 2e-6 for k in found)


def test_partitioning_does_not_change_neighbours(spark):
    x = vectors(60, 5, 6)
    results = []
    for n in (1, 16):
        df = table(spark, x).repartition(n)
        out = N.nearest(df.withColumnRenamed("id", "query_id"), df, 3)
        results.append(sorted(map(tuple, out.collect())))
    assert results[0] == results[1]


def test_best_pattern_both_ways(spark, monkeypatch):
    p, x = vectors(12, 6, 7), vectors(50, 6, 8)
    p[9] = p[4]
    patterns = table(spark, p).select(F.col("id").cast("int").alias("ord"), "embedding")
    chunks = table(spark, x).withColumnRenamed("id", "chunk_id")
    want = [(a, b) for a, b, _, _ in brute(x, p, 1)]
    got = sorted((r.chunk_id, r.best_ord) for r in N.best_pattern(chunks, patterns).collect())
    assert got == want
    monkeypatch.setattr(N, "SMALL_LIBRARY_ROWS", 3)
    got = sorted((r.chunk_id, r.best_ord) for r in N.best_pattern(chunks, patterns).collect())
    assert got == want


def test_rows_without_vector_are_skipped(spark):
    df = table(spark, [[1.0, 0.0], None, [], [0.0, 1.0]])
    out = N.nearest(df.withColumnRenamed("id", "query_id"), df, 5)
    assert {(r.query_id, r.id) for r in out.collect()} == {(0, 0), (0, 3), (3, 0), (3, 3)}


def test_cosine_expression(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got[1] == 0.0 and abs(got[0] - 0.5 ** 0.5) < 1e-12


def test_similar_functions_drop_own_name_after_the_cut(spark):
    df = table(spark, [[1, 0], [1, 0.01], [1, 0.02], [1, 0.5]], function_name=["f", "f", "g", "h"])
    chunks = df.select(F.col("id").cast("string").alias("chunk_id"), "function_name", "embedding",
                       F.lit("d/a.py").alias("file_path"), F.lit(1).alias("start_line"),
                       F.lit("code").alias("code"))
    out = N.similar_functions(chunks.where("chunk_id = '0'"), N.index_rows(chunks), 1)
    # The two nearest are rows 0 and 1, both named f: nothing is left.
    assert out.count() == 0
    out = N.similar_functions(chunks.where("chunk_id = '0'"), N.index_rows(chunks), 2)
    assert [(r.function, r.file, r.n) for r in out.collect()] == [("g", "a.py", 1)]


def test_index_rows_shuffle_vectors_only_where_ids_repeat(spark):
    x = [(i, f"f{i}", f"{i}.py", 1, f"code {i}", [1.0, float(i)]) for i in range(50)]
    columns = "chunk_id long, function_name string, file_path string, start_line int, code string, embedding array<double>"
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    once = N.index_rows(spark.createDataFrame(x, columns))
    assert "Join" not in plan(once) and sorted(r.code for r in once.collect()) == sorted(r[4] for r in x)
    twice = N.index_rows(spark.createDataFrame([*x, (7, "f7", "7.py", 9, "later", [2.0, 7.0]), (8, "f8", "8.py", 0, "earlier", [2.0, 8.0])], columns))
    assert "Join" in plan(twice)
    assert sorted(r.code for r in twice.collect()) == sorted([*(r[4] for r in x if r[0] != 7), "later"])


def test_encoder_failures_lose_the_vector_only(spark):
    def make():
        def encode(texts):
            if any("bad" in x for x in texts):
                raise RuntimeError("no")
            return np.array([[len(x), 1.0] for x in texts])
        return encode

    df = spark.createDataFrame([("a",), ("bad",), (None,), ("ccc",)], "code string")
    got = {r.code: r.embedding for r in embeddings.embed_with(df, make).collect()}
    assert got == {"a": [1.0, 1.0], "bad": None, None: None, "ccc": [3.0, 1.0]}


def test_batch_inference_equals_the_plain_encoder(spark):
    def make():
        def encode(texts):
            if len(texts) > 4:
                raise AssertionError("batches are of four texts at most")
            if any("bad" in x for x in texts):
                raise RuntimeError("no")
            return np.array([[len(x), np.nan if x == "odd" else 1.0] for x in texts])
        return encode

    texts = ["a", "bad", None, "ccc", "odd", ""] + [f"t{i}" for i in range(30)] + ["bad again"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, code string").repartition(3)
    got = {r.id: r.embedding for r in embeddings.embed_in_batches(df, make, batch_size=4).collect()}
    want = [None if x is None or "bad" in x or x == "odd" else [float(len(x)), 1.0] for x in texts]
    assert [got[i] for i in range(len(texts))] == want
    assert embeddings.embed_in_batches(df.limit(0), make).collect() == []


def outlier_chunks(spark, n=200, partitions=4):
    x = np.random.default_rng(9).standard_normal((n, 6))
    x[:4] += 12
    df = table(spark, x)
    return df.select(
        F.format_string("c%04d", "id").alias("chunk_id"), F.lit("f").alias("function_name"),
        F.lit("a.py").alias("file_path"), F.lit(1).alias("start_line"),
        F.lit("x\ny").alias("code"), "embedding").repartition(partitions)


def test_planted_outliers_rank_first_and_share_is_kept(spark):
    got = O.flag(outlier_chunks(spark)).orderBy("anomaly_score").collect()
    assert {r.chunk_id for r in got[:4]} == {f"c{i:04d}" for i in range(4)}
    assert abs(len(got) - 10) <= 1
    assert all(abs(r.confidence - min(1, -2 * r.anomaly_score)) < 2e-3 for r in got)


def test_forest_does_not_depend_on_partitioning(spark):
    runs = []
    for n in (1, 7):
        rows = O.flag(outlier_chunks(spark, partitions=n)).collect()
        runs.append(sorted((r.chunk_id, r.anomaly_score) for r in rows))
    assert runs[0] == runs[1]


def test_two_seeds_agree_on_order(spark):
    chunks = outlier_chunks(spark)
    scores = []
    for seed in (1, 2):
        forest = O.fit(chunks, AnalysisConfig(forest_seed=seed))
        got = {r.chunk_id: r.score for r in O.score(chunks, forest).collect()}
        scores.append([got[k] for k in sorted(got)])
    ranks = [np.argsort(np.argsort(s)) for s in scores]
    assert np.corrcoef(*ranks)[0, 1] > 0.8


def test_too_few_rows_give_no_forest(spark):
    assert O.flag(outlier_chunks(spark, n=9)) is None


def test_sampled_pool(spark):
    """More rows than the trees can take: the sample is drawn by hash."""
    chunks = outlier_chunks(spark, n=600)
    forest = O.fit(chunks, AnalysisConfig(forest_trees=5, forest_sample=32))
    assert forest.feature.shape == (5, 63) and forest.sample == 32


def test_draws_are_the_smallest_of_all_rows(spark):
    """Each tree grows from the rows with the smallest draws, however they are partitioned."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "=hot").otherwise(F.concat(F.lit("=r"), F.col("id") % 40)).alias("g"),
        F.col("id").cast("string").alias("id"), F.xxhash64("id", F.lit(1)).alias("h"))
    kept = []
    for n in (1, 9):
        drawn = O._smallest_draws(rows.repartition(n, "id"), 4, 16).toPandas()
        best = drawn.sort_values(["draw", "id"]).groupby(["g", "tree"]).head(16)
        kept.append(sorted(map(tuple, best.to_numpy().tolist())))
    assert kept[0] == kept[1]
    assert {len(part) for _, part in best.groupby(["g", "tree"])} == {16}


def test_every_repository_has_its_own_forest(spark, monkeypatch):
    """The rows of a repository get the scores they get alone; small ones get none; forests may travel."""
    chunks = outlier_chunks(spark, n=300)
    number = F.substring("chunk_id", 2, 9).cast("int")
    chunks = chunks.withColumn("repo", F.when(number < 5, "tiny").when(number % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("r"), number % 3)))
    config = AnalysisConfig(forest_trees=12, forest_sample=32)

    def flagged(df, **how):
        got = O.flag(df, config, **how)
        return sorted(((r.repo, r.chunk_id, r.anomaly_score) for r in got.collect()), key=repr)

    all_at_once = flagged(chunks)
    alone = flagged(chunks.where("repo = 'r1'")) + flagged(chunks.where("repo = 'r2'")) + flagged(chunks.where("repo is null"))
    assert all_at_once == sorted(alone, key=repr) and "tiny" not in {r[0] for r in all_at_once}
    monkeypatch.setattr(O, "MOST_FOREST_BYTES", 0)
    monkeypatch.setattr(O, "SCORE_ROWS", 20)
    assert flagged(chunks) == all_at_once
    assert len(flagged(chunks, per_repo=False)) == 15


def test_quantile_by_group(spark):
    from codequarry.plans.quantile import quantile_by

    rng = np.random.default_rng(8)
    x = {"a": rng.standard_normal(500), "b": rng.choice([-3.0, 0.5, 2.0], 77), "c": np.array([1.25]), "d": rng.standard_normal(2) * 9}
    df = spark.createDataFrame([(k, float(v)) for k, some in x.items() for v in some] + [("e", None)], "k string, x double").cache()
    for share in (0.0, 0.05, 0.37, 1.0):
        got = {r["k"]: r["quantile"] for r in quantile_by(df, "k", "x", share, -2.0, 2.0, bins=7).collect()}
        assert set(got) == set(x)
        assert all(got[k] == pytest.approx(np.percentile(some, share * 100), rel=1e-12) for k, some in x.items())


@pytest.mark.parametrize("seed", range(6))
def test_exact_quantile(spark, seed, monkeypatch):
    from codequarry.plans import quantile

    monkeypatch.setattr(quantile, "_BINS", 5)
    monkeypatch.setattr(quantile, "_FEW", 8)
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 300))
    x = rng.choice(rng.standard_normal(40), n) if seed % 2 else rng.standard_normal(n) ** 9
    df = spark.createDataFrame([(float(v),) for v in x], "x double").cache()
    for share in (0.0, 0.05, 0.5, 1.0):
        assert exact_quantile(df, "x", share) == pytest.approx(np.percentile(x, share * 100), rel=1e-12)
