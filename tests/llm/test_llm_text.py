"""Scoring operators: quality, toxicity, language."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import language, quality, text, toxicity, trees
from codequarry.llm.queries import op1_toxicity, op5_language, op9_quality

SF = "/root/testdata/sf0.01"
#: Labels are few: in smaller tables there are about ten toxic ones in a language.
LABELLED = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, score double, language string"


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, columns with the operators' own names."""
    rows = [
        (1, None, None, None, 0.5, None), (2, "", "en", "s", None, "x"), (None, "no id here", "en", None, 1.0, "x"),
        (3, "same row", "de", "s", 2.0, "x"), (3, "same row", "de", "s", 2.0, "x"), (4, "wort " * 20_000, "de", "s", 3.0, None),
        (5, "12 34 !!", None, "s", 3.0, None), (6, "\U0001f600 é́ \x00", "fr", "s", 3.0, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def test_spans_hash_by_content():
    data = np.frombuffer(b"abc abd abc", np.uint8)
    starts, ends = text.token_bounds((~text.SPACE[data]).astype(np.uint8), np.array([0, 11]))
    h = text.SpanHash(data)(starts, ends)
    assert h[0] == h[2] != h[1]


def test_tokens_do_not_cross_texts():
    data = np.frombuffer(b"abcd", np.uint8)
    starts, ends = text.token_bounds(np.ones(4, np.uint8), np.array([0, 2, 2, 4]))
    assert list(zip(starts, ends)) == [(0, 2), (2, 4)]


def test_pieces_cover_all_rows():
    offsets = np.array([0, 0, 5, 25, 26, 26, 40])
    parts = list(text.pieces(np.zeros(40, np.uint8), offsets, 10))
    assert parts[0][0] == 0 and parts[-1][1] == 6
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def auc(scores, labels):
    order = scores.rank()
    ones, zeros = (labels == 1).sum(), (labels == 0).sum()
    return (order[labels == 1].sum() - ones * (ones + 1) / 2) / ones / zeros


@pytest.mark.parametrize("run,label,sf", [(op9_quality, "quality", LABELLED), (op1_toxicity, "toxic", LABELLED)])
def test_held_out_accuracy(spark, run, label, sf):
    got = run(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    out = both[both.held_out]
    assert auc(out.score, out[label]) > 0.95
    assert (out.predicted == out[label]).mean() > 0.9


def test_language_accuracy(spark):
    got = op5_language(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs)
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.95


def test_scores_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame(
        [(3, 1, 0), (3, 0, 0), (4, 0, 1), (None, 1, 1), (9, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for lab in (labels, labels.where("false")):
            model = module.fit(docs, lab)
            got = module.with_score(docs, model, "out").collect()
            assert len(got) == 8
            assert all(0 <= r["out"] <= 1 for r in got)
            assert {r["score"] for r in got} == {0.5, None, 1.0, 2.0, 3.0}
            assert len({r["out"] for r in got if r["doc_id"] == 3}) == 1
            assert len({r["out"] for r in got if not r["text"]}) == 1
        model = module.fit(empty_docs(spark), labels)
        assert module.with_score(empty_docs(spark), model, "out").count() == 0


def test_toxicity_scores_do_not_follow_the_sample(spark):
    # Half of the documents with an insult are labelled toxic, and one label in eleven.
    def said(i):
        return f"the report number {i} of the {('north', 'south', 'west')[i % 3]} is " + ("idiot work" if i % 11 < 2 else "good work")

    rows = [(i, said(i), int(i % 11 == 0)) for i in range(3300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    means = []
    for most in (4000, 1000, 200):
        scored = toxicity.with_score(docs, toxicity.fit(docs, labels, sample_rows=most))
        means.append([r[0] for r in scored.groupBy((F.col("doc_id") % 11 < 2).alias("k")).agg(F.avg("score").alias("s")).orderBy("k").select("s").collect()])
    assert abs(means[0][1] - 0.5) < 0.05 and means[0][0] < 0.02
    assert np.abs(np.array(means[1:]) - means[0]).max() < 0.1


def test_languages_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = language.with_language(docs, language.fit(docs), "out").select("doc_id", "text", "out.lang", "out.score").collect()
    by = {(r["doc_id"], r["text"]): (r["lang"], r["score"]) for r in got}
    assert by[(1, None)] == by[(2, "")] == by[(5, "12 34 !!")] == ("und", 0.0)
    assert by[(4, "wort " * 20_000)][0] == "de"
    model = language.fit(empty_docs(spark))
    assert {r[0] for r in language.with_language(docs, model, "out").select("out.lang").collect()} == {"und"}


def test_mixture_finds_both_languages():
    rng = np.random.default_rng(1)
    words = {"a": ["lorem", "ipsum", "dolor", "amet"], "b": ["zwei", "schrank", "kugel", "wurst"]}
    say = {k: " ".join(rng.choice(w, 400)) for k, w in words.items()}
    counts = np.stack([np.bincount(language.cells(say[k]), minlength=1 << language.BITS) for k in "ab"], 1) + 0.5
    model = language.Model(["a", "b"], counts / counts.sum(axis=0))
    main, share, shares = model.mixture(say["a"][:900] + " " + say["b"][:300])
    assert main == "a" and 0.6 < share < 0.9 and shares[1] > 0.1
    assert model.mixture(say["b"][:300])[:2] == ("b", 1.0)


def test_trees_learn_an_exclusive_or_and_isotonic_rises():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    forest = trees.fit(x, y, trees=30, depth=3)
    assert (((forest.margin(x) > 0) == (y > 0)).mean()) > 0.97
    steps = trees.isotonic(np.array([0.0, 1, 2, 3, 3]), np.array([0, 1, 0, 1, 1]))
    at = steps(np.linspace(-1, 4, 50))
    assert (np.diff(at) >= 0).all() and 0 < at[0] < at[-1] < 1
    assert trees.fit(np.zeros((0, 2)), np.zeros(0)).margin(np.zeros((1, 2))).shape == (1,)


def test_ftrl_separates():
    one = [(np.array([0]), np.array([1.0]), 1), (np.array([1]), np.array([1.0]), 0)] * 50
    weights, _ = quality.ftrl(one, 4)
    assert weights[0] > 0 > weights[1] and weights[2] == 0


def test_held_out_is_false_without_id(spark):
    got = spark.createDataFrame([(None,), (0,)], "doc_id long").select(text.held_out(F.col("doc_id"), 5, 0)).collect()
    assert [r[0] for r in got] == [False, zlib.crc32(b"0") % 5 == 0]


def test_toxicity_does_not_depend_on_neighbours():
    """Every text has the features it has alone, beside any other: the empty ones, and ones that repeat a letter."""
    said = ["sooo", "", "oo", "o", "", "YOU idiot!!", "", "aaa bbb", "é", "soooo you", "n@sty 1d10t", "", "x"]
    hashes = toxicity._hashes(["idiot", "nasty"]), toxicity._hashes(["idiot"]), toxicity._hashes(["you"])

    def of(some):
        raw = [x.encode() for x in some]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        return toxicity.features(np.frombuffer(b"".join(raw), np.uint8), offsets, *hashes)

    alone = np.concatenate([of([x]) for x in said])
    assert np.array_equal(of(said), alone)
    for i, a in enumerate(said):
        for j, b in enumerate(said):
            assert np.array_equal(of([a, b]), alone[[i, j]])
    assert alone[0, 19] == 0.25 and alone[7, 19] == 2 / 7
