import hashlib
import random

from pyspark.sql import functions as F

from codequarry.functions import ages, text as T

ODD = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u2028",
       "\u2029", "\xa0", "\u3000", "\u200b", "\ufeff", " ", "\t", "a", "é", "#", "_", "0"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 12))) for _ in range(n)]


def test_lines_and_strip_match_python(spark):
    texts = random_texts(3000, 1)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.lines(F.col("t")).alias("l"), T.strip(F.col("t")).alias("s")).collect():
        assert r.l == r.t.splitlines()
        assert r.s == r.t.strip()


def test_null_text_stays_null(spark):
    r = spark.createDataFrame([(None,)], "t string").select(
        T.lines(F.col("t")).alias("l"), T.strip(F.col("t")).alias("s")).first()
    assert r.l is None and r.s is None


def test_percent_rounds_half_even(spark):
    df = spark.createDataFrame([(x / 1000,) for x in range(0, 1001)], "x double")
    for r in df.select("x", T.percent(F.col("x")).alias("p")).collect():
        assert r.p == f"{r.x:.0%}"


def test_ids_and_names(spark):
    df = spark.createDataFrame([("a/b.py", "f", 7)], "p string, f string, s int")
    r = df.select(T.chunk_id(F.col("p"), F.col("f"), F.col("s")).alias("id")).first()
    assert r.id == hashlib.sha1(b"a/b.py::f::7").hexdigest()[:12]
    urls = {
        "https://h.org/pallets/flask": ("flask", "flask"),
        "https://h.org/a/My.Repo.git/": ("My.Repo", "my-repo-git"),
        "": ("", "default"), "https://h.org/---/": ("---", "default"),
        "x/" + "a" * 60: ("a" * 60, "a" * 40),
    }
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(
        "u", T.repo_name(F.col("u")).alias("n"), T.collection_name(F.col("u")).alias("c"))
    assert {r.u: (r.n, r.c) for r in got.collect()} == urls


def test_fill_leaves_other_braces(spark):
    r = spark.range(1).select(T.fill("{a}{x}-{b}{a}", a=F.lit("1"), b=F.lit("{a}")).alias("t"))
    assert r.first().t == "1{x}-{a}1"


def test_age_ladder(spark):
    day = 86_400
    as_of = 1000 * day
    want = {None: "unknown age", as_of: "introduced today", as_of - day: "introduced yesterday",
            as_of - 6 * day - 5: "introduced 6 days ago", as_of - 7 * day: "introduced 1 week(s) ago",
            as_of - 29 * day: "introduced 4 week(s) ago", as_of - 30 * day: "introduced 1 month(s) ago",
            as_of - 364 * day: "introduced 12 month(s) ago", as_of - 800 * day: "introduced 2 year(s) ago"}
    df = spark.createDataFrame([(k,) for k in want], "t long")
    got = df.select("t", ages.age_text(ages.days_old(F.col("t"), as_of)).alias("a")).collect()
    assert {r.t: r.a for r in got} == want
