import ast
import random
import re

import pytest
from pyspark.sql import functions as F

from codequarry import fixed_values as fixed
from codequarry.config import AnalysisConfig
from codequarry.operators import chunks as C, parse, rules

from .test_parse_and_chunks import functions_of

SAMPLE = """def share(total, parts):
    return total / 0

def load(items=[]):
    items.append(1)
    return items

def run(text):
    return eval(text)

def fetch():
    try:
        return get()
    except:
        pass

def show():
    print("value")
"""

CASES = {
    "typed except": ("def f():\n    try:\n        g()\n    except ValueError:\n        pass",
                     [("bare_except_swallow", 4, "high")]),
    "except with more": ("def f():\n    try:\n        g()\n    except E:\n        pass\n        x()", []),
    "kw only default": ("def f(*, a=[]):\n    return a\n", []),
    "call default": ("def f(a=list(), b=()):\n    return a\n", []),
    "three defaults": ("async def f(a={}, b=[1], c={1}):\n    x\n    y",
                       [("mutable_default_argument", 1, "medium")] * 3),
    "positional only default": ("def f(a=[], /, b=1):\n    x\n    y",
                                [("mutable_default_argument", 1, "medium")]),
    "loop with nested break": ("def f():\n    while True:\n        for x in y:\n            break", []),
    "loop with return in def": ("def f():\n    while True:\n        def g():\n            return 1", []),
    "while 1": ("def f():\n    while 1:\n        g()", []),
    "loop": ("def f():\n    while True:\n        g()", [("potential_infinite_loop", 2, "medium")]),
    "floor division": ("def f():\n    x\n    return 1 // 0", [("division_by_zero", 3, "high")]),
    "fraction": ("def f():\n    x\n    return 1 / 0.5", []),
    "zero point": ("def f():\n    x\n    return 1 / 0.", [("division_by_zero", 3, "high")]),
    "word after zero": ("def f():\n    x = 'a/0é'\n    return 1 / 0x1", []),
    "in text": ("def f():\n    x = 'a /\xa00 b'\n    y", [("division_by_zero", 2, "high")]),
    "comment": ("def f():\n    # 1 / 0\n    y", []),
    "secret": ("def f():\n    Api_Key = 'x'\n    y", [("hardcoded_secret", 2, "high")]),
    "secret prefix": ("def f():\n    my_password = 'x'\n    épassword = 'x'", []),
    "secret attribute": ("def f(o):\n    o.password = \"x\"\n    y", [("hardcoded_secret", 2, "high")]),
    "secret empty": ("def f(o):\n    password = ''\n    y", []),
    "secret fold": ("def f(o):\n    to\u212aen = 'x'\n    pa\u017f\u017fword = 'x'",
                    [("hardcoded_secret", 2, "high"), ("hardcoded_secret", 3, "high")]),
    "eval compiled": ("def f(c):\n    ctx = 1\n    return eval(compile(c, ctx, 'eval'))",
                      [("eval_usage", 3, "medium")]),
    "method eval": ("def f(c):\n    x\n    return c.eval('1')", []),
    "wide eval": ("def f(c):\n    x\n    return \uff45val('1')", [("eval_usage", 3, "high")]),
    "exec of file": ("def f(p):\n    t = open(p)\n    exec(t)", [("exec_usage", 3, "medium")]),
    "assert": ("def f(p):\n    x\n    assert p", [("assert_in_production", 3, "low")]),
    "does not parse": ("def f(p):\n    print(p)\n    return (", []),
    "async print": ("async def f(p):\n    x\n    print(p)", [("print_in_production", 3, "low")]),
}


def chunks_of(spark, cases):
    data = [(k, "f", "a.py", 10, v[0]) for k, v in cases.items()]
    return spark.createDataFrame(
        data, "chunk_id string, function_name string, file_path string, start_line int, code string")


def test_edges_of_each_rule(spark):
    got = {k: [] for k in CASES}
    for r in rules.scan(chunks_of(spark, CASES)).orderBy("chunk_id", "hit_seq").collect():
        got[r.chunk_id].append((r.type, r.line_number, r.severity))
        assert r.file_line == r.line_number + 9
        assert r.confidence == fixed.CONFIDENCE[r.type]
    assert got == {k: v[1] for k, v in CASES.items()}


def test_assert_is_allowed_in_test_functions(spark):
    df = chunks_of(spark, {"a": ("def t():\n    x\n    assert y", None)})
    assert rules.scan(df.withColumn("function_name", F.lit("testing"))).count() == 0


@pytest.mark.parametrize("low, types", [
    (3, ["bare_except_swallow", "mutable_default_argument"]),
    (1, ["bare_except_swallow", "division_by_zero", "eval_usage", "mutable_default_argument",
         "print_in_production"]),
])
def test_five_function_sample(spark, low, types):
    chunks = C.chunk_functions(functions_of(spark, m=SAMPLE), AnalysisConfig(min_chunk_lines=low))
    assert sorted(r.type for r in rules.scan(chunks).collect()) == types


def test_line_patterns_match_python_regexes(spark):
    """Random lines: same answer as the patterns under Python's own engine."""
    rng = random.Random(5)
    parts = ["/", "0", ".", " ", "\t", "\xa0", "\x1c", "a", "é", "1", "_", "²", "password", "Token",
             "=", "'", '"', "secret", "\u0301", "٣"]
    lines = ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(20_000)]
    zero = re.compile(r"/\s*0(?!\.\d|\w)")
    secret = re.compile(
        r"\b(" + "|".join(fixed.SECRET_NAMES) + r")\s*=\s*['\"].+['\"]", re.IGNORECASE)
    df = spark.createDataFrame([(x,) for x in lines], "x string").select(
        "x", F.col("x").rlike(rules.DIVISION_BY_ZERO).alias("z"),
        F.col("x").rlike(rules.SECRET).alias("s"))
    hits = 0
    for r in df.collect():
        assert r.z == bool(zero.search(r.x)), repr(r.x)
        assert r.s == bool(secret.search(r.x)), repr(r.x)
        hits += r.z + r.s
    assert hits > 50


def test_skipping_the_parser_loses_no_fact(spark):
    """Chunks that are not sent to the parser have no node any rule asks about."""
    texts = [v[0] for v in CASES.values()] + ["x = 1", "def f(a=1):\n    return a", "lambda: 0"]
    df = chunks_of(spark, {str(i): (t, None) for i, t in enumerate(texts)})
    for r in parse.with_facts(df).collect():
        assert len(r.facts) == len(parse._facts_of(r.code))
        if not r.facts:
            try:
                names = {n.id for n in ast.walk(ast.parse(r.code)) if isinstance(n, ast.Name)}
            except SyntaxError:
                continue
            assert "eval" not in names


def test_only_texts_with_a_word_of_the_rule_are_parsed(spark):
    """One rule parses the chunks that hold its word and finds what it finds among all rules."""
    codes = ["def f(a=[]):\n    print(a)\n    return a", "def g(p):\n    eval(p)\n    print(p)", "def h(p):\n    while True:\n        step(p)",
             "def i(p):\n    try:\n        exec(p)\n    except E:\n        pass", "def j(p):\n    assert p\n    return {1}", "def k(p):\n    ｅval(p)\n    return p"]
    chunks = spark.createDataFrame(
        [("r", f"c{n}", "f.py", "f", 1, c) for n, c in enumerate(codes)],
        "repo string, chunk_id string, file_path string, function_name string, start_line int, code string")
    facts = {r.chunk_id: len(r.facts) for r in parse.with_facts(chunks, ("eval",)).collect()}
    assert facts == {"c0": 0, "c1": 2, "c2": 0, "c3": 0, "c4": 0, "c5": 1}
    place = ("type", "chunk_id", "line_number", "message")
    every = sorted(tuple(r) for r in rules.scan(chunks).select(*place).collect())
    alone = sorted(tuple(r) for rule in rules.RULES for r in rules.scan(chunks, (rule,)).select(*place).collect())
    assert every == alone and len(every) >= 8


def test_facts_of_a_file_are_those_of_its_chunks(spark):
    """The parse of a file finds what a parse of each chunk finds, and chunks are not parsed again unless they
    are parts, or their text by itself may read otherwise."""
    nested = "class K:\n    @eval(a=[])\n    async def f(p, q={}):\n\n        def g(x):\n            while True:\n                assert x\n" \
             "                print(x)\n        try:\n            exec(open(p).read())\n        except E:\n            pass   \n"
    open_end = "def h(p):\n    eval(p)\n    assert p \\\n\n\n"
    long = "def l(p, a=[]):\n" + "    print(p)\n" * 90 + "\n" + "    eval(p)\n" * 5
    sources = {"a": nested, "b": open_end, "c": long, "d": "def w(p):\n    x = 1\n    return ｅval(p)\n",
               "e": "def b(p):\n    x = '\x0c'\n    assert p\n    return p\n", "f": SAMPLE, "g": "def broken(:\n"}
    files = spark.createDataFrame(
        [("r", f"r/{k}.py", f"{k}.py", v) for k, v in sources.items()], "repo string, file_path string, rel_path string, content string")
    plain = C.chunk_functions(parse.functions(parse.parse_files(files)))
    known = C.chunk_functions(parse.functions(parse.parse_files(files, facts=True)))
    assert known.drop("facts").columns == plain.columns
    asked = {r.function_name for r in known.collect() if r.facts is None}
    assert asked == {"h", "l", "w", "b"}
    for r in known.where("facts is not null").collect():
        assert [f.asDict() for f in r.facts] == parse._facts_of(r.code)
    every = sorted(tuple(r) for r in rules.scan(known).collect())
    assert every == sorted(tuple(r) for r in rules.scan(plain).collect()) and len(every) >= 10
