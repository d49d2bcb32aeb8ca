"""Tables derived from the driver's tables: source files, a call graph, issues, file
history, test runs and model responses.

Python files are made from ``events``: one piece of code per event, one file per user and
block of event ids (so a file is bounded however busy a user is). What is known about
each piece of code is written down next to it by hand; the SQL oracles are built from
those notes alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EVENTS_PER_FILE = 2_000


@dataclass(frozen=True)
class Fn:
    """A function inside a shape. ``{i}`` is the event id, ``~`` a line break."""

    name: str
    offset: int
    n_lines: int
    code: str
    args: tuple[str, ...] = ("p",)
    calls: tuple[str, ...] = ()
    is_async: bool = False
    nested: bool = False
    source: bool = False
    sink: bool = False


@dataclass(frozen=True)
class Issue:
    fn: int
    type: str
    severity: str
    confidence: float
    line: int
    snippet: str


@dataclass(frozen=True)
class Shape:
    when: str
    text: str
    n_lines: int
    functions: tuple[Fn, ...]
    issues: tuple[Issue, ...] = ()
    # Chunks of a function longer than 80 lines: (start offset, lines, code).
    parts: tuple[tuple[int, int, str], ...] = field(default=())


_ERROR = """def on_error_{i}(p):~    try:~        step(p)~    except ValueError:~        pass"""
_REJECT = (
    'def reject_{i}(p):~    """Reject."""~    if not p:~        raise ValueError("bad")~'
    '    raise Exception("worse")'
)
_PURCHASE = "def on_purchase_{i}(p, acc=[]):~    acc.append(p)~    print(p)~    return acc"
_BUY = (
    'def on_buy_{i}(p, *, acc=[]):~    exec(open(p).read())~    # password = "x"~'
    "    return 1 / 0.5"
)
_INNER = "def inner_{i}(x):~        total = x / 0~        return total"
_SHIP = (
    "async def on_ship_{i}(p, q={}, r=[]):~    def inner_{i}(x):~        total = x / 0~"
    "        return total~    return inner_{i}(p)"
)
_RUN = 'def on_run_{i}(p):~    data = request.args~    token = "k{i}"~    exec(p)'
_CLICK = "def on_click_{i}(p: str) -> int:~    logger.info(p)~    return eval(p)"
_VIEW = "def onView{i}(p):~    while True:~        step(p)"
_TEST = "def test_view_{i}(p):~    assert p~    step(p)"
_LONG_1 = "def longView{i}(p):" + "~    p = step(p)" * 80
_LONG_2 = "p = other(p)" + "~    p = other(p)" * 29 + "~    return p"
_SIGNUP = 'def on_signup_{i}(p):~    token = "k{i}"~    assert p'
_SHORT = "def on_signup_{i}(p):~    return p"

SHAPES: tuple[Shape, ...] = (
    Shape("event_type = 'error' AND event_id % 3 <> 0", _ERROR, 5,
          (Fn("on_error_{i}", 0, 5, _ERROR, calls=("step",)),),
          (Issue(0, "bare_except_swallow", "high", 0.95, 4, "except ValueError:"),)),
    Shape("event_type = 'error' AND event_id % 3 = 0", "@retry~" + _REJECT, 6,
          (Fn("reject_{i}", 1, 5, _REJECT, calls=("Exception", "ValueError")),)),
    Shape("event_type = 'purchase' AND event_id % 4 = 0", _PURCHASE, 4,
          (Fn("on_purchase_{i}", 0, 4, _PURCHASE, ("p", "acc"), ("append", "print")),),
          (Issue(0, "mutable_default_argument", "medium", 0.90, 1,
                 "def on_purchase_{i}(p, acc=[]):"),
           Issue(0, "print_in_production", "low", 0.70, 3, "print(p)"))),
    Shape("event_type = 'purchase' AND event_id % 4 = 1", _BUY, 4,
          (Fn("on_buy_{i}", 0, 4, _BUY, calls=("exec", "read", "open"), source=True,
              sink=True),),
          (Issue(0, "exec_usage", "medium", 0.95, 2, "exec(open(p).read())"),)),
    Shape("event_type = 'purchase' AND event_id % 4 = 2", _SHIP, 5,
          (Fn("on_ship_{i}", 0, 5, _SHIP, ("p", "q", "r"), ("inner_{i}",), is_async=True),
           Fn("inner_{i}", 1, 3, _INNER, ("x",), nested=True)),
          (Issue(0, "division_by_zero", "high", 0.75, 3, "total = x / 0"),
           Issue(0, "mutable_default_argument", "medium", 0.90, 1,
                 "async def on_ship_{i}(p, q={}, r=[]):"),
           Issue(0, "mutable_default_argument", "medium", 0.90, 1,
                 "async def on_ship_{i}(p, q={}, r=[]):"),
           Issue(1, "division_by_zero", "high", 0.75, 2, "total = x / 0"))),
    Shape("event_type = 'purchase' AND event_id % 4 = 3", _RUN, 4,
          (Fn("on_run_{i}", 0, 4, _RUN, calls=("exec",), source=True, sink=True),),
          (Issue(0, "exec_usage", "high", 0.95, 4, "exec(p)"),
           Issue(0, "hardcoded_secret", "high", 0.70, 3, 'token = "k{i}"'))),
    Shape("event_type = 'click'", _CLICK, 3,
          (Fn("on_click_{i}", 0, 3, _CLICK, calls=("info", "eval"), sink=True),),
          (Issue(0, "eval_usage", "high", 0.95, 3, "return eval(p)"),)),
    Shape("event_type = 'view' AND event_id % 7 > 1", _VIEW, 3,
          (Fn("onView{i}", 0, 3, _VIEW, calls=("step",)),),
          (Issue(0, "potential_infinite_loop", "medium", 0.90, 2, "while True:"),)),
    Shape("event_type = 'view' AND event_id % 7 = 1", _TEST, 3,
          (Fn("test_view_{i}", 0, 3, _TEST, calls=("step",)),)),
    Shape("event_type = 'view' AND event_id % 7 = 0", _LONG_1 + "~~    " + _LONG_2, 113,
          (Fn("longView{i}", 0, 113, _LONG_1 + "~~    " + _LONG_2,
              calls=("step",) * 80 + ("other",) * 30),),
          parts=((0, 81, _LONG_1), (81, 31, _LONG_2))),
    Shape("event_type = 'signup' AND event_id % 5 <> 0", _SIGNUP, 3,
          (Fn("on_signup_{i}", 0, 3, _SIGNUP),),
          (Issue(0, "hardcoded_secret", "high", 0.70, 2, 'token = "k{i}"'),
           Issue(0, "assert_in_production", "low", 0.95, 3, "assert p"))),
    Shape("event_type = 'signup' AND event_id % 5 = 0", _SHORT, 2,
          (Fn("on_signup_{i}", 0, 2, _SHORT),)),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """SQL text with ``{table}`` slots, for views that both engines share."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def _text(template: str) -> Column:
    text = F.replace(F.lit(template), F.lit("~"), F.lit("\n"))
    return F.replace(text, F.lit("{i}"), F.col("event_id").cast("string"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, file_path, rel_path, content) of the derived source files."""
    text = F.when(F.expr(SHAPES[0].when), _text(SHAPES[0].text))
    for shape in SHAPES[1:]:
        text = text.when(F.expr(shape.when), _text(shape.text))
    pieces = table(spark, sf_dir, "events").select(
        "user_id", F.floor(F.col("event_id") / EVENTS_PER_FILE).alias("block"),
        F.struct("event_id", text.alias("text")).alias("piece"),
    )
    # The shuffle of the grouping, with its number of tasks fixed: files are small in
    # bytes but dear to parse, so they should not be merged into few tasks afterwards.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = pieces.repartition(tasks, "user_id", "block")
    files = placed.groupBy("user_id", "block").agg(
        F.array_sort(F.collect_list("piece")).alias("pieces")
    )
    folder = (
        F.when(F.col("user_id") % 10 == 0, "tests/u")
        .when(F.col("user_id") % 10 == 1, "latest/u")
        .when(F.col("user_id") % 10 == 2, "src/conftest_u")
        .otherwise("src/u")
    )
    rel = F.concat(folder, F.col("user_id"), F.lit("_"), F.col("block"), F.lit(".py"))
    return files.select(
        F.lit("repo").alias("repo"), F.concat(F.lit("repo/"), rel).alias("file_path"),
        rel.alias("rel_path"),
        F.concat(
            F.array_join(F.transform("pieces", lambda p: p["text"]), "\n\n\n"), F.lit("\n")
        ).alias("content"),
    )


# --- the same facts for the oracle -----------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_text(template: str) -> str:
    return f"replace(replace({template}, '~', chr(10)), '{{i}}', CAST(event_id AS VARCHAR))"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)


def _names(names: tuple[str, ...]) -> str:
    return "CAST([" + ", ".join(_q(n) for n in names) + "] AS VARCHAR[])"


def tree_oracle() -> str:
    """The bytes of the files that a scan of the derived tree opens."""
    texts = _values((n, _q(s.text)) for n, s in enumerate(SHAPES))
    gap = "chr(10) || chr(10) || chr(10)"
    return f"""WITH {code_ctes()},
    text_of(shape, text_t) AS (VALUES {texts}),
    body AS (SELECT rel_path, string_agg({_sql_text('text_t')}, {gap} ORDER BY event_id) || chr(10) AS content
             FROM placed JOIN text_of USING (shape) WHERE user_id % 10 NOT IN (0, 2) GROUP BY rel_path)
    SELECT rel_path, CAST(strlen(content) AS BIGINT) AS length, sha256(content) AS body_sha256 FROM body"""


def code_ctes() -> str:
    """CTEs ``fn`` (all functions), ``chunk`` (of scanned files) and ``hit`` (rule
    issues of all chunks) for DuckDB."""
    kind = "CASE " + " ".join(
        f"WHEN {s.when} THEN {n}" for n, s in enumerate(SHAPES)
    ) + " END"
    sizes = _values((n, s.n_lines) for n, s in enumerate(SHAPES))
    fns = _values(
        (n, k, _q(f.name), f.offset, f.n_lines, _q(f.code), _names(f.args),
         _names(f.calls), f.is_async, f.nested, f.source, f.sink)
        for n, s in enumerate(SHAPES) for k, f in enumerate(s.functions)
    )
    parts = _values(
        (n, 0, p, off, size, _q(code))
        for n, s in enumerate(SHAPES) for p, (off, size, code) in enumerate(s.parts)
    )
    hits = _values(
        (n, i.fn, h, _q(i.type), _q(i.severity), i.confidence, i.line, _q(i.snippet))
        for n, s in enumerate(SHAPES) for h, i in enumerate(s.issues)
    )
    return f"""
    ev AS (SELECT event_id, user_id, event_id // {EVENTS_PER_FILE} AS block,
                  {kind} AS shape FROM events),
    size_of(shape, shape_lines) AS (VALUES {sizes}),
    fn_of(shape, k, name_t, off, n_lines, code_t, args, calls_t, is_async, nested, is_source,
          is_sink) AS (VALUES {fns}),
    part_of(shape, k, part, part_off, part_lines, part_code) AS (VALUES {parts}),
    hit_of(shape, k, hit, type, severity, confidence, line_number, snippet_t)
        AS (VALUES {hits}),
    placed AS (
        SELECT ev.*, 1 + coalesce(sum(shape_lines + 2) OVER (
                   PARTITION BY user_id, block ORDER BY event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
               CASE user_id % 10 WHEN 0 THEN 'tests/u' WHEN 1 THEN 'latest/u'
                    WHEN 2 THEN 'src/conftest_u' ELSE 'src/u' END
                 || user_id || '_' || block || '.py' AS rel_path
        FROM ev JOIN size_of USING (shape)),
    fn AS (
        SELECT event_id, shape, k, user_id, rel_path, 'repo/' || rel_path AS file_path,
               {_sql_text('name_t')} AS function_name,
               CAST(base + off AS INT) AS start_line,
               CAST(base + off + n_lines - 1 AS INT) AS end_line, n_lines,
               CASE WHEN nested THEN '    ' ELSE '' END || {_sql_text('code_t')} AS code,
               args, [{_sql_text('x')} FOR x IN calls_t] AS calls,
               is_async, nested, is_source, is_sink,
               CAST(row_number() OVER (PARTITION BY rel_path ORDER BY nested, event_id) - 1
                    AS INT) AS func_seq
        FROM placed JOIN fn_of USING (shape)
        WHERE user_id % 10 NOT IN (0, 2)),
    chunk AS (
        SELECT event_id, shape, k, rel_path, file_path, function_name, func_seq,
               coalesce(part, 0) AS part,
               CAST(start_line + coalesce(part_off, 0) AS INT) AS start_line,
               CAST(start_line + coalesce(part_off, 0) + coalesce(part_lines, n_lines)
                    AS INT) AS end_line,
               CASE WHEN part IS NULL THEN ltrim(code) ELSE {_sql_text('part_code')} END
                 AS code,
               left(sha1(file_path || '::' || function_name || '::'
                         || CAST(start_line + coalesce(part_off, 0) AS VARCHAR)), 12)
                 AS chunk_id
        FROM fn LEFT JOIN part_of USING (shape, k) WHERE n_lines >= 3),
    hit AS (
        SELECT chunk.*, type, severity, CAST(confidence AS DOUBLE) AS confidence,
               line_number, hit,
               start_line + line_number - 1 AS file_line,
               {_sql_text('snippet_t')} AS code_snippet
        FROM chunk JOIN hit_of USING (shape, k))"""


# --- views both engines build from the same SQL text --------------------------------------

EDGES = """
SELECT 'r' AS repo,
       concat('u', a.user_id, '_', a.event_type, '_', a.layer) AS caller,
       concat('u', b.user_id, '_', b.event_type, '_', a.layer + 1) AS callee,
       min(a.event_id) AS ordinal
FROM (SELECT event_id, user_id, event_type,
             CAST(floor((day(ts) - 1) / 5.0) AS INT) AS layer FROM {events}) a
JOIN (SELECT event_id, user_id, event_type FROM {events}) b
  ON b.event_id = (a.event_id * 7 + 3) % (SELECT count(*) FROM {events})
GROUP BY 1, 2, 3
"""

# The same calls, some of them answered by a call back that comes first in its caller.
EDGES_CYCLIC = f"""
SELECT repo, caller, callee, ordinal FROM ({EDGES}) e
UNION ALL
SELECT repo, callee, caller, -ordinal FROM ({EDGES}) f WHERE ordinal % 17 = 0
"""

ISSUES = """
SELECT event_id AS seq, event_type AS type,
       CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium'
            WHEN 'signup' THEN NULL ELSE 'low' END AS severity,
       concat('src/d', user_id % 7, '/u', user_id, '.py') AS file,
       concat('f', user_id) AS function,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 100) / 100.0E0 END
         AS confidence
FROM {events}
"""

PATCHES = """
SELECT event_id AS seq,
       CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'rule_based'
            WHEN 2 THEN 'llamacpp' WHEN 3 THEN 'llamacpp+rag' END AS patch_source,
       concat('f', user_id) AS function, concat('src/u', user_id, '.py') AS file,
       event_type AS issue_type, concat('fix ', event_id) AS suggested_fix
FROM {events}
"""

LINE_HISTORY = """
SELECT CAST(l_orderkey AS STRING) AS file, l_linenumber AS line_from,
       CAST(l_linenumber + l_suppkey % 3 AS INT) AS line_to, l_suppkey AS commit_id,
       l_shipdate AS committed_at, s_name AS author
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
"""

# Orders as long changes of a few files.
LONG_CHANGES = """
SELECT concat('f', o_custkey % 50) AS file, o_orderkey * 7919 % 10000000 AS line_from,
       o_orderkey * 7919 % 10000000 + 1000 + o_orderkey % 400 * 1000 AS line_to,
       o_orderkey AS commit_id, o_orderdate AS committed_at
FROM {orders}
"""

# Orders as commits to one file per customer.
COMMITS = """
SELECT CAST(o_custkey AS STRING) AS file, o_orderkey AS commit_seq,
       CAST(o_orderkey % 20 + 1 AS INT) AS line_from,
       CAST(o_orderkey % 20 + 3 AS INT) AS line_to,
       concat('c', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS commit_id,
       o_orderkey AS committed_at,
       concat('dev', o_orderkey % 17) AS author,
       concat('dev', o_orderkey % 17, '@example.org') AS author_mail,
       946684800 + (o_orderkey * 7919) % 60000000 AS ts_epoch,
       concat(o_orderpriority, ' change of order number ', o_orderkey,
              ' for customer number ', o_custkey) AS summary
FROM {orders}
"""

VERSIONS = """
SELECT CAST(o_custkey AS STRING) AS file, o_orderkey AS seq,
       repeat(concat('v', o_orderkey, chr(10)), 15) AS content
FROM {orders}
"""

HISTORY_ISSUES = """
SELECT event_id AS issue_id, CAST(user_id AS STRING) AS file,
       CAST(event_id % 25 AS INT) AS line_no
FROM {events}
"""

AS_OF = 1_009_843_200  # 2002-01-01 UTC

BLAME_TEXT = """
SELECT o_orderkey,
       CASE o_orderkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN concat('abc', chr(10), 'author x')
       ELSE concat('c', lpad(CAST(o_orderkey AS STRING), 39, '0'), ' 4 4 1', chr(10),
                   'author Dev ', o_orderkey % 17, chr(10),
                   'author-mail <dev', o_orderkey % 17, '@example.org>', chr(10),
                   'author-time ', CASE o_orderkey % 9 WHEN 2 THEN 'never'
                       ELSE CAST(946684800 + o_orderkey AS STRING) END, chr(10),
                   'committer Other', chr(10), 'summary  ', o_orderpriority, ' ', chr(10),
                   'filename a.py', chr(10)) END AS porcelain
FROM {orders}
"""

RUN_PATCHES = """
SELECT o_orderkey AS issue_id, concat('r', o_custkey % 3) AS repo,
       CASE WHEN o_orderkey % 13 = 0 THEN 'Manual review required.'
            ELSE concat('x = ', o_orderkey) END AS suggested_fix
FROM {orders}
"""

ALL_RUNS = """
SELECT o_orderkey AS issue_id,
       concat(o_custkey % 7, ' passed, ', o_orderkey % 3, ' failed') AS stdout,
       CASE WHEN o_orderkey % 5 = 0 THEN ', 1 error' ELSE '' END AS stderr
FROM {orders}
"""
# Patches that could not be applied have no run.
RUNS = ALL_RUNS + "WHERE o_orderkey % 11 <> 0"

RESPONSES = """
SELECT conv_id, turn,
       CASE (conv_id + turn) % 4
         WHEN 0 THEN concat('```python', chr(10), 'def fix_', conv_id, '(x):', chr(10),
                            '    return ', turn, chr(10), '```')
         WHEN 1 THEN concat('Consider this: ', text)
         WHEN 2 THEN concat(text, chr(10), 'def broken(:')
         ELSE concat('async def f():', chr(10), '    await g(', conv_id, ')') END AS response
FROM {conversations}
"""

FENCED = """
SELECT conv_id, turn,
       CASE WHEN (conv_id + turn) % 3 = 0
            THEN concat(' ```python', chr(10), text, chr(10), '  ``` ')
            WHEN (conv_id + turn) % 3 = 1 THEN concat('```', chr(10), '```')
            ELSE text END AS response
FROM {conversations}
"""

# Vectors as chunks of code: the function name comes from the label.
VECTOR_CHUNKS = """
SELECT vec_id AS chunk_id, concat('f', label) AS function_name,
       concat('src/v', vec_id, '.py') AS file_path, 1 AS start_line,
       concat('def f', label, '():', chr(10), '    return ', vec_id) AS code, embedding
FROM {embeddings}
"""


def oracle_view(sql: str) -> str:
    """View text for DuckDB: table slots become table names."""
    for name in ("events", "lineitem", "supplier", "orders", "conversations", "embeddings"):
        sql = sql.replace("{" + name + "}", name)
    return sql
