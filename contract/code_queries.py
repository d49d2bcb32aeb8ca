"""Queries over source code and text lines: scan, parse, chunk, rules, conventions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codequarry import fixed_values as fixed
from codequarry.config import AnalysisConfig
from codequarry.functions import text as T
from codequarry.operators import callgraph, chunks as C, conventions, issues as I, parse
from codequarry.operators import embeddings, rules
from codequarry.plans import analysis
from codequarry.plans.checkpoints import cut, work_folder
from codequarry.sources import files as S, results

from .registry import query
from .views import _q, code_ctes, code_files, table, tree_oracle

CTES = "WITH " + code_ctes()


def scanned(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return files.where(~S.is_excluded(F.col("rel_path")))


def parsed(spark, sf_dir):
    return parse.parse_files(scanned(spark, sf_dir))


def functions(spark, sf_dir):
    return parse.functions(parsed(spark, sf_dir))


def chunks(spark, sf_dir):
    return C.chunk_functions(functions(spark, sf_dir))


def fact_chunks(spark, sf_dir):
    """The same with the syntax facts that the parse of their file found."""
    return C.chunk_functions(parse.functions(parse.parse_files(scanned(spark, sf_dir), facts=True)))


# --- line rules over documents -----------------------------------------------------------

_DOC_LINES = """
WITH line AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text,
           generate_subscripts(string_split(text, chr(10)), 1) AS line_no
    FROM documents)
SELECT doc_id, CAST(line_no AS INT) AS line_no, trim(line_text) AS code_snippet,
       'high' AS severity, CAST({confidence} AS DOUBLE) AS confidence
FROM line
WHERE trim(line_text) <> '' AND trim(line_text) NOT LIKE '#%'
  AND regexp_matches(line_text, '{pattern}')
"""


@query(_DOC_LINES.format(
    confidence=0.7,
    pattern=r"(?i)(^|[^\pL\pN_])(" + "|".join(fixed.SECRET_NAMES)
    + r")\s*=\s*[''\"].+[''\"]"))
def q_secret_lines(spark, sf_dir):
    return rules.scan_texts(
        table(spark, sf_dir, "documents"), "doc_id", "text", "hardcoded_secret"
    )


@query(_DOC_LINES.format(
    confidence=0.75, pattern=r"/\s*0(\.?$|[^.\pL\pN_]|\.[^\p{Nd}])"))
def q_division_lines(spark, sf_dir):
    return rules.scan_texts(
        table(spark, sf_dir, "documents"), "doc_id", "text", "division_by_zero"
    )


@query("""
WITH line AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text,
           generate_subscripts(string_split(text, chr(10)), 1) AS line_no
    FROM documents)
SELECT doc_id, count(*) AS n_lines, CAST(min(line_no) AS INT) AS first_line,
       CAST(max(line_no) AS INT) AS last_line,
       CAST(sum(length(line_text)) AS BIGINT) AS n_chars
FROM line WHERE trim(line_text) <> '' AND trim(line_text) NOT LIKE '#%'
GROUP BY doc_id""")
def q_code_lines(spark, sf_dir):
    lines = C.code_lines(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "text"
    )
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"),
        F.sum(F.length("line_text")).alias("n_chars"),
    )


@query("""
SELECT 'doc' || doc_id || '.txt' AS file_path, 'doc' AS function_name, 1 AS start_line,
       CAST(1 + len(string_split(trim(text, chr(10) || ' '), chr(10))) AS INT) AS end_line,
       left(sha1('doc' || doc_id || '.txt::doc::1'), 12) AS chunk_id,
       CAST(length(trim(text, chr(10) || ' ')) AS INT) AS n_chars
FROM documents
WHERE len(string_split(trim(text, chr(10) || ' '), chr(10))) >= 3""")
def q_text_chunks(spark, sf_dir):
    """Whole documents through the chunker, parts of 20 lines (they have no blank line
    to cut at, so every document stays one chunk)."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("file_path"),
        F.lit("doc").alias("function_name"), F.lit(1).alias("start_line"),
        F.col("text").alias("code"),
    )
    out = C.chunk_functions(docs, AnalysisConfig(max_chunk_lines=20))
    return out.select(
        "file_path", "function_name", "start_line", "end_line", "chunk_id",
        F.length("code").alias("n_chars"),
    )


# --- sources -------------------------------------------------------------------------------


def _raw_documents(spark, sf_dir):
    """Documents as undecoded files; every third ends in a byte that is not UTF-8."""
    bad = F.when(F.col("doc_id") % 3 == 0, F.lit(bytearray(b"\xff"))).otherwise(
        F.lit(bytearray(b""))
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d/"), "doc_id", F.lit(".py")).alias("file_path"),
        F.concat("doc_id", F.lit(".py")).alias("rel_path"),
        F.concat(F.col("text").cast("binary"), bad).alias("body"),
        F.lit(None).cast("string").alias("read_error"),
    )


def _new_folder(spark) -> str:
    return f"{work_folder(spark)}/{uuid.uuid4().hex}"


@query(tree_oracle())
def q_scan_tree(spark, sf_dir):
    """All derived source files written as a tree, then listed and read from there; more than a local
    file system holds at once go through several trees."""
    def read(root):
        return S.scan_tree(spark, root).select("rel_path", "length", F.sha2("body", 256).alias("body_sha256"))

    return results.through_trees(code_files(spark, sf_dir), _new_folder(spark), read)


@query("""
WITH d AS (SELECT doc_id, source, sha256(text) AS text_sha256, n_chars FROM documents)
SELECT 'json' AS kind, * FROM d UNION ALL SELECT 'table' AS kind, * FROM d""")
def q_saved_results(spark, sf_dir):
    """Whole documents through both sinks and read back, without a reject."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars")
    lines, parts = _new_folder(spark), _new_folder(spark)
    results.save_json(docs, lines)
    results.save_table(docs, parts, "source")
    rows, rejects = results.load_json(spark, lines, docs.schema)
    stored = spark.read.parquet(parts).select(docs.columns)
    told = [
        df.select(F.lit(kind).alias("kind"), "doc_id", "source", F.sha2("text", 256).alias("text_sha256"), "n_chars")
        for kind, df in (("json", rows), ("table", stored),
                         ("reject", rejects.withColumn("text", F.col(results.CORRUPT))))
    ]
    return told[0].unionByName(told[1]).unionByName(told[2])


@query("""
SELECT 'd/' || doc_id || '.py' AS file_path, text AS content FROM documents
WHERE doc_id % 3 <> 0""")
def q_read_strict(spark, sf_dir):
    files, _ = S.decode_strict(_raw_documents(spark, sf_dir), "d")
    return files.select("file_path", "content")


@query("""
SELECT 'd/' || doc_id || '.py' AS file_path, 'not valid UTF-8' AS error FROM documents
WHERE doc_id % 3 = 0""")
def q_read_rejects(spark, sf_dir):
    _, rejects = S.decode_strict(_raw_documents(spark, sf_dir), "d")
    return rejects.select("file_path", "error")


@query("""
SELECT 'd/' || doc_id || '.py' AS file_path,
       text || CASE WHEN doc_id % 3 = 0 THEN chr(65533) ELSE '' END AS content
FROM documents""")
def q_read_lossy(spark, sf_dir):
    return S.decode_lossy(_raw_documents(spark, sf_dir), "d").select(
        "file_path", "content"
    )


@query(r"""
WITH last AS (SELECT page_id, url, regexp_extract(regexp_replace(url, '/+$', ''),
                     '[^/]*$') AS seg FROM pages),
slug AS (SELECT page_id, seg, left(trim(regexp_replace(lower(seg), '[^\pL\pN]', '-', 'g'),
                '-'), 40) AS s FROM last)
SELECT page_id, regexp_replace(seg, '\.git$', '') AS repo_name,
       CASE WHEN s = '' THEN 'default' ELSE s END AS collection FROM slug""")
def q_repo_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", T.repo_name(F.col("url")).alias("repo_name"),
        T.collection_name(F.col("url")).alias("collection"),
    )


@query("""
SELECT DISTINCT 'repo/' || CASE user_id % 10 WHEN 1 THEN 'latest/u' ELSE 'src/u' END
       || user_id || '_' || event_id // 2000 || '.py' AS file_path
FROM events WHERE user_id % 10 NOT IN (0, 2)""")
def q_path_filter(spark, sf_dir):
    return scanned(spark, sf_dir).select("file_path")


# --- functions and chunks ---------------------------------------------------------------------


@query(CTES + """
SELECT file_path, func_seq, function_name, start_line, end_line, code,
       is_async AS is_method, nested AS is_nested FROM fn""")
def q_functions(spark, sf_dir):
    return functions(spark, sf_dir).select(
        "file_path", "func_seq", "function_name", "start_line", "end_line", "code",
        "is_method", "is_nested",
    )


@query(CTES + """
SELECT file_path, function_name, start_line AS line_number,
       array_to_string(args, ',') AS arguments FROM fn WHERE NOT is_async""")
def q_args(spark, sf_dir):
    return parse.function_args(parsed(spark, sf_dir)).select(
        "file_path", "function_name", "line_number",
        F.array_join("arguments", ",").alias("arguments"),
    )


@query(CTES + """
SELECT chunk_id, function_name, file_path, part, start_line, end_line, code FROM chunk""")
def q_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select(
        "chunk_id", "function_name", "file_path", "part", "start_line", "end_line", "code"
    )


@query(CTES + """
SELECT chunk_id, function_name, file_path FROM chunk
WHERE NOT contains(file_path, 'test') AND NOT starts_with(function_name, 'test_')""")
def q_production_filter(spark, sf_dir):
    return C.production_chunks(chunks(spark, sf_dir)).select(
        "chunk_id", "function_name", "file_path"
    )


@query(CTES + """
SELECT count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS removed
FROM (SELECT NOT contains(file_path, 'test') AND NOT starts_with(function_name, 'test_')
             AS keep FROM chunk)""")
def q_production_counts(spark, sf_dir):
    return C.production_counts(chunks(spark, sf_dir))


# --- rules ------------------------------------------------------------------------------------

_HIT = """
SELECT type, severity, confidence, function_name AS function, file_path AS file,
       line_number, file_line, code_snippet, chunk_id FROM hit"""


def _hits(spark, sf_dir):
    return rules.scan(fact_chunks(spark, sf_dir)).select(
        "type", "severity", "confidence", "function", "file", "line_number", "file_line",
        "code_snippet", "chunk_id",
    )


@query(CTES + _HIT)
def q_rule_issues(spark, sf_dir):
    return _hits(spark, sf_dir)


def _one_rule(rule: rules.Rule):
    def run(spark, sf_dir):
        found = fact_chunks(spark, sf_dir) if rule.over == "fact" else chunks(spark, sf_dir)
        return rules.scan(found, (rule,)).select(
            "type", "severity", "confidence", "function", "file", "line_number",
            "file_line", "code_snippet", "chunk_id",
        )

    return run


for _rule in rules.RULES:
    query(CTES + _HIT + f" WHERE type = {_q(_rule.issue_type)}",
          name=f"q_rule_{_rule.issue_type}")(_one_rule(_rule))


@query(CTES + f"""
SELECT type, function_name AS function,
       CASE type {' '.join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in
                           fixed.RULE_MESSAGES.items()
                           if k not in ('mutable_default_argument', 'exec_usage'))}
         WHEN 'exec_usage' THEN CASE severity WHEN 'medium'
             THEN {_q(fixed.RULE_MESSAGES['exec_usage_from_file'])}
             ELSE {_q(fixed.RULE_MESSAGES['exec_usage'])} END
         ELSE replace({_q(fixed.RULE_MESSAGES['mutable_default_argument'])}, '%s',
                      function_name) END AS message
FROM hit""")
def q_rule_messages(spark, sf_dir):
    return rules.scan(fact_chunks(spark, sf_dir)).select("type", "function", "message")


@query(CTES + """
SELECT chunk_id, kind, line_no, name FROM (
    SELECT chunk_id,
           CASE type WHEN 'potential_infinite_loop' THEN 'while_true'
               WHEN 'assert_in_production' THEN 'assert'
               WHEN 'bare_except_swallow' THEN 'except_pass'
               WHEN 'mutable_default_argument' THEN 'mutable_default' ELSE 'call' END AS kind,
           line_number AS line_no,
           CASE type WHEN 'eval_usage' THEN 'eval' WHEN 'exec_usage' THEN 'exec'
               WHEN 'print_in_production' THEN 'print'
               WHEN 'mutable_default_argument' THEN function_name END AS name
    FROM hit WHERE type NOT IN ('division_by_zero', 'hardcoded_secret')
    UNION ALL
    SELECT chunk_id, 'assert', 2, NULL FROM chunk
    WHERE starts_with(function_name, 'test_'))""")
def q_syntax_facts(spark, sf_dir):
    facts = parse.with_facts(chunks(spark, sf_dir))
    return facts.select("chunk_id", F.explode("facts").alias("f")).select(
        "chunk_id", "f.kind", "f.line_no", "f.name"
    )


# --- call graph from source ---------------------------------------------------------------------


@query(CTES + """
SELECT file_path, function_name AS caller, CAST(pos - 1 AS INT) AS call_seq, callee
FROM (SELECT file_path, function_name, unnest(calls) AS callee,
             generate_subscripts(calls, 1) AS pos FROM fn)""")
def q_call_sites(spark, sf_dir):
    return parse.call_sites(parsed(spark, sf_dir)).select(
        "file_path", "caller", "call_seq", "callee"
    )


@query(CTES + """
SELECT function_name AS caller, callee, CAST(min(pos) - 1 AS INT) AS call_seq
FROM (SELECT function_name, unnest(calls) AS callee,
             generate_subscripts(calls, 1) AS pos FROM fn) GROUP BY ALL""")
def q_call_edges(spark, sf_dir):
    return callgraph.call_edges(parsed(spark, sf_dir)).select(
        "caller", "callee", F.col("ordinal.call_seq").alias("call_seq")
    )


@query(CTES + """
SELECT function_name AS name, file_path, start_line, code, is_source,
       is_sink FROM fn""")
def q_call_nodes(spark, sf_dir):
    return callgraph.call_nodes(parsed(spark, sf_dir)).drop("repo")


# --- conventions ----------------------------------------------------------------------------------


def _like(pattern: str) -> str:
    return _q(pattern.format(space=r"\s", word=r"\w", names="|".join(fixed.TYPE_HINT_NAMES)))


def _any(words) -> str:
    return " OR ".join(f"contains(code, {_q(w)})" for w in words)


_MARKS = f"""
SELECT *, {_any(fixed.LOGGING_WORDS)} AS logs, contains(code, {_q(fixed.PRINT_WORD)}) AS prints,
       {_any(fixed.DOCSTRING_MARKS)} AS documented,
       regexp_matches(code, {_like(fixed.TYPE_HINT_PATTERN)}) AS hinted,
       contains(code, {_q(fixed.RAISE_WORD)}) AS raises,
       regexp_matches(code, {_like(fixed.CUSTOM_ERROR_PATTERN)}) AS custom,
       regexp_matches(code, {_like(fixed.GENERIC_ERROR_PATTERN)}) AS generic,
       regexp_matches(function_name, {_q(fixed.SNAKE_PATTERN)}) AS snake,
       regexp_matches(function_name, {_q(fixed.CAMEL_PATTERN)}) AS camel
FROM {{source}}"""

_PROFILE = """
mark AS ({marks}),
n AS (SELECT count(*) AS n, count(*) FILTER (logs) AS logs, count(*) FILTER (prints) AS prints,
             count(*) FILTER (documented) AS docs, count(*) FILTER (hinted) AS hints,
             count(*) FILTER (raises) AS raises, count(*) FILTER (custom) AS custom,
             count(*) FILTER (generic) AS generic, count(*) FILTER (snake) AS snake,
             count(*) FILTER (camel) AS camel FROM mark),
side AS (
    SELECT 'output_style' AS pattern_name, 0 AS pos, n AS base, 0.75 AS threshold,
           CASE WHEN logs >= prints THEN 'logging' ELSE 'print' END AS dominant_value,
           greatest(logs, prints) AS followers, n FROM n
    UNION ALL SELECT 'docstring_coverage', 1, n, 0.70, 'docstrings', docs, n FROM n
    UNION ALL SELECT 'type_hints', 2, n, 0.60, 'type_hints', hints, n FROM n
    UNION ALL SELECT 'error_handling', 3, raises, 0.65,
        CASE WHEN custom >= generic THEN 'custom_exceptions' ELSE 'generic_exceptions' END,
        greatest(custom, generic), n FROM n
    UNION ALL SELECT 'naming_convention', 4, n, 0.80,
        CASE WHEN snake >= camel THEN 'snake_case' ELSE 'camelCase' END,
        greatest(snake, camel), n FROM n),
prof AS (
    SELECT pattern_name, pos, CASE WHEN base = 0 THEN 'none' ELSE dominant_value END
             AS dominant_value,
           CASE WHEN base = 0 THEN 1.0 ELSE round_even(followers / base, 3) END AS coverage,
           base = 0 OR followers / base >= threshold AS is_consistent,
           CASE WHEN base = 0 THEN 0 ELSE followers END AS follower_count,
           CASE WHEN base = 0 THEN 0 ELSE base - followers END AS violator_count,
           CAST(threshold AS DOUBLE) AS threshold, n AS total_chunks
    FROM side WHERE n >= 10)"""


def _profile(source):
    return _PROFILE.format(marks=_MARKS.format(source=source))


_PROFILE_ROWS = """
SELECT pattern_name, dominant_value, coverage, is_consistent, follower_count,
       violator_count, threshold, total_chunks FROM prof"""


def _profile_rows(measured):
    return conventions.profile(measured).select(
        "pattern_name", "dominant_value", "coverage", "is_consistent", "follower_count",
        "violator_count", "threshold", "total_chunks",
    )


@query(CTES + "," + _profile("chunk") + _PROFILE_ROWS)
def q_profile(spark, sf_dir):
    return _profile_rows(conventions.measure(chunks(spark, sf_dir)))


@query(CTES + "," + _profile("fn") + _PROFILE_ROWS)
def q_profile_functions(spark, sf_dir):
    """The profile over all functions, short ones included."""
    return _profile_rows(conventions.measure(functions(spark, sf_dir)))


@query(CTES + "," + _profile("chunk") + """
SELECT 'Codebase DNA — ' || max(total_chunks) || ' chunks analyzed' || chr(10)
       || string_agg('  ' || pattern_name || ': ' || dominant_value || ' ('
            || CAST(round_even(coverage * 100, 0) AS INT) || '%, '
            || CASE WHEN is_consistent THEN 'consistent' ELSE 'mixed' END || ')',
            chr(10) ORDER BY pos) AS summary
FROM prof HAVING count(*) > 0""")
def q_profile_text(spark, sf_dir):
    return conventions.profile_text(conventions.measure(chunks(spark, sf_dir)))


# The house style of the fixture is mixed, so violations are read off a corpus in which every
# second view has a name like the others.
_RENAMED = (r"^onView(\d*[02468])$", "on_view_")


def _named_chunks(spark, sf_dir):
    name = F.regexp_replace("function_name", _RENAMED[0], _RENAMED[1] + "$1")
    return chunks(spark, sf_dir).withColumn("function_name", name)


@query(CTES + ", calm AS (SELECT * REPLACE (regexp_replace(function_name, '" + _RENAMED[0] + "', '" + _RENAMED[1] + r"\1') AS function_name) FROM chunk)," +
       _profile("calm") + """,
text AS (SELECT pattern_name, dominant_value, is_consistent,
                CAST(round_even(coverage * 100, 0) AS INT) || '%' AS pct FROM prof)
SELECT m.chunk_id, m.function_name AS function, m.file_path AS file,
       m.start_line AS line_number, 'low' AS severity, CAST(0.75 AS DOUBLE) AS confidence,
       t.pattern_name AS pattern,
       CASE t.pattern_name WHEN 'output_style' THEN
                CASE t.dominant_value WHEN 'logging' THEN 'print_in_logging_codebase'
                     ELSE 'logging_in_print_codebase' END
            WHEN 'error_handling' THEN 'generic_exception_in_custom_codebase'
            WHEN 'naming_convention' THEN 'naming_violates_' || t.dominant_value
            ELSE t.pattern_name || '_violation' END AS subtype,
       CASE t.pattern_name
            WHEN 'naming_convention' THEN 'Codebase uses ' || t.dominant_value || ' (' || t.pct
                || ' of functions) but ''' || m.function_name
                || ''' uses a different style. Rename to match codebase convention.'
            WHEN 'error_handling' THEN 'Codebase uses custom exceptions (' || t.pct
                || ') but this function raises generic Exception(). Create a specific'
                || ' exception class for this error case.' END AS message
FROM mark m, text t
WHERE t.is_consistent AND CASE t.pattern_name
    WHEN 'output_style' THEN CASE t.dominant_value WHEN 'logging' THEN prints AND NOT logs
                                  ELSE logs AND NOT prints END
    WHEN 'docstring_coverage' THEN NOT documented
    WHEN 'type_hints' THEN NOT hinted
    WHEN 'error_handling' THEN t.dominant_value = 'custom_exceptions' AND generic
    ELSE NOT CASE t.dominant_value WHEN 'snake_case' THEN snake ELSE camel END
         AND length(m.function_name) > 4 AND camel <> snake END""")
def q_convention_violations(spark, sf_dir):
    corpus = cut(_named_chunks(spark, sf_dir))
    return conventions.violations(corpus, conventions.measure(corpus)).select(
        "chunk_id", "function", "file", "line_number", "severity", "confidence",
        "pattern", "subtype", "message",
    )


_STYLED = """
SELECT event_id AS chunk_id, 'handle' AS function_name, 'u' || user_id || '.py' AS file_path,
       event_id % 10 = 0 AS odd FROM events"""


@query(f"""
WITH e AS ({_STYLED}),
share AS (SELECT CAST(round_even(100.0 * count_if(NOT odd) / count(*), 0) AS INT) || '%' AS pct,
                 count_if(NOT odd) >= 0.75 * count(*) AS holds FROM e)
SELECT e.chunk_id, pattern, subtype, replace(message, '%s', pct) AS message
FROM e, share, (VALUES
    ('output_style', 'print_in_logging_codebase', {_q(fixed.CONVENTION_MESSAGES["print_in_logging_codebase"])}),
    ('docstring_coverage', 'docstring_coverage_violation', {_q(fixed.CONVENTION_MESSAGES["docstring_coverage_violation"])}),
    ('type_hints', 'type_hints_violation', {_q(fixed.CONVENTION_MESSAGES["type_hints_violation"])})
) v(pattern, subtype, message)
WHERE odd AND holds""")
def q_style_violations(spark, sf_dir):
    """Output, docstring and type hint conventions on functions made of events: every tenth
    breaks all three."""
    events = table(spark, sf_dir, "events")
    house = "def handle(p: str) -> int:\n    \"\"\"Handle.\"\"\"\n    logger.info(p)\n"
    corpus = cut(events.select(
        F.col("event_id").alias("chunk_id"), F.lit("handle").alias("function_name"),
        F.concat(F.lit("u"), "user_id", F.lit(".py")).alias("file_path"), F.lit(1).alias("start_line"),
        F.when(F.col("event_id") % 10 == 0, "def handle(p):\n    print(p)\n").otherwise(house).alias("code")))
    return conventions.violations(corpus, conventions.measure(corpus)).select(
        "chunk_id", "pattern", "subtype", "message")


# --- union -------------------------------------------------------------------------------------------


@query(CTES + "," + _profile("chunk") + """
SELECT type, severity, confidence, function_name AS function, chunk_id,
       CAST(NULL AS VARCHAR) AS subtype, file_line FROM hit
UNION ALL
SELECT 'dna_violation', 'low', 0.75, function_name, chunk_id, 'naming_violates_' ||
       dominant_value, start_line
FROM mark, prof WHERE pattern_name = 'naming_convention' AND is_consistent
  AND NOT CASE dominant_value WHEN 'snake_case' THEN snake ELSE camel END
  AND length(function_name) > 4 AND camel <> snake
UNION ALL
SELECT 'dna_violation', 'low', 0.75, function_name, chunk_id,
       'generic_exception_in_custom_codebase', start_line
FROM mark, prof WHERE pattern_name = 'error_handling' AND is_consistent
  AND dominant_value = 'custom_exceptions' AND generic""")
def q_issue_union(spark, sf_dir):
    corpus = cut(fact_chunks(spark, sf_dir))
    everything = I.union(
        rules=rules.scan(corpus),
        convention=conventions.violations(corpus, conventions.measure(corpus)),
    )
    return everything.select(
        "type", "severity", "confidence", "function", "chunk_id", "subtype", "file_line"
    )


@query(CTES + """
SELECT 'functions' AS name, 'rows' AS counter, (SELECT count(*) FROM fn) AS n
UNION ALL SELECT 'chunks', 'rows', (SELECT count(*) FROM chunk)
UNION ALL SELECT 'issues', 'rows', (SELECT count(*) FROM hit)
UNION ALL SELECT 'issues', level, (SELECT count(*) FROM hit WHERE severity = level)
FROM (VALUES ('high'), ('medium'), ('low')) AS v(level)""")
def q_saved_counters(spark, sf_dir):
    """Counters of saved result tables, taken while they are written."""
    found = cut(functions(spark, sf_dir))
    corpus = cut(C.chunk_functions(found))
    told = analysis.save(
        {"functions": found, "chunks": corpus, "issues": rules.scan(corpus)}, _new_folder(spark))
    rows = [(name, counter, n) for name, of in told.items() for counter, n in of.items()]
    return spark.createDataFrame(rows, "name string, counter string, n long")


def _letter_model():
    """Counts of characters, bytes, spaces and e; a text of 7, 14, ... characters fails."""
    def encode(texts):
        if any(len(t) % 7 == 0 for t in texts):
            raise ValueError("a text that the model cannot take")
        return [[len(t), len(t.encode()), t.count(" "), t.count("e")] for t in texts]

    return encode


@query("""
SELECT doc_id, CASE WHEN length(text) % 7 <> 0 THEN CAST([length(text), strlen(text),
           length(text) - length(replace(text, ' ', '')),
           length(text) - length(replace(text, 'e', ''))] AS VARCHAR) END AS embedding
FROM documents""")
def q_embed_batches(spark, sf_dir):
    """Vectors of whole texts from a user's model, in batches; a text that fails has none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = embeddings.embed_in_batches(docs, _letter_model, "text", batch_size=64)
    return told.select("doc_id", F.col("embedding").cast("array<bigint>").cast("string").alias("embedding"))


@query("SELECT doc_id, 256 AS dimensions, CAST(1 AS DOUBLE) AS norm FROM documents")
def q_embed_texts(spark, sf_dir):
    """Hashed token vectors of whole texts: their width and length."""
    v = embeddings.embed_hashed(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "text"
    )
    squares = F.aggregate(
        "embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return v.select(
        "doc_id", F.size("embedding").alias("dimensions"),
        F.round(F.sqrt(squares), 4).alias("norm"),
    )
