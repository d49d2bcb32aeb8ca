"""Queries over issues, patches, history and test runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry import fixed_values as fixed
from codequarry.operators import history, issues as I, metrics, patches as P
from codequarry.operators import rules, verification as V
from codequarry.plans.checkpoints import cut

from . import views
from .code_queries import CTES, fact_chunks
from .registry import query
from .views import _q, oracle_view, run_sql, table

_I = "WITH i AS (" + oracle_view(views.ISSUES) + "), p AS (" + oracle_view(
    views.PATCHES) + ") "


def issues_v(spark, sf_dir):
    return run_sql(spark, sf_dir, views.ISSUES, "events")


def patches_v(spark, sf_dir):
    return run_sql(spark, sf_dir, views.PATCHES, "events")


# --- metrics ---------------------------------------------------------------------------


@query(_I + """
SELECT (SELECT count(*) FROM documents) AS total_chunks, count(*) AS total_issues,
       round_even(count(*) / (SELECT count(*) FROM documents) * 100, 2)
         AS detection_rate_per_100 FROM i""")
def q_summary(spark, sf_dir):
    return metrics.summary(table(spark, sf_dir, "documents"), issues_v(spark, sf_dir))


@query(_I + "SELECT coalesce(severity, 'unknown') AS severity, count(*) AS n FROM i GROUP BY 1")
def q_severity(spark, sf_dir):
    return metrics.severity_counts(issues_v(spark, sf_dir))


@query(_I + "SELECT type, count(*) AS n FROM i GROUP BY 1")
def q_types(spark, sf_dir):
    return metrics.type_counts(issues_v(spark, sf_dir))


@query(_I + """
SELECT 'severity' AS dimension, coalesce(severity, 'unknown') AS value, count(*) AS n
FROM i GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM i GROUP BY 2""")
def q_breakdown(spark, sf_dir):
    return metrics.breakdown(issues_v(spark, sf_dir))


@query(_I + """
SELECT file, count(*) AS n FROM i GROUP BY 1 ORDER BY n DESC, min(seq) LIMIT 5""")
def q_top_files(spark, sf_dir):
    return metrics.top_files(issues_v(spark, sf_dir))


@query(_I + """
SELECT regexp_extract(file, '[^/]*$') AS file, count(*) AS n FROM i GROUP BY 1
ORDER BY n DESC, min(seq) LIMIT 8""")
def q_top_base_names(spark, sf_dir):
    return metrics.top_base_names(issues_v(spark, sf_dir))


@query(_I + """
SELECT b.bucket, count(i.seq) AS n
FROM (VALUES ('>=90%', 0.9, 9), ('70-89%', 0.7, 0.9), ('50-69%', 0.5, 0.7),
             ('<50%', -9, 0.5)) b(bucket, lo, hi)
LEFT JOIN i ON coalesce(confidence, 0) >= lo AND coalesce(confidence, 0) < hi GROUP BY 1""")
def q_conf_buckets(spark, sf_dir):
    return metrics.confidence_buckets(issues_v(spark, sf_dir))


@query(_I + "SELECT seq, type, confidence FROM i WHERE coalesce(confidence, 0) >= 0.8")
def q_high_confidence(spark, sf_dir):
    return I.at_least(issues_v(spark, sf_dir), 0.80).select("seq", "type", "confidence")


@query(_I + """
SELECT seq, type, confidence FROM i WHERE coalesce(confidence, 0) >= 0.8
ORDER BY seq LIMIT 20""")
def q_to_investigate(spark, sf_dir):
    return I.first_high_confidence(issues_v(spark, sf_dir), cap=20).select(
        "seq", "type", "confidence"
    )


@query(_I + """
SELECT seq, type, confidence FROM i ORDER BY coalesce(confidence, 0) DESC, seq LIMIT 20""")
def q_recent(spark, sf_dir):
    return metrics.recent_issues(issues_v(spark, sf_dir)).select("seq", "type", "confidence")


@query(_I + "SELECT seq, patch_source, suggested_fix FROM p ORDER BY seq LIMIT 25")
def q_first_patches(spark, sf_dir):
    return metrics.first_patches(patches_v(spark, sf_dir)).select(
        "seq", "patch_source", "suggested_fix"
    )


@query(_I + """
SELECT count(*) FILTER (patch_source IS DISTINCT FROM 'none') AS patched_issues,
       round_even(count(*) FILTER (patch_source IS DISTINCT FROM 'none')
                  / (SELECT count(*) FROM i) * 100, 1) AS coverage_pct,
       count(*) FILTER (patch_source NOT IN ('none', 'rule_based')) AS model_count,
       count(*) FILTER (patch_source = 'rule_based') AS rule_count FROM p""")
def q_patch_metrics(spark, sf_dir):
    return metrics.patch_metrics(issues_v(spark, sf_dir), patches_v(spark, sf_dir))


@query(_I + """
SELECT count(*) FILTER (contains(s, '+rag')) AS retrieval,
       count(*) FILTER (s NOT IN ('none', 'rule_based') AND NOT contains(s, '+rag')) AS model,
       count(*) FILTER (s = 'rule_based') AS rule_based, count(*) AS total
FROM (SELECT coalesce(patch_source, '') AS s FROM p)""")
def q_patch_sources(spark, sf_dir):
    return metrics.patch_sources(patches_v(spark, sf_dir))


@query(_I + """
SELECT count(*) FILTER (type = 'error') AS taint_count,
       count(*) FILTER (type = 'click') AS anomaly_count,
       count(*) FILTER (type = 'view') AS dna_count FROM i""")
def q_kind_counts(spark, sf_dir):
    renamed = issues_v(spark, sf_dir).replace(
        {"error": "taint_flow", "click": "statistical_anomaly", "view": "dna_violation"},
        subset=["type"],
    )
    return metrics.kind_counts(renamed)


@query(_I + """,
f AS (SELECT regexp_extract(file, '[^/]*$') AS name, count(*) AS n, min(seq) AS s FROM i
      GROUP BY 1 ORDER BY n DESC, s LIMIT 8),
r AS (SELECT * FROM i ORDER BY coalesce(confidence, 0) DESC, seq LIMIT 20)
SELECT true AS has_results, count(*) AS total_issues,
       count(*) FILTER (coalesce(confidence, 0) >= 0.8) AS high_confidence,
       (SELECT count(*) FROM documents) AS total_chunks,
       (SELECT count(*) FROM p) AS total_patches,
       (SELECT round_even(count(*) FILTER (patch_source IS DISTINCT FROM 'none')
               / (SELECT count(*) FROM i) * 100, 1) FROM p) AS coverage_pct,
       (SELECT string_agg(name || '=' || n, ';' ORDER BY n DESC, s) FROM f) AS top_files,
       (SELECT string_agg(function, ';' ORDER BY coalesce(confidence, 0) DESC, seq) FROM r)
         AS recent,
       (SELECT CAST(count(DISTINCT coalesce(severity, 'unknown')) AS INT) FROM i)
         AS severities,
       4 AS buckets, 25 AS patches
FROM i""")
def q_dashboard(spark, sf_dir):
    issues = issues_v(spark, sf_dir).withColumns(
        {"line_number": F.lit(1), "message": F.lit("m")}
    )
    page = metrics.dashboard(
        table(spark, sf_dir, "documents"), issues, patches_v(spark, sf_dir)
    )
    return page.select(
        "has_results", "total_issues", "high_confidence", "total_chunks", "total_patches",
        F.col("patch_metrics.coverage_pct").alias("coverage_pct"),
        F.array_join(
            F.transform("top_files", lambda x: F.concat_ws("=", x["file"], x["n"])), ";"
        ).alias("top_files"),
        F.array_join(F.transform("recent_issues", lambda x: x["function"]), ";")
        .alias("recent"),
        F.size("severity").alias("severities"), F.size("conf_buckets").alias("buckets"),
        F.size("patches").alias("patches"),
    )


# --- history ------------------------------------------------------------------------------


@query("WITH h AS (" + oracle_view(views.LINE_HISTORY) + """),
l AS (SELECT file, unnest(range(line_from, line_to + 1)) AS line_no, commit_id, committed_at,
             author FROM h)
SELECT file, CAST(line_no AS INT) AS line_no,
       arg_max(commit_id, (committed_at, commit_id)) AS commit_id,
       max(committed_at) AS committed_at,
       arg_max(author, (committed_at, commit_id)) AS author
FROM l GROUP BY file, line_no""")
def q_line_owner(spark, sf_dir):
    lines = run_sql(spark, sf_dir, views.LINE_HISTORY, "lineitem", "supplier")
    return history.line_owners(lines).select(
        "file", "line_no", "commit_id", "committed_at", "author"
    )


_OWNED_LINES = "WITH h AS (" + oracle_view(views.LINE_HISTORY) + """),
l AS (SELECT file, unnest(range(line_from, line_to + 1)) AS line_no, commit_id, committed_at
      FROM h),
o AS (SELECT file, line_no, max((committed_at, commit_id)) AS owner FROM l GROUP BY ALL)"""


@query(_OWNED_LINES + """,
m AS (SELECT *, line_no - row_number() OVER (PARTITION BY file, owner ORDER BY line_no) AS island
      FROM o)
SELECT file, CAST(min(line_no) AS INT) AS line_from, CAST(max(line_no) AS INT) AS line_to,
       owner[2] AS commit_id, owner[1] AS committed_at
FROM m GROUP BY file, owner, island""")
def q_owned_ranges(spark, sf_dir):
    """Every file as ranges of lines with one owner."""
    lines = run_sql(spark, sf_dir, views.LINE_HISTORY, "lineitem", "supplier")
    return history.owned_ranges(lines).select(
        "file", "line_from", "line_to", "commit_id", "committed_at"
    )


# Every order is a change of 1,000 to 400,000 lines of one of 50 files.
@query("WITH c AS (" + oracle_view(views.LONG_CHANGES) + """),
p AS (SELECT file, line_from AS x FROM c UNION SELECT file, line_to + 1 FROM c),
s AS (SELECT file, x, lead(x) OVER (PARTITION BY file ORDER BY x) - 1 AS upto FROM p),
o AS (SELECT s.file, s.x, s.upto, max((committed_at, commit_id)) AS owner
      FROM s JOIN c ON c.file = s.file AND s.x BETWEEN c.line_from AND c.line_to
      GROUP BY ALL),
h AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY x) AS island
      FROM (SELECT *, coalesce(lag(owner) OVER w <> owner OR lag(upto) OVER w <> x - 1, true) AS fresh
            FROM o WINDOW w AS (PARTITION BY file ORDER BY x)))
SELECT file, min(x) AS line_from, max(upto) AS line_to, owner[2] AS commit_id,
       owner[1] AS committed_at
FROM h GROUP BY file, island, owner""")
def q_owned_long_ranges(spark, sf_dir):
    """The same where changes are long: no line is a row."""
    return history.owned_ranges(run_sql(spark, sf_dir, views.LONG_CHANGES, "orders")).select(
        "file", "line_from", "line_to", "commit_id", "committed_at"
    )


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS file, o_orderkey AS seq,
       lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before_seq
FROM orders""")
def q_version_before(spark, sf_dir):
    versions = run_sql(spark, sf_dir, views.VERSIONS, "orders").select("file", "seq")
    return history.version_before(versions, versions, width=64)


_OWNED = "WITH c AS (" + oracle_view(views.COMMITS) + "), hi AS (" + oracle_view(
    views.HISTORY_ISSUES) + f"""),
own AS (
    SELECT file, line_no, max(commit_seq) AS commit_seq
    FROM (SELECT file, unnest(range(line_from, line_to + 1)) AS line_no, commit_seq FROM c)
    GROUP BY ALL),
before AS (
    SELECT file, commit_seq,
           lag(commit_seq) OVER (PARTITION BY file ORDER BY commit_seq) AS b FROM c),
a AS (
    SELECT hi.issue_id, hi.file, hi.line_no, c.*, before.b,
           CAST(floor(({views.AS_OF} - c.ts_epoch) / 86400.0) AS INT) AS days,
           hi.line_no <> 0 AND c.commit_id IS NOT NULL AS investigated
    FROM hi LEFT JOIN own ON own.file = hi.file AND own.line_no = hi.line_no
    LEFT JOIN c ON c.file = own.file AND c.commit_seq = own.commit_seq
    LEFT JOIN before ON before.file = c.file AND before.commit_seq = c.commit_seq),
told AS (
    SELECT *, 'introduced ' || CASE
        WHEN days = 0 THEN 'today' WHEN days = 1 THEN 'yesterday'
        WHEN days < 7 THEN days || ' days ago'
        WHEN days < 30 THEN days // 7 || ' week(s) ago'
        WHEN days < 365 THEN days // 30 || ' month(s) ago'
        ELSE days // 365 || ' year(s) ago' END AS age FROM a)
"""


@query(_OWNED + """
SELECT issue_id, investigated,
       CASE WHEN line_no = 0 THEN 'Issue missing file or line_number'
            WHEN commit_id IS NULL THEN 'git blame returned no result for ' || file || ':'
                 || line_no END AS reason,
       author, author_mail AS author_email, left(commit_id, 8) AS commit_hash,
       summary AS commit_summary, days AS days_old,
       CASE WHEN investigated THEN age END AS age_description,
       CASE WHEN b IS NOT NULL THEN array_to_string(
           [CASE WHEN x = 16 THEN '' ELSE 'v' || b END
            FOR x IN range(greatest(1, line_no - 10), least(15, line_no + 10) + 1)],
           chr(10)) END AS code_before,
       b IS NOT NULL AS had_safe_version,
       CASE WHEN investigated THEN 'Bug ' || age || ' by ' || author || ' in commit '
            || left(commit_id, 8) || ': ''' || left(summary, 60) || '''' END AS insight
FROM told""")
def q_archaeology(spark, sf_dir):
    told = history.investigate(
        run_sql(spark, sf_dir, views.HISTORY_ISSUES, "events"),
        run_sql(spark, sf_dir, views.COMMITS, "orders"),
        run_sql(spark, sf_dir, views.VERSIONS, "orders"), views.AS_OF,
    )
    return told.select("issue_id", "archaeology.*")


@query(_OWNED + """
SELECT count(*) FILTER (investigated) AS investigated, count(*) AS asked FROM told""")
def q_archaeology_counts(spark, sf_dir):
    told = history.investigate(
        run_sql(spark, sf_dir, views.HISTORY_ISSUES, "events"),
        run_sql(spark, sf_dir, views.COMMITS, "orders"),
        run_sql(spark, sf_dir, views.VERSIONS, "orders"), views.AS_OF,
    )
    return history.counters(told)


@query(_I + """,
first AS (SELECT * FROM i WHERE coalesce(confidence, 0) >= 0.8)
SELECT i.seq, i.function, t.s AS story
FROM i LEFT JOIN (SELECT function, max(seq) AS s FROM first GROUP BY 1) t USING (function)
""")
def q_attach_archaeology(spark, sf_dir):
    """Stories of high-confidence issues copied to every issue of the same chunk."""
    found = issues_v(spark, sf_dir).withColumns(
        {"chunk_id": F.col("function"), "issue_id": F.col("seq")}
    )
    first = I.first_high_confidence(found).withColumn("archaeology", F.col("seq"))
    return history.attach(found, first).select(
        "seq", "function", F.col("archaeology").alias("story")
    )


@query("""
SELECT o_orderkey,
       'c' || lpad(CAST(o_orderkey AS VARCHAR), 39, '0') AS commit_hash,
       'Dev ' || o_orderkey % 17 AS author,
       'dev' || o_orderkey % 17 || '@example.org' AS author_mail,
       CASE o_orderkey % 9 WHEN 2 THEN 0 ELSE 946684800 + o_orderkey END AS ts_epoch,
       o_orderpriority AS summary
FROM orders WHERE o_orderkey % 9 > 1
UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL FROM orders
WHERE o_orderkey % 9 <= 1""")
def q_blame_parse(spark, sf_dir):
    texts = run_sql(spark, sf_dir, views.BLAME_TEXT, "orders")
    return texts.select(
        "o_orderkey", history.parse_blame(F.col("porcelain")).alias("b")
    ).select("o_orderkey", "b.*")


# --- prompts, responses, patches -------------------------------------------------------------

_STANDARD = _q(fixed.STANDARD_PROMPT)
_MESSAGE = f"""CASE type {' '.join(
    f"WHEN {_q(k)} THEN {_q(v)}" for k, v in fixed.RULE_MESSAGES.items()
    if k not in ('mutable_default_argument', 'exec_usage'))}
  WHEN 'exec_usage' THEN CASE severity WHEN 'medium'
      THEN {_q(fixed.RULE_MESSAGES['exec_usage_from_file'])}
      ELSE {_q(fixed.RULE_MESSAGES['exec_usage'])} END
  ELSE replace({_q(fixed.RULE_MESSAGES['mutable_default_argument'])}, '%s', function_name)
  END"""


def _work(spark, sf_dir):
    # Both tables are read more than once, so they are stored first.
    corpus = cut(fact_chunks(spark, sf_dir))
    found = cut(I.union(rules=rules.scan(corpus)))
    return P.with_chunks(found, corpus)


@query(CTES + f"""
SELECT chunk_id, replace(replace(replace(replace(replace({_STANDARD},
           '{{type}}', type), '{{severity}}', severity), '{{message}}', {_MESSAGE}),
           '{{function}}', function_name), '{{code}}', code) AS prompt
FROM hit""")
def q_prompts(spark, sf_dir):
    return P.prompts(_work(spark, sf_dir)).select("chunk_id", "prompt")


@query(CTES + f"""
SELECT function_name AS function, file_path AS file, chunk_id, type AS issue_type, severity,
       'rule_based' AS patch_source, code AS original_code,
       CASE type {' '.join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in
                           fixed.PATCH_TEMPLATES.items())} END AS suggested_fix
FROM hit""")
def q_patches(spark, sf_dir):
    return P.choose(_work(spark, sf_dir)).select(
        "function", "file", "chunk_id", "issue_type", "severity", "patch_source",
        "original_code", "suggested_fix",
    )


@query("WITH r AS (" + oracle_view(views.FENCED) + r""")
SELECT conv_id, turn,
       CASE WHEN (conv_id + turn) % 3 = 1 THEN response
            ELSE trim(regexp_replace(regexp_replace(response, '^ ```python\n', ''),
                                     '\n  ``` $', ''), ' ' || chr(10)) END AS cleaned
FROM r""")
def q_clean_response(spark, sf_dir):
    responses = run_sql(spark, sf_dir, views.FENCED, "conversations")
    return responses.select(
        "conv_id", "turn", P.clean_response(F.col("response")).alias("cleaned")
    )


@query("""
SELECT conv_id, turn, (conv_id + turn) % 4 IN (0, 3) AS is_valid FROM conversations""")
def q_check_responses(spark, sf_dir):
    responses = run_sql(spark, sf_dir, views.RESPONSES, "conversations")
    return P.check_responses(responses).select("conv_id", "turn", "is_valid")


_TYPED = """
SELECT conv_id * 1000 + turn AS issue_id,
       CASE turn % 5 WHEN 0 THEN 'eval_usage' WHEN 1 THEN 'taint_flow' WHEN 2 THEN 'odd'
            WHEN 3 THEN 'dna_violation' ELSE 'statistical_anomaly' END AS type,
       CASE conv_id % 3 WHEN 0 THEN 'print_in_logging_codebase' ELSE 'type_hints_violation'
            END AS subtype
FROM {conversations}"""


@query("WITH t AS (" + _TYPED.replace("{conversations}", "conversations") + f"),\nr AS ("
       + oracle_view(views.RESPONSES) + f"""),
v AS (SELECT conv_id * 1000 + turn AS issue_id, (conv_id + turn) % 4 AS c, conv_id, turn
      FROM r)
SELECT issue_id, type AS issue_type,
       CASE WHEN type IN ('eval_usage', 'odd') AND c IN (0, 3)
                 THEN CASE WHEN c = 0 THEN 'llamacpp+rag' ELSE 'llamacpp' END
            WHEN type = 'odd' THEN 'none' ELSE 'rule_based' END AS patch_source,
       CASE WHEN type IN ('eval_usage', 'odd') AND c = 0
                 THEN 'def fix_' || conv_id || '(x):' || chr(10) || '    return ' || turn
            WHEN type IN ('eval_usage', 'odd') AND c = 3
                 THEN 'async def f():' || chr(10) || '    await g(' || conv_id || ')'
            WHEN type = 'odd' THEN 'No automated patch for ''odd''. Manual review required.'
            WHEN type = 'eval_usage' THEN {_q(fixed.PATCH_TEMPLATES['eval_usage'])}
            WHEN type = 'taint_flow' THEN replace(replace(
                {_q(fixed.PATCH_TEMPLATES['taint_flow'])}, '{{path}}', 'a → b'), '{{sink}}', 'b')
            WHEN type = 'statistical_anomaly' THEN replace(
                {_q(fixed.PATCH_TEMPLATES['statistical_anomaly'])}, '{{score}}', '-0.487')
            WHEN subtype = 'print_in_logging_codebase' THEN 'Convention violation: m'
                 || chr(10) || chr(10)
                 || {_q(fixed.CONVENTION_ADVICE['print_in_logging_codebase'])}
            ELSE 'Convention violation (' || subtype || '):' || chr(10) || 'm' || chr(10)
                 || chr(10) || 'Align with the dominant convention in this codebase.' END
         AS suggested_fix
FROM t JOIN v USING (issue_id)""")
def q_choose_patches(spark, sf_dir):
    """All ways a patch is chosen: response, template, advice, none."""
    found = run_sql(spark, sf_dir, _TYPED, "conversations").select(
        "issue_id", "type", "subtype", F.lit("high").alias("severity"),
        F.lit("m").alias("message"), F.lit("f").alias("function"),
        F.lit("a.py").alias("file"), F.lit("c1").alias("chunk_id"),
        F.lit("a → b").alias("taint_path"), F.lit("b").alias("sink_function"),
        F.lit(-0.487).alias("anomaly_score"),
        F.lit(None).cast("string").alias("pattern_label"),
        F.lit(None).cast("double").alias("similarity_score"),
        F.lit("f").alias("chunk_function"), F.lit("a.py").alias("chunk_file"),
        F.lit("x").alias("chunk_code"),
    )
    asked = (F.col("conv_id") + F.col("turn")) % 4
    responses = run_sql(spark, sf_dir, views.RESPONSES, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("issue_id"), "response",
        F.when(asked == 0, "retrieval").otherwise("standard").alias("kind"),
    )
    return P.choose(found, responses).select(
        "issue_id", "issue_type", "patch_source", "suggested_fix"
    )


# --- verification -----------------------------------------------------------------------------


@query("""
SELECT o_orderkey AS issue_id, true AS runnable, CAST(o_custkey % 7 AS INT) AS passed,
       CAST(o_orderkey % 3 AS INT) AS failed,
       CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS errors,
       CAST(o_custkey % 7 + o_orderkey % 3 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END
            AS INT) AS total,
       o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AS clean
FROM orders""")
def q_test_output(spark, sf_dir):
    runs = run_sql(spark, sf_dir, views.ALL_RUNS, "orders")
    parsed = runs.select(
        "issue_id", V.parse_test_output(F.col("stdout"), F.col("stderr")).alias("r")
    )
    r = F.col("r")
    return parsed.select(
        "issue_id", "r.runnable", "r.passed", "r.failed", "r.errors",
        V.run_total(r).alias("total"), V.run_is_clean(r).alias("clean"),
    )


def _verified(spark, sf_dir):
    baselines = spark.createDataFrame(
        [("r0", "3 passed, 1 failed", ""), ("r1", "nothing to do", ""),
         ("r2", "2 passed, 2 failed", ", 1 error")],
        "repo string, stdout string, stderr string",
    )
    return V.verify(
        run_sql(spark, sf_dir, views.RUN_PATCHES, "orders"), baselines,
        run_sql(spark, sf_dir, views.RUNS, "orders"),
    )


_VERDICT = """
WITH o AS (
    SELECT o_orderkey AS issue_id, o_custkey % 3 AS repo, o_custkey % 7 AS p,
           o_orderkey % 3 AS f, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS e,
           CASE o_custkey % 3 WHEN 0 THEN 3 ELSE 2 END AS bp,
           CASE o_custkey % 3 WHEN 0 THEN 1 ELSE 2 END AS bf,
           CASE o_custkey % 3 WHEN 0 THEN 0 ELSE 1 END AS be,
           o_orderkey % 13 <> 0 AS tested, o_custkey % 3 = 1 AS no_suite,
           o_orderkey % 11 = 0 AS unapplied
    FROM orders),
w AS (SELECT *, CASE WHEN tested AND NOT no_suite AND NOT unapplied
                     THEN p >= bp AND f <= bf AND e <= be END AS verified FROM o)
"""


@query(_VERDICT + """
SELECT issue_id, verified,
       CASE WHEN NOT tested THEN NULL WHEN no_suite THEN 0 ELSE bp END AS baseline_pass,
       CASE WHEN NOT tested THEN NULL WHEN no_suite THEN 0 ELSE bf END AS baseline_fail,
       CASE WHEN verified IS NOT NULL THEN CAST(p AS INT) END AS after_pass,
       CASE WHEN verified IS NOT NULL THEN CAST(f AS INT) END AS after_fail,
       CAST(CASE WHEN NOT tested THEN NULL WHEN verified IS NULL THEN 0.0
            WHEN verified THEN 0.15 ELSE -0.3 END AS DOUBLE) AS confidence_boost,
       CASE WHEN NOT tested THEN NULL
            WHEN no_suite THEN 'No runnable pytest suite found — add tests to enable patch verification'
            WHEN unapplied THEN 'Patch could not be applied — original code not found in target file'
            WHEN verified THEN 'Tests stable after patch (' || p || ' passed, ' || f
                 || ' failed) — fix is safe ✅'
            ELSE 'Tests degraded — before: ' || bp || 'p/' || bf || 'f, after: ' || p || 'p/'
                 || f || 'f — fix rejected ❌' END AS reason
FROM w""")
def q_verdicts(spark, sf_dir):
    return _verified(spark, sf_dir).select("issue_id", "verification.*")


@query(_VERDICT + """
SELECT count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS rejected,
       count(*) FILTER (tested AND verified IS NULL) AS unverifiable FROM w""")
def q_verdict_counts(spark, sf_dir):
    return V.counters(_verified(spark, sf_dir))


@query("""
SELECT doc_id, CASE WHEN position('the' IN text) > 0
    THEN left(text, position('the' IN text) - 1) || 'fix' || doc_id
         || substr(text, position('the' IN text) + 3) END AS patched
FROM documents""")
def q_apply_patch(spark, sf_dir):
    fix = F.concat(F.lit(" fix"), F.col("doc_id"), F.lit("\n"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", V.apply_patch(F.col("text"), F.lit(" the "), fix).alias("patched")
    )


@query("""
SELECT event_id, concat('src/u', user_id, '.py') AS target FROM events""")
def q_relative_paths(spark, sf_dir):
    """Absolute and relative patch files of one repository."""
    name = F.concat(F.lit("src/u"), F.col("user_id"), F.lit(".py"))
    absolute = F.concat(F.lit("/work/repo/"), name)
    file = F.when(F.col("event_type") == "click", absolute).otherwise(name)
    return table(spark, sf_dir, "events").select(
        "event_id", V.relative_path(file, "/work/repo/").alias("target")
    )
