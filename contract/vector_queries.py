"""Queries over vectors and over the call graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codequarry.operators import callgraph, ivf, neighbours, outliers, patches as P
from codequarry.functions import vectors as V
from codequarry.plans.checkpoints import cut, work_folder
from codequarry.streaming import changing_index

from . import views
from .registry import query
from .views import oracle_view, run_sql, table

PATTERNS_BELOW = 15
THRESHOLD = 0.30


def _library(spark, sf_dir):
    """(patterns, chunks): the first vectors are the pattern library."""
    v = table(spark, sf_dir, "embeddings")
    patterns = v.where(F.col("vec_id") < PATTERNS_BELOW).select(
        F.col("vec_id").cast("int").alias("ord"),
        F.concat(F.lit("label"), "vec_id").alias("label"),
        F.concat(F.lit("pattern"), "vec_id").alias("pattern"), "embedding",
    )
    chunks = run_sql(spark, sf_dir, views.VECTOR_CHUNKS, "embeddings").where(
        F.col("chunk_id") >= PATTERNS_BELOW
    )
    return patterns, chunks


_BEST = """
WITH s AS (
    SELECT c.vec_id AS chunk_id, c.label, p.vec_id AS ord,
           list_cosine_similarity(CAST(c.embedding AS DOUBLE[]),
                                  CAST(p.embedding AS DOUBLE[])) AS score
    FROM embeddings c, embeddings p WHERE c.vec_id >= 15 AND p.vec_id < 15),
best AS (SELECT *, row_number() OVER (PARTITION BY chunk_id
             ORDER BY round(score, 6) DESC, ord) AS rn FROM s)"""


@query(_BEST + """
SELECT chunk_id, CAST(ord AS INT) AS best_ord, round(score, 6) AS best_score
FROM best WHERE rn = 1""")
def q_cosine_best(spark, sf_dir):
    patterns, chunks = _library(spark, sf_dir)
    return neighbours.best_pattern(chunks, patterns).select(
        "chunk_id", "best_ord", F.round("best_score", 6).alias("best_score")
    )


@query(_BEST + f"""
SELECT chunk_id, 'f' || label AS function, 'pattern' || ord AS matched_pattern,
       'label' || ord AS pattern_label, round_even(score, 4) AS similarity_score,
       'def f' || label || '():     return ' || chunk_id AS code_snippet,
       'Code is semantically similar to known anti-pattern ''label' || ord
         || ''' (similarity: ' || CAST(round_even(score * 100, 1) AS VARCHAR)
         || '%). Manual review recommended.' AS message
FROM best WHERE rn = 1 AND score >= {THRESHOLD}""")
def q_semantic_flags(spark, sf_dir):
    patterns, chunks = _library(spark, sf_dir)
    return neighbours.semantic_flags(chunks, patterns, THRESHOLD).select(
        "chunk_id", "function", "matched_pattern", "pattern_label", "similarity_score",
        "code_snippet", "message",
    )


@query("""
SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]),
           CAST(r.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings e JOIN embeddings r ON r.vec_id = e.vec_id + 1""")
def q_cosine_expression(spark, sf_dir):
    """The cosine expression between neighbours in id order."""
    v = table(spark, sf_dir, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(after, "vec_id").select(
        "vec_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity")
    )


_TOP = """
WITH s AS (
    SELECT q.vec_id AS chunk_id, q.label AS own, i.vec_id AS similar_id, i.label,
           round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]),
                                        CAST(i.embedding AS DOUBLE[])), 6) AS sim
    FROM embeddings q, embeddings i),
near AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY sim DESC, similar_id)
             AS rank FROM s),
other AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY rank) AS n
          FROM near WHERE rank <= 4 AND label <> own)"""


def _vector_tables(spark, sf_dir):
    chunks = run_sql(spark, sf_dir, views.VECTOR_CHUNKS, "embeddings")
    return chunks, neighbours.index_rows(chunks)


@query(_TOP + """
SELECT chunk_id, CAST(n AS INT) AS n, similar_id, 'f' || label AS function,
       'v' || similar_id || '.py' AS file, round_even(sim, 3) AS similarity
FROM other WHERE n <= 3""")
def q_topk_similar(spark, sf_dir):
    chunks, index = _vector_tables(spark, sf_dir)
    return neighbours.similar_functions(chunks, index, 3).drop("code")


@query(_TOP + """
SELECT chunk_id AS query_id, similar_id AS id, sim AS similarity, CAST(rank AS INT) AS rank
FROM near WHERE rank <= 4""")
def q_nearest_packed(spark, sf_dir):
    """The same search with both sides in packs, as for two large sides."""
    v = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(
        v.select(F.col("vec_id").alias("query_id"), "embedding"),
        v.select(F.col("vec_id").alias("id"), "embedding"), 4, packed=True,
    )


@query("""
WITH s AS (
    SELECT q.vec_id AS query_id, i.vec_id AS id,
           round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]),
                                        CAST(i.embedding AS DOUBLE[])), 6) AS similarity
    FROM embeddings q JOIN embeddings i ON q.label = i.label),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
             ORDER BY similarity DESC, id) AS INT) AS rank FROM s)
SELECT * FROM near WHERE rank <= 4""")
def q_nearest_within(spark, sf_dir):
    """Nearest rows within the same group (one collection per repository)."""
    v = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(
        v.select(F.col("vec_id").alias("query_id"), "label", "embedding"),
        v.select(F.col("vec_id").alias("id"), "label", "embedding"), 4,
        within=("label",),
    )


@query()
def q_nearest_hashed(spark, sf_dir):
    """Nearest rows by hash buckets (approximate, so without an oracle)."""
    v = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(
        v.select(F.col("vec_id").alias("query_id"), "embedding"),
        v.select(F.col("vec_id").alias("id"), "embedding"), 4, tables=4, bits=6,
    )


_ASKED = """
WITH s AS (
    SELECT q.vec_id AS query_id, i.vec_id AS id,
           round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]),
                                        CAST(i.embedding AS DOUBLE[])), 6) AS similarity
    FROM embeddings q, embeddings i WHERE q.vec_id % 50 = 0),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
             ORDER BY similarity DESC, id) AS INT) AS rank FROM s)"""


def _stored_index(spark, sf_dir):
    """(index over all vectors, the queries)."""
    v = table(spark, sf_dir, "embeddings")
    path = f"{work_folder(spark)}/ivf-{uuid.uuid4().hex}"
    index = ivf.build(v.select(F.col("vec_id").alias("id"), "embedding"), path)
    return index, v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query(_ASKED + " SELECT * FROM near WHERE rank <= 10")
def q_nearest_ivf(spark, sf_dir):
    """Ten nearest rows by the inverted-file index: nearest cells first, then all that may hold better."""
    index, queries = _stored_index(spark, sf_dir)
    return index.search(queries, 10, exact=True)


@query(_ASKED + """
SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS reached,
       count(*) AS scored_right FROM near WHERE rank <= 10""")
def q_ivf_recall(spark, sf_dir):
    """Probing as many cells as the sample asks for: recall of at least 0.9 against brute force, and
    every score that of the pair."""
    index, queries = _stored_index(spark, sf_dir)
    found = cut(index.search(queries, 10, probes=index.probes_for(0.95, 10)))
    rows = index.rows().select("id", "embedding")
    true = cut(neighbours.nearest(queries, rows, 10, packed=True))
    score = F.abs(F.round(V.cosine(F.col("embedding"), F.col("own")), 6) - F.col("similarity")) <= 1.5e-6
    checked = (
        found.join(rows, "id").join(queries.withColumnRenamed("embedding", "own"), "query_id")
        .agg(F.count_if(score).alias("scored_right"))
    )
    return ivf.recall(found, true).select(
        "queries", "neighbours", (F.col("found") >= 0.9 * F.col("neighbours")).alias("reached"),
        checked.scalar().alias("scored_right"))


@query("""
SELECT vec_id AS chunk_id, 'f' || label AS function, 'src/v' || vec_id || '.py' AS file,
       '1' AS start
FROM embeddings WHERE label >= 5""")
def q_index_new(spark, sf_dir):
    """Rows to add to an index that already holds the labels below five."""
    chunks, rows = _vector_tables(spark, sf_dir)
    held = table(spark, sf_dir, "embeddings").where(F.col("label") < 5)
    index = held.select(F.col("vec_id").alias("chunk_id"))
    return neighbours.new_rows(rows, index).select("chunk_id", "function", "file", "start")


# Two batches: the labels below seven, then all of two of three repositories, with some chunks
# changed, some new and some gone.
_SECOND = "label % 3 < 2 AND vec_id % 4 <> 3"
_CODE = "'def f' || label || '():' || chr(10) || '    return ' || vec_id"


def _changed_index(spark, sf_dir):
    """(path, counts of the second batch) of an index after both batches, the second one twice."""
    chunks = run_sql(spark, sf_dir, views.VECTOR_CHUNKS, "embeddings")
    label = F.substring("function_name", 2, 9).cast("int")
    chunks = chunks.withColumn("repo", F.concat(F.lit("r"), label % 3))
    number = F.col("chunk_id")
    path = f"{work_folder(spark)}/changing-{uuid.uuid4().hex}"

    def batch(of):
        return of.withColumn("chunk_id", number.cast("string"))

    second = chunks.where((label % 3 < 2) & (number % 4 != 3)).withColumn(
        "code", F.when(number % 5 == 0, F.concat("code", F.lit(" + 1"))).otherwise(F.col("code")))
    changing_index.apply(batch(chunks.where(label < 7)), path, 1)
    counts = cut(changing_index.apply(batch(second), path, 2, whole=True))
    changing_index.apply(batch(second), path, 2, whole=True)
    return path, counts


@query(f"""
SELECT 'r' || label % 3 AS repo, CAST(vec_id AS VARCHAR) AS chunk_id, 'f' || label AS function,
       'src/v' || vec_id || '.py' AS file, '1' AS start,
       CASE WHEN {_SECOND} AND vec_id % 5 = 0 THEN {_CODE} || ' + 1' ELSE {_CODE} END AS code,
       CAST(embedding[1] AS DOUBLE) AS first
FROM embeddings WHERE {_SECOND} OR (label % 3 = 2 AND label < 7)""")
def q_index_changes(spark, sf_dir):
    """The index after changed, new, unchanged and vanished chunks, and a replay."""
    path, _ = _changed_index(spark, sf_dir)
    changing_index.compact(spark, path)
    return changing_index.read(spark, path).select(
        "repo", "chunk_id", "function", "file", "start", "code", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query(f"""
SELECT 'r' || label % 3 AS repo,
       CASE WHEN NOT ({_SECOND}) THEN 'gone' WHEN label >= 7 THEN 'new'
            WHEN vec_id % 5 = 0 THEN 'changed' ELSE 'same' END AS change, count(*) AS rows
FROM embeddings WHERE {_SECOND} OR (label % 3 < 2 AND label < 7) GROUP BY ALL""")
def q_index_change_counts(spark, sf_dir):
    """What the second batch did to each of its repositories."""
    return _changed_index(spark, sf_dir)[1]


@query("""
SELECT 'f' || label AS repo, count(*) AS rows FROM embeddings GROUP BY 1
UNION ALL SELECT NULL, count(*) FROM embeddings""")
def q_index_size(spark, sf_dir):
    """How many chunks the index holds, by repository and in all."""
    chunks, _ = _vector_tables(spark, sf_dir)
    return neighbours.index_size(neighbours.index_rows(chunks.withColumn("repo", F.col("function_name"))))


@query()
def q_outliers(spark, sf_dir):
    chunks = run_sql(spark, sf_dir, views.VECTOR_CHUNKS, "embeddings")
    return outliers.flag(
        chunks.withColumn("chunk_id", F.col("chunk_id").cast("string"))
    ).select("chunk_id", "function", "severity", "confidence", "anomaly_score", "message")


@query("""
SELECT count(*) AS chunks,
       CAST(floor(0.05 * (count(*) - 1)) + 1 AS BIGINT) AS flagged,
       CAST(floor(0.05 * (count(*) - 1)) + 1 AS BIGINT) AS most_isolated,
       CAST(floor(0.05 * (count(*) - 1)) + 1 AS BIGINT) AS told_right
FROM embeddings""")
def q_outlier_rule(spark, sf_dir):
    """What the flagged outliers have to be, whatever the forest: as many as lie below the
    interpolated quantile, with lower scores than all others, and with the confidence and the
    text that follow from their score."""
    chunks = run_sql(spark, sf_dir, views.VECTOR_CHUNKS, "embeddings").withColumn(
        "chunk_id", F.col("chunk_id").cast("string"))
    flagged = cut(outliers.flag(chunks))
    scored = cut(outliers.score(chunks, outliers.fit(chunks)).select("chunk_id", F.bround("score", 4).alias("s")))
    low = scored.join(flagged, "chunk_id", "left_anti").agg(F.min("s").alias("low")).select("low").scalar()
    chunks = scored.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    s = F.col("anomaly_score")
    near = F.abs(F.col("confidence") - F.least(F.lit(1.0), -2 * s)) <= 0.0011
    text = F.col("message").contains("'") | F.col("message").contains(F.col("function"))
    return flagged.join(scored, "chunk_id").withColumn("low", low).agg(
        F.count(F.lit(1)).alias("flagged"), F.count_if(s <= F.col("low")).alias("most_isolated"),
        F.count_if(near & text & (s == F.col("s"))).alias("told_right"),
    ).withColumn("chunks", chunks)


@query("""
SELECT 'r' || label % 3 AS repo, count(*) AS chunks,
       CAST(floor(0.05 * (count(*) - 1)) + 1 AS BIGINT) AS flagged,
       CAST(floor(0.05 * (count(*) - 1)) + 1 AS BIGINT) AS most_isolated
FROM embeddings GROUP BY 1""")
def q_outlier_rule_by_repo(spark, sf_dir):
    """The same of every repository by itself, with a forest and a cut of its own."""
    chunks = run_sql(spark, sf_dir, views.VECTOR_CHUNKS, "embeddings").withColumn(
        "chunk_id", F.col("chunk_id").cast("string"))
    label = F.substring("function_name", 2, 9).cast("int")
    chunks = cut(chunks.withColumn("repo", F.concat(F.lit("r"), label % 3)))
    flagged = cut(outliers.flag(chunks))
    forests = outliers.grow_forests(chunks, outliers.DEFAULT_CONFIG, "repo")
    scored = cut(outliers.score_by_group(chunks, forests, "repo").select("repo", "chunk_id", F.bround("score", 4).alias("s")))
    low = scored.join(flagged, ["repo", "chunk_id"], "left_anti").groupBy("repo").agg(F.min("s").alias("low"))
    n = scored.groupBy("repo").agg(F.count(F.lit(1)).alias("chunks"))
    told = flagged.join(scored, ["repo", "chunk_id"]).join(low, "repo").groupBy("repo").agg(
        F.count(F.lit(1)).alias("flagged"),
        F.count_if((F.col("anomaly_score") <= F.col("low")) & (F.col("anomaly_score") == F.col("s"))).alias("most_isolated"))
    return n.join(told, "repo")


@query("""
SELECT event_id, round_even(greatest(0.0, least(1.0, 2.0 * (event_id % 997) / 996.0)), 3) AS confidence
FROM events""")
def q_outlier_confidence(spark, sf_dir):
    scores = table(spark, sf_dir, "events").withColumn("score", -(F.col("event_id") % 997) / 996.0)
    return scores.select("event_id", outliers.confidence(F.col("score")).alias("confidence"))


# --- retrieval prompts -------------------------------------------------------------------------

_RETRIEVAL = views._q(P.fixed.RETRIEVAL_PROMPT)


@query(_TOP + f""",
ex AS (
    SELECT chunk_id, {views._q(P.fixed.RETRIEVAL_EXAMPLES_HEAD)} || string_agg(
        'Example ' || n || ' — f' || label || '() in v' || similar_id
        || '.py (similarity: ' || CAST(round_even(round_even(sim, 3) * 100, 0) AS INT)
        || '%):' || chr(10) || '```python' || chr(10) || 'def f' || label || '():' || chr(10)
        || '    return ' || similar_id || chr(10) || '```', chr(10) || chr(10) ORDER BY n)
        || chr(10) AS examples
    FROM other WHERE n <= 3 GROUP BY chunk_id)
SELECT vec_id AS issue_id, vec_id AS chunk_id, CASE WHEN examples IS NULL THEN 'standard'
           ELSE 'retrieval' END AS kind,
       replace(replace(replace(replace(replace(replace(replace(
           CASE WHEN examples IS NULL THEN {views._q(P.fixed.STANDARD_PROMPT)}
                ELSE {_RETRIEVAL} END,
           '{{type}}', 'eval_usage'), '{{severity}}', 'high'), '{{message}}', 'm'),
           '{{file}}', 'v' || vec_id || '.py'), '{{function}}', 'f' || label),
           '{{code}}', 'def f' || label || '():' || chr(10) || '    return ' || vec_id),
           '{{examples}}', coalesce(examples, '')) AS prompt
FROM embeddings LEFT JOIN ex ON chunk_id = vec_id""")
def q_retrieval_prompts(spark, sf_dir):
    """One eval finding per vector chunk, with similar functions in the prompt."""
    chunks, index = _vector_tables(spark, sf_dir)
    found = chunks.select(
        F.col("chunk_id").alias("issue_id"), "chunk_id", F.lit("eval_usage").alias("type"),
        F.lit("high").alias("severity"), F.lit("m").alias("message"),
        F.col("function_name").alias("function"), F.col("file_path").alias("file"),
        F.lit("").alias("code_snippet"),
    )
    similar = neighbours.similar_functions(chunks, index, 3)
    return P.prompts(P.with_chunks(found, chunks), similar)


# --- source-to-sink paths -------------------------------------------------------------------------


def graph(spark, sf_dir, view=views.EDGES):
    edges = cut(run_sql(spark, sf_dir, view, "events"))
    names = edges.select("repo", F.col("caller").alias("name")).union(
        edges.select("repo", "callee")
    ).distinct()
    part = F.split("name", "_")
    user = F.substring(part[0], 2, 20).cast("long")
    layer = F.element_at(part, -1).cast("int")
    nodes = names.select(
        "*", ((layer == 0) & (user % 5 == 0)).alias("is_source"),
        ((layer >= 3) & (user % 11 == 0)).alias("is_sink"),
        F.concat(F.lit("src/"), "name", F.lit(".py")).alias("file_path"),
        layer.alias("start_line"), F.concat(F.lit("def "), "name").alias("code"),
    )
    return edges, nodes


def _paths(view):
    return f"""
WITH RECURSIVE edge AS ({oracle_view(view)}),
node AS (
    SELECT name, CAST(string_split(name, '_')[1][2:] AS BIGINT) AS u,
           CAST(string_split(name, '_')[-1] AS INT) AS layer
    FROM (SELECT caller AS name FROM edge UNION SELECT callee FROM edge)),
walk AS (
    SELECT name AS source, name AS node, [name] AS path, CAST([] AS BIGINT[]) AS ords,
           false AS ended
    FROM node WHERE layer = 0 AND u % 5 = 0
    UNION ALL
    SELECT w.source, e.callee, list_append(w.path, e.callee), list_append(w.ords, e.ordinal),
           n.layer >= 3 AND n.u % 11 = 0
    FROM walk w JOIN edge e ON e.caller = w.node JOIN node n ON n.name = e.callee
    WHERE NOT w.ended AND NOT list_contains(w.path, e.callee)),
first AS (SELECT source, arg_min(path, ords) AS path FROM walk WHERE ended GROUP BY source)
"""


_PATHS = _paths(views.EDGES)


@query(_PATHS + "SELECT source, array_to_string(path, ' > ') AS path FROM first")
def q_taint_paths(spark, sf_dir):
    edges, nodes = graph(spark, sf_dir)
    return callgraph.sink_paths(edges, nodes).select(
        "source", F.array_join("path", " > ").alias("path")
    )


@query(_paths(views.EDGES_CYCLIC) + "SELECT source, array_to_string(path, ' > ') AS path FROM first")
def q_taint_cycles(spark, sf_dir):
    """Paths in a graph with cycles, where the first live call often leads back."""
    edges, nodes = graph(spark, sf_dir, views.EDGES_CYCLIC)
    return callgraph.sink_paths(edges, nodes).select(
        "source", F.array_join("path", " > ").alias("path")
    )


@query(_PATHS + """
SELECT 'taint_flow' AS type, source AS function, 'src/' || source || '.py' AS file,
       'taint_' || source || '_' || path[-1] AS chunk_id,
       array_to_string(path, ' → ') AS taint_path, path[-1] AS sink_function,
       'src/' || path[-1] || '.py' AS sink_file,
       CAST(string_split(path[-1], '_')[-1] AS INT) AS sink_line,
       CAST(0.8 AS DOUBLE) AS confidence,
       'User-controlled input enters at ''' || source || ''' and reaches dangerous operation in '''
         || path[-1] || ''' via ' || len(path) - 1 || ' call(s): '
         || array_to_string(path, ' → ') || '. Potential injection vulnerability — verify all'
         || ' input is sanitized before reaching ''' || path[-1] || '''.' AS message
FROM first""")
def q_taint_issues(spark, sf_dir):
    edges, nodes = graph(spark, sf_dir)
    return callgraph.taint_issues(callgraph.sink_paths(edges, nodes), nodes).select(
        "type", "function", "file", "chunk_id", "taint_path", "sink_function", "sink_file",
        "sink_line", "confidence", "message",
    )


@query(_PATHS + """
SELECT count(*) FILTER (layer = 0 AND u % 5 = 0) AS sources,
       count(*) FILTER (layer >= 3 AND u % 11 = 0) AS sinks,
       (SELECT count(*) FROM first) AS flows FROM node""")
def q_taint_counts(spark, sf_dir):
    edges, nodes = graph(spark, sf_dir)
    return callgraph.counters(nodes, callgraph.sink_paths(edges, nodes))
