"""The whole run: source files in, tables of findings, patches and metrics out."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fixed
from ..config import DEFAULT_CONFIG, AnalysisConfig
from ..functions.vectors import has_vector
from ..operators import (
    callgraph, chunks as C, conventions, history, issues as I, metrics, neighbours,
    outliers, parse, patches as P, rules, verification as V,
)
from ..operators.embeddings import embed_hashed
from ..sources import files as S
from ..sources.results import save_table
from .checkpoints import cut
from .skew import keep_last_wide


@dataclass(frozen=True)
class Inputs:
    """What comes from outside: an encoder, and tables that other systems produce."""

    embed: Callable[[DataFrame], DataFrame] = embed_hashed
    # ord, label, pattern, embedding; made from the fixed pattern list if not given.
    patterns: DataFrame | None = None
    # issue_id, response, kind
    responses: DataFrame | None = None
    # repo (if there are several), file, line_from, line_to, commit_id, committed_at, commit_seq, author, author_mail,
    # ts_epoch, summary / file, seq, content; files are relative to ``root``.
    line_history: DataFrame | None = None
    versions: DataFrame | None = None
    as_of: int = 0
    root: str = ""
    # repo, stdout, stderr / issue_id, stdout, stderr
    baselines: DataFrame | None = None
    test_runs: DataFrame | None = None


def pattern_library(spark: SparkSession, embed: Callable[[DataFrame], DataFrame]):
    """The known bad patterns with vectors of the same encoder as the chunks."""
    rows = [(i, label, code) for i, (code, label) in enumerate(fixed.BAD_PATTERNS)]
    library = spark.createDataFrame(rows, "ord int, label string, code string")
    return embed(library).withColumnRenamed("code", "pattern")


def read_tree(
    spark: SparkSession, root: str, repo: str, config: AnalysisConfig = DEFAULT_CONFIG
) -> tuple[DataFrame, DataFrame]:
    """(files, rejects). Every readable file is kept for the call graph; ``is_strict``
    marks those whose text is valid UTF-8, which alone are analysed further."""
    raw = S.scan_tree(spark, root, config)
    strict = F.is_valid_utf8(F.col("body").cast("string")).alias("is_strict")
    lossy = S.decode_lossy(raw.withColumn("is_strict", strict), repo, "is_strict")
    _, rejects = S.decode_strict(raw, repo)
    return lossy, rejects


def analyze(
    files: DataFrame,
    config: AnalysisConfig = DEFAULT_CONFIG,
    inputs: Inputs = Inputs(),
    *,
    per_repo: bool = True,
    index: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All result tables of one corpus.

    ``files``: repo, file_path, rel_path, content and optionally ``is_strict``.
    ``per_repo`` learns conventions, looks for similar functions and grows outlier forests
    within each repo; without it, over the corpus. Tables that several stages read are stored once.
    """
    spark = files.sparkSession
    by = ("repo",) if per_repo else ()
    if "is_strict" not in files.columns:
        files = files.withColumn("is_strict", F.lit(True))

    parsed = cut(parse.parse_files(files))
    nodes = cut(callgraph.call_nodes(parsed))
    paths = cut(callgraph.sink_paths(callgraph.call_edges(parsed), nodes))
    taint = callgraph.taint_issues(paths, nodes)

    functions = parse.functions(parsed.where("is_strict"))
    production = C.production_chunks(C.chunk_functions(functions, config), config)
    chunks = cut(inputs.embed(production))

    patterns = inputs.patterns
    if patterns is None:
        patterns = pattern_library(spark, inputs.embed)
    measured = cut(conventions.measure(chunks, by))
    found = I.union(
        rules=rules.scan(chunks),
        semantic=neighbours.semantic_flags(chunks, patterns, config.similarity_threshold),
        anomaly=outliers.flag(chunks, config, per_repo),
        convention=conventions.violations(chunks, measured, by),
        taint=taint,
    )
    issues = cut(found)

    work = cut(P.with_chunks(issues, chunks))
    rows = neighbours.index_rows(chunks)
    searched = rows if index is None else rows.unionByName(index)
    asked = work.where(P.goes_to_model(F.col("type")) & F.col("chunk_has_vector"))
    wanted = asked.select("repo", "chunk_id").distinct()
    similar = cut(
        neighbours.similar_functions(
            _one_per_id(chunks.join(wanted, ["repo", "chunk_id"], "left_semi")), searched, config.neighbours,
            within=by,
        )
    )
    prompts = P.prompts(work, similar)
    patches = P.choose(work, inputs.responses, config.provider)
    if inputs.baselines is not None and inputs.test_runs is not None:
        patches = V.verify(patches, inputs.baselines, inputs.test_runs)
    patches = cut(patches)
    told_of = {"taint_counters": callgraph.counters(nodes, paths)}
    if inputs.baselines is not None and inputs.test_runs is not None:
        told_of["verification_counters"] = V.counters(patches)

    if inputs.line_history is not None and inputs.versions is not None:
        first = I.first_high_confidence(
            issues, config.high_confidence, config.archaeology_cap
        )
        asked_lines = first.select(
            "issue_id", "repo", "chunk_id", "seq",
            V.relative_path(F.col("file"), inputs.root).alias("file"),
            F.col("file_line").alias("line_no"),
        )
        told = cut(history.investigate(
            cut(asked_lines), inputs.line_history, inputs.versions, inputs.as_of
        ))
        issues = cut(history.attach(issues, told))
        told_of["history_counters"] = history.counters(told)

    return {
        "functions": functions, "function_args": parse.function_args(parsed.where("is_strict")),
        "parse_errors": parse.parse_errors(parsed.where("is_strict")),
        "call_nodes": nodes, "call_edges": callgraph.call_edges(parsed),
        "taint_paths": paths, "chunks": chunks, "index": rows,
        "convention_profile": conventions.profile(measured),
        "convention_text": conventions.profile_text(measured),
        "issues": I.at_least(issues, config.min_confidence),
        "issues_high_confidence": I.at_least(issues, config.high_confidence),
        "prompts": prompts, "patches": patches,
        "summary": metrics.summary(chunks, issues),
        "breakdown": metrics.breakdown(issues),
        "patch_metrics": metrics.patch_metrics(issues, patches),
        "patch_sources": metrics.patch_sources(patches),
        "top_files": metrics.top_files(issues),
        "dashboard": metrics.dashboard(
            chunks, issues, patches, None if per_repo else measured,
            config.high_confidence,
        ),
        **told_of,
    }


def _one_per_id(chunks: DataFrame) -> DataFrame:
    """Query vectors: the last chunk of an id, as in the index."""
    place = F.struct("rel_path", "func_seq", "part")
    slim = chunks.where(has_vector(F.col("embedding"))).select(
        "repo", "chunk_id", "function_name", "embedding", place.alias("place")
    )
    return keep_last_wide(slim, ["repo", "chunk_id"], ["place"]).drop("place")


def _counted(name: str, df: DataFrame) -> dict[str, Column]:
    """What is counted of a result table while it is saved, besides its rows."""
    wanted = {}
    if "severity" in df.columns:
        wanted |= {level: F.count_if(F.col("severity") == level) for level in ("high", "medium", "low")}
    if name == "call_nodes":
        wanted |= {"sources": F.count_if("is_source"), "sinks": F.count_if("is_sink")}
    if "archaeology" in df.columns:
        # Every issue of an investigated chunk has its story, asked for or not.
        wanted["with_history"] = F.count_if(F.col("archaeology.investigated"))
    if "verification" in df.columns:
        verified, tested = F.col("verification.verified"), F.col("verification").isNotNull()
        wanted |= {"verified": F.count_if(verified), "rejected": F.count_if(~verified),
                   "unverifiable": F.count_if(tested & verified.isNull())}
    return wanted


def save(results: dict[str, DataFrame], folder: str, *names: str) -> dict[str, dict[str, int]]:
    """Write result tables as Parquet below a folder; all of them if none is named. Returns the
    counters of each table, observed on the write."""
    return {
        name: save_table(results[name], f"{folder.rstrip('/')}/{name}", counters=_counted(name, results[name]))
        for name in names or results
    }
