"""The issue table: union of detectors, explicit order, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ISSUE_SCHEMA = {
    "repo": "string", "type": "string", "severity": "string", "confidence": "double",
    "function": "string", "file": "string", "line_number": "int", "file_line": "int",
    "code_snippet": "string", "chunk_id": "string", "message": "string",
    "similarity_score": "double", "matched_pattern": "string", "pattern_label": "string",
    "anomaly_score": "double", "taint_path": "string", "sink_function": "string",
    "sink_file": "string", "sink_line": "int", "subtype": "string", "pattern": "string",
}
# Position of a detector's rows in the union.
STAGES = ("rules", "semantic", "anomaly", "convention", "taint")
_ORDER = {"rel_path": "string", "func_seq": "int", "part": "int", "rule_seq": "int",
          "hit_seq": "int"}


def _typed(df: DataFrame, stage: int) -> DataFrame:
    """All issue columns (absent ones NULL) and ``seq``, the order of detection."""
    def column(name: str, kind: str) -> Column:
        value = F.col(name) if name in df.columns else F.lit(None)
        return value.cast(kind).alias(name)

    def order(name: str, kind: str) -> Column:
        return F.coalesce(column(name, kind), F.lit(0).cast(kind))

    # Within a stage: conventions go pattern by pattern, all others chunk by chunk.
    place = [
        F.split(order("rel_path", "string"), "/").alias("path"),
        order("func_seq", "int").alias("func"), order("part", "int").alias("part"),
    ]
    rule = [order("rule_seq", "int").alias("rule"), order("hit_seq", "int").alias("hit")]
    first = order("rule_seq", "int") if STAGES[stage] == "convention" else F.lit(0)
    seq = F.struct(
        F.lit(stage).alias("stage"), first.alias("pass"), *place, *rule,
        F.coalesce(column("function", "string"), F.lit("")).alias("name"),
    )
    return df.select(
        *[column(k, v) for k, v in ISSUE_SCHEMA.items()], seq.alias("seq")
    )


def union(**detected: DataFrame | None) -> DataFrame:
    """Bag union of detector outputs given by stage name."""
    out = None
    for n, name in enumerate(STAGES):
        df = detected.pop(name, None)
        if df is not None:
            typed = _typed(df, n)
            out = typed if out is None else out.unionByName(typed)
    if detected:
        raise ValueError(f"unknown stages: {sorted(detected)}")
    if out is None:
        raise ValueError("no detector output given")
    key = F.to_json(F.struct("repo", "type", "chunk_id", "seq"))
    return out.withColumn("issue_id", F.sha2(key, 256))


def at_least(issues: DataFrame, threshold: float) -> DataFrame:
    """Issues of that confidence or more; an absent confidence counts as 0."""
    return issues.where(F.coalesce("confidence", F.lit(0.0)) >= threshold)


def first_high_confidence(
    issues: DataFrame, threshold: float = 0.80, cap: int | None = None
) -> DataFrame:
    """High-confidence issues; with a ``cap`` the first so many in order of detection, of
    each repo where issues have one."""
    found = at_least(issues, threshold)
    if cap is None:
        return found
    if "repo" not in issues.columns:
        return found.orderBy("seq").limit(cap)
    # Of each part of a repo the first few, then of what is left the first few again.
    parts = found.withColumn("__part", F.pmod(F.xxhash64("seq"), F.lit(64)))
    for keys in (["repo", "__part"], ["repo"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
        parts = parts.withColumn("__n", place).where(F.col("__n") <= cap)
    return parts.drop("__n", "__part")
