"""Rollups of issues and patches. Each is one aggregate with partial counts, or a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

BUCKETS = ((">=90%", 0.90), ("70-89%", 0.70), ("50-69%", 0.50), ("<50%", None))


def _percent(part: Column, whole: Column, digits: int) -> Column:
    share = part / F.nullif(whole, F.lit(0)) * 100
    return F.bround(F.coalesce(share, F.lit(0.0)), digits)


def summary(chunks: DataFrame, issues: DataFrame) -> DataFrame:
    counted = issues.agg(F.count(F.lit(1)).alias("total_issues")).withColumn(
        "total_chunks", chunks.agg(F.count(F.lit(1))).scalar()
    )
    return counted.select(
        "total_chunks", "total_issues",
        _percent(F.col("total_issues"), F.col("total_chunks"), 2)
        .alias("detection_rate_per_100"),
    )


def _or_unknown(name: str) -> Column:
    return F.coalesce(name, F.lit("unknown"))


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy(_or_unknown("severity").alias("severity")).agg(
        F.count(F.lit(1)).alias("n")
    )


def type_counts(issues: DataFrame) -> DataFrame:
    """Most frequent type first."""
    return issues.groupBy(_or_unknown("type").alias("type")).agg(
        F.count(F.lit(1)).alias("n")
    ).orderBy(F.desc("n"), "type")


def breakdown(issues: DataFrame) -> DataFrame:
    """Severity and type counts from one pass: (dimension, value, n)."""
    sets = issues.select(
        _or_unknown("severity").alias("severity"), _or_unknown("type").alias("type")
    ).groupingSets([["severity"], ["type"]], "severity", "type")
    by_type = F.grouping("severity") == 1
    return sets.agg(
        F.when(by_type, "type").otherwise("severity").alias("dimension"),
        F.coalesce(F.col("severity"), F.col("type")).alias("value"),
        F.count(F.lit(1)).alias("n"),
    ).select("dimension", "value", "n")


def patch_metrics(issues: DataFrame, patches: DataFrame) -> DataFrame:
    source = F.col("patch_source")
    counts = patches.agg(
        F.count_if(~source.eqNullSafe("none")).alias("patched_issues"),
        F.count_if(source.isNotNull() & ~source.isin("rule_based", "none"))
        .alias("model_count"),
        F.count_if(source == "rule_based").alias("rule_count"),
    ).withColumn("total", issues.agg(F.count(F.lit(1))).scalar())
    return counts.select(
        "patched_issues",
        _percent(F.col("patched_issues"), F.col("total"), 1).alias("coverage_pct"),
        "model_count", "rule_count",
    )


def patch_sources(patches: DataFrame) -> DataFrame:
    source = F.coalesce("patch_source", F.lit(""))
    with_examples = source.contains("+rag")
    return patches.agg(
        F.count_if(with_examples).alias("retrieval"),
        F.count_if(~source.isin("rule_based", "none") & ~with_examples).alias("model"),
        F.count_if(source == "rule_based").alias("rule_based"),
        F.count(F.lit(1)).alias("total"),
    )


def _top(issues: DataFrame, by: Column, name: str, n: int) -> DataFrame:
    counted = issues.groupBy(by.alias(name)).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seen")
    )
    return counted.orderBy(F.desc("n"), "first_seen").limit(n)


def top_files(issues: DataFrame, n: int = 5) -> DataFrame:
    """Files with most issues; of equals, the one seen first."""
    return _top(issues, _or_unknown("file"), "file", n).select("file", "n")


def top_base_names(issues: DataFrame, n: int = 8) -> DataFrame:
    name = T.base_name(_or_unknown("file"))
    return _top(issues, name, "file", n).select("file", "n")


def _in_bucket(confidence: Column) -> list[tuple[str, Column]]:
    out, above = [], F.lit(False)
    for label, floor in BUCKETS:
        here = ~above if floor is None else (confidence >= floor) & ~above
        out.append((label, here))
        above = above if floor is None else confidence >= floor
    return out


def confidence_buckets(issues: DataFrame) -> DataFrame:
    """All four buckets, empty ones included."""
    c = F.coalesce("confidence", F.lit(0.0))
    counts = issues.agg(*[
        F.count_if(cond).alias(f"b{i}") for i, (_, cond) in enumerate(_in_bucket(c))
    ])
    rows = F.array(*[
        F.struct(F.lit(label).alias("bucket"), F.col(f"b{i}").alias("n"))
        for i, (label, _) in enumerate(BUCKETS)
    ])
    return counts.select(F.inline(rows))


def kind_counts(issues: DataFrame) -> DataFrame:
    kind = F.col("type")
    return issues.agg(
        F.count_if(kind == "taint_flow").alias("taint_count"),
        F.count_if(kind == "statistical_anomaly").alias("anomaly_count"),
        F.count_if(kind == "dna_violation").alias("dna_count"),
    )


def recent_issues(issues: DataFrame, n: int = 20) -> DataFrame:
    """Highest confidence first, in order of detection among equals."""
    return issues.orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "seq").limit(n)


def first_patches(patches: DataFrame, n: int = 25) -> DataFrame:
    return patches.orderBy("seq").limit(n)


def dashboard(
    chunks: DataFrame, issues: DataFrame, patches: DataFrame,
    measured: DataFrame | None = None, high_confidence: float = 0.80,
) -> DataFrame:
    """Everything a results page shows, as one row; lists are bounded top-k results."""
    def rows(df: DataFrame, by: list[Column], *columns: str) -> Column:
        """A bounded result as one array, ordered by ``by``."""
        keyed = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(by)],
                         F.struct(*columns).alias("row"))
        listed = df.agg(F.array_sort(F.collect_list(keyed)).alias("x"))
        return listed.select(F.transform("x", lambda r: r["row"]).alias("x")).scalar()

    most = [-F.col("n")]
    c = F.coalesce("confidence", F.lit(0.0))
    n = F.count(F.lit(1))
    out = issues.agg(
        (n > 0).alias("has_results"), n.alias("total_issues"),
        F.count_if(c >= high_confidence).alias("high_confidence"),
        *[F.count_if(F.col("type") == k).alias(v) for k, v in (
            ("taint_flow", "taint_count"), ("statistical_anomaly", "anomaly_count"),
            ("dna_violation", "dna_count"))],
    )
    totals = patch_metrics(issues, patches)
    out = (
        out.withColumn("total_chunks", chunks.agg(F.count(F.lit(1))).scalar())
        .withColumn("total_patches", patches.agg(F.count(F.lit(1))).scalar())
        .withColumn("patch_metrics", totals.select(F.struct("*")).scalar())
        .withColumn("severity", rows(severity_counts(issues), most, "severity", "n"))
        .withColumn("issue_types", rows(type_counts(issues), most, "type", "n"))
        .withColumn("top_files", rows(
            _top(issues, T.base_name(_or_unknown("file")), "file", 8),
            [*most, F.col("first_seen")], "file", "n"))
        .withColumn("conf_buckets", rows(
            confidence_buckets(issues),
            [F.array_position(F.array(*[F.lit(b) for b, _ in BUCKETS]), F.col("bucket"))],
            "bucket", "n"))
        .withColumn("recent_issues", rows(
            recent_issues(issues), [-c, F.col("seq")], "type", "severity", "confidence", "function", "file",
            "line_number", "message"))
        .withColumn("patches", rows(
            first_patches(patches), [F.col("seq")], "function", "file", "issue_type", "patch_source",
            "suggested_fix"))
    )
    if measured is not None:
        out = out.withColumn("conventions", measured.select("patterns").scalar())
    return out
