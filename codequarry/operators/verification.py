"""Test-run texts to counts, and patches to verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions import text as T
from ..plans.skew import spread_lookup


def _count(text: Column, word: str) -> Column:
    digits = F.regexp_extract(text, rf"(\p{{Nd}}+) {word}", 1)
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("int"))


def parse_test_output(stdout: Column, stderr: Column) -> Column:
    text = F.concat(F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit("")))
    return F.struct(
        T.contains_any(text, fixed.RUNNABLE_WORDS).alias("runnable"),
        _count(text, "passed").alias("passed"), _count(text, "failed").alias("failed"),
        _count(text, "error").alias("errors"),
        F.left(text, F.lit(fixed.TEST_OUTPUT_CHARS)).alias("output"),
    )


def run_total(run: Column) -> Column:
    return run["passed"] + run["failed"] + run["errors"]


def run_is_clean(run: Column) -> Column:
    return run["runnable"] & (run["failed"] == 0) & (run["errors"] == 0)


def needs_verification(suggested_fix: Column) -> Column:
    """Fixes that are advice only are not tested."""
    return ~T.contains_any(F.coalesce(suggested_fix, F.lit("")), fixed.UNVERIFIABLE_PHRASES)


def relative_path(file: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(
        file.startswith(prefix), F.substring(file, len(prefix) + 1, 1_000_000_000)
    ).otherwise(file)


def apply_patch(content: Column, original: Column, fix: Column) -> Column:
    """File text with the first occurrence of the original replaced; NULL where the
    patch does not apply."""
    old = T.strip(F.coalesce(original, F.lit("")))
    new = T.strip(F.coalesce(fix, F.lit("")))
    at = F.position(old, content)
    patched = F.concat(
        F.substring(content, F.lit(1), at - 1), new,
        F.substring(content, at + F.length(old), F.length(content)),
    )
    return F.when((old != "") & (new != "") & (at > 0), patched)


def _verdict(base: Column, after: Column) -> Column:
    no_suite = base["runnable"].isNull() | ~base["runnable"]
    safe = (
        (after["passed"] >= base["passed"]) & (after["failed"] <= base["failed"])
        & (after["errors"] <= base["errors"])
    )
    judged = ~no_suite & after.isNotNull()
    none = F.lit(None)
    return F.struct(
        F.when(judged, safe).alias("verified"),
        F.when(no_suite, 0).otherwise(base["passed"]).alias("baseline_pass"),
        F.when(no_suite, 0).otherwise(base["failed"]).alias("baseline_fail"),
        F.when(judged, after["passed"]).otherwise(none.cast("int")).alias("after_pass"),
        F.when(judged, after["failed"]).otherwise(none.cast("int")).alias("after_fail"),
        F.when(~judged, 0.0).when(safe, fixed.BOOST_VERIFIED)
        .otherwise(fixed.BOOST_REJECTED).alias("confidence_boost"),
        F.when(no_suite, fixed.VERDICT_NO_SUITE)
        .when(after.isNull(), fixed.VERDICT_NOT_APPLIED)
        .when(safe, F.format_string(fixed.VERDICT_STABLE, after["passed"], after["failed"]))
        .otherwise(F.format_string(
            fixed.VERDICT_DEGRADED, base["passed"], base["failed"], after["passed"],
            after["failed"],
        )).alias("reason"),
    )


def verify(
    patches: DataFrame, baselines: DataFrame, runs: DataFrame, patch_id: str = "issue_id"
) -> DataFrame:
    """``patches`` (with ``repo``) plus ``verification``; advice-only fixes get NULL.

    ``baselines``: repo, stdout, stderr (one run per repo); ``runs``: the patch id,
    stdout, stderr (one run per patch that could be applied).
    """
    base = baselines.select(
        "repo", parse_test_output(F.col("stdout"), F.col("stderr")).alias("__base")
    )
    after = runs.select(
        patch_id, parse_test_output(F.col("stdout"), F.col("stderr")).alias("__after")
    )
    joined = spread_lookup(
        patches.join(after, patch_id, "left"), base, ["repo"], spread_by=[patch_id],
        how="left", salts=128,
    )
    tested = needs_verification(F.col("suggested_fix"))
    return joined.select(
        *patches.columns,
        F.when(tested, _verdict(F.col("__base"), F.col("__after"))).alias("verification"),
    )


def counters(verified: DataFrame) -> DataFrame:
    v = F.col("verification.verified")
    tested = F.col("verification").isNotNull()
    return verified.agg(
        F.count_if(v).alias("verified"), F.count_if(~v).alias("rejected"),
        F.count_if(tested & v.isNull()).alias("unverifiable"),
    )
