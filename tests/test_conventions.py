from pyspark.sql import functions as F

from codequarry.operators import conventions as V


def corpus(spark, rows):
    data = [(f"c{i}", n, f"f{i}.py", i, code, repo) for i, (n, code, repo) in enumerate(rows)]
    return spark.createDataFrame(
        data, "chunk_id string, function_name string, file_path string, start_line int, "
              "code string, repo string")


def profile(df, by=()):
    return {r.pattern_name: r for r in V.profile(V.measure(df, by)).collect()}


def found(df, by=()):
    out = V.violations(df, V.measure(df, by), by)
    return sorted((r.chunk_id, r.subtype) for r in out.collect())


def test_small_corpora_have_no_profile(spark):
    df = corpus(spark, [("a_b", "print(1)", "r")] * 9)
    assert profile(df) == {} and found(df) == []
    assert V.profile_text(V.measure(df)).count() == 0


def test_ties_and_empty_base(spark):
    p = profile(corpus(spark, [("x", "1", "r")] * 10))
    assert (p["output_style"].dominant_value, p["output_style"].coverage) == ("logging", 0.0)
    assert (p["error_handling"].dominant_value, p["error_handling"].coverage,
            p["error_handling"].is_consistent, p["error_handling"].follower_count) == ("none", 1.0, True, 0)
    assert p["naming_convention"].dominant_value == "snake_case"


def test_logging_house(spark):
    df = corpus(spark, [("x", "logger.info(1)", "r")] * 9 + [
        ("x", "print(1)", "r"), ("x", "print(1); logging.x", "r"), ("x", "pass", "r")])
    assert found(df) == [("c9", "print_in_logging_codebase")]
    message = V.violations(df, V.measure(df)).first().message
    assert message.startswith("Codebase uses logging (83% of functions)")


def test_print_house(spark):
    df = corpus(spark, [("x", "print(1)", "r")] * 10 + [("x", "logging.x", "r")])
    assert found(df) == [("c10", "logging_in_print_codebase")]


def test_docstrings_and_hints(spark):
    good = 'def f(a: int):\n    """x"""'
    df = corpus(spark, [("x", good, "r")] * 10 + [("x", "def f(a): pass", "r")])
    assert found(df) == [("c10", "docstring_coverage_violation"), ("c10", "type_hints_violation")]


def test_threshold_uses_the_unrounded_share(spark):
    # 1999 of 3332 is 0.59994: rounds to 0.6 but is below the threshold of 0.6.
    df = spark.range(3332).select(
        F.col("id").cast("string").alias("chunk_id"), F.lit("x").alias("function_name"),
        F.lit("a").alias("file_path"), F.lit(1).alias("start_line"),
        F.when(F.col("id") < 1999, "-> x").otherwise("1").alias("code"))
    p = profile(df)["type_hints"]
    assert p.coverage == 0.6 and not p.is_consistent


def test_generic_raise_only_in_a_custom_house(spark):
    df = corpus(spark, [("x", "raise ValueError(1)", "r")] * 10 + [("x", "raise Exception (1)", "r")])
    assert found(df) == [("c10", "generic_exception_in_custom_codebase")]
    df = corpus(spark, [("x", "raise Exception(1)", "r")] * 10 + [("x", "raise ValueError(1)", "r")])
    assert found(df) == []


def test_naming(spark):
    df = corpus(spark, [("do_it", "1", "r")] * 20 + [
        ("doThing", "1", "r"), ("aB", "1", "r"), ("plain", "1", "r"), ("do_itNow", "1", "r")])
    assert found(df) == [("c20", "naming_violates_snake_case")]
    df = corpus(spark, [("doIt", "1", "r")] * 20 + [("do_thing", "1", "r")])
    assert found(df) == [("c20", "naming_violates_camelCase")]


def test_per_repo_profiles(spark):
    df = corpus(spark, [("do_it", "1", "a")] * 20 + [("doThing", "1", "a")]
                + [("doIt", "1", "b")] * 20 + [("do_thing", "1", "b")] + [("doIt", "1", "c")])
    assert found(df, ("repo",)) == [
        ("c20", "naming_violates_snake_case"), ("c41", "naming_violates_camelCase")]


def test_summary_text(spark):
    text = V.profile_text(V.measure(corpus(spark, [("do_it", "1", "r")] * 10))).first().summary
    assert text.splitlines()[0] == "Codebase DNA — 10 chunks analyzed"
    assert "  naming_convention: snake_case (100%, consistent)" in text.splitlines()
