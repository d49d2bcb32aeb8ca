"""Conventions of a corpus, learned in one aggregate, and the chunks that break them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions import text as T
from ..plans.skew import spread_lookup


def marks() -> dict[str, Column]:
    """Style marks of one chunk; every convention is a count over these."""
    code, name = F.col("code"), F.col("function_name")

    def shape(pattern: str) -> str:
        return pattern.format(space=T.WS, word=T.WORD, names="|".join(fixed.TYPE_HINT_NAMES))

    def any_of(words: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, (code.contains(w) for w in words))

    return {
        "logs": any_of(fixed.LOGGING_WORDS),
        "prints": code.contains(fixed.PRINT_WORD),
        "documented": any_of(fixed.DOCSTRING_MARKS),
        "hinted": code.rlike(shape(fixed.TYPE_HINT_PATTERN)),
        "raises": code.contains(fixed.RAISE_WORD),
        "raises_custom": code.rlike(shape(fixed.CUSTOM_ERROR_PATTERN)),
        "raises_generic": code.rlike(shape(fixed.GENERIC_ERROR_PATTERN)),
        "snake": name.rlike(fixed.SNAKE_PATTERN),
        "camel": name.rlike(fixed.CAMEL_PATTERN),
    }


@dataclass(frozen=True)
class Convention:
    """``sides`` are (label, mark) in the order that wins ties; ``among`` is the mark
    that selects the chunks the share is taken of (all chunks if None)."""

    name: str
    sides: tuple[tuple[str, str], ...]
    among: str | None = None


CONVENTIONS: tuple[Convention, ...] = (
    Convention("output_style", (("logging", "logs"), ("print", "prints"))),
    Convention("docstring_coverage", (("docstrings", "documented"),)),
    Convention("type_hints", (("type_hints", "hinted"),)),
    Convention(
        "error_handling",
        (("custom_exceptions", "raises_custom"), ("generic_exceptions", "raises_generic")),
        among="raises",
    ),
    Convention("naming_convention", (("snake_case", "snake"), ("camelCase", "camel"))),
)


def _measure_one(seq: int, convention: Convention) -> Column:
    """The result row of one convention from the counts ``n`` and ``n_<mark>``."""
    threshold = F.lit(fixed.CONVENTION_THRESHOLDS[convention.name])
    (label, mark), *other = convention.sides
    dominant, followers = F.lit(label), F.col(f"n_{mark}")
    for label2, mark2 in other:
        ahead = followers >= F.col(f"n_{mark2}")
        dominant = F.when(ahead, dominant).otherwise(F.lit(label2))
        followers = F.when(ahead, followers).otherwise(F.col(f"n_{mark2}"))
    base = F.col(f"n_{convention.among}" if convention.among else "n")
    empty = base == 0
    share = F.when(empty, F.lit(1.0)).otherwise(followers / F.nullif(base, F.lit(0)))
    return F.struct(
        F.lit(seq).alias("pattern_seq"),
        F.lit(convention.name).alias("pattern_name"),
        F.when(empty, F.lit("none")).otherwise(dominant).alias("dominant_value"),
        F.bround(share, 3).alias("coverage"),
        (share >= threshold).alias("is_consistent"),
        F.when(empty, F.lit(0)).otherwise(followers).cast("long").alias("follower_count"),
        F.when(empty, F.lit(0)).otherwise(base - followers).cast("long")
        .alias("violator_count"),
        threshold.alias("threshold"),
    )


def measure(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per corpus (per value of ``by``) with all results as an array.

    Corpora below the minimum size have no row.
    """
    counts = [F.count(F.lit(1)).alias("n")] + [
        F.count_if(mark).alias(f"n_{name}") for name, mark in marks().items()
    ]
    results = F.array(*[_measure_one(i, c) for i, c in enumerate(CONVENTIONS)])
    return (
        chunks.groupBy(*by).agg(*counts)
        .where(F.col("n") >= fixed.CONVENTION_MIN_CHUNKS)
        .select(*by, F.col("n").alias("total_chunks"), results.alias("patterns"))
    )


def profile(measured: DataFrame) -> DataFrame:
    """The results as one row per pattern."""
    by = [c for c in measured.columns if c not in ("total_chunks", "patterns")]
    return measured.select(*by, "total_chunks", F.inline("patterns"))


def profile_text(measured: DataFrame) -> DataFrame:
    by = [c for c in measured.columns if c not in ("total_chunks", "patterns")]
    line = lambda p: F.format_string(
        "  %s: %s (%s, %s)", p["pattern_name"], p["dominant_value"],
        T.percent(p["coverage"]),
        F.when(p["is_consistent"], "consistent").otherwise("mixed"),
    )
    head = F.format_string("Codebase DNA — %d chunks analyzed", "total_chunks")
    return measured.select(
        *by,
        F.array_join(F.concat(F.array(head), F.transform("patterns", line)), "\n")
        .alias("summary"),
    )


def _breaches(p: list[Column]) -> list[tuple[Column, str, Column, Column]]:
    """(condition, pattern, subtype, message) for one chunk against the results."""
    style, docs, hints, errors, naming = p
    text = fixed.CONVENTION_MESSAGES

    def share(x):
        return T.percent(x["coverage"])

    def say(key, *args):
        return F.format_string(text[key], *args)

    logging_house = style["dominant_value"] == "logging"
    snake_house = naming["dominant_value"] == "snake_case"
    follows = F.when(snake_house, F.col("snake")).otherwise(F.col("camel"))
    return [
        (style["is_consistent"] & logging_house & F.col("prints") & ~F.col("logs"),
         "output_style", F.lit("print_in_logging_codebase"),
         say("print_in_logging_codebase", share(style))),
        (style["is_consistent"] & ~logging_house & F.col("logs") & ~F.col("prints"),
         "output_style", F.lit("logging_in_print_codebase"),
         say("logging_in_print_codebase", share(style))),
        (docs["is_consistent"] & ~F.col("documented"),
         "docstring_coverage", F.lit("docstring_coverage_violation"),
         say("docstring_coverage_violation", share(docs))),
        (hints["is_consistent"] & ~F.col("hinted"),
         "type_hints", F.lit("type_hints_violation"),
         say("type_hints_violation", share(hints))),
        (errors["is_consistent"] & (errors["dominant_value"] == "custom_exceptions")
         & F.col("raises_generic"),
         "error_handling", F.lit("generic_exception_in_custom_codebase"),
         say("generic_exception_in_custom_codebase", share(errors))),
        (naming["is_consistent"] & ~follows & (F.length("function_name") > 4)
         & (F.col("camel") != F.col("snake")),
         "naming_convention",
         F.concat(F.lit("naming_violates_"), naming["dominant_value"]),
         say("naming_violates", naming["dominant_value"], share(naming),
             F.col("function_name"))),
    ]


def violations(
    chunks: DataFrame, measured: DataFrame, by: tuple[str, ...] = ()
) -> DataFrame:
    """Issue rows of chunks that break a consistent convention of their corpus.

    The text is reduced to its marks before anything moves, and only chunks that can
    breach something take part in the lookup of the results.
    """
    order = [c for c in ("repo", "rel_path", "func_seq", "part") if c in chunks.columns]
    names = list(marks())
    marked = chunks.select(
        *dict.fromkeys([*order, *by]), "chunk_id", "function_name", "file_path",
        "start_line", *[m.alias(k) for k, m in marks().items()],
    )
    candidates = marked.where(
        (F.col("prints") != F.col("logs")) | ~F.col("documented") | ~F.col("hinted")
        | F.col("raises_generic") | (F.col("camel") != F.col("snake"))
    )
    if by:
        joined = spread_lookup(
            candidates, measured.select(*by, "patterns"), list(by),
            spread_by=["chunk_id"], salts=128,
        )
    else:
        # One row at most: read once as a scalar, not joined.
        joined = candidates.withColumn("patterns", measured.select("patterns").scalar())
    p = [F.col("patterns")[i] for i in range(len(CONVENTIONS))]
    found = F.array(*[
        F.when(
            cond,
            F.struct(
                F.lit(i).alias("rule_seq"), F.lit(pattern).alias("pattern"),
                subtype.alias("subtype"), message.alias("message"),
            ),
        )
        for i, (cond, pattern, subtype, message) in enumerate(_breaches(p))
    ])
    hits = joined.select(
        *order, "chunk_id", F.col("function_name").alias("function"),
        F.col("file_path").alias("file"), F.col("start_line").alias("line_number"),
        F.explode(F.array_compact(found)).alias("v"),
    )
    return hits.select(
        *order, "v.rule_seq",
        F.lit("dna_violation").alias("type"), F.lit("low").alias("severity"),
        F.lit(fixed.CONFIDENCE["dna_violation"]).alias("confidence"),
        "function", "file", "line_number", F.col("line_number").alias("file_line"),
        F.lit("").alias("code_snippet"), "chunk_id", "v.message", "v.subtype",
        "v.pattern",
    )
