"""Prompts out, responses in, patches chosen. No model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions import text as T
from ..plans.skew import keep_last_wide, shared, spread_lookup
from .parse import parses


# --- issue and chunk ----------------------------------------------------------------


def with_chunks(issues: DataFrame, chunks: DataFrame) -> DataFrame:
    """Issues with the chunk they are about, as ``chunk`` columns.

    The last of several chunks with one id in a repo wins. An issue without a chunk is dropped,
    except a taint flow: it spans functions and is its own chunk.
    """
    has_vector = (
        F.coalesce(F.size("embedding") > 0, F.lit(False))
        if "embedding" in chunks.columns else F.lit(False)
    )
    keys = shared(["repo", "chunk_id"], issues, chunks)
    place = [c for c in ("rel_path", "func_seq", "part") if c in chunks.columns]
    place = place or ["file_path", "start_line"]
    # Only chunks with an issue are stored, and their text is not sorted to find the last. Of a vector
    # it is only asked whether there is one, before chunks are shuffled.
    told = chunks.select(
        *keys, F.col("function_name").alias("chunk_function"),
        F.col("file_path").alias("chunk_file"), F.col("code").alias("chunk_code"),
        has_vector.alias("chunk_has_vector"),
        *(F.col(c).alias(f"__{c}") for c in place),
    )
    lookup = keep_last_wide(
        told.join(issues.select(*keys).distinct(), keys, "left_semi"), keys, [f"__{c}" for c in place],
    ).drop(*(f"__{c}" for c in place)).withColumn("found", F.lit(True))
    joined = spread_lookup(issues, lookup, keys, spread_by=["issue_id"], how="left")
    taint = F.col("type") == "taint_flow"
    return joined.where(F.col("found").isNotNull() | taint).select(
        *issues.columns,
        F.coalesce("chunk_function", "function", F.lit(fixed.UNKNOWN)).alias("chunk_function"),
        F.coalesce("chunk_file", "file", F.lit(fixed.UNKNOWN)).alias("chunk_file"),
        F.coalesce(
            "chunk_code", "code_snippet", F.lit(fixed.NO_CHUNK_CODE)
        ).alias("chunk_code"),
        F.coalesce("chunk_has_vector", F.lit(False)).alias("chunk_has_vector"),
    )


def goes_to_model(issue_type: Column) -> Column:
    return ~issue_type.isin(*fixed.TEMPLATE_ONLY_TYPES)


# --- prompts ---------------------------------------------------------------------------


def standard_prompt() -> Column:
    return T.fill(
        fixed.STANDARD_PROMPT, type=F.col("type"), severity=_text("severity"),
        message=F.col("message"), function=F.col("chunk_function"),
        code=F.col("chunk_code"),
    )


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("None"))


def example_text(n: Column, function: Column, file: Column, similarity: Column,
                 code: Column) -> Column:
    return T.fill(
        fixed.RETRIEVAL_EXAMPLE, n=n, function=function, file=file,
        similarity=T.percent(similarity),
        code=F.left(code, F.lit(fixed.RETRIEVAL_EXAMPLE_CHARS)),
    )


def retrieval_prompt(examples: Column) -> Column:
    """``examples`` is the text of the similar functions, empty for none."""
    return T.fill(
        fixed.RETRIEVAL_PROMPT, type=F.col("type"), severity=_text("severity"),
        message=F.col("message"), file=T.base_name(F.col("chunk_file")),
        function=F.col("chunk_function"), code=F.col("chunk_code"), examples=examples,
    )


def example_sections(similar: DataFrame) -> DataFrame:
    """(repo if given, chunk_id, examples): the few similar functions of each chunk as one section."""
    one = F.struct(
        "n",
        example_text(F.col("n"), F.col("function"), F.col("file"), F.col("similarity"),
                     F.col("code")).alias("text"),
    )
    parts = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["text"])
    section = F.concat(
        F.lit(fixed.RETRIEVAL_EXAMPLES_HEAD), F.array_join(parts, "\n\n"), F.lit("\n")
    )
    keys = shared(["repo", "chunk_id"], similar)
    return similar.groupBy(*keys).agg(section.alias("examples"))


def prompts(work: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """(issue_id, chunk_id, kind, prompt) for every issue that goes to a model.

    ``work`` comes from :func:`with_chunks`, ``similar`` from ``similar_functions``; the
    retrieval form is used where similar functions were found.
    """
    asked = work.where(goes_to_model(F.col("type")))
    if similar is None:
        return asked.select(
            "issue_id", "chunk_id", F.lit("standard").alias("kind"),
            standard_prompt().alias("prompt"),
        )
    keys = shared(["repo", "chunk_id"], asked, similar)
    joined = spread_lookup(
        asked, example_sections(similar.select(*keys, "n", "function", "file", "similarity", "code")),
        keys, spread_by=["issue_id"], how="left",
    )
    hit = F.col("examples").isNotNull()
    return joined.select(
        "issue_id", "chunk_id",
        F.when(hit, "retrieval").otherwise("standard").alias("kind"),
        F.when(hit, retrieval_prompt(F.col("examples"))).otherwise(standard_prompt())
        .alias("prompt"),
    )


# --- responses ---------------------------------------------------------------------------


def clean_response(text: Column) -> Column:
    """Without fence lines; a text of fences only stays as it is."""
    stripped = T.strip(text)
    kept = F.filter(T.lines(stripped), lambda x: ~T.strip(x).startswith("```"))
    inner = T.strip(F.array_join(kept, "\n"))
    return F.when(inner == "", stripped).otherwise(inner)


def looks_like_code(text: Column) -> Column:
    """Long enough, and the first line is not prose."""
    body = T.strip(text)
    first = T.strip(F.lower(F.try_element_at(T.lines(body), F.lit(1))))
    return F.coalesce(
        (F.length(body) >= 10) & ~T.starts_with_any(first, fixed.PROSE_OPENERS),
        F.lit(False),
    )


def check_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """``responses`` plus ``cleaned`` and ``is_valid``. Only texts that pass the cheap
    tests are given to the parser."""
    out = responses.withColumn("cleaned", clean_response(F.col(text)))
    candidate = F.when(looks_like_code(F.col("cleaned")), F.col("cleaned"))
    return out.withColumn("is_valid", F.coalesce(parses(candidate), F.lit(False)))


# --- templates ------------------------------------------------------------------------------


def template_text() -> Column:
    """Suggested fix by issue type, NULL for an unknown type."""
    kind, out = F.col("type"), None
    for issue_type, template in fixed.PATCH_TEMPLATES.items():
        text = F.lit(template)
        if issue_type == "semantic_similarity_flag":
            text = T.fill(
                template, label=F.coalesce("pattern_label", F.lit(fixed.UNKNOWN)),
                score=F.coalesce(F.col("similarity_score").cast("string"), F.lit(fixed.NOT_AVAILABLE)),
            )
        elif issue_type == "taint_flow":
            text = T.fill(
                template, path=F.coalesce("taint_path", F.lit(fixed.NO_TAINT_PATH)),
                sink=F.coalesce("sink_function", F.lit(fixed.UNKNOWN)),
            )
        elif issue_type == "statistical_anomaly":
            score = F.coalesce(F.col("anomaly_score").cast("string"), F.lit(fixed.NOT_AVAILABLE))
            text = T.fill(template, score=score)
        out = F.when(kind == issue_type, text) if out is None else out.when(
            kind == issue_type, text
        )
    return out.when(kind == "dna_violation", _convention_text())


def _convention_text() -> Column:
    subtype = F.coalesce("subtype", F.lit(""))
    message = F.coalesce("message", F.lit(""))
    text = T.fill(fixed.CONVENTION_GENERAL_TEXT, subtype=subtype, message=message)
    for known, advice in fixed.CONVENTION_ADVICE.items():
        text = F.when(
            subtype == known,
            T.fill(fixed.CONVENTION_ADVICE_TEXT, message=message, advice=F.lit(advice)),
        ).otherwise(text)
    return text


# --- patches ----------------------------------------------------------------------------------


def choose(
    work: DataFrame,
    responses: DataFrame | None = None,
    provider: str = "llamacpp",
) -> DataFrame:
    """One patch per issue: a valid response, else a template, else none.

    ``responses``: issue_id, response, kind (the kind of prompt it answers).
    """
    template = template_text()
    fallback = F.coalesce(
        template, F.format_string(fixed.NO_PATCH_TEXT, F.col("type"))
    )
    source = F.when(template.isNotNull(), "rule_based").otherwise("none")
    if responses is not None:
        checked = check_responses(responses.select("issue_id", "response", "kind"))
        # Of several valid responses to an issue the first by text is taken.
        valid = checked.where("is_valid").groupBy("issue_id").agg(
            F.min(F.struct("cleaned", "kind")).alias("first")
        ).select("issue_id", "first.*")
        work = work.join(valid, "issue_id", "left")
        taken = goes_to_model(F.col("type")) & F.col("cleaned").isNotNull()
        with_examples = F.col("kind") == "retrieval"
        source = F.when(
            taken, F.when(with_examples, f"{provider}+rag").otherwise(provider)
        ).otherwise(source)
        fallback = F.when(taken, F.col("cleaned")).otherwise(fallback)
    keep = [c for c in ("repo", "seq") if c in work.columns]
    return work.select(
        "issue_id", *keep, F.col("chunk_function").alias("function"),
        F.col("chunk_file").alias("file"), "chunk_id", F.col("type").alias("issue_type"),
        "severity", source.alias("patch_source"),
        F.col("chunk_code").alias("original_code"), fallback.alias("suggested_fix"),
    )
