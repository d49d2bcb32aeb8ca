"""Functions to chunks, and the filters around them. No shuffle anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT_CONFIG, AnalysisConfig
from ..functions import text as T


def _cut_points(rows: Column, max_lines: int) -> Column:
    """1-based positions of the blank lines that end a part.

    The fold runs over the blank lines only and keeps just the cuts, of which there is
    at most one per ``max_lines`` lines.
    """
    numbered = F.transform(rows, lambda x, i: F.struct((i + 1).alias("n"), x.alias("x")))
    blanks = F.transform(
        F.filter(numbered, lambda r: T.strip(r["x"]) == ""), lambda r: r["n"]
    )
    return F.aggregate(
        blanks,
        F.expr("cast(array() as array<int>)"),
        lambda cuts, n: F.when(
            n - F.coalesce(F.try_element_at(cuts, F.lit(-1)), F.lit(0)) >= max_lines,
            F.array_append(cuts, n),
        ).otherwise(cuts),
    )


def _parts(rows: Column, cuts: Column) -> Column:
    starts = F.concat(F.array(F.lit(1)), F.transform(cuts, lambda c: c + 1))
    ends = F.concat(cuts, F.array(F.size(rows)))
    spans = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    texts = F.transform(
        F.filter(spans, lambda s: s["b"] >= s["a"]),
        lambda s: T.strip(
            F.array_join(F.slice(rows, s["a"], s["b"] - s["a"] + 1), "\n")
        ),
    )
    return F.filter(texts, lambda t: t != "")


def chunk_functions(
    functions: DataFrame, config: AnalysisConfig = DEFAULT_CONFIG
) -> DataFrame:
    """Drop short functions, split long ones at blank lines, give stable ids.

    A later part starts where the *stripped* parts before it end, and ``end_line`` is
    one past the last line. ``facts`` of a function, if given, stay with a chunk that is the whole of it;
    they are NULL for parts.
    """
    facts = [c for c in ("facts",) if c in functions.columns]
    keep = [c for c in ("repo", "rel_path", "func_seq", "is_nested")
            if c in functions.columns]
    # Short functions get no parts and fall out after the explode: as a filter before it,
    # the test would be pushed down and split every text a second time.
    rows = functions.withColumn("code", T.strip(F.col("code"))).withColumn(
        "rows", T.lines(F.col("code"))
    )
    n_lines = F.size("rows")
    is_long = n_lines > config.max_chunk_lines
    # Used twice, so the cuts are a column; a function in one part has its lines counted already.
    rows = rows.withColumn("cuts", F.when(is_long, _cut_points(F.col("rows"), config.max_chunk_lines)))
    parts = F.when(is_long, _parts(F.col("rows"), F.col("cuts"))).when(
        n_lines >= config.min_chunk_lines, F.array("code"))
    texts = rows.withColumn("parts", parts).withColumn(
        "sizes", F.when(is_long, F.transform("parts", lambda p: F.size(T.lines(p)))).otherwise(F.array(n_lines)))
    texts = texts.withColumns({c: F.when(~is_long, F.col(c)) for c in facts})
    exploded = texts.select(
        *keep, "function_name", "file_path", F.col("start_line").alias("func_start"),
        "sizes", *facts, F.posexplode_outer("parts").alias("part", "p"),
    ).where(F.col("part").isNotNull())
    before = F.aggregate(
        F.slice("sizes", F.lit(1), F.col("part")), F.lit(0), lambda acc, n: acc + n
    )
    placed = exploded.withColumn("start_line", (F.col("func_start") + before).cast("int"))
    return placed.select(
        *keep, "part",
        T.chunk_id(F.col("file_path"), F.col("function_name"), F.col("start_line"))
        .alias("chunk_id"),
        "function_name", "file_path", "start_line",
        (F.col("start_line") + F.col("sizes")[F.col("part")]).cast("int").alias("end_line"),
        F.col("p").alias("code"), *facts,
    )


def is_production(
    file_path: Column, function_name: Column, config: AnalysisConfig = DEFAULT_CONFIG
) -> Column:
    """The excluded words count anywhere in the path (``latest/`` holds ``test``)."""
    return ~(
        T.contains_any(file_path, config.excluded_dirs)
        | T.starts_with_any(function_name, config.excluded_prefixes)
    )


def production_chunks(
    chunks: DataFrame, config: AnalysisConfig = DEFAULT_CONFIG
) -> DataFrame:
    return chunks.where(is_production(F.col("file_path"), F.col("function_name"), config))


def production_counts(
    chunks: DataFrame, config: AnalysisConfig = DEFAULT_CONFIG
) -> DataFrame:
    keep = is_production(F.col("file_path"), F.col("function_name"), config)
    return chunks.agg(
        F.count_if(keep).alias("kept"), F.count_if(~keep).alias("removed")
    )


def code_lines(df: DataFrame, text: str = "code") -> DataFrame:
    """Numbered lines that hold code: not blank and not a comment."""
    rows = df.select(
        *[c for c in df.columns if c != text],
        F.posexplode(T.lines(F.col(text))).alias("pos", "line_text"),
    )
    stripped = T.strip(F.col("line_text"))
    return rows.where((stripped != "") & ~stripped.startswith("#")).select(
        *[c for c in rows.columns if c not in ("pos", "line_text")],
        (F.col("pos") + 1).alias("line_no"), "line_text",
    )
