"""From raw documents to packed sequences: five stages, each one operator of ``codequarry.llm``.

A stage takes ``(spark, docs, sf_dir)`` and works on everything that the one before kept. Its
result is written as Parquet and read back before the next one starts, so a lost executor costs
one stage at most. All but the last return the columns of ``documents``.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table
and further columns, which are carried through up to the last stage. Repeated rows of one id
and text count as copies: the second stage keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codequarry.llm import decontaminate, near, packing, quality, suffix
from codequarry.llm.text import held_out, small_batches, table
from codequarry.plans.checkpoints import cut

NEAR_WORDS, NEAR_PERCENT = 5, 80
REPEAT_BYTES = 50

#: Stages on edit distances and models are not SQL; tests compare them with plain versions.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels outside
    the held-out fold. Empty texts are scored like all others."""
    small_batches(spark)
    usable = ~held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), usable=usable)
    scored = quality.with_score(docs, model, "__quality")
    return scored.where(F.col("__quality") >= quality.THRESHOLD).select(*_columns(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates, with all
    texts that it has; of rows equal in id and text one stays. Rows without id are in no
    group and stay."""
    small_batches(spark)
    found = near.near_duplicates(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*_columns(docs)).unionByName(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of earlier documents; those of which nothing is left go.
    ``n_chars`` follows the text."""
    small_batches(spark)
    done = suffix.remove_repeats(docs, window=REPEAT_BYTES, as_text=True)
    changed = F.col("sa_removed") > 0
    text = F.when(changed, F.col("sa_kept")).otherwise(F.col("text"))
    out = done.withColumn("text", text).where(~changed | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return out.select(*_columns(docs))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), column="__leaks")
    return found.where(F.size("__leaks") == 0).select(*_columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences."""
    small_batches(spark)
    return packing.pack(docs, packing.tokenizer_source())


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("quality", good_quality), ("near_duplicates", one_of_each_group), ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmarks), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
