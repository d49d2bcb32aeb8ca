"""Bounded samples of labelled documents.

A classifier is fitted on at most ``rows`` labelled documents: those with the smallest hash
of their id, so the sample is the same whatever the partitioning. Only the ids of the sample
are broadcast (``rows`` numbers at most); the texts stay where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int,
                    per_class: bool = False) -> DataFrame:
    """``__order`` long, ``__text`` string, ``__label`` int of at most ``rows`` documents.

    ``usable`` is a condition on the labels table. Several labels of one id count as 1 if
    any of them is 1, several texts of one id as the first of them; null labels and ids are
    left out. With ``per_class`` the bound holds for either label by itself, which keeps a rare
    one from vanishing; ``__weight`` double is then the number of labels that a row stands for.
    """
    known = (
        labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).cast("int").alias("__label"))
        .withColumn("__order", F.xxhash64("__id"))
    )

    def smallest(df: DataFrame) -> DataFrame:
        return df.orderBy("__order", "__id").limit(rows)

    if per_class:
        counts = known.groupBy("__label").agg(F.count(F.lit(1)).alias("__labels"))
        known = (
            smallest(known.where("__label = 1")).unionByName(smallest(known.where("__label = 0")))
            .join(F.broadcast(counts), "__label")
            .select("__id", "__order", "__label", F.greatest(F.lit(1.0), F.col("__labels") / F.lit(rows)).alias("__weight"))
        )
    else:
        known = smallest(known)
    texts = docs.select(F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("__text"))
    # One text for an id, however many rows have it, so that the bound holds for rows as well.
    kept = [c for c in known.columns if c not in ("__id", "__order")]
    return (
        texts.join(F.broadcast(known), "__id").groupBy("__id", "__order", *kept)
        .agg(F.min("__text").alias("__text")).select("__order", "__text", *kept)
    )
