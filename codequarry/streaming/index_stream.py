"""Keeping a vector index up to date from a stream of embedded chunks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.neighbours import index_rows

INDEX_SCHEMA = (
    "chunk_id string, embedding array<float>, code string, function string, file string, "
    "start string, repo string"
)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index, empty when nothing was written yet."""
    try:
        return spark.read.schema(INDEX_SCHEMA).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX_SCHEMA)


def add_to_index(chunks: DataFrame, path: str) -> None:
    """Append the chunks whose id the index does not hold yet, partitioned by repo.

    Running it again with the same chunks adds nothing, so a replayed batch is harmless.
    """
    spark = chunks.sparkSession
    rows = index_rows(chunks).persist()
    try:
        key = ["repo", "chunk_id"]
        index = read_index(spark, path).select(*key)
        known = index.join(rows.select(*key), key, "left_semi")
        fresh = rows.join(known, key, "left_anti")
        # Few files per repo, and a repo with many rows is split over several tasks.
        fresh.hint("rebalance", "repo").write.mode("append").partitionBy("repo").parquet(
            path
        )
    finally:
        rows.unpersist()


def stream_to_index(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that adds every micro-batch of a chunk stream to the index."""
    return (
        chunks.writeStream.foreachBatch(lambda batch, _: add_to_index(batch, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
