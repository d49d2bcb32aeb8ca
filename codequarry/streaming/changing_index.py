"""A vector index whose chunks can change: merge on read over generations.

Every batch is a generation. It appends the chunks whose code is new or changed, by a digest of
the code, and a tombstone for every chunk that is gone; what did not change is not written. A
reader takes the row of the latest generation of each chunk and leaves tombstones out. Files
lie below ``base=<n>/repo=<name>/generation=<g>``, so a batch reads and writes its own
repositories only, and of what is there the slim columns only.

Running a batch again under its number gives the same files: it is compared with the generations
before it, and its partitions are written anew. :func:`compact` merges all generations
into the next base, which readers see once it is complete; the base before stays until
:func:`drop_old_bases`.

Null ids of chunks are not indexed, nor are chunks without a vector. A null ``repo`` is a
repository of its own. Of equal ids in one batch the last one wins. Texts of null code are empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.neighbours import index_rows
from ..plans.checkpoints import cut
from ..plans.skew import join_null_safe

COLUMNS = "chunk_id string, embedding array<float>, code string, function string, file string, start string, code_sha string, gone boolean"
SCHEMA = f"{COLUMNS}, repo string, generation bigint"
KEY = ["repo", "chunk_id"]
#: Up to this many repositories a batch names them in its filter; more are found by a join.
MOST_NAMED = 1000


def _bases(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete bases, oldest first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(
        int(s.getPath().getName().split("=")[1]) for s in files.listStatus(place)
        if s.getPath().getName().startswith("base=") and (
            s.getPath().getName() == "base=0" or files.exists(done(s.getPath(), "_SUCCESS"))))


def _base(spark: SparkSession, path: str) -> str:
    return f"{path.rstrip('/')}/base={(_bases(spark, path) or [0])[-1]}"


def generations(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the current base, tombstones included; empty when nothing was written yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(_base(spark, path))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def _of_repos(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows of the given repositories, by partition."""
    named = [r["repo"] for r in repos.limit(MOST_NAMED + 1).collect()]
    if len(named) > MOST_NAMED:
        return join_null_safe(rows, repos, ["repo"])
    known = F.col("repo").isin([n for n in named if n is not None])
    return rows.where(known | F.col("repo").isNull() if None in named else known)


def _latest(rows: DataFrame) -> DataFrame:
    """(repo, chunk_id, generation) of the row that counts of each chunk: no wide column is moved."""
    return rows.groupBy(*KEY).agg(F.max("generation").alias("generation"))


def read(spark: SparkSession, path: str, repos: list[str] | None = None) -> DataFrame:
    """The index as it is now, in the columns of the search, of all or of some repositories."""
    rows = generations(spark, path)
    rows = rows if repos is None else rows.where(F.col("repo").isin(repos))
    live = join_null_safe(rows, _latest(rows), [*KEY, "generation"]).where("not gone")
    return live.drop("gone", "code_sha", "generation")


def apply(chunks: DataFrame, path: str, generation: int, whole: bool = False) -> DataFrame:
    """Write one batch of chunks as a generation. With ``whole`` the batch has all chunks of its
    repositories, and those that it does not have are gone. Returns (repo, change, rows) counts."""
    spark = chunks.sparkSession
    code = F.coalesce(F.col("code"), F.lit(""))
    rows = cut(index_rows(chunks).where("chunk_id is not null").withColumn("code", code).withColumn("code_sha", F.sha2(code, 256)))
    repos = rows.select("repo").distinct()
    before = _of_repos(generations(spark, path), repos).where(F.col("generation") < generation)
    slim = before.select(*KEY, "generation", "code_sha", "gone")
    now = cut(join_null_safe(slim, _latest(slim), [*KEY, "generation"]).where("not gone").select(*KEY, F.col("code_sha").alias("old_sha")))
    asked = rows.select(*KEY, "code_sha")
    same = asked["repo"].eqNullSafe(now["repo"]) & (asked["chunk_id"] == now["chunk_id"])
    compared = asked.join(now.withColumn("known", F.lit(True)), same, "full").select(
        F.coalesce(asked["repo"], now["repo"]).alias("repo"), F.coalesce(asked["chunk_id"], now["chunk_id"]).alias("chunk_id"),
        F.when(F.col("known").isNull(), "new").when(F.col("code_sha").isNull(), "gone")
        .when(F.col("code_sha") != F.col("old_sha"), "changed").otherwise("same").alias("change"))
    changes = cut(compared if whole else compared.where("change <> 'gone'"))
    written = join_null_safe(rows, changes.where("change in ('new', 'changed')").select(*KEY), KEY).withColumn("gone", F.lit(False))
    stones = changes.where("change = 'gone'").select(*KEY, F.lit(True).alias("gone"))
    out = written.unionByName(stones, allowMissingColumns=True).withColumn("generation", F.lit(generation).cast("long"))
    columns = [f.name for f in spark.createDataFrame([], SCHEMA).schema]
    # Few files per repository, and a large one is split over several tasks.
    (
        out.select(columns).hint("rebalance", "repo").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("repo", "generation").parquet(_base(spark, path))
    )
    return changes.groupBy("repo", "change").agg(F.count(F.lit(1)).alias("rows"))


def compact(spark: SparkSession, path: str) -> None:
    """Merge all generations into the next base, as the latest of them."""
    rows = generations(spark, path)
    last = rows.agg(F.max("generation")).first()[0]
    if last is None:
        return
    live = join_null_safe(rows, _latest(rows), [*KEY, "generation"]).where("not gone")
    bases = _bases(spark, path)
    place = f"{path.rstrip('/')}/base={(bases or [0])[-1] + 1}"
    live.withColumn("generation", F.lit(last)).select(rows.columns).hint("rebalance", "repo").write.mode("overwrite").partitionBy(
        "repo", "generation").parquet(place)


def drop_old_bases(spark: SparkSession, path: str) -> None:
    """Remove bases that a later complete one replaces; call it when no reader uses them any more."""
    for n in _bases(spark, path)[:-1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/base={n}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stream(chunks: DataFrame, path: str, checkpoint: str, whole: bool = False) -> StreamingQuery:
    """Start a query that applies every micro-batch of a chunk stream, under the number of the batch."""
    return (
        chunks.writeStream.foreachBatch(lambda batch, n: apply(batch, path, n + 1, whole) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
