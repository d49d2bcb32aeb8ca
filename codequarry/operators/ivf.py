"""An inverted-file index over vectors: rows stored by the cell of their nearest centroid.

Centroids come from spherical k-means whose rounds are Spark jobs over a sample chosen by a hash of
the id (``TRAIN_PER_CELL`` rows a cell, about); every row is indexed. The rows are stored as Parquet
partitioned by cell, a large cell in several parts, next to a small table with the
centroid, the size and the least similarity of each cell. A search reads the cells it probes
and no other, multiplies packs of queries with packs of the same part, and scores are exact.

How many cells are probed is the caller's choice: a fixed number, the number that reached a wanted
recall on a sample of queries (:meth:`Index.probes_for`, by brute force), or ``exact=True``, which
goes on with every cell whose bound allows a better row than the k-th found.

Vectors without length have similarity 0 to all. Rows without a vector, or with another
number of dimensions than the first cell, are not vectors of the index and are left out on both
sides. Ties go to the smaller id. An empty index answers with no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as t

from ..functions.vectors import has_vector
from ..plans.checkpoints import cut
from .neighbours import PACK_ROWS, SCORE_DIGITS, _hit_schema, _pack, _products, _scan_index, _small_side, _top_per_query, _unit_rows

TRAIN_PER_CELL, ROUNDS = 256, 6
#: The centroids are sent to every task: no more of them than this many bytes hold.
MOST_CENTROID_BYTES = 64 << 20
#: Rows of a part, the unit that meets the queries of its cell.
PART_ROWS = 8 * PACK_ROWS
TUNE_QUERIES = 256
_LANES = 16


def _centres(values: pa.Array, centroids: np.ndarray):
    """(unit rows, products with the centroids) of a batch of lists."""
    flat = values.flatten().to_numpy(zero_copy_only=False)
    units = _unit_rows(flat.reshape(len(values), -1)) if len(values) else np.zeros((0, centroids.shape[1]))
    return units, units @ centroids.T


def _round(sample: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round of spherical k-means: a sum per cell from each task, added in a few lanes."""
    shape = centroids.shape
    held = sample.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            units, products = _centres(batch.column(0), held.value)
            np.add.at(total, products.argmax(axis=1), units)
        yield row(TaskContext.get().partitionId() % _LANES, total)

    def add(batches):
        total = np.zeros(shape)
        for batch in batches:
            for part in batch.column(1):
                total += np.frombuffer(part.as_buffer()).reshape(shape)
        yield row(0, total)

    def row(lane, total):
        return pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["lane", "part"])

    schema = "lane int, part binary"
    got = sample.select("embedding").mapInArrow(run, schema).repartition("lane").mapInArrow(add, schema).toArrow()
    held.unpersist()
    sums = sum((np.frombuffer(p.as_buffer()) for p in got.column("part")), start=np.zeros(shape[0] * shape[1])).reshape(shape)
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    # A cell that nobody is nearest to stays where it was.
    return np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)


def train(rows: DataFrame, cells: int | None = None, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Unit centroids of ``rows (id, embedding)``; by default about the root of the number of rows."""
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return np.zeros((0, 0))
    most = max(1, MOST_CENTROID_BYTES // (8 * width))
    cells = int(min(cells or round(n ** 0.5), n, most))
    h = F.xxhash64("id", F.lit(seed))
    share = min(1.0, 1.2 * TRAIN_PER_CELL * cells / n)
    sample = cut(rows.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding", h.alias("h")))
    first = sample.orderBy("h").limit(cells).select("embedding").toArrow().column(0).combine_chunks()
    flat = first.flatten().to_numpy(zero_copy_only=False)
    centroids = _unit_rows(flat.reshape(len(first), -1))
    for _ in range(rounds):
        centroids = _round(sample, centroids)
    return centroids


def build(rows: DataFrame, path: str, cells: int | None = None, rounds: int = ROUNDS) -> Index:
    """Write the index of ``rows (id, embedding)`` below ``path`` and open it."""
    spark = rows.sparkSession
    rows = rows.where(has_vector(F.col("embedding")))
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = rows.where(F.size("embedding") == width).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    centroids = train(rows, cells, rounds)
    held = spark.sparkContext.broadcast(centroids)

    def place(vectors: pa.Array) -> pa.Array:
        _, products = _centres(vectors, held.value)
        cell = products.argmax(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(cell, pa.int32()), pa.array(products[np.arange(len(cell)), cell], pa.float64())], ["cell", "near"])

    place.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    kind = t.StructType([t.StructField("cell", t.IntegerType()), t.StructField("near", t.DoubleType())])
    placed = cut(rows.withColumn("p", F.arrow_udf(place, kind).asNondeterministic()("embedding")).select("id", "embedding", "p.*"))
    sizes = cut(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("near").alias("least")).withColumn(
        "parts", F.ceil(F.col("rows") / PART_ROWS).cast("int")))
    # One row per centroid at most, and those are bounded by MOST_CENTROID_BYTES.
    salted = placed.join(F.broadcast(sizes.select("cell", "parts")), "cell").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    salted.select("id", "embedding", "part", "cell").repartition("cell", "part").write.mode("error").partitionBy("cell").parquet(f"{path}/rows")
    table = [(i, c.tolist()) for i, c in enumerate(centroids)]
    cells_table = spark.createDataFrame(table, "cell int, centroid array<double>").join(sizes, "cell", "left")
    cells_table.repartition(1).write.mode("error").parquet(f"{path}/cells")
    held.unpersist()
    return Index(spark, path, rows.schema["id"].dataType)


class Index:
    """A stored index. ``cells`` is a table of one row per centroid."""

    def __init__(self, spark: SparkSession, path: str, id_type: t.DataType = t.LongType()):
        self.spark, self.path = spark, path
        self.cells = spark.read.parquet(f"{path}/cells")
        got = self.cells.orderBy("cell").toArrow()
        lists = got.column("centroid").combine_chunks()
        self.centroids = np.array(lists.to_pylist(), float).reshape(len(lists), -1 if len(lists) else 0)
        self.used = np.array([r is not None for r in got.column("rows").to_pylist()], bool)
        self.least = np.array([1.0 if v is None else v for v in got.column("least").to_pylist()], float)
        self.schema = t.StructType([
            t.StructField("id", id_type), t.StructField("embedding", t.ArrayType(t.DoubleType())),
            t.StructField("part", t.IntegerType()), t.StructField("cell", t.IntegerType())])

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def _asked(self, queries: DataFrame) -> DataFrame:
        return queries.where(has_vector(F.col("embedding")) & (F.size("embedding") == self.centroids.shape[1])).select(
            "query_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def _probed(self, queries: DataFrame, probes: int, floor: bool) -> DataFrame:
        """(query_id, embedding, cell) of the ``probes`` nearest cells; with ``floor``, of the further
        cells whose bound is not below ``queries.kth`` (all of them where it is null)."""
        held = self.spark.sparkContext.broadcast((self.centroids, self.used, np.arccos(np.clip(self.least, -1, 1))))
        margin = 10.0 ** -SCORE_DIGITS

        def choose(vectors: pa.Array, kth: pa.Array) -> pa.Array:
            centroids, used, reach = held.value
            _, products = _centres(vectors, centroids)
            ranked = np.argsort(np.where(used, -products, np.inf), axis=1, kind="stable")
            at = min(probes, int(used.sum()))
            if not floor:
                return pa.array(list(ranked[:, :at].astype(np.int32)), pa.list_(pa.int32()))
            # By the triangle inequality of angles nothing in a cell is nearer than this.
            angle = np.maximum(np.arccos(np.clip(products, -1, 1)) - reach, 0)
            bar = kth.to_numpy(zero_copy_only=False).astype(float)
            open_ = used & ~(np.cos(angle) + 2 * margin < np.where(np.isnan(bar), -2, bar)[:, None])
            np.put_along_axis(open_, ranked[:, :at], False, axis=1)
            return pa.array([np.flatnonzero(row).astype(np.int32) for row in open_], pa.list_(pa.int32()))

        choose.__annotations__ = {"vectors": pa.Array, "kth": pa.Array, "return": pa.Array}
        chosen = F.arrow_udf(choose, t.ArrayType(t.IntegerType())).asNondeterministic()
        kth = F.col("kth") if floor else F.lit(None).cast("double")
        return queries.withColumn("cell", F.explode(chosen("embedding", kth))).select("query_id", "embedding", "cell")

    def _hits(self, probed: DataFrame, k: int) -> DataFrame:
        """The k best of each query in each part that it probes."""
        probed = cut(probed)
        wanted = [r["cell"] for r in probed.select("cell").distinct().collect()]  # centroids at most
        rows = self.rows().where(F.col("cell").isin(wanted) if len(wanted) < self.used.sum() else F.lit(True))
        parts = F.broadcast(self.cells.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
        schema = _hit_schema(probed, rows)
        left = _pack(probed.join(parts, "cell"), ["cell", "part"], "query_id", 1).drop("salt").select(
            "cell", "part", F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"))
        right = _pack(rows, ["cell", "part"], "id", 1)
        return _products(left, right, ["cell", "part"], k, schema)

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """(query_id, id, similarity, rank): the k nearest rows in the ``probes`` nearest cells, or of
        the whole index with ``exact``."""
        if not self.used.any():
            return self.spark.createDataFrame([], t.StructType([
                queries.schema["query_id"], t.StructField("id", self.schema["id"].dataType),
                t.StructField("similarity", t.DoubleType()), t.StructField("rank", t.IntegerType())]))
        asked = self._asked(queries)
        hits = self._hits(self._probed(asked, probes, False), k)
        if exact:
            hits = cut(_top_per_query(hits, k)).drop("rank")
            kth = hits.groupBy("query_id").agg(F.min("similarity").alias("kth"), F.count(F.lit(1)).alias("n")).select(
                "query_id", F.when(F.col("n") == k, F.col("kth")).alias("kth"))
            hits = hits.unionByName(self._hits(self._probed(asked.join(kth, "query_id", "left"), probes, True), k))
        return _top_per_query(hits, k)

    def probes_for(self, recall: float, k: int, queries: int = TUNE_QUERIES) -> int:
        """How many cells hold this share of the true neighbours of a sample of the indexed rows: those
        with the smallest hash, ``queries`` of them at most, are answered by brute force in one pass."""
        if not self.used.any():
            return 1
        rows = self.rows()
        sample = rows.orderBy(F.xxhash64("id", F.lit(29)), "id").limit(queries).select(F.col("id").alias("query_id"), "embedding")
        small = _small_side(sample, "query_id", queries)
        schema = _hit_schema(sample, rows)
        best = _top_per_query(_scan_index(rows, small, k, schema), k).select("query_id", "id")
        found = best.join(rows.select("id", "cell"), "id").toArrow()  # queries times k rows at most
        products = small[1] @ self.centroids.T
        order = np.argsort(np.where(self.used, -products, np.inf), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        at = {q: i for i, q in enumerate(small[0])}
        ranks = sorted(int(place[at[q], c]) for q, c in zip(found.column("query_id").to_pylist(), found.column("cell").to_pylist()))
        return ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] + 1 if ranks else 1


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row: queries, true neighbours, and how many of them were found."""
    hit = found.select("query_id", "id").withColumn("hit", F.lit(1))
    return true.join(hit, ["query_id", "id"], "left").agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"))
