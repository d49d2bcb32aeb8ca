"""Isolation forest over vectors: bounded fit, one-pass scores, exact cut.

Trees are grown from bounded samples (Liu, Ting, Zhou 2008), one task per tree. Rows are
chosen by a hash of their id, so neither partitioning nor order changes a result, and in the same
way at every size. Every repository has its own forest and its own cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as t
from pyspark.sql.window import Window

from .. import fixed_values as fixed
from ..config import DEFAULT_CONFIG, AnalysisConfig
from ..functions import text as T
from ..functions.vectors import has_vector
from ..plans.checkpoints import cut
from ..plans.quantile import quantile_by

MIN_ROWS = 10
_TREE = t.StructType([
    t.StructField("tree", t.IntegerType()),
    t.StructField("feature", t.ArrayType(t.IntegerType())),
    t.StructField("threshold", t.ArrayType(t.DoubleType())),
    t.StructField("length", t.ArrayType(t.DoubleType())),
])


def average_path(n):
    """Mean depth of an unsuccessful search among n rows: the c(n) of the paper."""
    n = np.asarray(n, dtype=np.float64)
    many = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (
        n - 1.0
    ) / np.maximum(n, 1.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, many))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays over a complete binary numbering (children of i: 2i+1, 2i+2);
    ``feature`` is -1 at a leaf, where ``length`` is the path length."""

    feature: np.ndarray
    threshold: np.ndarray
    length: np.ndarray
    sample: int


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    size = 2 ** (max_depth + 1) - 1
    feature = np.full(size, -1, np.int32)
    threshold = np.zeros(size)
    length = np.zeros(size)
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) <= 1 or len(varied) == 0:
            length[node] = depth + float(average_path(len(rows)))
            continue
        f = int(rng.choice(varied))
        cutoff = rng.uniform(low[f], high[f])
        cutoff = low[f] if cutoff >= high[f] else cutoff
        feature[node], threshold[node] = f, cutoff
        left = part[:, f] <= cutoff
        todo.append((2 * node + 2, rows[~left], depth + 1))
        todo.append((2 * node + 1, rows[left], depth + 1))
    return feature, threshold, length


#: Bytes of forests that may be sent to every task; more of them travel with the rows they score.
MOST_FOREST_BYTES = 64 << 20
#: Rows of one group that are scored together where forests travel.
SCORE_ROWS = 50_000
_GROUP = "__group"


def _grouped(chunks: DataFrame, by: str | None) -> DataFrame:
    """Rows with a vector, and the group whose forest they belong to; null is a group of its own."""
    key = F.lit("") if by is None else F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    return chunks.where(has_vector(F.col("embedding"))).withColumn(_GROUP, key)


def _smallest_draws(rows: DataFrame, trees: int, sample: int) -> DataFrame:
    """(group, tree, draw, id): of each task, the ``sample`` smallest draws of every tree and group.

    A row draws one number per tree, from a hash of its id. What a task keeps of a group is bounded,
    and such sets can be merged, so every row takes part at any size."""
    id_type = rows.schema["id"].dataType
    steps = (np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        ids_type = to_arrow_type(id_type)
        group, draws, ids = None, None, None

        def flush():
            kept = draws.shape[0]
            tree = np.tile(np.arange(trees, dtype=np.int32), kept)
            return pa.RecordBatch.from_arrays(
                [pa.array([group] * len(tree)), pa.array(tree), pa.array(draws.ravel()), pa.array(ids.ravel().tolist(), ids_type)],
                names=["g", "tree", "draw", "id"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            h = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            own = np.empty(batch.num_rows, object)
            own[:] = batch.column(2).to_pylist()
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                z = h[a:b, None] + steps
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                new = ((z ^ (z >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)
                new_ids = np.broadcast_to(own[a:b, None], new.shape)
                if group != names[a]:
                    if group is not None:
                        yield flush()
                    group, draws, ids = names[a], new, new_ids
                else:
                    draws, ids = np.concatenate([draws, new]), np.concatenate([ids, new_ids])
                if len(draws) > sample:
                    keep = np.argpartition(draws, sample - 1, axis=0)[:sample]
                    draws, ids = np.take_along_axis(draws, keep, 0), np.take_along_axis(ids, keep, 0)
        if group is not None:
            yield flush()

    schema = t.StructType([
        t.StructField("g", t.StringType()), t.StructField("tree", t.IntegerType()), t.StructField("draw", t.LongType()),
        t.StructField("id", id_type)])
    return rows.select("g", "h", "id").sortWithinPartitions("g").mapInArrow(run, schema)


def grow_forests(chunks: DataFrame, config: AnalysisConfig, by: str | None, id_column: str = "chunk_id") -> DataFrame:
    """``g, tree, feature, threshold, length, sample``: one row per tree of every group of at least
    ``MIN_ROWS`` rows. A tree grows from the rows of its group with the smallest draws: chosen by
    slim rows in one shuffle, their vectors fetched afterwards. Rows of one id are drawn together."""
    seed, trees, sample = config.forest_seed, config.forest_trees, config.forest_sample
    rows = cut(_grouped(chunks, by).select(
        F.col(_GROUP).alias("g"), F.col(id_column).alias("id"), F.xxhash64(id_column, F.lit(seed)).alias("h"), "embedding"))
    large = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_ROWS)
    w = Window.partitionBy("g", "tree").orderBy("draw", "id")
    drawn = _smallest_draws(rows.join(large.select("g"), "g", "left_semi"), trees, sample).distinct()
    picked = drawn.withColumn("at", F.row_number().over(w)).where(F.col("at") <= sample).select("g", "tree", "id")

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        x = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
        depth = math.ceil(math.log2(max(len(x), 2)))
        feature, threshold, length = _grow(x, np.random.default_rng([seed, int(key[1])]), depth)
        return pd.DataFrame({
            "g": [key[0]], "tree": [int(key[1])], "feature": [feature], "threshold": [threshold],
            "length": [length], "sample": [len(x)],
        })

    schema = t.StructType([t.StructField("g", t.StringType()), *_TREE, t.StructField("sample", t.IntegerType())])
    return cut(picked.join(rows.select("g", "id", "embedding"), ["g", "id"]).groupBy("g", "tree").applyInPandas(build, schema))


def _forest(rows) -> Forest:
    """A forest of its tree rows."""
    rows = sorted(rows, key=lambda r: r["tree"])
    size = max(len(r["feature"]) for r in rows)

    def wide(name, fill, kind):
        return np.array([list(r[name]) + [fill] * (size - len(r[name])) for r in rows], kind)

    return Forest(wide("feature", -1, np.int32), wide("threshold", 0.0, float), wide("length", 0.0, float), max(r["sample"] for r in rows))


def fit(
    chunks: DataFrame, config: AnalysisConfig = DEFAULT_CONFIG, id_column: str = "chunk_id"
) -> Forest | None:
    """One forest over all chunks with a vector, or None when there are fewer than 10."""
    got = grow_forests(chunks, config, None, id_column).collect()  # one row per tree
    return _forest(got) if got else None


def score_matrix(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Scores in [-1, 0): the lower, the easier to isolate."""
    depth = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, threshold, length in zip(forest.feature, forest.threshold, forest.length):
        node = np.zeros(len(x), np.int64)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(f, 0)] > threshold[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        depth += length[node]
    mean = depth / len(forest.feature)
    return -np.exp2(-mean / max(float(average_path(forest.sample)), 1e-12))


def score(chunks: DataFrame, forest: Forest) -> DataFrame:
    """``chunks`` that have a vector, plus ``score``."""
    held = chunks.sparkSession.sparkContext.broadcast(forest)

    def run(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.float64())
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(len(vectors), -1).astype(np.float64)
        return pa.array(np.round(score_matrix(held.value, x), 9), pa.float64())

    run.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    scored = F.arrow_udf(run, t.DoubleType()).asNondeterministic()
    return chunks.where(has_vector(F.col("embedding"))).withColumn(
        "score", scored("embedding")
    )


def score_by_group(chunks: DataFrame, forests: DataFrame, by: str | None) -> DataFrame:
    """``chunks`` whose group has a forest, plus ``score``. Few forests are sent to every task. Many
    travel: the rows of a group are dealt into parts of bounded size, and each part meets the
    trees of its group at its head."""
    rows = _grouped(chunks, by)
    n, nodes = forests.agg(F.count(F.lit(1)), F.max(F.size("feature"))).first()
    if not n or n * nodes * 20 <= MOST_FOREST_BYTES:
        trees: dict = {}
        for r in forests.collect():
            trees.setdefault(r["g"], []).append(r)
        held = chunks.sparkSession.sparkContext.broadcast({g: _forest(some) for g, some in trees.items()})

        def run(groups: pa.Array, vectors: pa.Array) -> pa.Array:
            names = np.array(groups.to_pylist(), object)
            out = np.zeros(len(names))
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(len(names), -1).astype(np.float64) if len(names) else flat
            for g in set(names.tolist()):
                mine = names == g
                out[mine] = score_matrix(held.value[g], x[mine])
            return pa.array(np.round(out, 9), pa.float64())

        run.__annotations__ = {"groups": pa.Array, "vectors": pa.Array, "return": pa.Array}
        scored = F.arrow_udf(run, t.DoubleType()).asNondeterministic()
        known = rows.where(F.col(_GROUP).isin(list(trees)))
        return known.withColumn("score", scored(_GROUP, "embedding")).drop(_GROUP)

    sizes = cut(rows.groupBy(_GROUP).agg(F.ceil(F.count(F.lit(1)) / SCORE_ROWS).cast("int").alias("__parts")))
    kind = t.StructType([f for f in forests.schema if f.name != "g"])
    part = F.pmod(F.xxhash64("embedding"), F.col("__parts")).cast("int").alias("__part")
    scored = rows.join(sizes, _GROUP).select("*", part, F.lit(1).alias("__phase"), F.lit(None).cast(kind).alias("__tree"))
    heads = forests.select(F.col("g").alias(_GROUP), F.struct(*kind.names).alias("__tree")).join(sizes, _GROUP).select(
        _GROUP, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), F.lit(0).alias("__phase"), "__tree")
    both = scored.drop("__parts").unionByName(heads, allowMissingColumns=True)
    schema = t.StructType([*chunks.schema, t.StructField("score", t.DoubleType())])
    names = chunks.columns

    def stream(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        at, trees, forest = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (_GROUP, "__part", "__phase"))))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if keys[a][:2] != at:
                    at, trees, forest = keys[a][:2], [], None
                run = batch.slice(a, b - a)
                if keys[a][2] == 0:
                    trees += run.column(run.schema.get_field_index("__tree")).to_pylist()
                elif trees:  # a group without trees has too few rows
                    forest = forest or _forest(trees)
                    vectors = run.column(run.schema.get_field_index("embedding"))
                    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1).astype(np.float64)
                    columns = [run.column(run.schema.get_field_index(c)) for c in names]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(np.round(score_matrix(forest, x), 9), pa.float64())], schema=wanted)

    return both.repartition(_GROUP, "__part").sortWithinPartitions(_GROUP, "__part", "__phase").mapInArrow(stream, schema)


def confidence(score_column: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -2.0 * score_column)), 3)


def flag(
    chunks: DataFrame, config: AnalysisConfig = DEFAULT_CONFIG, per_repo: bool = True
) -> DataFrame | None:
    """Issues for the most isolated share of the chunks, of every repository by itself unless
    ``per_repo`` is off or there is no ``repo``; None when all have too few."""
    by = "repo" if per_repo and "repo" in chunks.columns else None
    forests = grow_forests(chunks, config, by)
    if forests.isEmpty():
        return None
    order = [c for c in ("repo", "rel_path", "func_seq", "part") if c in chunks.columns]
    key = _GROUP
    scored = cut(
        _grouped(score_by_group(chunks, forests, by), by).select(
            *order, "chunk_id", "function_name", "file_path", "start_line",
            T.snippet(F.col("code")).alias("code_snippet"), "score", key,
        )
    )
    limits = quantile_by(scored, key, "score", config.contamination, -1.0, 0.0)
    scored = scored.join(limits, key).withColumn("__limit", F.col("quantile"))
    limit = F.col("__limit")
    s = F.col("score")
    return scored.where(s < limit).select(
        *order, F.lit("statistical_anomaly").alias("type"),
        F.lit("medium").alias("severity"), confidence(s).alias("confidence"),
        F.col("function_name").alias("function"), F.col("file_path").alias("file"),
        F.col("start_line").alias("line_number"), F.col("start_line").alias("file_line"),
        "code_snippet", "chunk_id", F.bround(s, 4).alias("anomaly_score"),
        F.format_string(
            fixed.ANOMALY_MESSAGE, F.col("function_name"), F.bround(s, 3).cast("string")
        ).alias("message"),
    )
