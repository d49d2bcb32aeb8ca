"""Cosine match and nearest neighbours.

Vectors move in packs (a bounded block of rows as one row: ids and one matrix), and a
pair of packs is answered by one matrix product that keeps the best few per query. So
neither side is ever paired row by row, and a hot group is only more packs, spread over
many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as t
from pyspark.sql.window import Window

from .. import fixed_values as fixed
from ..functions import text as T
from ..functions.vectors import has_vector
from ..plans.checkpoints import cut
from ..plans.skew import keep_last_wide, shared, spread_lookup

# Rows of a pattern library, or of a query side, that may be sent to every task (some tens
# of MB of 1,000 wide vectors). Queries cost k result rows each in every task.
SMALL_LIBRARY_ROWS = 16_384
SMALL_QUERY_ROWS = 2_048
PACK_ROWS = 2_048
# Queries of one matrix product, which has as many rows of scores and a column per index row.
PRODUCT_ROWS = 256
# Digits that scores are compared with, in every form of the search.
SCORE_DIGITS = 6
# Without keys all rows meet all rows: bytes of the index that a task reads and buffers, products of a
# task, and the fewest queries that are worth a task.
INDEX_PART_BYTES = 128 * 1024 * 1024
TASK_PRODUCTS = 2 ** 32
TASK_QUERIES = 256
# Index rows that the first best ones come from; later ones are compared with these.
_FIRST_ROWS = 64
# Rows of a key that stay together: larger groups are cut into blocks of about as many, by a
# hash of the id. The index rows of a block (128 MB of 1,000 wide vectors) are buffered by the join.
BLOCK_ROWS = 8 * PACK_ROWS
_BLOCKS = "__blocks"


def _unit_rows(vectors) -> np.ndarray:
    """Matrix of unit rows in double; a vector without length stays all zero."""
    m = np.asarray(vectors, dtype=np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _small_side(df: DataFrame, key: str, limit: int):
    """(keys, unit matrix) of a side of at most ``limit`` rows, None for a larger one."""
    got = df.select(key, "embedding").limit(limit + 1).toArrow()
    if got.num_rows > limit:
        return None
    if got.num_rows == 0:
        return [], None
    flat = got.column("embedding").combine_chunks().flatten()
    matrix = flat.to_numpy(zero_copy_only=False).reshape(got.num_rows, -1)
    keys = got.column(key).to_pylist()
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return [keys[i] for i in order], _unit_rows(matrix[order])


def _best(scores: np.ndarray, ids: np.ndarray, k: int):
    """Columns of the k best scores per row, ties by smaller id. Scores have ``SCORE_DIGITS``
    digits, so score and place among the ids make one integer, and k are selected, not all sorted."""
    n = len(ids)
    place = np.empty(n, np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(n)
    steps = np.rint(np.nan_to_num(scores, nan=-2.0) * 10.0 ** SCORE_DIGITS).astype(np.int64)
    key = place - steps * n
    if k < n:
        best = np.argpartition(key, k - 1, axis=1)[:, :k]
    else:
        best = np.broadcast_to(np.arange(n), key.shape)
    return np.take_along_axis(best, np.argsort(np.take_along_axis(key, best, 1), axis=1), 1)


def _running(kept, scores: np.ndarray, ids: np.ndarray, k: int):
    """(scores, ids) of the k best per row, of those ``kept`` so far (None at first) and new columns."""
    best = _best(scores, ids, k)
    new, new_ids = np.take_along_axis(scores, best, 1), ids[best]
    if kept is None:
        return new, new_ids
    new = np.concatenate([kept[0], new], 1)
    new_ids = np.concatenate([kept[1], new_ids], 1)
    # Ties go to the smaller id: first by id, then, stably, by score.
    by_id = np.argsort(new_ids, axis=1, kind="stable")
    new, new_ids = np.take_along_axis(new, by_id, 1), np.take_along_axis(new_ids, by_id, 1)
    top = np.argsort(-new, axis=1, kind="stable")[:, :k]
    new, new_ids = np.take_along_axis(new, top, 1), np.take_along_axis(new_ids, top, 1)
    return new, new_ids


def _better(kept: list, units: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int) -> None:
    """:func:`_running` over the rows of ``matrix``, in ``kept`` by lots of ``PRODUCT_ROWS`` queries, so that a product
    is bounded. Products are taken in single precision first; in double only those of rows that come up to the k-th
    best of a query, within what rounding can change."""
    single, rows = units.astype(np.float32), matrix.astype(np.float32)
    for lot, begin in enumerate(range(0, len(units), PRODUCT_ROWS)):
        end, done = begin + PRODUCT_ROWS, 0
        if lot == len(kept):
            done = min(len(ids), max(k, _FIRST_ROWS))
            kept.append(_running(None, np.round(units[begin:end] @ matrix[:done].T, SCORE_DIGITS), ids[:done], k))
        while done < len(ids):
            # The best of few rows let many through: at first, as many rows go on as went before.
            stop = 2 * done if done else len(ids)
            kept[lot] = _step(kept[lot], units[begin:end], single[begin:end], matrix[done:stop], rows[done:stop], ids[done:stop], k)
            done = stop


def _step(kept, units, single, matrix, rows, ids, k: int):
    """``kept`` of one lot of queries after some more index rows; ``single`` and ``rows`` are the same vectors in single precision."""
    best, best_ids = kept
    if best.shape[1] < k:
        return _running(kept, np.round(units @ matrix.T, SCORE_DIGITS), ids, k)
    least = best.min(axis=1)
    # A product of unit rows is off by less than this in single precision, whatever the order of its sum.
    slack = (units.shape[1] + 8) * 2.0 ** -24 + 10.0 ** -SCORE_DIGITS
    hits = np.flatnonzero(single @ rows.T >= (least - slack).astype(np.float32)[:, None])
    at, column = np.divmod(hits, len(ids))
    asked = np.unique(at)
    # What is no number counts as the least; only queries that hold such rows can take more of them.
    blank = np.flatnonzero(np.isnan(least))
    if len(hits) > 8 * PRODUCT_ROWS or len(blank):
        asked = np.union1d(asked, blank)
        best[asked], best_ids[asked] = _running(
            (best[asked], best_ids[asked]), np.round(units[asked] @ matrix.T, SCORE_DIGITS), ids, k)
    elif len(hits):
        scores = np.round(np.einsum("ij,ij->i", units[at], matrix[column]), SCORE_DIGITS)
        query = np.concatenate([np.repeat(asked, k), at])
        scores = np.concatenate([best[asked].ravel(), scores])
        found = np.concatenate([best_ids[asked].ravel(), ids[column]])
        place = np.unique(found, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((place, -scores, query))
        first = np.searchsorted(query[order], asked)
        top = order[first[:, None] + np.arange(k)]
        best[asked], best_ids[asked] = scores[top], found[top]
    return best, best_ids


# --- best pattern per chunk ------------------------------------------------------


def best_pattern(chunks: DataFrame, patterns: DataFrame, id_column: str = "chunk_id"):
    """``chunks`` plus ``best_ord``, ``best_score``: the pattern (``ord``, ``embedding``)
    most similar to each chunk, the earliest one on ties.

    A pattern library is small, so after a look at its size it is sent to every task
    as one matrix. A larger one goes through the pack join. Scores have six digits in either
    form, so that ties are the same.
    """
    chunks = chunks.where(has_vector(F.col("embedding")))
    library = patterns.where(has_vector(F.col("embedding"))).select("ord", "embedding")
    small = _small_side(library, "ord", SMALL_LIBRARY_ROWS)
    if small is None:
        top = nearest(
            chunks.select(F.col(id_column).alias("query_id"), "embedding"),
            library.select(F.col("ord").alias("id"), "embedding"),
            1, packed=True,
        )
        hit = top.select(
            F.col("query_id").alias(id_column), F.col("id").alias("best_ord"),
            F.col("similarity").alias("best_score"),
        )
        return chunks.join(hit, id_column)
    ords, units = small
    if units is None:
        nothing = F.lit(None)
        return chunks.where(F.lit(False)).select(
            "*", nothing.cast("int").alias("best_ord"),
            nothing.cast("double").alias("best_score"),
        )
    matrix = chunks.sparkSession.sparkContext.broadcast(units)

    def match(vectors: pa.Array) -> pa.Array:
        m = matrix.value
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        scores = _unit_rows(values.reshape(len(vectors), m.shape[1])) @ m.T
        scores = np.round(scores, SCORE_DIGITS)
        best = scores.argmax(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(best, pa.int32()),
             pa.array(scores[np.arange(len(best)), best], pa.float64())],
            ["at", "score"],
        )

    match.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    found = F.arrow_udf(
        match,
        t.StructType([t.StructField("at", t.IntegerType()),
                      t.StructField("score", t.DoubleType())]),
    ).asNondeterministic()
    return (
        chunks.withColumn("__m", found("embedding"))
        .withColumn("best_ord", F.array(*map(F.lit, ords))[F.col("__m.at")])
        .withColumn("best_score", F.col("__m.score"))
        .drop("__m")
    )


def semantic_flags(
    chunks: DataFrame, patterns: DataFrame, threshold: float
) -> DataFrame:
    """At most one issue per chunk: its best pattern, where it scores high enough.

    ``patterns`` has ``ord``, ``label``, ``pattern``, ``embedding``.
    """
    order = [c for c in ("repo", "rel_path", "func_seq", "part") if c in chunks.columns]
    flagged = best_pattern(chunks, patterns).where(F.col("best_score") >= threshold)
    names = patterns.select(
        F.col("ord").alias("best_ord"), "label", F.col("pattern").alias("matched_pattern")
    )
    n = names.limit(SMALL_LIBRARY_ROWS + 1).count()
    if n <= SMALL_LIBRARY_ROWS:
        named = flagged.join(F.broadcast(names), "best_ord")
    else:
        named = spread_lookup(flagged, names, ["best_ord"], spread_by=["chunk_id"])
    score = F.col("best_score")
    return named.select(
        *order, F.lit("semantic_similarity_flag").alias("type"),
        F.lit("medium").alias("severity"),
        F.col("function_name").alias("function"), F.col("file_path").alias("file"),
        F.col("start_line").alias("line_number"), F.col("start_line").alias("file_line"),
        T.snippet(F.col("code")).alias("code_snippet"), "chunk_id",
        "matched_pattern", F.col("label").alias("pattern_label"),
        F.bround(score, 4).alias("similarity_score"),
        F.format_string(
            fixed.SEMANTIC_MESSAGE, F.col("label"),
            F.bround(score * 100, 1).cast("string"),
        ).alias("message"),
    )


# --- nearest neighbours ------------------------------------------------------------

def _hit_schema(queries: DataFrame, index: DataFrame) -> t.StructType:
    return t.StructType([
        t.StructField("query_id", queries.schema["query_id"].dataType),
        t.StructField("id", index.schema["id"].dataType),
        t.StructField("similarity", t.DoubleType()),
    ])


def _top_per_query(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _with_buckets(df: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """One row per hash table: the bucket is the signs of products with random
    directions, the same ones in every task and every run."""

    def sign(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.list_(pa.int32()))
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        m = flat.reshape(len(vectors), -1).astype(np.float64)
        planes = np.random.default_rng(seed).standard_normal((m.shape[1], tables * bits))
        on = (m @ planes >= 0).reshape(len(m), tables, bits)
        return pa.array(list((on << np.arange(bits)).sum(axis=2).astype(np.int32)))

    sign.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    signed = F.arrow_udf(sign, t.ArrayType(t.IntegerType())).asNondeterministic()
    return df.withColumn("__b", signed("embedding")).select(
        *df.columns, F.posexplode("__b").alias("table", "bucket")
    )


def _block_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of more than ``BLOCK_ROWS`` rows and the blocks they go into: at most one row here
    for ``BLOCK_ROWS`` rows there. Stored, so that a join knows its size."""
    blocks = F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias(_BLOCKS)
    return cut(df.groupBy(*keys).count().where(F.col("count") > BLOCK_ROWS).select(*keys, blocks))


def _with_blocks(df: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    return df.join(counts, keys, "left").withColumn(_BLOCKS, F.coalesce(_BLOCKS, F.lit(1)))


def _pack(df: DataFrame, keys: list[str], id_column: str, salts: int | Column) -> DataFrame:
    """Rows of one (keys, salt) as packs of at most ``PACK_ROWS`` rows."""
    salted = df.withColumn(
        "salt", F.pmod(F.xxhash64(id_column), F.lit(salts)).cast("int")
    ).select(*keys, "salt", id_column, "embedding")
    group = [*keys, "salt"]
    # Rows of a group meet in one task and stay next to each other; a pack is then a
    # run of neighbouring rows, built while streaming.
    placed = salted.repartition(*group).sortWithinPartitions(*group)
    schema = t.StructType(
        [salted.schema[c] for c in group]
        + [t.StructField("ids", t.ArrayType(salted.schema[id_column].dataType)),
           t.StructField("matrix", t.BinaryType())]
    )

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        held, ids, blocks = None, [], []

        def flush():
            row = [[v] for v in held]
            row.append([np.concatenate(ids).tolist()])
            row.append([np.concatenate(blocks).tobytes()])
            arrays = [pa.array(c, f.type) for c, f in zip(row, wanted)]
            return pa.RecordBatch.from_arrays(arrays, schema=wanted)

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            key_columns = [batch.column(g).to_numpy(zero_copy_only=False) for g in group]
            row_ids = batch.column(id_column).to_numpy(zero_copy_only=False)
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            units = _unit_rows(flat.reshape(n, -1))
            new_key = np.zeros(n, bool)
            for column in key_columns:
                new_key[1:] |= column[1:] != column[:-1]
            starts = [0, *np.flatnonzero(new_key), n]
            for begin, end in zip(starts, starts[1:]):
                key = tuple(batch.column(g)[begin].as_py() for g in group)
                while begin < end:
                    size = sum(map(len, ids))
                    if ids and (key != held or size >= PACK_ROWS):
                        yield flush()
                        ids, blocks, size = [], [], 0
                    held = key
                    stop = min(end, begin + PACK_ROWS - size)
                    ids.append(row_ids[begin:stop])
                    blocks.append(units[begin:stop])
                    begin = stop
        if ids:
            yield flush()

    return placed.mapInArrow(run, schema)


def nearest(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    *,
    within: tuple[str, ...] = (),
    packed: bool | None = None,
    tables: int = 0,
    bits: int = 12,
    seed: int = 7,
) -> DataFrame:
    """The k nearest index rows of each query by cosine: (query_id, id, similarity,
    rank), ties by smaller id.

    ``queries`` has ``query_id``, ``embedding``; ``index`` has ``id``, ``embedding``;
    both have the columns of ``within``, and only rows that agree on them can match.
    Exact by default: a query side that is found to be small is sent to every task, any
    other goes through the pack join (``packed`` forces it).  ``tables`` > 0 looks only at index rows that share a sign-hash
    bucket with the query in one of that many tables: much less work, and exact
    similarities, but a neighbour may be missed.
    """
    queries = queries.where(has_vector(F.col("embedding")))
    index = index.where(has_vector(F.col("embedding")))
    schema = _hit_schema(queries, index)
    if packed is False and (tables or within):
        raise ValueError("groups and hash tables need the packed form")
    if not packed and not tables and not within:
        small = _small_side(queries, "query_id", SMALL_QUERY_ROWS)
        if small is not None:
            return _top_per_query(_scan_index(index, small, k, schema), k)

    hits = _packed_hits(queries, index, k, list(within), tables, bits, seed)
    if tables:
        hits = hits.distinct()
    return _top_per_query(hits, k)


def _packed_hits(queries, index, k: int, keys: list[str], tables: int = 0, bits: int = 12, seed: int = 7) -> DataFrame:
    """The k best of each query in each block of the index that shares its keys; a row whose key
    is null shares it with none.

    Blocks follow measured sizes: a group of up to ``BLOCK_ROWS`` rows is one. Without keys they are
    the parts of :func:`_all_hits`."""
    schema = _hit_schema(queries, index)
    if tables:
        queries = _with_buckets(queries, tables, bits, seed)
        index = _with_buckets(index, tables, bits, seed)
        keys = [*keys, "table", "bucket"]
    if not keys:
        return _all_hits(queries, index, k, schema)
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    queries, index = queries.where(known), index.where(known)
    index_blocks = _block_counts(index, keys)
    queries = _with_blocks(queries, keys, _block_counts(queries, keys))
    index = _with_blocks(index, keys, index_blocks)
    left = _pack(queries, keys, "query_id", F.col(_BLOCKS)).drop("salt")
    left = _with_blocks(left, keys, index_blocks).select(
        *keys, F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"),
        F.explode(F.sequence(F.lit(0), F.col(_BLOCKS) - 1)).alias("salt"),
    )
    right = _pack(index, keys, "id", F.col(_BLOCKS))
    return _products(left, right, [*keys, "salt"], k, schema)


def _number_type(df: DataFrame) -> np.dtype:
    single = isinstance(df.schema["embedding"].dataType.elementType, t.FloatType)
    return np.dtype(np.float32 if single else np.float64)


def _flat_packs(df: DataFrame, id_column: str, rows: int, parts: int, names: tuple[str, str]) -> DataFrame:
    """Neighbouring rows as packs of at most ``rows`` rows, dealt to ``parts`` partitions. Vectors stay as they are, so
    a pack has the size of its rows."""
    number = _number_type(df)
    schema = t.StructType([
        t.StructField(names[0], t.ArrayType(df.schema[id_column].dataType)), t.StructField(names[1], t.BinaryType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        ids, vectors, held = [], [], 0

        def flush():
            row = [np.concatenate(ids).tolist()], [np.concatenate(vectors).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, wanted)], schema=wanted)

        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                part = batch.slice(begin, rows - held)
                begin += part.num_rows
                held += part.num_rows
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                vectors.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(number, copy=False))
                if held == rows:
                    yield flush()
                    ids, vectors, held = [], [], 0
        if held:
            yield flush()

    return df.select(id_column, "embedding").mapInArrow(run, schema).repartition(parts)


def _all_hits(queries: DataFrame, index: DataFrame, k: int, schema) -> DataFrame:
    """The k best of each query in each part of the index. Either side is dealt out once: a task reads a
    part of the queries and a part of the index from where the shuffle left them, and no pack is copied for the
    pairs that it is in. Parts follow measured sizes."""
    def told(df):
        n, width = df.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        return n, (width or 0) * _number_type(df).itemsize

    asked, _ = told(queries)
    n, row_bytes = told(index)
    index_parts = max(1, -(-n * row_bytes // INDEX_PART_BYTES))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    query_parts = max(1, -(-asked * n // (index_parts * TASK_PRODUCTS)), min(2 * cores, -(-asked // TASK_QUERIES)))
    query_rows = min(PACK_ROWS, max(1, -(-asked // (4 * query_parts))))
    left = _flat_packs(queries, "query_id", query_rows, query_parts, ("query_ids", "query_matrix"))
    right = _flat_packs(index, "id", PACK_ROWS, index_parts, ("ids", "matrix"))
    pairs = left.crossJoin(right.hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(_pair_products(k, schema, (_number_type(queries), _number_type(index))), schema)


def _products(left: DataFrame, right: DataFrame, on: list[str], k: int, schema) -> DataFrame:
    """Hits of query packs in the index packs they meet. A merge join streams its left side, so a
    task sees all index packs of one query pack in a row and hands on k rows per query for them."""
    pairs = left.join(right.hint("merge"), on).select("query_ids", "query_matrix", "ids", "matrix")
    return pairs.mapInArrow(_pair_products(k, schema), schema)


def _hits_batch(query_ids, kept, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)
    scores, ids = kept
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.asarray(query_ids), scores.shape[1])).cast(wanted[0].type),
         pa.array(ids.ravel()).cast(wanted[1].type), pa.array(scores.ravel(), pa.float64())],
        schema=wanted,
    )


def _together(kept: list):
    return tuple(np.concatenate(columns) for columns in zip(*kept))


def _pair_products(k: int, schema, numbers: tuple[np.dtype, np.dtype] | None = None):
    """Running top-k over the pairs of a task. Only the best of the query pack at hand are held;
    if its pairs do not come in a row, more rows leave the task and the top-k is the same. Packs hold
    unit rows, or vectors as they are, of the types ``numbers``."""
    def units_of(matrix, n: int, number) -> np.ndarray:
        if number is None:
            return np.frombuffer(matrix).reshape(n, -1)
        return _unit_rows(np.frombuffer(matrix, number).reshape(n, -1))

    def run(batches):
        held = a = query_ids = kept = None
        query_number, number = numbers or (None, None)
        for batch in batches:
            columns = [batch.column(c) for c in ("query_ids", "query_matrix", "ids", "matrix")]
            for at in range(batch.num_rows):
                asked, matrix, ids, rows = (c[at] for c in columns)
                ids = ids.values.to_numpy(zero_copy_only=False)
                if held is None or not (matrix.as_buffer().equals(held) and asked.values.equals(query_ids)):
                    if held is not None:
                        yield _hits_batch(query_ids.to_numpy(zero_copy_only=False), _together(kept), schema)
                    held, query_ids, kept = matrix.as_buffer(), asked.values, []
                    a = units_of(held, len(query_ids), query_number)
                _better(kept, a, units_of(rows.as_buffer(), len(ids), number), ids, k)
        if held is not None:
            yield _hits_batch(query_ids.to_numpy(zero_copy_only=False), _together(kept), schema)

    return run


def _scan_index(index: DataFrame, small: tuple, k: int, schema) -> DataFrame:
    """One pass over the index with the queries in memory: each batch gives the k best
    per query, and each task hands on only its own best."""
    held = index.sparkSession.sparkContext.broadcast(small)

    def run(batches):
        query_ids, q = held.value
        if q is None:
            return
        kept = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            scores = np.round(q @ _unit_rows(flat.reshape(len(ids), -1)).T, SCORE_DIGITS)
            kept = _running(kept, scores, ids, k)
        if kept is not None:
            yield _hits_batch(query_ids, kept, schema)

    return index.select("id", "embedding").mapInArrow(run, schema)


def similar_functions(
    queries: DataFrame, index: DataFrame, k: int = 3, *, within: tuple[str, ...] = (),
    **how,
) -> DataFrame:
    """Up to k similar functions per query chunk, most similar first.

    The k+1 nearest are taken, then those with the query's own function name dropped.
    ``queries``: chunk_id, function_name, embedding; ``index``: chunk_id, function,
    file, code, embedding.  Code is looked up for the few results only.
    """
    repo = shared(["repo"], queries, index)

    def identity(df: DataFrame, name: str) -> DataFrame:
        # A chunk id is unique within a repo only.
        return df.withColumn(name, F.concat_ws("\u0001", *repo, F.col("chunk_id")))

    queries = identity(queries, "query_id")
    index = identity(index, "id")
    hits = cut(nearest(
        queries.select("query_id", *within, "embedding"), index.select("id", *within, "embedding"),
        k + 1, within=within, **how,
    ))
    wanted = index.join(hits.select("id").distinct(), "id", "left_semi")
    named = spread_lookup(
        hits, wanted.select("id", F.col("chunk_id").alias("similar_id"), "function", "file", "code"),
        ["id"], spread_by=["query_id"],
    )
    own = queries.select("query_id", *repo, "chunk_id", F.col("function_name").alias("own_name"))
    others = named.join(own, "query_id").where(F.col("function") != F.col("own_name"))
    w = Window.partitionBy("query_id").orderBy("rank")
    return (
        others.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
        .select(
            *repo, "chunk_id", "n", "similar_id",
            "function", T.base_name(F.col("file")).alias("file"), "code",
            F.bround("similarity", 3).alias("similarity"),
        )
    )


# --- incremental index -------------------------------------------------------------------


def index_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with a vector in the form they are indexed; the last of equal ids in a repo
    wins."""
    order = [c for c in ("rel_path", "func_seq", "part") if c in chunks.columns]
    order = order or ["file_path", "start_line"]
    keys = shared(["repo", "chunk_id"], chunks)
    kept = keep_last_wide(chunks, keys, order, has_vector(F.col("embedding")))
    return kept.select(
        *keys, "embedding", "code", F.col("function_name").alias("function"),
        F.col("file_path").alias("file"),
        F.coalesce(F.col("start_line"), F.lit(0)).cast("string").alias("start"),
    )


def new_rows(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows whose id is not in the index of their repo yet.

    The ids are looked up from the small side: only ids of the index that occur in
    ``rows`` are kept, so a large index is not shuffled when ``rows`` is small.
    """
    keys = shared(["repo", "chunk_id"], rows, index)
    known = index.select(*keys).join(rows.select(*keys), keys, "left_semi")
    return rows.join(known, keys, "left_anti")


def index_size(index: DataFrame) -> DataFrame:
    """(repo, rows): how many chunks the index holds, in all (repo NULL) and by repo."""
    repo = F.col("repo") if "repo" in index.columns else F.lit(None).cast("string")
    return index.select(repo.alias("repo")).rollup("repo").agg(
        F.count(F.lit(1)).alias("rows"), F.grouping("repo").alias("all")
    ).where((F.col("all") == 1) | F.col("repo").isNotNull()).select("repo", "rows")
