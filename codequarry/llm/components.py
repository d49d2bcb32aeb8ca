"""Connected components: edges are contracted in lots, then by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.checkpoints import cut, cut_counted, forget

#: Edges that a task contracts at once.
LOT_EDGES = 1 << 19


def _named(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges with their smallest connected node, without those that are this themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[:len(a)], ends[len(a):]
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    own = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[own], nodes[low[own]]


def _contract(batches):
    """Edges to as few as connect the same nodes, lot by lot."""
    def stars(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([r.column(k).to_numpy(zero_copy_only=False) for r in rows]) for k in (0, 1))
        schema = rows[0].schema
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(_named(a, b), schema)], schema=schema)

    held, n = [], 0
    for batch in batches:
        while n + batch.num_rows >= LOT_EDGES:
            held.append(batch.slice(0, LOT_EDGES - n))
            yield stars(held)
            batch, held, n = batch.slice(LOT_EDGES - n), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield stars(held)


def _star(edges: DataFrame, upward: bool) -> DataFrame:
    """One star step over edges ``(a, b)`` with ``a > b``.

    Upward (large star): every node tells its larger neighbours its smallest neighbour.
    Downward (small star): every node tells its smaller neighbours their smallest one.
    A node's neighbours are never gathered: its minimum is an aggregate with map-side
    combine, and the edges meet it in a join that adaptive execution can split."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if upward else edges
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
    told = both.join(low, "a")
    if upward:
        told = told.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        told = told.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return told.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``; a component is called by its
    smallest node.

    Every task contracts its edges first. What is left of up to ``LOT_EDGES`` edges is one more lot;
    more go through rounds of stars, which grow with the logarithm of a component's width. Each step is stored.

    Loops, repeated and reversed edges are allowed. No edges give no rows."""
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    held, total = cut_counted(ends.mapInArrow(_contract, ends.schema))
    if total <= LOT_EDGES:
        now = cut(held.coalesce(1).mapInArrow(_contract, ends.schema))
        forget(held)
    else:
        now = _by_stars(held)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _by_stars(edges: DataFrame) -> DataFrame:
    """Every node with the smallest of its component, as edges, from stored edges ``(a, b)`` with ``a > b``."""
    now = cut(edges.distinct())
    forget(edges)
    held, before = now, None
    while True:
        step = _star(_star(now, True), False)
        stored, total = cut_counted(step.withColumn("__h", F.xxhash64("a", "b")))
        sums = stored.agg(F.sum(F.col("__h").cast("decimal(38,0)"))).first()[0]
        now = stored.drop("__h")
        forget(held)  # the round before has no reader any more
        held = stored
        if (total, sums) == before:
            return now
        before = (total, sums)
