"""Texts as byte arrays: the vectorised ground under the operators.

Arrow hands a batch of texts over as one buffer with offsets. Words, shingles and windows
are computed for all texts of a batch at once with numpy; a batch is cut into pieces of
bounded size first, so memory follows the piece and the longest single text, never the
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.memory import give_back

PIECE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20

# Odd 64-bit multipliers of the hashes.
BASE = 0x9E3779B97F4A7C15
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_seeded = np.random.default_rng(20_240_601)
BYTE_CODE = _seeded.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class TaskCache(dict):
    """Tables kept while a task runs; they never travel with a pickled function."""

    def __reduce__(self):
        return TaskCache, ()


_powers = TaskCache()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values joined, and where each value starts (one more entry than rows).
    A null is an empty value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    if len(column) == 0 or body is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer text is a range of its own."""
    first = 0
    rows = len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last
    if len(data) >= most:
        give_back()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept per process."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            run = np.full(max(n, 1 << 16), base, np.uint64)
            run[0] = 1
            _powers[name] = np.cumprod(run)
    return _powers["up"], _powers["down"]


class SpanHash:
    """64-bit hashes of any span of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * powers[:len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        span = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mixed(span + (ends - starts).astype(np.uint64))


def token_bounds(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one non-zero kind, none across two texts."""
    n = len(kinds)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:n])
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    solid = kinds[starts] != 0
    return starts[solid], ends[solid]


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the first token of each text, one more entry than texts."""
    return np.searchsorted(starts, offsets)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; false for no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def small_batches(spark) -> None:
    """Whole texts are long rows: batches between Spark and Python are bounded by bytes, which
    keeps the buffers of all workers of an executor small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A stored table; the session's batches become small."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
