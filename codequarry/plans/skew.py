"""Joins that survive a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .checkpoints import stored

_SALT, _FILE, _ROW = "__salt", "__file_name", "__row_index"


def spread_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    *,
    spread_by: list[str],
    how: str = "inner",
    salts: int = 32,
) -> DataFrame:
    """Join many fact rows to a lookup with one row per key.

    Fact rows of one key are spread over ``salts`` groups by a hash of ``spread_by``.
    The lookup row is copied to just those (key, salt) groups that occur, so a rare
    key costs one copy and a hot key at most ``salts``; no row is dropped and nothing
    is sent to all tasks.  ``how`` is ``inner`` or ``left``.
    """
    salted = facts.withColumn(
        _SALT, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    )
    present = salted.select(*keys, _SALT).distinct()
    copies = present.join(lookup, keys, "inner")
    return salted.join(copies, [*keys, _SALT], how).drop(_SALT)


# A stored side of at most this many rows (of names and numbers, some tens of MB) may be
# sent to every task.
SMALL_ROWS = 200_000


def step_join(
    frontier: DataFrame, n_frontier: int, table: DataFrame, keys: list[str],
    *, spread_by: list[str], frontier_is_hot: bool,
) -> DataFrame:
    """Inner join of a loop's frontier, whose row count is known, with a large table.

    A small frontier is broadcast, so the table is not shuffled. A large one goes through
    :func:`spread_lookup`: ``frontier_is_hot`` says which side may repeat a key without
    bound and is spread; the other side is copied.
    """
    if n_frontier <= SMALL_ROWS:
        return table.join(F.broadcast(frontier), keys)
    if frontier_is_hot:
        return spread_lookup(frontier, table, keys, spread_by=spread_by)
    return spread_lookup(table, frontier, keys, spread_by=spread_by)


def shared(names: list[str], *tables: DataFrame) -> list[str]:
    """Those of the key columns that all tables have; ``repo`` may be absent from a corpus
    of one repository."""
    return [n for n in names if all(n in t.columns for t in tables)]


def keep_last_wide(
    df: DataFrame, keys: list[str], order: list[str], where: Column | None = None
) -> DataFrame:
    """:func:`keep_last` for rows with long texts or vectors, of the rows ``where`` holds.

    ``df`` is stored unless it is a stored table already. Keys, order columns and the place of a
    row in the stored files are reduced, with map-side combine and without reading the rest; the
    rows at the places that are left are then fetched by one hash join, so no wide row is sorted or
    aggregated. Of rows equal in keys and order the one that was stored last is kept. Null is a
    value like others, in keys and, as the least, in order columns. The keys are counted first: where none
    comes twice, the stored rows are the result and are not shuffled."""
    kept = stored(df)
    kept = kept if where is None else kept.where(where)
    if kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty():
        return kept.select(df.columns)
    placed = kept.select("*", F.col("_metadata.file_name").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))
    last = placed.groupBy(*keys).agg(F.max(F.struct(*order, _FILE, _ROW)).alias("__top"))
    places = last.select(f"__top.{_FILE}", f"__top.{_ROW}").hint("shuffle_hash")
    return placed.join(places, [_FILE, _ROW]).select(df.columns)


def join_null_safe(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, where null equals null; each key is in the result once."""
    names = [f"__right_{k}" for k in range(len(keys))]
    other = other.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *(c for c in other.columns if c not in keys))
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return df.join(other, same).drop(*names)


def keep_last(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: the one with the greatest order.  An aggregate with map-side
    combine, not a window, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), order).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*")
