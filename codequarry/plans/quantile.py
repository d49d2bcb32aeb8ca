"""Exact quantiles of a numeric column without sorting or collecting it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

_BINS = 2_048
_FEW = 10_000


def _kth(df: DataFrame, column: str, k: int, low: float, high: float) -> tuple:
    """(value, rows up to and with it) of the k-th smallest row, k from 0."""
    x = F.col(column)
    below = 0
    while True:
        inside = df.where(x.between(low, high))
        width = (high - low) / _BINS
        slot = (
            F.least(F.floor((x - low) / width), F.lit(_BINS - 1)) if width > 0 else F.lit(0)
        )
        bins = (
            inside.groupBy(slot.alias("slot"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
            .orderBy("slot").collect()
        )
        for b in bins:
            if below + b.n > k:
                break
            below += b.n
        if b.lo == b.hi:
            return b.lo, below + b.n
        low, high = b.lo, b.hi
        if b.n <= _FEW:
            values = (
                df.where(x.between(low, high)).groupBy(x.alias("v"))
                .agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()
            )
            for v in values:
                if below + v.n > k:
                    return v.v, below + v.n
                below += v.n


def exact_quantile(df: DataFrame, column: str, share: float) -> float | None:
    """Quantile with linear interpolation between the two nearest rows.

    Each pass counts rows per bin (at most 2,048 counts come back) and looks closer at
    the one bin that holds the wanted row, so the cost is a few aggregates at any size.
    ``df`` is read several times: give it a stored table.
    """
    x = F.col(column)
    n, low, high = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return None
    at = (n - 1) * share
    k = math.floor(at)
    first, upto = _kth(df, column, k, low, high)
    if at == k:
        return first
    second = first if upto > k + 1 else df.where(x > first).agg(F.min(x)).first()[0]
    return first + (second - first) * (at - k)


def quantile_by(df: DataFrame, key: str, column: str, share: float, low: float, high: float, bins: int = _BINS) -> DataFrame:
    """``key, quantile`` of the non-null values of every group, interpolated like :func:`exact_quantile`.

    ``low`` and ``high`` bound the values, which only decides how fine the first count is. One pass
    counts values per group and bin; a second one looks at the bin or two that hold the wanted
    rows of each group. ``df`` is read twice: give it a stored table."""
    x = F.col(column)
    slot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x - low) / ((high - low) / bins)))).cast("int")
    placed = df.where(x.isNotNull()).select(F.col(key).alias("g"), slot.alias("slot"), x.alias("x"))
    by_slot = Window.partitionBy("g").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("g")
    counted = placed.groupBy("g", "slot").agg(F.count(F.lit(1)).alias("n")).select(
        "g", "slot", "n", F.coalesce(F.sum("n").over(by_slot), F.lit(0)).alias("below"), F.sum("n").over(whole).alias("total"))
    at = (F.col("total") - 1) * share
    ranked = counted.withColumn("at", at).withColumn("k", F.floor(at))
    # The wanted rows are the k-th and the one after it, from 0.
    holds = ranked.where((F.col("below") <= F.col("k") + 1) & (F.col("below") + F.col("n") > F.col("k")))
    inside = placed.join(holds.select("g", "slot", "below", "at", "k"), ["g", "slot"]).groupBy("g", "slot", "x", "below", "at", "k").agg(
        F.count(F.lit(1)).alias("n"))
    by_value = Window.partitionBy("g", "slot").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("below") + F.coalesce(F.sum("n").over(by_value), F.lit(0))
    spans = inside.withColumn("start", start).withColumn("end", F.col("start") + F.col("n"))

    def value(rank):
        return F.max(F.when((F.col("start") <= rank) & (F.col("end") > rank), F.col("x")))

    first, second = value(F.col("k")), value(F.col("k") + 1)
    both = spans.groupBy("g").agg(first.alias("first"), second.alias("second"), F.max(F.col("at") - F.col("k")).alias("part"))
    return both.select(F.col("g").alias(key), F.when(F.col("part") == 0, F.col("first")).otherwise(
        F.col("first") + (F.col("second") - F.col("first")) * F.col("part")).alias("quantile"))
