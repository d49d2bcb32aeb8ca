"""Age of a change against a fixed point in time (never the wall clock)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def days_old(epoch: Column, as_of: int) -> Column:
    """Whole days, -1 where no timestamp is known. Truncates toward zero."""
    age = ((F.lit(as_of) - epoch) / F.lit(86_400)).cast("int")
    return F.when(epoch.isNull() | (epoch == 0), F.lit(-1)).otherwise(age)


def age_text(days: Column) -> Column:
    def n(unit: int, word: str) -> Column:
        return F.concat(
            F.lit("introduced "), (days / unit).cast("int").cast("string"), F.lit(word)
        )

    return (
        F.when(days < 0, "unknown age")
        .when(days == 0, "introduced today")
        .when(days == 1, "introduced yesterday")
        .when(days < 7, n(1, " days ago"))
        .when(days < 30, n(7, " week(s) ago"))
        .when(days < 365, n(30, " month(s) ago"))
        .otherwise(n(365, " year(s) ago"))
    )
