"""Size-checked broadcasting and scalar attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only where the table is counted to be small; a plain join otherwise."""
    rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


def shuffled(df: DataFrame) -> DataFrame:
    """Hint against a broadcast of either side, for tables known to grow with the input.

    Estimates don't see that rows were exploded or that a written file is packed, so a plain join may
    send a table of many gigabytes through the driver.
    """
    return df.hint("merge")


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Attach a one-row table to every row."""
    keyed = scalar.withColumn("_one", F.lit(0))
    return df.withColumn("_one", F.lit(0)).join(F.broadcast(keyed), "_one").drop("_one")


def attach(df: DataFrame, totals: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join group totals to rows, null groups included, or the single total row when there is no group key."""
    if not by:
        return with_scalar(df, totals)
    named = totals.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = [df[c].eqNullSafe(named[f"_by_{c}"]) for c in by]
    return df.join(named, same, how).drop(*[f"_by_{c}" for c in by])
