"""Order-free content digests of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_DIGITS = 15  # 60 bits of a SHA-256 per slice
SLICES = 4


def row_text(columns: list[str]) -> Column:
    """Canonical text of a row: ``name=value`` in name order, ``~`` for null."""
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("~"))) for c in sorted(columns)]
    return F.concat_ws("|", *cells)


def digest_slices(text: Column, prefix: str) -> list[Column]:
    """Aggregates: each slice of the row hash is summed, so row order does not matter."""
    digest = F.sha2(text, 256)
    return [
        F.coalesce(F.sum(F.conv(F.substring(digest, 1 + SLICE_DIGITS * i, SLICE_DIGITS), 16, 10).cast("decimal(20,0)")), F.lit(0))
        .cast("decimal(38,0)")
        .alias(f"{prefix}{i}")
        for i in range(SLICES)
    ]


def dataset_fingerprint(df: DataFrame, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Row count and digest of a table, or of each group. Equal tables have equal digests
    whatever their partitioning; repeated rows count as often as they occur."""
    columns = columns or [c for c in df.columns if c not in (by or [])]
    out = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("row_count"), *digest_slices(row_text(columns), "_d"))
    slices = [F.col(f"_d{i}").cast("string") for i in range(SLICES)]
    text = F.concat_ws(":", F.col("row_count").cast("string"), *slices)
    return out.withColumn("fingerprint", F.sha2(text, 256)).drop(*[f"_d{i}" for i in range(SLICES)])


def run_summary(df: DataFrame, distinct: dict[str, str] | None = None, flags: dict[str, Column] | None = None) -> DataFrame:
    """One-row summary: row count, distinct counts and conditional counts."""
    aggregates = [F.count(F.lit(1)).alias("row_count")]
    aggregates += [F.count_distinct(F.col(c)).alias(name) for name, c in (distinct or {}).items()]
    aggregates += [F.count_if(rule).alias(name) for name, rule in (flags or {}).items()]
    return df.agg(*aggregates)
