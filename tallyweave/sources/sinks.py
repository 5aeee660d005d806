"""Deterministic sinks. Writes are all-or-nothing through the output committer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import shuffle_width


def write_table(
    df: DataFrame,
    path: str,
    sort_keys: list[str],
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    compression: str | None = None,
    mode: str = "errorifexists",
) -> str:
    """Write in key order: ranges over files, sorted inside each file.

    Part files in name order are the table in key order, so a CSV or JSON-lines table is
    byte-stable for a given number of files without passing through one task.
    """
    width = shuffle_width(df.sparkSession)
    if partition_by:
        placed = df.repartitionByRange(width, *partition_by, *sort_keys).sortWithinPartitions(*partition_by, *sort_keys)
    else:
        placed = df.repartitionByRange(width, *sort_keys).sortWithinPartitions(*sort_keys)
    writer = placed.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_summary(summary: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One-row summary document as JSON."""
    document = summary.select(F.to_json(F.struct(*sorted(summary.columns))).alias("value"))
    document.coalesce(1).write.mode(mode).text(path)
    return path


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count, fields and fingerprint of each table, one row per table."""
    from tallyweave.sources.fingerprint import dataset_fingerprint

    out = None
    for name, df in tables.items():
        row = dataset_fingerprint(df).withColumns(
            {"name": F.lit(name), "fields": F.array_join(F.array(*[F.lit(c) for c in df.columns]), ";")}
        )
        out = row if out is None else out.unionByName(row)
    return out
