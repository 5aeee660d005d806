"""Two-source comparisons: field-level audits, sampled windows, boundary and code agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.sizing import small_side
from tallyweave.sources.fingerprint import digest_slices, SLICES


def table_diff(
    left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], consensus: list[str], strict: bool = True
) -> DataFrame:
    """Field-level audit of two tables matched on a key.

    Each side is read and shuffled once: rows are grouped by key, which counts repeated keys and keeps
    the partitioning that the full outer join needs. One aggregate gives, per field, the
    matched and one-sided key counts, values missing on a side, value mismatches and an order-free
    digest per side. ``consensus`` names the fields whose agreement establishes the same record;
    the others are provider metadata. With ``strict`` a repeated key fails the job; without it each
    key stands for the first of its rows in order of their values, and ``primary_repeated_key_count`` and
    ``validation_repeated_key_count`` say how many keys that were. Null keys match none.
    """

    def side(df: DataFrame, mark: str) -> DataFrame:
        kept = df.groupBy(*[F.col(k).alias(f"{mark}k{i}") for i, k in enumerate(keys)]).agg(
            F.count(F.lit(1)).alias(f"{mark}n"), F.min(F.struct(*[F.col(f) for f in fields])).alias("_row")
        )
        return kept.select(*[f"{mark}k{i}" for i in range(len(keys))], f"{mark}n", *[F.col(f"_row.{f}").alias(f"{mark}_{f}") for f in fields])

    same = reduce(lambda p, q: p & q, [F.col(f"_lk{i}") == F.col(f"_rk{i}") for i in range(len(keys))])
    joined = side(left, "_l").join(side(right, "_r"), same, "full_outer")
    joined = joined.withColumns({k: F.coalesce(f"_lk{i}", f"_rk{i}") for i, k in enumerate(keys)})
    in_left, in_right = F.col("_ln").isNotNull(), F.col("_rn").isNotNull()
    repeated = (F.coalesce("_ln", F.lit(0)) > 1, F.coalesce("_rn", F.lit(0)) > 1)
    if strict:
        broken = F.raise_error(F.lit(f"repeated key {keys} in a compared table")).cast("boolean")
        joined = joined.where(F.when(repeated[0] | repeated[1], broken).otherwise(F.lit(True)))
    both = in_left & in_right
    identity = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys])
    aggregates = [
        F.coalesce(F.sum("_ln"), F.lit(0)).alias("primary_row_count"),
        F.coalesce(F.sum("_rn"), F.lit(0)).alias("validation_row_count"),
        F.count_if(both).alias("matched_key_count"),
        F.count_if(in_left & ~in_right).alias("primary_only_key_count"),
        F.count_if(in_right & ~in_left).alias("validation_only_key_count"),
        F.count_if(repeated[0]).alias("primary_repeated_key_count"),
        F.count_if(repeated[1]).alias("validation_repeated_key_count"),
    ]
    for i, f in enumerate(fields):
        x, y = F.col(f"_l_{f}"), F.col(f"_r_{f}")
        aggregates += [
            F.count_if(both & x.isNull()).alias(f"pm{i}"),
            F.count_if(both & y.isNull()).alias(f"vm{i}"),
            F.count_if(both & x.isNotNull() & y.isNotNull() & (x != y)).alias(f"mm{i}"),
            *digest_slices(F.when(x.isNotNull(), F.concat_ws("|", identity, x.cast("string"))), f"pd{i}_"),
            *digest_slices(F.when(y.isNotNull(), F.concat_ws("|", identity, y.cast("string"))), f"vd{i}_"),
        ]
    wide = joined.agg(*aggregates)

    def digest(prefix: str) -> str:
        parts = ", ".join(f"cast({prefix}{j} AS string)" for j in range(SLICES))
        return f"sha2(concat_ws(':', {parts}), 256)"

    rows = ", ".join(
        f"'{f}', '{'consensus' if f in consensus else 'provider_metadata'}', pm{i}, vm{i}, mm{i}, {digest(f'pd{i}_')}, {digest(f'vd{i}_')}"
        for i, f in enumerate(fields)
    )
    shared = ["primary_row_count", "validation_row_count", "matched_key_count", "primary_only_key_count", "validation_only_key_count"]
    shared += [] if strict else ["primary_repeated_key_count", "validation_repeated_key_count"]
    long = wide.selectExpr(
        *shared,
        f"stack({len(fields)}, {rows}) AS (field, field_class, primary_missing_count, validation_missing_count, value_mismatch_count, primary_digest, validation_digest)",
    )
    zero = [F.col(c) == 0 for c in ("primary_only_key_count", "validation_only_key_count", "primary_missing_count", "validation_missing_count", "value_mismatch_count")]
    return long.withColumn("exact_match", reduce(lambda p, q: p & q, zero))


def diff_status(audit: DataFrame) -> DataFrame:
    """One row: full match, consensus match with differing metadata, or mismatch."""
    out = audit.agg(
        F.bool_and(F.col("exact_match") | (F.col("field_class") != "consensus")).alias("consensus_match"),
        F.bool_and("exact_match").alias("full_match"),
    )
    status = (
        F.when(F.col("full_match"), F.lit("full_payload_exact_match"))
        .when(F.col("consensus_match"), F.lit("consensus_match_provider_metadata_differs"))
        .otherwise(F.lit("consensus_mismatch"))
    )
    return out.withColumn("validation_status", status)


def window_checks(primary: DataFrame, validation: DataFrame, windows: DataFrame, columns: list[str], block: str = "block_number") -> DataFrame:
    """Row counts and digests of both sources inside each sampled block window."""
    windows = small_side(windows)

    def side(df: DataFrame, prefix: str) -> DataFrame:
        inside = df.join(windows, F.col(block).between(F.col("from_block"), F.col("to_block")))
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
        out = inside.groupBy("from_block", "to_block").agg(
            F.count(F.lit(1)).alias(f"{prefix}_row_count"), *digest_slices(text, f"_{prefix}")
        )
        parts = [F.col(f"_{prefix}{i}").cast("string") for i in range(SLICES)]
        return out.withColumn(f"{prefix}_digest", F.sha2(F.concat_ws(":", *parts), 256)).drop(*[f"_{prefix}{i}" for i in range(SLICES)])

    joined = windows.join(side(primary, "primary"), ["from_block", "to_block"], "left").join(
        side(validation, "validation"), ["from_block", "to_block"], "left"
    )
    joined = joined.fillna(0, ["primary_row_count", "validation_row_count"])
    return joined.withColumn("exact_match", F.col("primary_digest").eqNullSafe(F.col("validation_digest")))


def boundary_agreement(boundaries: DataFrame, headers: DataFrame, key: str = "cohort_id") -> DataFrame:
    """First, week-zero and last two boundaries of each cohort against another header table."""
    span = boundaries.groupBy(key).agg(F.min("boundary_event_week").alias("_lo"), F.max("boundary_event_week").alias("_hi"))
    week = F.col("boundary_event_week")
    sample = boundaries.join(span, key).where((week == F.col("_lo")) | (week == 0) | (week >= F.col("_hi") - 1)).drop("_lo", "_hi")
    other = headers.select(F.col("block_number").alias("start_block"), F.col("block_hash").alias("_hash"), F.col("timestamp").alias("_ts"))
    match = F.col("_hash").eqNullSafe(F.col("start_block_hash")) & F.col("_ts").eqNullSafe(F.col("start_block_timestamp"))
    return small_side(sample).join(other, "start_block", "left").select(
        key, "boundary_event_week", "start_block", F.col("_hash").alias("validation_block_hash"), match.alias("exact_match")
    )


def code_agreement(primary: DataFrame, validation: DataFrame, independent: bool = True) -> DataFrame:
    """Historical code at a block across two sources: ``address, block_number, code``.

    A null code on the validating side means its state was unavailable.
    """
    b = validation.select("address", "block_number", F.col("code").alias("_v"), F.lit(True).alias("_found"))
    joined = primary.join(b, ["address", "block_number"], "left")
    code, other = F.col("code"), F.col("_v")
    status = (
        F.when(F.coalesce(code, F.lit("0x")) == "0x", F.lit("primary_code_absent"))
        .when(F.col("_found").isNull() | other.isNull(), F.lit("validation_historical_state_unavailable"))
        .when(other == "0x", F.lit("validation_historical_code_absent"))
        .when(code != other, F.lit("code_differs"))
        .otherwise(F.lit("independent_exact_match" if independent else "same_endpoint_replay"))
    )
    return joined.select(
        "address", "block_number", status.alias("status"), F.coalesce((code == other) & (code != "0x"), F.lit(False)).alias("exact_match")
    )
