"""Action tables on storage: typed scan and contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators.contracts import Contract, enforce, require_columns

ACTION_ROW = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("chain_id", T.LongType()),
            ("pool_address", T.StringType()),
            ("action", T.StringType()),
            ("event_signature", T.StringType()),
            ("topic0", T.StringType()),
            ("block_number", T.LongType()),
            ("block_hash", T.StringType()),
            ("tx_hash", T.StringType()),
            ("tx_index", T.LongType()),
            ("log_index", T.LongType()),
            ("reserve_address", T.StringType()),
            ("secondary_reserve_address", T.StringType()),
            ("actor_address", T.StringType()),
            ("beneficiary_address", T.StringType()),
            ("counterparty_address", T.StringType()),
            ("amount_raw", T.StringType()),
            ("secondary_amount_raw", T.StringType()),
            ("referral_code", T.IntegerType()),
            ("interest_rate_mode", T.IntegerType()),
            ("borrow_rate_ray", T.StringType()),
            ("use_a_tokens", T.BooleanType()),
            ("receive_a_token", T.BooleanType()),
            ("event_week", T.IntegerType()),
        )
    ]
)


def read_actions(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    columns: list[str] | None = None,
    chain: str | None = None,
    contract: Contract | None = None,
) -> DataFrame:
    """Scan of an action table: explicit schema, pruned columns, lower-case addresses.

    Parquet reads only the selected columns; CSV is read with the declared types and fails on
    a malformed row. ``chain`` adds a chain tag.
    """
    reader = spark.read
    if fmt == "csv":
        df = reader.schema(ACTION_ROW).option("header", True).option("mode", "FAILFAST").csv(path)
    else:
        df = reader.format(fmt).load(path)
    if columns:
        require_columns(df, columns, "action table")
        df = df.select(*columns)
    for name in df.columns:
        if name.endswith("_address"):
            df = df.withColumn(name, F.lower(F.col(name).cast("string")))
    if "action" in df.columns:
        df = df.withColumn("action", F.trim(F.lower("action")))
    if chain:
        df = df.withColumn("chain", F.lit(chain))
    return enforce(df, contract, "action table") if contract else df
