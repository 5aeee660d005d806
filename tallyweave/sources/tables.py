"""Views of the given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIONS = ["click", "error", "purchase", "signup", "view"]
FIRST_DAY, LAST_DAY = -14, 15  # event days around ACTIVATION_DAY that the events table spans
ACTIVATION_DAY = "2024-01-15"
ORDER_ACTIVATION = "1998-04-20"  # weekly clock for the orders tables


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded action rows out of the events table; the period is one day."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        (F.col("event_id") % 2).alias("chain_id"),
        kind.alias("action"),
        F.col("event_id").alias("block_number"),
        F.call_function("div", F.col("event_id"), F.lit(3)).cast("bigint").alias("tx_hash"),
        F.col("event_id").alias("log_index"),
        (k % 10).alias("reserve_address"),
        k.alias("actor_address"),
        F.col("user_id").alias("beneficiary_address"),
        F.when(kind == "view", (F.col("user_id") + k) % 100).alias("counterparty_address"),
        F.concat(F.round(F.col("value") * 100).cast("bigint").cast("string"), F.lit("0" * 16)).alias("amount_raw"),
        F.datediff(F.to_date("ts"), F.lit(ACTIVATION_DAY).cast("date")).alias("event_week"),
        F.col("ts"),
    )


def order_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as weekly actions: customer is the beneficiary, market segment the chain."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    day = F.datediff(F.to_date("o_orderdate"), F.lit(ORDER_ACTIVATION).cast("date"))
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("c_mktsegment").alias("chain"),
        F.col("o_orderpriority").alias("action"),
        F.floor(day / F.lit(7)).cast("int").alias("event_week"),
        F.col("o_custkey").alias("beneficiary_address"),
        F.col("o_orderkey").alias("tx_hash"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").alias("ts"),
    )


def supply_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Line items joined to orders as customer to supplier transfers."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("customer"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_quantity").alias("value"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("asset"),
    )


EVENT_TO_ACTION = {"click": "supply", "error": "liquidation", "purchase": "borrow", "signup": "repay", "view": "withdraw"}
POOL = "0x" + "ab" * 20


def address(n, prefix: str = "00000000"):
    """Forty-digit address text of a small integer."""
    return F.concat(F.lit("0x" + prefix), F.lpad(F.lower(F.hex(n)), 32, "0"))


def address_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as full action rows with address texts, ready to be encoded as logs."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    action = F.create_map(*[F.lit(x) for pair in EVENT_TO_ACTION.items() for x in pair])[F.col("event_type")]
    cents = F.round(F.col("value") * 100).cast("bigint")
    rows = table(spark, folder, "events").select(
        "event_id", "user_id", k.alias("k"), cents.alias("cents"), action.alias("action")
    )
    is_action = {a: F.col("action") == a for a in EVENT_TO_ACTION.values()}
    user, actor = address(F.col("user_id") + 1), address(F.col("k") + 1)
    return rows.select(
        F.lit(1).cast("bigint").alias("chain_id"),
        F.lit(POOL).alias("pool_address"),
        "action",
        F.col("event_id").alias("block_number"),
        F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("block"), F.col("event_id").cast("string")), 256)).alias("block_hash"),
        F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("tx"), F.col("event_id").cast("string")), 256)).alias("tx_hash"),
        (F.col("event_id") % 7).alias("tx_index"),
        (F.col("event_id") % 100).alias("log_index"),
        address(F.col("k") % 10 + 1, "aaaaaaaa").alias("reserve_address"),
        F.when(is_action["liquidation"], address(F.col("k") % 7 + 1, "bbbbbbbb")).alias("secondary_reserve_address"),
        F.when(is_action["withdraw"], user).otherwise(actor).alias("actor_address"),
        user.alias("beneficiary_address"),
        F.when(is_action["withdraw"], actor).alias("counterparty_address"),
        (F.col("cents") * F.lit(10**12)).cast("string").alias("amount_raw"),
        F.when(is_action["liquidation"], (F.col("cents") * 3).cast("string")).alias("secondary_amount_raw"),
        F.when(is_action["supply"] | is_action["borrow"], (F.col("k") % 5).cast("int")).alias("referral_code"),
        F.when(is_action["borrow"], F.lit(2)).alias("interest_rate_mode"),
        F.when(is_action["borrow"], (F.col("cents") * F.lit(10**9)).cast("string")).alias("borrow_rate_ray"),
        F.when(is_action["repay"], F.col("k") % 2 == 0).alias("use_a_tokens"),
        F.when(is_action["liquidation"], F.col("k") % 2 == 1).alias("receive_a_token"),
    )


def raw_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Every event encoded as a raw log."""
    from tallyweave.sources.logs import encode_logs

    return encode_logs(address_actions(spark, folder))


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """Block headers: one block per event, in time order."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("block_number"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("block"), F.col("event_id").cast("string")), 256)).alias("block_hash"),
    )


def warehouse_transfers(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a warehouse transfer table with mixed-case addresses and raw integers."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, folder, "events").select(
        F.col("ts").alias("block_timestamp"),
        F.col("event_id").alias("block_number"),
        F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("tx"), F.col("event_id").cast("string")), 256)).alias("transaction_hash"),
        (F.col("event_id") % 100).alias("log_index"),
        F.upper(F.substring(address(k % 5 + 1, "cccccccc"), 3, 40)).alias("_token"),
        address(k + 1).alias("from_address"),
        address(F.col("user_id") + 1).alias("to_address"),
        F.round(F.col("value") * 100).cast("bigint").alias("value"),
    ).withColumn("token_address", F.concat(F.lit("0x"), F.col("_token"))).drop("_token")
