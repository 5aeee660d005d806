"""Scans, decoders, sinks and ingest on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyweave.catalog.registry import query, r, rounded
from tallyweave.operators.contracts import split_valid
from tallyweave.session import shared_folder
from tallyweave.sources import fingerprint, logs, sinks, transfers
from tallyweave.sources import tables as T
from tallyweave.sources.actions import read_actions


def scratch(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _addr(n: str, prefix: str = "00000000") -> str:
    return f"'0x{prefix}' || lpad(lower(to_hex(CAST({n} AS BIGINT))), 32, '0')"


SRC = """src AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents,
  CASE event_type WHEN 'click' THEN 'supply' WHEN 'error' THEN 'liquidation' WHEN 'purchase' THEN 'borrow' WHEN 'signup' THEN 'repay' ELSE 'withdraw' END AS action FROM events)"""
TX = "'0x' || sha256('tx' || CAST(event_id AS VARCHAR))"
BLOCK = "'0x' || sha256('block' || CAST(event_id AS VARCHAR))"


@query(
    "s01_action_scan",
    "SELECT lower(event_type) AS event_type, count(*) AS event_count, max(event_id) AS last_event FROM events GROUP BY ALL",
)
def action_scan(spark, folder):
    df = read_actions(spark, f"{folder}/events.parquet", columns=["event_id", "event_type"])
    return df.groupBy(F.lower("event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("event_count"), F.max("event_id").alias("last_event"))


@query("s02_raw_log_scan", f"WITH {SRC} SELECT action, count(*) AS log_count, max(event_id) AS last_block FROM src GROUP BY ALL")
def raw_log_scan(spark, folder):
    path = scratch(spark, "rawlogs")
    T.raw_logs(spark, folder).write.option("compression", "gzip").json(path)
    read = logs.canonicalize_logs(logs.read_raw_logs(spark, path))
    topics = {spec.topic0: spec.action for spec in logs.EVENT_SPECS}
    action = F.create_map(*[F.lit(x) for pair in topics.items() for x in pair])[F.element_at("topics", 1)]
    return read.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("log_count"), F.max("block_number").alias("last_block"))


TOKENS = [f"0xcccccccc{n:032x}" for n in (1, 3)]


@query(
    "s03_token_transfer_scan",
    f"""WITH {SRC} SELECT event_id AS block_number, {TX} AS tx_hash, event_id % 100 AS log_index, CAST(1 AS BIGINT) AS chain_id, {_addr('k % 5 + 1', 'cccccccc')} AS token_address,
  {_addr('k + 1')} AS from_address, {_addr('user_id + 1')} AS to_address, CAST(cents AS VARCHAR) AS raw_value
FROM src WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' AND k % 5 IN (0, 2)""",
)
def token_transfer_scan(spark, folder):
    return transfers.scan_transfers(spark, T.warehouse_transfers(spark, folder), "2024-01-03", "2024-01-20", TOKENS).drop("timestamp")


@query(
    "s04_protocol_log_scan",
    f"""WITH {SRC} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS log_count, count(DISTINCT {TX}) AS transactions
FROM src WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY ALL""",
)
def protocol_log_scan(spark, folder):
    raw = logs.canonicalize_logs(T.raw_logs(spark, folder)).join(T.headers(spark, folder).select("block_number", "timestamp"), "block_number")
    view = raw.withColumnsRenamed({"timestamp": "block_timestamp", "transactionHash": "transaction_hash"})
    out = transfers.scan_protocol_events(spark, view, "2024-01-05", "2024-01-25", [T.POOL])
    return out.groupBy(F.to_date("timestamp").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("log_count"), F.count_distinct("tx_hash").alias("transactions")
    )


def _normalized(spark, folder):
    raw = transfers.scan_transfers(
        spark, T.warehouse_transfers(spark, folder), "2024-01-01", "2024-01-31", [f"0xcccccccc{n:032x}" for n in range(1, 6)]
    )
    assets = raw.select(F.col("token_address").alias("address")).distinct()
    index = F.conv(F.substring("address", 42, 1), 16, 10).cast("int")
    assets = assets.select("address", F.concat(F.lit("tok"), index.cast("string")).alias("symbol"), (index * 2).alias("decimals"))
    return transfers.normalize_transfers(raw, assets)


@query(
    "s05_normalize_transfers",
    f"""WITH {SRC} SELECT event_id AS block_number, 'TOK' || CAST(k % 5 + 1 AS VARCHAR) AS asset, CAST(cents AS VARCHAR) AS raw_value,
  {r('cents / pow(CAST(10 AS DOUBLE), 2 * (k % 5 + 1))', 11)} AS value FROM src""",
)
def normalize_transfers(spark, folder):
    return rounded(_normalized(spark, folder).select("block_number", "asset", "raw_value", "value"), 11)


@query(
    "s06_clean_transfers",
    f"""WITH {SRC} SELECT 'TOK' || CAST(k % 5 + 1 AS VARCHAR) AS asset, {_addr('k + 1')} AS from_address, count(*) AS transfers,
  {r('sum(cents / pow(CAST(10 AS DOUBLE), 2 * (k % 5 + 1)))')} AS value FROM src GROUP BY ALL""",
)
def clean_transfers(spark, folder):
    clean = transfers.clean_transfers(_normalized(spark, folder))
    return rounded(clean.groupBy("asset", "from_address").agg(F.count(F.lit(1)).alias("transfers"), F.sum("value").alias("value")))


DECODED = f"""decoded AS (SELECT CAST(1 AS BIGINT) AS chain_id, '{T.POOL}' AS pool_address, action, event_id AS block_number, {BLOCK} AS block_hash, {TX} AS tx_hash,
  event_id % 7 AS tx_index, event_id % 100 AS log_index, {_addr('k % 10 + 1', 'aaaaaaaa')} AS reserve_address,
  CASE WHEN action = 'liquidation' THEN {_addr('k % 7 + 1', 'bbbbbbbb')} END AS secondary_reserve_address,
  CASE WHEN action = 'withdraw' THEN {_addr('user_id + 1')} ELSE {_addr('k + 1')} END AS actor_address, {_addr('user_id + 1')} AS beneficiary_address,
  CASE WHEN action = 'withdraw' THEN {_addr('k + 1')} END AS counterparty_address, CAST(cents * 1000000000000 AS VARCHAR) AS amount_raw,
  CASE WHEN action = 'liquidation' THEN CAST(cents * 3 AS VARCHAR) END AS secondary_amount_raw,
  CASE WHEN action IN ('supply', 'borrow') THEN k % 5 END AS referral_code, CASE WHEN action = 'borrow' THEN CAST(2 AS BIGINT) END AS interest_rate_mode,
  CASE WHEN action = 'borrow' THEN CAST(cents * 1000000000 AS VARCHAR) END AS borrow_rate_ray,
  CASE WHEN action = 'repay' THEN k % 2 = 0 END AS use_a_tokens, CASE WHEN action = 'liquidation' THEN k % 2 = 1 END AS receive_a_token FROM src)"""


@query("s07_decode_logs", f"WITH {SRC}, {DECODED} SELECT * FROM decoded")
def decode_logs(spark, folder):
    out = logs.decode_logs(T.raw_logs(spark, folder), 1)
    return rounded(out.drop("event_signature", "topic0"))


@query(
    "s07_decode_rejects",
    f"""WITH {SRC}, t AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'data_aligned,data_word_count,word_domain' WHEN event_id % 50 = 1 THEN 'known_topic,topic_count,data_word_count,word_domain' ELSE '' END AS failed FROM src)
SELECT failed, count(*) AS logs FROM t GROUP BY ALL""",
)
def decode_rejects(spark, folder):
    raw = T.raw_logs(spark, folder)
    number = F.conv(F.substring("blockNumber", 3, 16), 16, 10).cast("bigint")
    broken = raw.withColumns(
        {
            "data": F.when(number % 50 == 0, F.substring("data", 1, 60)).otherwise(F.col("data")),
            "topics": F.when(
                number % 50 == 1, F.transform("topics", lambda t, i: F.when(i == 0, F.lit("0x" + "9" * 64)).otherwise(t))
            ).otherwise(F.col("topics")),
        }
    )
    out = logs.decode_logs(broken, 1, strict=False)
    return out.groupBy(F.array_join("failed_rules", ",").alias("failed")).agg(F.count(F.lit(1)).alias("logs"))


@query(
    "s08_decode_messages",
    f"""WITH {SRC} SELECT CAST(9 AS BIGINT) AS chain_id, '{T.POOL}' AS contract_address, '0x' || lpad(substr({_addr('user_id + 1')}, 3), 64, '0') AS message_id, {TX} AS tx_hash,
  event_id AS block_number, event_id % 7 AS transaction_index, event_id % 100 AS log_index FROM src""",
)
def decode_messages(spark, folder):
    topic0 = F.element_at("topics", 1)
    is_liquidation = topic0 == logs.EVENT_SPECS[4].topic0
    raw = T.raw_logs(spark, folder)
    out = logs.decode_messages(raw.where(~is_liquidation), 9, 2).unionByName(logs.decode_messages(raw.where(is_liquidation), 9, 3))
    good, _ = split_valid(out)
    return good.drop("block_hash")


FAMILY = "CASE action WHEN 'liquidation' THEN 'LiquidationCall' ELSE upper(action[1]) || action[2:] END"


@query(
    "s09_decode_beneficiaries",
    f"""WITH {SRC} SELECT '{T.POOL}' AS pool_address, event_id AS block_number, {TX} AS transaction_hash, event_id % 100 AS log_index, {FAMILY} AS event_family,
  {_addr('user_id + 1')} AS beneficiary_address FROM src""",
)
def decode_beneficiaries(spark, folder):
    good, _ = split_valid(logs.decode_beneficiaries(T.raw_logs(spark, folder)))
    return good


@query(
    "s10_canonical_logs",
    f"""WITH {SRC} SELECT '{T.POOL}' AS address, event_id AS block_number, event_id % 7 AS tx_index, event_id % 100 AS log_index, {TX} AS tx_hash FROM src""",
)
def canonical_logs(spark, folder):
    raw = T.raw_logs(spark, folder).withColumns({"address": F.upper("address"), "transactionHash": F.upper("transactionHash")})
    out = logs.in_log_order(logs.canonicalize_logs(raw))
    return out.select("address", "block_number", "tx_index", "log_index", F.col("transactionHash").alias("tx_hash"))


@query(
    "s11_chunk_plan_and_coverage",
    """WITH sp AS (SELECT event_type, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY ALL)
SELECT event_type, CAST(ceil((hi - lo + 1) / 97.0) AS BIGINT) AS chunk_count, CAST(0 AS BIGINT) AS gap_count, hi - lo + 1 AS covered_blocks, true AS continuous_inclusive_coverage FROM sp""",
)
def chunk_plan_and_coverage(spark, folder):
    spans = T.table(spark, folder, "events").groupBy("event_type").agg(F.min("event_id").alias("first_block"), F.max("event_id").alias("last_block"))
    chunks = logs.build_chunks(spans, 97)
    out = logs.coverage_audit(chunks, ["event_type"])
    return out.select("event_type", "chunk_count", "gap_count", "covered_blocks", "continuous_inclusive_coverage")


@query(
    "s11_time_shards",
    """WITH sp AS (SELECT event_type, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events GROUP BY ALL)
SELECT event_type, i AS shard_index, a + ((b - a) * i) // 4 AS start_us, a + ((b - a) * (i + 1)) // 4 AS end_us FROM sp, range(4) t(i)""",
)
def time_shards(spark, folder):
    spans = T.table(spark, folder, "events").groupBy("event_type").agg(
        F.min("ts").cast("timestamp").alias("scan_start_utc"), F.max("ts").cast("timestamp").alias("scan_end_utc")
    )
    out = logs.shard_windows(spans, 4)
    return out.select(
        "event_type", F.col("shard_index").cast("bigint").alias("shard_index"), F.unix_micros("scan_start_utc").alias("start_us"), F.unix_micros("scan_end_utc").alias("end_us")
    )


@query(
    "s12_resumable_ingest",
    "SELECT event_type, count(*) AS stored, max(event_id) AS last_event FROM events WHERE value >= 0 AND user_id IS NOT NULL GROUP BY ALL",
)
def resumable_ingest(spark, folder):
    from tallyweave.streaming.ingest import resumable_ingest as run

    schema = T.table(spark, folder, "events").schema
    rules = {"value_non_negative": F.col("value") >= 0, "user_present": F.col("user_id").isNotNull()}
    store = scratch(spark, "ingest")
    paths = run(spark, folder, schema, store, rules, ["event_id"], fmt="parquet", glob="events.parquet")
    run(spark, folder, schema, store, rules, ["event_id"], fmt="parquet", glob="events.parquet")  # nothing new to do
    return spark.read.parquet(paths["accepted"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("stored"), F.max("event_id").alias("last_event"))


@query(
    "s12_weekly_action_stream",
    """WITH w AS (SELECT epoch_us(ts) // 604800000000 AS wk, event_id % 2 AS chain_id, event_type AS action FROM events)
SELECT CAST(make_timestamp(wk * 604800000000) AS VARCHAR)[1:10] AS week_start, chain_id, action, count(*) AS event_count FROM w GROUP BY ALL""",
)
def weekly_action_stream(spark, folder):
    from tallyweave.streaming.ingest import close_panel, run_to_table, weekly_action_counts

    schema = T.table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    shape = [
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 2).alias("chain_id"),
        F.col("event_type").alias("action"),
        F.call_function("div", F.col("event_id"), F.lit(3)).alias("tx_hash"),
        F.col("event_id").alias("log_index"),
    ]
    path = run_to_table(weekly_action_counts(stream.select(*shape)), scratch(spark, "weekly"))
    closed = spark.read.schema("window_start timestamp, window_end timestamp, chain_id bigint, action string, event_count bigint").parquet(path)
    panel = close_panel(closed, T.table(spark, folder, "events").select(*shape))
    return panel.select(F.to_date("window_start").cast("string").alias("week_start"), "chain_id", "action", "event_count")


@query(
    "s13_sink_round_trip",
    f"WITH {SRC} SELECT action, count(*) AS row_count, CAST(sum(cents) AS BIGINT) AS cents FROM src GROUP BY ALL",
)
def sink_round_trip(spark, folder):
    rows = T.address_actions(spark, folder).select("block_number", "tx_hash", "action", "amount_raw")
    path = sinks.write_table(rows, scratch(spark, "sink"), ["block_number"], fmt="csv", compression="gzip")
    back = spark.read.schema(rows.schema).option("header", True).csv(path)
    cents = F.call_function("div", F.col("amount_raw").cast("bigint"), F.lit(10**12))
    return back.groupBy("action").agg(F.count(F.lit(1)).alias("row_count"), F.sum(cents).alias("cents"))


ROW_TEXT = "concat_ws('|', 'event_id=' || CAST(event_id AS VARCHAR), 'event_type=' || event_type, 'user_id=' || CAST(user_id AS VARCHAR))"
SLICE_SUMS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS HUGEINT)) AS VARCHAR) AS d{i}" for i in range(4))


@query(
    "s14_dataset_fingerprint",
    f"""WITH h AS (SELECT event_type, sha256({ROW_TEXT}) AS h FROM events), g AS (SELECT event_type, count(*) AS row_count, {SLICE_SUMS} FROM h GROUP BY ALL)
SELECT event_type, row_count, sha256(concat_ws(':', CAST(row_count AS VARCHAR), d0, d1, d2, d3)) AS fingerprint FROM g""",
)
def dataset_fingerprint(spark, folder):
    df = T.table(spark, folder, "events")
    return fingerprint.dataset_fingerprint(df, ["event_type"], ["event_id", "user_id", "event_type"])


@query(
    "s15_run_summary",
    """SELECT count(*) AS row_count, count(DISTINCT user_id) AS user_count, count(DISTINCT event_type) AS action_count, count(*) FILTER (value > 50) AS large_count FROM events""",
)
def run_summary(spark, folder):
    df = T.table(spark, folder, "events")
    return fingerprint.run_summary(df, {"user_count": "user_id", "action_count": "event_type"}, {"large_count": F.col("value") > 50})


@query(
    "s16_attach_timestamps",
    f"WITH {SRC} SELECT event_id AS block_number, epoch_us(ts) AS block_us FROM src",
)
def attach_timestamps(spark, folder):
    out = logs.attach_timestamps(logs.canonicalize_logs(T.raw_logs(spark, folder)), T.headers(spark, folder))
    return out.select("block_number", F.unix_micros(F.col("block_timestamp").cast("timestamp")).alias("block_us"))
