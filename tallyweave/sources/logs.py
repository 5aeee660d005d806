"""Raw event logs: schema, validation, decoding, canonical order, coverage of block ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.columns import hex_to_long, is_hex
from tallyweave.functions.uint256 import hex_word_to_decimal
from tallyweave.operators.contracts import reject_rows
from tallyweave.session import shuffle_width

RAW_LOG = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("data", T.StringType()),
        T.StructField("blockHash", T.StringType()),
        T.StructField("blockNumber", T.StringType()),
        T.StructField("transactionHash", T.StringType()),
        T.StructField("transactionIndex", T.StringType()),
        T.StructField("logIndex", T.StringType()),
        T.StructField("removed", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class EventSpec:
    """An event: its topic, typed words and the action column each word fills."""

    action: str
    family: str
    signature: str
    topic0: str
    indexed: tuple[tuple[str, str], ...]  # (output column, ABI type), topics 1..n
    data: tuple[tuple[str, str], ...]
    beneficiary_topic: int


# Public event signatures and topics of the decoded actions, and the action
# column that each of their words fills. A withdrawal's user is actor and beneficiary.
EVENT_SPECS = (
    EventSpec(
        "supply",
        "Supply",
        "Supply(address,address,address,uint256,uint16)",
        "0x2b627736bca15cd5381dcf80b0bf11fd197d01a037c52b927a881a10fb73ba61",
        (("reserve_address", "address"), ("beneficiary_address", "address"), ("referral_code", "uint16")),
        (("actor_address", "address"), ("amount_raw", "uint256")),
        2,
    ),
    EventSpec(
        "withdraw",
        "Withdraw",
        "Withdraw(address,address,address,uint256)",
        "0x3115d1449a7b732c986cba18244e897a450f61e1bb8d589cd2e69e6c8924f9f7",
        (("reserve_address", "address"), ("beneficiary_address", "address"), ("counterparty_address", "address")),
        (("amount_raw", "uint256"),),
        2,
    ),
    EventSpec(
        "borrow",
        "Borrow",
        "Borrow(address,address,address,uint256,uint8,uint256,uint16)",
        "0xb3d084820fb1a9decffb176436bd02558d15fac9b0ddfed8c465bc7359d7dce0",
        (("reserve_address", "address"), ("beneficiary_address", "address"), ("referral_code", "uint16")),
        (("actor_address", "address"), ("amount_raw", "uint256"), ("interest_rate_mode", "uint8"), ("borrow_rate_ray", "uint256")),
        2,
    ),
    EventSpec(
        "repay",
        "Repay",
        "Repay(address,address,address,uint256,bool)",
        "0xa534c8dbe71f871f9f3530e97a74601fea17b426cae02e1c5aee42c96c784051",
        (("reserve_address", "address"), ("beneficiary_address", "address"), ("actor_address", "address")),
        (("amount_raw", "uint256"), ("use_a_tokens", "bool")),
        2,
    ),
    EventSpec(
        "liquidation",
        "LiquidationCall",
        "LiquidationCall(address,address,address,uint256,uint256,address,bool)",
        "0xe413a321e8681d831f4dbccbca790d2952b56f977908e45be37335533e005286",
        (("secondary_reserve_address", "address"), ("reserve_address", "address"), ("beneficiary_address", "address")),
        (("amount_raw", "uint256"), ("secondary_amount_raw", "uint256"), ("actor_address", "address"), ("receive_a_token", "bool")),
        3,
    ),
)

ACTION_FIELDS = {
    "reserve_address": "address",
    "secondary_reserve_address": "address",
    "actor_address": "address",
    "beneficiary_address": "address",
    "counterparty_address": "address",
    "amount_raw": "uint256",
    "secondary_amount_raw": "uint256",
    "referral_code": "uint16",
    "interest_rate_mode": "uint8",
    "borrow_rate_ray": "uint256",
    "use_a_tokens": "bool",
    "receive_a_token": "bool",
}

_ZERO_DIGITS = {"address": 24, "uint256": 0, "uint16": 60, "uint8": 62, "bool": 63}  # leading zeros of a word


def _in_domain(word: Column, kind: str) -> Column:
    """Range check of a hexadecimal word by its leading zeros."""
    zeros = _ZERO_DIGITS[kind]
    fits = word.startswith("0" * zeros) if zeros else F.lit(True)
    return fits & F.substring(word, 64, 1).isin("0", "1") if kind == "bool" else fits


def read_raw_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines chunks, compressed or not. A gzip chunk is one task, so chunks are the unit
    of parallelism; the caller repartitions once if chunks are few and large."""
    return spark.read.schema(RAW_LOG).option("mode", "FAILFAST").json(path)


def canonicalize_logs(logs: DataFrame) -> DataFrame:
    """Lower-case hexadecimal fields and numeric positions, in one projection."""
    return logs.withColumns(
        {
            "address": F.lower("address"),
            "blockHash": F.lower("blockHash"),
            "transactionHash": F.lower("transactionHash"),
            "data": F.lower("data"),
            "topics": F.transform("topics", lambda t: F.lower(t)),
            "block_number": hex_to_long("blockNumber"),
            "tx_index": hex_to_long(F.coalesce("transactionIndex", F.lit("0x0"))),
            "log_index": hex_to_long("logIndex"),
        }
    )


def in_log_order(logs: DataFrame) -> DataFrame:
    """Range-partitioned and sorted by (block, transaction, log), for sinks."""
    order = ["block_number", "tx_index", "log_index"]
    return logs.repartitionByRange(shuffle_width(logs.sparkSession), *order).sortWithinPartitions(*order)


def _topic_word(i: int) -> Column:
    return F.substring(F.try_element_at("topics", F.lit(i + 2)), 3, 64)


def _data_word(i: int) -> Column:
    return F.substring("data", 3 + 64 * i, 64)


def _with_spec(logs: DataFrame, specs: tuple[EventSpec, ...]) -> DataFrame:
    """Add ``topic0`` and the index of its spec, so later branches compare a small integer."""
    base = logs.withColumn("topic0", F.try_element_at("topics", F.lit(1)))
    index = F.lit(-1)
    for i, spec in enumerate(specs):
        index = F.when(F.col("topic0") == spec.topic0, F.lit(i)).otherwise(index)
    return base.withColumn("_spec", index)


def _is(spec: EventSpec, specs: tuple[EventSpec, ...]) -> Column:
    return F.col("_spec") == specs.index(spec)


def _decode(word: Column, kind: str) -> Column:
    if kind == "address":
        return F.concat(F.lit("0x"), F.substring(word, 25, 40))
    if kind == "uint256":
        return F.when(word.isNotNull(), hex_word_to_decimal(word))
    if kind == "bool":
        return F.substring(word, 64, 1) == "1"
    return F.conv(F.substring(word, 57, 8), 16, 10).cast("int")


def log_rules(specs: tuple[EventSpec, ...] = EVENT_SPECS) -> dict[str, Column]:
    """Row predicates a canonical log must satisfy to be decoded."""
    n_topics, known = F.size("topics"), F.lit(False)
    arity, words, domain = F.lit(False), F.lit(False), F.lit(False)
    for spec in specs:
        mine = _is(spec, specs)
        known = known | mine
        arity = arity | (mine & (n_topics == len(spec.indexed) + 1))
        words = words | (mine & (F.length("data") == 2 + 64 * len(spec.data)))
        valid = mine
        for i, (_, kind) in enumerate(spec.indexed):
            valid = valid & _in_domain(_topic_word(i), kind)
        for i, (_, kind) in enumerate(spec.data):
            valid = valid & _in_domain(_data_word(i), kind)
        domain = domain | (valid & (F.length("data") >= 2 + 64 * len(spec.data)))
    shape = F.array_join("topics", "").rlike("^(0x[0-9a-f]{64})*$")
    hexadecimal = F.col("data").rlike("^0x[0-9a-f]*$")
    return {
        "has_topics": n_topics > 0,
        "known_topic": known,
        "topic_count": arity,
        "topic_shape": shape,
        "data_prefix": F.col("data").startswith("0x"),
        "data_aligned": (F.length("data") - 2) % 64 == 0,
        "data_word_count": words,
        "word_domain": domain & hexadecimal,
        "position_numeric": F.col("block_number").isNotNull() & F.col("log_index").isNotNull() & F.col("tx_index").isNotNull(),
    }


def _by_spec(values: list, index: str) -> Column:
    """The value of the event whose index a column holds, null for none."""
    kind = "int" if any(isinstance(v, int) for v in values) else "string"
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col(index))


def _start(spec: EventSpec, name: str) -> int | None:
    """Place of a field's word in the joined topics and data of an event."""
    for i, (target, _) in enumerate(spec.indexed):
        if target == name:
            return 66 * (i + 1) + 3
    for i, (target, _) in enumerate(spec.data):
        if target == name:
            return 66 * (len(spec.indexed) + 1) + 3 + 64 * i
    if name == "actor_address":  # a withdrawal names one user for both roles
        return 66 * spec.beneficiary_topic + 3
    return None


def decode_logs(
    logs: DataFrame, chain_id: int | Column, pool_address: str | None = None, specs: tuple[EventSpec, ...] = EVENT_SPECS, strict: bool = True
) -> DataFrame:
    """Logs to the 22 action columns; blanks of the row format are nulls.

    Word selection and decoding are column expressions, so decoding adds no shuffle and no
    Python. With ``strict`` the job fails at the first undecodable log; otherwise each row
    carries ``failed_rules`` and :func:`tallyweave.operators.contracts.split_valid` parts them.
    """
    base = _with_spec(canonicalize_logs(logs), specs)
    tagged = reject_rows(base, log_rules(specs))
    # topics and data in one text: a field's word starts at a place that depends on the event alone
    placed = tagged.withColumns(
        {"_flat": F.concat(F.array_join("topics", ""), "data"), "_good": F.when(F.size("failed_rules") == 0, F.col("_spec"))}
    )
    picked = placed.withColumns(
        {f"_w_{name}": F.substr(F.col("_flat"), _by_spec([_start(spec, name) for spec in specs], "_good"), F.lit(64)) for name in ACTION_FIELDS}
    )
    action, signature = _by_spec([s.action for s in specs], "_spec"), _by_spec([s.signature for s in specs], "_spec")
    chain = chain_id if isinstance(chain_id, Column) else F.lit(chain_id).cast("bigint")
    out = picked.select(
        chain.alias("chain_id"),
        (F.lit(pool_address.lower()) if pool_address else F.col("address")).alias("pool_address"),
        action.alias("action"),
        signature.alias("event_signature"),
        "topic0",
        "block_number",
        F.col("blockHash").alias("block_hash"),
        F.col("transactionHash").alias("tx_hash"),
        "tx_index",
        "log_index",
        *[_decode(F.col(f"_w_{name}"), kind).alias(name) for name, kind in ACTION_FIELDS.items()],
        "failed_rules",
    )
    if not strict:
        return out
    message = F.concat(F.lit("undecodable log "), F.coalesce("tx_hash", F.lit("?")), F.lit(": "), F.array_join("failed_rules", ","))
    checked = F.when(F.size("failed_rules") == 0, F.col("action")).otherwise(F.raise_error(message))
    return out.withColumn("action", checked).drop("failed_rules")


def decode_beneficiaries(logs: DataFrame, specs: tuple[EventSpec, ...] = EVENT_SPECS) -> DataFrame:
    """Event family and beneficiary only, read from one indexed topic; zero address rejected."""
    base = _with_spec(canonicalize_logs(logs), specs)
    family, topic = F.lit(None).cast("string"), F.lit(None).cast("string")
    for spec in specs:
        enough = _is(spec, specs) & (F.size("topics") > spec.beneficiary_topic)
        family = F.when(_is(spec, specs), F.lit(spec.family)).otherwise(family)
        topic = F.when(enough, F.try_element_at("topics", F.lit(spec.beneficiary_topic + 1))).otherwise(topic)
    base = base.withColumns({"event_family": family, "_topic": topic})
    address = F.concat(F.lit("0x"), F.substring("_topic", 27, 40))
    rules = {
        "known_topic": F.col("event_family").isNotNull(),
        "topic_shape": is_hex("_topic", 32),
        "nonzero_beneficiary": ~F.col("_topic").endswith("0" * 40),
    }
    tagged = reject_rows(base, rules)
    return tagged.select(
        F.col("address").alias("pool_address"),
        "block_number",
        F.col("transactionHash").alias("transaction_hash"),
        "log_index",
        "event_family",
        F.when(F.size("failed_rules") == 0, address).alias("beneficiary_address"),
        "failed_rules",
    )


def batch_rules(contract: str, topics: list[str], first_block: int, last_block: int, require_removed: bool = False) -> dict[str, Column]:
    """Rules of a fetched batch of canonical logs."""
    removed = F.coalesce(F.col("removed"), F.lit(require_removed))
    return {
        "block_in_range": F.col("block_number").between(first_block, last_block),
        "expected_contract": F.col("address") == contract.lower(),
        "allowed_topic": F.try_element_at("topics", F.lit(1)).isin(*[t.lower() for t in topics]),
        "not_removed": ~removed,
    }


def decode_messages(logs: DataFrame, chain_id: int, topic_index: int) -> DataFrame:
    """Message events: the id is an indexed topic, everything else is position."""
    if topic_index < 1:
        raise ValueError("the message id must be an indexed topic")
    base = canonicalize_logs(logs)
    present = F.size("topics") > topic_index
    base = base.withColumn("message_id", F.when(present, F.try_element_at("topics", F.lit(topic_index + 1))))
    rules = {
        "message_topic_present": present,
        "message_id_shape": is_hex("message_id", 32),
        "contract_shape": is_hex("address", 20),
        "not_removed": F.col("removed") == F.lit(False),
    }
    return reject_rows(base, rules).select(
        F.lit(chain_id).cast("bigint").alias("chain_id"),
        F.col("address").alias("contract_address"),
        "message_id",
        F.col("transactionHash").alias("tx_hash"),
        F.col("blockHash").alias("block_hash"),
        "block_number",
        F.col("tx_index").alias("transaction_index"),
        "log_index",
        "failed_rules",
    )


def attach_timestamps(logs: DataFrame, headers: DataFrame, strict: bool = True) -> DataFrame:
    """Block time of each log by an equi-join to the header table; a missing header is an error.

    A block with several headers fails if they disagree; equal repeats count as one.
    """
    stamp = F.col("timestamp")
    two = F.raise_error(F.concat(F.lit("different headers of block "), F.col("block_number").cast("string")))
    times = headers.groupBy("block_number").agg(F.min(stamp).alias("_lo"), F.max(stamp).alias("_hi"))
    one = F.when(F.col("_lo").eqNullSafe(F.col("_hi")), F.col("_lo")).otherwise(two.cast(headers.schema["timestamp"].dataType))
    times = times.select("block_number", one.alias("block_timestamp"))
    joined = logs.join(times, "block_number", "left")
    if not strict:
        return joined
    kind = times.schema["block_timestamp"].dataType
    missing = F.raise_error(F.concat(F.lit("missing block header "), F.col("block_number").cast("string")))
    return joined.withColumn("block_timestamp", F.coalesce("block_timestamp", missing.cast(kind)))


def build_chunks(ranges: DataFrame, width: int) -> DataFrame:
    """Contiguous inclusive block chunks for each row of ``first_block, last_block``."""
    if width < 1:
        raise ValueError("width must be positive")
    start = F.explode(F.sequence("first_block", "last_block", F.lit(width).cast("bigint")))
    chunks = ranges.where("first_block >= 0 AND last_block >= first_block").withColumn("from_block", start)
    return chunks.withColumn("to_block", F.least(F.col("from_block") + (width - 1), F.col("last_block")))


def shard_windows(windows: DataFrame, count: int, start: str = "scan_start_utc", end: str = "scan_end_utc") -> DataFrame:
    """Equal time shards of each scan window."""
    shards = windows.withColumn("shard_index", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    begin, stop = F.unix_micros(F.col(start).cast("timestamp")), F.unix_micros(F.col(end).cast("timestamp"))

    def at(i: Column) -> Column:
        return F.timestamp_micros(begin + F.call_function("div", (stop - begin) * i, F.lit(count).cast("bigint")))

    return shards.withColumns(
        {start: at(F.col("shard_index").cast("bigint")), end: at((F.col("shard_index") + 1).cast("bigint")), "shard_count": F.lit(count)}
    )


def coverage_audit(chunks: DataFrame, by: list[str], first: str = "first_block", last: str = "last_block") -> DataFrame:
    """Whether the chunks of each scan cover its range once, without gap or overlap.

    A chunk needs a successor that starts one past its end unless it is the last; together
    with the summed width this excludes overlaps, and it is one equi-join instead of an
    ordered pass.
    """
    following = chunks.select(*by, (F.col("from_block") - 1).alias("to_block")).distinct().withColumn("_next", F.lit(True))
    joined = chunks.join(following, [*by, "to_block"], "left")
    out = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.count_if(F.col("_next").isNull() & (F.col("to_block") != F.col(last))).alias("gap_count"),
        F.sum(F.col("to_block") - F.col("from_block") + 1).alias("covered_blocks"),
        (F.min("from_block") == F.min(first)).alias("starts_at_first"),
        (F.max("to_block") == F.max(last)).alias("ends_at_last"),
        (F.max(last) - F.min(first) + 1).alias("required_blocks"),
    )
    complete = (
        (F.col("gap_count") == 0) & F.col("starts_at_first") & F.col("ends_at_last") & (F.col("covered_blocks") == F.col("required_blocks"))
    )
    return out.withColumn("continuous_inclusive_coverage", complete)


def encode_word(value: Column, kind: str) -> Column:
    """ABI word of an address text, boolean or non-negative bigint."""
    if kind == "address":
        return F.lpad(F.substring(value, 3, 40), 64, "0")
    if kind == "bool":
        return F.lpad(value.cast("int").cast("string"), 64, "0")
    return F.lpad(F.lower(F.hex(value.cast("bigint"))), 64, "0")


def encode_logs(rows: DataFrame, specs: tuple[EventSpec, ...] = EVENT_SPECS) -> DataFrame:
    """Action rows back to raw logs, the inverse of :func:`decode_logs` for bigint amounts."""
    topics, data = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for spec in specs:
        mine = F.col("action") == spec.action
        words = [F.concat(F.lit("0x"), encode_word(F.col(name), kind)) for name, kind in spec.indexed]
        topics = F.when(mine, F.array(F.lit(spec.topic0), *words)).otherwise(topics)
        payload = F.concat(F.lit("0x"), *[encode_word(F.col(name), kind) for name, kind in spec.data])
        data = F.when(mine, payload).otherwise(data)

    def quantity(c: str) -> Column:
        return F.concat(F.lit("0x"), F.lower(F.hex(F.col(c))))

    return rows.select(
        F.col("pool_address").alias("address"),
        topics.alias("topics"),
        data.alias("data"),
        F.col("block_hash").alias("blockHash"),
        quantity("block_number").alias("blockNumber"),
        F.col("tx_hash").alias("transactionHash"),
        quantity("tx_index").alias("transactionIndex"),
        quantity("log_index").alias("logIndex"),
        F.lit(False).alias("removed"),
    )
