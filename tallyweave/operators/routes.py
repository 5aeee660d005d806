"""Message pairing across chains, the route-event gate and weekly route metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import uint256
from tallyweave.functions.columns import all_present, both, exact_integer_text, integer_kind, is_nonnegative_integer_text, present
from tallyweave.operators.contracts import ContractError, duplicate_keys, require_columns
from tallyweave.operators.sizing import attach, small_side, with_scalar
from tallyweave.session import cut
from tallyweave.sources.fingerprint import SLICES, digest_slices, row_text

# Required provenance of a route event and columns of a paired message
ROUTE_COLUMNS = (
    "route_id", "protocol", "source_chain_id", "destination_chain_id", "source_token_pool", "destination_token_pool",
    "source_router", "destination_router", "lane_activation_tx", "lane_activation_block", "message_id", "source_tx_hash",
    "source_log_index", "destination_tx_hash", "destination_log_index", "amount_wei", "capacity_wei", "source_url",
    "verification_status",
)
ROUTE_INTEGERS = ("source_chain_id", "destination_chain_id", "source_log_index", "destination_log_index", "lane_activation_block")
METRIC_COLUMNS = (
    "week", "message_id", "source_chain", "destination_chain", "route_id", "amount_wei", "local_activity_wei",
    "source_tx_hash", "destination_tx_hash", "verification_status",
)
LEAD = 38  # leading digits of local activity that a decimal holds
TASK_KEYS = 1_000_000  # keys of route events that one task counts


def pair_messages(source: DataFrame, destination: DataFrame, key: str = "message_id") -> tuple[DataFrame, DataFrame]:
    """Source events with their destination, and a one-row audit.

    An id seen twice at the destination pairs nothing; :func:`duplicate_ids` lists such ids. Each side
    is read once: arrivals are counted and digested per id, the sources are written with what they
    met, and the audit sums up these two tables. Its fingerprints are those of
    ``dataset_fingerprint`` of the source, the destination and the pairs.
    """
    arrivals = cut(destination.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.first("tx_hash").alias("destination_tx_hash"),
        F.first("log_index").alias("destination_log_index"),
        F.first("block_number").alias("destination_block"),
        *digest_slices(row_text(destination.columns), "_d"),
    ))
    known = ["destination_tx_hash", "destination_log_index", "destination_block"]
    single = arrivals.where(present(key) & (F.col("_n") == 1)).select(key, *known, F.lit(True).alias("_met"))
    matched = cut(source.join(single, key, "left"))
    met = F.coalesce(F.col("_met"), F.lit(False))
    paired = matched.where(met).drop("_met")
    sources = matched.agg(
        F.count(F.lit(1)).alias("source_event_count"), F.count_if(met).alias("paired_event_count"), F.count_if(present(key) & ~met).alias("unmatched_source_count"),
        *digest_slices(row_text(source.columns), "_s"), *digest_slices(F.when(met, row_text(paired.columns)), "_p"),
    )
    slices = [F.coalesce(F.sum(f"_d{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"_d{i}") for i in range(SLICES)]
    targets = arrivals.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("destination_event_count"), F.count_if(present(key) & (F.col("_n") > 1)).alias("duplicate_destination_id_count"), *slices
    )

    def fingerprint(count: str, prefix: str) -> Column:
        return F.sha2(F.concat_ws(":", F.col(count).cast("string"), *[F.col(f"{prefix}{i}").cast("string") for i in range(SLICES)]), 256)

    audit = with_scalar(sources, targets).select(
        "source_event_count", "destination_event_count", "paired_event_count", "unmatched_source_count", "duplicate_destination_id_count",
        fingerprint("source_event_count", "_s").alias("source_fingerprint"), fingerprint("destination_event_count", "_d").alias("destination_fingerprint"),
        fingerprint("paired_event_count", "_p").alias("paired_fingerprint"), F.lit(False).alias("bridge_route_gate_passed"),
    )
    return paired, audit


def duplicate_ids(destination: DataFrame, key: str = "message_id") -> DataFrame:
    """Ids that arrive more than once, with how often."""
    return destination.where(present(key)).groupBy(key).agg(F.count(F.lit(1)).alias("arrivals")).where("arrivals > 1")


def route_gate(df: DataFrame, strict: bool = True) -> DataFrame:
    """One-row verdict over route events; it fails closed with a reason.

    Repeated source keys, destination keys or message ids are refused outright when the
    provenance is otherwise complete. Keys are counted by their 64-bit hash in tasks whose number
    follows the rows; the keys of hashes that repeat are counted themselves.
    """
    require_columns(df, ROUTE_COLUMNS, "route events")
    kinds = dict(df.dtypes)

    def integer(c: str, positive: bool = False) -> Column:
        """Exact non-negative (or positive) integers of the column's own type: signed text, whole doubles and decimals."""
        return is_nonnegative_integer_text(exact_integer_text(c, integer_kind(kinds[c])), positive)

    numeric = both([integer(c) for c in (*ROUTE_INTEGERS, "capacity_wei")]) & integer("lane_activation_block", True) & integer("amount_wei", True)
    complete = all_present(list(ROUTE_COLUMNS)) & numeric & (F.col("verification_status") == "onchain_verified")
    keys = {
        "source_keys": ["source_chain_id", "source_tx_hash", "source_log_index"],
        "destination_keys": ["destination_chain_id", "destination_tx_hash", "destination_log_index"],
        "message_ids": ["message_id"],
    }
    names = list(keys)
    routes = df.groupBy(F.col("route_id").cast("string").alias("_route")).agg(F.count(F.lit(1)).alias("n"), F.count_if(complete).alias("whole"))
    verdict = cut(routes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("event_rows"), F.coalesce(F.sum("whole"), F.lit(0)).alias("verified_rows"), F.count("_route").alias("verified_route_count")
    ))
    # nearly all keys differ, so they are dealt out by a hash before they are counted, to tasks of bounded size
    tasks = max(1, -(-verdict.first().event_rows * len(names) // TASK_KEYS))
    hashed = [F.struct(F.lit(i).alias("kind"), F.xxhash64(*keys[name]).alias("hash")) for i, name in enumerate(names)]
    counted = df.select(F.explode(F.array(*hashed)).alias("_f")).select("_f.*").repartition(tasks, "kind", "hash").groupBy("kind", "hash").agg(F.count(F.lit(1)).alias("n"))
    again = cut(counted.where("n > 1").select("kind", "hash"))
    repeats = again
    if again.limit(1).count():
        # hashes that repeat: their keys themselves are counted, as two keys can share a hash
        spelled = [F.struct(F.lit(i).alias("kind"), F.xxhash64(*keys[name]).alias("hash"), F.to_json(F.struct(*keys[name])).alias("value")) for i, name in enumerate(names)]
        found = df.select(F.explode(F.array(*spelled)).alias("_f")).select("_f.*").join(small_side(again), ["kind", "hash"], "left_semi")
        repeats = found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    verdict = with_scalar(verdict, repeats.agg(*[F.count_if(F.col("kind") == i).alias(f"duplicate_{name}") for i, name in enumerate(names)]))
    all_verified = F.col("verified_rows") == F.col("event_rows")
    repeated = sum((F.col(f"duplicate_{name}") for name in keys), F.lit(0)) > 0
    reason = (
        F.when(F.col("event_rows") == 0, F.lit("no_message_level_route_events"))
        .when(~all_verified, F.lit("incomplete_message_or_contract_provenance"))
        .when(repeated, F.lit("duplicate_route_keys"))
        .when(F.col("verified_route_count") < 2, F.lit("fewer_than_two_independently_identified_routes"))
    )
    out = verdict.withColumn("withheld_reason", reason)
    if strict:
        out = cut(out)  # the check and the caller read the one row that is written here
        row = out.first()
        if row.withheld_reason == "duplicate_route_keys":
            raise ContractError("route events repeat a source key, destination key or message id")
    passed = F.col("withheld_reason").isNull()
    return out.withColumns(
        {
            "status": F.when(passed, F.lit("verified_message_level_routes")).otherwise(F.lit("withheld")),
            "bridge_route_gate_passed": passed,
            "infrastructure_dependence_result_produced": F.lit(False),
            "causal_estimate_produced": F.lit(False),
        }
    )


def route_metrics(messages: DataFrame, by: list[str] = ["week"], strict: bool = True) -> DataFrame:
    """Weekly route concentration, source dominance, reliance and removal loss.

    Amounts are added exactly as 256-bit integers, by route and by source, and become doubles
    only as shares. Local activity is the largest value reported in the week.
    """
    require_columns(messages, [c for c in METRIC_COLUMNS if c != "week"] + by, "route messages")
    rows = messages
    if strict:
        # ids are counted by their hash; only ids of hashes that repeat are counted themselves
        hashed = messages.select(F.xxhash64("message_id").alias("_hash"), "message_id")
        again = cut(duplicate_keys(hashed, ["_hash"]).select("_hash"))
        if again.limit(1).count() and duplicate_keys(hashed.join(small_side(again), "_hash", "left_semi"), ["message_id"]).limit(1).count():
            raise ContractError("repeated message_id")
        good = (
            (F.col("verification_status") == "onchain_verified_paired")
            & is_nonnegative_integer_text("amount_wei", positive=True)
            & is_nonnegative_integer_text("local_activity_wei")
        )
        bad = F.raise_error(F.concat(F.lit("unverified or malformed message "), F.col("message_id").cast("string")))
        rows = messages.withColumn("amount_wei", F.when(F.coalesce(good, F.lit(False)), F.col("amount_wei")).otherwise(bad))
    local = F.regexp_replace("local_activity_wei", "^0+(?=.)", "")
    wide = F.raise_error(F.concat(F.lit("local activity beyond 256 bits: "), local))
    digits = F.when(F.length(local) > 78, wide).otherwise(local)
    # a text can't be the maximum of a hash aggregate, so rows would be sorted: numbers go by length and leading digits
    rows = rows.withColumns({"_digits": digits, "_length": F.length(digits), "_lead": F.substring(digits, 1, LEAD).cast(f"decimal({LEAD},0)")})
    cells = cut(rows.groupBy(*by, "route_id", "source_chain", "_length").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_lead").alias("_lead"), *uint256.sum_parts("amount_wei", "_p")
    ))
    longest = cells.groupBy(*by).agg(F.max(F.when(F.col("_length").isNotNull(), F.struct("_length", "_lead"))).alias("_top"))
    if cells.where(F.col("_length") > LEAD).limit(1).count():
        text = rows.where(F.col("_length") > LEAD).groupBy(*by).agg(F.max(F.lpad("_digits", 78, "0")).alias("_long"))
        longest = attach(longest, text, by, "left")
    else:
        longest = longest.withColumn("_long", F.lit(None).cast("string"))
    longest = longest.select(*by, F.coalesce("_long", F.col("_top._lead").cast("string")).alias("_local"))

    def flows(key: str) -> DataFrame:
        part = cells.groupBy(*by, key).agg(*uint256.merge_parts("_p"))
        return part.select(*by, key, uint256.parts_double("_p").alias("_f"))

    week = cells.groupBy(*by).agg(
        F.sum("_n").cast("bigint").alias("paired_message_count"), *uint256.merge_parts("_p")
    ).withColumns({"_cross": uint256.parts_double("_p"), "cross_chain_flow_wei": uint256.render_sum("_p")}).drop(*uint256.part_names("_p"))
    week = attach(week, longest, by)
    f = F.col("_f")
    routes = flows("route_id").groupBy(*by).agg(
        F.count(F.lit(1)).alias("verified_route_count"),
        (F.sum(f * f) / (F.sum(f) * F.sum(f))).alias("route_hhi"),
        (F.max(f) / F.sum(f)).alias("largest_route_removal_loss"),
    )
    sources = flows("source_chain").groupBy(*by).agg((F.max(f) / F.sum(f)).alias("dominant_source_share"))
    local = F.col("_local").cast("double")
    n = F.col("verified_route_count").cast("double")
    out = week.join(routes, by).join(sources, by)
    return out.select(
        *by,
        "paired_message_count",
        "verified_route_count",
        "cross_chain_flow_wei",
        F.regexp_replace("_local", "^0+(?=.)", "").alias("local_activity_wei"),
        F.when(F.col("_cross") + local > 0, F.col("_cross") / (F.col("_cross") + local)).alias("bridge_reliance"),
        "route_hhi",
        F.when(n > 1, (F.col("route_hhi") - 1 / n) / (F.lit(1.0) - 1 / n)).otherwise(F.lit(1.0)).alias("normalized_route_hhi"),
        "dominant_source_share",
        "largest_route_removal_loss",
    )


def route_metrics_gate(messages: DataFrame) -> DataFrame:
    out = messages.agg(F.count(F.lit(1)).alias("paired_message_count"), F.count_distinct("route_id").alias("verified_route_count"))
    passed = F.col("verified_route_count") >= 2
    reason = (
        F.when(F.col("paired_message_count") == 0, F.lit("no_paired_messages"))
        .when(passed, F.lit("passed"))
        .otherwise(F.lit("fewer_than_two_verified_routes"))
    )
    return out.withColumns({"gate_passed": passed, "reason": reason})

