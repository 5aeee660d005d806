"""Contracts, gates, table comparison, ordering and calendar queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.catalog.registry import ACTIONS, ORDER_ACTIONS, SUPPLY_EDGES, query, r, rounded
from tallyweave.functions import columns as X
from tallyweave.operators import calendars as K
from tallyweave.operators import contracts as Q
from tallyweave.operators import diff as D
from tallyweave.operators import ordering as O
from tallyweave.operators import panels as P
from tallyweave.operators.routes import pair_messages, route_gate, route_metrics, route_metrics_gate
from tallyweave.operators.sizing import with_scalar
from tallyweave.session import cut
from tallyweave.sources import tables as T
from tallyweave.sources import transfers as TR


@query(
    "q01_q03_action_contract",
    f"""WITH {ACTIONS}, c AS (SELECT count(*) FILTER (actor_address IS NULL) AS a, count(*) FILTER (beneficiary_address IS NULL) AS b, count(*) FILTER (action NOT IN ('click', 'error', 'purchase', 'signup', 'view')) AS d,
  CAST(NOT (min(event_week) = -14 AND max(event_week) = 15) AS INT) AS s, count(*) FILTER (chain_id <> 0) AS ch FROM actions),
k AS (SELECT count(*) AS k FROM (SELECT tx_hash, log_index FROM actions GROUP BY ALL HAVING count(*) > 1))
SELECT check_name, CAST(violations AS BIGINT) AS violations, violations = 0 AS passed FROM (
 SELECT 'filled:actor_address' AS check_name, a AS violations FROM c UNION ALL SELECT 'filled:beneficiary_address', b FROM c UNION ALL SELECT 'domain:action', d FROM c
 UNION ALL SELECT 'domain:chain_id', ch FROM c UNION ALL SELECT 'span:event_week', s FROM c UNION ALL SELECT 'key:tx_hash,log_index', k FROM k)""",
)
def action_contract(spark, folder):
    return Q.audit(T.actions(spark, folder), Q.action_contract(tuple(T.ACTIONS), 0, T.FIRST_DAY, T.LAST_DAY))


@query(
    "q02_duplicate_keys",
    """SELECT 'line' AS key_name, count(*) AS distinct_keys, count(*) FILTER (c > 1) AS duplicate_keys, CAST(sum(c - 1) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL SELECT 'part_supplier', count(*), count(*) FILTER (c > 1), CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_partkey, l_suppkey)""",
)
def duplicate_keys(spark, folder):
    items = T.table(spark, folder, "lineitem")
    return Q.duplicate_audit(items, {"line": ["l_orderkey", "l_linenumber"], "part_supplier": ["l_partkey", "l_suppkey"]})


@query(
    "q04_exact_integers",
    """SELECT l_returnflag, count(*) FILTER (l_quantity = floor(l_quantity)) AS exact_quantity, count(*) FILTER (l_extendedprice = floor(l_extendedprice)) AS exact_price,
  count(*) FILTER (regexp_full_match(CAST(l_orderkey AS VARCHAR), '[+-]?\\d+')) AS exact_key, max('7' || lpad(CAST(l_orderkey AS VARCHAR), 39, '0')) AS largest_text FROM lineitem GROUP BY ALL""",
)
def exact_integers(spark, folder):
    items = T.table(spark, folder, "lineitem")
    return items.groupBy("l_returnflag").agg(
        F.count(X.exact_integer("l_quantity", "double")).alias("exact_quantity"),
        F.count(X.exact_integer("l_extendedprice", "double")).alias("exact_price"),
        F.count(X.exact_integer(F.col("l_orderkey").cast("string"), "text")).alias("exact_key"),
        F.max(X.exact_integer_text(F.concat(F.lit(" +007"), F.lpad(F.col("l_orderkey").cast("string"), 39, "0")))).alias("largest_text"),
    )


@query(
    "q05_presence",
    """SELECT source, count(*) AS documents, count(*) FILTER (trim(text, ' ') <> '' AND lang IS NOT NULL AND quality IS NOT NULL) AS complete FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
)
def presence(spark, folder):
    df = T.table(spark, folder, "documents").join(T.table(spark, folder, "labels"), "doc_id", "left")
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(X.all_present(["text", "lang", "quality"])).alias("complete"))


def numbered_items(spark, folder):
    """Line items with a message id: order key and position inside the order."""
    inside = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    items = T.table(spark, folder, "lineitem").withColumn("n", F.row_number().over(inside))
    return items.withColumn("message_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("n").cast("string")))


def route_events(spark, folder, unverified: str = ""):
    """Line items as route events over supplier lanes; one return flag may be unverified."""
    items = numbered_items(spark, folder)
    text = F.col("message_id")
    return items.select(
        F.concat(F.lit("lane"), (F.col("l_suppkey") % 5).cast("string")).alias("route_id"),
        F.lit("bridge").alias("protocol"),
        (F.col("l_suppkey") % 3).cast("string").alias("source_chain_id"),
        F.lit("9").alias("destination_chain_id"),
        F.lit("p1").alias("source_token_pool"),
        F.lit("p2").alias("destination_token_pool"),
        F.lit("r1").alias("source_router"),
        F.lit("r2").alias("destination_router"),
        F.lit("0xaa").alias("lane_activation_tx"),
        F.lit("7").alias("lane_activation_block"),
        text.alias("message_id"),
        F.concat(F.lit("s"), text).alias("source_tx_hash"),
        F.col("n").cast("string").alias("source_log_index"),
        F.concat(F.lit("d"), text).alias("destination_tx_hash"),
        F.col("n").cast("string").alias("destination_log_index"),
        F.concat(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), F.lit("0" * 16)).alias("amount_wei"),
        F.lit("0").alias("capacity_wei"),
        F.lit("https://example.org").alias("source_url"),
        F.when(F.col("l_returnflag") == unverified, F.lit("pending")).otherwise(F.lit("onchain_verified")).alias("verification_status"),
    )


@query(
    "q06_route_gate",
    """SELECT count(*) AS event_rows, count(*) AS verified_rows, count(DISTINCT l_suppkey % 5) AS verified_route_count, 'verified_message_level_routes' AS status, true AS bridge_route_gate_passed FROM lineitem""",
)
def route_event_gate(spark, folder):
    out = route_gate(route_events(spark, folder))
    return out.select("event_rows", "verified_rows", "verified_route_count", "status", "bridge_route_gate_passed")


@query(
    "q06_route_gate_closed",
    """SELECT count(*) AS event_rows, count(*) FILTER (l_returnflag <> 'R') AS verified_rows, 'withheld' AS status, 'incomplete_message_or_contract_provenance' AS withheld_reason, false AS bridge_route_gate_passed FROM lineitem""",
)
def route_event_gate_closed(spark, folder):
    out = route_gate(route_events(spark, folder, unverified="R"))
    return out.select("event_rows", "verified_rows", "status", "withheld_reason", "bridge_route_gate_passed")


ROUTES = """msgs AS (SELECT 'lane' || CAST(l_suppkey % 5 AS VARCHAR) AS route_id, CAST(l_suppkey % 3 AS VARCHAR) AS source_chain, CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS VARCHAR) AS week,
  CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS HUGEINT) * 10000000000000000 AS amount, CAST(CAST(round(l_quantity) AS BIGINT) AS HUGEINT) * 1000000000000000000000000 AS local FROM lineitem)"""


def route_messages(spark, folder):
    rows, text = numbered_items(spark, folder), F.col("message_id")
    return rows.select(
        F.to_date(F.date_trunc("month", "l_shipdate")).cast("string").alias("week"),
        text.alias("message_id"),
        (F.col("l_suppkey") % 3).cast("string").alias("source_chain"),
        F.lit("9").alias("destination_chain"),
        F.concat(F.lit("lane"), (F.col("l_suppkey") % 5).cast("string")).alias("route_id"),
        F.concat(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), F.lit("0" * 16)).alias("amount_wei"),
        F.concat(F.round("l_quantity").cast("bigint").cast("string"), F.lit("0" * 24)).alias("local_activity_wei"),
        F.concat(F.lit("s"), text).alias("source_tx_hash"),
        F.concat(F.lit("d"), text).alias("destination_tx_hash"),
        F.lit("onchain_verified_paired").alias("verification_status"),
    )


@query(
    "a19_route_metrics",
    f"""WITH {ROUTES}, rf AS (SELECT week, route_id, sum(amount) AS f FROM msgs GROUP BY ALL), sf AS (SELECT week, source_chain, sum(amount) AS f FROM msgs GROUP BY ALL),
w AS (SELECT week, count(*) AS n, sum(amount) AS c, max(local) AS l FROM msgs GROUP BY ALL),
rm AS (SELECT week, count(*) AS k, sum(CAST(f AS DOUBLE) * CAST(f AS DOUBLE)) / (sum(CAST(f AS DOUBLE)) * sum(CAST(f AS DOUBLE))) AS h, max(CAST(f AS DOUBLE)) / sum(CAST(f AS DOUBLE)) AS loss FROM rf GROUP BY ALL),
sm AS (SELECT week, max(CAST(f AS DOUBLE)) / sum(CAST(f AS DOUBLE)) AS dom FROM sf GROUP BY ALL)
SELECT week, n AS paired_message_count, k AS verified_route_count, CAST(c AS VARCHAR) AS cross_chain_flow_wei, CAST(l AS VARCHAR) AS local_activity_wei, {r('CAST(c AS DOUBLE) / (CAST(c AS DOUBLE) + CAST(l AS DOUBLE))')} AS bridge_reliance,
 {r('h')} AS route_hhi, {r('CASE WHEN k > 1 THEN (h - CAST(1 AS DOUBLE) / k) / (1 - CAST(1 AS DOUBLE) / k) ELSE 1 END')} AS normalized_route_hhi, {r('dom')} AS dominant_source_share, {r('loss')} AS largest_route_removal_loss
FROM w JOIN rm USING (week) JOIN sm USING (week)""",
)
def weekly_route_metrics(spark, folder):
    return rounded(route_metrics(route_messages(spark, folder)))


@query("a19_route_metrics_gate", "SELECT count(*) AS paired_message_count, count(DISTINCT l_suppkey % 5) AS verified_route_count, true AS gate_passed, 'passed' AS reason FROM lineitem")
def weekly_route_metrics_gate(spark, folder):
    return route_metrics_gate(route_messages(spark, folder))


@query(
    "j09_message_pairing",
    """WITH s AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), d AS (SELECT conv_id, turn - 1 AS turn FROM conversations WHERE role = 'assistant')
SELECT CAST(s.conv_id AS VARCHAR) || ':' || CAST(s.turn AS VARCHAR) AS message_id, s.turn + 1 AS destination_block FROM s JOIN d USING (conv_id, turn)
WHERE (SELECT count(*) FROM d x WHERE x.conv_id = s.conv_id AND x.turn = s.turn) = 1""",
)
def message_pairing(spark, folder):
    turns = T.table(spark, folder, "conversations")

    def side(role: str, shift: int):
        key = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - shift).cast("string"))
        return turns.where(F.col("role") == role).select(
            key.alias("message_id"), F.col("conv_id").cast("string").alias("tx_hash"), F.lit(0).alias("log_index"), F.col("turn").alias("block_number")
        )

    paired, _ = pair_messages(side("user", 0), side("assistant", 1))
    return paired.select("message_id", "destination_block")


@query(
    "j09_pairing_audit",
    """WITH s AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), d AS (SELECT conv_id, turn - 1 AS turn, count(*) AS c FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT (SELECT count(*) FROM s) AS source_event_count, (SELECT CAST(sum(c) AS BIGINT) FROM d) AS destination_event_count, (SELECT count(*) FROM s JOIN d USING (conv_id, turn) WHERE c = 1) AS paired_event_count,
 (SELECT count(*) FROM s) - (SELECT count(*) FROM s JOIN d USING (conv_id, turn) WHERE c = 1) AS unmatched_source_count, (SELECT count(*) FROM d WHERE c > 1) AS duplicate_destination_id_count""",
)
def pairing_audit(spark, folder):
    turns = T.table(spark, folder, "conversations")

    def side(role: str, shift: int):
        key = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - shift).cast("string"))
        return turns.where(F.col("role") == role).select(
            key.alias("message_id"), F.col("conv_id").cast("string").alias("tx_hash"), F.lit(0).alias("log_index"), F.col("turn").alias("block_number")
        )

    _, audit = pair_messages(side("user", 0), side("assistant", 1))
    return audit.select("source_event_count", "destination_event_count", "paired_event_count", "unmatched_source_count", "duplicate_destination_id_count")


@query(
    "q07_batch_rejects",
    """WITH t AS (SELECT concat_ws(',', CASE WHEN event_id NOT BETWEEN 100 AND (SELECT max(event_id) - 100 FROM events) THEN 'block_in_range' END, CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN 'allowed_topic' END, CASE WHEN event_id % 11 = 0 THEN 'not_removed' END) AS failed FROM events)
SELECT failed, count(*) AS logs FROM t GROUP BY ALL""",
)
def batch_rejects(spark, folder):
    from tallyweave.sources import logs as L

    raw = L.canonicalize_logs(T.raw_logs(spark, folder)).withColumn("removed", F.col("block_number") % 11 == 0)
    last = T.table(spark, folder, "events").agg(F.max("event_id")).first()[0]
    topics = [s.topic0 for s in L.EVENT_SPECS if s.action in ("supply", "withdraw", "liquidation")]
    out = Q.reject_rows(raw, L.batch_rules(T.POOL, topics, 100, last - 100))
    return out.groupBy(F.array_join("failed_rules", ",").alias("failed")).agg(F.count(F.lit(1)).alias("logs"))


def label_table(spark, folder):
    """Customers as curated labels; a few intervals and scopes are broken on purpose."""
    c = T.table(spark, folder, "customer")
    return c.select(
        F.col("c_custkey").alias("address"),
        F.lit("v1").alias("release_version"),
        F.lit(1).alias("chain_id"),
        ((F.col("c_acctbal") + 1000) / 12000).alias("confidence"),
        F.lit(10).alias("valid_from_block"),
        F.when(F.col("c_custkey") % 40 == 0, 5).otherwise(20).alias("valid_to_block"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("person")).otherwise(F.lit("economic_actor")).alias("entity_scope"),
        F.concat(F.when(F.col("c_nationkey") == 3, F.lit("http")).otherwise(F.lit("https")), F.lit("://example.org/")).alias("source_url"),
    )


@query(
    "q08_label_gate",
    """WITH c AS (SELECT count(*) FILTER (NOT ((c_acctbal + 1000) / 12000 BETWEEN 0 AND 1)) AS a, count(*) FILTER (c_custkey % 40 = 0) AS b, count(*) FILTER (c_mktsegment = 'MACHINERY') AS d, count(*) FILTER (c_nationkey = 3) AS e FROM customer)
SELECT check_name, violations, violations = 0 AS passed FROM (SELECT 'rule:confidence_in_unit_interval' AS check_name, a AS violations FROM c UNION ALL SELECT 'rule:interval_ordered', b FROM c UNION ALL SELECT 'rule:scope_allowed', d FROM c
 UNION ALL SELECT 'rule:https_source', e FROM c UNION ALL SELECT 'key:address', CAST(0 AS BIGINT))""",
)
def label_gate(spark, folder):
    return Q.audit(Q.select_release(label_table(spark, folder), "v1", 1), Q.label_contract())


@query(
    "q09_constraint_gate",
    """WITH k AS (SELECT c_custkey AS id, c_custkey AS l, CASE WHEN c_custkey % 9 = 0 THEN c_custkey ELSE c_custkey + 7 END AS rr, (c_acctbal + 1000) / 12000 AS conf FROM customer),
t AS (SELECT concat_ws(',', CASE WHEN l = rr THEN 'no_self_link' END, CASE WHEN NOT (conf BETWEEN 0 AND 1) THEN 'confidence_in_unit_interval' END, CASE WHEN NOT (conf >= CAST(0.1 AS DOUBLE)) THEN 'evidence_accepted' END, CASE WHEN rr NOT IN (SELECT c_custkey FROM customer) THEN 'known_addresses' END) AS failed FROM k)
SELECT failed, count(*) AS constraints FROM t GROUP BY ALL""",
)
def constraint_gate(spark, folder):
    c = T.table(spark, folder, "customer")
    rows = c.select(
        F.col("c_custkey").alias("constraint_id"),
        F.col("c_custkey").alias("left_address"),
        F.when(F.col("c_custkey") % 9 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 7).alias("right_address"),
        ((F.col("c_acctbal") + 1000) / 12000).alias("confidence"),
        F.lit(1).alias("valid_from_block"),
        F.lit(2).alias("valid_to_block"),
        F.lit("https://example.org").alias("source_url"),
        F.lit("a" * 40).alias("source_revision"),
        F.lit("must_link").alias("relation"),
        F.lit("economic_actor").alias("entity_scope"),
        F.lit("verified").alias("review_status"),
    )
    registry = c.select(F.col("c_custkey").alias("address"))
    out = Q.constraint_gate(rows, registry, Q.constraint_rules(0.1, "must_link", "economic_actor", "verified"))
    return out.groupBy(F.array_join("failed_rules", ",").alias("failed")).agg(F.count(F.lit(1)).alias("constraints"))


@query(
    "q10_registry_loader",
    """SELECT c_mktsegment AS entity_scope, count(*) AS addresses, count(*) FILTER (c_custkey % 2 = 0) AS contracts, count(*) FILTER (c_custkey % 3 = 0 AND c_mktsegment = 'BUILDING') AS infrastructure FROM customer GROUP BY ALL""",
)
def registry_loader(spark, folder):
    c = T.table(spark, folder, "customer")
    scope = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("protocol_infrastructure")).otherwise(F.col("c_mktsegment"))
    raw = c.select(
        F.col("c_custkey").alias("address"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit(" True")).otherwise(F.lit("0")).alias("contract_observed"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("1")).otherwise(F.lit("false")).alias("high_confidence_entity_label"),
        F.lit("FALSE").alias("economic_actor_resolved"),
        scope.alias("entity_scope"),
        F.col("c_mktsegment").alias("segment"),
    )
    out = Q.load_registry(raw)
    return out.groupBy(F.col("segment").alias("entity_scope")).agg(
        F.count(F.lit(1)).alias("addresses"), F.count_if("contract_observed").alias("contracts"), F.count_if("curated_infrastructure").alias("infrastructure")
    )


def daily_targets():
    import datetime as dt

    return [dt.datetime(2024, 1, 2) + dt.timedelta(days=i) for i in range(28)]


@query(
    "j05_first_block_at_or_after",
    """WITH t AS (SELECT CAST(i AS BIGINT) AS target_index, TIMESTAMP '2024-01-02' + to_days(CAST(i AS INTEGER)) AS target FROM range(28) x(i)),
f AS (SELECT target_index, target, min(event_id) AS start_block FROM t JOIN events ON ts >= target GROUP BY ALL)
SELECT target_index, start_block, epoch_us(e.ts) // 1000000 - epoch_us(target) // 1000000 AS lag_seconds, true AS adjacent_proof FROM f JOIN events e ON e.event_id = f.start_block""",
)
def first_block_at_or_after(spark, folder):
    out = K.first_at_or_after(T.headers(spark, folder), daily_targets())
    return rounded(out.select("target_index", "start_block", "lag_seconds", "adjacent_proof"))


def boundary_table(spark, folder):
    """Boundaries of a 28-day panel around 2024-01-15, found from the headers."""
    out = K.first_at_or_after(T.headers(spark, folder), daily_targets())
    hashed = F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("block"), F.col("start_block").cast("string")), 256))
    return out.select(
        F.lit(1).alias("cohort_id"), (F.col("target_index") - 13).alias("boundary_event_week"), "target_utc", "start_block", "start_block_timestamp",
        "previous_block_timestamp", "lag_seconds", hashed.alias("start_block_hash"),
    )


@query(
    "j04_assign_weeks",
    """SELECT CASE WHEN ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-29' THEN date_diff('day', DATE '2024-01-15', CAST(ts AS DATE)) END AS event_week, count(*) AS events FROM events GROUP BY ALL""",
)
def assign_weeks(spark, folder):
    boundaries = boundary_table(spark, folder).select("boundary_event_week", "start_block", F.lit(1).alias("cohort_id"))
    events = T.table(spark, folder, "events").select(F.col("event_id").alias("block_number"), F.lit(1).alias("cohort_id"))
    out = K.assign_weeks(events, boundaries, ["cohort_id"], strict=False)
    return rounded(out.groupBy("event_week").agg(F.count(F.lit(1)).alias("events")))


# several blocks share each stored second: headers carry the day alone, the anchor is the third block of its day
ANCHORED = """h AS (SELECT event_id % 2 AS chain, event_id AS b, date_trunc('day', ts) AS t FROM events),
anchor AS (SELECT chain, b FROM h WHERE t = TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY chain ORDER BY b) = 3),
tg AS (SELECT chain, i - 13 AS week, TIMESTAMP '2024-01-02' + to_days(CAST(i AS INTEGER)) AS target FROM range(28) x(i), range(2) y(chain)),
fb AS (SELECT tg.chain, week, target, min(h.b) FILTER (h.t >= target) AS first_b, max(h.t) FILTER (h.t < target) AS prev_t, min(h.t) FILTER (h.t >= target) AS first_t
  FROM tg JOIN h ON h.chain = tg.chain GROUP BY ALL),
bd AS (SELECT fb.chain, week, target, CASE WHEN fb.chain = 0 AND week = 0 THEN a.b ELSE first_b END AS start_block, first_t,
  CASE WHEN fb.chain = 0 AND week = 0 THEN (SELECT max_by(h.t, h.b) FROM h WHERE h.chain = 0 AND h.b < a.b) ELSE prev_t END AS previous_t
  FROM fb JOIN anchor a ON a.chain = fb.chain)"""


def anchored_boundaries(spark, folder):
    """Daily boundaries of two chains; chain 0 starts at its activation block, chain 1 at the first of the day."""
    headers = T.headers(spark, folder).select(
        (F.col("block_number") % 2).alias("chain"), "block_number", F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("timestamp")
    )
    day = headers.where(F.col("timestamp") == F.lit(T.ACTIVATION_DAY).cast("timestamp_ntz"))
    third = day.withColumn("n", F.row_number().over(Window.partitionBy("chain").orderBy("block_number"))).where("n = 3 and chain = 0")
    anchor = third.select("chain", F.lit(0).alias("boundary_event_week"), F.col("block_number").alias("activation_block"))
    weeks = spark.range(28).select((F.col("id") - 13).cast("int").alias("boundary_event_week"))
    target = (F.lit(T.ACTIVATION_DAY).cast("timestamp_ntz") + F.make_interval(days=F.col("boundary_event_week"))).alias("target_utc")
    targets = weeks.crossJoin(spark.range(2).select(F.col("id").alias("chain"))).select("chain", "boundary_event_week", target)
    return K.boundary_blocks(headers, targets.join(anchor, ["chain", "boundary_event_week"], "left"), "chain")


@query(
    "j05_anchored_boundaries",
    f"WITH {ANCHORED} SELECT chain, CAST(week AS BIGINT) AS boundary_event_week, start_block, CAST(CAST(first_t AS DATE) AS VARCHAR) AS start_day, CAST(CAST(previous_t AS DATE) AS VARCHAR) AS previous_day, epoch_us(first_t) // 1000000 - epoch_us(target) // 1000000 AS lag_seconds FROM bd",
)
def anchored_boundary_table(spark, folder):
    out = anchored_boundaries(spark, folder)
    day = {name: F.to_date(f"{column}_timestamp").cast("string").alias(name) for name, column in (("start_day", "start_block"), ("previous_day", "previous_block"))}
    return rounded(out.select("chain", "boundary_event_week", "start_block", day["start_day"], day["previous_day"], "lag_seconds"))


@query(
    "q11_calendar_checks",
    f"""WITH {ANCHORED}, c AS (
  SELECT chain AS cohort_id, *, CASE WHEN chain = 0 THEN 'anchored' ELSE 'adjacent' END AS policy FROM bd
  UNION ALL SELECT 2, *, 'adjacent' FROM bd WHERE chain = 0 UNION ALL SELECT 3, *, 'adjacent' FROM bd WHERE chain = 1 AND week <> 5)
SELECT cohort_id, count(*) AS boundary_count, CAST(cohort_id = 3 AS BIGINT) AS gap_count, CAST(0 AS BIGINT) AS not_increasing_count,
  count(*) FILTER (CASE WHEN week = 0 AND policy = 'anchored' THEN NOT (first_t = target AND previous_t <= target) ELSE NOT (first_t >= target AND previous_t < target) END) AS unproven_count,
  CAST(0 AS BIGINT) AS lag_mismatch_count, CAST(0 AS BIGINT) AS malformed_hash_count, cohort_id <> 3 AS weeks_complete, cohort_id < 2 AS calendar_valid FROM c GROUP BY ALL""",
)
def calendar_checks(spark, folder):
    """Good cohorts under both policies; the anchored boundaries under the other policy; one without a week."""
    bounds = anchored_boundaries(spark, folder).withColumn("start_block_hash", F.concat(F.lit("0x"), F.sha2(F.col("start_block").cast("string"), 256)))
    even, odd = bounds.where("chain = 0"), bounds.where("chain = 1")
    cases = [(0, even, "anchored"), (1, odd, "adjacent"), (2, even, "adjacent"), (3, odd.where("boundary_event_week <> 5"), "adjacent")]
    table = reduce(lambda a, b: a.unionByName(b), [df.withColumns({"cohort_id": F.lit(i).cast("bigint"), "policy": F.lit(rule)}) for i, df, rule in cases])
    return rounded(K.calendar_checks(table, "cohort_id", -13, 13, "policy"))


@query(
    "j14_boundary_agreement",
    """WITH t AS (SELECT i - 13 AS week, TIMESTAMP '2024-01-02' + to_days(CAST(i AS INTEGER)) AS target FROM range(28) x(i) WHERE i IN (0, 13, 26, 27)), f AS (SELECT week, min(event_id) AS b FROM t JOIN events ON ts >= target GROUP BY ALL)
SELECT CAST(1 AS BIGINT) AS cohort_id, week AS boundary_event_week, b AS start_block, CASE WHEN b % 2 = 0 THEN '0x' || sha256('block' || CAST(b AS VARCHAR)) WHEN b % 3 > 0 THEN '0x' || sha256('fork' || CAST(b AS VARCHAR)) END AS validation_block_hash, b % 2 = 0 AS exact_match FROM f""",
)
def boundary_agreement(spark, folder):
    """The second source has another hash for odd blocks and lacks those that three divides."""
    number, text = F.col("block_number"), F.col("block_number").cast("string")
    fork = F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("fork"), text), 256))
    other = T.headers(spark, folder).where((number % 2 == 0) | (number % 3 > 0)).withColumn("block_hash", F.when(number % 2 == 0, F.col("block_hash")).otherwise(fork))
    return rounded(D.boundary_agreement(boundary_table(spark, folder), other))


@query(
    "j06_first_code_block",
    "SELECT user_id AS address, min(event_id) AS first_code_block FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY ALL",
)
def first_code_block(spark, folder):
    code = F.when(F.col("event_type").isin("purchase", "signup"), F.lit("0x6001")).otherwise(F.lit("0x"))
    snaps = T.table(spark, folder, "events").select(F.col("user_id").alias("address"), F.col("event_id").alias("block_number"), code.alias("code"))
    return K.first_code_block(snaps)


PERIODS = [("pre", -14, -1), ("post", 1, 15), ("full", -14, 15)]


def periods(spark):
    return spark.createDataFrame(PERIODS, "period string, minimum_event_week int, maximum_event_week int")


@query(
    "j07_overlapping_periods",
    f"""WITH {ACTIONS}, p AS (SELECT * FROM (VALUES ('pre', -14, -1), ('post', 1, 15), ('full', -14, 15)) t(period, a, b))
SELECT period, action, count(*) AS events FROM actions JOIN p ON event_week BETWEEN a AND b GROUP BY ALL""",
)
def overlapping_periods(spark, folder):
    out = K.assign_periods(T.actions(spark, folder).select("event_week", "action"), periods(spark))
    return out.groupBy("period", "action").agg(F.count(F.lit(1)).alias("events"))


@query(
    "j01_entity_map",
    """WITH s AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), m AS (SELECT c_custkey AS a, 'E' || CAST(c_nationkey AS VARCHAR) AS e FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(f.e, '0x00000000' || lpad(lower(to_hex(k + 1)), 32, '0')) AS from_entity, coalesce(t.e, '0x00000000' || lpad(lower(to_hex(user_id + 1)), 32, '0')) AS to_entity, count(*) AS transfers
FROM s LEFT JOIN m f ON f.a = k + 1 LEFT JOIN m t ON t.a = user_id + 1 GROUP BY ALL""",
)
def entity_map(spark, folder):
    mapping = T.table(spark, folder, "customer").where("c_custkey % 2 = 0").select(
        F.upper(T.address(F.col("c_custkey"))).alias("_a"), F.concat(F.lit("E"), F.col("c_nationkey").cast("string")).alias("entity_id"), F.lit(1.0).alias("confidence")
    ).withColumn("address", F.concat(F.lit("0x"), F.substring("_a", 3, 40))).drop("_a")
    out = TR.apply_entity_map(T.warehouse_transfers(spark, folder), mapping)
    return out.groupBy("from_entity", "to_entity").agg(F.count(F.lit(1)).alias("transfers"))


def perturbed(df):
    """A deterministic second source: rows dropped, values and a metadata field changed."""
    return df.where("event_id % 97 <> 0").withColumns(
        {
            "event_type": F.when(F.col("event_id") % 101 == 0, F.lit("other")).otherwise(F.col("event_type")),
            "value": F.when(F.col("event_id") % 53 == 0, F.lit(None).cast("double")).otherwise(F.col("value")),
        }
    )


@query(
    "j13_table_diff",
    """WITH b AS (SELECT event_id, user_id, CASE WHEN event_id % 101 = 0 THEN 'other' ELSE event_type END AS event_type, CASE WHEN event_id % 53 = 0 THEN NULL ELSE value END AS value FROM events WHERE event_id % 97 <> 0),
j AS (SELECT a.user_id AS ua, b.user_id AS ub, a.event_type AS ta, b.event_type AS tb, a.value AS va, b.value AS vb, b.event_id AS bid FROM events a LEFT JOIN b USING (event_id)),
c AS (SELECT count(*) AS n, count(bid) AS m, count(*) FILTER (bid IS NOT NULL AND ta <> tb) AS mt, count(*) FILTER (bid IS NOT NULL AND vb IS NULL) AS mv FROM j)
SELECT field, field_class, n AS primary_row_count, m AS validation_row_count, m AS matched_key_count, n - m AS primary_only_key_count, CAST(0 AS BIGINT) AS validation_only_key_count, CAST(0 AS BIGINT) AS primary_missing_count, vm AS validation_missing_count, mm AS value_mismatch_count, false AS exact_match
FROM c, LATERAL (SELECT 'user_id' AS field, 'consensus' AS field_class, CAST(0 AS BIGINT) AS vm, CAST(0 AS BIGINT) AS mm UNION ALL SELECT 'event_type', 'consensus', CAST(0 AS BIGINT), mt UNION ALL SELECT 'value', 'provider_metadata', mv, CAST(0 AS BIGINT)) x""",
)
def table_diff(spark, folder):
    events = T.table(spark, folder, "events")
    out = D.table_diff(events, perturbed(events), ["event_id"], ["user_id", "event_type", "value"], ["user_id", "event_type"])
    return out.drop("primary_digest", "validation_digest")


@query(
    "j13_diff_status",
    """SELECT * FROM (VALUES ('itself', true, true, 'full_payload_exact_match'), ('without_fields', true, false, 'consensus_match_provider_metadata_differs'), ('perturbed', false, false, 'consensus_mismatch'))
t(compared, consensus_match, full_match, validation_status), (SELECT count(*) AS primary_row_count FROM events)""",
)
def diff_status(spark, folder):
    """Status of the events beside themselves in another order, with values missing, and with rows and fields changed."""
    events = T.table(spark, folder, "events")
    others = {
        "itself": events.repartition("user_id"),
        "without_fields": events.withColumn("value", F.when(F.col("event_id") % 53 != 0, F.col("value"))),
        "perturbed": perturbed(events),
    }
    out = None
    for name, other in others.items():
        # written, as it is read twice: for the status and for the count of rows
        audit = cut(D.table_diff(events, other, ["event_id"], ["user_id", "event_type", "value"], ["user_id", "event_type"]))
        rows = audit.agg(F.max("primary_row_count").alias("primary_row_count"))
        row = with_scalar(D.diff_status(audit), rows).withColumn("compared", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("compared", "consensus_match", "full_match", "validation_status", "primary_row_count")


@query(
    "j13_window_checks",
    """WITH n AS (SELECT count(*) AS n, max(event_id) AS mx FROM events), p AS (SELECT i, CAST(round_even(i * (n - 1) / CAST(4 AS DOUBLE), 0) AS BIGINT) AS b, mx FROM n, range(5) t(i)),
w AS (SELECT DISTINCT least(greatest(0, b - 50), mx - 100 + 1) AS f, least(mx, least(greatest(0, b - 50), mx - 100 + 1) + 99) AS t FROM p)
SELECT f AS from_block, t AS to_block, count(*) AS primary_row_count, count(*) FILTER (event_id % 97 <> 0) AS validation_row_count, count(*) = count(*) FILTER (event_id % 97 <> 0 AND event_id % 101 <> 0) AS exact_match FROM w JOIN events ON event_id BETWEEN f AND t GROUP BY ALL""",
)
def window_checks(spark, folder):
    events = T.table(spark, folder, "events").withColumn("block_number", F.col("event_id"))
    last = events.agg(F.max("event_id")).first()[0]
    windows = O.sample_windows(events, "block_number", 5, 100, 0, last)
    out = D.window_checks(events, perturbed(events), windows, ["event_id", "user_id", "event_type"])
    return out.select("from_block", "to_block", "primary_row_count", "validation_row_count", "exact_match")


@query(
    "w07_sample_windows",
    """WITH n AS (SELECT count(*) AS n, max(event_id) AS mx FROM events), p AS (SELECT i, CAST(round_even(i * (n - 1) / CAST(6 AS DOUBLE), 0) AS BIGINT) AS b, mx FROM n, range(7) t(i))
SELECT DISTINCT least(greatest(0, b - 20), mx - 40 + 1) AS from_block, least(mx, least(greatest(0, b - 20), mx - 40 + 1) + 39) AS to_block FROM p""",
)
def sample_windows(spark, folder):
    events = T.table(spark, folder, "events")
    last = events.agg(F.max("event_id")).first()[0]
    return O.sample_windows(events, "event_id", 7, 40, 0, last)


@query(
    "j16_code_agreement",
    """WITH t AS (SELECT CASE WHEN event_type = 'view' THEN 'primary_code_absent' WHEN event_id % 97 = 0 OR event_id % 53 = 0 THEN 'validation_historical_state_unavailable' WHEN event_id % 31 = 0 THEN 'validation_historical_code_absent' WHEN event_id % 101 = 0 THEN 'code_differs' ELSE 'independent_exact_match' END AS status FROM events)
SELECT status, count(*) AS snapshots, count(*) FILTER (status = 'independent_exact_match') AS matches FROM t GROUP BY ALL""",
)
def code_agreement(spark, folder):
    events = T.table(spark, folder, "events")
    primary = events.select(
        F.col("user_id").alias("address"), F.col("event_id").alias("block_number"), F.when(F.col("event_type") == "view", F.lit("0x")).otherwise(F.lit("0x60")).alias("code")
    )
    n = F.col("block_number")
    validation = primary.where(n % 97 != 0).withColumn(
        "code", F.when(n % 53 == 0, F.lit(None).cast("string")).when(n % 31 == 0, F.lit("0x")).when(n % 101 == 0, F.lit("0x61")).otherwise(F.col("code"))
    )
    out = D.code_agreement(primary, validation)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("snapshots"), F.count_if("exact_match").alias("matches"))


@query(
    "q12_ledger_reconciliation",
    """WITH c AS (SELECT n_nationkey AS id, min(o_orderdate) AS t, min(o_orderkey) AS b FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT id AS event_id, CASE WHEN id % 6 = 0 THEN 'missing' WHEN id % 6 = 1 THEN 'evidence_tier' WHEN id % 6 = 2 THEN 'block_number' WHEN id % 6 = 3 THEN 'event_time_utc' END AS mismatches FROM c WHERE id % 6 < 4""",
)
def ledger_reconciliation(spark, folder):
    orders = T.table(spark, folder, "orders").join(T.table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cohorts = orders.groupBy(F.col("c_nationkey").alias("event_id")).agg(F.min("o_orderdate").alias("activation_utc"), F.min("o_orderkey").alias("activation_block"))
    n = F.col("event_id") % 6
    ledger = cohorts.select(
        "event_id",
        F.when(n == 0, F.lit("no")).otherwise(F.lit("Yes ")).alias("primary_treatment"),
        F.when(n == 1, F.lit("B")).otherwise(F.lit("A+")).alias("evidence_tier"),
        F.when(n == 2, F.col("activation_block") + 1).otherwise(F.col("activation_block")).alias("block_number"),
        F.when(n == 3, F.col("activation_utc") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("activation_utc")).alias("event_time_utc"),
    )
    out = Q.ledger_mismatches(cohorts, ledger)
    return out.select("event_id", F.array_join("mismatches", ",").alias("mismatches"))


@query(
    "q13_table_package",
    """SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS rows, (SELECT count(*) FROM orders) AS observed_rows, '' AS issues UNION ALL SELECT 'customer', (SELECT count(*) FROM customer) + 1, (SELECT count(*) FROM customer), 'row_count'
UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), (SELECT count(*) FROM nation), 'fields' UNION ALL SELECT 'region', NULL, (SELECT count(*) FROM region), 'not_in_manifest'""",
)
def table_package(spark, folder):
    tables = {n: T.table(spark, folder, n) for n in ("orders", "customer", "nation", "region")}
    rows = [
        (n, tables[n].count() + (1 if n == "customer" else 0), tables[n].columns[: 2 if n == "nation" else None], "DERIVED", "DERIVED")
        for n in ("orders", "customer", "nation")
    ]
    manifest = spark.createDataFrame(rows, "name string, rows bigint, fields array<string>, evidence_status string, expected_status string")
    return Q.package_audit(manifest, tables)


@query(
    "q14_evidence_guard",
    "SELECT count(*) AS row_count, count(*) FILTER (event_type <> 'view') AS promoted_rows, count(*) FILTER (event_type = 'view') AS guarded_rows FROM events",
)
def evidence_guard(spark, folder):
    """Counts of promoted rows, and the rows that pass the guard, which fails on any other."""
    events = T.table(spark, folder, "events")
    kept = Q.evidence_guard(events.where("event_type = 'view'"), "event_type", "view").groupBy("event_type").agg(F.count(F.lit(1)).alias("guarded_rows"))
    return with_scalar(Q.evidence_counts(events, "event_type", "view"), kept.select("guarded_rows"))


@query(
    "q15_frames_equal",
    """SELECT event_id, concat_ws(',', CASE WHEN event_id % 97 = 0 THEN 'only_left' END, CASE WHEN event_id % 89 = 0 THEN 'repeated_left' END, CASE WHEN event_id % 83 = 0 AND event_id % 97 <> 0 THEN 'repeated_right' END,
  CASE WHEN event_id % 101 = 0 AND event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0 THEN 'event_type' END, CASE WHEN event_id % 53 = 0 AND event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0 THEN 'value' END) AS differences
FROM events WHERE event_id % 97 = 0 OR event_id % 101 = 0 OR event_id % 53 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0""",
)
def frames_equal(spark, folder):
    events = T.table(spark, folder, "events").select("event_id", "event_type", "value")
    right = perturbed(events)
    left = events.unionByName(events.where("event_id % 89 = 0"))
    out = Q.frames_equal(left, right.unionByName(right.where("event_id % 83 = 0")), ["event_id"])
    return out.select("event_id", F.array_join("differences", ",").alias("differences"))


@query(
    "q16_glossary_rules",
    """WITH g AS (SELECT p_brand, 'b' || CAST(p_size % 7 AS VARCHAR) AS k FROM part)
SELECT 'uncited' AS rule, k AS reference_key, CAST(1 AS BIGINT) AS found FROM g WHERE k IN ('b5', 'b6') GROUP BY ALL
UNION ALL SELECT 'outside_domain', p_brand, count(*) FROM g WHERE p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22', 'Brand#23') GROUP BY ALL""",
)
def glossary_rules(spark, folder):
    """Keys without a citation, and measures whose dimension is outside a fixed list."""
    parts = T.table(spark, folder, "part").select(
        F.col("p_partkey").alias("measure_id"),
        F.col("p_brand").alias("dimension"),
        F.concat(F.lit("b"), (F.col("p_size") % 7).cast("string"), F.lit(";b0")).alias("reference_keys"),
    )
    known = T.table(spark, folder, "part").where("p_size % 7 < 5").select(F.concat(F.lit("b"), (F.col("p_size") % 7).cast("string")).alias("reference_key"))
    uncited = Q.uncited_keys(parts, known).select(F.lit("uncited").alias("rule"), "reference_key", F.lit(1).cast("bigint").alias("found"))
    allowed = tuple(f"Brand#{a}{b}" for a in (1, 2) for b in (1, 2, 3))
    outside = Q.reject_rows(parts, {"domain": F.col("dimension").isin(*allowed)}).where(F.size("failed_rules") > 0)
    counted = outside.groupBy(F.col("dimension").alias("reference_key")).agg(F.count(F.lit(1)).alias("found"))
    return uncited.unionByName(counted.select(F.lit("outside_domain").alias("rule"), "reference_key", "found"))


@query(
    "q18_coverage_gate",
    f"""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT CAST(n AS DOUBLE) AS n, o_custkey % 10 < 9 AS l, o_custkey % 10 < 7 AS e FROM c)
SELECT {r('count(*) FILTER (l) / CAST(count(*) AS DOUBLE)')} AS unique_address_coverage, {r('sum(n) FILTER (l) / sum(n)')} AS incidence_coverage, {r('sum(n) FILTER (e) / sum(n)')} AS economic_actor_incidence_coverage,
 (sum(n) FILTER (e) / sum(n) >= 0.8 AND sum(n) FILTER (l) / sum(n) >= 0.8) AS entity_gate_passed FROM t""",
)
def coverage_gate(spark, folder):
    registry = T.table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("event_incidence_count"))
    registry = registry.withColumns({"labelled": F.col("o_custkey") % 10 < 9, "economic": F.col("o_custkey") % 10 < 7})
    return rounded(Q.coverage_gate(registry, "labelled", "economic", "event_incidence_count"))


@query("q19_metric_drift", f"WITH {ACTIONS} SELECT chain_id, 'events' AS differences FROM actions WHERE chain_id = 1 GROUP BY ALL")
def metric_drift(spark, folder):
    df = T.actions(spark, folder)
    observed = df.groupBy("chain_id").agg(F.count(F.lit(1)).alias("events"), F.avg("beneficiary_address").alias("mean_unit"))
    locked = observed.select("chain_id", (F.col("events") + F.col("chain_id")).alias("event_count"), (F.col("mean_unit") * (1 + 1e-13)).alias("locked_mean"))
    out = Q.metric_drift(observed, locked, ["chain_id"], {"events": "event_count"}, {"mean_unit": "locked_mean"})
    return out.select("chain_id", F.array_join("differences", ",").alias("differences"))


@query(
    "q19_grid_and_totals",
    f"""WITH {ACTIONS} SELECT 'whole' AS panel, CAST(count(*) AS BIGINT) AS sum_of_parts, CAST(count(*) AS BIGINT) AS stated_total, true AS reconciles, CAST(0 AS BIGINT) AS missing_cells FROM actions
UNION ALL SELECT 'cut', CAST(count(*) FILTER (event_week <> 3) AS BIGINT), CAST(count(*) AS BIGINT), count(*) FILTER (event_week = 3) = 0, CAST(2 * 5 AS BIGINT) FROM actions""",
)
def grid_and_totals(spark, folder):
    """A complete panel, and one without a week."""
    df = T.actions(spark, folder)
    panel = P.event_count_panel(df, ["chain_id"], T.FIRST_DAY, T.LAST_DAY, T.ACTIONS)
    total = df.agg(F.count(F.lit(1)).alias("n"))
    out = []
    for name, part in (("whole", panel), ("cut", panel.where("event_week <> 3"))):
        missing = Q.grid_complete(part, panel, ["chain_id", "event_week", "action"]).agg(F.count(F.lit(1)).alias("missing_cells"))
        sums = Q.totals_reconcile(part, "event_count", total, "n").withColumn("panel", F.lit(name))
        out.append(with_scalar(sums, missing))
    return out[0].unionByName(out[1])


@query(
    "q20_crosswalk",
    """SELECT s_suppkey AS result_id, CASE WHEN s_suppkey % 10 = 0 THEN 'orphan_in_index' WHEN s_suppkey % 10 = 1 THEN 'configurations' ELSE '' END AS issues FROM supplier""",
)
def crosswalk(spark, folder):
    s = T.table(spark, folder, "supplier")
    index = s.select(F.col("s_suppkey").alias("result_id"), F.concat(F.lit("a;n"), F.col("s_nationkey").cast("string")).alias("configurations"), F.col("s_name").alias("fields"))
    mapping = index.where("result_id % 10 <> 0").withColumn(
        "configurations", F.when(F.col("result_id") % 10 == 1, F.lit("b;c")).otherwise(F.col("configurations"))
    )
    return Q.crosswalk(index, mapping, "result_id", ["configurations", "fields"])


@query("w01_global_ordinal", "SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) AS ordinal FROM events")
def global_ordinal(spark, folder):
    events = T.table(spark, folder, "events").select("event_id", "user_id")
    return O.global_ordinal(events, ["user_id", "event_id"]).select("event_id", "ordinal")


@query(
    "w02_average_rank",
    f"""WITH u AS (SELECT o_orderpriority, o_custkey, count(*) AS c FROM orders GROUP BY ALL), k AS (SELECT o_orderpriority, c, rank() OVER (PARTITION BY o_orderpriority ORDER BY c) AS rk, count(*) OVER (PARTITION BY o_orderpriority, c) AS ties, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM u)
SELECT DISTINCT o_orderpriority, c, {r('rk + (ties - 1) / CAST(2 AS DOUBLE)')} AS rank, {r('(rk + (ties - 1) / CAST(2 AS DOUBLE)) / n')} AS rank_pct, ties FROM k""",
)
def average_rank(spark, folder):
    counts = T.table(spark, folder, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.count(F.lit(1)).alias("c"))
    return rounded(O.average_rank(counts, ["o_orderpriority"], "c"))


@query(
    "w02_spearman",
    f"""WITH u AS (SELECT c_mktsegment, c_custkey, count(o_orderkey) AS n, c_acctbal AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
k AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY n) + (count(*) OVER (PARTITION BY c_mktsegment, n) - 1) / CAST(2 AS DOUBLE) AS x, rank() OVER (PARTITION BY c_mktsegment ORDER BY b) + (count(*) OVER (PARTITION BY c_mktsegment, b) - 1) / CAST(2 AS DOUBLE) AS y FROM u)
SELECT c_mktsegment, {r('corr(x, y)')} AS spearman FROM k GROUP BY ALL""",
)
def spearman(spark, folder):
    counts = T.table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    df = T.table(spark, folder, "customer").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").fillna(0, ["n"])
    return rounded(O.spearman(df, ["c_mktsegment"], "n", "c_acctbal"))


@query("w05_stable_order", "SELECT o_custkey, c FROM (SELECT o_custkey, count(*) AS c FROM orders GROUP BY ALL) ORDER BY c DESC, o_custkey LIMIT 50")
def stable_order(spark, folder):
    counts = T.table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c"))
    return O.stable_top(counts, "c", "o_custkey", 50)


@query(
    "w06_audit_sample",
    """WITH u AS (SELECT o_custkey AS address, count(*) AS w, o_custkey % 3 = 0 AS contract FROM orders GROUP BY ALL), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY w DESC, address) AS rk FROM u) WHERE rk <= 10),
f AS (SELECT address FROM u WHERE address NOT IN (SELECT address FROM h) ORDER BY sha256('audit:' || CAST(address AS VARCHAR)), address LIMIT 20)
SELECT address, 'heaviest_of_stratum' AS sample_source FROM h UNION ALL SELECT address, 'hash_rank' FROM f""",
)
def audit_sample(spark, folder):
    registry = T.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("address")).agg(F.count(F.lit(1)).alias("w")).withColumn("contract", F.col("address") % 3 == 0)
    return O.audit_sample(registry, 40, "contract", "w", "address", "audit").select("address", "sample_source")


@query(
    "w08_w09_union_distinct",
    f"""WITH {ACTIONS}, u AS (SELECT chain_id, actor_address AS address FROM actions UNION ALL SELECT chain_id, beneficiary_address FROM actions) SELECT chain_id, count(*) AS role_rows, count(DISTINCT address) AS addresses FROM u GROUP BY ALL""",
)
def union_distinct(spark, folder):
    df = T.actions(spark, folder)
    parts = [df.select("chain_id", F.col(c).alias("address")) for c in ("actor_address", "beneficiary_address")]
    stacked = parts[0].unionByName(parts[1])
    distinct = stacked.dropDuplicates(["chain_id", "address"]).groupBy("chain_id").agg(F.count(F.lit(1)).alias("addresses"))
    return stacked.groupBy("chain_id").agg(F.count(F.lit(1)).alias("role_rows")).join(distinct, "chain_id")


@query(
    "w10_set_operations",
    f"""WITH {ACTIONS}, f AS (SELECT action, beneficiary_address AS u, max(CAST(chain_id = 0 AS INT)) AS a, max(CAST(chain_id = 1 AS INT)) AS b FROM actions GROUP BY ALL)
SELECT action, CAST(sum(a * b) AS BIGINT) AS both, CAST(sum(a * (1 - b)) AS BIGINT) AS only_left, CAST(sum(b * (1 - a)) AS BIGINT) AS only_right, count(*) AS either FROM f GROUP BY ALL""",
)
def set_operations(spark, folder):
    df = T.actions(spark, folder)
    flags = df.groupBy("action", "beneficiary_address").agg(
        F.max((F.col("chain_id") == 0).cast("int")).alias("a"), F.max((F.col("chain_id") == 1).cast("int")).alias("b")
    )
    a, b = F.col("a") == 1, F.col("b") == 1
    return flags.groupBy("action").agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_left"), F.count_if(b & ~a).alias("only_right"), F.count(F.lit(1)).alias("either")
    )


@query(
    "w12_period_labels",
    f"""WITH {ORDER_ACTIONS} SELECT CASE WHEN event_week BETWEEN -400 AND -9 THEN 'clean_pre' WHEN event_week BETWEEN -8 AND -1 THEN 'anticipation_excluded' WHEN event_week = 0 THEN 'event_week_zero_excluded' ELSE 'post' END AS period, count(*) AS events FROM order_actions GROUP BY ALL""",
)
def period_labels(spark, folder):
    labels = (("clean_pre", -400, -9), ("anticipation_excluded", -8, -1), ("event_week_zero_excluded", 0, 0), ("post", 1, 400))
    assert K.periods_partition(labels, -400, 400)
    df = T.order_actions(spark, folder)
    return df.groupBy(K.period_label(F.col("event_week"), labels).alias("period")).agg(F.count(F.lit(1)).alias("events"))


@query(
    "c03_sunday_weeks",
    f"""WITH {SUPPLY_EDGES} SELECT CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS VARCHAR)[1:10] AS period, count(*) AS transfers FROM supply_edges GROUP BY ALL""",
)
def sunday_weeks(spark, folder):
    df = T.supply_edges(spark, folder)
    return df.groupBy(K.week_start_sunday(F.col("ts")).cast("string").alias("period")).agg(F.count(F.lit(1)).alias("transfers"))
