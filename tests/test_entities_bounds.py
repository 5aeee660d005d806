import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyweave.operators import bounds as B
from tallyweave.operators import contracts as Q
from tallyweave.operators import entities as E
from tallyweave.operators import routes as R

EVENTS = "chain_id bigint, action string, block_number bigint, tx_hash string, log_index bigint, event_week int, actor_address string, beneficiary_address string, counterparty_address string"


def events(spark):
    data = [(1, "supply", 10, "t1", 0, 0, "A", "A", None), (1, "withdraw", 11, "t2", 0, 1, "B", "C", "C")]
    return spark.createDataFrame(data, EVENTS)


def test_universe_roles_and_incidences(spark):
    universe, incidences = E.address_universe(events(spark))
    out = rows(universe, "address")
    assert len(out) == 3 and incidences.count() == 3
    assert out["A"]["observed_roles"] == "actor|beneficiary" and out["C"]["observed_roles"] == "beneficiary|counterparty"
    assert out["C"]["role_incidence_count"] == 2 and out["C"]["event_incidence_count"] == 1
    assert rows(incidences, "address")["A"]["roles_in_event"] == "actor|beneficiary"


CODE = "address string, first_runtime_code string, last_runtime_code string"


def test_code_classes(spark):
    data = [("A", "0x", "0x"), ("B", "0x6001", "0x6001"), ("C", "0x", "0x6001"), ("D", "0x6001", "0x"), ("E", "0x60", "0x61")]
    out = rows(E.classify_code(spark.createDataFrame(data, CODE)), "address")
    assert out["A"]["address_type"] == "code_absent_at_observed_bounds" and not out["A"]["contract_observed"]
    assert out["B"]["address_type"] == "smart_contract" and out["B"]["infrastructure_family_id"].startswith("runtime_sha256:")
    assert [out[k]["code_presence_class"] for k in "CDE"] == ["runtime_code_appeared", "runtime_code_disappeared", "runtime_code_changed"]
    assert out["B"]["last_runtime_code_bytes"] == 2
    with pytest.raises(Exception, match="malformed runtime code"):
        E.classify_code(spark.createDataFrame([("A", "0x1", "0x")], CODE)).collect()


def labels(spark, data):
    return spark.createDataFrame(data, "address string, entity_id string, entity_scope string, confidence double, valid_from_block bigint, valid_to_block bigint")


def test_curated_collapse(spark):
    data = [(1, "supply", 10, "t1", 0, 0, "B", "C", None), (1, "withdraw", 11, "t2", 0, 1, "A", "A", None)]
    df = spark.createDataFrame(data, EVENTS)
    universe, incidences = E.address_universe(df)
    facts = E.classify_code(spark.createDataFrame([(a, "0x60", "0x60") for a in "ABC"], CODE))
    known = labels(spark, [(a, "E1", "protocol_infrastructure", 0.95, 1, 99) for a in "BC"])
    registry = E.versioned_registry(universe, facts, known, "v1")
    by_action, weekly = E.measurement_panels(incidences, registry, 0, 1, ["supply", "withdraw"])
    week = rows(weekly, "event_week")[0]
    assert (week["active_addresses"], week["effective_active_addresses"], week["effective_curated_entities_sensitivity"]) == (2, 2.0, 1.0)
    assert week["high_confidence_entity_incidence_coverage"] == 1.0 and week["economic_actor_incidence_coverage"] == 0.0
    assert by_action.count() == 4 and by_action.where("event_incidence_count = 0").count() == 2
    bare = E.classify_code(spark.createDataFrame([(a, "0x", "0x") for a in "ABC"], CODE))
    with pytest.raises(Exception, match="without runtime code"):
        E.versioned_registry(universe, bare, known, "v1").collect()
    assert E.address_type_summary(registry).first().address_share == 1.0
    assert E.infrastructure_summary(registry).first().curated_entity_ids == "E1"


def bounds_input(spark):
    units = ["A"] * 3 + ["B"] * 3 + ["C"] * 4
    data = [(i + 1, f"t{i}", 0, 0, "supply", u) for i, u in enumerate(units)]
    return spark.createDataFrame(data, "block_number bigint, tx_hash string, log_index bigint, event_week int, action string, beneficiary_address string")


LINKS = "constraint_id string, left_address string, right_address string, valid_from_block bigint, valid_to_block bigint"


def test_bounds(spark):
    panel = bounds_input(spark)
    none = spark.createDataFrame([], LINKS)
    out = B.identified_set(panel, none, ["event_week"]).first()
    assert (out.event_split_hhi_lower, out.stable_address_hhi_lower) == (0.1, pytest.approx(0.34))
    assert out.evidence_hhi_lower == pytest.approx(0.34) and out.accepted_must_link_constraint_count == 0
    link = spark.createDataFrame([("1", "B", "C", 1, 10), ("2", "A", "Z", 1, 10), ("3", "A", "B", 2, 10)], LINKS)
    out = B.identified_set(panel, link, ["event_week"]).first()
    assert out.evidence_hhi_lower == pytest.approx(0.58)
    assert out.accepted_must_link_constraint_count == 2  # the third does not cover the first block
    assert out.evidence_top1_lower == pytest.approx(0.7) and out.evidence_hhi_upper == 1.0
    periods = spark.createDataFrame([("pre", 0, 0), ("post", 0, 0)], "period string, minimum_event_week int, maximum_event_week int")
    actions = ["borrow", "liquidation", "repay", "supply", "withdraw"]
    by_action, weekly, by_period = B.bound_panels(panel, none, periods, 0, 2, actions)
    assert by_action.count() == 15 and by_action.where("NOT cell_observed").count() == 14
    assert weekly.count() == 1 and by_period.count() == 2


def test_change_envelope(spark):
    data = [("pre", 0.2, 0.05, 1.0, 0.2, 1.0, 0.1, 1.0), ("post", 0.3, 0.05, 1.0, 0.3, 1.0, 0.05, 1.0)]
    names = "period string, address_proxy_hhi double, event_split_hhi_lower double, event_split_hhi_upper double, stable_address_hhi_lower double, stable_address_hhi_upper double, evidence_hhi_lower double, evidence_hhi_upper double"
    out = rows(B.change_bounds(spark.createDataFrame(data, names)), "assumption")
    assert (out["evidence"]["change_lower"], out["evidence"]["change_upper"]) == (pytest.approx(-0.95), pytest.approx(0.9))
    assert out["evidence"]["direction"] == "not_identified" and not out["evidence"]["economic_actor_conclusion_permitted"]
    assert out["address_proxy_point"]["direction"] == "increase" and not out["address_proxy_point"]["economic_actor_conclusion_permitted"]


def test_contract_fails_closed(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 5), (2, " ", 5)], "k int, v string, w int")
    contract = Q.Contract(columns=("k", "v"), keys=(("k",),), domains={"v": ("a", "b", "c")}, spans={"w": (0, 5)}, filled=("v",), rules={"small": F.col("w") < 5})
    out = rows(Q.audit(df, contract), "check_name")
    assert {k: v["violations"] for k, v in out.items()} == {"key:k": 1, "domain:v": 2, "span:w": 0, "filled:v": 1, "rule:small": 2}
    with pytest.raises(Q.ContractError, match="key:k"):
        Q.enforce(df, contract)
    with pytest.raises(Q.ContractError, match="missing columns"):
        Q.audit(df, Q.Contract(columns=("absent",)))
    assert Q.enforce(df.where("k = 1 AND v = 'a'"), Q.Contract(keys=(("k",),))).count() == 1


def test_frames_equal_tolerance(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y"), (3, 3.0, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-13, "x"), (2, None, "y"), (4, 3.0, "z")], "k int, v double, s string")
    out = rows(Q.frames_equal(a, b, ["k"]), "k")
    assert {k: v["differences"] for k, v in out.items()} == {3: ["only_left"], 4: ["only_right"]}
    Q.assert_frames_equal(a, a, ["k"])
    with pytest.raises(Q.ContractError):
        Q.assert_frames_equal(a, b, ["k"])


def test_evidence_guard_raises(spark):
    df = spark.createDataFrame([("diagnostic",), ("promoted",)], "status string")
    assert Q.evidence_counts(df, "status", "diagnostic").first().promoted_rows == 1
    with pytest.raises(Exception, match="promoted past"):
        Q.evidence_guard(df, "status", "diagnostic").collect()


def test_constraint_release_is_all_or_nothing(spark):
    base = spark.createDataFrame([("1", "A", "B"), ("2", "A", "A")], "constraint_id string, left_address string, right_address string")
    full = base.withColumns(
        {
            "confidence": F.lit(0.99), "valid_from_block": F.lit(1), "valid_to_block": F.lit(2), "source_url": F.lit("https://x"),
            "source_revision": F.lit("a" * 40), "relation": F.lit("must_link"), "entity_scope": F.lit("economic_actor"), "review_status": F.lit("ok"),
        }
    )
    registry = spark.createDataFrame([("A",), ("B",)], "address string")
    rules = Q.constraint_rules(0.9, "must_link", "economic_actor", "ok")
    gated = Q.constraint_gate(full, registry, rules)
    assert rows(gated, "constraint_id")["2"]["failed_rules"] == ["no_self_link"]
    with pytest.raises(Exception, match="constraint rejected"):
        Q.accepted_constraints(gated).collect()
    assert Q.accepted_constraints(Q.constraint_gate(full.where("constraint_id = '1'"), registry, rules)).count() == 1


def test_timing_and_registry(spark):
    event = spark.createDataFrame([("e", 5, "t")], "event_id string, activation_block int, activation_utc string")
    audit = spark.createDataFrame([("e", 5, "t")], "event_id string, block_number int, event_time_utc string")
    calendar = event.withColumn("event_week", F.lit(0))
    assert Q.event_timing_mismatches(event, audit, calendar).count() == 0
    assert Q.event_timing_mismatches(event, audit.withColumn("block_number", F.lit(6)), calendar).first().mismatches == ["audit_block"]
    raw = spark.createDataFrame([("a", "yes", "true", "0", "x")], "address string, contract_observed string, high_confidence_entity_label string, economic_actor_resolved string, entity_scope string")
    with pytest.raises(Exception, match="invalid boolean"):
        Q.load_registry(raw).collect()


def route_rows(spark, n=2, **change):
    row = {c: "x" for c in R.ROUTE_COLUMNS}
    row.update(source_chain_id="1", destination_chain_id="2", lane_activation_block="3", source_url="https://x", verification_status="onchain_verified", capacity_wei="0")
    data = []
    for i in range(n):
        one = {**row, "route_id": f"r{i}", "message_id": f"m{i}", "source_tx_hash": f"s{i}", "destination_tx_hash": f"d{i}", "source_log_index": "0", "destination_log_index": "0", "amount_wei": "5"}
        data.append({**one, **change})
    return spark.createDataFrame([tuple(d[c] for c in R.ROUTE_COLUMNS) for d in data], ", ".join(f"{c} string" for c in R.ROUTE_COLUMNS))


def test_route_gate(spark):
    assert R.route_gate(route_rows(spark)).first().bridge_route_gate_passed
    assert R.route_gate(route_rows(spark, 1)).first().withheld_reason == "fewer_than_two_independently_identified_routes"
    for change in ({"amount_wei": "1.5"}, {"amount_wei": "0"}, {"route_id": " "}, {"verification_status": "pending"}, {"lane_activation_block": "0"}):
        assert R.route_gate(route_rows(spark, **change)).first().withheld_reason == "incomplete_message_or_contract_provenance"
    with pytest.raises(Q.ContractError):
        R.route_gate(route_rows(spark, message_id="same"))
    assert R.route_gate(route_rows(spark, 0)).first().withheld_reason == "no_message_level_route_events"
    with pytest.raises(Q.ContractError):
        R.route_gate(route_rows(spark).drop("route_id"))


def test_route_gate_counts_keys_in_tasks_that_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_KEYS", 10)
    dealt, original = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *columns: dealt.append(n) or original(self, n, *columns))
    assert R.route_gate(route_rows(spark, 20)).first().bridge_route_gate_passed
    assert dealt == [6]


def test_route_gate_counts_keys_not_hashes(spark, monkeypatch):
    """Keys that share a hash are no repeated keys; keys that repeat are told with and without a refusal."""
    monkeypatch.setattr(R.F, "xxhash64", lambda *columns: F.lit(7).cast("bigint"))
    assert R.route_gate(route_rows(spark, 3)).first().bridge_route_gate_passed
    row = R.route_gate(route_rows(spark, 3).union(route_rows(spark, 1)), strict=False).first()
    assert (row.event_rows, row.duplicate_source_keys, row.duplicate_destination_keys, row.duplicate_message_ids) == (4, 1, 1, 1)
    assert row.withheld_reason == "duplicate_route_keys"


def test_route_metrics(spark):
    data = [("w", f"m{i}", "c", "d", f"r{i}", a, "100", f"s{i}", f"t{i}", "onchain_verified_paired") for i, a in enumerate(["60", "40"])]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in R.METRIC_COLUMNS))
    out = R.route_metrics(df).first()
    assert out.route_hhi == pytest.approx(0.52) and out.normalized_route_hhi == pytest.approx(0.04)
    assert (out.bridge_reliance, out.largest_route_removal_loss, out.cross_chain_flow_wei) == (0.5, 0.6, "100")
    assert R.route_metrics_gate(df).first().gate_passed
    assert not R.route_metrics_gate(df.where("route_id = 'r0'")).first().gate_passed
    with pytest.raises(Exception, match="unverified or malformed"):
        R.route_metrics(df.withColumn("amount_wei", F.lit("-1"))).collect()


def test_duplicate_destination_pairs_nothing(spark):
    names = "message_id string, tx_hash string, log_index int, block_number int"
    source = spark.createDataFrame([("m1", "a", 0, 1), ("m2", "b", 0, 2), (None, "c", 0, 3)], names)
    target = spark.createDataFrame([("m1", "x", 0, 5), ("m1", "y", 0, 6), ("m2", "z", 1, 7)], names)
    paired, audit = R.pair_messages(source, target)
    from tallyweave.sources.fingerprint import dataset_fingerprint

    told = audit.first()
    for name, table in (("source", source), ("destination", target), ("paired", paired)):
        assert told[f"{name}_fingerprint"] == dataset_fingerprint(table).first().fingerprint
    assert R.duplicate_ids(target).count() == told.duplicate_destination_id_count
    assert [(r.message_id, r.destination_tx_hash) for r in paired.collect()] == [("m2", "z")]
    row = audit.first()
    assert (row.unmatched_source_count, row.duplicate_destination_id_count, row.paired_event_count) == (1, 1, 1)


def test_local_activity_of_any_length_needs_no_sorted_rows(spark, monkeypatch):
    """The largest of short, zero-padded and 78-digit texts, and an id that repeats, without an aggregate over sorted rows."""
    wide, less = "9" * 38 + "7" * 40, "9" * 38 + "6" * 40
    values = {"a": ["5", "0012", "9"], "b": [less, wide, "8" * 77], "c": ["0", "00", "0"], "d": ["9" * 38, "1" + "0" * 37, "0" * 50 + "3"]}
    data = [(w, f"{w}{i}", "1", "2", f"r{i % 2}", "7", v, "s", "d", "onchain_verified_paired") for w, texts in values.items() for i, v in enumerate(texts)]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in R.METRIC_COLUMNS))
    plans, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or cut(x))
    got = {r.week: r.local_activity_wei for r in R.route_metrics(df).collect()}
    assert got == {"a": "12", "b": wide, "c": "0", "d": "9" * 38}
    assert len(plans) == 2 and not any("SortAggregate" in p for p in plans)
    with pytest.raises(Q.ContractError, match="repeated message_id"):
        R.route_metrics(df.unionByName(df.limit(1)))
