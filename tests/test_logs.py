import hashlib
import gzip
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyweave.operators.contracts import ContractError, split_valid
from tallyweave.sources import actions, fingerprint, logs, sinks, transfers

A, B, C = ("0x" + d * 40 for d in "123")
POOL = "0x" + "ab" * 20
SPEC = {s.action: s for s in logs.EVENT_SPECS}


def word(value, kind="uint"):
    return value[2:].lower().rjust(64, "0") if kind == "address" else f"{int(value):064x}"


def log(action, topics, data, block=16, index=0, **extra):
    spec = SPEC[action]
    row = {
        "address": POOL,
        "topics": [spec.topic0, *["0x" + word(v, k) for v, (_, k) in zip(topics, spec.indexed)]],
        "data": "0x" + "".join(word(v, k) for v, (_, k) in zip(data, spec.data)),
        "blockHash": "0x" + "1" * 64,
        "blockNumber": hex(block),
        "transactionHash": "0x" + "2" * 64,
        "transactionIndex": "0x1",
        "logIndex": hex(index),
        "removed": False,
    }
    return {**row, **extra}


def frame(spark, records):
    return spark.createDataFrame([tuple(r[f.name] for f in logs.RAW_LOG.fields) for r in records], logs.RAW_LOG)


def test_supply_roles_and_amount(spark):
    big = 2**255 + 12345
    out = logs.decode_logs(frame(spark, [log("supply", [A, B, 7], [C, big])]), 1).first()
    assert (out.action, out.reserve_address, out.beneficiary_address, out.actor_address) == ("supply", A, B, C)
    assert (out.amount_raw, out.referral_code, out.block_number) == (str(big), 7, 16)
    assert out.counterparty_address is None


def test_withdraw_user_holds_two_roles(spark):
    out = logs.decode_logs(frame(spark, [log("withdraw", [A, B, C], [5])]), 1).first()
    assert (out.actor_address, out.beneficiary_address, out.counterparty_address) == (B, B, C)


def test_liquidation_has_two_assets_and_amounts(spark):
    out = logs.decode_logs(frame(spark, [log("liquidation", [A, B, C], [10, 20, A, 1])]), 1).first()
    assert (out.reserve_address, out.secondary_reserve_address) == (B, A)
    assert (out.amount_raw, out.secondary_amount_raw, out.receive_a_token, out.actor_address) == ("10", "20", True, A)


def test_malformed_logs_are_rejected_by_rule(spark):
    good = log("repay", [A, B, C], [9, 1])
    bad = {
        "topic_count": {**good, "topics": good["topics"][:3]},
        "known_topic": {**good, "topics": ["0x" + "9" * 64, *good["topics"][1:]]},
        "data_aligned": {**good, "data": good["data"][:-2]},
        "word_domain": log("repay", [A, B, C], [9, 2]),
        "data_word_count": {**good, "data": good["data"] + "0" * 64},
        "has_topics": {**good, "topics": []},
    }
    out = logs.decode_logs(frame(spark, [good, *bad.values()]), 1, strict=False).select("failed_rules").collect()
    assert out[0].failed_rules == []
    for (rule, _), row in zip(bad.items(), out[1:]):
        assert rule in row.failed_rules
    with pytest.raises(Exception, match="undecodable log"):
        logs.decode_logs(frame(spark, [bad["topic_count"]]), 1).collect()


def test_address_with_high_bits_is_rejected(spark):
    row = log("supply", [A, B, 7], [C, 1])
    row["topics"][2] = "0x" + "f" * 64
    out = logs.decode_logs(frame(spark, [row]), 1, strict=False).first()
    assert "word_domain" in out.failed_rules


def test_encode_inverts_decode(spark):
    raw = frame(spark, [log("borrow", [A, B, 3], [C, 77, 2, 99]), log("withdraw", [A, B, C], [5], index=1)])
    once = logs.decode_logs(raw, 1)
    again = logs.decode_logs(logs.encode_logs(once), 1)
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_light_decode_rejects_zero_beneficiary(spark):
    zero = "0x" + "0" * 40
    out = logs.decode_beneficiaries(frame(spark, [log("supply", [A, B, 7], [C, 1]), log("supply", [A, zero, 7], [C, 1])]))
    good, bad = split_valid(out)
    assert good.first().beneficiary_address == B and bad.first().failed_rules == ["nonzero_beneficiary"]


def test_message_decode(spark):
    raw = frame(spark, [log("supply", [A, B, 7], [C, 1]), log("withdraw", [A, B, C], [1], removed=None)])
    good, bad = split_valid(logs.decode_messages(raw, 5, 2))
    assert good.first().message_id == "0x" + word(B, "address")
    assert bad.first().failed_rules == ["not_removed"]


def test_chunks_cover_and_gaps_show(spark):
    plan = logs.build_chunks(spark.createDataFrame([(0, 10)], "first_block bigint, last_block bigint"), 4).withColumn("s", F.lit(1))
    assert [(r.from_block, r.to_block) for r in plan.orderBy("from_block").collect()] == [(0, 3), (4, 7), (8, 10)]
    assert logs.coverage_audit(plan, ["s"]).first().continuous_inclusive_coverage
    assert not logs.coverage_audit(plan.where("from_block <> 4"), ["s"]).first().continuous_inclusive_coverage
    overlap = plan.withColumn("from_block", F.when(F.col("from_block") == 8, 7).otherwise(F.col("from_block")))
    assert not logs.coverage_audit(overlap, ["s"]).first().continuous_inclusive_coverage


def test_missing_header_fails(spark):
    raw = logs.canonicalize_logs(frame(spark, [log("supply", [A, B, 7], [C, 1])]))
    headers = spark.createDataFrame([(17, 1000)], "block_number bigint, timestamp bigint")
    with pytest.raises(Exception, match="missing block header"):
        logs.attach_timestamps(raw, headers).collect()


def test_gzip_chunks_and_resumable_ingest(spark, tmp_path):
    from tallyweave.streaming.ingest import resumable_ingest

    source = tmp_path / "chunks"
    source.mkdir()

    def chunk(name, records):
        with gzip.open(source / name, "wt") as handle:
            handle.writelines(json.dumps(r) + "\n" for r in records)

    chunk("a.jsonl.gz", [log("supply", [A, B, 7], [C, 1], index=0), log("supply", [A, B, 7], [C, 1], index=1, block=999)])
    assert logs.read_raw_logs(spark, str(source)).count() == 2
    rules = logs.batch_rules(POOL, [SPEC["supply"].topic0], 0, 100)
    keys = ["block_number", "transactionHash", "log_index"]
    store = str(tmp_path / "store")

    def run():
        return resumable_ingest(spark, str(source), logs.RAW_LOG, store, rules, keys, transform=logs.canonicalize_logs)

    paths = run()
    assert spark.read.parquet(paths["accepted"]).count() == 1
    assert spark.read.parquet(paths["rejected"]).first().failed_rules == ["block_in_range"]
    chunk("b.jsonl.gz", [log("supply", [A, B, 7], [C, 1], index=5)])
    run()
    assert spark.read.parquet(paths["accepted"]).count() == 2
    receipts = spark.read.parquet(paths["receipts"]).collect()
    assert sorted(r.log_count for r in receipts) == [1, 2]
    for r in receipts:
        raw = (source / r.chunk.rsplit("/", 1)[1]).read_bytes()
        assert (r.content_bytes, r.content_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
    chunk("c.jsonl.gz", [log("supply", [A, B, 7], [C, 1], index=5)])
    with pytest.raises(Exception, match="repeated keys"):
        run()


def test_only_batches_that_may_hold_a_key_are_read(spark, tmp_path):
    from tallyweave.streaming import ingest

    ledger = str(tmp_path / "ledger")
    table = spark.range(9000).selectExpr("id DIV 3000 AS batch", "id AS block_number", "concat('x', id) AS name")
    for batch in range(3):
        ingest.batch_ledger(table.where(F.col("batch") == batch), ["block_number", "name"]).write.parquet(f"{ledger}/batch_id={batch}")
    keys = ["block_number", "name"]

    def suspects(condition, batch_id=9):
        return sorted(ingest.suspect_batches(spark, ledger, table.where(condition), keys, batch_id))

    for batch in range(3):
        for inside in (3000 * batch, 3000 * batch + 2999):
            assert suspects(F.col("block_number") == inside) == [batch]
    assert suspects("block_number IN (1, 4000, 8999)") == [0, 1, 2] and suspects("block_number = 1", 0) == []
    other = table.where("block_number % 100 = 7").withColumn("name", F.concat(F.lit("y"), "name"))
    seen = [ingest.suspect_batches(spark, ledger, other.where(F.col("block_number") == n), keys, 9) for n in range(7, 1000, 100)]
    assert sum(map(len, seen)) <= 1  # same blocks, other names
    assert ingest.suspect_batches(spark, str(tmp_path / "none"), table, keys, 9) == []


def test_transfer_normalisation(spark):
    data = [("2024-01-01", 1, "0xt", 0, 1, "0xAB", A, B, "1250000"), ("2024-01-01", 2, "0xu", 0, 1, "0xab", A, B, "1" + "0" * 60)]
    df = spark.createDataFrame(data, "timestamp string, block_number bigint, tx_hash string, log_index int, chain_id bigint, token_address string, from_address string, to_address string, raw_value string")
    assets = spark.createDataFrame([("test", "0xAb", 6)], "symbol string, address string, decimals int")
    out = rows(transfers.normalize_transfers(df, assets), "block_number")
    assert (out[1]["asset"], out[1]["value"], out[1]["raw_value"]) == ("TEST", 1.25, "1250000")
    assert out[2]["value"] == pytest.approx(1e54)
    with pytest.raises(ContractError):
        transfers.normalize_transfers(df, assets.union(assets))
    with pytest.raises(Exception, match="unconfigured token"):
        transfers.normalize_transfers(df, assets.withColumn("address", F.lit("0xother"))).collect()


def test_cleaning_refuses_bad_values(spark):
    columns = "timestamp timestamp, chain_id bigint, asset string, token_address string, from_address string, to_address string, value double"
    import datetime as dt

    ok = (dt.datetime(2024, 1, 1), 1, " gld ", A.upper().replace("0X", "0x"), A, B, 2.0)
    assert transfers.clean_transfers(spark.createDataFrame([ok], columns)).first().asset == "GLD"
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite and non-negative"):
            transfers.clean_transfers(spark.createDataFrame([(*ok[:-1], bad)], columns)).collect()
    with pytest.raises(Exception, match="invalid address"):
        transfers.clean_transfers(spark.createDataFrame([(*ok[:3], "0x12", *ok[4:])], columns)).collect()


def test_sinks_and_fingerprint(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") * 7 % 13).alias("v"))
    path = sinks.write_table(df.repartition(5), str(tmp_path / "t"), ["id"], fmt="csv", compression="gzip")
    back = spark.read.schema(df.schema).option("header", True).csv(path)
    one = fingerprint.dataset_fingerprint(df).first()
    assert one == fingerprint.dataset_fingerprint(back.repartition(3)).first()
    assert one != fingerprint.dataset_fingerprint(df.where("id < 99")).first()
    sinks.write_summary(fingerprint.run_summary(df, {"values": "v"}), str(tmp_path / "s"))
    assert json.loads(spark.read.text(str(tmp_path / "s")).first().value) == {"row_count": 100, "values": 13}
    assert sinks.manifest({"t": df}).first().row_count == 100
    df.withColumnsRenamed({"id": "log_index", "v": "actor_address"}).write.parquet(str(tmp_path / "a"))
    assert actions.read_actions(spark, str(tmp_path / "a"), columns=["actor_address"]).dtypes == [("actor_address", "string")]
