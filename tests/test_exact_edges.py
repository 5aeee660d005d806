"""Inputs that once gave a wrong or silent result: long numbers, repeated keys, absent weeks, null groups."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import columns as X
from tallyweave.functions import uint256
from tallyweave.operators import calendars as K
from tallyweave.operators import contracts as Q
from tallyweave.operators import inference as I
from tallyweave.operators import ordering as O
from tallyweave.operators import staggered as S
from tallyweave.operators.routes import ROUTE_COLUMNS, route_gate
from tallyweave.sources import logs, transfers

from conftest import rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, decimals, value",
    [("1.5e6", 6, 1.5), ("1" + "0" * 40, 18, 1e22), ("-25", 1, -2.5), (".5", 0, 0.5), ("+7.", 2, 0.07), ("123456789012345678", 18, 0.123456789012345678), ("5E-3", 0, 0.005)],
)
def test_transfer_amounts_of_any_length_and_form(spark, text, decimals, value):
    row = (dt.datetime(2024, 1, 1), 1, "0x1", 0, 1, "0xAA", "0xbb", "0xcc", text)
    frame = spark.createDataFrame([row], list(transfers.WAREHOUSE_COLUMNS))
    assets = spark.createDataFrame([("tok", "0xaa", decimals)], "symbol string, address string, decimals int")
    assert transfers.normalize_transfers(frame, assets).first().value == value


@pytest.mark.parametrize("text", ["", "abc", "1e", "1.2.3", "e5", "0x10", "nan"])
def test_transfer_amounts_that_are_no_numbers_fail(spark, text):
    row = (dt.datetime(2024, 1, 1), 1, "0x1", 0, 1, "0xaa", "0xbb", "0xcc", text)
    frame = spark.createDataFrame([row], list(transfers.WAREHOUSE_COLUMNS))
    assets = spark.createDataFrame([("tok", "0xaa", 2)], "symbol string, address string, decimals int")
    with pytest.raises(Exception, match="invalid raw token value"):
        transfers.normalize_transfers(frame, assets).collect()


def test_integers_beyond_decimals(spark):
    digits = "9" * 40
    assert one(spark, X.exact_integer_text(F.lit(f" +00{digits}"))) == digits
    assert one(spark, X.exact_integer_text(F.lit("-0"))) == "0" and one(spark, X.exact_integer_text(F.lit("-07"))) == "-7"
    assert one(spark, X.exact_integer_text(F.lit("1.0"))) is None and one(spark, X.exact_integer_text(F.lit(5.0), "double")) == "5"
    with pytest.raises(Exception, match="beyond 38 digits"):
        one(spark, X.exact_integer(F.lit(digits), "text"))


@pytest.mark.parametrize("value", [1.23456789012345e-9, 2.5e19, -1.5, 0.0, -0.0, 123456789012345.0, 1e15, 0.1, 999999999999999.9, 1e-300, -3.0])
def test_decimal_text_of_any_magnitude(spark, value):
    text = one(spark, X.significant_text(F.lit(value)))
    assert float(text) == float(f"{value:.14e}") and "e" not in text and not (("." in text) and text[-1] in "0.")


def test_decimal_text_of_no_number(spark):
    assert one(spark, X.significant_text(F.lit(math.nan))) is None and one(spark, X.significant_text(F.lit(math.inf))) is None


def test_sums_refuse_more_than_256_bits(spark):
    table = spark.createDataFrame([("1" * 79,)], ["a"])
    with pytest.raises(Exception, match="beyond 256 bits"):
        uint256.sum_uint256(table, [], "a").collect()


def test_tables_with_repeated_keys_differ(spark):
    once = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    more = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (None, "n")], "k int, v string")
    assert rows(Q.frames_equal(more, once, ["k"]), "k") == {1: {"k": 1, "differences": ["repeated_left"]}}
    assert rows(Q.frames_equal(once, more, ["k"]), "k")[1]["differences"] == ["repeated_right"]
    assert Q.frames_equal(once, once, ["k"]).count() == 0
    pairs = Q.reconcile(once.where("k = 1"), more, ["k"], {"v": ("v", "v")})
    assert pairs.first().mismatches == ["repeated"]
    index = spark.createDataFrame([("r", "x"), ("r", "x"), ("s", "y")], "id string, f string")
    issues = rows(Q.crosswalk(index, index.where("id = 's'"), "id", ["f"]), "id")
    assert issues["r"]["issues"] == "orphan_in_index;repeated_in_index" and issues["s"]["issues"] == ""


def test_placebo_needs_its_sides_alone(spark):
    gaps = spark.createDataFrame([("a", w, float(w)) for w in range(-6, 3) if w != -2], "chain string, event_week int, gap double")
    out = rows(I.placebo(gaps, ["chain"], [-2], 3), "chain")
    assert out["a"]["pseudo_event_week"] == -2 and out["a"]["gap_change"] == pytest.approx(0.0 - -4.0)
    with pytest.raises(Exception, match="incomplete placebo support"):
        I.placebo(gaps, ["chain"], [0], 3).collect()
    assert I.placebo(gaps, ["chain"], [0, 50], 3, strict=False).where("gap_change is null").count() == 2


def test_singular_designs_use_the_pseudo_inverse(spark):
    import numpy as np

    y = [1.0, 2.0, 4.0, 3.0]
    table = spark.createDataFrame([(i, 2.0, v) for i, v in enumerate(y)], "t int, x double, y double")
    fit = I.hac_ols(table, [], "y", ["x"], "t", 0).first()
    design = np.array([[1.0, 2.0]] * 4)
    inverse = np.linalg.pinv(design.T @ design)
    beta = inverse @ design.T @ np.array(y)
    scores = design * (np.array(y) - design @ beta)[:, None]
    cov = inverse @ scores.T @ scores @ inverse * 4 / 2
    assert [fit.coef_0, fit.coef_1] == pytest.approx(beta.tolist()) and [fit.se_0, fit.se_1] == pytest.approx(np.sqrt(np.diag(cov)).tolist())


def test_ranks_of_a_null_group(spark):
    table = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0)], "g string, v double")
    ranked = O.average_rank(table, ["g"], "v").collect()
    assert sorted((r.g or "", r.v, r.rank) for r in ranked) == [("", 1.0, 1.0), ("", 2.0, 2.0), ("a", 1.0, 1.0)]


def test_units_with_repeated_or_missing_periods(spark):
    panel = [("u", p, 0, float(p)) for p in (1, 2, 3)] + [("short", 1, 0, 1.0), ("short", 3, 0, 1.0)]
    schema = "unit string, period int, first int, y double"
    paths, periods = S.unit_paths(spark.createDataFrame(panel, schema), "unit", "period", "first", "y")
    assert [r.unit for r in paths.collect()] == ["u"] and periods == [1, 2, 3]
    assert [(r.unit, r.periods) for r in S.incomplete_units(spark.createDataFrame(panel, schema), "unit", "period").collect()] == [("short", 2)]
    twice = panel + [("twice", p, 0, 1.0) for p in (1, 1, 3)]
    with pytest.raises(Exception, match="repeated period"):
        S.unit_paths(spark.createDataFrame(twice, schema), "unit", "period", "first", "y")[0].collect()


def test_headers_that_disagree_fail(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b")], "block_number long, x string")
    t = dt.datetime(2024, 1, 1)
    same = spark.createDataFrame([(1, t), (1, t), (2, t)], ["block_number", "timestamp"])
    assert logs.attach_timestamps(log, same).count() == 2
    other = spark.createDataFrame([(1, t), (1, dt.datetime(2024, 1, 2)), (2, t)], ["block_number", "timestamp"])
    with pytest.raises(Exception, match="different headers"):
        logs.attach_timestamps(log, other).collect()


def test_donors_that_fail_a_clock_are_refused(spark):
    day = dt.datetime
    calendar = K.event_calendar(spark.createDataFrame([("c", day(2024, 1, 15))], ["cohort_id", "activation_utc"]), 1, 1)
    donors = [("d", "x", 1, day(2023, 1, 1), day(2025, 1, 1)), ("late", "y", 2, day(2024, 1, 14), day(2025, 1, 1))]
    table = spark.createDataFrame(donors, "cohort_id string, chain string, chain_id int, market_available_by_utc timestamp, own_anticipation_utc timestamp")
    assert K.donor_calendar(calendar, table.where("cohort_id = 'd'")).count() == 3
    with pytest.raises(Exception, match="does not cover"):
        K.donor_calendar(calendar, table).collect()
    assert {r.cohort_id for r in K.donor_calendar(calendar, table, strict=False).collect()} == {"d"}


def test_activation_anchor_must_lie_at_its_instant(spark):
    t = [dt.datetime(2024, 1, 1, 0, 0, s) for s in (0, 1, 1, 1, 2)]
    headers = spark.createDataFrame([("c", i, x) for i, x in enumerate(t)], "cohort_id string, block_number long, timestamp timestamp")

    def start(block, target):
        targets = spark.createDataFrame([("c", 0, target, block)], "cohort_id string, boundary_event_week int, target_utc timestamp, activation_block long")
        return K.boundary_blocks(headers, targets).first()

    assert start(None, t[1]).start_block == 1 and start(2, t[1]).start_block == 2
    assert start(2, t[1]).previous_block_timestamp == t[1] and start(None, t[1]).previous_block_timestamp == t[0]
    assert start(None, dt.datetime(2024, 1, 2)).start_block is None
    with pytest.raises(Exception, match="isn't at its instant"):
        start(4, t[1])


def gate_rows(**change):
    base = {c: "x" for c in ROUTE_COLUMNS}
    base |= {c: "5" for c in ROUTE_COLUMNS if c.endswith(("_block", "_index", "_wei", "_chain_id", "block_number"))}
    base |= {"verification_status": "onchain_verified"}
    out = []
    for i in range(2):
        row = base | {"route_id": f"r{i}", "message_id": f"m{i}", "source_tx_hash": f"s{i}", "destination_tx_hash": f"d{i}"}
        out.append(row | change)
    return out


@pytest.mark.parametrize("value, passes", [("+5", True), ("-0", False), ("5.5", False), ("7" * 40, True), (5.0, True), (5.5, False), (2.0**60, False), ("-3", False), (None, False)])
def test_route_integers_by_type(spark, value, passes):
    kind = "double" if isinstance(value, float) else "string"
    schema = ", ".join(f"{c} {kind if c == 'amount_wei' else 'string'}" for c in ROUTE_COLUMNS)
    table = spark.createDataFrame([tuple(r[c] for c in ROUTE_COLUMNS) for r in gate_rows(amount_wei=value)], schema)
    assert route_gate(table).first().bridge_route_gate_passed is passes


def test_decimal_text_of_means_equals_its_sql(spark, tmp_path):
    """Weeks of many customers: doubles become decimals by their text on both sides, to the last digit."""
    duckdb = pytest.importorskip("duckdb")
    from tallyweave.catalog import load

    queries, oracle = load()
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, 'S' || CAST(i % 40 AS VARCHAR) AS c_mktsegment, CAST(0 AS INTEGER) AS c_nationkey FROM range(4000) t(i)")
    con.execute(
        """CREATE TABLE orders AS SELECT i AS o_orderkey, CAST(hash(i) % 4000 AS BIGINT) AS o_custkey, '1-URGENT' AS o_orderpriority, CAST(1 AS DOUBLE) AS o_totalprice,
        TIMESTAMP '1998-02-01' + to_days(CAST(hash(i + 7) % 150 AS INTEGER)) AS o_orderdate FROM range(60000) t(i)"""
    )
    for name in ("customer", "orders"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    found = {tuple(row) for row in queries["a20_pre_post_decimal_text"](spark, str(tmp_path)).collect()}
    assert found == set(con.execute(oracle["a20_pre_post_decimal_text"]).fetchall())
