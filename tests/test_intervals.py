"""Interval containment, as-of joins and what is built on them, against plain loops."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyweave.operators import bounds as B
from tallyweave.operators import calendars as K
from tallyweave.operators import intervals as I
from tallyweave.operators import sizing


def test_dyadic_blocks_part_an_interval(spark):
    rng = random.Random(1)
    data = [(a, a + rng.randrange(-2, 70)) for a in (rng.randrange(-90, 90) for _ in range(150))] + [(None, 3), (4, None), (0, 2**63 - 1), (-(2**63), 2**63 - 1), (7, 7)]
    found = spark.createDataFrame(data, "a long, b long").select("a", "b", I.dyadic_blocks(F.col("a"), F.col("b")).alias("x")).collect()
    for a, b, blocks in found:
        if a is None or b is None or b < a:
            assert not blocks
            continue
        spans = sorted((x["block"] << x["level"], (x["block"] + 1) << x["level"]) for x in blocks)
        low, high = max(a, -I.FAR), min(b, I.FAR)
        assert spans[0][0] == low and spans[-1][1] == high + 1 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert len(spans) <= 2 * max(1, (high - low + 1).bit_length())


def test_containment_is_an_equality_join(spark):
    rng = random.Random(2)
    points = [(i, rng.choice([None, rng.randrange(-40, 40)]), rng.randrange(3)) for i in range(80)]
    spans = [(i, a, a + rng.randrange(-1, 30), rng.randrange(3)) for i, a in ((i, rng.randrange(-40, 40)) for i in range(60))]
    left = spark.createDataFrame(points, "p long, at long, k int")
    right = spark.createDataFrame(spans, "s long, lo long, hi long, k int")
    joined = I.containing(left, right, "at", "lo", "hi", ["k"])
    wanted = {(p, s) for p, at, k in points for s, lo, hi, k2 in spans if at is not None and k == k2 and lo <= at <= hi}
    got = [(r.p, r.s) for r in joined.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("ties", [False, True])
def test_as_of(spark, forward, ties):
    rng = random.Random(3)
    events = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(60)])) for i in range(300)]
    marks = [(k, t, f"{k}{t}") for k in ("a", "b", "d") for t in rng.sample(range(60), 9)] + [("a", None, "no"), (None, 5, "no")]
    left = spark.createDataFrame(events, "i long, k string, t int").repartition(5)
    right = spark.createDataFrame(marks, "k string, u int, name string")
    got = {r.i: r.hit and r.hit.name for r in I.as_of(left, right, ["k"], "t", "u", "hit", ties, forward).collect()}
    assert len(got) == len(events)
    for i, k, t in events:
        near = [u for k2, u, _ in marks if k2 == k and k is not None and t is not None and u is not None and ((u > t if forward else u < t) or (ties and u == t))]
        want = (min(near) if forward else max(near)) if near else None
        assert got[i] == (None if want is None else f"{k}{want}")


def test_week_assignment_by_merging_ranges(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(c, w, 10 * w + rng.randrange(9)) for c in ("x", "y") for w in range(-5, 40)]
    events = [(rng.choice(["x", "y", "z"]), rng.randrange(-80, 420)) for _ in range(500)]
    boundaries = spark.createDataFrame(edges, "c string, boundary_event_week int, start_block long")
    table = spark.createDataFrame(events, "c string, block_number long")
    small = sorted((r.c, r.block_number, r.event_week) for r in K.assign_weeks(table, boundaries, ["c"], strict=False).collect() if r.event_week is not None)
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 3)
    merged = K.assign_weeks(table, boundaries, ["c"], strict=False).collect()
    assert len(merged) == len(events)
    assert sorted((r.c, r.block_number, r.event_week) for r in merged if r.event_week is not None) == small and small
    with pytest.raises(Exception, match="outside the panel"):
        K.assign_weeks(table, boundaries, ["c"]).collect()


def test_boundaries_and_periods_of_many_targets(spark, monkeypatch):
    rng = random.Random(5)
    headers = spark.createDataFrame([(c, b, 3 * (b // 3) + rng.randrange(2)) for c in ("x", "y") for b in range(100, 200)], "cohort_id string, block_number long, timestamp int")
    headers = headers.withColumn("timestamp", F.timestamp_seconds("timestamp"))
    wanted = [(c, w, 95 + 5 * w, 130 if (c, w) == ("x", 99) else None) for c in ("x", "y") for w in range(24)]
    targets = spark.createDataFrame(wanted, "cohort_id string, boundary_event_week int, t int, activation_block long")
    targets = targets.select("cohort_id", "boundary_event_week", F.timestamp_seconds("t").alias("target_utc"), "activation_block")
    few = sorted(map(tuple, K.boundary_blocks(headers, targets).collect()), key=str)
    monkeypatch.setattr(K, "SLOTS", 2)
    assert sorted(map(tuple, K.boundary_blocks(headers, targets).collect()), key=str) == few and len(few) == 48
    weeks = spark.createDataFrame([(i, rng.choice([None, rng.randrange(-9, 9)])) for i in range(60)], "i int, event_week int")
    periods = spark.createDataFrame([(f"p{i}", a, a + rng.randrange(6)) for i, a in enumerate(range(-9, 9))], "period string, minimum_event_week int, maximum_event_week int")
    near = sorted((r.i, r.period) for r in K.assign_periods(weeks, periods).collect())
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 2)
    assert sorted((r.i, r.period) for r in K.assign_periods(weeks, periods).collect()) == near and near


def test_stacked_panels_equal_single_groupings(spark):
    rng = random.Random(6)
    events = [(b, rng.randrange(3), rng.choice(["supply", "repay"]), f"u{rng.randrange(7)}", rng.random() < 0.4) for b in range(90)]
    panel = spark.createDataFrame(events, "block_number long, event_week int, action string, beneficiary_address string, odd boolean")
    links = [(f"l{i}", f"u{rng.randrange(7)}", f"u{rng.randrange(7)}", rng.randrange(40), rng.randrange(40, 120)) for i in range(12)]
    constraints = spark.createDataFrame(links, "constraint_id string, left_address string, right_address string, valid_from_block long, valid_to_block long")
    periods = spark.createDataFrame([("pre", 0, 1), ("post", 1, 2)], "period string, minimum_event_week int, maximum_event_week int")
    by_action, weekly, by_period = B.bound_panels(panel, constraints, periods, 0, 2, ["supply", "repay"], {"odd_share": "odd"})
    for out, keys, source in (
        (by_action, ["event_week", "action"], panel), (weekly, ["event_week"], panel), (by_period, ["period"], K.assign_periods(panel, periods)),
    ):
        alone = rows(B.identified_set(source, constraints, keys, flags={"odd_share": "odd"}), *keys)
        got = rows(out, *keys)
        assert set(got) == set(alone)
        for at, row in alone.items():
            assert {k: pytest.approx(v) for k, v in row.items()} == {k: got[at][k] for k in row}
        for at, row in alone.items():
            mine = [e for e in events if (e[1] == at if keys == ["event_week"] else (e[1], e[2]) == at if len(keys) == 2 else (0 if at == "pre" else 1) <= e[1] <= (1 if at == "pre" else 2))]
            low, high = min(e[0] for e in mine), max(e[0] for e in mine)
            assert row["accepted_must_link_constraint_count"] == sum(a <= low and b >= high for *_, a, b in links)


def test_large_interval_sides_are_not_broadcast(spark):
    """Blocks are many more than Spark expects of a narrow table: the join must not be planned from its estimate."""
    many = sizing.BROADCAST_ROWS + 10
    points = spark.range(many).select(F.col("id").alias("address"), (F.col("id") % 1000).alias("at"))
    spans = spark.range(many).select(F.col("id").alias("address"), F.lit(0).cast("long").alias("a"), F.lit(1023).cast("long").alias("b"))
    found = I.containing(points, spans, "at", "a", "b", ["address"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == many


def test_links_of_many_units_are_not_broadcast(spark):
    units = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("address"), F.lit(1).alias("weight"))
    spans = spark.createDataFrame([(1, 5, 8)], "g int, minimum_block long, maximum_block long")
    links = spark.range(4000).select(
        F.col("id").alias("constraint_id"), F.col("id").alias("left_address"), (F.col("id") + 1).alias("right_address"),
        (F.col("id") % 7).alias("valid_from_block"), F.when(F.col("id") % 2 == 0, 9).otherwise(F.col("id") % 10).cast("long").alias("valid_to_block"),
    )
    present = B.present_links(units, spans, links, ["g"])
    plan = present._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(strategy=merge)") == 2
    expected = {(i, i + 1) for i in range(4000) if i % 7 <= 5 and (9 if i % 2 == 0 else i % 10) >= 8}
    assert {(row.src, row.dst) for row in present.collect()} == expected
