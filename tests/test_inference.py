import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyweave.operators import calendars as K
from tallyweave.operators import design as D
from tallyweave.operators import inference as I
from tallyweave.operators import staggered as S
from tallyweave.operators.contracts import ContractError

SPECS = "specification string, pre_min int, pre_max int, post_min int, post_max int, lag int"


def test_two_by_two(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.5), (1, 0, 2.0), (1, 1, 4.5)], "treated int, post int, y double")
    assert I.two_by_two(df, [], "y").first().estimate == pytest.approx(2.0)
    with pytest.raises(Exception, match="empty cell"):
        I.two_by_two(df.where("treated = 0 OR post = 0"), [], "y").collect()


def dense_hac(y, x, t, lag):
    y, x = np.array(y), np.array(x)
    n, k = x.shape
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    u = y - x @ beta
    meat = np.zeros((k, k))
    for i in range(n):
        for j in range(n):
            d = abs(t[i] - t[j])
            if d <= lag:
                meat += (1 - d / (lag + 1)) * u[i] * u[j] * np.outer(x[i], x[j])
    cov = inverse @ meat @ inverse * (n / (n - k) if n > k else 1)
    return beta, np.sqrt(np.diag(cov)), cov


@pytest.mark.parametrize("width", [1, 3])
def test_hac_matches_dense_formula(spark, width):
    rng = random.Random(width)
    data, groups = [], {}
    for g in range(4):
        t = sorted(rng.sample(range(-20, 20), 15))
        x = [[1.0, *[rng.gauss(0, 1) for _ in range(width)]] for _ in t]
        y = [rng.gauss(0, 1) + row[1] for row in x]
        groups[g] = (y, x, t)
        data += [(g, a, b, *row[1:]) for a, b, row in zip(t, y, x)]
    names = [f"x{i}" for i in range(width)]
    df = spark.createDataFrame(data, "g int, t int, y double, " + ", ".join(f"{n} double" for n in names))
    out = rows(I.hac_ols(df, ["g"], "y", names, "t", 3), "g")
    adjacent = rows(I.hac_ols(df, ["g"], "y", names, "t", 3, row_adjacent=True), "g")
    for g, (y, x, t) in groups.items():
        beta, se, _ = dense_hac(y, x, t, 3)
        assert [out[g][f"coef_{i}"] for i in range(width + 1)] == pytest.approx(list(beta))
        assert [out[g][f"se_{i}"] for i in range(width + 1)] == pytest.approx(list(se))
        _, se, _ = dense_hac(y, x, list(range(len(t))), 3)
        assert [adjacent[g][f"se_{i}"] for i in range(width + 1)] == pytest.approx(list(se))


def gaps(spark, effect=2.0, noise=0.0):
    rng = random.Random(5)
    data = [("o", w, 1.0 + (effect if w >= 1 else 0.0) + noise * rng.gauss(0, 1)) for w in range(-16, 17)]
    return spark.createDataFrame(data, "outcome_id string, event_week int, gap double")


def test_constant_gap_recovers_effect(spark):
    spec = spark.createDataFrame([("s", -16, -9, 1, 16, 3)], SPECS)
    out = I.did_estimates(gaps(spark), ["outcome_id"], spec, 3).first()
    assert out.estimate == pytest.approx(2.0) and out.n == 24
    assert abs(I.pretrend(gaps(spark), ["outcome_id"], -16, -9, 2).first().gap_slope_per_event_week) < 1e-12
    assert all(abs(r.gap_change) < 1e-12 for r in I.placebo(gaps(spark), ["outcome_id"], [-13, -12, -11], 2).collect())
    study = rows(I.event_study(gaps(spark), ["outcome_id"], -16, -9), "event_week")
    assert study[5]["gap_relative_to_clean_pre_mean"] == pytest.approx(2.0)
    with pytest.raises(Exception, match="incomplete placebo"):
        I.placebo(gaps(spark), ["outcome_id"], [-16], 2).collect()


def test_degenerate_and_p_values(spark):
    df = spark.createDataFrame([(1.96, 1.0), (0.5, 0.0)], "e double, s double")
    out = rows(I.normal_diagnostic(df, "e", "s"), "e")
    assert out[1.96]["normal_approx_p_value"] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-8)
    assert math.isnan(out[0.5]["normal_approx_p_value"]) and out[0.5]["ci_lower"] == 0.5


def test_ledger_has_42_rows(spark):
    both = gaps(spark, noise=2.0).union(gaps(spark, noise=3.0).withColumn("outcome_id", F.lit("p")))
    rng = random.Random(9)
    panel = spark.createDataFrame([(c, w, rng.randint(5, 50), rng.random()) for c in "xy" for w in range(-16, 17)], "chain string, event_week int, active int, hhi double")
    ledger = I.uncertainty_ledger(panel, both, {"o": "O", "p": "P"}, {"active": "A", "hhi": "H"}, "change")
    out = rows(ledger, "analysis_family", "outcome", "term", "specification")
    assert len(out) == 42 and len({k[0] for k in out}) == 6
    assert I.ledger_gate(ledger).first().gate_passed
    series = [(r.event_week, r.gap) for r in both.where("outcome_id = 'o'").collect() if r.event_week <= -9 or r.event_week >= 1]
    t, y = [a for a, _ in series], [b for _, b in series]
    x = [[1.0, w, float(w >= 1), w * float(w >= 1)] for w in t]
    beta, se, cov = dense_hac(y, x, t, 2)
    level = out[("Primary controlled ITS", "O", "cITS level shift at week 0", "primary")]
    assert (level["estimate"], level["hac_standard_error"]) == (pytest.approx(beta[2]), pytest.approx(se[2]))
    wald = float(beta[2:] @ np.linalg.pinv(cov[2:, 2:]) @ beta[2:])
    joint = out[("Primary controlled ITS", "O", "Joint level-and-slope shift", "primary")]
    assert joint["test_statistic"] == pytest.approx(wald, rel=1e-6) and joint["two_sided_p_value"] == pytest.approx(math.exp(-wald / 2), rel=1e-5, abs=1e-300)


def staggered(spark, noise=0.0):
    rng = random.Random(3)
    data = []
    for u in range(40):
        g = [0, 4, 6][u % 3]
        for t in range(1, 9):
            y = u * 0.1 + t * 0.3 + (1.5 if g and t >= g else 0.0) + noise * rng.gauss(0, 1)
            data.append((u, t, g, y))
    return spark.createDataFrame(data, "unit_id int, period_id int, first_treat_period int, outcome double")


def test_constant_effect_in_every_post_cell(spark):
    att = S.group_time_att(staggered(spark), "unit_id", "period_id", "first_treat_period", "outcome")
    for r in att.collect():
        assert r.att == pytest.approx(1.5 if r.t >= r.g else 0.0, abs=1e-9)
    assert S.dynamic_effects(att).first().overall_att == pytest.approx(1.5)


def test_bootstrap_is_close_to_the_analytic_error(spark):
    draws, out = S.multiplier_bootstrap(staggered(spark, 1.0), "unit_id", "period_id", "first_treat_period", "outcome", draws=199)
    ratio = [r.bootstrap_se / r.se for r in out.collect()]
    assert 0.7 < float(np.mean(ratio)) < 1.3
    assert "bootstrap_se" in S.dynamic_effects(out, draws).columns


def test_twfe_matches_dense_regression(spark):
    panel = staggered(spark, 0.5).withColumns(
        {"treated": (F.col("first_treat_period") > 0).cast("int"), "event_time": F.when(F.col("first_treat_period") > 0, F.col("period_id") - F.col("first_treat_period"))}
    )
    panel = panel.where("NOT (unit_id = 3 AND period_id = 2)")  # unbalanced
    data = panel.collect()
    times = sorted({r.event_time for r in data if r.treated and r.event_time != -1})
    units, periods = sorted({r.unit_id for r in data}), sorted({r.period_id for r in data})
    x = np.array([[float(r.treated and r.event_time == t) for t in times] + [float(r.unit_id == u) for u in units] + [float(r.period_id == p) for p in periods[1:]] for r in data])
    beta = np.linalg.lstsq(x, np.array([r.outcome for r in data]), rcond=None)[0]
    residual = np.array([r.outcome for r in data]) - x @ beta
    fitted = rows(S.twfe_event_study(panel, "unit_id", "period_id", "event_time", "treated", "outcome"), "event_time")
    # only differences between event times and the reference are pinned down by the design
    assert set(fitted) == set(times)
    design = x[:, : len(times)]
    mine = np.array([fitted[t]["estimate"] for t in times])
    other = x[:, len(times):]
    rest = np.linalg.lstsq(other, np.array([r.outcome for r in data]) - design @ mine, rcond=None)[0]
    again = np.array([r.outcome for r in data]) - design @ mine - other @ rest
    assert float(again @ again) == pytest.approx(float(residual @ residual), rel=1e-6)


def ts(text):
    import datetime as dt

    return dt.datetime.fromisoformat(text)


def test_week_assignment(spark):
    edges = spark.createDataFrame([("c", -1, 10), ("c", 0, 20), ("c", 1, 30)], "cohort_id string, boundary_event_week int, start_block bigint")
    events = spark.createDataFrame([("c", b) for b in (10, 19, 20, 29)], "cohort_id string, block_number bigint")
    out = rows(K.assign_weeks(events, edges, ["cohort_id"]), "block_number")
    assert {b: r["event_week"] for b, r in out.items()} == {10: -1, 19: -1, 20: 0, 29: 0}
    for outside in (9, 30):
        with pytest.raises(Exception, match="outside the panel"):
            K.assign_weeks(spark.createDataFrame([("c", outside)], "cohort_id string, block_number bigint"), edges, ["cohort_id"]).collect()


def test_calendar_has_33_half_open_weeks(spark):
    cohort = spark.createDataFrame([("c", ts("2024-07-02T15:40:32"))], "cohort_id string, activation_utc timestamp")
    out = rows(K.event_calendar(cohort, 16, 16), "event_week")
    assert len(out) == 33 and out[0]["window_start_utc"] == ts("2024-07-02T15:40:32")
    assert out[-1]["window_end_utc_exclusive"] == out[0]["window_start_utc"]
    assert K.boundary_targets(K.event_calendar(cohort, 16, 16)).count() == 34
    assert K.periods_partition(K.DESIGN_PERIODS, -16, 16)


def treatments(spark, bundled=False):
    data = [(f"c{i}", "chain", i, bundled and i == 0, ts("2025-01-01"), ts("2025-03-01")) for i in range(3)]
    return spark.createDataFrame(data, "cohort_id string, chain string, chain_id int, bundled_market_entry boolean, formal_commitment_utc timestamp, operational_activation_utc timestamp")


def donors(spark):
    data = [("d1", "D", 11, "verified", ts("2020-01-01"), "0xD1"), ("d2", "D", 12, "verified", ts("2020-01-01"), "0xD2"), ("d3", "D", 13, "failed", ts("2020-01-01"), "0xD3")]
    return spark.createDataFrame(data, "market_id string, chain string, chain_id int, status string, first_seen_utc timestamp, pool_address string")


def test_support_and_plan(spark):
    support = D.contemporaneous_support(treatments(spark), donors(spark))
    assert support.where("support_gate").count() == 6
    bundled = D.contemporaneous_support(treatments(spark, True), donors(spark))
    assert bundled.where("support_gate").count() == 4
    assert all(r.mvp_gate for r in D.support_summary(support).collect())
    markets = spark.createDataFrame([("M", i, f"0xM{i}", "verified_locked_registry") for i in range(3)], "chain string, chain_id int, pool_address string, verification_status string")
    jobs, scans = D.acquisition_plan(support, treatments(spark), markets, donors(spark))
    row = D.plan_summary(jobs, scans).first()
    assert (row.analysis_count, row.unit_job_count, row.deduplicated_chain_scans, row.plan_valid) == (6, 18, 5, True)
    with pytest.raises(ContractError):
        D.acquisition_plan(support, treatments(spark), markets.where("chain_id < 2"), donors(spark))
    gate = D.verification_gate(donors(spark), 2).first()
    assert (gate.selected, gate.verified, gate.support_audit_eligible, gate.all_verified) == (3, 2, True, False)


def test_an_absent_chain_breaks_the_common_panel(spark):
    from tallyweave.operators.inference import common_panel

    panel = spark.createDataFrame([("a", w, w + 5) for w in range(-2, 3)] + [("b", 9, 1)], "chain string, event_week int, active int")
    weeks = panel.select("event_week").distinct()
    whole = panel.where("chain = 'a'")
    assert common_panel(whole, weeks, ["chain"], "active", -2, 2).count() == 5
    assert common_panel(whole, weeks, ["chain"], "active", -2, 2, expected=[("a",)]).count() == 5
    for table, expected in ((whole, [("a",), ("c",)]), (panel, None)):
        with pytest.raises(ValueError, match="lacks one row per week"):
            common_panel(table, weeks, ["chain"], "active", -2, 2, expected=expected)


def test_repeated_rows_reach_a_unit_once(spark, monkeypatch):
    """Rows of a unit, period and event time are added up before anything else; estimates and errors are those of all rows."""
    from tallyweave.operators import staggered

    rng = np.random.default_rng(3)
    data = []
    for u in range(24):
        first = (0, 3, 4)[u % 3]
        data += [(u, p, p - first if first else None, int(first > 0), float(rng.normal() + u)) for p in range(6) for _ in range(1 + (u + p) % 3) if (u + p) % 7]
    df = spark.createDataFrame(data, "u int, p int, e int, d int, y double")
    written, cut = [], staggered.cut
    monkeypatch.setattr(staggered, "cut", lambda x: written.append(cut(x)) or written[-1])
    got = {r.event_time: r for r in staggered.twfe_event_study(df, "u", "p", "e", "d", "y").collect()}
    assert written[0].count() == len({r[:2] for r in data}) < len(data)
    units, periods, times = sorted({r[0] for r in data}), sorted({r[1] for r in data})[1:], sorted({r[2] for r in data if r[2] not in (None, -1)})
    x = np.array([[u == r[0] for u in units] + [p == r[1] for p in periods] + [t == r[2] for t in times] for r in data], float)
    y = np.array([r[4] for r in data])
    inverse = np.linalg.pinv(x.T @ x)
    beta = np.linalg.pinv(x) @ y
    assert np.linalg.matrix_rank(x) == x.shape[1]
    assert [got[t].estimate for t in times] == pytest.approx(beta[-len(times) :], abs=1e-8)
    scores = np.array([x[[r[0] == u for r in data]].T @ (y - x @ beta)[[r[0] == u for r in data]] for u in units])
    variance = np.diag(inverse @ scores.T @ scores @ inverse)[-len(times) :]
    params = len(times) + len(periods) + 1
    scale = len(units) / (len(units) - 1) * (len(data) - 1) / (len(data) - params)
    assert [got[t].cluster_se for t in times] == pytest.approx(np.sqrt(variance * scale), abs=1e-8)
