import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyweave.functions import uint256
from tallyweave.operators import concentration as C
from tallyweave.operators import panels as P


def weeks(spark, cells, chain="x"):
    data = [(chain, 1, week, unit) for week, unit in cells]
    return spark.createDataFrame(data, "chain string, chain_id bigint, event_week int, beneficiary_address string")


def test_participation_against_previous_week(spark):
    df = weeks(spark, [(-16, "a"), (-16, "a"), (-16, "b"), (-15, "b"), (-15, "c")])
    out = rows(P.participation_panel(df, ["chain", "chain_id"], -16, 16), "event_week")
    assert len(out) == 33
    first, second, third, last = out[-16], out[-15], out[-14], out[16]
    assert (first["event_count"], first["active_beneficiary_addresses"], first["entrant_addresses"]) == (3, 2, 2)
    assert first["beneficiary_hhi"] == pytest.approx(5 / 9)
    assert first["nakamoto_51"] == 1
    assert (second["entrant_addresses"], second["exit_addresses"], second["retained_addresses"]) == (1, 1, 1)
    assert (third["active_beneficiary_addresses"], third["exit_addresses"]) == (0, 2)
    assert last["event_count"] == 0 and last["beneficiary_gini"] == 0.0


def test_overlap(spark):
    a = weeks(spark, [(-16, "a"), (-16, "a"), (-16, "b"), (-15, "b"), (-15, "c")], "left")
    b = weeks(spark, [(-16, "a"), (-16, "d")], "right")
    out = rows(P.overlap_panel(a.unionByName(b), "chain", "left", "right", -16, 16), "event_week")
    assert out[-16]["shared_addresses"] == 1
    assert out[-16]["jaccard_overlap"] == pytest.approx(1 / 3)
    assert out[16]["jaccard_overlap"] == 0.0 and len(out) == 33


def test_beneficiary_bundle(spark):
    df = spark.createDataFrame([(u,) for u in ["0xa", "0xa", "0xb", "0xc"]], "beneficiary_address string")
    out = P.beneficiary_metrics(df, []).first()
    assert (out.event_count, out.active_beneficiary_addresses) == (4, 3)
    assert out.beneficiary_hhi == pytest.approx(0.375)
    assert out.top1_beneficiary_share == pytest.approx(0.5)
    assert out.inverse_hhi_beneficiary_addresses == pytest.approx(8 / 3)
    assert out.event_split_actor_hhi_lower == pytest.approx(0.25)


def test_incidence_counts_an_address_once_per_event(spark):
    df = spark.createDataFrame([("A", "A", None), ("A", "B", "")], "actor_address string, beneficiary_address string, counterparty_address string")
    out = P.incidence_concentration(df, []).first()
    assert (out.active_addresses, out.address_event_incidences) == (2, 3)
    assert out.effective_active_addresses == pytest.approx(1.8)


def test_reserve_sums_stay_apart(spark):
    data = [(1, 0, "supply", "r1", "t1", "a", "a", None, "5"), (1, 0, "supply", "r2", "t2", "a", "b", None, "700")]
    df = spark.createDataFrame(
        data, "chain_id bigint, event_week int, action string, reserve_address string, tx_hash string, actor_address string, beneficiary_address string, counterparty_address string, amount_raw string"
    )
    out = rows(P.reserve_panel(df, ["chain_id"]), "reserve_address")
    assert {k: v["total_amount_raw"] for k, v in out.items()} == {"r1": "5", "r2": "700"}


def test_calendar_week_panel(spark):
    df = spark.createDataFrame([(u,) for u in "aaab"], "beneficiary_address string")
    out = P.calendar_family_panel(df.withColumn("k", F.lit(1)), ["k"]).first()
    assert (out.event_count, out.active_beneficiary_addresses) == (4, 2)
    assert out.beneficiary_event_hhi == 0.625 and out.normalized_beneficiary_event_hhi == 0.25


def brute(counts, threshold=0.51):
    total, n = sum(counts), len(counts)
    shares = sorted((c / total for c in counts), reverse=True)
    cumulative, needed = 0.0, 0
    for s in shares:
        cumulative += s
        needed += 1
        if cumulative >= threshold:
            break
    ascending = sorted(counts)
    gini = 2 * sum((i + 1) * x for i, x in enumerate(ascending)) / (n * total) - (n + 1) / n
    return {
        "hhi": sum(s * s for s in shares),
        "entropy": -sum(s * math.log(s) for s in shares),
        "top5_share": sum(shares[:5]),
        "p10": sum(shares[: max(1, math.ceil(n * 0.10))]),
        "nakamoto": needed,
        "gini": gini,
    }


@pytest.mark.parametrize("real", [False, True])
def test_histogram_measures_match_brute_force(spark, real):
    rng = random.Random(7)
    groups = {g: [rng.choice([1, 1, 1, 2, 3, 50, 400]) * (1.25 if real else 1) for _ in range(rng.randint(1, 60))] for g in range(12)}
    groups[99] = [1000.0 if real else 1000] * 3  # one group of equal heavy units
    data = [(g, f"u{i}", float(w)) for g, ws in groups.items() for i, w in enumerate(ws)]
    df = spark.createDataFrame(data, "g int, u string, w double")
    units = df if real else df.withColumn("w", F.col("w").cast("bigint"))
    out = rows(
        C.concentration_of_units(units, ["g"], top=(5,), top_fraction={"p10": 0.10}, nakamoto=0.51, gini=True, real=real, weight="w"), "g"
    )
    for g, ws in groups.items():
        for name, value in brute(ws).items():
            assert out[g][name] == pytest.approx(value, abs=1e-12), (g, name)


def test_single_and_adjusted(spark):
    df = spark.createDataFrame([("g", "a"), ("g", "a"), ("h", "a"), ("h", "b")], "g string, u string")
    out = rows(C.concentration(df, ["g"], "u", top=()), "g")
    assert out["g"]["adjusted_hhi"] == 1.0 and out["g"]["normalized_entropy"] == 0.0
    assert out["h"]["adjusted_hhi"] == 0.0 and out["h"]["normalized_entropy"] == pytest.approx(1.0)


def test_hhi_derivative_matches_difference(spark):
    x, dx, h = [3.0, 1.0, 6.0], [0.5, -0.2, 0.1], 1e-6
    df = spark.createDataFrame(list(zip(x, dx)), "x double, dx double")

    def hhi(values):
        return sum(v * v for v in values) / sum(values) ** 2

    expected = (hhi([a + h * b for a, b in zip(x, dx)]) - hhi([a - h * b for a, b in zip(x, dx)])) / (2 * h)
    out = C.hhi_sensitivity(df, [], "x", "dx").first()
    assert out.hhi_derivative == pytest.approx(expected, rel=1e-6)


def test_uint256_sums_are_exact(spark):
    rng = random.Random(3)
    values = [rng.randrange(2**256) for _ in range(200)] + [2**256 - 1, 0]
    small = [v // 10**6 for v in values]
    df = spark.createDataFrame([(i % 3, str(v)) for i, v in enumerate(small)], "g int, v string")
    out = rows(uint256.sum_uint256(df, ["g"], "v"), "g")
    for g in range(3):
        assert out[g]["total"] == str(sum(v for i, v in enumerate(small) if i % 3 == g))


def test_hex_words_to_decimal(spark):
    rng = random.Random(5)
    values = [rng.randrange(2**256) for _ in range(100)] + [0, 1, 2**256 - 1, 2**64, 10**18]
    df = spark.createDataFrame([(i, f"{v:064x}") for i, v in enumerate(values)], "i int, w string")
    out = rows(df.select("i", uint256.hex_word_to_decimal("w").alias("d")), "i")
    assert all(out[i]["d"] == str(v) for i, v in enumerate(values))


def test_pre_post_text(spark):
    data = [("eth", w, 0.2 if w < 0 else 0.1) for w in range(-2, 3)]
    out = P.pre_post_decimal(spark.createDataFrame(data, "chain string, event_week int, h double"), ["chain"], "h").first()
    assert (out.pre_mean_h, out.post_mean_h, out.relative_change) == ("0.2", "0.1", "-0.5")
