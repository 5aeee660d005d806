import random

import numpy as np
from conftest import rows

from tallyweave.operators import ordering as O


def test_group_ordinal(spark):
    rng = random.Random(1)
    data = [(rng.choice("aab"), rng.randrange(5), i) for i in range(300)]
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(7)
    out = rows(O.group_ordinal(df, ["g"], ["v", "i"]), "i")
    for g in "ab":
        ordered = sorted((v, i) for k, v, i in data if k == g)
        assert [out[i]["ordinal"] for _, i in ordered] == list(range(1, len(ordered) + 1))


def average_ranks(values):
    ordered = sorted(values)
    return [np.mean([i + 1 for i, x in enumerate(ordered) if x == v]) for v in values]


def test_average_rank_and_spearman(spark):
    rng = random.Random(2)
    data = [(rng.choice([-1.5, 0.0, 2.0, 3.25, 1e9]), rng.random() if rng.random() < 0.7 else 0.5) for _ in range(80)]
    df = spark.createDataFrame(data, "x double, y double")
    out = rows(O.average_rank(df, [], "x"), "x")
    expected = dict(zip([x for x, _ in data], average_ranks([x for x, _ in data])))
    assert {x: r["rank"] for x, r in out.items()} == expected
    rho = np.corrcoef(average_ranks([x for x, _ in data]), average_ranks([y for _, y in data]))[0, 1]
    assert abs(O.spearman(df, [], "x", "y").first().spearman - rho) < 1e-9
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert O.spearman(flat, [], "x", "y").first().spearman == 0.0


def test_sample_windows_round_half_even(spark):
    df = spark.createDataFrame([(b,) for b in (10, 20, 30, 40, 50, 60)] * 2, "block bigint")
    out = sorted((r.from_block, r.to_block) for r in O.sample_windows(df, "block", 3, 4, 10, 60).collect())
    picks = [[10, 20, 30, 40, 50, 60][round(i * 5 / 2)] for i in range(3)]
    expected = sorted({(min(max(10, b - 2), 57), min(60, min(max(10, b - 2), 57) + 3)) for b in picks})
    assert out == expected
    assert O.sample_windows(df, "block", 1, 4, 10, 60).first().from_block == 38


def test_audit_sample_is_stable(spark):
    data = [(f"a{i}", i % 2 == 0, i % 7) for i in range(60)]
    df = spark.createDataFrame(data, "address string, contract boolean, n int")
    first = {r.address for r in O.audit_sample(df, 12, "contract", "n", "address", "s").collect()}
    again = {r.address for r in O.audit_sample(df.repartition(5), 12, "contract", "n", "address", "s").collect()}
    assert first == again and len(first) == 12
