"""Registered queries against their SQL on the smallest tables (a quick cross-section)."""

import math

import duckdb
import pytest

from tallyweave.catalog import load

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = load()
SAMPLE = [
    "a02_adjusted_and_normalized", "a07_weekly_participation", "a10_reserve_week_action_panel", "a15_address_universe", "a26_population_overlap",
    "s07_decode_logs", "s12_resumable_ingest", "s14_dataset_fingerprint", "q02_duplicate_keys", "q15_frames_equal", "j05_first_block_at_or_after",
    "j13_table_diff", "w02_average_rank", "w06_audit_sample", "g01_role_graph", "i02_i05_hac_difference_in_changes", "j12_plan_summary",
]


def canonical(rows, order):
    def text(v):
        if v is None:
            return "~"
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return v.isoformat() if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(text(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    result = sql.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    ordered = sorted(names)
    left = canonical([tuple(r) for r in df.collect()], [df.columns.index(c) for c in ordered])
    assert left == canonical(result.fetchall(), [names.index(c) for c in ordered])


def test_a_promoted_estimate_stops_the_release(spark):
    from tallyweave.catalog.studies import released

    with pytest.raises(Exception, match="promoted past"):
        released(spark, FOLDER, "causal").collect()


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) - len(ORACLE) < 20


def test_diff_status_reads_its_sides_once_in_no_fixed_number_of_tasks(spark, sql, monkeypatch):
    dealt, original = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *columns: dealt.append(n) or original(self, n, *columns))
    out = QUERIES["j13_diff_status"](spark, FOLDER)
    assert not any(isinstance(n, int) for n in dealt)
    assert not any(path.endswith("events.parquet") for path in out.inputFiles())
    result = sql.execute(ORACLE["j13_diff_status"])
    names = sorted(d[0] for d in result.description)
    assert canonical([tuple(r) for r in out.select(*names).collect()], range(len(names))) == canonical(result.fetchall(), [[d[0] for d in result.description].index(c) for c in names])
