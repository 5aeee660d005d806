"""End-to-end study paths on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.catalog.entities import LINKS, PERIOD_ACTIONS, REGISTRY, address_labels, bound_sql, code_records, links, periods
from tallyweave.catalog.gates import boundary_table
from tallyweave.catalog.panels import order_panel
from tallyweave.catalog.registry import ACTIONS, ORDER_ACTIONS, query, r, rounded
from tallyweave.catalog.sources import SRC
from tallyweave.operators import bounds as B
from tallyweave.operators import calendars as K
from tallyweave.operators import entities, panels
from tallyweave.operators.sizing import with_scalar
from tallyweave.plans import studies
from tallyweave.sources import tables as T

NAMES = ["borrow", "liquidation", "repay", "supply", "withdraw"]


@query(
    "study_panels_from_logs",
    f"""WITH {SRC}, d AS (SELECT action, date_diff('day', DATE '2024-01-15', CAST(ts AS DATE)) AS w, event_id FROM src WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-29'),
sp AS (SELECT w, action FROM range(-13, 14) t(w), (SELECT DISTINCT action FROM src))
SELECT CAST(1 AS BIGINT) AS chain_id, sp.w AS event_week, sp.action, count(event_id) AS event_count FROM sp LEFT JOIN d ON d.w = sp.w AND d.action = sp.action GROUP BY ALL""",
)
def panels_from_logs(spark, folder):
    boundaries = boundary_table(spark, folder).select("boundary_event_week", "start_block")
    out = studies.panels_from_logs(T.raw_logs(spark, folder), boundaries, 1, -13, 13, NAMES, strict=False)["weekly_action"]
    return rounded(out.select("chain_id", "event_week", "action", "event_count"))


@query(
    "study_snapshots_from_transfers",
    f"""WITH {SRC}, t AS (SELECT CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS VARCHAR)[1:10] AS period, 'TOK' || CAST(k % 5 + 1 AS VARCHAR) AS asset, k AS f, user_id AS u, cents / pow(CAST(10 AS DOUBLE), 2 * (k % 5 + 1)) AS v FROM src)
SELECT period, CAST(1 AS BIGINT) AS chain_id, asset, (SELECT count(*) FROM (SELECT f FROM t x WHERE x.period = t.period AND x.asset = t.asset UNION SELECT u FROM t x WHERE x.period = t.period AND x.asset = t.asset)) AS active_nodes,
 count(DISTINCT (f, u)) FILTER (f <> u) AS edge_count, {r('sum(v)', 7)} AS total_value FROM t GROUP BY period, asset""",
)
def snapshots_from_transfers(spark, folder):
    from tallyweave.sources import transfers

    raw = transfers.scan_transfers(spark, T.warehouse_transfers(spark, folder), "2024-01-01", "2024-01-31", [f"0xcccccccc{n:032x}" for n in range(1, 6)])
    assets = raw.select(F.col("token_address").alias("address")).distinct()
    index = F.conv(F.substring("address", 42, 1), 16, 10).cast("int")
    assets = assets.select("address", F.concat(F.lit("tok"), index.cast("string")).alias("symbol"), (index * 2).alias("decimals"))
    out = studies.snapshots_from_transfers(raw, assets, None)
    out = out.select(F.col("period").cast("string").alias("period"), "chain_id", "asset", "active_nodes", "edge_count", "total_value")
    return rounded(out, 7)


@query(
    "study_comparison",
    f"""WITH {ORDER_ACTIONS}, u AS (SELECT chain, event_week, count(DISTINCT beneficiary_address) AS a FROM order_actions GROUP BY ALL),
g AS (SELECT x.event_week, x.a - y.a AS gap FROM u x JOIN u y USING (event_week) WHERE x.chain = 'MACHINERY' AND y.chain = 'BUILDING')
SELECT 'active' AS outcome_id, 'all_weeks' AS specification, count(*) FILTER (event_week <> 0) AS n, {r('avg(gap) FILTER (event_week > 0) - avg(gap) FILTER (event_week < 0)', 8)} AS estimate FROM g""",
)
def comparison(spark, folder):
    from tallyweave.catalog.inference import specs

    panel = order_panel(spark, folder)
    out = studies.comparison_study(panel, "chain", "MACHINERY", "BUILDING", {"active": "active"}, specs(spark, [("all_weeks", -400, -1, 1, 400, 3)]), 3)
    return rounded(out["estimates"].select("outcome_id", "specification", "n", "estimate"), 8)


@query(
    "study_entity_layer",
    f"""WITH {ACTIONS}, {REGISTRY}, t AS (SELECT count(*) FILTER (econ) AS resolved FROM rg)
SELECT 'address_types' AS part, kind || '/' || presence AS name, count(*) AS addresses, CAST(sum(ev) AS BIGINT) AS incidences FROM rg GROUP BY kind, presence
UNION ALL SELECT 'infrastructure', family, count(*), CAST(sum(ev) AS BIGINT) FROM rg WHERE contract GROUP BY family
UNION ALL SELECT 'registry', 'all', count(*), CAST(sum(ev) AS BIGINT) FROM rg
UNION ALL SELECT 'weekly_action', 'cells', {(T.LAST_DAY - T.FIRST_DAY + 1) * len(T.ACTIONS)}, CAST(sum(ev) AS BIGINT) FROM rg
UNION ALL SELECT 'weekly', 'cells', {T.LAST_DAY - T.FIRST_DAY + 1}, CAST(sum(ev) AS BIGINT) FROM rg""",
)
def entity_layer(spark, folder):
    """All parts of the entity layer, each with its rows or addresses and the incidences it accounts for."""
    actions = T.actions(spark, folder).withColumn("chain_id", F.lit(1))
    universe = entities.address_universe(actions)[0]
    parts = studies.entity_layer(actions, code_records(universe.select("address")), address_labels(universe), "v1", T.FIRST_DAY, T.LAST_DAY, T.ACTIONS)

    def part(name, key, addresses, incidences):
        return parts[name].groupBy(F.lit(name).alias("part"), key.alias("name")).agg(addresses.cast("bigint").alias("addresses"), F.sum(incidences).cast("bigint").alias("incidences"))

    rows = F.count(F.lit(1))
    out = part("address_types", F.concat_ws("/", "address_type", "code_presence_class"), F.sum("address_count"), "event_incidence_count")
    out = out.unionByName(part("infrastructure", F.col("infrastructure_family_id"), F.sum("address_count"), "event_incidence_count"))
    out = out.unionByName(part("registry", F.lit("all"), rows, "event_incidence_count"))
    for name in ("weekly_action", "weekly"):
        out = out.unionByName(part(name, F.lit("cells"), rows, "event_incidence_count"))
    return out


@query(
    "study_release_results",
    f"""WITH {ACTIONS}, {LINKS}, {PERIOD_ACTIONS}, {bound_sql('period', 'pa')}, ev AS (SELECT max(h) FILTER (period = 'post') - 1 AS lo, 1 - max(h) FILTER (period = 'pre') AS hi FROM m2),
n AS (SELECT CAST(chain_id AS VARCHAR) AS chain, count(*) AS events FROM actions GROUP BY ALL)
SELECT chain, events AS event_count, events AS snapshot_events, (SELECT count(DISTINCT action) FROM actions) AS guarded_estimates, 'hhi' AS metric, {r('lo')} AS change_lower, {r('hi')} AS change_upper FROM n, ev""",
)
def release_results(spark, folder):
    """The released results of both chains from their tables; a promoted row makes the job fail."""
    return released(spark, folder, "diagnostic_not_causal")


def released(spark, folder, status):
    actions = T.actions(spark, folder).withColumn("chain", F.col("chain_id").cast("string"))
    participation = panels.beneficiary_panel(actions, ["chain"], T.FIRST_DAY, T.LAST_DAY)
    layers = F.explode(F.array(F.lit("all_actions"), F.col("action"))).alias("layer")
    structure = actions.select("chain", layers).groupBy("chain", "layer").agg(F.count(F.lit(1)).alias("snapshot_events"))
    estimates = actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).withColumns({"post_horizon": F.lit(16), "causal_status": F.lit(status)})
    bounds = B.change_bounds(B.identified_set(K.assign_periods(actions, periods(spark)), links(spark, folder), ["period"]))
    out = studies.release_results(participation, structure, estimates, bounds)
    guarded = out["failed_design_horizon_16"].agg(F.count("causal_status").alias("guarded_estimates"))
    bound = out["economic_actor_hhi_change_bound"].select("metric", "change_lower", "change_upper")
    means = out["weekly_beneficiary_hhi"].select("chain")
    joined = out["event_totals"].join(means, "chain").join(out["all_actions_structural_snapshot"].drop("layer"), "chain")
    return rounded(with_scalar(with_scalar(joined, guarded), bound))
