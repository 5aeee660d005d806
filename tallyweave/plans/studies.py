"""The four study paths, each a composition of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators import calendars, contracts, entities, graph, inference, panels
from tallyweave.session import cut
from tallyweave.sources import logs, transfers


def panels_from_logs(
    raw: DataFrame, boundaries: DataFrame, chain_id: int, minimum: int, maximum: int, actions: list[str], strict: bool = True
) -> dict[str, DataFrame]:
    """Raw logs to decoded, week-assigned actions and their panels.

    The decoded table is written once and every panel reads it.
    """
    decoded = logs.decode_logs(raw, chain_id)
    tagged = boundaries.withColumn("chain_id", F.lit(chain_id).cast("bigint"))
    assigned = cut(calendars.assign_weeks(decoded, tagged.select("chain_id", "boundary_event_week", "start_block"), ["chain_id"], strict=strict))
    inside = assigned.where(F.col("event_week").isNotNull())
    return {
        "actions": assigned,
        "weekly_action": panels.action_panel(inside, ["chain_id"], minimum, maximum, actions),
        "reserve_week_action": panels.reserve_panel(inside, ["chain_id"]),
        "weekly_beneficiary": panels.beneficiary_panel(inside, ["chain_id"], minimum, maximum),
        "participation": panels.participation_panel(inside, ["chain_id"], minimum, maximum),
    }


def snapshots_from_transfers(raw: DataFrame, assets: DataFrame, mapping: DataFrame | None, by: list[str] | None = None) -> DataFrame:
    """Warehouse transfers to weekly network snapshots per chain and asset."""
    clean = transfers.clean_transfers(transfers.normalize_transfers(raw, assets))
    mapped = cut(transfers.apply_entity_map(clean, mapping))
    return graph.temporal_snapshots(mapped, by or ["chain_id", "asset"])


def entity_layer(actions: DataFrame, code_records: DataFrame, labels: DataFrame, release: str, minimum: int, maximum: int, names: list[str]) -> dict[str, DataFrame]:
    """Universe, versioned registry, measurement panels and summaries of one chain."""
    universe, incidences = entities.address_universe(actions)
    registry = cut(entities.versioned_registry(universe, entities.classify_code(code_records), labels, release))
    by_action, weekly = entities.measurement_panels(incidences, registry, minimum, maximum, names)
    return {
        "registry": registry,
        "weekly_action": by_action,
        "weekly": weekly,
        "address_types": entities.address_type_summary(registry),
        "infrastructure": entities.infrastructure_summary(registry),
        "gate": contracts.coverage_gate(registry, "high_confidence_entity_label", "economic_actor_resolved", "event_incidence_count"),
    }


def comparison_study(panel: DataFrame, role: str, treated: str, control: str, outcomes: dict[str, str], specs: DataFrame, lag: int) -> dict[str, DataFrame]:
    """Weekly panels of two chains to gaps, differences in changes, pre-trends and event study.

    ``outcomes`` maps an outcome id to its panel column.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("o"), F.col(c).cast("double").alias("v")) for k, c in outcomes.items()])
    long = panel.select(role, "event_week", F.explode(cells).alias("_c")).select(role, "event_week", F.col("_c.o").alias("outcome_id"), F.col("_c.v").alias("value"))
    gaps = cut(inference.gap_series(long, ["outcome_id", "event_week"], role, treated, control, "value"))
    return {
        "gaps": gaps,
        "estimates": inference.did_estimates(gaps, ["outcome_id"], specs, lag),
        "pretrend": inference.pretrend(gaps, ["outcome_id"], -16, -9, 2),
        "event_study": inference.event_study(gaps, ["outcome_id"], -16, -9),
        "placebo": inference.placebo(gaps, ["outcome_id"], [-13, -12, -11], 2),
    }


def release_results(participation: DataFrame, structure: DataFrame, estimates: DataFrame, bounds: DataFrame) -> dict[str, DataFrame]:
    """Published results out of the released tables, each behind its evidence guard."""
    totals = participation.groupBy("chain").agg(F.sum("event_count").alias("event_count"))
    means = panels.pre_post_decimal(participation, ["chain"], "beneficiary_hhi")
    snapshot = structure.where(F.col("layer") == "all_actions")
    failed = contracts.evidence_guard(estimates.where("post_horizon = 16"), "causal_status", "diagnostic_not_causal")
    evidence = bounds.where(F.col("assumption") == "evidence")
    permitted = contracts.evidence_guard(
        evidence.withColumn("_p", F.col("economic_actor_conclusion_permitted").cast("string")), "_p", "false"
    ).drop("_p")
    one = Window.partitionBy("assumption")
    single = F.when(F.count(F.lit(1)).over(one) == 1, F.col("metric")).otherwise(F.raise_error(F.lit("more than one evidence row")))
    return {
        "event_totals": totals,
        "weekly_beneficiary_hhi": means,
        "all_actions_structural_snapshot": snapshot,
        "failed_design_horizon_16": failed,
        "economic_actor_hhi_change_bound": permitted.withColumn("metric", single),
    }
