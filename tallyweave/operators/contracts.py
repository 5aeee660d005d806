"""Declarative data contracts evaluated as aggregates, and row-level rejects."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import flags, present, strict_bool
from tallyweave.operators.sizing import with_scalar


class ContractError(ValueError):
    """A table does not satisfy its contract."""


@dataclass(frozen=True)
class Contract:
    """What a table must satisfy.

    ``columns`` must exist. Each tuple in ``keys`` must be unique. ``rules`` are row
    predicates that must hold. ``domains`` name the exact value set of a column, ``spans``
    its exact minimum and maximum, and ``filled`` the columns that may not be blank.
    """

    columns: tuple[str, ...] = ()
    keys: tuple[tuple[str, ...], ...] = ()
    rules: dict[str, Column] = field(default_factory=dict)
    domains: dict[str, tuple] = field(default_factory=dict)
    spans: dict[str, tuple] = field(default_factory=dict)
    filled: tuple[str, ...] = ()


def missing_columns(df: DataFrame, columns: tuple[str, ...] | list[str]) -> list[str]:
    return sorted(set(columns) - set(df.columns))


def require_columns(df: DataFrame, columns: tuple[str, ...] | list[str], label: str = "table") -> DataFrame:
    missing = missing_columns(df, columns)
    if missing:
        raise ContractError(f"{label} is missing columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def duplicate_audit(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """Per named key: distinct keys, keys that repeat and surplus rows.

    The keys are counted with partial aggregation, so a key held by a third of all rows
    reaches the shuffle as one partial count per task.
    """
    parts = []
    for name, columns in keys.items():
        counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(
            counted.agg(
                F.count(F.lit(1)).alias("distinct_keys"),
                F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
                F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("surplus_rows"),
            ).withColumn("key_name", F.lit(name))
        )
    return reduce(DataFrame.unionByName, parts)


def audit(df: DataFrame, contract: Contract) -> DataFrame:
    """One row per check with its violation count. Column presence is checked first."""
    require_columns(df, contract.columns)
    aggregates: dict[str, Column] = {}
    for name, rule in contract.rules.items():
        aggregates[f"rule:{name}"] = F.count_if(~F.coalesce(rule, F.lit(False)))
    for column in contract.filled:
        aggregates[f"filled:{column}"] = F.count_if(~present(column))
    for column, values in contract.domains.items():
        expected = F.array(*[F.lit(v) for v in values])
        seen = F.collect_set(F.when(F.col(column).isin(*values), F.col(column)))
        outside = F.count_if(~F.coalesce(F.col(column).isin(*values), F.lit(False)))
        absent = F.size(F.array_except(expected, seen))
        aggregates[f"domain:{column}"] = outside + absent
    for column, (low, high) in contract.spans.items():
        wrong = ~((F.min(column) == F.lit(low)) & (F.max(column) == F.lit(high)))
        aggregates[f"span:{column}"] = F.coalesce(wrong.cast("int"), F.lit(1))
    parts = []
    if aggregates:
        names = list(aggregates)
        wide = df.agg(*[aggregates[n].cast("bigint").alias(f"c{i}") for i, n in enumerate(names)])
        pairs = ", ".join(f"'{n}', c{i}" for i, n in enumerate(names))
        parts.append(wide.selectExpr(f"stack({len(names)}, {pairs}) AS (check_name, violations)"))
    if contract.keys:
        keyed = duplicate_audit(df, {"key:" + ",".join(k): list(k) for k in contract.keys})
        parts.append(keyed.select(F.col("key_name").alias("check_name"), F.col("duplicate_keys").alias("violations")))
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)


def enforce(df: DataFrame, contract: Contract, label: str = "table") -> DataFrame:
    """Raise when any check fails, else hand the table on. The report has one row per check."""
    failed = audit(df, contract).where(~F.col("passed")).orderBy("check_name").collect()
    if failed:
        raise ContractError(f"{label}: " + "; ".join(f"{r.check_name} ({r.violations})" for r in failed))
    return df


def reject_rows(df: DataFrame, rules: dict[str, Column], name: str = "failed_rules") -> DataFrame:
    """Tag every row with the names of the rules it breaks (an empty array when none)."""
    return df.withColumn(name, flags({label: ~F.coalesce(rule, F.lit(False)) for label, rule in rules.items()}))


def split_valid(tagged: DataFrame, name: str = "failed_rules") -> tuple[DataFrame, DataFrame]:
    return tagged.where(F.size(name) == 0).drop(name), tagged.where(F.size(name) > 0)


def reconcile(left: DataFrame, right: DataFrame, on: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows of ``left`` whose match in ``right`` is missing, repeated or differs, null-safe.

    ``pairs`` names each compared field as (left column, right column).
    """
    found = F.count(F.lit(1)).alias("_found")
    other = right.groupBy(*on).agg(found, *[F.min(b).alias(f"_r_{n}") for n, (_, b) in pairs.items()])
    joined = left.join(other, on, "left")
    issues = {"missing": F.col("_found").isNull(), "repeated": F.coalesce(F.col("_found") > 1, F.lit(False))}
    for name, (a, _) in pairs.items():
        issues[name] = F.col("_found").isNotNull() & ~F.col(a).eqNullSafe(F.col(f"_r_{name}"))
    joined = joined.withColumn("mismatches", flags(issues))
    return joined.where(F.size("mismatches") > 0).drop("_found", *[f"_r_{n}" for n in pairs])


def frames_equal(left: DataFrame, right: DataFrame, keys: list[str], rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """Keys that differ between two tables. Empty means equal.

    A key that occurs more than once on a side is a difference of its own (``repeated_left``,
    ``repeated_right``); null keys are keys like others.
    Doubles agree when ``abs(a - b) <= atol + rtol * abs(b)`` or both are null or NaN; every
    other type is compared null-safe.
    """
    values = [c for c in left.columns if c not in keys]
    if sorted(left.columns) != sorted(right.columns):
        raise ContractError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    kinds = dict(left.dtypes)
    # one grouping of both sides counts each key, null keys too, and brings its rows together
    sides = [df.select(*keys, F.lit(side).alias("_side"), *[F.col(c).alias(f"_v_{c}") for c in values]) for side, df in (("a", left), ("b", right))]
    held = [
        F.first(F.when(F.col("_side") == side, F.struct(F.lit(side).alias("_s"), *[F.col(f"_v_{c}") for c in values])), ignorenulls=True).alias(f"_{side}")
        for side in "ab"
    ]
    counts = [F.count_if(F.col("_side") == side).alias(f"_n_{side}") for side in "ab"]
    joined = sides[0].unionByName(sides[1]).groupBy(*keys).agg(*counts, *held)
    issues = {
        "only_right": F.col("_n_a") == 0, "only_left": F.col("_n_b") == 0, "repeated_left": F.col("_n_a") > 1, "repeated_right": F.col("_n_b") > 1,
    }
    matched = (F.col("_n_a") == 1) & (F.col("_n_b") == 1)
    for c in values:
        x, y = F.col("_a")[f"_v_{c}"], F.col("_b")[f"_v_{c}"]
        same = x.eqNullSafe(y)
        if kinds[c] in ("double", "float"):
            near = F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)
            same = same | F.coalesce(near, F.lit(False))
        issues[c] = matched & ~same
    joined = joined.withColumn("differences", flags(issues))
    return joined.where(F.size("differences") > 0).select(*keys, "differences")


def assert_frames_equal(left: DataFrame, right: DataFrame, keys: list[str], rtol: float = 1e-10, atol: float = 1e-12) -> None:
    sample = frames_equal(left, right, keys, rtol, atol).limit(5).collect()
    if sample:
        raise ContractError(f"tables differ, for example at {[r.asDict() for r in sample]}")


def package_audit(manifest: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Manifest rows against the tables found: inventory, row counts and field lists.

    ``manifest`` holds ``name, rows, fields (array), evidence_status, expected_status``.
    """
    observed = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("observed_rows")).withColumns(
            {"name": F.lit(name), "observed_fields": F.array(*[F.lit(c) for c in df.columns])}
        )
        observed = row if observed is None else observed.unionByName(row)
    joined = manifest.join(observed, "name", "full_outer")
    issues = {
        "not_in_manifest": F.col("rows").isNull(),
        "table_missing": F.col("observed_rows").isNull(),
        "row_count": F.col("rows") != F.col("observed_rows"),
        "fields": F.col("fields") != F.col("observed_fields"),
        "evidence_status": ~F.col("evidence_status").eqNullSafe(F.col("expected_status")) & F.col("rows").isNotNull(),
    }
    return joined.select("name", "rows", "observed_rows", F.array_join(flags(issues), ";").alias("issues"))


def evidence_guard(df: DataFrame, column: str, expected: str) -> DataFrame:
    """Hand rows on unchanged; the job fails at the first row promoted past its status."""
    message = F.concat(F.lit(f"{column} promoted past {expected}: "), F.coalesce(F.col(column), F.lit("null")))
    guarded = F.when(F.col(column) == F.lit(expected), F.col(column)).otherwise(F.raise_error(message))
    return df.withColumn(column, guarded)


def evidence_counts(df: DataFrame, column: str, expected: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(~F.col(column).eqNullSafe(F.lit(expected))).alias("promoted_rows"),
    )


def grid_complete(df: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """Spine cells that the panel lacks."""
    return spine.select(*keys).join(df.select(*keys).distinct(), keys, "left_anti")


def totals_reconcile(parts: DataFrame, part: str, total: DataFrame, whole: str) -> DataFrame:
    """One row: the sum of the parts, the stated total and whether they agree."""
    summed = parts.agg(F.sum(part).cast("bigint").alias("sum_of_parts"))
    stated = total.agg(F.sum(whole).cast("bigint").alias("stated_total"))
    return with_scalar(summed, stated).withColumn("reconciles", F.col("sum_of_parts") == F.col("stated_total"))


def crosswalk(index: DataFrame, mapping: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Full outer comparison of an index with its crosswalk; list fields are ``;``-separated."""
    a = index.groupBy(key).agg(F.count(F.lit(1)).alias("_a"), *[F.min(f).alias(f"_a_{f}") for f in fields])
    b = mapping.groupBy(key).agg(F.count(F.lit(1)).alias("_b"), *[F.min(f).alias(f"_b_{f}") for f in fields])
    joined = a.join(b, key, "full_outer")
    issues = {
        "orphan_in_crosswalk": F.col("_a").isNull(), "orphan_in_index": F.col("_b").isNull(),
        "repeated_in_index": F.coalesce(F.col("_a") > 1, F.lit(False)), "repeated_in_crosswalk": F.coalesce(F.col("_b") > 1, F.lit(False)),
    }
    for f in fields:
        x, y = F.split(F.col(f"_a_{f}").cast("string"), ";"), F.split(F.col(f"_b_{f}").cast("string"), ";")
        issues[f] = F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~x.eqNullSafe(y)
    return joined.select(key, F.array_join(flags(issues), ";").alias("issues"))


def coverage_gate(
    registry: DataFrame,
    labelled: str,
    economic: str,
    incidences: str,
    minimum_unique: float = 0.50,
    minimum_incidence: float = 0.80,
    minimum_economic: float = 0.80,
) -> DataFrame:
    """Labelled address share, labelled incidence share and economic-actor share against gates."""
    w = F.col(incidences).cast("double")
    out = registry.agg(
        (F.count_if(F.col(labelled)) / F.count(F.lit(1))).alias("unique_address_coverage"),
        (F.sum(F.when(F.col(labelled), w).otherwise(0.0)) / F.sum(w)).alias("incidence_coverage"),
        (F.sum(F.when(F.col(economic), w).otherwise(0.0)) / F.sum(w)).alias("economic_actor_incidence_coverage"),
    )
    passed = (
        (F.col("unique_address_coverage") >= minimum_unique)
        & (F.col("incidence_coverage") >= minimum_incidence)
        & (F.col("economic_actor_incidence_coverage") >= minimum_economic)
    )
    return out.withColumn("entity_gate_passed", passed)


def metric_drift(observed: DataFrame, locked: DataFrame, keys: list[str], exact: dict[str, str], close: dict[str, str]) -> DataFrame:
    """Drift between observed metrics and a locked row; ``exact``/``close`` map names across."""
    names = {**exact, **close}
    renamed = locked.select(*keys, *[F.col(b).alias(a) for a, b in names.items()])
    return frames_equal(observed.select(*keys, *names), renamed, keys)


# Scopes a curated label may carry
LABEL_SCOPES = ("economic_actor", "protocol_infrastructure", "asset_infrastructure")
INFRASTRUCTURE_SCOPES = ("protocol_infrastructure", "asset_infrastructure")


def label_contract() -> Contract:
    return Contract(
        columns=("address", "confidence", "valid_from_block", "valid_to_block", "entity_scope", "source_url"),
        keys=(("address",),),
        rules={
            "confidence_in_unit_interval": F.col("confidence").between(0.0, 1.0),
            "interval_ordered": F.col("valid_to_block") >= F.col("valid_from_block"),
            "scope_allowed": F.col("entity_scope").isin(*LABEL_SCOPES),
            "https_source": F.col("source_url").startswith("https://"),
        },
    )


def select_release(df: DataFrame, release: str, chain_id: int) -> DataFrame:
    return df.where((F.col("release_version") == release) & (F.col("chain_id") == chain_id))


def constraint_rules(minimum_confidence: float, relation: str, scope: str, review: str) -> dict[str, Column]:
    return {
        "no_self_link": F.col("left_address") != F.col("right_address"),
        "confidence_in_unit_interval": F.col("confidence").between(0.0, 1.0),
        "interval_ordered": F.col("valid_to_block") >= F.col("valid_from_block"),
        "https_source": F.col("source_url").startswith("https://"),
        "pinned_revision": F.col("source_revision").rlike("^[0-9a-f]{40}$"),
        "evidence_accepted": (F.col("relation") == relation)
        & (F.col("entity_scope") == scope)
        & (F.col("review_status") == review)
        & (F.col("confidence") >= minimum_confidence),
    }


def constraint_gate(constraints: DataFrame, registry: DataFrame, rules: dict[str, Column], address: str = "address") -> DataFrame:
    """Each constraint with the rules it breaks, unknown endpoints and repeated ids included."""
    known = registry.select(F.col(address).alias("_known")).distinct()
    ends = constraints
    for side in ("left_address", "right_address"):
        seen = known.select(F.col("_known").alias(side), F.lit(True).alias(f"_k_{side}"))
        ends = ends.join(seen, side, "left")
    repeated = duplicate_keys(constraints, ["constraint_id"]).select("constraint_id", F.lit(True).alias("_repeat"))
    ends = ends.join(repeated, "constraint_id", "left")
    full = dict(rules)
    full["known_addresses"] = F.col("_k_left_address").isNotNull() & F.col("_k_right_address").isNotNull()
    full["unique_id"] = F.col("_repeat").isNull()
    return reject_rows(ends, full).drop("_k_left_address", "_k_right_address", "_repeat")


def accepted_constraints(gated: DataFrame) -> DataFrame:
    """The constraints, or a failing job when any row of the release was rejected."""
    message = F.concat(F.lit("constraint rejected: "), F.col("constraint_id").cast("string"), F.lit(" "), F.array_join("failed_rules", ","))
    checked = F.when(F.size("failed_rules") == 0, F.col("constraint_id")).otherwise(F.raise_error(message))
    return gated.withColumn("constraint_id", checked).drop("failed_rules")


def load_registry(df: DataFrame, booleans: tuple[str, ...] = ("contract_observed", "high_confidence_entity_label", "economic_actor_resolved")) -> DataFrame:
    """Registry with strict booleans and the derived infrastructure flag; keys must be unique."""
    typed = df.withColumns({c: strict_bool(c) for c in booleans})
    enforce(typed, Contract(columns=("address", "entity_scope", *booleans), keys=(("address",),)), "registry")
    infrastructure = F.col("high_confidence_entity_label") & F.coalesce(F.col("entity_scope").isin(*INFRASTRUCTURE_SCOPES), F.lit(False))
    return typed.withColumn("curated_infrastructure", infrastructure)


def action_contract(actions: tuple[str, ...], chain_id: int, minimum: int, maximum: int) -> Contract:
    """Contract of the topology and bounds inputs."""
    return Contract(
        columns=("chain_id", "action", "block_number", "tx_hash", "log_index", "event_week", "actor_address", "beneficiary_address"),
        keys=(("tx_hash", "log_index"),),
        domains={"action": actions, "chain_id": (chain_id,)},
        spans={"event_week": (minimum, maximum)},
        filled=("actor_address", "beneficiary_address"),
    )


def ledger_mismatches(cohorts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Cohorts whose primary ledger event is missing, not top tier, or differs in block or time."""
    primary = ledger.where(F.lower(F.trim("primary_treatment")) == "yes")
    tagged = cohorts.withColumn("_tier", F.lit("A+"))
    pairs = {
        "evidence_tier": ("_tier", "evidence_tier"),
        "block_number": ("activation_block", "block_number"),
        "event_time_utc": ("activation_utc", "event_time_utc"),
    }
    return reconcile(tagged, primary, ["event_id"], pairs).drop("_tier")


def event_timing_mismatches(event: DataFrame, audit_rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """The configured event against the source audit and the calendar's week zero."""
    first = reconcile(
        event, audit_rows, ["event_id"], {"audit_block": ("activation_block", "block_number"), "audit_time": ("activation_utc", "event_time_utc")}
    )
    zero = calendar.where("event_week = 0")
    second = reconcile(
        event, zero, ["event_id"], {"calendar_block": ("activation_block", "activation_block"), "calendar_time": ("activation_utc", "activation_utc")}
    )
    return first.unionByName(second)


def glossary_contract(dimensions: tuple[str, ...]) -> Contract:
    return Contract(
        columns=("measure_id", "dimension", "reference_keys"),
        keys=(("measure_id",),),
        domains={"dimension": dimensions},
    )


def uncited_keys(glossary: DataFrame, known: DataFrame) -> DataFrame:
    """Reference keys used by the glossary that no known source defines."""
    cited = glossary.select(F.explode(F.split("reference_keys", ";")).alias("reference_key")).where(F.col("reference_key") != "")
    return cited.distinct().join(known.select("reference_key").distinct(), "reference_key", "left_anti")


