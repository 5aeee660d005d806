"""Participants, code classes, versioned registries and entity-level measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import blank_to_null, distinct_present, flags, is_hex, ratio, role_text
from tallyweave.operators.concentration import unit_weights
from tallyweave.operators.contracts import ContractError, duplicate_keys
from tallyweave.operators.sizing import attach, with_scalar
from tallyweave.session import cut

ROLES = {"actor": "actor_address", "beneficiary": "beneficiary_address", "counterparty": "counterparty_address"}


def event_incidences(events: DataFrame, roles: dict[str, str] = ROLES) -> DataFrame:
    """One row per event and participating address, with the roles it holds in that event.

    The roles of an event sit in one row, so the set is built in place and nothing is
    shuffled; the event key must be unique (see the action contract).
    """
    cells = [blank_to_null(F.col(c)) for c in roles.values()]
    people = distinct_present(cells)

    exploded = events.withColumn("address", F.explode(people))
    exploded = exploded.withColumn("_roles", flags({name: cell == F.col("address") for name, cell in sorted(zip(roles, cells), key=lambda pair: pair[0])}))
    return exploded.withColumn("roles_in_event", F.array_join("_roles", "|"))


def address_universe(events: DataFrame, by: list[str] = ["chain_id"], roles: dict[str, str] = ROLES) -> tuple[DataFrame, DataFrame]:
    """Universe (one row per address) and incidences (one row per event and address)."""
    rows = event_incidences(events, roles)
    keys = [*by, "address"]
    spread = rows.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_roles")))), "|").alias("observed_roles"),
        role_text(F.col("action")).alias("observed_actions"),
        F.min("block_number").alias("first_observed_block"),
        F.max("block_number").alias("last_observed_block"),
        F.min("event_week").alias("first_event_week"),
        F.max("event_week").alias("last_event_week"),
        F.sum(F.size("_roles")).alias("role_incidence_count"),
        F.count_distinct("tx_hash").alias("transaction_count"),
        F.count(F.lit(1)).alias("event_incidence_count"),
    )
    return spread, rows.drop("_roles")


def code_facts(code: Column) -> dict[str, Column]:
    """Presence, byte length and SHA-256 of runtime code; malformed code fails the job."""
    text = F.lower(code)
    bad = F.raise_error(F.concat(F.lit("malformed runtime code: "), F.coalesce(F.substring(text, 1, 20), F.lit("null"))))
    good = F.when(is_hex(text), text).otherwise(bad)
    payload = F.unhex(F.substring(good, 3, 2147483647))
    here = good != "0x"
    return {
        "present": here,
        "bytes": F.when(here, F.length(payload)).otherwise(F.lit(0)),
        "sha256": F.when(here, F.sha2(payload, 256)).otherwise(F.lit("")),
    }


def classify_code(records: DataFrame) -> DataFrame:
    """Code class of each address from its code at the first and last observed blocks."""
    first, last = code_facts(F.col("first_runtime_code")), code_facts(F.col("last_runtime_code"))
    base = records.select(
        "address",
        *[first[k].alias(f"_f_{k}") for k in first],
        *[last[k].alias(f"_l_{k}") for k in last],
    )
    f, l = F.col("_f_present"), F.col("_l_present")
    same = F.col("_f_sha256") == F.col("_l_sha256")
    # fixed values: names of the presence, type and family classes
    presence = (
        F.when(~f & ~l, F.lit("no_runtime_code_observed"))
        .when(f & l & same, F.lit("stable_runtime_code"))
        .when(~f & l, F.lit("runtime_code_appeared"))
        .when(f & ~l, F.lit("runtime_code_disappeared"))
        .otherwise(F.lit("runtime_code_changed"))
    )
    kind = (
        F.when(~f & ~l, F.lit("code_absent_at_observed_bounds"))
        .when(f & l & same, F.lit("smart_contract"))
        .otherwise(F.lit("smart_contract_dynamic"))
    )
    family = (
        F.when(~f & ~l, F.lit(""))
        .when(f & l & same, F.concat(F.lit("runtime_sha256:"), F.col("_f_sha256")))
        .otherwise(F.concat(F.lit("dynamic_address:"), F.col("address").cast("string")))
    )
    return base.select(
        "address",
        kind.alias("address_type"),
        presence.alias("code_presence_class"),
        f.alias("first_runtime_code_present"),
        F.col("_f_bytes").alias("first_runtime_code_bytes"),
        F.col("_f_sha256").alias("first_runtime_code_sha256"),
        l.alias("last_runtime_code_present"),
        F.col("_l_bytes").alias("last_runtime_code_bytes"),
        F.col("_l_sha256").alias("last_runtime_code_sha256"),
        (f | l).alias("contract_observed"),
        family.alias("infrastructure_family_id"),
    )


def attach_registry(panel: DataFrame, registry: DataFrame, key: str, columns: list[str], address: str = "address", strict: bool = True) -> DataFrame:
    """Many-to-one registry attach: the registry key must be unique and no row may miss it."""
    if strict and duplicate_keys(registry, [address]).limit(1).count():
        raise ContractError("registry has repeated addresses")
    side = registry.select(F.col(address).alias(key), F.lit(True).alias("_known"), *columns)
    joined = panel.join(side, key, "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("address missing from registry: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        joined = joined.withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(missing.cast(panel.schema[key].dataType)))
    return joined.drop("_known")


# Text columns of a label
LABEL_TEXT = (
    "address_label", "entity_id", "entity_label", "entity_category", "entity_scope", "infrastructure_category",
    "source_id", "source_url", "source_revision", "source_path", "review_status", "notes",
)


def versioned_registry(universe: DataFrame, facts: DataFrame, labels: DataFrame, release: str, minimum_confidence: float = 0.90) -> DataFrame:
    """Universe with code facts and labels, one row per address, gated by label confidence.

    A labelled address without code evidence fails the job; so does a repeated key.
    """
    universe, facts, labels = cut(universe), cut(facts), cut(labels)  # read by the checks and the join
    for name, side in (("universe", universe), ("code facts", facts), ("labels", labels)):
        if duplicate_keys(side, ["address"]).limit(1).count():
            raise ContractError(f"{name} has repeated addresses")
    out = universe.join(facts, "address", "left")
    texts = [c for c in LABEL_TEXT if c in labels.columns]
    side = labels.select("address", *texts, *[F.col(c).alias(f"_{c}") for c in ("confidence", "valid_from_block", "valid_to_block")])
    out = out.join(side, "address", "left")
    out = out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts})
    out = out.withColumns(
        {
            "confidence": F.coalesce(F.col("_confidence").cast("double"), F.lit(0.0)),
            "valid_from_block": F.coalesce("_valid_from_block", "first_observed_block").cast("bigint"),
            "valid_to_block": F.coalesce("_valid_to_block", "last_observed_block").cast("bigint"),
            "contract_observed": F.coalesce("contract_observed", F.lit(False)),
        }
    ).drop("_confidence", "_valid_from_block", "_valid_to_block")
    accepted = (F.col("entity_id") != "") & (F.col("confidence") >= F.lit(float(minimum_confidence)))
    bad = accepted & ~F.col("contract_observed")
    refused = F.raise_error(F.concat(F.lit("label without runtime code evidence: "), F.col("address").cast("string")))
    out = out.withColumn("high_confidence_entity_label", F.when(bad, refused.cast("boolean")).otherwise(accepted))
    return out.withColumns(
        {
            "release_version": F.lit(release),
            "label_release_version": F.lit(release),
            "address_type_basis": F.lit("eth_getCode_at_first_and_last_observed_blocks"),
            "address_type_confidence": F.lit(1.0),
            "economic_actor_resolved": F.col("high_confidence_entity_label") & (F.col("entity_scope") == "economic_actor"),
            "curated_entity_key": F.when(F.col("high_confidence_entity_label"), F.col("entity_id")).otherwise(
                F.concat(F.lit("address:"), F.col("address").cast("string"))
            ),
            "entity_resolution": F.when(F.col("high_confidence_entity_label"), F.lit("high_confidence_curated_label")).otherwise(
                F.lit("unresolved_address_fallback")
            ),
        }
    )


# Registry columns that measurements carry
REGISTRY_FIELDS = [
    "contract_observed", "infrastructure_family_id", "curated_entity_key", "high_confidence_entity_label", "economic_actor_resolved", "entity_scope",
]


def _grouped_hhi(units: DataFrame, by: list[str], key: Column, name: str) -> DataFrame:
    sums = units.groupBy(*by, key.alias("_k")).agg(F.sum("weight").cast("double").alias("_w"))
    w = F.col("_w")
    out = sums.groupBy(*by).agg((F.sum(w * w) / (F.sum(w) * F.sum(w))).alias(name), (F.max(w) / F.sum(w)).alias(f"_top_{name}"))
    return out


def registry_units(incidences: DataFrame, registry: DataFrame, by: list[str]) -> DataFrame:
    """Incidence counts per group and address with the registry fields they need.

    Incidences are counted first and the registry is joined to the counts, so the join never
    sees single events.
    """
    side = cut(registry.select("address", *REGISTRY_FIELDS))
    return attach_registry(unit_weights(incidences, by, "address"), side, "address", REGISTRY_FIELDS)


def measurement_panel(units: DataFrame, by: list[str]) -> DataFrame:
    """Entity-sensitivity measures per group from :func:`registry_units` of the same or a
    finer grouping; every measure is a sum over addresses."""
    units = units.groupBy(*by, "address", *REGISTRY_FIELDS).agg(F.sum("weight").alias("weight"))
    w = F.col("weight").cast("double")
    accepted = F.col("high_confidence_entity_label")

    def weighted(flag: Column) -> Column:
        return F.sum(F.when(flag, w).otherwise(F.lit(0.0))) / F.sum(w)

    base = units.groupBy(*by).agg(
        F.sum("weight").cast("bigint").alias("event_incidence_count"),
        F.count(F.lit(1)).alias("active_addresses"),
        (F.sum(w * w) / (F.sum(w) * F.sum(w))).alias("address_activity_hhi"),
        weighted(F.col("contract_observed")).alias("contract_incidence_share"),
        weighted(F.col("entity_scope") == "protocol_infrastructure").alias("protocol_infrastructure_incidence_share"),
        weighted(accepted).alias("high_confidence_entity_incidence_coverage"),
        weighted(F.col("economic_actor_resolved")).alias("economic_actor_incidence_coverage"),
    )
    curated = _grouped_hhi(units, by, F.col("curated_entity_key"), "curated_entity_activity_hhi_sensitivity")
    collapsed = F.when(accepted, F.col("curated_entity_key")).otherwise(F.lit("unresolved:all_addresses_collapsed"))
    extreme = _grouped_hhi(units, by, collapsed, "unresolved_all_one_hhi_extreme")
    templated = units.where(F.col("contract_observed") & (F.col("infrastructure_family_id") != ""))
    template = _grouped_hhi(templated, by, F.col("infrastructure_family_id"), "contract_template_hhi_conditional")
    out = base
    for part in (curated, extreme, template):
        out = attach(out, part, by, "left")
    return out.select(
        *by,
        "event_incidence_count",
        "active_addresses",
        "address_activity_hhi",
        ratio(F.lit(1.0), F.col("address_activity_hhi")).alias("effective_active_addresses"),
        "curated_entity_activity_hhi_sensitivity",
        ratio(F.lit(1.0), F.col("curated_entity_activity_hhi_sensitivity")).alias("effective_curated_entities_sensitivity"),
        "unresolved_all_one_hhi_extreme",
        ratio(F.lit(1.0), F.col("unresolved_all_one_hhi_extreme")).alias("effective_entities_unresolved_all_one_extreme"),
        "contract_incidence_share",
        "protocol_infrastructure_incidence_share",
        "high_confidence_entity_incidence_coverage",
        "economic_actor_incidence_coverage",
        F.coalesce("contract_template_hhi_conditional", F.lit(0.0)).alias("contract_template_hhi_conditional"),
        F.coalesce("_top_contract_template_hhi_conditional", F.lit(0.0)).alias("top_contract_template_share_conditional"),
    )


def measurement_panels(incidences: DataFrame, registry: DataFrame, minimum: int, maximum: int, actions: list[str], week: str = "event_week") -> tuple[DataFrame, DataFrame]:
    """Dense week-by-action and week panels, absent cells zero."""
    from tallyweave.operators.panels import fill_zero, spine

    weeks = spine(incidences, [], minimum, maximum, week)
    cells = weeks.withColumn("action", F.explode(F.array(*[F.lit(a) for a in actions])))
    units = cut(registry_units(incidences, registry, [week, "action"]))
    by_action = cells.join(measurement_panel(units, [week, "action"]), [week, "action"], "left")
    weekly = weeks.join(measurement_panel(units, [week]), week, "left")
    return fill_zero(by_action, [week, "action"]), fill_zero(weekly, [week])


def address_type_summary(registry: DataFrame) -> DataFrame:
    groups = registry.groupBy("address_type", "code_presence_class").agg(
        F.count(F.lit(1)).alias("address_count"), F.sum("event_incidence_count").cast("bigint").alias("event_incidence_count")
    )
    totals = groups.agg(F.sum("address_count").alias("_a"), F.sum("event_incidence_count").alias("_e"))
    return with_scalar(groups, totals).withColumns(
        {
            "address_share": F.col("address_count") / F.col("_a"),
            "event_incidence_share": F.col("event_incidence_count") / F.col("_e"),
        }
    ).drop("_a", "_e")


def infrastructure_summary(registry: DataFrame) -> DataFrame:
    """Template families among contracts, with shares and the labels seen in each."""
    labels = F.array_sort(F.collect_set(F.when(F.col("entity_id") != "", F.col("entity_id"))))
    groups = registry.where("contract_observed").groupBy("infrastructure_family_id").agg(
        F.count(F.lit(1)).alias("address_count"),
        F.sum("event_incidence_count").cast("bigint").alias("event_incidence_count"),
        F.array_join(labels, "|").alias("curated_entity_ids"),
    )
    weight = F.col("event_incidence_count")
    totals = registry.agg(F.sum(F.when(F.col("contract_observed"), weight)).alias("_c"), F.sum(weight).alias("_e"))
    return with_scalar(groups, totals).withColumns(
        {"share_of_contract_incidences": weight / F.col("_c"), "share_of_all_incidences": weight / F.col("_e")}
    ).drop("_c", "_e")
