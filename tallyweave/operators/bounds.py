"""Identified sets of concentration under assumptions about who is behind an address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.calendars import assign_periods
from tallyweave.operators.concentration import concentration_of_units
from tallyweave.operators.graph import components
from tallyweave.operators.intervals import containing
from tallyweave.operators.ordering import global_ordinal
from tallyweave.operators.panels import fill_zero
from tallyweave.operators.sizing import attach, shuffled, small_side
from tallyweave.session import cut

# Reported metrics and assumptions, in report order
METRICS = ("hhi", "effective", "entropy", "top1", "top5")
ASSUMPTIONS = ("event_split", "stable_address", "evidence")


def beneficiary_events(actions: DataFrame) -> DataFrame:
    """Beneficiary rows numbered by (block, transaction, log) over the whole table."""
    ordered = global_ordinal(
        actions.select("block_number", "tx_hash", "log_index", "event_week", "action", "beneficiary_address"),
        ["block_number", "tx_hash", "log_index"],
        "event_ordinal",
    )
    return ordered.select("event_ordinal", "block_number", "event_week", "action", "beneficiary_address")


def active_constraints(spans: DataFrame, constraints: DataFrame) -> DataFrame:
    """Links valid over the whole block span of a group (``minimum_block``, ``maximum_block``)."""
    links = constraints.select("constraint_id", "left_address", "right_address", "valid_from_block", "valid_to_block")
    found = containing(spans, links, "minimum_block", "valid_from_block", "valid_to_block")
    return found.where("valid_to_block >= maximum_block").drop("valid_from_block", "valid_to_block")


def active_counts(spans: DataFrame, constraints: DataFrame, by: list[str]) -> DataFrame:
    """How many links are valid over each group's span, from one row per distinct validity."""
    validity = constraints.groupBy("valid_from_block", "valid_to_block").agg(F.count(F.lit(1)).alias("_links"))
    found = containing(spans, validity, "minimum_block", "valid_from_block", "valid_to_block").where("valid_to_block >= maximum_block")
    return found.groupBy(*by).agg(F.sum("_links").alias("accepted_must_link_constraint_count"))


def present_links(units: DataFrame, spans: DataFrame, constraints: DataFrame, by: list[str]) -> DataFrame:
    """Active links with both ends in the group: ``by``, ``src``, ``dst``.

    Units meet the links of their own address only, at most links x groups pairs, of which those
    valid over the group's span remain. Both tables grow with the input and are shuffled.
    """
    links = constraints.select(F.col("left_address").alias("src"), F.col("right_address").alias("dst"), "valid_from_block", "valid_to_block")
    links = links.where("valid_from_block <= valid_to_block")
    here = units.select(*by, F.col("address").alias("src"))
    found = here.join(shuffled(links), "src")
    placed = attach(found, small_side(spans.select(*by, "minimum_block", "maximum_block")), by)
    active = placed.where("valid_from_block <= minimum_block AND valid_to_block >= maximum_block")
    pairs = active.select(*by, "src", "dst").distinct()
    return pairs.join(shuffled(here.withColumnRenamed("src", "dst")), [*by, "dst"], "left_semi").select(*by, "src", "dst", F.lit(1).alias("weight"))


def component_weights(units: DataFrame, present: DataFrame, by: list[str]) -> DataFrame:
    """Unit weights after merging addresses along ``present`` links (:func:`present_links`).

    The merged unit is named by its smallest address.
    """
    present = cut(present)
    if not present.limit(1).count():
        return units.select(*by, F.col("address").alias("component"), "weight")
    labels = components(present, by).withColumnRenamed("node", "address")
    merged = units.join(shuffled(labels), [*by, "address"], "left")
    return merged.groupBy(*by, F.coalesce("component", "address").alias("component")).agg(F.sum("weight").alias("weight"))


def _bundle(units: DataFrame, by: list[str], prefix: str) -> DataFrame:
    out = concentration_of_units(units, by, top=(1, 5))
    return out.select(
        *by,
        F.col("hhi").alias(f"{prefix}_hhi"),
        F.col("inverse_hhi").alias(f"{prefix}_effective"),
        F.col("entropy").alias(f"{prefix}_entropy"),
        F.col("top1_share").alias(f"{prefix}_top1"),
        F.col("top5_share").alias(f"{prefix}_top5"),
    )


def identified_set(
    panel: DataFrame, constraints: DataFrame, by: list[str], unit: str = "beneficiary_address", flags: dict[str, str] | None = None
) -> DataFrame:
    """Lower and upper bounds per group and assumption.

    Event-split treats every event as its own actor, stable-address treats addresses as the
    finest actors, and evidence merges addresses by accepted links; the coarsest case is one
    actor in all three. ``flags`` names boolean columns reported as event shares.
    """
    flags = flags or {}
    return _identified(cut(_units(panel, by, unit, flags)), constraints, by, flags)


def _units(panel: DataFrame, by: list[str], unit: str, flags: dict[str, str]) -> DataFrame:
    """Events, block span and flagged events of every address in its group."""
    return panel.groupBy(*by, F.col(unit).alias("address")).agg(
        F.count(F.lit(1)).alias("weight"),
        F.min("block_number").alias("_lo"),
        F.max("block_number").alias("_hi"),
        *[F.sum(F.col(c).cast("int")).alias(name) for name, c in flags.items()],
    )


def _identified(units: DataFrame, constraints: DataFrame, by: list[str], flags: dict[str, str]) -> DataFrame:
    base = units.groupBy(*by).agg(
        F.sum("weight").cast("bigint").alias("event_count"),
        F.count(F.lit(1)).alias("beneficiary_address_count"),
        F.min("_lo").alias("minimum_block"),
        F.max("_hi").alias("maximum_block"),
        *[(F.sum(name) / F.sum("weight")).alias(name) for name in flags],
    )
    base = cut(base)
    spans = base.select(*by, "minimum_block", "maximum_block")
    counted = active_counts(spans, constraints, by)
    merged = component_weights(units.select(*by, "address", "weight"), present_links(units, spans, constraints, by), by)
    out = (
        base.join(counted, by, "left")
        .fillna(0, ["accepted_must_link_constraint_count"])
        .join(_bundle(units, by, "_a"), by)
        .join(_bundle(merged, by, "_e"), by)
    )
    n, one = F.col("event_count").cast("double"), F.lit(1.0)
    columns = {"cell_observed": F.lit(True)}
    names = {"hhi": "address_proxy_hhi", "effective": "address_proxy_effective_number", "entropy": "address_proxy_entropy", "top1": "address_proxy_top1_share", "top5": "address_proxy_top5_share"}
    for metric, name in names.items():
        columns[name] = F.col(f"_a_{metric}")
    event = {
        "hhi": (one / n, one), "effective": (one, n), "entropy": (F.lit(0.0), F.ln(n)), "top1": (one / n, one), "top5": (F.least(F.lit(5.0), n) / n, one),
    }
    for metric, (low, high) in event.items():
        columns[f"event_split_{metric}_lower"], columns[f"event_split_{metric}_upper"] = low, high
    for assumption, prefix in (("stable_address", "_a"), ("evidence", "_e")):
        for metric in METRICS:
            value = F.col(f"{prefix}_{metric}")
            if metric in ("effective", "entropy"):
                low, high = (one if metric == "effective" else F.lit(0.0)), value
            else:
                low, high = value, one
            columns[f"{assumption}_{metric}_lower"], columns[f"{assumption}_{metric}_upper"] = low, high
    out = out.withColumns(columns)
    return out.drop(*[f"{p}_{m}" for p in ("_a", "_e") for m in METRICS])


def bound_panels(
    panel: DataFrame, constraints: DataFrame, periods: DataFrame, minimum: int, maximum: int, actions: list[str], flags: dict[str, str] | None = None, unit: str = "beneficiary_address"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Week-by-action (dense), week (observed) and period panels of identified sets.

    The events are read once, into units per week, action and address. The three groupings are
    stacked under one numbered group key, so their links, components and metrics come from one run.
    """
    from tallyweave.operators.panels import spine

    flags = flags or {}
    named = ["event_week", "action", "period", "minimum_event_week", "maximum_event_week"]
    fine = cut(_units(panel, ["event_week", "action"], unit, flags))
    none = {c: F.lit(None).cast("string") for c in ("action", "period")} | {c: F.lit(None).cast("int") for c in ("event_week", *named[3:])}
    cells = fine.withColumns({"_set": F.lit("cell")} | {c: none[c] for c in named[2:]})
    weeks = fine.withColumns({"_set": F.lit("week")} | {c: none[c] for c in named[1:]})
    framed = assign_periods(fine, periods.select(*named[2:])).withColumns({"_set": F.lit("period"), "event_week": none["event_week"], "action": none["action"]})
    stacked = cells.unionByName(weeks).unionByName(framed)
    # a number in place of the group's names, which every unit, link and label would carry
    labels = cut(stacked.select("_set", *named).distinct().withColumn("_group", F.monotonically_increasing_id()))
    units = attach(stacked, small_side(labels), ["_set", *named]).groupBy("_group", "address").agg(
        F.sum("weight").alias("weight"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *[F.sum(name).alias(name) for name in flags]
    )
    sets = cut(labels.join(_identified(cut(units), constraints, ["_group"], flags), "_group").drop("_group"))

    def only(kind: str, *keep: str) -> DataFrame:
        return sets.where(F.col("_set") == kind).drop("_set", *[c for c in named if c not in keep])

    dense = spine(panel, [], minimum, maximum).withColumn("action", F.explode(F.array(*[F.lit(a) for a in actions])))
    by_action = fill_zero(dense.join(only("cell", *named[:2]), named[:2], "left"), named[:2])
    return by_action, only("week", "event_week"), only("period", *named[2:])


def change_bounds(periods: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Post-minus-pre envelopes of the HHI: [lower - upper, upper - lower] per assumption.

    The address proxy is a point and never permits a conclusion about economic actors.
    """
    by = by or []
    cases = ", ".join(
        ["'address_proxy_point', address_proxy_hhi, address_proxy_hhi"] + [f"'{a}', {a}_hhi_lower, {a}_hhi_upper" for a in ASSUMPTIONS]
    )
    long = periods.where(F.col("period").isin("pre", "post")).selectExpr(
        *by, "period", f"stack({len(ASSUMPTIONS) + 1}, {cases}) AS (assumption, lower, upper)"
    )
    wide = long.groupBy(*by, "assumption").agg(
        *[F.max(F.when(F.col("period") == p, F.col(b))).alias(f"{p}_{b}") for p in ("pre", "post") for b in ("lower", "upper")]
    )
    point = F.col("assumption") == "address_proxy_point"
    low = F.when(point, F.col("post_lower") - F.col("pre_lower")).otherwise(F.col("post_lower") - F.col("pre_upper"))
    high = F.when(point, F.col("post_lower") - F.col("pre_lower")).otherwise(F.col("post_upper") - F.col("pre_lower"))
    out = wide.withColumns({"comparison": F.lit("post_minus_pre"), "metric": F.lit("hhi"), "change_lower": low, "change_upper": high})
    up, down = F.col("change_lower") > 0, F.col("change_upper") < 0
    direction = F.when(up, F.lit("increase")).when(down, F.lit("decrease")).otherwise(F.when(point, F.lit("zero")).otherwise(F.lit("not_identified")))
    return out.withColumns(
        {
            "sign_identified": point | up | down,
            "direction": direction,
            "economic_actor_conclusion_permitted": ~point & (up | down),
        }
    )
