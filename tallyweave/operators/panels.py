"""Dense unit-by-week panels and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import uint256
from tallyweave.functions.columns import blank_to_null, distinct_present, ratio
from tallyweave.operators.concentration import (
    concentration,
    concentration_of_units,
    incidences,
    unit_weights,
)
from tallyweave.operators.sizing import small_side
from tallyweave.session import cut

ROLES = ["actor_address", "beneficiary_address", "counterparty_address"]


def spine(df: DataFrame, by: list[str], minimum: int, maximum: int, week: str = "event_week") -> DataFrame:
    """Every week of the window for every observed group."""
    weeks = F.explode(F.sequence(F.lit(minimum), F.lit(maximum))).alias(week)
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    return groups.select(*by, weeks)


def fill_zero(df: DataFrame, keep: list[str]) -> DataFrame:
    """Absent cells become zero in every measure column."""
    filled = {}
    for field in df.schema.fields:
        if field.name not in keep:
            filled[field.name] = F.coalesce(F.col(field.name), F.lit(0).cast(field.dataType))
    return df.withColumns(filled) if filled else df


def participation_panel(
    df: DataFrame,
    by: list[str],
    minimum: int,
    maximum: int,
    week: str = "event_week",
    unit: str = "beneficiary_address",
) -> DataFrame:
    """Weekly participation and concentration against the immediately preceding week.

    Retained units are found with a lag over each unit's own active weeks, so the history of
    a unit is at most as long as the window and no week-to-week set join is needed. Exits
    follow from the previous week's size. The week before the window counts as empty.
    """
    inside = df.where(F.col(week).between(minimum, maximum))
    weekly = unit_weights(inside, [*by, week], unit)
    own = Window.partitionBy(*by, unit).orderBy(week)
    flow = (
        weekly.withColumn("_stayed", F.lag(week).over(own) == F.col(week) - 1)
        .groupBy(*by, week)
        .agg(F.count_if("_stayed").alias("retained_addresses"))
    )
    measures = concentration_of_units(
        weekly,
        [*by, week],
        top=(),
        top_fraction={"top1pct_share": 0.01, "top10pct_share": 0.10},
        nakamoto=0.51,
        gini=True,
    ).select(
        *by,
        week,
        F.col("observations").cast("bigint").alias("event_count"),
        F.col("units").alias("active_beneficiary_addresses"),
        F.col("hhi").alias("beneficiary_hhi"),
        F.col("gini").alias("beneficiary_gini"),
        "top1pct_share",
        "top10pct_share",
        F.col("nakamoto").alias("nakamoto_51"),
    )
    dense = spine(weekly, by, minimum, maximum, week).join(measures, [*by, week], "left").join(flow, [*by, week], "left")
    dense = fill_zero(dense, [*by, week])
    order = Window.partitionBy(*by).orderBy(week)
    prior = F.coalesce(F.lag("active_beneficiary_addresses").over(order), F.lit(0))
    return dense.withColumns(
        {
            "entrant_addresses": F.col("active_beneficiary_addresses") - F.col("retained_addresses"),
            "exit_addresses": (prior - F.col("retained_addresses")).cast("bigint"),
            "observed_unit": F.lit("beneficiary_address"),
            "causal_status": F.lit("descriptive_only"),
        }
    )


def overlap_panel(
    df: DataFrame,
    side: str,
    left: object,
    right: object,
    minimum: int,
    maximum: int,
    week: str = "event_week",
    unit: str = "beneficiary_address",
) -> DataFrame:
    """Weekly overlap of two populations: sizes, shared units, Jaccard and containment."""
    flags = (
        df.where(F.col(week).between(minimum, maximum) & F.col(side).isin(left, right))
        .groupBy(week, unit)
        .agg(F.max((F.col(side) == F.lit(left)).cast("int")).alias("_l"), F.max((F.col(side) == F.lit(right)).cast("int")).alias("_r"))
    )
    sizes = flags.groupBy(week).agg(
        F.sum("_l").alias("left_addresses"),
        F.sum("_r").alias("right_addresses"),
        F.sum(F.col("_l") * F.col("_r")).alias("shared_addresses"),
        F.count(F.lit(1)).alias("union_addresses"),
    )
    dense = fill_zero(spine(df, [], minimum, maximum, week).join(sizes, week, "left"), [week])
    shared = F.col("shared_addresses")
    return dense.withColumns(
        {
            "jaccard_overlap": ratio(shared, F.col("union_addresses")),
            "left_share_also_on_right": ratio(shared, F.col("left_addresses")),
            "right_share_also_on_left": ratio(shared, F.col("right_addresses")),
        }
    )


def incidence_concentration(df: DataFrame, by: list[str], roles: list[str] = ROLES) -> DataFrame:
    """Concentration with each address counted once per event over its roles."""
    rows = incidences(df.select(*by, *roles), roles)
    return _incidence_columns(concentration(rows, by, "address", top=()), by)


def _incidence_columns(out: DataFrame, by: list[str]) -> DataFrame:
    return out.select(
        *by,
        F.col("units").alias("active_addresses"),
        F.col("observations").cast("bigint").alias("address_event_incidences"),
        F.col("hhi").alias("activity_hhi"),
        F.col("adjusted_hhi").alias("adjusted_activity_hhi"),
        F.col("inverse_hhi").alias("effective_active_addresses"),
    )


def _cell_measures(df: DataFrame, by: list[str], distinct: dict[str, str], sums: list[Column] = (), roles: list[str] = ROLES) -> DataFrame:
    """Events, exact distinct counts, incidence concentration and sums per group, from one scan of the events.

    An event becomes a few facts: itself, its value in each counted column, and each address that takes
    part in it. Facts are counted per group, kind and value, mostly before the shuffle, and that
    one table of counts gives all measures. ``sums`` are aggregates over the events, named with a
    leading underscore; they come back under their names.
    """
    def fact(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    counted = [F.when(F.col(c).isNotNull(), fact(name, F.col(c))) for name, c in distinct.items()]
    parties = F.transform(distinct_present([blank_to_null(r) for r in roles]), lambda a: fact("_unit", a))
    facts = F.concat(F.array_compact(F.array(fact("_event", F.lit("")), *counted)), F.coalesce(parties, F.array().cast("array<struct<kind:string,value:string>>")))
    own = [c for c in ("amount_raw", "secondary_amount_raw") if c in df.columns]
    rows = df.select(*by, *own, F.explode(facts).alias("_f")).select(*by, F.col("_f.kind").alias("_kind"), F.col("_f.value").alias("_value"), *own)
    rows = rows.withColumns({c: F.when(F.col("_kind") == "_event", F.col(c)) for c in own})
    weights = cut(rows.groupBy(*by, "_kind", "_value").agg(F.count(F.lit(1)).alias("weight"), *sums))
    names = [c for c in weights.columns if c not in (*by, "_kind", "_value", "weight")]
    events = F.col("_kind") == "_event"
    counts = weights.groupBy(*by).agg(
        F.sum(F.when(events, F.col("weight"))).cast("bigint").alias("event_count"), *[F.count_if(F.col("_kind") == name).alias(name) for name in distinct],
        *[F.sum(F.when(events, F.col(c))).alias(c) for c in names],
    )
    units = weights.where("_kind = '_unit'").select(*by, F.col("_value").alias("address"), "weight")
    return counts.join(_incidence_columns(concentration_of_units(units, by, top=()), by), by, "left")


def action_panel(df: DataFrame, by: list[str], minimum: int, maximum: int, actions: list[str], week: str = "event_week") -> DataFrame:
    """Dense week-by-action panel: events, transactions, reserves, incidence concentration."""
    keys = [*by, week, "action"]
    measures = _cell_measures(df, keys, {"transaction_count": "tx_hash", "reserve_count": "reserve_address"})
    cells = spine(df, by, minimum, maximum, week).withColumn("action", F.explode(F.array(*[F.lit(a) for a in actions])))
    return fill_zero(cells.join(measures, keys, "left"), keys)


def reserve_panel(df: DataFrame, by: list[str], week: str = "event_week") -> DataFrame:
    """Observed week-action-reserve cells with exact raw sums, never across reserves."""
    keys = [*by, week, "action", "reserve_address"]
    has_second = "secondary_amount_raw" in df.columns
    parts = uint256.sum_parts("amount_raw", "_p")
    if has_second:
        parts = parts + uint256.sum_parts("secondary_amount_raw", "_s")
    out = _cell_measures(df, keys, {"transaction_count": "tx_hash"}, parts)
    out = out.withColumn("total_amount_raw", uint256.render_sum("_p")).drop(*uint256.part_names("_p"))
    if has_second:
        out = out.withColumn("total_secondary_amount_raw", uint256.render_sum("_s")).drop(*uint256.part_names("_s"))
    return out


def beneficiary_metrics(df: DataFrame, by: list[str], unit: str = "beneficiary_address") -> DataFrame:
    """Beneficiary bundle with the logical actor bounds, one row per observed group."""
    out = concentration(df.where(F.col(unit).isNotNull()), by, unit, top=(1, 10))
    return out.select(
        *by,
        F.col("observations").cast("bigint").alias("event_count"),
        F.col("units").alias("active_beneficiary_addresses"),
        F.col("hhi").alias("beneficiary_hhi"),
        F.col("entropy").alias("beneficiary_entropy"),
        F.col("normalized_entropy").alias("normalized_beneficiary_entropy"),
        F.col("effective_entropy").alias("effective_beneficiary_addresses"),
        F.col("inverse_hhi").alias("inverse_hhi_beneficiary_addresses"),
        F.col("top1_share").alias("top1_beneficiary_share"),
        F.col("top10_share").alias("top10_beneficiary_share"),
        ratio(F.lit(1.0), F.col("observations")).alias("event_split_actor_hhi_lower"),
        F.col("hhi").alias("stable_address_actor_hhi_lower"),
        F.lit(1.0).alias("actor_hhi_upper"),
    )


def beneficiary_panel(df: DataFrame, by: list[str], minimum: int, maximum: int, week: str = "event_week") -> DataFrame:
    """Dense weekly beneficiary panel with the number of distinct actions."""
    keys = [*by, week]
    metrics = beneficiary_metrics(df, keys)
    actions = df.groupBy(*keys, "action").agg(F.lit(1).alias("_x")).groupBy(*keys).agg(F.count("_x").alias("action_count"))
    dense = spine(df, by, minimum, maximum, week).join(metrics, keys, "left").join(actions, keys, "left")
    return fill_zero(dense, keys)


def calendar_family_panel(df: DataFrame, by: list[str], unit: str = "beneficiary_address") -> DataFrame:
    """Observed calendar-week panel with twelve-digit concentration values."""
    from tallyweave.functions.columns import significant

    out = concentration(df, by, unit, top=())
    normalized = F.when(F.col("units") > 1, F.col("adjusted_hhi")).otherwise(F.lit(1.0))
    return out.select(
        *by,
        F.col("observations").cast("bigint").alias("event_count"),
        F.col("units").alias("active_beneficiary_addresses"),
        significant("hhi", 12).alias("beneficiary_event_hhi"),
        significant(normalized, 12).alias("normalized_beneficiary_event_hhi"),
    )


def stack_panels(panels: dict[str, DataFrame], label: str = "chain") -> DataFrame:
    """Union of panels under a label, with nulls where a panel lacks a column."""
    out = None
    for name, panel in panels.items():
        tagged = panel.withColumn(label, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def comparable_reserve_rows(panel: DataFrame, reserves: DataFrame, by: str = "chain_id") -> DataFrame:
    """Rows of one named reserve per chain."""
    return panel.join(small_side(reserves), [by, "reserve_address"], "left_semi")


def period_of(week: Column) -> Column:
    return F.when(week < 0, F.lit("pre")).when(week == 0, F.lit("week_zero")).otherwise(F.lit("post"))


def pre_post(panel: DataFrame, by: list[str], metrics: list[str], week: str = "event_week") -> DataFrame:
    """Pre and post means and relative change per metric; week zero is in neither."""
    w = F.col(week)
    aggregates = [F.count_if(w < 0).alias("pre_weeks"), F.count_if(w > 0).alias("post_weeks")]
    for metric in metrics:
        aggregates += [F.avg(F.when(w < 0, F.col(metric))).alias(f"pre_mean_{metric}"), F.avg(F.when(w > 0, F.col(metric))).alias(f"post_mean_{metric}")]
    out = panel.groupBy(*by).agg(*aggregates)
    for metric in metrics:
        change = F.when(F.col(f"pre_mean_{metric}") != 0, F.col(f"post_mean_{metric}") / F.col(f"pre_mean_{metric}") - 1)
        out = out.withColumn(f"relative_change_{metric}", change)
    return out


def pre_post_decimal(panel: DataFrame, by: list[str], metric: str, week: str = "event_week") -> DataFrame:
    """The published form: decimal means and fifteen-significant-digit text."""
    from tallyweave.functions.columns import significant_text

    w, value = F.col(week), F.col(metric).cast("decimal(38,18)")
    out = panel.groupBy(*by).agg(
        F.count_if(w < 0).alias("pre_weeks"),
        F.count_if(w > 0).alias("post_weeks"),
        F.sum(F.when(w < 0, value)).alias("_pre"),
        F.sum(F.when(w > 0, value)).alias("_post"),
    )
    pre = F.col("_pre").cast("double") / F.col("pre_weeks")
    post = F.col("_post").cast("double") / F.col("post_weeks")
    return out.select(
        *by,
        "pre_weeks",
        "post_weeks",
        significant_text(pre).alias(f"pre_mean_{metric}"),
        significant_text(post).alias(f"post_mean_{metric}"),
        significant_text(post / pre - 1).alias("relative_change"),
    )


def period_means(panel: DataFrame, by: list[str], metrics: list[str], week: str = "event_week") -> DataFrame:
    period = period_of(F.col(week)).alias("period")
    return panel.groupBy(*by, period).agg(*[F.avg(m).alias(m) for m in metrics])


def index_to_pre_mean(panel: DataFrame, by: list[str], metric: str, name: str, week: str = "event_week") -> DataFrame:
    """Metric as a percentage of its pre-period mean."""
    base = panel.groupBy(*by).agg(F.avg(F.when(F.col(week) < 0, F.col(metric))).alias("_base"))
    return panel.join(base, by).withColumn(name, F.lit(100.0) * F.col(metric) / F.col("_base")).drop("_base")


def index_to_baseline(df: DataFrame, scenario: str, baseline: object, on: list[str], metric: str, name: str) -> DataFrame:
    """Metric relative to the baseline scenario at the same parameter values."""
    base = df.where(F.col(scenario) == F.lit(baseline)).select(*on, F.col(metric).alias("_base"))
    return df.join(base, on).withColumn(name, F.col(metric) / F.col("_base")).drop("_base")


def action_ranges(panel: DataFrame, by: list[str]) -> DataFrame:
    """Minimum, maximum and total of the weekly event counts per action."""
    return panel.groupBy(*by).agg(
        F.min("event_count").alias("minimum"), F.max("event_count").alias("maximum"), F.sum("event_count").alias("total")
    )


def event_count_panel(df: DataFrame, by: list[str], minimum: int, maximum: int, actions: list[str], week: str = "event_week") -> DataFrame:
    """Dense week-by-action event counts."""
    keys = [*by, week, "action"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"))
    cells = spine(df, by, minimum, maximum, week).withColumn("action", F.explode(F.array(*[F.lit(a) for a in actions])))
    return fill_zero(cells.join(counts, keys, "left"), keys)
