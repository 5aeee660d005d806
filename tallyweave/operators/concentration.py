"""Concentration measures of a distribution of activity over units.

Every measure is read from the weight histogram of a group: how many units have each weight.
For counts the histogram of a group with W events has at most sqrt(2 W) rows, since distinct
positive integers that add up to W cannot be more. The rank-based measures therefore need a
window over a bounded number of rows even when one group holds most of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.columns import blank_to_null, distinct_present
from tallyweave.operators.ordering import running_before
from tallyweave.operators.sizing import attach


def unit_weights(df: DataFrame, by: list[str], unit: str, weight: str | None = None) -> DataFrame:
    """Weight of every unit in every group: event count, or the sum of ``weight``."""
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*by, unit).agg(measure.alias("weight"))


def weight_histogram(units: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    return units.groupBy(*by, F.col(weight).alias("w")).agg(F.count(F.lit(1)).alias("m"))


def concentration(
    df: DataFrame,
    by: list[str],
    unit: str,
    weight: str | None = None,
    top: tuple[int, ...] = (1, 5, 10),
    top_fraction: dict[str, float] | None = None,
    nakamoto: float | None = None,
    gini: bool = False,
    real: bool = False,
) -> DataFrame:
    """Concentration bundle per group.

    Columns: ``observations`` (total weight), ``units``, ``hhi``, ``inverse_hhi``,
    ``adjusted_hhi`` (one when there is a single unit), ``entropy``, ``normalized_entropy``,
    ``effective_entropy`` and, when asked for, ``top<k>_share``, the named top-fraction
    shares, ``nakamoto`` and ``gini``. ``real`` marks weights that are not counts, whose
    histogram is not bounded; their running totals are then split over value buckets.
    """
    units = unit_weights(df, by, unit, weight)
    return concentration_of_units(units, by, top, top_fraction, nakamoto, gini, real)


def concentration_of_units(
    units: DataFrame,
    by: list[str],
    top: tuple[int, ...] = (1, 5, 10),
    top_fraction: dict[str, float] | None = None,
    nakamoto: float | None = None,
    gini: bool = False,
    real: bool = False,
    weight: str = "weight",
) -> DataFrame:
    histogram = weight_histogram(units, by, weight)
    ranked = bool(top or top_fraction or nakamoto is not None or gini)
    w, m = F.col("w").cast("double"), F.col("m").cast("double")
    if ranked:
        histogram = _with_ranks(histogram, by, real)
    aggregates = [
        F.sum("m").alias("units"),
        F.sum(m * w).alias("observations"),
        F.sum(m * w * w).alias("_w2"),
        F.sum(F.when(w > 0, m * w * F.ln(w)).otherwise(F.lit(0.0))).alias("_wlnw"),
    ]
    if ranked:
        n, total = F.col("_n"), F.col("_W")
        above = F.col("_above").cast("double")
        heavier = F.col("_heavier").cast("double")

        def taken(k: Column) -> Column:
            return F.sum(w * F.least(F.greatest(k - above, F.lit(0.0)), m))

        aggregates += [taken(F.lit(float(k))).alias(f"_top{k}") for k in top]
        for name, fraction in (top_fraction or {}).items():
            size = F.greatest(F.lit(1.0), F.ceil(n * F.lit(float(fraction))).cast("double"))
            aggregates.append(taken(size).alias(f"_frac_{name}"))
        if gini:
            below = F.col("_below").cast("double")
            ranks = m * below + m * (m + 1) / F.lit(2.0)
            aggregates.append(F.sum(w * ranks).alias("_ranksum"))
        if nakamoto is not None:
            aggregates.append(F.min(_needed_units(w, m, above, heavier, total, nakamoto)).alias("_nakamoto"))
    out = histogram.groupBy(*by).agg(*aggregates)
    total, n = F.col("observations"), F.col("units").cast("double")
    has = total > 0
    hhi = F.when(has, F.col("_w2") / (total * total)).otherwise(F.lit(0.0))
    entropy = F.when(has, F.ln(total) - F.col("_wlnw") / total).otherwise(F.lit(0.0))
    out = out.withColumn("hhi", hhi).withColumn("entropy", F.greatest(entropy, F.lit(0.0)))
    columns = [
        *by,
        F.col("observations"),
        F.col("units").cast("bigint").alias("units"),
        F.col("hhi"),
        F.when(F.col("hhi") > 0, F.lit(1.0) / F.col("hhi")).otherwise(F.lit(0.0)).alias("inverse_hhi"),
        adjusted_hhi(F.col("hhi"), n).alias("adjusted_hhi"),
        F.col("entropy"),
        F.when(n > 1, F.col("entropy") / F.ln(n)).otherwise(F.lit(0.0)).alias("normalized_entropy"),
        F.when(has, F.exp("entropy")).otherwise(F.lit(0.0)).alias("effective_entropy"),
    ]
    columns += [share(F.col(f"_top{k}"), total).alias(f"top{k}_share") for k in top]
    columns += [share(F.col(f"_frac_{name}"), total).alias(name) for name in (top_fraction or {})]
    if gini:
        value = F.lit(2.0) * F.col("_ranksum") / (n * total) - (n + 1) / n
        columns.append(F.when(has, value).otherwise(F.lit(0.0)).alias("gini"))
    if nakamoto is not None:
        columns.append(F.coalesce(F.col("_nakamoto"), F.lit(0)).cast("bigint").alias("nakamoto"))
    return out.select(*columns)


def _with_ranks(histogram: DataFrame, by: list[str], real: bool) -> DataFrame:
    """Add units below, units above, heavier weight and the group totals to each block."""
    placed = histogram.withColumn("_mw", F.col("m") * F.col("w"))
    placed = running_before(placed, by, "w", {"_below": "m", "_lighter": "_mw"}, bucketed=real)
    totals = histogram.groupBy(*by).agg(
        F.sum("m").alias("_n"), F.sum(F.col("m") * F.col("w")).alias("_W")
    )
    if not real:
        group = Window.partitionBy(*by)
        placed = placed.withColumns({"_n": F.sum("m").over(group), "_W": F.sum("_mw").over(group)})
    else:
        placed = attach(placed, totals, by)
    return placed.withColumns(
        {
            "_above": F.col("_n") - F.col("_below") - F.col("m"),
            "_heavier": F.col("_W") - F.col("_lighter") - F.col("_mw"),
        }
    )


def _needed_units(w: Column, m: Column, above: Column, heavier: Column, total: Column, threshold: float) -> Column:
    """Units needed to reach the threshold share when it is reached inside this block."""
    goal = F.lit(float(threshold))
    guess = F.greatest(F.lit(1.0), F.ceil((goal * total - heavier) / w).cast("double"))

    def reached(j: Column) -> Column:
        return (heavier + j * w) / total >= goal

    exact = F.when((guess > 1) & reached(guess - 1), guess - 1).when(reached(guess), guess).otherwise(guess + 1)
    return F.when((w > 0) & (total > 0) & reached(m), above + exact)


def share(part: Column, total: Column) -> Column:
    return F.when(total > 0, part.cast("double") / total).otherwise(F.lit(0.0))


def adjusted_hhi(hhi: Column, n: Column) -> Column:
    """(H - 1/n) / (1 - 1/n), one for a single unit and zero for none."""
    value = (hhi - F.lit(1.0) / n) / (F.lit(1.0) - F.lit(1.0) / n)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.when(n > 1, clipped).when(n == 1, F.lit(1.0)).otherwise(F.lit(0.0))


def gini(df: DataFrame, by: list[str], unit: str, weight: str | None = None, real: bool = False) -> DataFrame:
    """Gini coefficient of unit weights. Real weights drop non-finite values and clip at zero."""
    units = unit_weights(df, by, unit, weight)
    if real:
        finite = ~F.isnan("weight") & ~F.col("weight").isin(float("inf"), float("-inf"))
        units = units.where(finite).withColumn("weight", F.greatest("weight", F.lit(0.0)))
    return concentration_of_units(units, by, (), None, None, True, real).select(*by, "gini")


def incidences(df: DataFrame, roles: list[str], address: str = "address") -> DataFrame:
    """One row per event and distinct participating address."""
    return df.withColumn(address, F.explode(distinct_present([blank_to_null(r) for r in roles])))


def hhi_sensitivity(df: DataFrame, by: list[str], activity: str, marginal: str) -> DataFrame:
    """HHI and its derivative (2/X) sum((s - H) dx) along a marginal change of activity."""
    x, dx = F.col(activity).cast("double"), F.col(marginal).cast("double")
    sums = df.groupBy(*by).agg(
        F.sum(x).alias("X"), F.sum(x * x).alias("xx"), F.sum(x * dx).alias("xdx"), F.sum(dx).alias("dx")
    )
    hhi = F.col("xx") / (F.col("X") * F.col("X"))
    slope = F.lit(2.0) / F.col("X") * (F.col("xdx") / F.col("X") - hhi * F.col("dx"))
    live = F.col("X") > 0
    return sums.select(
        *by,
        F.when(live, hhi).otherwise(F.lit(0.0)).alias("hhi"),
        F.when(live, slope).otherwise(F.lit(0.0)).alias("hhi_derivative"),
    )


def removal_loss(df: DataFrame, by: list[str], group: str, activity: str) -> DataFrame:
    """Group HHI, the largest group's share and the share lost when that group is removed."""
    groups = df.groupBy(*by, group).agg(F.sum(activity).alias("a"))
    sums = groups.groupBy(*by).agg(
        F.sum("a").alias("A"),
        F.sum(F.col("a") * F.col("a")).alias("aa"),
        F.max("a").alias("largest"),
        F.max_by(group, F.struct("a", group)).alias("largest_group"),
        F.count(F.lit(1)).alias("group_count"),
    )
    live = F.col("A") > 0
    return sums.select(
        *by,
        "group_count",
        F.col("A").alias("total_activity"),
        F.when(live, F.col("aa") / (F.col("A") * F.col("A"))).otherwise(F.lit(0.0)).alias("group_hhi"),
        "largest_group",
        F.when(live, F.col("largest") / F.col("A")).otherwise(F.lit(0.0)).alias("largest_group_removal_loss"),
    )
