"""Staggered adoption: group-time effects, multiplier bootstrap and a two-way fixed-effect study."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.sizing import small_side, with_scalar
from tallyweave.session import cut

NEVER = 2**31 - 1


def unit_paths(panel: DataFrame, unit: str, period: str, first: str, outcome: str) -> tuple[DataFrame, list[int]]:
    """One row per unit observed in every period: outcome array over the sorted periods.

    The array is as long as the calendar, so it is bounded whatever the number of units. A unit
    with two rows in one period fails the job; units that lack a period are left out and listed
    by :func:`incomplete_units`.
    """
    periods = [row[0] for row in panel.select(period).distinct().orderBy(period).collect()]
    points = F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col(outcome).cast("double").alias("y"))))
    units = panel.groupBy(F.col(unit).alias("unit")).agg(
        points.alias("_points"), F.coalesce(F.max(F.nullif(F.col(first), F.lit(0))), F.lit(NEVER)).cast("bigint").alias("cohort")
    )
    seen = F.transform("_points", lambda s: s["p"])
    twice = F.raise_error(F.concat(F.lit("repeated period of unit "), F.col("unit").cast("string"))).cast("boolean")
    whole = F.when(F.size(F.array_distinct(seen)) != F.size(seen), twice).otherwise(seen == _calendar(panel, period, periods))
    units = units.where(whole) if periods else units
    return units.select("unit", F.transform("_points", lambda s: s["y"]).alias("path"), "cohort"), periods


def _calendar(panel: DataFrame, period: str, periods: list) -> Column:
    kind = panel.schema[period].dataType.simpleString()
    return F.array(*[F.lit(p) for p in periods]).cast(f"array<{kind}>")


def incomplete_units(panel: DataFrame, unit: str, period: str) -> DataFrame:
    """Units that lack a period of the panel, with the number of periods they have."""
    periods = panel.agg(F.count_distinct(period).alias("_all"))
    counts = panel.groupBy(F.col(unit).alias("unit")).agg(F.count_distinct(period).alias("periods"))
    return with_scalar(counts, periods).where(F.col("periods") < F.col("_all")).drop("_all")


def att_cells(spark, cohorts: list[int], periods: list[int]) -> DataFrame:
    """Group-time cells with their base period: g - 1 from treatment on, t - 1 before it."""
    place = {p: i for i, p in enumerate(periods)}
    rows = []
    for g in cohorts:
        before = [p for p in periods if p < g]
        if not before:
            continue  # treated from the start: no base period
        for t in periods[1:]:
            base = before[-1] if t >= g else periods[place[t] - 1]
            rows.append((int(g), int(t), place[t] + 1, place[base] + 1, int(max(t, base))))
    return spark.createDataFrame(rows, "g bigint, t bigint, at int, base int, horizon bigint")


def group_time_att(panel: DataFrame, unit: str, period: str, first: str, outcome: str) -> DataFrame:
    """Average effect per cohort and period against units not yet treated.

    Long differences are array look-ups on each unit's path, and a cell needs only the count,
    sum and sum of squares of its two sides, so the shuffle carries a few rows per task.
    """
    units, periods = unit_paths(panel, unit, period, first, outcome)
    units = cut(units)
    return _att_from_paths(units, periods)


def _cells_for(units: DataFrame, periods: list[int]) -> DataFrame:
    cohorts = [r[0] for r in units.select("cohort").distinct().where(F.col("cohort") <= max(periods)).orderBy("cohort").collect()]
    return att_cells(units.sparkSession, cohorts, periods)


def _differences(units: DataFrame, cells: DataFrame) -> DataFrame:
    treated = F.col("cohort") == F.col("g")
    control = ~treated & (F.col("cohort") > F.col("horizon"))
    joined = units.join(small_side(cells), treated | control)
    change = F.element_at("path", F.col("at")) - F.element_at("path", F.col("base"))
    return joined.select("unit", "g", "t", treated.alias("treated"), change.alias("d"))


def _att_from_paths(units: DataFrame, periods: list[int]) -> DataFrame:
    cells = _cells_for(units, periods)
    sums = _differences(units, cells).groupBy("g", "t", "treated").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss")
    )
    mean, spread = F.col("s") / F.col("n"), (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") * F.col("n"))
    parts = sums.select("g", "t", "treated", "n", mean.alias("m"), F.greatest(spread, F.lit(0.0)).alias("v"))
    wide = parts.groupBy("g", "t").agg(
        *[F.max(F.when(F.col("treated") == flag, F.col(c))).alias(f"{c}_{side}") for flag, side in ((True, "t"), (False, "c")) for c in ("n", "m", "v")]
    )
    return wide.where("n_t IS NOT NULL AND n_c IS NOT NULL").select(
        "g",
        "t",
        F.col("n_t").cast("bigint").alias("treated_units"),
        F.col("n_c").cast("bigint").alias("control_units"),
        (F.col("m_t") - F.col("m_c")).alias("att"),
        F.sqrt(F.col("v_t") + F.col("v_c")).alias("se"),
        F.col("m_t").alias("treated_mean"),
        F.col("m_c").alias("control_mean"),
    )


#: Draws that one digest gives, 24 bits each.
PER_DIGEST = 10


def _uniform(units: list[str], draws: int, seed: int) -> np.ndarray:
    """Uniform numbers (draws by units) from counters: hexadecimal digits of SHA-256 of ``unit:block:seed``.

    Draw d of a unit takes six digits of block d // 10, so any engine with that hash repeats them.
    """
    blocks = -(-draws // PER_DIGEST)
    out = np.empty((blocks * PER_DIGEST, len(units)))
    for j, name in enumerate(units):
        digits = "".join(hashlib.sha256(f"{name}:{block}:{seed}".encode()).hexdigest()[: 6 * PER_DIGEST] for block in range(blocks))
        raw = np.frombuffer(bytes.fromhex(digits), np.uint8).reshape(-1, 3).astype(np.int64)
        out[:, j] = ((raw[:, 0] << 16) + (raw[:, 1] << 8) + raw[:, 2]) / float(1 << 24)
    return out[:draws]


def multiplier_bootstrap(
    panel: DataFrame, unit: str, period: str, first: str, outcome: str, draws: int = 199, seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Cell draws and bootstrap standard errors, clustered by unit with two-point weights.

    Each task multiplies its units' weights with their centred differences (a draws-by-cells
    product), and the partial products are summed across tasks.
    """
    units, periods = unit_paths(panel, unit, period, first, outcome)
    units = cut(units)
    att = cut(_att_from_paths(units, periods))
    cells = _cells_for(units, periods)
    centred = _differences(units, cells).join(small_side(att), ["g", "t"])
    mean = F.when(F.col("treated"), F.col("treated_mean")).otherwise(F.col("control_mean"))
    sign = F.when(F.col("treated"), F.lit(1.0) / F.col("treated_units")).otherwise(F.lit(-1.0) / F.col("control_units"))
    influence = centred.select(F.col("unit").cast("string").alias("u"), "g", "t", ((F.col("d") - mean) * sign).alias("w"))
    root5 = 5.0**0.5
    low, high, p_low = (1 - root5) / 2, (1 + root5) / 2, (1 + root5) / (2 * root5)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            inverse, names = pd.factorize(batch["u"])
            weights = np.where(_uniform(names.tolist(), draws, seed) < p_low, low, high)
            for key, part in batch.groupby(["g", "t"]):
                values = weights[:, inverse[part.index.to_numpy()]] @ part["w"].to_numpy()
                total[key] = total.get(key, 0.0) + values
        for (g, t), values in total.items():
            yield pd.DataFrame({"g": g, "t": t, "draw": np.arange(draws), "value": values})

    partial = influence.mapInPandas(draw, "g bigint, t bigint, draw int, value double")
    cell_draws = cut(partial.groupBy("g", "t", "draw").agg(F.sum("value").alias("value")))
    quartiles = cell_draws.groupBy("g", "t").agg(F.percentile("value", F.lit(0.75)).alias("_hi"), F.percentile("value", F.lit(0.25)).alias("_lo"))
    spread = (F.col("_hi") - F.col("_lo")) / F.lit(1.3489795003921634)  # interquartile range of a standard normal
    out = att.join(quartiles, ["g", "t"]).withColumn("bootstrap_se", spread).drop("_hi", "_lo", "treated_mean", "control_mean")
    return cell_draws, out


def dynamic_effects(att: DataFrame, cell_draws: DataFrame | None = None) -> DataFrame:
    """Effects by time since treatment, cohorts weighted by size, and the overall post effect."""
    e = F.col("t") - F.col("g")
    weight = F.col("treated_units").cast("double")
    out = att.groupBy(e.alias("event_time")).agg(
        (F.sum(weight * F.col("att")) / F.sum(weight)).alias("att"),
        F.count(F.lit(1)).alias("cohort_count"),
        F.sum("treated_units").cast("bigint").alias("treated_units"),
    )
    overall = out.where("event_time >= 0").agg(F.avg("att").alias("overall_att"))
    out = with_scalar(out, overall)
    if cell_draws is None:
        return out
    drawn = cell_draws.join(small_side(att.select("g", "t", "treated_units")), ["g", "t"])
    per_draw = drawn.groupBy(e.alias("event_time"), "draw").agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("value"))
    q = per_draw.groupBy("event_time").agg(F.percentile("value", F.lit(0.75)).alias("_hi"), F.percentile("value", F.lit(0.25)).alias("_lo"))
    return out.join(q, "event_time").withColumn("bootstrap_se", (F.col("_hi") - F.col("_lo")) / F.lit(1.3489795003921634)).drop("_hi", "_lo")


def twfe_event_study(
    panel: DataFrame, unit: str, period: str, event_time: str, treated: str, outcome: str, reference: int = -1
) -> DataFrame:
    """Outcome on event-time-by-treated dummies with unit and period effects.

    A row touches two regressors at most, its period and its event time, so it is kept as the
    numbers of these two. Unit effects are eliminated exactly (Schur complement): a unit
    takes the outer product of its regressor counts, divided by its rows, from the normal
    equations. Units with the same counts are counted together before their products are made. What
    is left is one small system over periods and event times, solved once; periods are then
    eliminated from it, and event times that can't be told apart get the least solution.
    Clustered errors need each unit's residual sums weighted with the rows of the solution.
    """
    hit = F.col(treated).cast("int") == 1
    data = panel.select(
        F.col(unit).alias("unit"), F.col(period).cast("bigint").alias("p"), F.col(outcome).cast("double").alias("y"),
        F.when(hit & (F.col(event_time) != reference), F.col(event_time)).cast("bigint").alias("e"),
    )
    # rows meet their unit once: later sums by unit find it whole in a task and shuffle one row of it
    cells = cut(data.repartition("unit").groupBy("unit", "p", "e").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("s")))
    touched = F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("kind"), F.col("p").alias("at")), F.when(F.col("e").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("e").alias("at"))))))
    units = cells.groupBy("unit").agg(
        F.sum("c").cast("double").alias("n"), F.sum("s").alias("total"), F.sort_array(F.collect_list(F.struct("p", "e", "c"))).alias("pattern")
    )  # a unit's pattern is as long as the calendar at most
    units = units.groupBy("pattern", "n").agg(F.count(F.lit(1)).alias("units"), F.sum(F.col("total") / F.col("n")).alias("means"))
    patterns = cut(units.withColumn("id", F.monotonically_increasing_id()))
    counts = patterns.select("id", "n", "units", "means", F.explode("pattern").alias("_r")).select("id", "n", "units", "means", "_r.*")
    counts = cut(counts.select("id", "n", "units", "means", "c", touched.alias("x")).groupBy("id", "n", "units", "means", "x").agg(F.sum("c").alias("c")))
    lists = counts.groupBy("id", "n", "units").agg(F.collect_list(F.struct("x", "c")).alias("pattern"))
    left = lists.select("n", "units", "pattern", F.explode("pattern").alias("a")).select("n", "units", "a", F.explode("pattern").alias("b"))
    outer = left.groupBy(F.col("a.x").alias("a"), F.col("b.x").alias("b")).agg((-F.sum(F.col("units") * F.col("a.c") * F.col("b.c") / F.col("n"))).alias("v"))
    direct = counts.groupBy(F.col("x").alias("a")).agg(F.sum(F.col("units") * F.col("c")).cast("double").alias("v")).select("a", F.col("a").alias("b"), "v")
    period_of, event_of = F.struct(F.lit(0).alias("kind"), F.col("p").alias("at")), F.struct(F.lit(1).alias("kind"), F.col("e").alias("at"))
    crossed = cells.where("e IS NOT NULL").groupBy("p", "e").agg(F.sum("c").cast("double").alias("v"))
    crossed = crossed.select(period_of.alias("a"), event_of.alias("b"), "v").unionByName(crossed.select(event_of.alias("a"), period_of.alias("b"), "v"))
    system = outer.unionByName(direct).unionByName(crossed).groupBy("a", "b").agg(F.sum("v").alias("v")).collect()  # calendar squared
    moments_of = cells.groupBy("p", "e").agg(F.sum("s").alias("s")).select("s", touched.alias("x")).select("x", F.col("s").alias("v"))
    moments_of = moments_of.unionByName(counts.select("x", (-F.col("means") * F.col("c")).alias("v")))
    right = moments_of.groupBy("x").agg(F.sum("v").alias("v")).collect()
    clusters, n = (int(x or 0) for x in patterns.agg(F.sum("units"), F.sum(F.col("units") * F.col("n"))).first())
    places = sorted({(r.x.kind, r.x.at) for r in right})
    number = {at: i for i, at in enumerate(places)}
    matrix, moments = np.zeros((len(places), len(places))), np.zeros(len(places))
    for r in system:
        matrix[number[r.a.kind, r.a.at], number[r.b.kind, r.b.at]] += r.v
    for r in right:
        moments[number[r.x.kind, r.x.at]] = r.v
    n_periods = sum(kind == 0 for kind, _ in places)
    times = [at for kind, at in places if kind == 1]
    inner = np.linalg.pinv(matrix[:n_periods, :n_periods])
    cross = matrix[n_periods:, :n_periods] @ inner
    inverse = np.linalg.pinv(matrix[n_periods:, n_periods:] - cross @ matrix[:n_periods, n_periods:])
    beta = inverse @ (moments[n_periods:] - cross @ moments[:n_periods])
    gamma = inner @ (moments[:n_periods] - matrix[:n_periods, n_periods:] @ beta)
    rows_of = np.hstack([-inverse @ cross, inverse])  # maps a unit's score over all regressors to its share of each estimate
    spark = data.sparkSession
    values = [(int(k), int(at), float(v), [float(x) for x in rows_of[:, i]]) for i, ((k, at), v) in enumerate(zip(places, [*gamma, *beta], strict=True))]
    known = spark.createDataFrame(values, "kind int, at bigint, v double, w array<double>")
    by_period, by_event = (F.broadcast(known.where(F.col("kind") == k).select(F.col("at").alias(name), F.col("v").alias(f"v_{name}"), F.col("w").alias(f"w_{name}"))) for k, name in ((0, "p"), (1, "e")))
    fitted = cells.join(by_period, "p").join(by_event, "e", "left")
    raw = fitted.withColumn("u", F.col("s") - F.col("c") * (F.col("v_p") + F.coalesce("v_e", F.lit(0.0))))
    # a unit's score less its mean residual, as sums of the unit: one row a unit holds all estimates
    weights = [f"(w_p[{i}] + coalesce(w_e[{i}], 0D))" for i in range(len(times))]
    scored = raw.groupBy("unit").agg(
        (F.sum("u") / F.sum("c")).alias("m"), *[F.expr(f"cast(array({', '.join(f'sum({w} * {x})' for w in weights)}) AS array<double>)").alias(f"_{x}") for x in ("u", "c")]
    )
    spread = scored.select(F.posexplode(F.zip_with("_u", "_c", lambda u, c: u - F.col("m") * c)).alias("i", "h")).groupBy("i").agg(F.sum(F.col("h") * F.col("h")).alias("v"))
    variance = {r.i: r.v for r in spread.collect()}
    params = len(times) + n_periods
    small = clusters / (clusters - 1) * (n - 1) / (n - params)
    out = [(int(t), float(beta[i]), float(max(variance.get(i, 0.0) * small, 0.0) ** 0.5), int(n), int(clusters)) for i, t in enumerate(times)]
    return spark.createDataFrame(out, "event_time bigint, estimate double, cluster_se double, n bigint, clusters bigint")
