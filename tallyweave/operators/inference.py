"""Event-study regressions for many groups at once, with calendar-aware HAC covariance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.columns import significant
from tallyweave.functions.stats import solve_normal, two_sided_p
from tallyweave.operators.sizing import attach, small_side
from tallyweave.session import cut


def two_by_two(df: DataFrame, by: list[str], outcome: str, treated: str = "treated", post: str = "post") -> DataFrame:
    """(T1 - T0) - (C1 - C0) from four conditional means; an empty cell fails the job."""
    t, p = F.col(treated).cast("int"), F.col(post).cast("int")
    cells = {"treated_pre": (1, 0), "treated_post": (1, 1), "control_pre": (0, 0), "control_post": (0, 1)}
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_observations"),
        *[F.avg(F.when((t == a) & (p == b), F.col(outcome))).alias(name) for name, (a, b) in cells.items()],
    )
    checked = {n: F.coalesce(F.col(n), F.raise_error(F.lit(f"empty cell {n}")).cast("double")) for n in cells}
    out = out.withColumns(checked)
    change = (F.col("treated_post") - F.col("treated_pre")) - (F.col("control_post") - F.col("control_pre"))
    return out.withColumn("estimate", change)


def _at(array: str, i: int) -> Column:
    return F.element_at(array, i + 1)


def hac_ols(
    df: DataFrame, by: list[str], y: str, xs: list[str], t: str, lag: int | str, maximum_lag: int | None = None, row_adjacent: bool = False
) -> DataFrame:
    """OLS with an intercept and Bartlett HAC covariance, one fit per group.

    ``lag`` is a number or a column that is constant within a group (then ``maximum_lag``
    bounds it). Pairs count by calendar distance ``1 <= t - s <= lag``; with ``row_adjacent``
    the distance is in rows. The lagged scores come from range frames over each group's time
    series, so there is no pairwise join, and a group is as long as its calendar.

    Returns ``by, n, k, coef_i, se_i`` and the covariance as the array ``cov``.
    """
    names = ["_x0", *[f"_x{i + 1}" for i in range(len(xs))]]
    k = len(names)
    base = df.select(
        *by, F.col(t).alias("_t"), F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_x0"),
        *[F.col(x).cast("double").alias(f"_x{i + 1}") for i, x in enumerate(xs)],
        (F.lit(lag) if isinstance(lag, int) else F.col(lag)).cast("int").alias("_lag"),
    )
    if row_adjacent:
        base = base.withColumn("_t", F.row_number().over(Window.partitionBy(*by).orderBy("_t")))
    base = cut(base)  # a panel of calendar size; the source is read once, not per pass
    top_lag = lag if isinstance(lag, int) else maximum_lag
    if top_lag is None:
        raise ValueError("maximum_lag is needed when lag is a column")
    xtx = [F.sum(F.col(a) * F.col(b)) for a in names for b in names]
    xty = [F.sum(F.col(a) * F.col("_y")) for a in names]
    sums = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*xtx).alias("_xtx"), F.array(*xty).alias("_xty"))
    if k == 2:
        a, b, d = _at("_xtx", 0), _at("_xtx", 1), _at("_xtx", 3)
        # a singular design has rank one, whose pseudo-inverse is the matrix over its squared trace
        singular = F.abs(a * d - b * b) <= F.lit(1e-14) * a * d
        det, trace = F.nullif(a * d - b * b, F.lit(0.0)), (a + d) * (a + d)
        sums = sums.withColumn(
            "_inv", F.when(singular, F.array(a / trace, b / trace, b / trace, d / trace)).otherwise(F.array(d / det, -b / det, -b / det, a / det))
        )
        u, v = _at("_xty", 0), _at("_xty", 1)
        sums = sums.withColumn("_beta", F.array(*[_at("_inv", 2 * i) * u + _at("_inv", 2 * i + 1) * v for i in range(2)]))
    else:
        sums = sums.withColumn("_s", solve_normal("_xtx", "_xty"))
        sums = sums.withColumns({"_beta": F.col("_s.beta"), "_inv": F.col("_s.inverse")})
    fits = sums.select(*by, "n", "_beta", "_inv")
    fitted = attach(base, fits.select(*by, "_beta"), by)
    value = F.lit(0.0)
    for i, x in enumerate(names):
        value = value + _at("_beta", i) * F.col(x)
    scored = fitted.withColumn("_u", F.col("_y") - value)
    scored = scored.withColumns({f"_s{i}": F.col("_u") * F.col(x) for i, x in enumerate(names)})
    series = Window.partitionBy(*by).orderBy("_t")
    lagged = {}
    for i in range(k):
        total = F.lit(0.0)
        for d in range(1, top_lag + 1):
            weight = F.when(F.col("_lag") >= d, F.lit(1.0) - F.lit(float(d)) / (F.col("_lag") + F.lit(1.0))).otherwise(F.lit(0.0))
            total = total + weight * F.coalesce(F.sum(f"_s{i}").over(series.rangeBetween(-d, -d)), F.lit(0.0))
        lagged[f"_z{i}"] = total
    scored = scored.withColumns(lagged)
    meat = [
        F.sum(F.col(f"_s{i}") * F.col(f"_s{j}") + F.col(f"_s{i}") * F.col(f"_z{j}") + F.col(f"_z{i}") * F.col(f"_s{j}"))
        for i in range(k)
        for j in range(k)
    ]
    meats = scored.groupBy(*by).agg(F.array(*meat).alias("_meat"))
    joined = attach(fits, meats, by)
    half = []
    for i in range(k):
        for j in range(k):
            cell = F.lit(0.0)
            for m in range(k):
                cell = cell + _at("_inv", i * k + m) * _at("_meat", m * k + j)
            half.append(cell)
    joined = joined.withColumn("_half", F.array(*half))
    scale = F.when(F.col("n") > k, F.col("n") / (F.col("n") - k)).otherwise(F.lit(1.0))
    full = []
    for i in range(k):
        for j in range(k):
            cell = F.lit(0.0)
            for m in range(k):
                cell = cell + _at("_half", i * k + m) * _at("_inv", m * k + j)
            full.append(cell * scale)
    joined = joined.withColumn("cov", F.array(*full))
    return joined.select(
        *by,
        "n",
        F.lit(k).alias("k"),
        *[_at("_beta", i).alias(f"coef_{i}") for i in range(k)],
        *[F.when(_at("cov", i * k + i).isNotNull(), F.sqrt(F.greatest(_at("cov", i * k + i), F.lit(0.0)))).alias(f"se_{i}") for i in range(k)],
        "cov",
    )


def normal_diagnostic(df: DataFrame, estimate: str, se: str, p_digits: int | None = 10) -> DataFrame:
    """z, two-sided normal p and 1.96 interval; a non-positive standard error is degenerate."""
    e, s = F.col(estimate), F.col(se)
    live = s > 0
    z = F.when(live, e / s)
    p = F.when(live, two_sided_p(F.coalesce(z, F.lit(0.0)))).otherwise(F.lit(float("nan")))
    if p_digits:
        p = significant(p, p_digits)
    return df.withColumns(
        {
            "z": z,
            "ci_lower": F.when(live, e - F.lit(1.96) * s).otherwise(e),
            "ci_upper": F.when(live, e + F.lit(1.96) * s).otherwise(e),
            "normal_approx_p_value": p,
        }
    )


def pivot_roles(panel: DataFrame, keys: list[str], role: str, roles: list[str], value: str) -> DataFrame:
    """Role rows to role columns (the roles are a short fixed list)."""
    return panel.groupBy(*keys).agg(*[F.max(F.when(F.col(role) == r, F.col(value))).alias(r) for r in roles])


def gap_series(panel: DataFrame, keys: list[str], role: str, treated: str, control: str, value: str) -> DataFrame:
    wide = pivot_roles(panel, keys, role, [treated, control], value)
    both = F.col(treated).isNotNull() & F.col(control).isNotNull()
    return wide.where(both).withColumn("gap", F.col(treated) - F.col(control))


def apply_specs(gaps: DataFrame, specs: DataFrame, week: str = "event_week") -> DataFrame:
    """Repeat a series for every specification whose pre or post window holds the week.

    ``specs`` has ``specification, pre_min, pre_max, post_min, post_max, lag``.
    """
    w = F.col(week)
    inside = w.between(F.col("pre_min"), F.col("pre_max")) | w.between(F.col("post_min"), F.col("post_max"))
    out = gaps.join(small_side(specs), inside)
    post = (w >= F.col("post_min")).cast("double")
    return out.withColumns({"post": post, "week_post": post * w, "week_value": w.cast("double")})


def did_estimates(gaps: DataFrame, by: list[str], specs: DataFrame, maximum_lag: int, row_adjacent: bool = False, gap: str = "gap", week: str = "event_week") -> DataFrame:
    """Difference in changes per series and specification, all fits in one job."""
    data = apply_specs(gaps, specs, week)
    fit = hac_ols(data, [*by, "specification"], gap, ["post"], week, "lag", maximum_lag, row_adjacent)
    out = fit.select(*by, "specification", "n", F.col("coef_1").alias("estimate"), F.col("se_1").alias("nw_standard_error"))
    return normal_diagnostic(out, "estimate", "nw_standard_error")


def change_table(panel: DataFrame, by: list[str], role: str, specs: DataFrame, value: str, week: str = "event_week") -> DataFrame:
    """Pre mean, post mean and change of each role under each specification."""
    data = apply_specs(panel, specs, week)
    out = data.groupBy(*by, role, "specification").agg(
        F.avg(F.when(F.col("post") == 0, F.col(value))).alias("pre_mean"), F.avg(F.when(F.col("post") == 1, F.col(value))).alias("post_mean")
    )
    return out.withColumn("change", F.col("post_mean") - F.col("pre_mean"))


def pretrend(gaps: DataFrame, by: list[str], first: int, last: int, lag: int, row_adjacent: bool = False, gap: str = "gap", week: str = "event_week") -> DataFrame:
    """Slope of the gap over the pre weeks."""
    rows = gaps.where(F.col(week).between(first, last)).withColumn("_w", F.col(week).cast("double"))
    fit = hac_ols(rows, by, gap, ["_w"], week, lag, row_adjacent=row_adjacent)
    out = fit.select(*by, "n", F.col("coef_1").alias("gap_slope_per_event_week"), F.col("se_1").alias("nw_standard_error"))
    return normal_diagnostic(out, "gap_slope_per_event_week", "nw_standard_error")


def controlled_its(gaps: DataFrame, by: list[str], specs: DataFrame, maximum_lag: int, gap: str = "gap", week: str = "event_week") -> DataFrame:
    """Interrupted time series of the gap: intercept, slope, level and slope shift, joint Wald."""
    data = apply_specs(gaps, specs, week)
    fit = hac_ols(data, [*by, "specification"], gap, ["week_value", "post", "week_post"], week, "lag", maximum_lag)
    a, b, d = _at("cov", 10), _at("cov", 11), _at("cov", 15)
    det = F.nullif(a * d - b * b, F.lit(0.0))
    q2, q3 = F.col("coef_2"), F.col("coef_3")
    wald = (d * q2 * q2 - F.lit(2.0) * b * q2 * q3 + a * q3 * q3) / det
    return fit.withColumns({"wald": wald, "wald_p": F.exp(-wald / F.lit(2.0))}).drop("cov", "k")


def placebo(gaps: DataFrame, by: list[str], pseudo_weeks: list[int], half: int, gap: str = "gap", week: str = "event_week", strict: bool = True) -> DataFrame:
    """Mean of the ``half`` weeks after minus the ``half`` weeks before each pseudo date.

    One row per group and pseudo date; only the two sides count, the pseudo week itself may be
    absent. A side with fewer than ``half`` values fails the job, or gives null unless ``strict``.
    """
    dates = F.array(*[F.lit(w) for w in pseudo_weeks])
    groups = gaps.select(*by).distinct() if by else gaps.sparkSession.range(1).select()
    spine = groups.withColumn("pseudo_event_week", F.explode(dates))
    near = F.filter(dates, lambda p: (F.abs(p - F.col(week)) <= half) & (p != F.col(week)))
    rows = gaps.select(*by, week, gap, F.explode(near).alias("pseudo_event_week"))
    before, after = F.col(week) < F.col("pseudo_event_week"), F.col(week) > F.col("pseudo_event_week")
    sides = rows.groupBy(*by, "pseudo_event_week").agg(
        F.avg(F.when(before, F.col(gap))).alias("_b"), F.avg(F.when(after, F.col(gap))).alias("_a"),
        F.count(F.when(before, F.col(gap))).alias("_nb"), F.count(F.when(after, F.col(gap))).alias("_na"),
    )
    rows = attach(spine, sides, [*by, "pseudo_event_week"], "left")
    full = F.coalesce((F.col("_nb") == half) & (F.col("_na") == half), F.lit(False))
    short = F.lit(None).cast("double")
    if strict:
        short = F.raise_error(F.concat(F.lit("incomplete placebo support around week "), F.col("pseudo_event_week").cast("string"))).cast("double")
    change = F.when(full, F.col("_a") - F.col("_b")).otherwise(short)
    return rows.select(*by, "pseudo_event_week", F.lit(half).alias("half_window"), change.alias("gap_change"))


def event_study(gaps: DataFrame, by: list[str], first: int, last: int, gap: str = "gap", week: str = "event_week") -> DataFrame:
    """Gap of every week relative to the mean gap of the clean pre weeks."""
    base = gaps.where(F.col(week).between(first, last)).groupBy(*by).agg(F.avg(gap).alias("pre_mean_gap"))
    return attach(gaps, base, by).withColumn("gap_relative_to_clean_pre_mean", F.col(gap) - F.col("pre_mean_gap"))


def common_panel(panel: DataFrame, calendar: DataFrame, by: list[str], active: str, minimum: int, maximum: int, week: str = "event_week", strict: bool = True, expected: list[tuple] | None = None) -> DataFrame:
    """Chains on one calendar with the log1p participation outcome.

    Each chain must have exactly one row per week of the window; ``strict`` checks it, for the
    chains that ``expected`` names (values of ``by``) or else for those of ``panel`` in any week.
    """
    inside = panel.where(F.col(week).between(minimum, maximum))
    if strict:
        width = maximum - minimum + 1
        counts = inside.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(week).alias("_d"))
        wanted = panel.sparkSession.createDataFrame(expected, inside.select(*by).schema) if expected else panel.select(*by)
        same = [F.col(f"_w{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
        counts = wanted.distinct().toDF(*[f"_w{i}" for i in range(len(by))]).join(counts, same, "left").fillna(0, ["_n", "_d"])
        broken = counts.where((F.col("_n") != width) | (F.col("_d") != width)).limit(1).collect()
        if broken:
            raise ValueError(f"a chain lacks one row per week: {broken[0].asDict()}")
    from tallyweave.operators.calendars import period_label

    joined = inside.join(small_side(calendar), week)
    return joined.withColumns({f"log_{active}": F.log1p(F.col(active)), "period": period_label(F.col(week))})


def ledger_specs(spark) -> DataFrame:
    """The sensitivity grid of the uncertainty ledger, one row per specification.

    Columns: family, specification, kind (did or its), window bounds, lag, order.
    """
    rows = [("Primary DiD-style comparison", "primary", "did", -16, -9, 1, 16, 3), ("Primary controlled ITS", "primary", "its", -16, -9, 1, 16, 2)]
    rows += [("Post-horizon sensitivity", f"post_horizon_{h}", "did", -16, -9, 1, h, 3) for h in (8, 12, 16)]
    for gone in (0, 4, 8):
        name = f"anticipation_exclusion_{gone}_weeks"
        rows.append(("Anticipation-window sensitivity", name, "did", -16, -gone - 1, 1, 16, 3))
        rows.append(("Anticipation-window sensitivity", name, "its", -16, -gone - 1, 1, 16, 2))
    return spark.createDataFrame(
        rows, "family string, specification string, kind string, pre_min int, pre_max int, post_min int, post_max int, lag int"
    )


# Terms of the interrupted time series, in coefficient order
ITS_TERMS = ("cITS intercept", "cITS pre-gap slope/week", "cITS level shift at week 0", "cITS slope shift/week")


def _ledger_rows(df: DataFrame, keys: dict[str, Column], estimate: Column, se: Column, lag: Column, status: Column) -> DataFrame:
    out = df.select(
        *[v.alias(k) for k, v in keys.items()],
        estimate.alias("estimate"),
        se.alias("hac_standard_error"),
        F.lit("z_normal_approximation").alias("test_statistic_type"),
        F.lit(None).cast("int").alias("degrees_of_freedom"),
        F.col("n").alias("n"),
        lag.alias("hac_lag"),
        status.alias("interpretation_status"),
    )
    out = normal_diagnostic(out, "estimate", "hac_standard_error", p_digits=None)
    return out.withColumnsRenamed(
        {"z": "test_statistic", "normal_approx_p_value": "two_sided_p_value", "ci_lower": "ci_low_model_based", "ci_upper": "ci_high_model_based"}
    )


def uncertainty_ledger(chain_panel: DataFrame, gaps: DataFrame, labels: dict[str, str], chain_labels: dict[str, str], contrast: str) -> DataFrame:
    """Uncertainty ledger over families, outcomes and specifications.

    ``chain_panel`` is (chain, event_week, <outcome columns>); ``gaps`` is (outcome_id,
    event_week, gap). ``labels`` and ``chain_labels`` name the outcomes of each. Every DiD
    specification is one group of a single regression job, and so is every ITS one.
    """
    specs = ledger_specs(gaps.sparkSession)
    gaps, chain_panel = cut(gaps), cut(chain_panel)
    label = F.element_at(F.create_map(*[F.lit(x) for p in labels.items() for x in p]), F.col("outcome_id"))

    cases = ", ".join(f"'{name}', cast({c} AS double)" for c, name in chain_labels.items())
    long = chain_panel.where("event_week <> 0 AND event_week BETWEEN -16 AND 16").selectExpr("chain", "event_week", f"stack({len(chain_labels)}, {cases}) AS (label, value)")
    long = long.withColumn("post", (F.col("event_week") >= 1).cast("double"))
    chain_fit = hac_ols(long, ["chain", "label"], "value", ["post"], "event_week", 3)
    parts = [
        _ledger_rows(
            chain_fit,
            {
                # fixed values here and below: family, term and status texts of a published ledger
                "analysis_family": F.lit("Chain-relative pre/post"),
                "outcome": F.concat("chain", F.lit(": "), "label"),
                "term": F.lit("Post-minus-pre weekly mean"),
                "specification": F.lit("primary"),
            },
            F.col("coef_1"), F.col("se_1"), F.lit(3), F.lit("descriptive_chain_relative_not_event_effect"),
        )
    ]

    did_specs = specs.where("kind = 'did'").withColumn("case", F.concat_ws("#", "family", "specification"))
    data = apply_specs(gaps, did_specs)
    did = hac_ols(data, ["outcome_id", "case"], "gap", ["post"], "event_week", "lag", 3)
    family, spec = F.split("case", "#")[0], F.split("case", "#")[1]
    primary = family == "Primary DiD-style comparison"
    horizon = F.concat(F.lit("DiD-style change through week +"), F.regexp_extract(spec, r"(\d+)$", 1))
    excluded = F.concat(F.lit("DiD-style change ("), F.regexp_extract(spec, r"_(\d+)_", 1), F.lit("-week exclusion)"))
    term = F.when(primary, F.lit(contrast)).when(family == "Post-horizon sensitivity", horizon).otherwise(excluded)
    status = F.when(primary, F.lit("comparative_longitudinal_not_identified_effect")).otherwise(F.lit("comparative_longitudinal_sensitivity"))
    keys = {"analysis_family": family, "outcome": label, "term": term, "specification": spec}
    parts.append(_ledger_rows(did, keys, F.col("coef_1"), F.col("se_1"), F.lit(3), status))

    its_specs = specs.where("kind = 'its'").withColumn("case", F.concat_ws("#", "family", "specification"))
    its = controlled_its(gaps, ["outcome_id"], its_specs.drop("specification").withColumnRenamed("case", "specification"), 2)
    its = its.withColumnRenamed("specification", "case")
    primary = family == "Primary controlled ITS"
    terms = ", ".join(f"{i}, coef_{i}, se_{i}" for i in range(4))
    long_its = its.selectExpr("outcome_id", "case", "n", "wald", "wald_p", f"stack(4, {terms}) AS (i, c, s)")
    long_its = long_its.where(primary | (F.col("i") >= 2))
    gone = F.regexp_extract(spec, r"_(\d+)_", 1)
    named = F.element_at(F.array(*[F.lit(t) for t in ITS_TERMS]), F.col("i") + 1)
    shifted = F.concat(F.when(F.col("i") == 2, F.lit("cITS level shift (")).otherwise(F.lit("cITS slope shift (")), gone, F.lit("-week exclusion)"))
    status = F.when(primary, F.lit("comparative_longitudinal_not_identified_effect")).otherwise(F.lit("comparative_longitudinal_sensitivity"))
    keys = {"analysis_family": family, "outcome": label, "term": F.when(primary, named).otherwise(shifted), "specification": spec}
    parts.append(_ledger_rows(long_its, keys, F.col("c"), F.col("s"), F.lit(2), status))

    slope = pretrend(gaps, ["outcome_id"], -16, -9, 2)
    keys = {
        "analysis_family": F.lit("Clean-pre path diagnostic"), "outcome": label, "term": F.lit("Standalone gap slope/week"), "specification": F.lit("primary"),
    }
    parts.append(
        _ledger_rows(
            slope, keys, F.col("gap_slope_per_event_week"), F.col("nw_standard_error"), F.lit(2),
            F.lit("comparison_support_diagnostic_not_parallel_trends_validation"),
        )
    )

    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    joint = its.where(primary).select(
        F.lit("Primary controlled ITS").alias("analysis_family"),
        label.alias("outcome"),
        F.lit("Joint level-and-slope shift").alias("term"),
        F.lit("primary").alias("specification"),
        F.lit("robust_wald_chi_square").alias("test_statistic_type"),
        F.col("wald").alias("test_statistic"),
        F.lit(2).alias("degrees_of_freedom"),
        F.col("wald_p").alias("two_sided_p_value"),
        "n",
        F.lit(2).alias("hac_lag"),
        F.lit("working_model_joint_test_not_identification_test").alias("interpretation_status"),
    )
    return out.unionByName(joint, allowMissingColumns=True)


def ledger_gate(ledger: DataFrame, rows: int = 42) -> DataFrame:
    """One row: the row count and zero p-values, and whether the ledger may be released."""
    out = ledger.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("two_sided_p_value") == 0).alias("zero_p_count"))
    return out.withColumn("gate_passed", (F.col("row_count") == rows) & (F.col("zero_p_count") == 0))
