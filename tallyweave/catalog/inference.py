"""Panel regressions and event-study statistics on weekly order panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.catalog.panels import WEEKLY, order_panel
from tallyweave.catalog.registry import ORDER_ACTIONS, query, r, rounded
from tallyweave.operators import inference as I
from tallyweave.operators import staggered as S
from tallyweave.sources import tables as T

CONTROL = "BUILDING"

# gap of every other segment against the control segment, participation and concentration
GAPS = f"""{WEEKLY},
long AS (SELECT chain, event_week, 'log_active' AS outcome_id, ln(1 + CAST(active AS DOUBLE)) AS v FROM wk UNION ALL SELECT chain, event_week, 'hhi', hhi FROM wk),
gaps AS (SELECT t.chain, t.outcome_id, t.event_week, t.v - c.v AS gap FROM long t JOIN long c ON t.outcome_id = c.outcome_id AND t.event_week = c.event_week AND c.chain = '{CONTROL}' WHERE t.chain <> '{CONTROL}')"""


def long_panel(spark, folder):
    panel = order_panel(spark, folder)
    cells = F.array(
        F.struct(F.lit("log_active").alias("o"), F.log1p(F.col("active").cast("double")).alias("v")),
        F.struct(F.lit("hhi").alias("o"), F.col("hhi").alias("v")),
    )
    return panel.select("chain", "event_week", F.explode(cells).alias("_c")).select(
        "chain", "event_week", F.col("_c.o").alias("outcome_id"), F.col("_c.v").alias("value")
    )


def all_gaps(spark, folder):
    """Every segment against the control; the control's weeks are a calendar-sized table."""
    panel = long_panel(spark, folder)
    control = panel.where(F.col("chain") == CONTROL).select("outcome_id", "event_week", F.col("value").alias("_c"))
    return panel.where(F.col("chain") != CONTROL).join(control, ["outcome_id", "event_week"]).select(
        "chain", "outcome_id", "event_week", (F.col("value") - F.col("_c")).alias("gap")
    )


def specs(spark, rows):
    return spark.createDataFrame(rows, "specification string, pre_min int, pre_max int, post_min int, post_max int, lag int")


WIDE = [("all_weeks", -400, -1, 1, 400, 3), ("clean_pre_16", -16, -9, 1, 16, 3), ("clean_pre_8", -16, -9, 1, 8, 3), ("clean_pre_12", -16, -9, 1, 12, 3)]
SPEC_SQL = "specs AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {a}, {b}, {c}, {d}, {g})" for s, a, b, c, d, g in WIDE) + ") t(specification, pre_min, pre_max, post_min, post_max, lag))"


def hac2_sql(keys: str, source: str, x: str, y: str, t: str = "event_week") -> str:
    """Two-parameter HAC fit in SQL over ``source`` with columns keys, lag, x, y, t."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""rg AS MATERIALIZED (SELECT {keys}, lag, CAST({t} AS BIGINT) AS t, CAST({x} AS DOUBLE) AS x, {y} AS y FROM {source}),
ft AS MATERIALIZED (SELECT {keys}, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, count(*) * sum(x * x) - sum(x) * sum(x) AS det FROM rg GROUP BY ALL),
cf AS MATERIALIZED (SELECT *, (sxx * sy - sx * sxy) / det AS b0, (n * sxy - sx * sy) / det AS b1 FROM ft),
sc AS MATERIALIZED (SELECT {keys}, lag, t, x, (y - b0 - b1 * x) AS s0, x * (y - b0 - b1 * x) AS s1 FROM rg JOIN cf USING ({keys})),
d0 AS (SELECT {keys}, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM sc GROUP BY ALL),
dl AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, sum(w * 2 * a.s0 * b.s0) AS m00, sum(w * (a.s0 * b.s1 + a.s1 * b.s0)) AS m01, sum(w * 2 * a.s1 * b.s1) AS m11
  FROM (SELECT a.*, unnest(range(1, a.lag + 1)) AS d FROM sc a) a JOIN sc b ON {on} AND b.t = a.t - a.d, LATERAL (SELECT 1 - a.d / CAST(a.lag + 1 AS DOUBLE) AS w) GROUP BY ALL),
mt AS (SELECT {keys}, sum(m00) AS m00, sum(m01) AS m01, sum(m11) AS m11 FROM (SELECT * FROM d0 UNION ALL SELECT * FROM dl) GROUP BY ALL),
hac AS (SELECT {keys}, n, b0, b1,
  sqrt(greatest(n / (n - 2) * (sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / (det * det), 0)) AS se0,
  sqrt(greatest(n / (n - 2) * (sx * sx * m00 - 2 * sx * n * m01 + n * n * m11) / (det * det), 0)) AS se1 FROM cf JOIN mt USING ({keys}))"""


SPECCED = "dd AS (SELECT chain, outcome_id, specification, lag, event_week, CAST(event_week >= post_min AS INT) AS post, gap FROM gaps JOIN specs ON event_week BETWEEN pre_min AND pre_max OR event_week BETWEEN post_min AND post_max)"


@query(
    "i01_two_by_two_did",
    f"""WITH {ORDER_ACTIONS}, u AS (SELECT action, chain, event_week, count(DISTINCT beneficiary_address) AS y FROM order_actions GROUP BY ALL),
m AS (SELECT action, count(*) AS n, avg(y) FILTER (chain = 'MACHINERY' AND event_week >= 0) AS t1, avg(y) FILTER (chain = 'MACHINERY' AND event_week < 0) AS t0,
  avg(y) FILTER (chain <> 'MACHINERY' AND event_week >= 0) AS c1, avg(y) FILTER (chain <> 'MACHINERY' AND event_week < 0) AS c0 FROM u GROUP BY ALL)
SELECT action, n AS n_observations, {r('t0')} AS treated_pre, {r('t1')} AS treated_post, {r('c0')} AS control_pre, {r('c1')} AS control_post, {r('(t1 - t0) - (c1 - c0)')} AS estimate FROM m""",
)
def two_by_two_did(spark, folder):
    y = T.order_actions(spark, folder).groupBy("action", "chain", "event_week").agg(F.count_distinct("beneficiary_address").alias("y"))
    df = y.withColumns({"treated": (F.col("chain") == "MACHINERY").cast("int"), "post": (F.col("event_week") >= 0).cast("int")})
    return rounded(I.two_by_two(df, ["action"], "y"))


@query(
    "i02_i05_hac_difference_in_changes",
    f"""WITH {ORDER_ACTIONS}, {GAPS}, {SPEC_SQL}, {SPECCED}, {hac2_sql('chain, outcome_id, specification', 'dd', 'post', 'gap')}
SELECT chain, outcome_id, specification, CAST(n AS BIGINT) AS n, {r('b1', 8)} AS estimate, {r('se1', 8)} AS nw_standard_error FROM hac""",
)
def hac_difference_in_changes(spark, folder):
    out = I.did_estimates(all_gaps(spark, folder), ["chain", "outcome_id"], specs(spark, WIDE), 3)
    return rounded(out.select("chain", "outcome_id", "specification", "n", "estimate", "nw_standard_error"), 8)


PILOT = [(f"window_{w}", -w, -1, 1, w, 4) for w in (16, 12, 8)]
PILOT_SQL = "specs AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {a}, {b}, {c}, {d}, {g})" for s, a, b, c, d, g in PILOT) + ") t(specification, pre_min, pre_max, post_min, post_max, lag))"


@query(
    "i03_i06_row_adjacent_windows",
    f"""WITH {ORDER_ACTIONS}, {GAPS}, {PILOT_SQL}, {SPECCED}, dr AS (SELECT *, row_number() OVER (PARTITION BY chain, outcome_id, specification ORDER BY event_week) AS rn FROM dd),
{hac2_sql('chain, outcome_id, specification', 'dr', 'post', 'gap', 'rn')}
SELECT chain, outcome_id, specification, CAST(n AS BIGINT) AS n, {r('b1', 8)} AS estimate, {r('se1', 8)} AS nw_standard_error FROM hac""",
)
def row_adjacent_windows(spark, folder):
    out = I.did_estimates(all_gaps(spark, folder), ["chain", "outcome_id"], specs(spark, PILOT), 4, row_adjacent=True)
    return rounded(out.select("chain", "outcome_id", "specification", "n", "estimate", "nw_standard_error"), 8)


@query("i04_normal_diagnostics")
def normal_diagnostics(spark, folder):
    return rounded(I.did_estimates(all_gaps(spark, folder), ["chain", "outcome_id"], specs(spark, WIDE), 3))


@query(
    "i04_normal_intervals",
    f"""WITH {ORDER_ACTIONS}, {GAPS}, {SPEC_SQL}, {SPECCED}, {hac2_sql('chain, outcome_id, specification', 'dd', 'post', 'gap')}
SELECT chain, outcome_id, specification, {r('b1 / se1', 6)} AS z, {r('b1 - 1.96 * se1', 8)} AS ci_lower, {r('b1 + 1.96 * se1', 8)} AS ci_upper FROM hac""",
)
def normal_intervals(spark, folder):
    out = I.did_estimates(all_gaps(spark, folder), ["chain", "outcome_id"], specs(spark, WIDE), 3)
    out = rounded(out.select("chain", "outcome_id", "specification", "z", "ci_lower", "ci_upper"), 8)
    return out.withColumn("z", F.round("z", 6) + F.lit(0.0))


@query(
    "i05_change_table",
    f"""WITH {ORDER_ACTIONS}, {GAPS}, {SPEC_SQL}, dd AS (SELECT chain, outcome_id, specification, event_week >= post_min AS post, v FROM long JOIN specs ON event_week BETWEEN pre_min AND pre_max OR event_week BETWEEN post_min AND post_max)
SELECT outcome_id, chain, specification, {r('avg(v) FILTER (NOT post)')} AS pre_mean, {r('avg(v) FILTER (post)')} AS post_mean, {r('avg(v) FILTER (post) - avg(v) FILTER (NOT post)')} AS change FROM dd GROUP BY ALL""",
)
def change_table(spark, folder):
    return rounded(I.change_table(long_panel(spark, folder), ["outcome_id"], "chain", specs(spark, WIDE), "value"))


@query(
    "i07_pretrend",
    f"""WITH {ORDER_ACTIONS}, {GAPS}, dd AS (SELECT chain, outcome_id, 2 AS lag, event_week, gap FROM gaps WHERE event_week < 0), {hac2_sql('chain, outcome_id', 'dd', 'event_week', 'gap')}
SELECT chain, outcome_id, CAST(n AS BIGINT) AS n, {r('b1', 8)} AS gap_slope_per_event_week, {r('se1', 8)} AS nw_standard_error FROM hac""",
)
def pretrend(spark, folder):
    out = I.pretrend(all_gaps(spark, folder), ["chain", "outcome_id"], -400, -1, 2)
    return rounded(out.select("chain", "outcome_id", "n", "gap_slope_per_event_week", "nw_standard_error"), 8)


@query(
    "i08_controlled_its",
    f"""WITH {ORDER_ACTIONS}, {GAPS}, dd AS (SELECT chain, outcome_id, event_week >= 1 AS post, CAST(event_week AS DOUBLE) AS w, gap FROM gaps WHERE event_week <> 0)
SELECT chain, outcome_id, count(*) AS n, {r('regr_intercept(gap, w) FILTER (NOT post)', 8)} AS coef_0, {r('regr_slope(gap, w) FILTER (NOT post)', 8)} AS coef_1,
 {r('regr_intercept(gap, w) FILTER (post) - regr_intercept(gap, w) FILTER (NOT post)', 8)} AS coef_2, {r('regr_slope(gap, w) FILTER (post) - regr_slope(gap, w) FILTER (NOT post)', 8)} AS coef_3
FROM dd GROUP BY ALL""",
)
def controlled_its(spark, folder):
    out = I.controlled_its(all_gaps(spark, folder), ["chain", "outcome_id"], specs(spark, [("all", -400, -1, 1, 400, 2)]), 2)
    return rounded(out.select("chain", "outcome_id", "n", "coef_0", "coef_1", "coef_2", "coef_3"), 8)


@query("i08_controlled_its_wald")
def controlled_its_wald(spark, folder):
    out = I.controlled_its(all_gaps(spark, folder), ["chain", "outcome_id"], specs(spark, [("all", -400, -1, 1, 400, 2)]), 2)
    return rounded(out.select("chain", "outcome_id", "se_0", "se_1", "se_2", "se_3", "wald", "wald_p"), 8)


def ledger(spark, folder):
    gaps = all_gaps(spark, folder).where(F.col("chain") == "MACHINERY").drop("chain")
    panel = order_panel(spark, folder).where(F.col("chain").isin("MACHINERY", CONTROL))
    return I.uncertainty_ledger(
        panel, gaps, {"log_active": "Log participation", "hhi": "Concentration"}, {"active": "Active customers", "hhi": "Concentration"},
        "Treated-minus-control change",
    )


@query("i09_uncertainty_ledger")
def uncertainty_ledger(spark, folder):
    return rounded(ledger(spark, folder))


@query(
    "i10_significant_digits",
    f"""WITH {ORDER_ACTIONS}, {WEEKLY} SELECT chain, CAST(event_week AS BIGINT) AS event_week, CAST(printf('%.5e', hhi) AS DOUBLE) AS hhi_6 FROM wk""",
)
def significant_digits(spark, folder):
    from tallyweave.functions.columns import significant

    return order_panel(spark, folder).select("chain", F.col("event_week").cast("bigint").alias("event_week"), significant("hhi", 6).alias("hhi_6"))


@query("i13_ledger_recompute", "SELECT 'equal' AS copy, CAST(0 AS BIGINT) AS differing_rows, true AS ledger_matches FROM (SELECT count(*) FROM events) UNION ALL SELECT 'altered', CAST(3 AS BIGINT), false FROM (SELECT count(*) FROM events)")
def ledger_recompute(spark, folder):
    """A recomputed ledger against stored copies: one as it was, one with an estimate changed, a row lost and a row doubled."""
    from tallyweave.operators.contracts import frames_equal
    from tallyweave.session import cut

    stored = cut(ledger(spark, folder))
    fresh = ledger(spark, folder)
    key = ["analysis_family", "outcome", "term", "specification"]
    order = Window.orderBy(*key)  # a ledger has a few dozen rows
    placed = stored.withColumn("_n", F.row_number().over(order))
    numbers = [f.name for f in stored.schema.fields if f.dataType.simpleString() == "double"]
    changed = placed.where("_n <> 2").withColumn(numbers[0], F.when(F.col("_n") == 1, F.coalesce(F.col(numbers[0]), F.lit(0.0)) + 1.0).otherwise(F.col(numbers[0])))
    altered = changed.unionByName(changed.where("_n = 3")).drop("_n")
    out = []
    for name, copy in (("equal", stored), ("altered", altered)):
        count = frames_equal(fresh, copy, key, 1e-10, 1e-12).agg(F.count(F.lit(1)).alias("differing_rows"))
        out.append(count.select(F.lit(name).alias("copy"), "differing_rows", (F.col("differing_rows") == 0).alias("ledger_matches")))
    return out[0].unionByName(out[1])


@query(
    "w03_placebo",
    f"""WITH {ORDER_ACTIONS}, {GAPS}, p AS (SELECT * FROM (VALUES (-12), (-10), (-8), (-6)) t(pw))
SELECT chain, outcome_id, CAST(pw AS BIGINT) AS pseudo_event_week, CAST(4 AS BIGINT) AS half_window, {r('avg(gap) FILTER (event_week > pw) - avg(gap) FILTER (event_week < pw)')} AS gap_change
FROM gaps JOIN p ON event_week BETWEEN pw - 4 AND pw + 4 GROUP BY ALL""",
)
def placebo(spark, folder):
    return rounded(I.placebo(all_gaps(spark, folder), ["chain", "outcome_id"], [-12, -10, -8, -6], 4))


@query(
    "w04_event_study",
    f"""WITH {ORDER_ACTIONS}, {GAPS}
SELECT chain, outcome_id, CAST(event_week AS BIGINT) AS event_week, {r('gap')} AS gap, {r('avg(gap) FILTER (event_week < 0) OVER (PARTITION BY chain, outcome_id)')} AS pre_mean_gap,
 {r('gap - avg(gap) FILTER (event_week < 0) OVER (PARTITION BY chain, outcome_id)')} AS gap_relative_to_clean_pre_mean FROM gaps""",
)
def event_study(spark, folder):
    return rounded(I.event_study(all_gaps(spark, folder), ["chain", "outcome_id"], -400, -1))


@query(
    "w11_outcome_pivot",
    f"""WITH {ORDER_ACTIONS}, {WEEKLY} SELECT CAST(event_week AS BIGINT) AS event_week, {', '.join(f"max(active) FILTER (chain = '{c}') AS {c.lower()}" for c in ('AUTOMOBILE', 'BUILDING', 'MACHINERY'))} FROM wk GROUP BY ALL""",
)
def outcome_pivot(spark, folder):
    out = I.pivot_roles(order_panel(spark, folder), ["event_week"], "chain", ["AUTOMOBILE", "BUILDING", "MACHINERY"], "active")
    return rounded(out.toDF("event_week", "automobile", "building", "machinery"))


# staggered panel: customers by quarter, cohorts from the nation key
PANEL_SQL = """q AS (SELECT o_custkey, CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS BIGINT) AS period_id, count(*) AS n FROM orders GROUP BY ALL),
per AS (SELECT DISTINCT period_id FROM q),
pnl AS (SELECT c_custkey AS unit_id, per.period_id, CAST(CASE c_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 14 ELSE 20 END AS BIGINT) AS first_treat_period, ln(1 + CAST(coalesce(n, 0) AS DOUBLE)) AS outcome
  FROM customer, per LEFT JOIN q ON q.o_custkey = c_custkey AND q.period_id = per.period_id)"""


def staggered_panel(spark, folder):
    orders = T.table(spark, folder, "orders")
    counts = orders.groupBy("o_custkey", ((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate")).cast("bigint").alias("period_id")).agg(F.count(F.lit(1)).alias("n"))
    periods = counts.select("period_id").distinct().agg(F.array_sort(F.collect_set("period_id")).alias("_p"))
    customers = T.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    from tallyweave.operators.sizing import with_scalar

    grid = with_scalar(customers, periods).withColumn("period_id", F.explode("_p")).drop("_p")
    cohort = F.element_at(F.array(F.lit(0), F.lit(8), F.lit(14), F.lit(20)), F.col("c_nationkey") % 4 + 1).cast("bigint")
    joined = grid.join(counts, (grid.c_custkey == counts.o_custkey) & (grid.period_id == counts.period_id), "left")
    return joined.select(
        F.col("c_custkey").alias("unit_id"), grid.period_id, cohort.alias("first_treat_period"), F.log1p(F.coalesce("n", F.lit(0)).cast("double")).alias("outcome")
    )


ATT_SQL = f"""WITH {PANEL_SQL}, cells AS (SELECT g, t, CASE WHEN t >= g THEN g - 1 ELSE t - 1 END AS b FROM (VALUES (8), (14), (20)) x(g), (SELECT period_id AS t FROM per WHERE period_id > (SELECT min(period_id) FROM per))),
d AS (SELECT g, t, a.first_treat_period = g AS treated, a.outcome - b.outcome AS d FROM cells JOIN pnl a ON a.period_id = t JOIN pnl b ON b.unit_id = a.unit_id AND b.period_id = cells.b
  WHERE a.first_treat_period = g OR a.first_treat_period = 0 OR (a.first_treat_period <> g AND a.first_treat_period > greatest(t, cells.b))),
m AS (SELECT g, t, treated, count(*) AS n, avg(d) AS m, var_pop(d) / count(*) AS v FROM d GROUP BY ALL)"""


@query(
    "i11_group_time_att",
    f"""{ATT_SQL} SELECT CAST(a.g AS BIGINT) AS g, a.t, a.n AS treated_units, c.n AS control_units, {r('a.m - c.m', 8)} AS att, {r('sqrt(a.v + c.v)', 8)} AS se
FROM m a JOIN m c ON a.g = c.g AND a.t = c.t AND a.treated AND NOT c.treated""",
)
def group_time_att(spark, folder):
    out = S.group_time_att(staggered_panel(spark, folder), "unit_id", "period_id", "first_treat_period", "outcome")
    return rounded(out.drop("treated_mean", "control_mean"), 8)


@query(
    "i11_dynamic_effects",
    f"""{ATT_SQL}, x AS (SELECT a.t - a.g AS event_time, a.n, a.m - c.m AS att FROM m a JOIN m c ON a.g = c.g AND a.t = c.t AND a.treated AND NOT c.treated),
e AS (SELECT event_time, sum(n * att) / sum(n) AS att, count(*) AS cohort_count, CAST(sum(n) AS BIGINT) AS treated_units FROM x GROUP BY ALL)
SELECT event_time, {r('att', 8)} AS att, cohort_count, treated_units, {r('(SELECT avg(att) FROM e WHERE event_time >= 0)', 8)} AS overall_att FROM e""",
)
def dynamic_effects(spark, folder):
    att = S.group_time_att(staggered_panel(spark, folder), "unit_id", "period_id", "first_treat_period", "outcome")
    return rounded(S.dynamic_effects(att), 8)


@query(
    "i11_multiplier_bootstrap",
    f"""{ATT_SQL}, dd AS (SELECT unit_id, g, t, treated, d FROM (SELECT a.unit_id, g, t, a.first_treat_period = g AS treated, a.outcome - b.outcome AS d FROM cells JOIN pnl a ON a.period_id = t JOIN pnl b ON b.unit_id = a.unit_id AND b.period_id = cells.b
  WHERE a.first_treat_period = g OR a.first_treat_period = 0 OR (a.first_treat_period <> g AND a.first_treat_period > greatest(t, cells.b)))),
inf AS (SELECT unit_id, g, t, (d - m) * CASE WHEN treated THEN 1 ELSE -1 END / n AS w FROM dd JOIN m USING (g, t, treated)),
u AS (SELECT DISTINCT unit_id FROM inf),
dig AS (SELECT unit_id, blk, sha256(unit_id || ':' || blk || ':1') AS h FROM u, range(20) x(blk)),
wt AS (SELECT unit_id, blk * 10 + k AS draw, CASE WHEN CAST('0x' || substr(h, CAST(1 + 6 * k AS INTEGER), 6) AS BIGINT) / CAST(16777216 AS DOUBLE) < (1 + sqrt(5)) / (2 * sqrt(5)) THEN (1 - sqrt(5)) / 2 ELSE (1 + sqrt(5)) / 2 END AS v
  FROM dig, range(10) y(k) WHERE blk * 10 + k < 199),
dr AS (SELECT g, t, draw, sum(w * v) AS value FROM inf JOIN wt USING (unit_id) GROUP BY ALL),
qt AS (SELECT g, t, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / CAST(1.3489795003921634 AS DOUBLE) AS se FROM dr GROUP BY ALL)
SELECT CAST(a.g AS BIGINT) AS g, a.t, a.n AS treated_units, c.n AS control_units, {r('a.m - c.m', 8)} AS att, {r('sqrt(a.v + c.v)', 8)} AS se, {r('qt.se', 8)} AS bootstrap_se
FROM m a JOIN m c ON a.g = c.g AND a.t = c.t AND a.treated AND NOT c.treated JOIN qt ON qt.g = a.g AND qt.t = a.t""",
)
def multiplier_bootstrap(spark, folder):
    return rounded(S.multiplier_bootstrap(staggered_panel(spark, folder), "unit_id", "period_id", "first_treat_period", "outcome")[1], 8)


# normal equations over unit-demeaned regressors, reduced by Gauss-Jordan steps without pivots (the first period is left out)
TWFE_SQL = f"""WITH RECURSIVE {PANEL_SQL},
dt AS (SELECT unit_id, period_id AS p, outcome AS y, CASE WHEN first_treat_period > 0 THEN greatest(least(period_id - first_treat_period, 6), -6) END AS e FROM pnl),
reg AS (SELECT row_number() OVER (ORDER BY kind, pt) AS i, kind, pt FROM (SELECT DISTINCT 0 AS kind, p AS pt FROM dt WHERE p > (SELECT min(p) FROM dt) UNION ALL SELECT DISTINCT 1, e FROM dt WHERE e IS NOT NULL AND e <> -1)),
kk AS (SELECT max(i) AS k FROM reg),
x AS (SELECT unit_id, p, y, i, 1 AS v FROM dt JOIN reg ON (kind = 0 AND pt = p) OR (kind = 1 AND pt = e)),
nu AS (SELECT unit_id, count(*) AS n, sum(y) AS y FROM dt GROUP BY ALL), cu AS (SELECT unit_id, i, count(*) AS c, sum(y) AS s FROM x GROUP BY ALL),
pr AS (SELECT a.i, b.i AS j, count(*) AS v FROM x a JOIN x b USING (unit_id, p) GROUP BY ALL),
ou AS (SELECT a.i, b.i AS j, sum(a.c * b.c / CAST(n AS DOUBLE)) AS v FROM cu a JOIN cu b USING (unit_id) JOIN nu USING (unit_id) GROUP BY ALL),
mt AS (SELECT a.i, b.i AS j, coalesce(pr.v, 0) - coalesce(ou.v, 0) AS v FROM reg a JOIN reg b ON true LEFT JOIN pr ON pr.i = a.i AND pr.j = b.i LEFT JOIN ou ON ou.i = a.i AND ou.j = b.i),
rh AS (SELECT i, sum(s - c * nu.y / n) AS v FROM cu JOIN nu USING (unit_id) GROUP BY ALL),
aug AS (SELECT list(r ORDER BY i) AS m FROM (SELECT mt.i, list_append(list(mt.v ORDER BY j), any_value(rh.v)) || list_transform(range(1, (SELECT k FROM kk) + 1), lambda c: CASE WHEN c = mt.i THEN 1.0 ELSE 0.0 END) AS r FROM mt JOIN rh ON rh.i = mt.i GROUP BY mt.i)),
gj AS (SELECT CAST(1 AS BIGINT) AS s, m FROM aug UNION ALL
  SELECT s + 1, list_transform(m, lambda row, i: CASE WHEN i = s THEN list_transform(row, lambda z: z / m[s][s]) ELSE list_transform(row, lambda z, j: z - row[s] * m[s][j] / m[s][s]) END) FROM gj, kk WHERE s <= k),
sol AS (SELECT m, k FROM gj, kk WHERE s = k + 1),
co AS (SELECT i, kind, pt, m[i][k + 1] AS b, m[i] AS row FROM reg, sol),
fit AS (SELECT dt.unit_id, dt.p, dt.e, y - coalesce(cp.b, 0) - coalesce(ce.b, 0) AS u FROM dt LEFT JOIN co cp ON cp.kind = 0 AND cp.pt = p LEFT JOIN co ce ON ce.kind = 1 AND ce.pt = e),
res AS (SELECT *, u - avg(u) OVER (PARTITION BY unit_id) AS r FROM fit),
sc AS (SELECT unit_id, i, sum(r) AS g FROM res JOIN reg ON (kind = 0 AND pt = p) OR (kind = 1 AND pt = e) GROUP BY ALL),
hh AS (SELECT co.i, unit_id, sum(g * co.row[CAST((SELECT k FROM kk) + 1 + sc.i AS INTEGER)]) AS h FROM sc, co WHERE co.kind = 1 GROUP BY ALL),
va AS (SELECT i, sum(h * h) AS v FROM hh GROUP BY ALL),
nn AS (SELECT (SELECT count(*) FROM dt) AS n, (SELECT count(*) FROM nu) AS c, (SELECT k FROM kk) + 1 AS params)
SELECT CAST(pt AS BIGINT) AS event_time, {r('b', 8)} AS estimate, {r('sqrt(v * c / (c - 1) * (n - 1) / (n - params))', 8)} AS cluster_se, n, c AS clusters FROM co JOIN va USING (i), nn WHERE kind = 1"""


@query("i12_twfe_event_study", TWFE_SQL)
def twfe_event_study(spark, folder):
    panel = staggered_panel(spark, folder)
    ever = F.col("first_treat_period") > 0
    e = F.greatest(F.least(F.col("period_id") - F.col("first_treat_period"), F.lit(6)), F.lit(-6))
    df = panel.withColumns({"treated": ever.cast("int"), "event_time": F.when(ever, e)})
    return rounded(S.twfe_event_study(df, "unit_id", "period_id", "event_time", "treated", "outcome"), 8)
