"""Concentration measures and weekly panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.catalog.registry import ACTIONS, ORDER_ACTIONS, query, r, rounded
from tallyweave.operators import concentration as C
from tallyweave.operators import panels as P
from tallyweave.sources import tables as T

CELLS = """cells AS (SELECT chain_id, event_week, beneficiary_address, count(*) AS c FROM actions GROUP BY ALL)"""
RANKED = """ranked AS (
  SELECT *, c / sum(c) OVER g AS s, row_number() OVER (PARTITION BY chain_id, event_week ORDER BY c DESC, beneficiary_address) AS rk,
         row_number() OVER (PARTITION BY chain_id, event_week ORDER BY c, beneficiary_address) AS asc_rk,
         sum(c) OVER (PARTITION BY chain_id, event_week ORDER BY c DESC, beneficiary_address) / sum(c) OVER g AS cum,
         count(*) OVER g AS n, sum(c) OVER g AS w
  FROM cells WINDOW g AS (PARTITION BY chain_id, event_week))"""


@query(
    "a01_concentration_bundle",
    f"""WITH {ACTIONS}, {CELLS}, {RANKED}
SELECT chain_id, CAST(event_week AS BIGINT) AS event_week, CAST(sum(c) AS BIGINT) AS events, count(*) AS units, {r('sum(s * s)')} AS hhi,
       {r('1 / sum(s * s)')} AS inverse_hhi, {r('greatest(-sum(s * ln(s)), 0)')} AS entropy
FROM ranked GROUP BY ALL""",
)
def concentration_bundle(spark, folder):
    out = C.concentration(T.actions(spark, folder), ["chain_id", "event_week"], "beneficiary_address", top=())
    return rounded(
        out.select("chain_id", "event_week", F.col("observations").cast("bigint").alias("events"), "units", "hhi", "inverse_hhi", "entropy")
    )


@query(
    "a07_weekly_participation",
    f"""WITH {ACTIONS}, {CELLS}, {RANKED},
m AS (SELECT chain_id, event_week, CAST(sum(c) AS BIGINT) AS event_count, count(*) AS active,
        sum(s * s) AS hhi, 2 * sum(asc_rk * c) / (max(n) * max(w)) - (max(n) + 1) / max(n) AS gini,
        sum(s) FILTER (rk <= greatest(1, ceil(n * CAST(0.01 AS DOUBLE)))) AS t1,
        sum(s) FILTER (rk <= greatest(1, ceil(n * CAST(0.10 AS DOUBLE)))) AS t10,
        count(*) FILTER (cum - s < 0.51) AS nak
      FROM ranked GROUP BY ALL),
sp AS (SELECT chain_id, CAST(w AS INTEGER) AS event_week FROM (SELECT DISTINCT chain_id FROM actions), range(-14, 16) t(w)),
flow AS (SELECT a.chain_id, a.event_week, count(*) FILTER (b.beneficiary_address IS NOT NULL) AS retained
      FROM cells a LEFT JOIN cells b ON a.chain_id = b.chain_id AND a.beneficiary_address = b.beneficiary_address
       AND b.event_week = a.event_week - 1 GROUP BY ALL)
SELECT sp.chain_id, CAST(sp.event_week AS BIGINT) AS event_week, coalesce(event_count, 0) AS event_count,
  coalesce(active, 0) AS active_beneficiary_addresses,
  coalesce(active, 0) - coalesce(retained, 0) AS entrant_addresses,
  CAST(coalesce(lag(active) OVER (PARTITION BY sp.chain_id ORDER BY sp.event_week), 0) - coalesce(retained, 0) AS BIGINT) AS exit_addresses,
  coalesce(retained, 0) AS retained_addresses, {r('coalesce(hhi, 0)')} AS beneficiary_hhi, {r('coalesce(gini, 0)')} AS beneficiary_gini,
  {r('coalesce(t1, 0)')} AS top1pct_share, {r('coalesce(t10, 0)')} AS top10pct_share, coalesce(nak, 0) AS nakamoto_51,
  'beneficiary_address' AS observed_unit, 'descriptive_only' AS causal_status
FROM sp LEFT JOIN m USING (chain_id, event_week) LEFT JOIN flow USING (chain_id, event_week)""",
)
def weekly_participation(spark, folder):
    return rounded(P.participation_panel(T.actions(spark, folder), ["chain_id"], T.FIRST_DAY, T.LAST_DAY))


@query(
    "a02_adjusted_and_normalized",
    f"""WITH {ACTIONS}, {CELLS}, {RANKED}
SELECT chain_id, CAST(event_week AS BIGINT) AS event_week,
  {r('CASE WHEN max(n) > 1 THEN (sum(s * s) - CAST(1 AS DOUBLE) / max(n)) / (1 - CAST(1 AS DOUBLE) / max(n)) ELSE 1 END', 10)} AS adjusted_hhi,
  {r('CASE WHEN max(n) > 1 THEN -sum(s * ln(s)) / ln(max(n)) ELSE 0 END', 10)} AS normalized_entropy,
  {r('exp(-sum(s * ln(s)))', 10)} AS effective_entropy
FROM ranked GROUP BY ALL""",
)
def adjusted_and_normalized(spark, folder):
    out = C.concentration(T.actions(spark, folder), ["chain_id", "event_week"], "beneficiary_address", top=())
    return rounded(out.select("chain_id", F.col("event_week"), "adjusted_hhi", "normalized_entropy", "effective_entropy"), 10)


@query(
    "a03_gini",
    f"""WITH {ACTIONS}, u AS (SELECT action, beneficiary_address, count(*) AS c, sum(event_week + 20) AS v FROM actions GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY c, beneficiary_address) AS i FROM u)
SELECT action, {r('2 * sum(i * c) / (count(*) * CAST(sum(c) AS DOUBLE)) - (count(*) + 1) / CAST(count(*) AS DOUBLE)')} AS gini
FROM k GROUP BY ALL""",
)
def gini_counts(spark, folder):
    return rounded(C.gini(T.actions(spark, folder), ["action"], "beneficiary_address"))


@query(
    "a03_gini_real_weights",
    f"""WITH {ORDER_ACTIONS}, u AS (SELECT chain, beneficiary_address, sum(value) AS c FROM order_actions GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY c, beneficiary_address) AS i FROM u)
SELECT chain, {r('2 * sum(i * c) / (count(*) * sum(c)) - (count(*) + 1) / CAST(count(*) AS DOUBLE)')} AS gini
FROM k GROUP BY ALL""",
)
def gini_real(spark, folder):
    return rounded(C.gini(T.order_actions(spark, folder), ["chain"], "beneficiary_address", "value", real=True))


@query(
    "a04_top_k_shares",
    f"""WITH {ORDER_ACTIONS}, u AS (SELECT chain, beneficiary_address, count(*) AS c FROM order_actions GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY c DESC, beneficiary_address) AS i FROM u)
SELECT chain, {r('sum(c) FILTER (i <= 1) / CAST(sum(c) AS DOUBLE)')} AS top1_share,
  {r('sum(c) FILTER (i <= 5) / CAST(sum(c) AS DOUBLE)')} AS top5_share,
  {r('sum(c) FILTER (i <= 10) / CAST(sum(c) AS DOUBLE)')} AS top10_share
FROM k GROUP BY ALL""",
)
def top_k_shares(spark, folder):
    out = C.concentration(T.order_actions(spark, folder), ["chain"], "beneficiary_address", top=(1, 5, 10))
    return rounded(out.select("chain", "top1_share", "top5_share", "top10_share"))


@query(
    "a05_top_fraction_shares",
    f"""WITH {ORDER_ACTIONS}, u AS (SELECT chain, beneficiary_address, count(*) AS c FROM order_actions GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY c DESC, beneficiary_address) AS i, count(*) OVER (PARTITION BY chain) AS n FROM u)
SELECT chain, {r('sum(c) FILTER (i <= greatest(1, ceil(n * CAST(0.01 AS DOUBLE)))) / CAST(sum(c) AS DOUBLE)')} AS top1pct_share,
  {r('sum(c) FILTER (i <= greatest(1, ceil(n * CAST(0.10 AS DOUBLE)))) / CAST(sum(c) AS DOUBLE)')} AS top10pct_share
FROM k GROUP BY ALL""",
)
def top_fraction_shares(spark, folder):
    out = C.concentration(
        T.order_actions(spark, folder), ["chain"], "beneficiary_address", top=(),
        top_fraction={"top1pct_share": 0.01, "top10pct_share": 0.10},
    )
    return rounded(out.select("chain", "top1pct_share", "top10pct_share"))


@query(
    "a06_nakamoto",
    f"""WITH {ORDER_ACTIONS}, u AS (SELECT chain, beneficiary_address, count(*) AS c FROM order_actions GROUP BY ALL),
k AS (SELECT chain, sum(c) OVER (PARTITION BY chain ORDER BY c DESC, beneficiary_address) AS cum, c, sum(c) OVER (PARTITION BY chain) AS w FROM u)
SELECT chain, count(*) FILTER ((cum - c) / CAST(w AS DOUBLE) < CAST(0.51 AS DOUBLE)) AS nakamoto FROM k GROUP BY ALL""",
)
def nakamoto(spark, folder):
    out = C.concentration(T.order_actions(spark, folder), ["chain"], "beneficiary_address", top=(), nakamoto=0.51)
    return out.select("chain", "nakamoto")


INCIDENCE = """inc AS (SELECT DISTINCT chain_id, event_week, action, reserve_address, log_index, unnest([actor_address, beneficiary_address, counterparty_address]) AS address FROM actions),
inc2 AS (SELECT * FROM inc WHERE address IS NOT NULL)"""


def _incidence_sql(keys: str) -> str:
    return f"""ic AS (SELECT {keys}, address, count(*) AS c FROM inc2 GROUP BY ALL),
ih AS (SELECT {keys}, count(*) AS n, CAST(sum(c) AS BIGINT) AS t, sum(CAST(c AS DOUBLE) * c) / (CAST(sum(c) AS DOUBLE) * sum(c)) AS h FROM ic GROUP BY ALL)"""


ADJ = "CASE WHEN n > 1 THEN (h - CAST(1 AS DOUBLE) / n) / (1 - CAST(1 AS DOUBLE) / n) WHEN n = 1 THEN 1 ELSE 0 END"


@query(
    "a08_incidence_concentration",
    f"""WITH {ACTIONS}, {INCIDENCE}, {_incidence_sql('chain_id, event_week')}
SELECT chain_id, CAST(event_week AS BIGINT) AS event_week, n AS active_addresses, t AS address_event_incidences, {r('h')} AS activity_hhi,
 {r(ADJ)} AS adjusted_activity_hhi, {r('1 / h')} AS effective_active_addresses FROM ih""",
)
def incidence_concentration(spark, folder):
    return rounded(P.incidence_concentration(T.actions(spark, folder), ["chain_id", "event_week"]))


@query(
    "a09_week_action_panel",
    f"""WITH {ACTIONS}, {INCIDENCE}, {_incidence_sql('chain_id, event_week, action')},
c AS (SELECT chain_id, event_week, action, count(*) AS e, count(DISTINCT tx_hash) AS x, count(DISTINCT reserve_address) AS rs FROM actions GROUP BY ALL),
sp AS (SELECT chain_id, CAST(w AS INTEGER) AS event_week, action FROM (SELECT DISTINCT chain_id FROM actions), range(-14, 16) t(w), (SELECT DISTINCT action FROM actions))
SELECT chain_id, CAST(event_week AS BIGINT) AS event_week, action, coalesce(e, 0) AS event_count, coalesce(x, 0) AS transaction_count, coalesce(rs, 0) AS reserve_count,
 coalesce(n, 0) AS active_addresses, coalesce(t, 0) AS address_event_incidences, {r('coalesce(h, 0)')} AS activity_hhi,
 {r(f'coalesce({ADJ}, 0)')} AS adjusted_activity_hhi, {r('coalesce(1 / h, 0)')} AS effective_active_addresses
FROM sp LEFT JOIN c USING (chain_id, event_week, action) LEFT JOIN ih USING (chain_id, event_week, action)""",
)
def week_action_panel(spark, folder):
    return rounded(P.action_panel(T.actions(spark, folder), ["chain_id"], T.FIRST_DAY, T.LAST_DAY, T.ACTIONS))


@query(
    "a10_reserve_week_action_panel",
    f"""WITH {ACTIONS}, {INCIDENCE}, {_incidence_sql('chain_id, event_week, action, reserve_address')},
c AS (SELECT chain_id, event_week, action, reserve_address, count(*) AS e, count(DISTINCT tx_hash) AS x, CAST(sum(CAST(amount_raw AS HUGEINT)) AS VARCHAR) AS total FROM actions GROUP BY ALL)
SELECT chain_id, CAST(event_week AS BIGINT) AS event_week, action, reserve_address, e AS event_count, x AS transaction_count, total AS total_amount_raw,
 n AS active_addresses, t AS address_event_incidences, {r('h')} AS activity_hhi, {r(ADJ)} AS adjusted_activity_hhi, {r('1 / h')} AS effective_active_addresses
FROM c JOIN ih USING (chain_id, event_week, action, reserve_address)""",
)
def reserve_week_action_panel(spark, folder):
    return rounded(P.reserve_panel(T.actions(spark, folder), ["chain_id"]))


BENEFICIARY = f"""bm AS (SELECT chain_id, event_week, CAST(sum(c) AS BIGINT) AS event_count, count(*) AS active_beneficiary_addresses,
  sum(s * s) AS h, greatest(-sum(s * ln(s)), 0) AS en, count(*) AS nn, sum(s) FILTER (rk <= 1) AS t1, sum(s) FILTER (rk <= 10) AS t10
  FROM ranked GROUP BY ALL)"""
BENEFICIARY_COLUMNS = f"""{r('coalesce(h, 0)')} AS beneficiary_hhi, {r('coalesce(en, 0)')} AS beneficiary_entropy,
  {r('CASE WHEN nn > 1 THEN en / ln(nn) ELSE 0 END')} AS normalized_beneficiary_entropy, {r('coalesce(exp(en), 0)')} AS effective_beneficiary_addresses,
  {r('coalesce(1 / h, 0)')} AS inverse_hhi_beneficiary_addresses, {r('coalesce(t1, 0)')} AS top1_beneficiary_share, {r('coalesce(t10, 0)')} AS top10_beneficiary_share,
  {r('coalesce(CAST(1 AS DOUBLE) / event_count, 0)')} AS event_split_actor_hhi_lower, {r('coalesce(h, 0)')} AS stable_address_actor_hhi_lower,
  {r('CASE WHEN h IS NULL THEN 0 ELSE 1 END')} AS actor_hhi_upper"""


@query(
    "a11_beneficiary_metrics",
    f"""WITH {ACTIONS}, {CELLS}, {RANKED}, {BENEFICIARY}
SELECT chain_id, CAST(event_week AS BIGINT) AS event_week, event_count, active_beneficiary_addresses, {BENEFICIARY_COLUMNS} FROM bm""",
)
def beneficiary_metrics(spark, folder):
    return rounded(P.beneficiary_metrics(T.actions(spark, folder), ["chain_id", "event_week"]))


@query(
    "a12_weekly_beneficiary_panel",
    f"""WITH {ACTIONS}, {CELLS}, {RANKED}, {BENEFICIARY},
ac AS (SELECT chain_id, event_week, count(DISTINCT action) AS action_count FROM actions GROUP BY ALL),
sp AS (SELECT chain_id, CAST(w AS INTEGER) AS event_week FROM (SELECT DISTINCT chain_id FROM actions), range(-14, 16) t(w))
SELECT chain_id, CAST(event_week AS BIGINT) AS event_week, coalesce(event_count, 0) AS event_count, coalesce(active_beneficiary_addresses, 0) AS active_beneficiary_addresses,
  coalesce(action_count, 0) AS action_count, {BENEFICIARY_COLUMNS}
FROM sp LEFT JOIN bm USING (chain_id, event_week) LEFT JOIN ac USING (chain_id, event_week)""",
)
def weekly_beneficiary_panel(spark, folder):
    return rounded(P.beneficiary_panel(T.actions(spark, folder), ["chain_id"], T.FIRST_DAY, T.LAST_DAY))


@query(
    "a13_uint256_sum",
    f"""WITH {ACTIONS} SELECT chain_id, action, CAST(sum(CAST(amount_raw AS HUGEINT)) AS VARCHAR) AS total FROM actions GROUP BY ALL""",
)
def uint256_sum(spark, folder):
    from tallyweave.functions.uint256 import sum_uint256

    return sum_uint256(T.actions(spark, folder), ["chain_id", "action"], "amount_raw")


@query(
    "a14_calendar_week_family_panel",
    f"""WITH {ORDER_ACTIONS}, u AS (SELECT chain, CAST(date_trunc('week', ts) AS DATE) AS wk, action, beneficiary_address, count(*) AS c FROM order_actions GROUP BY ALL),
m AS (SELECT chain, wk, action, CAST(sum(c) AS BIGINT) AS e, count(*) AS n, sum(CAST(c AS DOUBLE) * c) / (CAST(sum(c) AS DOUBLE) * sum(c)) AS h FROM u GROUP BY ALL)
SELECT chain, CAST(wk AS VARCHAR) AS week_start_utc, action AS event_family, e AS event_count, n AS active_beneficiary_addresses,
  {r('h')} AS beneficiary_event_hhi, {r(ADJ)} AS normalized_beneficiary_event_hhi FROM m""",
)
def calendar_week_family_panel(spark, folder):
    from tallyweave.operators.calendars import week_start_monday

    df = T.order_actions(spark, folder).withColumn("week_start_utc", week_start_monday(F.col("ts")).cast("string"))
    df = df.withColumnRenamed("action", "event_family")
    return rounded(P.calendar_family_panel(df, ["chain", "week_start_utc", "event_family"]))


WEEKLY = """u AS (SELECT chain, event_week, beneficiary_address, count(*) AS c FROM order_actions GROUP BY ALL),
wk AS (SELECT chain, event_week, CAST(sum(c) AS BIGINT) AS event_count, count(*) AS active, sum(CAST(c AS DOUBLE) * c) / (CAST(sum(c) AS DOUBLE) * sum(c)) AS hhi FROM u GROUP BY ALL)"""


def order_panel(spark, folder):
    """Weekly order panel per market segment: events, active customers and HHI."""
    out = C.concentration(T.order_actions(spark, folder), ["chain", "event_week"], "beneficiary_address", top=())
    return out.select(
        "chain", "event_week", F.col("observations").cast("bigint").alias("event_count"), F.col("units").alias("active"), "hhi"
    )


@query(
    "a20_pre_post_means",
    f"""WITH {ORDER_ACTIONS}, {WEEKLY}
SELECT chain, count(*) FILTER (event_week < 0) AS pre_weeks, count(*) FILTER (event_week > 0) AS post_weeks,
 {r('avg(active) FILTER (event_week < 0)')} AS pre_mean_active, {r('avg(active) FILTER (event_week > 0)')} AS post_mean_active,
 {r('avg(hhi) FILTER (event_week < 0)')} AS pre_mean_hhi, {r('avg(hhi) FILTER (event_week > 0)')} AS post_mean_hhi,
 {r('avg(active) FILTER (event_week > 0) / avg(active) FILTER (event_week < 0) - 1')} AS relative_change_active,
 {r('avg(hhi) FILTER (event_week > 0) / avg(hhi) FILTER (event_week < 0) - 1')} AS relative_change_hhi
FROM wk GROUP BY ALL""",
)
def pre_post_means(spark, folder):
    return rounded(P.pre_post(order_panel(spark, folder), ["chain"], ["active", "hhi"]))


# a double becomes the decimal that its shortest text names, rounded at eighteen places, and a sum the double nearest to it; DuckDB's casts scale in binary
@query(
    "a20_pre_post_decimal_text",
    f"""WITH {ORDER_ACTIONS}, {WEEKLY},
p AS (SELECT chain, count(*) FILTER (event_week < 0) AS pre_weeks, count(*) FILTER (event_week > 0) AS post_weeks,
  CAST(CAST(sum(CAST(CAST(hhi AS VARCHAR) AS DECIMAL(38, 18))) FILTER (event_week < 0) AS VARCHAR) AS DOUBLE) / count(*) FILTER (event_week < 0) AS pre,
  CAST(CAST(sum(CAST(CAST(hhi AS VARCHAR) AS DECIMAL(38, 18))) FILTER (event_week > 0) AS VARCHAR) AS DOUBLE) / count(*) FILTER (event_week > 0) AS post FROM wk GROUP BY ALL)
SELECT chain, pre_weeks, post_weeks, format('{{:.15g}}', pre) AS pre_mean_hhi, format('{{:.15g}}', post) AS post_mean_hhi, format('{{:.15g}}', post / pre - 1) AS relative_change FROM p""",
)
def pre_post_decimal_text(spark, folder):
    return P.pre_post_decimal(order_panel(spark, folder), ["chain"], "hhi")


@query(
    "a21_period_means",
    f"""WITH {ORDER_ACTIONS}, {WEEKLY}
SELECT chain, CASE WHEN event_week < 0 THEN 'pre' WHEN event_week = 0 THEN 'week_zero' ELSE 'post' END AS period,
 {r('avg(event_count)')} AS event_count, {r('avg(hhi)')} AS hhi FROM wk GROUP BY ALL""",
)
def period_means(spark, folder):
    return rounded(P.period_means(order_panel(spark, folder), ["chain"], ["event_count", "hhi"]))


@query(
    "a22_index_to_pre_mean",
    f"""WITH {ORDER_ACTIONS}, {WEEKLY}
SELECT chain, CAST(event_week AS BIGINT) AS event_week, {r('100.0 * active / avg(active) FILTER (event_week < 0) OVER (PARTITION BY chain)')} AS active_index FROM wk""",
)
def index_to_pre_mean(spark, folder):
    out = P.index_to_pre_mean(order_panel(spark, folder), ["chain"], "active", "active_index")
    return rounded(out.select("chain", "event_week", "active_index"))


@query(
    "a22_index_to_baseline",
    f"""WITH {ORDER_ACTIONS}, {WEEKLY}
SELECT a.chain, CAST(a.event_week AS BIGINT) AS event_week, {r('a.active / CAST(b.active AS DOUBLE)')} AS activity_index FROM wk a JOIN wk b ON a.event_week = b.event_week AND b.chain = 'BUILDING'""",
)
def index_to_baseline(spark, folder):
    out = P.index_to_baseline(order_panel(spark, folder), "chain", "BUILDING", ["event_week"], "active", "activity_index")
    return rounded(out.select("chain", "event_week", "activity_index"))


@query(
    "a23_weekly_event_range",
    f"""WITH {ACTIONS}, c AS (SELECT chain_id, event_week, action, count(*) AS e FROM actions GROUP BY ALL),
sp AS (SELECT chain_id, w AS event_week, action FROM (SELECT DISTINCT chain_id FROM actions), range(-14, 16) t(w), (SELECT DISTINCT action FROM actions))
SELECT chain_id, action, min(coalesce(e, 0)) AS minimum, max(coalesce(e, 0)) AS maximum, CAST(sum(coalesce(e, 0)) AS BIGINT) AS total
FROM sp LEFT JOIN c USING (chain_id, event_week, action) GROUP BY ALL""",
)
def weekly_event_range(spark, folder):
    df = T.actions(spark, folder)
    panel = P.event_count_panel(df, ["chain_id"], T.FIRST_DAY, T.LAST_DAY, T.ACTIONS)
    return P.action_ranges(panel, ["chain_id", "action"])


@query(
    "a24_hhi_derivative",
    f"""WITH {ORDER_ACTIONS}, u AS (SELECT chain, beneficiary_address, sum(value) AS x, count(*) AS dx FROM order_actions GROUP BY ALL),
g AS (SELECT chain, sum(x) AS xx, sum(x * x) / (sum(x) * sum(x)) AS h FROM u GROUP BY ALL)
SELECT chain, {r('max(h)')} AS hhi, {r('2 / max(xx) * sum((x / xx - h) * dx)', 15)} AS hhi_derivative FROM u JOIN g USING (chain) GROUP BY ALL""",
)
def hhi_derivative(spark, folder):
    units = T.order_actions(spark, folder).groupBy("chain", "beneficiary_address").agg(F.sum("value").alias("x"), F.count("value").alias("dx"))
    out = C.hhi_sensitivity(units, ["chain"], "x", "dx")
    return out.select("chain", (F.round("hhi", 9) + 0.0).alias("hhi"), (F.round("hhi_derivative", 15) + 0.0).alias("hhi_derivative"))


@query(
    "a25_group_removal_loss",
    f"""WITH {ORDER_ACTIONS}, u AS (SELECT action, chain, count(*) AS a FROM order_actions GROUP BY ALL)
SELECT action, count(*) AS group_count, CAST(sum(a) AS BIGINT) AS total_activity, {r('sum(a * a) / (CAST(sum(a) AS DOUBLE) * sum(a))')} AS group_hhi,
  arg_max(chain, (a, chain)) AS largest_group, {r('max(a) / CAST(sum(a) AS DOUBLE)')} AS largest_group_removal_loss FROM u GROUP BY ALL""",
)
def group_removal_loss(spark, folder):
    df = T.order_actions(spark, folder).withColumn("one", F.lit(1))
    return rounded(C.removal_loss(df, ["action"], "chain", "one"))


@query(
    "a26_population_overlap",
    f"""WITH {ACTIONS}, f AS (SELECT event_week, beneficiary_address, max(CAST(chain_id = 0 AS INT)) AS l, max(CAST(chain_id = 1 AS INT)) AS rr FROM actions GROUP BY ALL),
s AS (SELECT event_week, CAST(sum(l) AS BIGINT) AS a, CAST(sum(rr) AS BIGINT) AS b, CAST(sum(l * rr) AS BIGINT) AS ab, count(*) AS un FROM f GROUP BY ALL),
sp AS (SELECT CAST(w AS INTEGER) AS event_week FROM range(-14, 16) t(w))
SELECT CAST(event_week AS BIGINT) AS event_week, coalesce(a, 0) AS left_addresses, coalesce(b, 0) AS right_addresses, coalesce(ab, 0) AS shared_addresses, coalesce(un, 0) AS union_addresses,
 {r('coalesce(ab / CAST(un AS DOUBLE), 0)')} AS jaccard_overlap, {r('CASE WHEN a > 0 THEN ab / CAST(a AS DOUBLE) ELSE 0 END')} AS left_share_also_on_right,
 {r('CASE WHEN b > 0 THEN ab / CAST(b AS DOUBLE) ELSE 0 END')} AS right_share_also_on_left FROM sp LEFT JOIN s USING (event_week)""",
)
def population_overlap(spark, folder):
    return rounded(P.overlap_panel(T.actions(spark, folder), "chain_id", 0, 1, T.FIRST_DAY, T.LAST_DAY))


@query(
    "j15_comparable_panels",
    f"""WITH {ACTIONS}
SELECT CASE chain_id WHEN 0 THEN 'north' ELSE 'south' END AS chain, chain_id, CAST(event_week AS BIGINT) AS event_week, action, reserve_address, count(*) AS event_count,
  CAST(sum(CAST(amount_raw AS HUGEINT)) AS VARCHAR) AS total_amount_raw
FROM actions WHERE reserve_address = CASE chain_id WHEN 0 THEN 3 ELSE 7 END GROUP BY ALL""",
)
def comparable_panels(spark, folder):
    panel = P.reserve_panel(T.actions(spark, folder), ["chain_id"])
    parts = {"north": panel.where("chain_id = 0"), "south": panel.where("chain_id = 1")}
    stacked = P.stack_panels(parts)
    reserves = spark.createDataFrame([(0, 3), (1, 7)], "chain_id bigint, reserve_address bigint")
    out = P.comparable_reserve_rows(stacked, reserves)
    return rounded(out.select("chain", "chain_id", "event_week", "action", "reserve_address", "event_count", "total_amount_raw"))
