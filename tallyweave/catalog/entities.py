"""Entity registry, measurement, identified sets, donor support and acquisition plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.catalog.gates import periods
from tallyweave.catalog.registry import ACTIONS, query, r, rounded
from tallyweave.operators import bounds as B
from tallyweave.operators import calendars as K
from tallyweave.operators import design as D
from tallyweave.operators import entities as E
from tallyweave.sources import tables as T

UNIVERSE_ROLES = """roles AS (SELECT chain_id, action, block_number, tx_hash, log_index, event_week, 'actor' AS role, actor_address AS address FROM actions UNION ALL
  SELECT chain_id, action, block_number, tx_hash, log_index, event_week, 'beneficiary', beneficiary_address FROM actions UNION ALL
  SELECT chain_id, action, block_number, tx_hash, log_index, event_week, 'counterparty', counterparty_address FROM actions WHERE counterparty_address IS NOT NULL)"""


@query(
    "a15_address_universe",
    f"""WITH {ACTIONS}, {UNIVERSE_ROLES}
SELECT chain_id, address, array_to_string(list_sort(list(DISTINCT role)), '|') AS observed_roles, array_to_string(list_sort(list(DISTINCT action)), '|') AS observed_actions, min(block_number) AS first_observed_block, max(block_number) AS last_observed_block,
 CAST(min(event_week) AS BIGINT) AS first_event_week, CAST(max(event_week) AS BIGINT) AS last_event_week, count(*) AS role_incidence_count, count(DISTINCT tx_hash) AS transaction_count, count(DISTINCT log_index) AS event_incidence_count FROM roles GROUP BY ALL""",
)
def address_universe(spark, folder):
    return rounded(E.address_universe(T.actions(spark, folder))[0])


@query(
    "a15_event_incidences",
    f"""WITH {ACTIONS}, {UNIVERSE_ROLES}, i AS (SELECT log_index, address, array_to_string(list_sort(list(DISTINCT role)), '|') AS roles_in_event FROM roles GROUP BY ALL) SELECT roles_in_event, count(*) AS incidences FROM i GROUP BY ALL""",
)
def event_incidences(spark, folder):
    return E.address_universe(T.actions(spark, folder))[1].groupBy("roles_in_event").agg(F.count(F.lit(1)).alias("incidences"))


def code_records(addresses):
    """Runtime code at the first and last blocks by address class (address modulo seven)."""
    n = F.col("address") % 7
    body = F.concat(F.lit("0x60"), F.lpad(F.lower(F.hex(F.col("address") % 4)), 4, "0"))
    return addresses.select(
        "address",
        F.when(n.isin(0, 1, 4), F.lit("0x")).otherwise(body).alias("first_runtime_code"),
        F.when(n.isin(0, 1, 5), F.lit("0x")).when(n == 6, F.lit("0x6001ff")).otherwise(body).alias("last_runtime_code"),
    )


CODES = """codes AS (SELECT address, CASE WHEN address % 7 IN (0, 1, 4) THEN '0x' ELSE '0x60' || lpad(lower(to_hex(address % 4)), 4, '0') END AS f,
  CASE WHEN address % 7 IN (0, 1, 5) THEN '0x' WHEN address % 7 = 6 THEN '0x6001ff' ELSE '0x60' || lpad(lower(to_hex(address % 4)), 4, '0') END AS l FROM addr),
cls AS (SELECT address, f <> '0x' AS fp, l <> '0x' AS lp, CASE WHEN f <> '0x' THEN sha256(unhex(f[3:])) ELSE '' END AS fh, CASE WHEN l <> '0x' THEN sha256(unhex(l[3:])) ELSE '' END AS lh FROM codes),
facts AS (SELECT address, fp, lp, fh, lh, CASE WHEN NOT fp AND NOT lp THEN 'no_runtime_code_observed' WHEN fp AND lp AND fh = lh THEN 'stable_runtime_code' WHEN NOT fp AND lp THEN 'runtime_code_appeared' WHEN fp AND NOT lp THEN 'runtime_code_disappeared' ELSE 'runtime_code_changed' END AS presence,
  CASE WHEN NOT fp AND NOT lp THEN 'code_absent_at_observed_bounds' WHEN fp AND lp AND fh = lh THEN 'smart_contract' ELSE 'smart_contract_dynamic' END AS kind,
  CASE WHEN NOT fp AND NOT lp THEN '' WHEN fp AND lp AND fh = lh THEN 'runtime_sha256:' || fh ELSE 'dynamic_address:' || CAST(address AS VARCHAR) END AS family, fp OR lp AS contract FROM cls)"""


@query(
    "e01_code_classes",
    f"""WITH addr AS (SELECT c_custkey AS address FROM customer), {CODES}
SELECT address, kind AS address_type, presence AS code_presence_class, fp AS first_runtime_code_present, CAST(CASE WHEN fp THEN 3 ELSE 0 END AS BIGINT) AS first_runtime_code_bytes, fh AS first_runtime_code_sha256,
 lp AS last_runtime_code_present, CAST(CASE WHEN lp THEN 3 ELSE 0 END AS BIGINT) AS last_runtime_code_bytes, lh AS last_runtime_code_sha256, contract AS contract_observed, family AS infrastructure_family_id FROM facts""",
)
def code_classes(spark, folder):
    return rounded(E.classify_code(code_records(T.table(spark, folder, "customer").select(F.col("c_custkey").alias("address")))))


def registry(spark, folder):
    """Registry of the event addresses; labels for contracts come from the address itself."""
    universe = E.address_universe(T.actions(spark, folder).withColumn("chain_id", F.lit(1)))[0]
    return E.versioned_registry(universe, E.classify_code(code_records(universe.select("address"))), address_labels(universe), "v1")


def address_labels(universe):
    label = F.col("address")
    return universe.where((label % 7).isin(2, 3, 4, 5) & (label % 2 == 0)).select(
        "address",
        F.concat(F.lit("ent"), (label % 11).cast("string")).alias("entity_id"),
        F.when(label % 3 == 0, F.lit("economic_actor")).otherwise(F.lit("protocol_infrastructure")).alias("entity_scope"),
        F.when(label % 5 == 0, F.lit(0.5)).otherwise(F.lit(0.95)).alias("confidence"),
        F.lit(1).cast("bigint").alias("valid_from_block"),
        F.lit(9).cast("bigint").alias("valid_to_block"),
    )


REGISTRY = f"""inc AS (SELECT DISTINCT event_week, action, log_index, unnest([actor_address, beneficiary_address, counterparty_address]) AS address FROM actions),
inc2 AS (SELECT * FROM inc WHERE address IS NOT NULL), addr AS (SELECT address, count(*) AS ev FROM inc2 GROUP BY ALL), {CODES},
reg AS (SELECT address, ev, kind, presence, family, contract, CASE WHEN address % 7 IN (2, 3, 4, 5) AND address % 2 = 0 THEN 'ent' || CAST(address % 11 AS VARCHAR) ELSE '' END AS entity_id,
  CASE WHEN address % 7 IN (2, 3, 4, 5) AND address % 2 = 0 THEN CASE WHEN address % 3 = 0 THEN 'economic_actor' ELSE 'protocol_infrastructure' END ELSE '' END AS scope,
  address % 7 IN (2, 3, 4, 5) AND address % 2 = 0 AND address % 5 <> 0 AS hi FROM facts JOIN addr USING (address)),
rg AS (SELECT *, hi AND scope = 'economic_actor' AS econ, CASE WHEN hi THEN entity_id ELSE 'address:' || CAST(address AS VARCHAR) END AS ckey FROM reg)"""


@query(
    "j02_j03_versioned_registry",
    f"""WITH {ACTIONS}, {REGISTRY} SELECT address, ev AS event_incidence_count, kind AS address_type, presence AS code_presence_class, contract AS contract_observed, family AS infrastructure_family_id, entity_id, scope AS entity_scope,
 hi AS high_confidence_entity_label, econ AS economic_actor_resolved, ckey AS curated_entity_key, CASE WHEN hi THEN 'high_confidence_curated_label' ELSE 'unresolved_address_fallback' END AS entity_resolution FROM rg""",
)
def versioned_registry(spark, folder):
    return registry(spark, folder).select(
        "address", "event_incidence_count", "address_type", "code_presence_class", "contract_observed", "infrastructure_family_id", "entity_id", "entity_scope",
        "high_confidence_entity_label", "economic_actor_resolved", "curated_entity_key", "entity_resolution",
    )


def _measure_sql(keys: str) -> str:
    return f"""u AS (SELECT {keys}, address, CAST(count(*) AS DOUBLE) AS c FROM inc2 GROUP BY ALL), ur AS (SELECT * FROM u JOIN rg USING (address)),
b AS (SELECT {keys}, CAST(sum(c) AS BIGINT) AS event_incidence_count, count(*) AS active_addresses, sum(c * c) / (sum(c) * sum(c)) AS ah, coalesce(sum(c) FILTER (contract), 0) / sum(c) AS cs,
  coalesce(sum(c) FILTER (scope = 'protocol_infrastructure'), 0) / sum(c) AS ps, coalesce(sum(c) FILTER (hi), 0) / sum(c) AS hs, coalesce(sum(c) FILTER (econ), 0) / sum(c) AS es FROM ur GROUP BY ALL),
cu AS (SELECT {keys}, sum(c * c) / (sum(c) * sum(c)) AS ch FROM (SELECT {keys}, ckey, sum(c) AS c FROM ur GROUP BY ALL) GROUP BY ALL),
ex AS (SELECT {keys}, sum(c * c) / (sum(c) * sum(c)) AS xh FROM (SELECT {keys}, CASE WHEN hi THEN ckey ELSE 'unresolved' END AS k, sum(c) AS c FROM ur GROUP BY ALL) GROUP BY ALL),
tp AS (SELECT {keys}, sum(c * c) / (sum(c) * sum(c)) AS th, max(c) / sum(c) AS tt FROM (SELECT {keys}, family, sum(c) AS c FROM ur WHERE contract GROUP BY ALL) GROUP BY ALL)"""


MEASURES = f"""coalesce(event_incidence_count, 0) AS event_incidence_count, coalesce(active_addresses, 0) AS active_addresses, {r('coalesce(ah, 0)')} AS address_activity_hhi, {r('coalesce(1 / ah, 0)')} AS effective_active_addresses,
 {r('coalesce(ch, 0)')} AS curated_entity_activity_hhi_sensitivity, {r('coalesce(1 / ch, 0)')} AS effective_curated_entities_sensitivity, {r('coalesce(xh, 0)')} AS unresolved_all_one_hhi_extreme, {r('coalesce(1 / xh, 0)')} AS effective_entities_unresolved_all_one_extreme,
 {r('coalesce(cs, 0)')} AS contract_incidence_share, {r('coalesce(ps, 0)')} AS protocol_infrastructure_incidence_share, {r('coalesce(hs, 0)')} AS high_confidence_entity_incidence_coverage, {r('coalesce(es, 0)')} AS economic_actor_incidence_coverage,
 {r('coalesce(th, 0)')} AS contract_template_hhi_conditional, {r('coalesce(tt, 0)')} AS top_contract_template_share_conditional"""


@query(
    "a16_week_action_measurement",
    f"""WITH {ACTIONS}, {REGISTRY}, {_measure_sql('event_week, action')}, sp AS (SELECT CAST(w AS INTEGER) AS event_week, action FROM range(-14, 16) t(w), (SELECT DISTINCT action FROM actions))
SELECT CAST(event_week AS BIGINT) AS event_week, action, {MEASURES} FROM sp LEFT JOIN b USING (event_week, action) LEFT JOIN cu USING (event_week, action) LEFT JOIN ex USING (event_week, action) LEFT JOIN tp USING (event_week, action)""",
)
def week_action_measurement(spark, folder):
    incidences = E.address_universe(T.actions(spark, folder))[1]
    return rounded(E.measurement_panels(incidences, registry(spark, folder), T.FIRST_DAY, T.LAST_DAY, T.ACTIONS)[0])


@query(
    "a16_week_measurement",
    f"""WITH {ACTIONS}, {REGISTRY}, {_measure_sql('event_week')}, sp AS (SELECT CAST(w AS INTEGER) AS event_week FROM range(-14, 16) t(w))
SELECT CAST(event_week AS BIGINT) AS event_week, {MEASURES} FROM sp LEFT JOIN b USING (event_week) LEFT JOIN cu USING (event_week) LEFT JOIN ex USING (event_week) LEFT JOIN tp USING (event_week)""",
)
def week_measurement(spark, folder):
    incidences = E.address_universe(T.actions(spark, folder))[1]
    return rounded(E.measurement_panels(incidences, registry(spark, folder), T.FIRST_DAY, T.LAST_DAY, T.ACTIONS)[1])


@query(
    "a17_address_type_summary",
    f"""WITH {ACTIONS}, {REGISTRY} SELECT kind AS address_type, presence AS code_presence_class, count(*) AS address_count, CAST(sum(ev) AS BIGINT) AS event_incidence_count, {r('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS address_share,
 {r('sum(ev) / CAST(sum(sum(ev)) OVER () AS DOUBLE)')} AS event_incidence_share FROM rg GROUP BY kind, presence""",
)
def address_type_summary(spark, folder):
    return rounded(E.address_type_summary(registry(spark, folder)))


@query(
    "a18_infrastructure_summary",
    f"""WITH {ACTIONS}, {REGISTRY}, t AS (SELECT sum(ev) FILTER (contract) AS c, sum(ev) AS e FROM rg) SELECT family AS infrastructure_family_id, count(*) AS address_count, CAST(sum(ev) AS BIGINT) AS event_incidence_count,
 coalesce(array_to_string(list_sort(list(DISTINCT entity_id) FILTER (entity_id <> '')), '|'), '') AS curated_entity_ids, {r('sum(ev) / CAST(max(c) AS DOUBLE)')} AS share_of_contract_incidences, {r('sum(ev) / CAST(max(e) AS DOUBLE)')} AS share_of_all_incidences FROM rg, t WHERE contract GROUP BY family""",
)
def infrastructure_summary(spark, folder):
    return rounded(E.infrastructure_summary(registry(spark, folder)))


def links(spark, folder):
    """Must-link constraints between neighbouring customers, valid over part of the blocks."""
    n = F.col("c_custkey")
    last = T.table(spark, folder, "events").agg(F.max("event_id")).first()[0]
    return T.table(spark, folder, "customer").where(n % 3 != 0).select(
        n.alias("constraint_id"),
        n.alias("left_address"),
        (n + 1).alias("right_address"),
        F.when(n % 2 == 0, F.lit(0)).otherwise(F.lit(last // 3)).cast("bigint").alias("valid_from_block"),
        F.lit(last).cast("bigint").alias("valid_to_block"),
    )


LINKS = "mx AS (SELECT max(event_id) AS mx FROM events), lk AS (SELECT c_custkey AS l, c_custkey + 1 AS rr, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE mx // 3 END AS vf, mx AS vt FROM customer, mx WHERE c_custkey % 3 <> 0)"


def bound_sql(keys: str, source: str) -> str:
    """Bounds per group; chains of links have at most three addresses, so two steps merge them."""
    return f"""gu AS MATERIALIZED (SELECT {keys}, beneficiary_address AS u, CAST(count(*) AS DOUBLE) AS c, min(block_number) AS lo, max(block_number) AS hi FROM {source} GROUP BY ALL),
gs AS (SELECT {keys}, min(lo) AS lo, max(hi) AS hi, CAST(sum(c) AS BIGINT) AS n, count(*) AS k FROM gu GROUP BY ALL),
al AS (SELECT {', '.join('gs.' + k.strip() for k in keys.split(','))}, l, rr FROM gs JOIN lk ON vf <= gs.lo AND vt >= gs.hi), ac AS (SELECT {keys}, count(*) AS links FROM al GROUP BY ALL),
pl AS (SELECT al.* FROM al SEMI JOIN gu a ON {' AND '.join(f'a.{k.strip()} = al.{k.strip()}' for k in keys.split(','))} AND a.u = al.l SEMI JOIN gu b ON {' AND '.join(f'b.{k.strip()} = al.{k.strip()}' for k in keys.split(','))} AND b.u = al.rr),
s1 AS (SELECT gu.*, coalesce(pl.l, gu.u) AS p1 FROM gu LEFT JOIN pl ON {' AND '.join(f'gu.{k.strip()} = pl.{k.strip()}' for k in keys.split(','))} AND gu.u = pl.rr),
s2 AS (SELECT s1.*, coalesce(pl.l, s1.p1) AS p2 FROM s1 LEFT JOIN pl ON {' AND '.join(f's1.{k.strip()} = pl.{k.strip()}' for k in keys.split(','))} AND s1.p1 = pl.rr),
cu AS (SELECT {keys}, p2 AS u, sum(c) AS c FROM s2 GROUP BY ALL),
m1 AS (SELECT {keys}, sum(s * s) AS h, -sum(s * ln(s)) AS e, max(s) AS t1, sum(s) FILTER (rk <= 5) AS t5 FROM (SELECT {keys}, c / sum(c) OVER (PARTITION BY {keys}) AS s, row_number() OVER (PARTITION BY {keys} ORDER BY c DESC, u) AS rk FROM gu) GROUP BY ALL),
m2 AS (SELECT {keys}, sum(s * s) AS h, -sum(s * ln(s)) AS e, max(s) AS t1, sum(s) FILTER (rk <= 5) AS t5 FROM (SELECT {keys}, c / sum(c) OVER (PARTITION BY {keys}) AS s, row_number() OVER (PARTITION BY {keys} ORDER BY c DESC, u) AS rk FROM cu) GROUP BY ALL)"""


BOUND_COLUMNS = f"""n AS event_count, k AS beneficiary_address_count, gs.lo AS minimum_block, gs.hi AS maximum_block, coalesce(links, 0) AS accepted_must_link_constraint_count, {r('m1.h')} AS address_proxy_hhi, {r('m1.e')} AS address_proxy_entropy, {r('m1.t5')} AS address_proxy_top5_share,
 {r('CAST(1 AS DOUBLE) / n')} AS event_split_hhi_lower, {r('ln(n)')} AS event_split_entropy_upper, {r('least(5, n) / CAST(n AS DOUBLE)')} AS event_split_top5_lower, {r('m1.h')} AS stable_address_hhi_lower, {r('1 / m1.h')} AS stable_address_effective_upper,
 {r('m2.h')} AS evidence_hhi_lower, {r('1 / m2.h')} AS evidence_effective_upper, {r('m2.e')} AS evidence_entropy_upper, {r('m2.t1')} AS evidence_top1_lower, {r('m2.t5')} AS evidence_top5_lower"""
BOUND_NAMES = [
    "event_count", "beneficiary_address_count", "minimum_block", "maximum_block", "accepted_must_link_constraint_count", "address_proxy_hhi", "address_proxy_entropy", "address_proxy_top5_share",
    "event_split_hhi_lower", "event_split_entropy_upper", "event_split_top5_lower", "stable_address_hhi_lower", "stable_address_effective_upper", "evidence_hhi_lower", "evidence_effective_upper",
    "evidence_entropy_upper", "evidence_top1_lower", "evidence_top5_lower",
]


@query(
    "e02_e03_weekly_bounds",
    f"""WITH {ACTIONS}, {LINKS}, {bound_sql('event_week, action', 'actions')}
SELECT CAST(event_week AS BIGINT) AS event_week, action, {BOUND_COLUMNS} FROM gs JOIN m1 USING (event_week, action) JOIN m2 USING (event_week, action) LEFT JOIN ac USING (event_week, action)""",
)
def weekly_bounds(spark, folder):
    out = B.identified_set(T.actions(spark, folder), links(spark, folder), ["event_week", "action"])
    return rounded(out.select("event_week", "action", *BOUND_NAMES))


PERIOD_ACTIONS = "pa AS (SELECT period, actions.* FROM actions JOIN (VALUES ('pre', -14, -1), ('post', 1, 15), ('full', -14, 15)) p(period, a, b) ON event_week BETWEEN a AND b)"


@query(
    "e04_period_bounds",
    f"""WITH {ACTIONS}, {LINKS}, {PERIOD_ACTIONS}, {bound_sql('period', 'pa')} SELECT period, {BOUND_COLUMNS} FROM gs JOIN m1 USING (period) JOIN m2 USING (period) LEFT JOIN ac USING (period)""",
)
def period_bounds(spark, folder):
    out = B.identified_set(K.assign_periods(T.actions(spark, folder), periods(spark)), links(spark, folder), ["period"])
    return rounded(out.select("period", *BOUND_NAMES))


def flagged_panels(spark, folder):
    """Bounds per week and action, week, and period, with the share of events of chain 1, all from one run."""
    panel = T.actions(spark, folder).withColumn("chain_one", F.col("chain_id") == 1)
    return B.bound_panels(panel, links(spark, folder), periods(spark), T.FIRST_DAY, T.LAST_DAY, T.ACTIONS, {"chain_one_share": "chain_one"})


def flag_sql(keys: str, source: str) -> str:
    return f"fl AS (SELECT {keys}, {r('avg(CAST(chain_id = 1 AS INTEGER))', 8)} AS chain_one_share FROM {source} GROUP BY ALL)"


FINE_COLUMNS = BOUND_COLUMNS.replace(", 9) + 0.0", ", 8) + 0.0")  # some shares of 320 events are ties at nine to eleven digits
_DENSE = ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*BOUND_NAMES, "chain_one_share"])


@query(
    "e04_dense_week_action_bounds",
    f"""WITH {ACTIONS}, {LINKS}, {bound_sql('event_week, action', 'actions')}, {flag_sql('event_week, action', 'actions')},
o AS (SELECT event_week, action, {FINE_COLUMNS}, chain_one_share FROM gs JOIN m1 USING (event_week, action) JOIN m2 USING (event_week, action) JOIN fl USING (event_week, action) LEFT JOIN ac USING (event_week, action)),
sp AS (SELECT CAST(w AS INTEGER) AS event_week, action FROM range({T.FIRST_DAY}, {T.LAST_DAY} + 1) x(w), (SELECT DISTINCT action FROM actions))
SELECT CAST(event_week AS BIGINT) AS event_week, action, o.event_count IS NOT NULL AS cell_observed, {_DENSE} FROM sp LEFT JOIN o USING (event_week, action)""",
)
def dense_week_action_bounds(spark, folder):
    return rounded(flagged_panels(spark, folder)[0].select("event_week", "action", "cell_observed", *BOUND_NAMES, "chain_one_share"), 8)


@query(
    "e04_week_bounds",
    f"""WITH {ACTIONS}, {LINKS}, {bound_sql('event_week', 'actions')}, {flag_sql('event_week', 'actions')}
SELECT CAST(event_week AS BIGINT) AS event_week, {FINE_COLUMNS}, chain_one_share FROM gs JOIN m1 USING (event_week) JOIN m2 USING (event_week) JOIN fl USING (event_week) LEFT JOIN ac USING (event_week)""",
)
def week_bounds(spark, folder):
    return rounded(flagged_panels(spark, folder)[1].select("event_week", *BOUND_NAMES, "chain_one_share"), 8)


@query(
    "e04_flagged_period_bounds",
    f"""WITH {ACTIONS}, {LINKS}, {PERIOD_ACTIONS}, {bound_sql('period', 'pa')}, {flag_sql('period', 'pa')} SELECT period, {FINE_COLUMNS}, chain_one_share FROM gs JOIN m1 USING (period) JOIN m2 USING (period) JOIN fl USING (period) LEFT JOIN ac USING (period)""",
)
def flagged_period_bounds(spark, folder):
    return rounded(flagged_panels(spark, folder)[2].select("period", *BOUND_NAMES, "chain_one_share"), 8)


@query(
    "j08_constraint_containment",
    f"""WITH {ACTIONS}, {LINKS}, gs AS (SELECT event_week, min(block_number) AS lo, max(block_number) AS hi FROM actions GROUP BY ALL)
SELECT CAST(event_week AS BIGINT) AS event_week, count(*) AS links FROM gs JOIN lk ON vf <= lo AND vt >= hi GROUP BY ALL""",
)
def constraint_containment(spark, folder):
    spans = T.actions(spark, folder).groupBy("event_week").agg(F.min("block_number").alias("minimum_block"), F.max("block_number").alias("maximum_block"))
    out = B.active_constraints(spans, links(spark, folder))
    return rounded(out.groupBy("event_week").agg(F.count(F.lit(1)).alias("links")))


@query(
    "e05_change_bounds",
    f"""WITH {ACTIONS}, {LINKS}, {PERIOD_ACTIONS}, {bound_sql('period', 'pa')}, x AS (SELECT 'address_proxy_point' AS assumption, period, h AS lo, h AS hi FROM m1 UNION ALL SELECT 'event_split', period, CAST(1 AS DOUBLE) / n, 1 FROM gs UNION ALL SELECT 'stable_address', period, h, 1 FROM m1 UNION ALL SELECT 'evidence', period, h, 1 FROM m2),
y AS (SELECT assumption, max(lo) FILTER (period = 'pre') AS pl, max(hi) FILTER (period = 'pre') AS ph, max(lo) FILTER (period = 'post') AS ql, max(hi) FILTER (period = 'post') AS qh FROM x GROUP BY ALL),
z AS (SELECT *, CASE WHEN assumption = 'address_proxy_point' THEN ql - pl ELSE ql - ph END AS cl, CASE WHEN assumption = 'address_proxy_point' THEN ql - pl ELSE qh - pl END AS cu FROM y)
SELECT 'post_minus_pre' AS comparison, 'hhi' AS metric, assumption, {r('pl')} AS pre_lower, {r('ph')} AS pre_upper, {r('ql')} AS post_lower, {r('qh')} AS post_upper, {r('cl')} AS change_lower, {r('cu')} AS change_upper,
 assumption = 'address_proxy_point' OR cl > 0 OR cu < 0 AS sign_identified, CASE WHEN cl > 0 THEN 'increase' WHEN cu < 0 THEN 'decrease' WHEN assumption = 'address_proxy_point' THEN 'zero' ELSE 'not_identified' END AS direction,
 assumption <> 'address_proxy_point' AND (cl > 0 OR cu < 0) AS economic_actor_conclusion_permitted FROM z""",
)
def change_bounds(spark, folder):
    out = B.identified_set(K.assign_periods(T.actions(spark, folder), periods(spark)), links(spark, folder), ["period"])
    return rounded(B.change_bounds(out))


@query(
    "w01_beneficiary_event_panel",
    f"WITH {ACTIONS} SELECT row_number() OVER (ORDER BY block_number, tx_hash, log_index) AS event_ordinal, block_number, CAST(event_week AS BIGINT) AS event_week, action, beneficiary_address FROM actions",
)
def beneficiary_event_panel(spark, folder):
    return rounded(B.beneficiary_events(T.actions(spark, folder)))


def cohorts(spark, folder):
    """Nations as cohorts: clocks follow from the first order date of the nation."""
    orders = T.table(spark, folder, "orders").join(T.table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    first = orders.groupBy("c_nationkey").agg(F.min(F.to_date("o_orderdate")).alias("_first"))
    n = F.col("n_nationkey")
    base = first.join(T.table(spark, folder, "nation"), F.col("c_nationkey") == n)
    day = F.to_timestamp_ntz(F.col("_first").cast("string"))
    activation = day + F.make_interval(days=n * 40 + 200)
    return base.select(
        n.alias("cohort_id"),
        F.col("n_name").alias("chain"),
        day.alias("market_available_by_utc"),
        activation.alias("activation_utc"),
        (activation - F.make_interval(days=(n % 12) * 7 + 14)).alias("anticipation_utc"),
        (n % 5 == 0).alias("market_bundled_with_treatment"),
    )


COHORTS = """co AS (SELECT n_nationkey AS id, n_name AS chain, CAST(min(CAST(o_orderdate AS DATE)) AS TIMESTAMP) AS opened, n_nationkey % 5 = 0 AS bundled FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
c2 AS (SELECT *, opened + to_days(id * 40 + 200) AS act, opened + to_days(id * 40 + 200) - to_days((id % 12) * 7 + 14) AS ant FROM co),
wk AS (SELECT c2.*, CAST(w AS INTEGER) AS event_week, act + to_days(CAST(w AS INTEGER) * 7) AS ws, act + to_days(CAST(w AS INTEGER) * 7 + 7) AS we FROM c2, range(-16, 17) t(w)),
wf AS (SELECT *, event_week < 0 AND we <= ant AS clean, event_week < 0 AND we > ant AS dirty, (event_week < 0 AND we <= ant) OR event_week >= 0 AS req FROM wk)"""


def flagged_weeks(spark, folder):
    return K.pre_flags(K.event_calendar(cohorts(spark, folder), 16, 16))


@query(
    "c01_event_week_calendar",
    f"WITH {COHORTS} SELECT id AS cohort_id, CAST(event_week AS BIGINT) AS event_week, strftime(ws, '%Y-%m-%d') AS window_start, strftime(we, '%Y-%m-%d') AS window_end FROM wk",
)
def event_week_calendar(spark, folder):
    out = K.event_calendar(cohorts(spark, folder), 16, 16)
    return rounded(
        out.select(
            "cohort_id", "event_week", F.to_date("window_start_utc").cast("string").alias("window_start"), F.to_date("window_end_utc_exclusive").cast("string").alias("window_end")
        )
    ).withColumn("cohort_id", F.col("cohort_id").cast("int"))


@query(
    "c02_donor_calendar",
    f"""WITH {COHORTS}, sp AS (SELECT id, min(ws) AS lo, max(we) AS hi FROM wk GROUP BY ALL), el AS (SELECT sp.id AS cal, d.id FROM sp JOIN c2 d ON d.opened <= sp.lo AND d.ant >= sp.hi AND d.id <> sp.id)
SELECT cal AS calendar_cohort_id, el.id AS cohort_id, count(*) AS weeks, strftime(min(ws), '%Y-%m-%d') AS first_day FROM el JOIN wk ON wk.id = cal GROUP BY ALL""",
)
def donor_calendar(spark, folder):
    base = cohorts(spark, folder)
    donors = base.select("cohort_id", "chain", F.col("cohort_id").alias("chain_id"), "market_available_by_utc", F.col("anticipation_utc").alias("own_anticipation_utc"))
    out = K.donor_calendar(K.event_calendar(base, 16, 16), donors, strict=False)
    return out.groupBy("calendar_cohort_id", "cohort_id").agg(
        F.count(F.lit(1)).alias("weeks"), F.to_date(F.min("window_start_utc")).cast("string").alias("first_day")
    )


@query(
    "c04_pre_period_flags",
    f"WITH {COHORTS} SELECT id AS cohort_id, count(*) FILTER (clean) AS clean, count(*) FILTER (dirty) AS contaminated, count(*) FILTER (req) AS required FROM wf GROUP BY ALL",
)
def pre_period_flags(spark, folder):
    return flagged_weeks(spark, folder).groupBy("cohort_id").agg(
        F.count_if("clean_pre").alias("clean"), F.count_if("contaminated_pre").alias("contaminated"), F.count_if("required").alias("required")
    )


DONORS = """dn AS (SELECT wf.id AS target, wf.event_week, d.id AS donor, d.opened <= ws AS a, d.ant >= we AS b, d.act >= we AS c FROM wf JOIN c2 d ON d.id <> wf.id)"""


@query(
    "j10_donor_support",
    f"""WITH {COHORTS}, {DONORS} SELECT target AS target_cohort_id, CAST(event_week AS BIGINT) AS target_event_week, donor AS donor_cohort_id, a AND b AND c AS eligible_donor,
 concat_ws(';', CASE WHEN NOT a THEN 'market-not-yet-active' END, CASE WHEN NOT b THEN 'anticipation-started' END, CASE WHEN NOT c THEN 'already-treated' END) AS exclusion_reason FROM dn""",
)
def donor_support(spark, folder):
    out = D.donor_support(flagged_weeks(spark, folder), cohorts(spark, folder))
    return out.select("target_cohort_id", F.col("target_event_week").cast("bigint").alias("target_event_week"), "donor_cohort_id", "eligible_donor", "exclusion_reason")


@query(
    "a28_cohort_support",
    f"""WITH {COHORTS}, {DONORS}, ws2 AS (SELECT wf.id, wf.event_week, clean, dirty, req, count(*) FILTER (a AND b AND c) AS el FROM wf LEFT JOIN dn ON dn.target = wf.id AND dn.event_week = wf.event_week GROUP BY ALL),
g AS (SELECT id, count(*) FILTER (clean) AS cp, count(*) FILTER (dirty) AS dp, count(*) FILTER (req) AS rq, count(*) FILTER (req AND el >= 1) AS sup, coalesce(min(el) FILTER (req), 0) AS mn FROM ws2 GROUP BY ALL),
h AS (SELECT g.*, bundled, opened <= act - to_days(112) AS pre FROM g JOIN c2 USING (id))
SELECT id AS cohort_id, cp AS clean_pre_week_count, dp AS anticipation_contaminated_pre_week_count, rq AS required_week_count, sup AS required_weeks_with_donor_support, mn AS minimum_eligible_donors_in_required_weeks,
 pre AND cp >= 8 AND sup = rq AND mn >= 1 AND NOT bundled AS activation_did_design_gate,
 concat_ws(';', CASE WHEN NOT pre THEN 'market-not-active-at-window-start' END, CASE WHEN cp < 8 THEN 'insufficient-clean-pre-weeks-after-anticipation' END, CASE WHEN NOT (sup = rq AND mn >= 1) THEN 'incomplete-not-yet-anticipated-donor-support' END, CASE WHEN bundled THEN 'market-and-treatment-bundled' END) AS failure_reasons FROM h""",
)
def cohort_support(spark, folder):
    base, weeks = cohorts(spark, folder), flagged_weeks(spark, folder)
    out = D.cohort_support(D.week_support(weeks, D.donor_support(weeks, base)), base)
    return out.select(
        "cohort_id", "clean_pre_week_count", "anticipation_contaminated_pre_week_count", "required_week_count", "required_weeks_with_donor_support",
        "minimum_eligible_donors_in_required_weeks", "activation_did_design_gate", "failure_reasons",
    )


@query(
    "a28_acquisition_windows",
    f"""WITH {COHORTS}, {DONORS}, ws2 AS (SELECT wf.id, wf.event_week, clean, dirty, req, count(*) FILTER (a AND b AND c) AS el FROM wf LEFT JOIN dn ON dn.target = wf.id AND dn.event_week = wf.event_week GROUP BY ALL),
g AS (SELECT id, count(*) FILTER (clean) AS cp, count(*) FILTER (req) AS rq, count(*) FILTER (req AND el >= 1) AS sup, coalesce(min(el) FILTER (req), 0) AS mn FROM ws2 GROUP BY ALL),
h AS (SELECT id, chain, act, opened <= act - to_days(112) AND cp >= 8 AND sup = rq AND mn >= 1 AND NOT bundled AS gate FROM g JOIN c2 USING (id))
SELECT id AS cohort_id, chain, CAST(act - to_days(112) AS VARCHAR)[1:10] AS first_day, CAST(act + to_days(119) AS VARCHAR)[1:10] AS end_day, gate AS activation_did_design_gate,
 CASE WHEN gate THEN 'causal-diagnostics-pending-data-and-assumptions' ELSE 'descriptive-and-network-comparison' END AS default_analysis_role FROM h""",
)
def acquisition_windows(spark, folder):
    base, weeks = cohorts(spark, folder), flagged_weeks(spark, folder)
    gate = D.cohort_support(D.week_support(weeks, D.donor_support(weeks, base)), base).select("cohort_id", "activation_did_design_gate")
    support = gate.join(base.select("cohort_id", "chain", "activation_utc"), "cohort_id")
    day = [F.to_date(c).cast("string").alias(n) for c, n in (("window_start_utc", "first_day"), ("window_end_utc_exclusive", "end_day"))]
    return D.acquisition_windows(support).select("cohort_id", "chain", *day, "activation_did_design_gate", "default_analysis_role")


def plan_inputs(spark, folder):
    base = cohorts(spark, folder)
    n = F.col("cohort_id")
    treatments = base.where(n % 2 == 1).select(
        "cohort_id", "chain", n.alias("chain_id"), F.col("market_bundled_with_treatment").alias("bundled_market_entry"),
        (F.col("activation_utc") - F.make_interval(days=F.lit(30))).alias("formal_commitment_utc"), F.col("activation_utc").alias("operational_activation_utc"),
    )
    suppliers = T.table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("_n"))
    donors = base.where(n % 2 == 0).join(suppliers, F.col("s_nationkey") == n, "left").select(
        n.alias("market_id"), "chain", n.alias("chain_id"), F.when(F.col("_n") >= 1, F.lit("verified")).otherwise(F.lit("failed")).alias("status"),
        (F.col("market_available_by_utc") + F.make_interval(days=n * 25)).alias("first_seen_utc"), F.concat(F.lit("0xD"), n.cast("string")).alias("pool_address"),
    )
    markets = base.select("chain", n.alias("chain_id"), F.concat(F.lit("0xM"), n.cast("string")).alias("pool_address"), F.lit("verified_locked_registry").alias("verification_status"))
    return treatments, donors, markets


SUPPORT = f"""{COHORTS}, sn AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL),
tr AS (SELECT id, chain, bundled, unnest([{{'clock': 'formal_commitment', 'e': act - to_days(30)}}, {{'clock': 'operational_activation', 'e': act}}]) AS x FROM c2 WHERE id % 2 = 1),
dm AS (SELECT id AS mid, opened + to_days(id * 25) AS seen FROM c2 JOIN sn ON s_nationkey = id WHERE id % 2 = 0),
su AS (SELECT tr.id, tr.chain, bundled, x.clock AS clock, x.e AS e, count(mid) AS k, coalesce(array_to_string(list_sort(list(CAST(mid AS VARCHAR)) FILTER (mid IS NOT NULL)), ';'), '') AS ids FROM tr LEFT JOIN dm ON seen <= x.e - to_days(112) AND mid <> tr.id GROUP BY ALL)"""


@query(
    "j11_contemporaneous_support",
    f"WITH {SUPPORT} SELECT id AS cohort_id, clock, k AS eligible_donor_count, ids AS eligible_market_ids, k >= 2 AND NOT bundled AS support_gate FROM su",
)
def contemporaneous_support(spark, folder):
    treatments, donors, _ = plan_inputs(spark, folder)
    out = D.contemporaneous_support(treatments, donors)
    return out.select("cohort_id", "clock", "eligible_donor_count", "eligible_market_ids", "support_gate")


PLAN = f"""{SUPPORT}, ok AS (SELECT * FROM su WHERE k >= 2 AND NOT bundled), jb AS (SELECT CAST(id AS VARCHAR) || '__' || clock AS aid, clock, id AS cohort, id AS chain_id, '0xm' || CAST(id AS VARCHAR) AS pool, e, 'treated' AS role FROM ok
 UNION ALL SELECT CAST(id AS VARCHAR) || '__' || clock, clock, id, CAST(mid AS INTEGER), '0xd' || mid, e, 'donor' FROM (SELECT *, unnest(string_split(ids, ';')) AS mid FROM ok))"""


@query(
    "j12_merged_scans",
    f"""WITH {PLAN} SELECT chain_id, pool AS pool_address, strftime(min(e - to_days(112)), '%Y-%m-%d') AS scan_start, strftime(max(e + to_days(112)), '%Y-%m-%d') AS scan_end, array_to_string(list_sort(list(DISTINCT aid)), ';') AS analysis_ids FROM jb GROUP BY ALL""",
)
def merged_scans(spark, folder):
    treatments, donors, markets = plan_inputs(spark, folder)
    _, scans = D.acquisition_plan(D.contemporaneous_support(treatments, donors), treatments, markets, donors)
    return scans.select(
        "chain_id", "pool_address", F.to_date("scan_start_utc").cast("string").alias("scan_start"), F.to_date("scan_end_utc").cast("string").alias("scan_end"), "analysis_ids"
    )


@query(
    "j12_plan_summary",
    f"""WITH {PLAN} SELECT count(DISTINCT aid) AS analysis_count, count(*) AS unit_job_count, count(DISTINCT cohort) FILTER (clock = 'formal_commitment') AS formal_cohort_count, count(DISTINCT cohort) FILTER (clock = 'operational_activation') AS activation_cohort_count,
 (SELECT count(*) FROM (SELECT DISTINCT chain_id, pool FROM jb)) AS deduplicated_chain_scans, (SELECT min(c) FROM (SELECT count(*) FILTER (role = 'donor') AS c FROM jb GROUP BY aid)) AS minimum_donors_per_analysis FROM jb""",
)
def plan_summary(spark, folder):
    treatments, donors, markets = plan_inputs(spark, folder)
    jobs, scans = D.acquisition_plan(D.contemporaneous_support(treatments, donors), treatments, markets, donors)
    return D.plan_summary(jobs, scans).drop("plan_valid")


@query(
    "q17_design_audit",
    f"""WITH {COHORTS}, t AS (SELECT count(*) FILTER (id % 2 = 1) AS n, count(*) FILTER (id % 2 = 1 AND bundled <> (opened = act)) AS bm FROM c2), d AS (SELECT count(*) AS c, count(*) FILTER (n IS NOT NULL) AS v FROM c2 LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL) ON s_nationkey = id WHERE id % 2 = 0),
r AS (SELECT count(*) FILTER (s_suppkey % 2 = 0) AS h, count(*) FILTER (s_suppkey % 2 = 1) AS cu FROM supplier)
SELECT n AS treatment_cohort_count, bm AS bundled_flag_mismatch, c AS candidate_donor_count, v AS verified_donor_count, h AS historically_verified_route_count, cu AS current_verified_route_count, CASE WHEN bm > 0 THEN 'invalid' ELSE 'design_valid_evidence_pending' END AS status,
 v >= 2 AND n >= 3 AS formal_commitment_staggered_did_gate, h >= 2 OR cu >= 2 AS bridge_metric_gate FROM t, d, r""",
)
def design_audit(spark, folder):
    treatments, donors, _ = plan_inputs(spark, folder)
    opened = cohorts(spark, folder).select("cohort_id", "market_available_by_utc")
    treatments = treatments.join(opened, "cohort_id").withColumn("formal_commitment_source", F.lit("https://example.org"))
    status = F.when(F.col("s_suppkey") % 2 == 0, F.lit("historically_verified")).otherwise(F.lit("current_verified"))
    routes = T.table(spark, folder, "supplier").select(status.alias("configuration_status"))
    out = D.design_audit(treatments, donors.withColumnRenamed("status", "verification_status"), routes)
    return out.select(
        "treatment_cohort_count", "bundled_flag_mismatch", "candidate_donor_count", "verified_donor_count", "historically_verified_route_count",
        "current_verified_route_count", "status", "formal_commitment_staggered_did_gate", "bridge_metric_gate",
    )


@query(
    "q21_donor_verification_gate",
    f"""WITH {COHORTS}, d AS (SELECT count(*) AS c, count(*) FILTER (n IS NOT NULL) AS v FROM c2 LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL) ON s_nationkey = id WHERE id % 2 = 0)
SELECT c AS selected, v AS verified, c - v AS failed, CAST(2 AS BIGINT) AS minimum_verified, v >= 2 AS support_audit_eligible, v = c AS all_verified FROM d""",
)
def donor_verification_gate(spark, folder):
    return rounded(D.verification_gate(plan_inputs(spark, folder)[1], 2))


@query(
    "c05_common_calendar_panel",
    f"""WITH {ACTIONS}, u AS (SELECT chain_id, event_week, count(DISTINCT beneficiary_address) AS a FROM actions GROUP BY ALL)
SELECT chain_id, CAST(event_week AS BIGINT) AS event_week, a AS active, {r('ln(1 + CAST(a AS DOUBLE))')} AS log_active, CASE WHEN event_week < -8 THEN 'clean_pre' WHEN event_week < 0 THEN 'anticipation_excluded' WHEN event_week = 0 THEN 'event_week_zero_excluded' ELSE 'post' END AS period FROM u""",
)
def common_calendar_panel(spark, folder):
    from tallyweave.operators.inference import common_panel

    panel = T.actions(spark, folder).groupBy("chain_id", "event_week").agg(F.count_distinct("beneficiary_address").alias("active"))
    calendar = spark.range(T.FIRST_DAY, T.LAST_DAY + 1).select(F.col("id").cast("int").alias("event_week"))
    return rounded(common_panel(panel, calendar, ["chain_id"], "active", T.FIRST_DAY, T.LAST_DAY))
