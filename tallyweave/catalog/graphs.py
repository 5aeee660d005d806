"""Graph measures on the interaction graph of the events and on customer-supplier flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.catalog.registry import ACTIONS, query, r, rounded
from tallyweave.operators import graph as G
from tallyweave.session import cut
from tallyweave.sources import tables as T

EDGES = """e AS (SELECT chain_id, actor_address AS src, beneficiary_address AS dst, count(*) AS w FROM actions WHERE actor_address <> beneficiary_address GROUP BY ALL)"""
SYMMETRIC = """sym AS (SELECT DISTINCT chain_id, src, dst FROM (SELECT chain_id, src, dst FROM e UNION ALL SELECT chain_id, dst, src FROM e))"""


@query(
    "g01_role_graph",
    f"""WITH {ACTIONS}, {EDGES} SELECT chain_id, least(src, dst) AS src, greatest(src, dst) AS dst, CAST(sum(w) AS BIGINT) AS weight FROM e GROUP BY ALL""",
)
def role_graph(spark, folder):
    return G.undirected(G.role_edges(T.actions(spark, folder), ["chain_id"]), ["chain_id"])


@query(
    "g01_self_directed_share",
    f"""WITH {ACTIONS} SELECT chain_id, action, count(*) AS event_count, {r('avg(CAST(actor_address = beneficiary_address AS INT))')} AS self_directed_event_share,
 count(*) FILTER (actor_address <> beneficiary_address) AS delegated_event_count FROM actions GROUP BY ALL""",
)
def self_directed_share(spark, folder):
    return rounded(G.self_directed(T.actions(spark, folder), ["chain_id", "action"]))


def components_sql(prefix: str, rounds: int = 12) -> str:
    """Minimum-label propagation, one step per round, on relation ``sym(g, src, dst)``."""
    steps = [f"l0 AS MATERIALIZED (SELECT DISTINCT {prefix}, src AS node, src AS c FROM sym)"]
    for i in range(rounds):
        steps.append(
            f"l{i + 1} AS MATERIALIZED (SELECT {prefix}, node, min(c) AS c FROM (SELECT {prefix}, node, c FROM l{i} UNION ALL "
            f"SELECT {', '.join('sym.' + p.strip() for p in prefix.split(','))}, sym.dst AS node, l.c FROM sym JOIN l{i} l ON "
            + " AND ".join(f"sym.{p.strip()} = l.{p.strip()}" for p in prefix.split(","))
            + " AND sym.src = l.node) GROUP BY ALL)"
        )
    return ", ".join(steps)


def cores_sql(prefix: str, rounds: int) -> str:
    """h-index iteration from degrees on relation ``sym(g, src, dst)``."""
    keys = [p.strip() for p in prefix.split(",")]
    match = " AND ".join(f"sym.{k} = k.{k}" for k in keys)
    listed = ", ".join(f"sym.{k}" for k in keys)
    steps = [f"k0 AS MATERIALIZED (SELECT {prefix}, src AS node, count(*) AS core FROM sym GROUP BY ALL)"]
    for i in range(rounds):
        steps.append(
            f"k{i + 1} AS MATERIALIZED (SELECT {prefix}, node, max(least(core, rk)) AS core FROM (SELECT {listed}, sym.dst AS node, k.core, "
            f"row_number() OVER (PARTITION BY {listed}, sym.dst ORDER BY k.core DESC) AS rk FROM sym JOIN k{i} k ON {match} AND sym.src = k.node) GROUP BY ALL)"
        )
    return ", ".join(steps)


def pagerank_sql(prefix: str, rounds: int) -> str:
    """Rounds of weighted PageRank on ``e(g, src, dst, w)``; graph g stops at its first round
    below the tolerance, and ``pr`` holds each graph's ranks at that round."""
    keys = [p.strip() for p in prefix.split(",")]
    using = f"USING ({prefix}, node)"
    steps = [
        f"ow AS MATERIALIZED (SELECT {prefix}, node, sum(o) AS o FROM (SELECT {prefix}, src AS node, CAST(w AS DOUBLE) AS o FROM e UNION ALL SELECT {prefix}, dst, 0 FROM e) GROUP BY ALL)",
        f"nn AS MATERIALIZED (SELECT {prefix}, CAST(count(*) AS DOUBLE) AS n FROM ow GROUP BY ALL)",
        f"p0 AS MATERIALIZED (SELECT {prefix}, node, o, n, 1 / n AS rank FROM ow JOIN nn USING ({prefix}))",
    ]
    on = " AND ".join(f"e.{k} = p.{k}" for k in keys)
    for i in range(rounds):
        steps.append(
            f"p{i + 1} AS MATERIALIZED (SELECT {prefix}, node, o, n, (1 - CAST(0.85 AS DOUBLE)) / n + CAST(0.85 AS DOUBLE) * coalesce(d, 0) / n + CAST(0.85 AS DOUBLE) * coalesce(inn, 0) AS rank "
            f"FROM p{i} LEFT JOIN (SELECT {', '.join('e.' + k for k in keys)}, e.dst AS node, sum(p.rank * e.w / p.o) AS inn FROM e JOIN p{i} p ON {on} AND e.src = p.node GROUP BY ALL) {using} "
            f"LEFT JOIN (SELECT {prefix}, sum(rank) AS d FROM p{i} WHERE o = 0 GROUP BY ALL) USING ({prefix}))"
        )
    union = " UNION ALL ".join(f"SELECT {i} AS rnd, * FROM p{i}" for i in range(rounds + 1))
    steps.append(f"hist AS MATERIALIZED ({union})")
    steps.append(
        f"stop AS (SELECT {prefix}, min(rnd) AS rnd FROM (SELECT {', '.join('a.' + k for k in keys)}, b.rnd, sum(abs(b.rank - a.rank)) AS ch, max(a.n) AS n FROM hist a JOIN hist b "
        f"ON {' AND '.join(f'a.{k} = b.{k}' for k in keys)} AND a.node = b.node AND b.rnd = a.rnd + 1 GROUP BY ALL) WHERE ch < n * 1e-10 GROUP BY ALL)"
    )
    steps.append(f"pr AS (SELECT hist.* FROM hist JOIN stop USING ({prefix}, rnd))")
    return ", ".join(steps)


@query(
    "g04_components",
    f"""WITH {ACTIONS}, {EDGES}, {SYMMETRIC}, {components_sql('chain_id')} SELECT chain_id, node, c AS component FROM l12""",
)
def components(spark, folder):
    return G.components(G.role_edges(T.actions(spark, folder), ["chain_id"]), ["chain_id"])


THIN = """e AS (SELECT event_week AS chain_id, action, actor_address AS src, 1000 + beneficiary_address AS dst, count(*) AS w FROM actions GROUP BY ALL)"""


@query(
    "g04_largest_component_share",
    f"""WITH {ACTIONS}, {THIN}, sym AS (SELECT DISTINCT chain_id, action, src, dst FROM (SELECT chain_id, action, src, dst FROM e UNION ALL SELECT chain_id, action, dst, src FROM e)),
{components_sql('chain_id, action', 40)},
s AS (SELECT chain_id, action, c, count(*) AS z FROM l40 GROUP BY ALL)
SELECT CAST(chain_id AS BIGINT) AS event_week, action, CAST(sum(z) AS BIGINT) AS node_count, count(*) AS component_count, max(z) AS largest_component, {r('max(z) / CAST(sum(z) AS DOUBLE)')} AS largest_component_share FROM s GROUP BY ALL""",
)
def largest_component_share(spark, folder):
    df = T.actions(spark, folder).withColumn("beneficiary_address", F.col("beneficiary_address") + 1000)
    by = ["event_week", "action"]
    return rounded(G.component_sizes(G.components(G.role_edges(df, by), by), by))


@query(
    "g05_core_numbers",
    f"""WITH {ACTIONS}, {EDGES}, {SYMMETRIC}, {cores_sql('chain_id', 14)} SELECT chain_id, node, core FROM k14""",
)
def core_numbers(spark, folder):
    return G.core_numbers(G.role_edges(T.actions(spark, folder), ["chain_id"]), ["chain_id"])


@query(
    "g06_pagerank",
    f"""WITH {ACTIONS}, {EDGES}, {pagerank_sql('chain_id', 24)} SELECT chain_id, node, {r('rank')} AS pagerank FROM pr""",
)
def pagerank(spark, folder):
    return rounded(G.pagerank(G.role_edges(T.actions(spark, folder), ["chain_id"]), ["chain_id"]))


LAYERED = """base AS (SELECT chain_id, action, actor_address AS src, beneficiary_address AS dst, count(*) AS w FROM actions WHERE actor_address <> beneficiary_address GROUP BY ALL),
e AS MATERIALIZED (SELECT chain_id, action AS layer, src, dst, w FROM base UNION ALL SELECT chain_id, 'all_actions', src, dst, CAST(sum(w) AS BIGINT) FROM base GROUP BY ALL),
ev AS (SELECT chain_id, action AS layer, actor_address, beneficiary_address FROM actions UNION ALL SELECT chain_id, 'all_actions', actor_address, beneficiary_address FROM actions),
sym AS MATERIALIZED (SELECT DISTINCT chain_id, layer, src, dst FROM (SELECT chain_id, layer, src, dst FROM e UNION ALL SELECT chain_id, layer, dst, src FROM e))"""


def _strength_hhi(column: str, name: str) -> str:
    return f"""{name} AS (SELECT chain_id, layer, sum(s * s) / (sum(s) * sum(s)) AS h FROM (SELECT chain_id, layer, {column}, CAST(sum(w) AS DOUBLE) AS s FROM e GROUP BY ALL) GROUP BY ALL)"""


TOPOLOGY_SQL = f"""WITH {ACTIONS}, {LAYERED}, {components_sql('chain_id, layer', 12)}, {cores_sql('chain_id, layer', 14)}, {pagerank_sql('chain_id, layer', 24)},
{_strength_hhi('src', 'oh')}, {_strength_hhi('dst', 'ih')},
ec AS (SELECT chain_id, layer, count(*) AS event_count, avg(CAST(actor_address = beneficiary_address AS INT)) AS ss, count(*) FILTER (actor_address <> beneficiary_address) AS dc FROM ev GROUP BY ALL),
nc AS (SELECT chain_id, layer, count(DISTINCT src) AS n FROM sym GROUP BY ALL),
mc AS (SELECT e.chain_id, e.layer, count(*) AS m, count(b.src) / CAST(count(*) AS DOUBLE) AS rec FROM e LEFT JOIN e b ON e.chain_id = b.chain_id AND e.layer = b.layer AND e.src = b.dst AND e.dst = b.src GROUP BY ALL),
gc AS (SELECT chain_id, layer, max(z) AS z FROM (SELECT chain_id, layer, c, count(*) AS z FROM l12 GROUP BY ALL) GROUP BY ALL),
kc AS (SELECT chain_id, layer, max(core) AS k, count(*) FILTER (core = mx) AS kn FROM (SELECT *, max(core) OVER (PARTITION BY chain_id, layer) AS mx FROM k14) GROUP BY ALL),
pc AS (SELECT chain_id, layer, sum(rank * rank) / (sum(rank) * sum(rank)) AS h, max(rank) AS mx FROM pr GROUP BY ALL)
SELECT chain_id, layer, event_count, {r('ss')} AS self_directed_event_share, dc AS delegated_event_count, n AS topology_node_count, m AS topology_edge_count, {r('rec')} AS directed_reciprocity,
  {r('z / CAST(n AS DOUBLE)')} AS largest_weak_component_share, {r('oh.h')} AS weighted_out_degree_hhi, {r('ih.h')} AS weighted_in_degree_hhi, {r('pc.h')} AS pagerank_hhi,
  {r('pc.mx')} AS maximum_pagerank_share, k AS maximum_k_core, {r('kn / CAST(n AS DOUBLE)')} AS maximum_core_node_share, 'address_role' AS observed_unit, 'descriptive_noncausal' AS interpretation_status
FROM ec JOIN nc USING (chain_id, layer) JOIN mc USING (chain_id, layer) JOIN gc USING (chain_id, layer) JOIN kc USING (chain_id, layer) JOIN pc USING (chain_id, layer)
JOIN oh USING (chain_id, layer) JOIN ih USING (chain_id, layer)"""


@query("g07_topology_panel", TOPOLOGY_SQL)
def topology_panel(spark, folder):
    return rounded(G.topology_panel(T.actions(spark, folder), ["chain_id"]))


def snapshot_sql(keys: list[str], flows: str, cores: int = 40, components: int = 40) -> str:
    k = ", ".join(keys)
    return f"""{flows},
e AS MATERIALIZED (SELECT {k}, src, dst, sum(v) AS w FROM flows WHERE src <> dst GROUP BY ALL),
ends AS (SELECT {k}, src AS node, v FROM flows UNION ALL SELECT {k}, dst, v FROM flows),
act AS (SELECT {k}, node, sum(v) AS a FROM ends GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY a, node) AS i FROM act),
am AS (SELECT {k}, count(*) AS n, sum(a * a) / (sum(a) * sum(a)) AS h, 2 * sum(i * a) / (count(*) * sum(a)) - (count(*) + 1) / CAST(count(*) AS DOUBLE) AS gi FROM rk GROUP BY ALL),
tv AS (SELECT {k}, sum(v) AS tv FROM flows GROUP BY ALL), mc AS (SELECT {k}, count(*) AS m FROM e GROUP BY ALL),
sym AS MATERIALIZED (SELECT DISTINCT {k}, src, dst FROM (SELECT {k}, src, dst FROM e UNION ALL SELECT {k}, dst, src FROM e)),
{components_sql(k, components)}, {cores_sql(k, cores)},
gc AS (SELECT {k}, max(z) AS z FROM (SELECT {k}, c, count(*) AS z FROM l{components} GROUP BY ALL) GROUP BY ALL),
kc AS (SELECT {k}, count(*) FILTER (core = mx) AS kn FROM (SELECT *, max(core) OVER (PARTITION BY {k}) AS mx FROM k{cores}) GROUP BY ALL)"""


SNAPSHOT_COLUMNS = f"""n AS active_nodes, coalesce(m, 0) AS edge_count, {r('tv')} AS total_value, {r('h')} AS activity_hhi, {r('1 / h')} AS effective_entities, {r('gi')} AS activity_gini,
 {r('coalesce(z, 1) / CAST(n AS DOUBLE)')} AS giant_component_ratio, {r('CASE WHEN n > 1 THEN coalesce(m, 0) / (CAST(n AS DOUBLE) * (n - 1)) ELSE 0 END')} AS density,
 {r('CASE WHEN n >= 2 AND coalesce(m, 0) > 0 THEN kn / CAST(n AS DOUBLE) ELSE 1 END')} AS core_share"""


@query(
    "g02_snapshot_metrics",
    f"""WITH {ACTIONS}, {snapshot_sql(['chain_id', 'action'], "flows AS (SELECT chain_id, action, actor_address AS src, beneficiary_address AS dst, CAST(amount_raw AS DOUBLE) / 1e18 AS v FROM actions)", 16, 12)}
SELECT chain_id, action, {SNAPSHOT_COLUMNS.replace("{r('tv')}", "tv")} FROM am JOIN tv USING (chain_id, action) LEFT JOIN mc USING (chain_id, action) LEFT JOIN gc USING (chain_id, action) LEFT JOIN kc USING (chain_id, action)""",
)
def snapshot_metrics(spark, folder):
    df = T.actions(spark, folder).withColumn("value", F.col("amount_raw").cast("double") / F.lit(1e18))
    return rounded(G.snapshot_metrics(df, ["chain_id", "action"], "actor_address", "beneficiary_address"))


@query(
    "g03_temporal_snapshots",
    f"""WITH {ACTIONS}, {snapshot_sql(['period', 'chain_id', 'asset'], "flows AS (SELECT CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS VARCHAR)[1:10] AS period, chain_id, reserve_address AS asset, actor_address AS src, 1000 + beneficiary_address AS dst, CAST(event_week + 15 AS DOUBLE) AS v FROM actions)", 12, 40)}
SELECT period, chain_id, asset, {SNAPSHOT_COLUMNS} FROM am JOIN tv USING (period, chain_id, asset) LEFT JOIN mc USING (period, chain_id, asset) LEFT JOIN gc USING (period, chain_id, asset) LEFT JOIN kc USING (period, chain_id, asset)""",
)
def temporal_snapshots(spark, folder):
    df = T.actions(spark, folder).select(
        F.col("ts").alias("timestamp"),
        "chain_id",
        F.col("reserve_address").alias("asset"),
        F.col("actor_address").alias("from_entity"),
        (F.col("beneficiary_address") + 1000).alias("to_entity"),
        (F.col("event_week") + 15).cast("double").alias("value"),
    )
    out = G.temporal_snapshots(df, ["chain_id", "asset"])
    return rounded(out.withColumn("period", F.col("period").cast("string")))


@query(
    "g14_core_persistence",
    f"""WITH {ACTIONS}, e AS (SELECT chain_id, event_week, actor_address AS src, beneficiary_address AS dst FROM actions WHERE actor_address <> beneficiary_address GROUP BY ALL),
sym AS MATERIALIZED (SELECT DISTINCT chain_id, event_week, src, dst FROM (SELECT chain_id, event_week, src, dst FROM e UNION ALL SELECT chain_id, event_week, dst, src FROM e)),
{cores_sql('chain_id, event_week', 14)}, m AS (SELECT *, max(core) OVER (PARTITION BY chain_id, event_week) AS mx FROM k14)
SELECT chain_id, node, count(*) AS topology_active_weeks, count(*) FILTER (core = mx) AS maximum_core_weeks, {r('avg(core / CAST(mx AS DOUBLE))')} AS mean_normalized_weekly_core,
 {r('count(*) FILTER (core = mx) / CAST(count(*) AS DOUBLE)')} AS maximum_core_persistence FROM m GROUP BY ALL""",
)
def core_persistence(spark, folder):
    return rounded(G.core_persistence(T.actions(spark, folder), ["chain_id"], minimum=T.FIRST_DAY, maximum=T.LAST_DAY))


def katz_sql(rounds: int) -> str:
    steps = ["x0 AS MATERIALIZED (SELECT DISTINCT chain_id, src AS node, CAST(1 AS DOUBLE) AS x FROM arcs)"]
    for i in range(rounds):
        steps.append(
            f"x{i + 1} AS MATERIALIZED (SELECT arcs.chain_id, arcs.dst AS node, 1 + sum(arcs.w * x{i}.x) * CAST(0.001 AS DOUBLE) AS x FROM arcs JOIN x{i} ON arcs.chain_id = x{i}.chain_id AND arcs.src = x{i}.node GROUP BY ALL)"
        )
    return ", ".join(steps)


@query(
    "g17_katz_bonacich",
    f"""WITH {ACTIONS}, {EDGES}, arcs AS MATERIALIZED (SELECT chain_id, src, dst, sum(w) AS w FROM (SELECT chain_id, src, dst, w FROM e UNION ALL SELECT chain_id, dst, src, w FROM e) GROUP BY ALL),
{katz_sql(28)} SELECT chain_id, node, {r('x')} AS activity FROM x28""",
)
def katz_bonacich(spark, folder):
    return rounded(G.katz_bonacich(G.role_edges(T.actions(spark, folder), ["chain_id"]), None, ["chain_id"], 0.001))


@query(
    "g17_katz_concentration",
    f"""WITH {ACTIONS}, {EDGES}, arcs AS MATERIALIZED (SELECT chain_id, src, dst, sum(w) AS w FROM (SELECT chain_id, src, dst, w FROM e UNION ALL SELECT chain_id, dst, src, w FROM e) GROUP BY ALL),
{katz_sql(28)} SELECT chain_id, count(*) AS nodes, {r('sum(x * x) / (sum(x) * sum(x))')} AS structural_hhi FROM x28 GROUP BY ALL""",
)
def katz_concentration(spark, folder):
    activity = G.katz_bonacich(G.role_edges(T.actions(spark, folder), ["chain_id"]), None, ["chain_id"], 0.001)
    x = F.col("activity")
    return rounded(
        activity.groupBy("chain_id").agg(F.count(F.lit(1)).alias("nodes"), (F.sum(x * x) / (F.sum(x) * F.sum(x))).alias("structural_hhi"))
    )


from tallyweave.operators import coreperiphery as CP  # noqa: E402
from tallyweave.operators.ordering import group_ordinal  # noqa: E402
from tallyweave.operators.sizing import with_scalar  # noqa: E402

CHAIN = ["chain_id"]


def flat_graph(spark, folder):
    return cut(G.undirected(G.role_edges(T.actions(spark, folder), []), []))


def node_tables(spark, folder):
    """Node table, continuous fits, binary summaries and binary candidates of both chains, from one run."""
    return CP.node_table(T.actions(spark, folder), CHAIN)


def first_chain(spark, folder):
    """The first chain's graph and its node table, for the display backbone."""
    actions = T.actions(spark, folder).where("chain_id = 0")
    flat = cut(G.undirected(G.role_edges(actions, []), []))
    return flat, cut(CP.node_table(actions, [])[0])


ONE_GRAPH = """e AS (SELECT actor_address AS src, beneficiary_address AS dst, count(*) AS w FROM actions WHERE actor_address <> beneficiary_address GROUP BY ALL),
flat AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(sum(w) AS BIGINT) AS w FROM e GROUP BY ALL),
sym AS (SELECT src, dst, w FROM flat UNION ALL SELECT dst, src, w FROM flat),
deg AS (SELECT src AS node, count(*) AS degree, CAST(sum(w) AS BIGINT) AS weighted_degree FROM sym GROUP BY ALL)"""


@query(
    "g08_rombach_template",
    f"""WITH {ACTIONS}, {ONE_GRAPH}, o AS (SELECT node, row_number() OVER (ORDER BY degree, node) AS i, count(*) OVER () AS n FROM deg),
p AS (SELECT node, i, n, greatest(1, least(n - 1, floor(n * CAST(0.8 AS DOUBLE)))) AS b FROM o),
t AS (SELECT node, i, CASE WHEN i <= b THEN 0.5 * i / (2 * b) ELSE (i - b) * CAST(0.5 AS DOUBLE) / (2 * (n - b)) + CAST(0.75 AS DOUBLE) END AS v FROM p)
SELECT node, i AS ordinal, {r('v / sum(v) OVER ()', 12)} AS profile FROM t""",
)
def rombach_template(spark, folder):
    arcs = G.both_ways(flat_graph(spark, folder), [])
    degree = arcs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    out = CP.template_table(group_ordinal(degree, [], ["degree", "node"]), 0.5, 0.8)
    return rounded(out.select("node", "ordinal", "profile"), 12)


def continuous_fits(spark, folder):
    """Coreness and fits of both chains; every lane is solved in the same jobs."""
    edges = cut(G.role_edges(T.actions(spark, folder), CHAIN))
    flat = cut(G.undirected(edges, CHAIN))
    starts = cut(CP.rombach_starts(flat, G.core_numbers(flat, CHAIN, flat=True), G.pagerank(edges, CHAIN), CHAIN))
    return CP.fit_rombach(flat, starts, CHAIN)


@query("g09_rombach_parameter_fits")
def rombach_parameter_fits(spark, folder):
    return rounded(continuous_fits(spark, folder)[1])


@query("g10_rombach_coreness")
def rombach_coreness(spark, folder):
    return rounded(continuous_fits(spark, folder)[0])


BE_SCORE = """CASE WHEN k <= 0 OR k >= n OR ones >= pairs THEN 0 ELSE ((m - p) / pairs - m / pairs * ones / pairs) / sqrt(m / pairs * (1 - m / pairs) * (ones / pairs) * (1 - ones / pairs)) END"""


@query(
    "g11_core_size_scan",
    f"""WITH {ACTIONS}, {ONE_GRAPH}, ords AS (SELECT 'unweighted_degree' AS ordering, node, row_number() OVER (ORDER BY degree DESC, node) AS i FROM deg
  UNION ALL SELECT 'weighted_degree', node, row_number() OVER (ORDER BY weighted_degree DESC, node) FROM deg),
sz AS (SELECT ordering, i AS k FROM ords), nm AS (SELECT (SELECT count(*) FROM deg) AS n, (SELECT count(*) FROM flat) AS m),
mr AS (SELECT a.ordering, least(a.i, b.i) AS i FROM flat JOIN ords a ON a.node = flat.src JOIN ords b ON b.node = flat.dst AND a.ordering = b.ordering),
pe AS (SELECT sz.ordering, sz.k, (SELECT m FROM nm) - count(mr.i) AS p FROM sz LEFT JOIN mr ON mr.ordering = sz.ordering AND mr.i <= sz.k GROUP BY ALL),
sc AS (SELECT ordering, k, p, CAST(n AS DOUBLE) AS n, CAST(m AS DOUBLE) AS m, n * (n - 1) / CAST(2 AS DOUBLE) AS pairs, n * (n - 1) / CAST(2 AS DOUBLE) - (n - k) * (n - k - 1) / CAST(2 AS DOUBLE) AS ones FROM pe, nm WHERE k >= 2)
SELECT ordering, k AS core_size, p AS peripheral_edge_count, {r(BE_SCORE)} AS score FROM sc""",
)
def core_size_scan(spark, folder):
    flat = flat_graph(spark, folder)
    scores = G.both_ways(flat, []).groupBy(F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree")
    )
    orderings = CP.be_orderings(scores, [], ("unweighted_degree", "weighted_degree"))
    scan = CP.scan_core_sizes(flat, orderings, ["ordering"])
    return rounded(scan.select("ordering", "core_size", "peripheral_edge_count", "score"))


@query("g12_g13_binary_core")
def binary_core(spark, folder):
    return rounded(CP.binary_summary(T.actions(spark, folder), CHAIN))


@query(
    "g13_candidate_scores",
    f"""WITH {ACTIONS}, {EDGES}, {SYMMETRIC}, {cores_sql('chain_id', 14)},
flat AS (SELECT chain_id, least(src, dst) AS src, greatest(src, dst) AS dst, CAST(sum(w) AS BIGINT) AS w FROM e GROUP BY ALL),
deg AS (SELECT chain_id, node, count(*) AS degree, sum(w) AS weight FROM (SELECT chain_id, src AS node, w FROM flat UNION ALL SELECT chain_id, dst, w FROM flat) GROUP BY ALL),
sc AS (SELECT chain_id, node, degree, weight, core FROM deg JOIN k14 USING (chain_id, node)),
ords AS (SELECT chain_id, 'unweighted_degree' AS ordering, node, row_number() OVER (PARTITION BY chain_id ORDER BY degree DESC, node) AS i FROM sc
  UNION ALL SELECT chain_id, 'weighted_degree', node, row_number() OVER (PARTITION BY chain_id ORDER BY weight DESC, node) FROM sc
  UNION ALL SELECT chain_id, 'k_core_then_degree', node, row_number() OVER (PARTITION BY chain_id ORDER BY core DESC, degree DESC, node) FROM sc),
mr AS (SELECT a.chain_id, a.ordering, least(a.i, b.i) AS i, count(*) AS c FROM flat JOIN ords a ON a.chain_id = flat.chain_id AND a.node = flat.src
  JOIN ords b ON b.chain_id = flat.chain_id AND b.node = flat.dst AND a.ordering = b.ordering GROUP BY ALL),
pe AS (SELECT o.chain_id, o.ordering, o.i AS k, coalesce(sum(c) OVER (PARTITION BY o.chain_id, o.ordering ORDER BY o.i), 0) AS covered FROM ords o LEFT JOIN mr USING (chain_id, ordering, i)),
nm AS (SELECT chain_id, (SELECT count(*) FROM deg WHERE deg.chain_id = flat.chain_id) AS n, count(*) AS m FROM flat GROUP BY ALL),
fit AS (SELECT chain_id, ordering, k, m - covered AS p, CAST(n AS DOUBLE) AS n, CAST(m AS DOUBLE) AS m, n * (n - 1) / CAST(2 AS DOUBLE) AS pairs, n * (n - 1) / CAST(2 AS DOUBLE) - (n - k) * (n - k - 1) / CAST(2 AS DOUBLE) AS ones
  FROM pe JOIN nm USING (chain_id) WHERE k >= 2),
val AS (SELECT chain_id, ordering, k, {BE_SCORE} AS score FROM fit)
SELECT chain_id, ordering, k AS core_size, {r('score')} AS score FROM val QUALIFY row_number() OVER (PARTITION BY chain_id, ordering ORDER BY round(score, 15) DESC, k) = 1""",
)
def candidate_scores(spark, folder):
    """Candidates of the orderings that need no fit."""
    flat = cut(G.undirected(G.role_edges(T.actions(spark, folder), CHAIN), CHAIN))
    scores = cut(CP.degrees(flat, CHAIN).join(G.core_numbers(flat, CHAIN, flat=True), [*CHAIN, "node"]))
    return rounded(CP.binary_candidates(flat, scores, CHAIN, ("unweighted_degree", "weighted_degree", "k_core_then_degree")))


@query("g15_method_agreement")
def method_agreement(spark, folder):
    return rounded(CP.method_agreement(cut(node_tables(spark, folder)[0]), CHAIN))


@query("g15_node_table")
def node_table(spark, folder):
    return rounded(node_tables(spark, folder)[0])


@query("g16_backbone")
def backbone(spark, folder):
    display, _, omitted = CP.backbone(*first_chain(spark, folder))
    shown = with_scalar(display.select("address", "display_reason", "rombach_percentile"), omitted)
    return rounded(shown)


@query("g16_backbone_edges")
def backbone_edges(spark, folder):
    return CP.backbone(*first_chain(spark, folder))[1]


@query("a27_scale_diagnostics")
def scale_diagnostics(spark, folder):
    summary = CP.core_overlap(cut(node_tables(spark, folder)[0]), CHAIN)
    out = G.scale_diagnostics(summary)
    return rounded(out.select("chain_id", "node_count", "scaled_pagerank_hhi", "effective_pagerank_fraction", "be_containment", "persistent_share"))


NODE_SQL = f"""WITH {ACTIONS}, e AS (SELECT chain_id AS g, actor_address AS src, beneficiary_address AS dst, count(*) AS w FROM actions WHERE actor_address <> beneficiary_address GROUP BY ALL),
sym AS MATERIALIZED (SELECT DISTINCT g, src, dst FROM (SELECT g, src, dst FROM e UNION ALL SELECT g, dst, src FROM e)), {cores_sql('g', 14)}, {pagerank_sql('g', 24)},
st AS (SELECT g, node, sum(o) AS o, sum(i) AS i FROM (SELECT g, src AS node, CAST(w AS DOUBLE) AS o, 0 AS i FROM e UNION ALL SELECT g, dst, 0, w FROM e) GROUP BY ALL)
SELECT g AS chain_id, st.node AS address, CASE WHEN st.o > 0 AND st.i > 0 THEN 'actor_and_beneficiary' WHEN st.o > 0 THEN 'actor_only' ELSE 'beneficiary_only' END AS address_role, CAST(st.o AS DOUBLE) AS weighted_out_degree, CAST(st.i AS DOUBLE) AS weighted_in_degree,
 {r('rank')} AS pagerank, core AS core_number, core = max(core) OVER (PARTITION BY g) AS maximum_k_core_member FROM st JOIN k14 USING (g, node) JOIN pr USING (g, node)"""


@query("g15_node_measures", NODE_SQL)
def node_measures(spark, folder):
    edges = cut(G.role_edges(T.actions(spark, folder), CHAIN))
    return rounded(CP.node_measures(edges, cut(G.pagerank(edges, CHAIN)), cut(G.core_numbers(edges, CHAIN)), CHAIN))
