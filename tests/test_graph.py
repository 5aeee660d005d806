import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyweave.operators import coreperiphery as CP
from tallyweave.operators import graph as G


def random_edges(seed, nodes, count, keys=2):
    rng = random.Random(seed)
    out = {}
    for _ in range(count):
        g, a, b = rng.randrange(keys), rng.randrange(nodes), rng.randrange(nodes)
        if rng.random() < 0.3:
            a = 0  # a hub
        if a != b:
            out[(g, a, b)] = rng.randint(1, 5)
    return [(g, f"n{a:03d}", f"n{b:03d}", w) for (g, a, b), w in out.items()]


def edge_frame(spark, edges):
    return spark.createDataFrame(edges, "g int, src string, dst string, weight bigint")


def adjacency(edges, g):
    near = defaultdict(set)
    for k, a, b, _ in edges:
        if k == g:
            near[a].add(b)
            near[b].add(a)
    return near


def peel(near):
    near = {v: set(n) for v, n in near.items()}
    core, k = {}, 0
    while near:
        v = min(near, key=lambda x: (len(near[x]), x))
        k = max(k, len(near[v]))
        core[v] = k
        for u in near.pop(v):
            near[u].discard(v)
    return core


def flood(near):
    label = {}
    for v in sorted(near):
        if v in label:
            continue
        stack = [v]
        while stack:
            u = stack.pop()
            if u not in label:
                label[u] = v
                stack.extend(near[u])
    return label


def dense_pagerank(edges, g, alpha=0.85):
    links = [(a, b, w) for k, a, b, w in edges if k == g]
    nodes = sorted({v for a, b, _ in links for v in (a, b)})
    place = {v: i for i, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in links:
        m[place[b], place[a]] += w
    out = m.sum(axis=0)
    rank = np.full(len(nodes), 1 / len(nodes))
    for _ in range(100):
        step = np.where(out > 0, rank / np.where(out > 0, out, 1), 0)
        new = (1 - alpha) / len(nodes) + alpha * rank[out == 0].sum() / len(nodes) + alpha * (m @ step)
        done = np.abs(new - rank).sum() < len(nodes) * 1e-10
        rank = new
        if done:
            break
    return dict(zip(nodes, rank))


@pytest.fixture
def few_rounds(monkeypatch):
    """Tiny graphs need many PageRank rounds; their ranks are tested elsewhere."""
    original = G.pagerank
    monkeypatch.setattr(G, "pagerank", lambda edges, by: original(edges, by, tolerance=0.05))


def test_topology_case(spark, few_rounds):
    data = [("c", "supply", a, b) for a, b in [("a", "a"), ("a", "b"), ("b", "a"), ("c", "a"), ("a", "c")]]
    events = spark.createDataFrame(data, "chain string, action string, actor_address string, beneficiary_address string")
    out = rows(G.topology_panel(events, ["chain"]), "layer")
    assert set(out) == {"all_actions", "supply"}
    row = out["all_actions"]
    assert (row["event_count"], row["delegated_event_count"], row["topology_node_count"], row["topology_edge_count"]) == (5, 4, 3, 4)
    assert row["self_directed_event_share"] == pytest.approx(0.2)
    assert row["directed_reciprocity"] == 1.0 and row["maximum_k_core"] == 1 and row["largest_weak_component_share"] == 1.0


def test_layer_of_self_loops_only(spark, few_rounds):
    data = [("c", "supply", "a", "b"), ("c", "repay", "a", "a")]
    events = spark.createDataFrame(data, "chain string, action string, actor_address string, beneficiary_address string")
    row = rows(G.topology_panel(events, ["chain"]), "layer")["repay"]
    assert (row["event_count"], row["topology_node_count"], row["maximum_k_core"], row["pagerank_hhi"]) == (1, 0, 0, 0.0)


@pytest.mark.parametrize("cell_rows", [4])
def test_many_graphs_match_brute_force(spark, monkeypatch, cell_rows):
    """The same answers with every hub salted over several cells."""
    original = G.Arcs.__init__
    monkeypatch.setattr(G.Arcs, "__init__", lambda self, arcs, by: original(self, arcs, by, cell_rows))
    edges = random_edges(11, 25, 45)
    df = edge_frame(spark, edges)
    labels = rows(G.components(df, ["g"]), "g", "node")
    cores = rows(G.core_numbers(df, ["g"]), "g", "node")
    ranks = rows(G.pagerank(df, ["g"]), "g", "node")
    for g in (0, 1):
        near = adjacency(edges, g)
        assert {v: labels[(g, v)]["component"] for v in near} == flood(near)
        assert {v: cores[(g, v)]["core"] for v in near} == peel(near)
        for v, value in dense_pagerank(edges, g).items():
            assert ranks[(g, v)]["pagerank"] == pytest.approx(value, abs=1e-11)


def test_long_path_component(spark):
    df = spark.createDataFrame([(i, i + 1, 1) for i in range(80)], "src bigint, dst bigint, weight bigint")
    out = G.components(df, [])
    assert out.count() == 81 and out.select("component").distinct().collect()[0][0] == 0


def test_snapshot_counts_self_loops_in_activity(spark):
    data = [("k", "a", "a", 2.0), ("k", "a", "b", 1.0), ("k", "c", "c", 1.0)]
    out = G.snapshot_metrics(spark.createDataFrame(data, "k string, s string, d string, value double"), ["k"], "s", "d").first()
    assert (out.active_nodes, out.edge_count, out.total_value) == (3, 1, 4.0)
    assert out.activity_hhi == pytest.approx((5**2 + 1 + 2**2) / 64)
    assert out.giant_component_ratio == pytest.approx(2 / 3) and out.core_share == pytest.approx(2 / 3)
    assert out.density == pytest.approx(1 / 6)


def test_core_persistence(spark):
    data = [(w, a, b) for w in (0, 1) for a, b in [("a", "b"), ("b", "c"), ("c", "a")]] + [(1, "a", "d")]
    df = spark.createDataFrame(data, "event_week int, actor_address string, beneficiary_address string")
    out = rows(G.core_persistence(df, []), "node")
    assert out["a"]["maximum_core_persistence"] == 1.0
    assert (out["d"]["topology_active_weeks"], out["d"]["maximum_core_weeks"], out["d"]["mean_normalized_weekly_core"]) == (1, 0, 0.5)


def test_katz_and_radius(spark):
    edges = [e for e in random_edges(4, 12, 30, keys=1)]
    df = edge_frame(spark, edges).drop("g")
    nodes = sorted({v for _, a, b, _ in edges for v in (a, b)})
    place = {v: i for i, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for _, a, b, w in edges:
        m[place[a], place[b]] += w
        m[place[b], place[a]] += w
    radius = float(np.max(np.abs(np.linalg.eigvalsh(m))))
    assert G.spectral_radius(df, [], tolerance=1e-6).first().radius == pytest.approx(radius, rel=1e-3)
    beta = 0.3 / m.sum(axis=0).max()
    expected = np.linalg.solve(np.eye(len(nodes)) - beta * m, np.ones(len(nodes)))
    out = rows(G.katz_bonacich(df, None, [], beta), "node")
    for v in nodes:
        assert out[v]["activity"] == pytest.approx(expected[place[v]], rel=1e-8)
    with pytest.raises(ValueError):
        G.katz_bonacich(df, None, [], -0.1)


STAR = [("a", "b", 4)] + [(x, y, 1) for x in "ab" for y in "cdef"]


def test_core_periphery_recovers_the_ideal_structure(spark):
    """Two graphs in one job: the ideal one, and the same with other names and weights."""
    twin = [("y", a.upper(), b.upper(), 2 * w) for a, b, w in STAR]
    flat = spark.createDataFrame([("x", *e) for e in STAR] + twin, "g string, src string, dst string, weight bigint")
    starts = CP.rombach_starts(flat, G.core_numbers(flat, ["g"]), G.pagerank(flat, ["g"]), ["g"])
    coreness, fits = CP.fit_rombach(flat, starts, ["g"], alphas=(0.5,), betas=(0.7,))
    scores = {(r.g, r.node): r.rombach_coreness for r in coreness.collect()}
    for g, names in (("x", "abcdef"), ("y", "ABCDEF")):
        mine = {n: scores[(g, n)] for n in names}
        assert max(mine.values()) == 1.0 and min(list(mine.values())[:2]) > max(list(mine.values())[2:])
    assert fits.count() == 2 and all(r.converged and r.rounds >= 0 for r in fits.collect())
    core, summary, candidates = CP.fit_borgatti_everett(flat, starts.join(coreness, ["g", "node"]), ["g"])
    assert {(r.g, r.node) for r in core.where("core").collect()} == {("x", "a"), ("x", "b"), ("y", "A"), ("y", "B")}
    for row in summary.collect():
        assert row.core_node_count == 2 and row.fit_correlation == pytest.approx(1.0) and row.converged and row.swaps == 0
    assert candidates.count() == 10


def profile_of(n, alpha, beta):
    b = min(max(int(np.floor(n * beta)), 1), n - 1)
    raw = np.array([(1 - alpha) * i / (2 * b) if i <= b else (i - b) * (1 - alpha) / (2 * (n - b)) + (1 + alpha) / 2 for i in range(1, n + 1)])
    return raw / raw.sum()


def dense_fit(edges, starts, alphas, betas):
    """Coreness of one small graph by dense matrices: {node: value}, {(alpha, beta): quality}."""
    nodes = sorted(starts)
    place = {v: i for i, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges:
        m[place[a], place[b]] += w
        m[place[b], place[a]] += w

    def placed(score, profile):
        out = np.zeros(len(nodes))
        out[sorted(range(len(nodes)), key=lambda i: (score[i], nodes[i]))] = profile
        return out

    total, weights, quality = np.zeros(len(nodes)), 0.0, {}
    for alpha in alphas:
        for beta in betas:
            profile, best = profile_of(len(nodes), alpha, beta), None
            for s in range(4):
                c = placed([starts[v][s] for v in nodes], profile)
                q = c @ m @ c
                while True:
                    pull = m @ c
                    new = placed(np.round(pull / np.abs(pull).max() + 1e-9 * c, 15), profile)
                    if new @ m @ new <= q + max(1e-10, abs(q) * 1e-12):
                        break
                    c, q = new, new @ m @ new
                if best is None or q > best[0] + 1e-12:
                    best = q, c
            quality[alpha, beta] = best[0]
            total, weights = total + best[0] * best[1], weights + best[0]
    total /= weights
    return dict(zip(nodes, total / total.max())), quality


def test_continuous_fits_of_two_graphs_match_dense_matrices(spark):
    edges = random_edges(21, 14, 40)
    flat = G.undirected(edge_frame(spark, edges), ["g"])
    starts = CP.rombach_starts(flat, G.core_numbers(flat, ["g"]), G.pagerank(flat, ["g"]), ["g"])
    coreness, fits = CP.fit_rombach(flat, starts, ["g"], alphas=(0.25, 0.75), betas=(0.7, 0.9))
    got, qualities = rows(coreness, "g", "node"), rows(fits, "g", "alpha", "beta")
    for g in (0, 1):
        mine = [(r.src, r.dst, r.weight) for r in flat.where(F.col("g") == g).collect()]
        given = {r.node: (r.s0, r.s1, r.s2, r.s3) for r in starts.where(F.col("g") == g).collect()}
        values, quality = dense_fit(mine, given, (0.25, 0.75), (0.7, 0.9))
        for at, q in quality.items():
            assert qualities[(g, *at)]["raw_quality"] == pytest.approx(q, rel=1e-9)
        for v, x in values.items():
            assert got[(g, v)]["rombach_coreness"] == pytest.approx(x, abs=1e-9)


def test_template_values(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 5)], "ordinal bigint")
    out = rows(CP.template_table(nodes, 0.5, 0.5), "ordinal")
    expected = [0.125 / 2.25, 0.25 / 2.25, 0.875 / 2.25, 1 / 2.25]
    assert [out[i]["profile"] for i in range(1, 5)] == pytest.approx(expected)


def test_refinement_moves_a_misplaced_core(spark):
    flat = spark.createDataFrame(STAR, "src string, dst string, weight bigint")
    flags = spark.createDataFrame([(n, n in "ac") for n in "abcdef"], "node string, core boolean")
    refined, ended = CP.refine_core(flat, flags, [])
    assert {r.node for r in refined.where("core").collect()} == {"a", "b"}
    assert (ended.first().swaps, ended.first().converged) == (1, True)


def refined_by_all_pairs(near, core, most, candidates):
    """Each swap is the least (change, rank inside, rank outside) over all pairs of candidates."""
    core, swaps = dict(core), 0
    while swaps < most:
        p = {v: sum(not core[u] for u in near[v]) for v in core}
        inside = sorted((v for v in core if core[v]), key=lambda v: (p[v], v))[:candidates]
        outside = sorted((v for v in core if not core[v]), key=lambda v: (-p[v], v))[:candidates]
        pairs = [(p[i] - (o in near[i]) - p[o], a, b) for a, i in enumerate(inside) for b, o in enumerate(outside)]
        if not pairs or min(pairs)[0] >= 0:
            return core, swaps, True
        _, a, b = min(pairs)
        core[inside[a]], core[outside[b]], swaps = False, True, swaps + 1
    return core, swaps, False


@pytest.mark.parametrize(("frontier", "nearby", "most"), [(512, 2048, 500), (3, 4, 500), (3, 0, 4)])
def test_refinement_makes_the_swaps_of_all_pairs(spark, frontier, nearby, most):
    """Four graphs at once, also with frontiers too small to decide more than a swap or two."""
    edges = random_edges(31, 26, 260, keys=4)
    flat = G.undirected(edge_frame(spark, edges), ["g"])
    near = {g: adjacency(edges, g) for g in range(4)}
    rng = random.Random(5)
    flags = [(g, v, rng.random() < 0.4) for g in near for v in sorted(near[g])]
    refined, ended = CP.refine_core(flat, spark.createDataFrame(flags, "g int, node string, core boolean"), ["g"], most, 3, frontier, nearby)
    got, told = rows(refined, "g", "node"), rows(ended, "g")
    made = 0
    for g in near:
        core, swaps, converged = refined_by_all_pairs(near[g], {v: c for k, v, c in flags if k == g}, most, 3)
        assert {v: got[(g, v)]["core"] for v in core} == core
        assert (told[g]["swaps"], told[g]["converged"]) == (swaps, converged)
        made += swaps
    assert made > 8


def test_scan_scores_match_correlation(spark):
    edges = random_edges(8, 9, 16, keys=1)
    flat = G.undirected(edge_frame(spark, edges).drop("g"), [])
    pairs = {(r.src, r.dst) for r in flat.collect()}
    nodes = sorted({v for p in pairs for v in p})
    order = spark.createDataFrame([("x", v, i + 1) for i, v in enumerate(nodes)], "o string, node string, ordinal bigint")
    out = rows(CP.scan_core_sizes(flat, order, ["o"]), "core_size")
    for k in range(2, len(nodes)):
        inside = set(nodes[:k])
        both = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :]]
        seen = [float((a, b) in pairs) for a, b in both]
        ideal = [float(a in inside or b in inside) for a, b in both]
        expected = 0.0 if len(set(ideal)) == 1 else float(np.corrcoef(seen, ideal)[0, 1])
        assert out[k]["score"] == pytest.approx(expected, abs=1e-9)


def test_core_numbers_of_long_chains(spark):
    """A chain of any length settles, beside a triangle with a tail."""
    chain = spark.range(2000).selectExpr("'g' as g", "id as src", "id + 1 as dst", "1 as weight")
    other = spark.createDataFrame([("g", a, b, 1) for a, b in [(9001, 9002), (9002, 9003), (9003, 9001), (9003, 9004), (9004, 9005)]], "g string, src long, dst long, weight int")
    cores = rows(G.core_numbers(chain.union(other), ["g"], tail_round=2), "g", "node")
    assert len(cores) == 2006
    assert {k[1]: r["core"] for k, r in cores.items() if k[1] > 9000} == {9001: 2, 9002: 2, 9003: 2, 9004: 1, 9005: 1}
    assert all(r["core"] == 1 for k, r in cores.items() if k[1] <= 2000)


def test_pagerank_says_when_it_has_not_settled(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (1, 3, 1)], "src long, dst long, weight int")
    with pytest.raises(RuntimeError, match="did not settle"):
        G.pagerank(edges, [], maximum_rounds=2)


def scattered_graph(seed):
    """Trees with cycles, tails of any length, bridges between cycles and rings."""
    rng = random.Random(seed)
    n = rng.randint(2, 30)
    edges = [(i, rng.randrange(max(0, i - rng.choice([1, 1, 2, 9])), i)) for i in range(1, n) if rng.random() < 0.93]
    edges += [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([0, 1, 2, 5]))]
    last = n
    for _ in range(rng.choice([0, 1, 2])):
        at = rng.randrange(n)
        for _ in range(rng.randint(1, 20)):
            edges.append((at, last))
            at, last = last, last + 1
        if rng.random() < 0.4:
            edges.append((at, rng.randrange(n)))
    ring = rng.choice([0, 3, 7])
    edges += [(1000 + i, 1000 + (i + 1) % ring) for i in range(ring)]
    return {(min(e), max(e)) for e in edges if e[0] != e[1]}


@pytest.mark.parametrize("tail_round", [1, 2])
def test_contracted_tails_leave_core_numbers_exact(spark, tail_round):
    edges = [(g, a, b, 1) for g in range(40) for a, b in scattered_graph(g)]
    cores = rows(G.core_numbers(spark.createDataFrame(edges, "g int, src long, dst long, weight int"), ["g"], rounds_per_cut=1, tail_round=tail_round), "g", "node")
    wanted = {(g, v): k for g in range(40) for v, k in peel(adjacency(edges, g)).items()}
    assert {at: r["core"] for at, r in cores.items()} == wanted


def test_a_cycle_with_a_long_tail_takes_few_writes(spark, monkeypatch):
    from tallyweave import session

    writes, original = [], session.cut

    def counted(df):
        writes.append(1)
        return original(df)

    monkeypatch.setattr(session, "cut", counted)
    monkeypatch.setattr(G, "cut", counted)
    edges = [(0, 1, 1), (1, 2, 1), (2, 0, 1)] + [(2 + i, 3 + i, 1) for i in range(5000)]
    cores = G.core_numbers(spark.createDataFrame(edges, "src long, dst long, weight int"), [])
    assert {r.core: r.n for r in cores.groupBy("core").agg(F.count("*").alias("n")).collect()} == {2: 3, 1: 5000}
    assert len(writes) <= 40


def test_many_node_values_are_not_broadcast(spark):
    """Written node values look small on disk; beyond the broadcast limit they must be shuffled."""
    from tallyweave.operators.sizing import BROADCAST_ROWS
    from tallyweave.session import cut

    few, many = (spark.range(n).select(F.lit(0).alias("k"), F.col("id").alias("src"), (F.col("id") + n).alias("dst"), F.lit(1).alias("weight")) for n in (50, BROADCAST_ROWS + 10))
    for edges, wide in ((few, False), (many, True)):
        arcs = G.Arcs(edges, ["k"])
        state = cut(edges.select("k", F.col("src").alias("node"), F.lit(1.0).alias("x")))
        plan = arcs.gather(state, ["x"], [F.sum("x").alias("y")])._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" not in plan) if wide else True
        assert arcs.many is wide


def test_radius_of_a_two_sided_graph_is_decided_early(spark, monkeypatch):
    """Heavy two-sided graphs swing between plus and minus the radius; bounds on both sides end the search."""
    rng = np.random.default_rng(4)
    weight = rng.integers(500, 1500, (6, 40))
    data = [(0, i, 100 + j, int(weight[i, j])) for i in range(6) for j in range(40)]
    edges = spark.createDataFrame(data, "k int, src long, dst long, weight long")
    radius = np.linalg.svd(weight.astype(float), compute_uv=False)[0]
    found = []
    rounds = G._radius_rounds(edges, ["k"], 1e-9, 40)
    for _, low, high, settled in rounds:
        found.append((low, high))
        assert low <= radius * (1 + 1e-12) and high >= radius * (1 - 1e-12)
        if settled:
            break
    assert len(found) < 40 and abs(found[-1][0] / radius - 1) < 1e-9
    calls, gather = [], G.Arcs.gather
    monkeypatch.setattr(G.Arcs, "gather", lambda self, *args, **kw: calls.append(1) or gather(self, *args, **kw))
    with pytest.raises(ValueError):
        G.katz_bonacich(edges, None, ["k"], 1.05 / radius)
    assert len(calls) < 10


def test_rounds_do_not_shuffle_arcs(spark, monkeypatch):
    """A laid-out graph keeps its partitioning: a round shuffles node values and messages to hubs, no arc and no message to others."""
    from tallyweave.session import cut

    monkeypatch.setattr(G, "TASK_ARCS", 50)  # more than one partition
    data = [(0, 1000 + i % 3, i, 1 + i % 5) for i in range(120)]
    flat = spark.createDataFrame(data, "k int, src long, dst long, weight int")
    for arcs in (G.TwoWayArcs(G.both_ways(flat, ["k"]), ["k"], 8), G.Arcs(G.both_ways(flat, ["k"]), ["k"], 8)):
        assert arcs.hubs.count() == 3 and not arcs.mixed and arcs.between is None and arcs.table.count() == 240
        arcs.many = True
        state = cut(arcs.nodes.select("k", "node", (F.col("node") * 1.0).alias("x")))
        got = arcs.gather(state, ["x"], [F.sum(F.col("weight") * F.col("x")).alias("y")])
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        expected = {}
        for _, a, b, w in data:
            expected[a] = expected.get(a, 0) + w * b
            expected[b] = expected.get(b, 0) + w * a
        assert {r.node: r.y for r in got.collect()} == expected
    plain = G.Arcs(G.both_ways(flat, ["k"]), ["k"])
    assert plain.hubs is None
    plain.many = True
    plan = plain.gather(state, ["x"], [F.sum("x").alias("y")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_hub_graphs_have_the_same_cores(spark, monkeypatch):
    """Weekly cores of graphs with hubs, arcs between others and isolated pairs, by both layouts."""
    data = [(w, a, b) for w in (0, 1) for a in range(3) for b in range(3, 40) if (a + b + w) % 2] + [(w, b, b + 1) for w in (0, 1) for b in range(10, 20)] + [(1, 90, 91)]
    events = spark.createDataFrame(data, "event_week int, actor_address int, beneficiary_address int")
    plain = rows(G.core_persistence(events, []), "node")
    monkeypatch.setattr(G, "FEW_ARCS", 0)
    monkeypatch.setattr(G, "HUB_ARCS", 6)
    assert rows(G.core_persistence(events, []), "node") == plain and len(plain) == 42


def _hub_graph(spark):
    """Two graphs of three linked hubs, many nodes around them and arcs between others."""
    rows = []
    for g, people in (("a", 60), ("b", 90)):
        for i in range(people):
            rows += [(g, f"h{h}", f"n{i:03d}", float(1 + (i * (h + 3)) % 7)) for h in range(3) if (i + h) % 3 or i % 5 == 0]
        rows += [(g, f"n{i:03d}", f"n{i + 1:03d}", 2.0) for i in range(0, people - 1, 4)]
        rows += [(g, "h0", "h1", 3.0), (g, "h1", "h2", 1.0)]
    return spark.createDataFrame(rows, "g string, src string, dst string, weight double").where("src <> dst")


@pytest.mark.parametrize("links", [True, False])
def test_array_sums_over_hubs_are_the_plain_sums(spark, monkeypatch, links):
    """Whole arrays added up in tasks, several chunks a batch, are what the sums of each element are; nulls count as zero."""
    flat = _hub_graph(spark)
    flat = flat if links else flat.where("src LIKE 'h%' AND dst LIKE 'n%'")
    arcs = G.TwoWayArcs(G.both_ways(flat, ["g"]), ["g"], cell_rows=10)
    assert arcs.hubs.count() == 6 and arcs.mixed == links and (arcs.between is not None) == links
    one = F.when((F.col("g") == "b"), F.crc32("node") % 97 / 8.0)
    state = G.cut(arcs.nodes.select("g", "node", F.array(F.crc32("node") % 89 / 4.0, one).alias("c")))
    monkeypatch.setattr(G, "CHUNK_ARCS", 5)
    got = rows(arcs.gather_array(state, "c", 2, "m"), "g", "node")
    want = rows(arcs.gather(state, ["c"], [F.sum(F.col("weight") * F.col("c")[i]).alias(f"m{i}") for i in range(2)]), "g", "node")
    assert len(got) == len(want) == 156
    for key, row in want.items():
        assert got[key]["m"] == [row["m0"], row["m1"] or 0.0]


def test_continuous_fits_in_blocks_match_whole_graphs(spark):
    """Blocks of eight nodes and hubs give the fits and coreness of graphs sorted whole, ties of equal nodes included."""
    flat = _hub_graph(spark)
    d = CP.degrees(flat, ["g"])
    starts = CP.cut(d.select("g", "node", F.col("degree").alias("s0"), F.col("weighted_degree").alias("s1"), F.lit(1.0).alias("s2"), (-F.col("degree")).alias("s3")))
    whole, blocks = (CP.fit_rombach(flat, starts, ["g"], alphas=(0.5,), betas=(0.8,), **more) for more in ({}, {"cell_rows": 10, "block": 8}))
    a, b = rows(whole[0], "g", "node"), rows(blocks[0], "g", "node")
    assert len(a) == 156 and a.keys() == b.keys()
    assert all(abs(a[k]["rombach_coreness"] - b[k]["rombach_coreness"]) < 1e-9 for k in a)
    f, h = rows(whole[1], "g"), rows(blocks[1], "g")
    assert all(f[k]["rounds"] == h[k]["rounds"] and abs(f[k]["raw_quality"] - h[k]["raw_quality"]) < 1e-12 for k in f)


def test_template_values_of_tasks_are_those_of_columns(spark):
    n = np.repeat([1.0, 2.0, 7.0, 160.0], 9)
    cases = [(float(r), float(k), a, b) for k in set(n) for r in range(1, int(k) + 1) for a in CP.ALPHAS for b in CP.BETAS]
    df = spark.createDataFrame(cases, "r double, n double, a double, b double")
    got = df.select("*", CP.rombach_template(F.col("r"), F.col("n"), F.col("a"), F.col("b")).alias("v")).toPandas()
    assert (CP.template_values(*(got[c].to_numpy() for c in "rnab")) == got["v"].to_numpy()).all()


def test_queries_run_no_step_that_they_do_not_return(spark, monkeypatch):
    """Candidates need no swaps and no PageRank, and the binary core no weekly cores."""
    from tallyweave.catalog import load

    def never(*_, **__):
        raise AssertionError("not needed")


    queries = load()[0]
    monkeypatch.setattr(CP, "refine_core", never)
    monkeypatch.setattr(CP, "pagerank", never)
    monkeypatch.setattr(G, "pagerank", never)
    assert queries["g13_candidate_scores"](spark, "/root/testdata/sf0.001").count() == 6
    small = spark.createDataFrame([(i % 2, i % 7, 10 + i % 5, 0) for i in range(60)], "chain_id int, actor_address int, beneficiary_address int, event_week int")
    coreness = spark.createDataFrame([(0, 0, 1.0)], "chain_id int, node int, rombach_coreness double")
    monkeypatch.setattr(CP, "core_persistence", never)
    monkeypatch.setattr(CP, "pagerank", lambda edges, by: G.nodes_of(edges, by).select(*by, "node", F.col("in_strength").cast("double").alias("pagerank")))
    monkeypatch.setattr(CP, "fit_rombach", lambda *_, **__: (coreness, coreness))
    monkeypatch.setattr(CP, "fit_borgatti_everett", lambda *_, **__: (coreness, coreness.limit(1), coreness))
    assert CP.binary_summary(small, ["chain_id"]).count() == 1
