"""Graph measures as iterative DataFrame jobs over many graphs at once.

A graph is rows ``(by..., src, dst, weight)``; ``by`` is the graph key, so weeks, layers and
chains are solved together. Every loop cuts lineage with a reliable checkpoint per round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.sizing import BROADCAST_ROWS, shuffled, small_side
from tallyweave.session import cut, cut_observed, discard, pin, shuffle_width

HUBS = 100_000  # most sources whose values are broadcast
HUB_ARCS = 64  # a source with no more arcs is never a hub
FEW_ARCS = 500_000  # up to here, all arcs lie with their source
TASK_ARCS = 50_000  # below shuffle-width times this, a graph uses fewer tasks
CHUNK_ARCS = 4_096  # arcs whose messages a task holds at once, where they are added up as arrays
_ALL = "_graph"


def role_edges(events: DataFrame, by: list[str], actor: str = "actor_address", beneficiary: str = "beneficiary_address") -> DataFrame:
    """Actor to beneficiary edges without self-directed events, weighted by event count."""
    return (
        events.where(F.col(actor) != F.col(beneficiary))
        .groupBy(*by, F.col(actor).alias("src"), F.col(beneficiary).alias("dst"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def self_directed(events: DataFrame, by: list[str], actor: str = "actor_address", beneficiary: str = "beneficiary_address") -> DataFrame:
    same = F.col(actor) == F.col(beneficiary)
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg(same.cast("int")).alias("self_directed_event_share"),
        F.count_if(~same).alias("delegated_event_count"),
    )


def undirected(edges: DataFrame, by: list[str]) -> DataFrame:
    """Weighted undirected projection with ``src < dst``."""
    return (
        edges.where(F.col("src") != F.col("dst"))
        .groupBy(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(F.sum("weight").alias("weight"))
    )


def both_ways(edges: DataFrame, by: list[str]) -> DataFrame:
    """Each undirected edge as two arcs, in one pass over the edges."""
    ends = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return edges.select(*by, F.explode(ends).alias("_e"), "weight").select(*by, F.col("_e.a").alias("src"), F.col("_e.b").alias("dst"), "weight")


def nodes_of(edges: DataFrame, by: list[str]) -> DataFrame:
    """Distinct endpoints with out and in strength."""
    zero = F.lit(0).cast(edges.schema["weight"].dataType)
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.col("weight").alias("o"), zero.alias("i")),
        F.struct(F.col("dst").alias("node"), zero.alias("o"), F.col("weight").alias("i")),
    )
    return (
        edges.select(*by, F.explode(ends).alias("_e"))
        .groupBy(*by, F.col("_e.node").alias("node"))
        .agg(F.sum("_e.o").alias("out_strength"), F.sum("_e.i").alias("in_strength"))
    )


class Arcs:
    """Arcs laid out once for repeated message passing.

    Arcs are kept as one row per node with an array of arcs, hash-partitioned by that node and checkpointed with
    that layout, so a round only shuffles node values and messages, never the arcs. Rows are kept in
    order, so a join with node values sorts these values only.

    Every arc lies with the end that has fewer arcs, as far as that pays: sources with more than ``total / HUBS`` arcs
    are hubs, of which there can be at most ``HUBS``. Their values are broadcast and their arcs lie with
    the target, so all that hubs send to a node is summed up in one task. Arcs of other sources lie with the source,
    and what they send to a hub is summed up per task. If no arc joins two nodes that are no hubs, messages to
    these are not shuffled at all. Graphs with few arcs have no hubs, unless ``cell_rows`` names the most
    arcs of a source that is none. An array holds at most ``max(cell_rows, total / HUBS)`` or ``HUBS`` arcs.
    """

    symmetric = False

    def __init__(self, arcs: DataFrame, by: list[str], cell_rows: int | None = None):
        self.by = by
        arcs = arcs if getattr(arcs, "_cut_path", None) else cut(arcs.select(*by, "src", "dst", "weight"))
        degree = cut(arcs.groupBy(*by, "src").agg(F.count(F.lit(1)).alias("_degree")))
        total, nodes = (x or 0 for x in degree.agg(F.sum("_degree"), F.count(F.lit(1))).first())
        self.many = nodes > BROADCAST_ROWS
        self.nodes = degree.select(*by, F.col("src").alias("node"), F.col("_degree").alias("degree"))
        self.width = max(1, min(shuffle_width(arcs.sparkSession), -(-total // TASK_ARCS)))
        self.keys = [*by, "src"]
        self.hubs, self.inward, self.between, self.mixed = None, None, None, True
        most = max(cell_rows or HUB_ARCS, total // HUBS)
        if cell_rows or total > FEW_ARCS:
            # hubs are numbered, so tasks find a hub's values by its place; they are few enough for one window
            hubs = cut(degree.where(F.col("_degree") > most).select(*by, "src", (F.row_number().over(Window.orderBy(*by, "src")) - 1).alias("_no")))
            self.hubs = hubs if hubs.limit(1).count() else None
        if self.hubs is None:
            self.outward = self._laid(arcs, "src", "dst")
            return
        for end in ("src", "dst"):
            named = self.hubs.select(*by, F.col("src").alias(end), F.col("_no").alias(f"_{end}"))
            arcs = arcs.join(F.broadcast(named), [*by, end], "left")
        self.outward = self._laid(arcs.where("_src IS NULL"), "src", "dst", F.col("_dst").alias("_hub"))
        if self.symmetric:
            self.inward = self.outward.select(*by, F.col("src").alias("dst"), F.expr("transform(filter(_arcs, a -> a._hub IS NOT NULL), a -> named_struct('src', a.dst, 'weight', a.weight))").alias("_arcs"))
        else:
            self.inward = self._laid(arcs.where("_src IS NOT NULL AND _dst IS NULL"), "dst", "src")
        between = cut(arcs.where("_src IS NOT NULL AND _dst IS NOT NULL").select(*by, "src", "dst", "weight"))
        self.between = between if between.limit(1).count() else None
        self.mixed = arcs.where("_src IS NULL AND _dst IS NULL").limit(1).count() > 0

    def _laid(self, arcs: DataFrame, own: str, other: str, *more: Column) -> DataFrame:
        """One row per node ``own`` with its arcs in order, so that equal nodes get equal sums; partitioned and sorted by it."""
        at = [*self.by, own]
        packed = arcs.repartition(self.width, *at).groupBy(*at).agg(F.sort_array(F.collect_list(F.struct(other, "weight", *more))).alias("_arcs"))
        return pin(packed.sortWithinPartitions(*at), laid=True)

    def _unpacked(self, laid: DataFrame, *named: Column | str) -> DataFrame:
        """One row per arc again."""
        rows = laid.select(*named, F.explode("_arcs").alias("_e"))
        return rows.select(*[c for c in rows.columns if c != "_e"], "_e.*")

    @property
    def table(self) -> DataFrame:
        """All arcs, one a row."""
        columns = [*self.by, "src", "dst", "weight"]
        out = self._unpacked(self.outward, *self.keys).select(*columns)
        if self.inward is not None:
            out = out.unionByName(self._unpacked(self.inward, *self.by, "dst").select(*columns))
        return out if self.between is None else out.unionByName(self.between)

    def apart(self, values: DataFrame) -> DataFrame:
        """Node values that are to be shuffled if the nodes are many: their written size would have them broadcast."""
        return shuffled(values) if self.many else values

    def gather(
        self, state: DataFrame, sends: list[str], aggregates: list[Column], extra: list[str | Column] = (), lanes: list[str] = (),
        finish: Callable[[DataFrame], DataFrame] = lambda received: received,
    ) -> DataFrame:
        """Send ``sends`` from every node along its arcs and aggregate at the targets.

        ``extra`` are further grouping columns at the target; ``lanes`` are state columns that
        keep parallel problems on the same graph apart. ``finish`` is applied to what the targets have received,
        grouped further by target at most, before parts of the targets are put together. ``state`` is read several times, so it should
        be a written table.
        """
        side = state.select(*self.by, *lanes, F.col("node").alias("src"), *sends)
        carried = [*self.by, *lanes, *sends, "dst", "weight"]

        def received(rows: DataFrame) -> DataFrame:
            return finish(rows.groupBy(*self.by, *lanes, F.col("dst").alias("node"), *extra).agg(*aggregates))

        sent = self._unpacked(self.outward.join(self.apart(side), self.keys), *self.by, *lanes, *sends).select(*carried)
        if self.hubs is None:
            return received(sent)
        loud = F.broadcast(side.join(F.broadcast(self.hubs), self.keys))
        taken = self._unpacked(self.inward, *self.by, "dst").join(loud, self.keys).select(*carried)
        if self.between is not None:
            sent = sent.unionByName(self.between.join(loud, self.keys).select(*carried))
        if self.mixed:
            return received(sent.unionByName(taken))
        return received(taken).unionByName(received(sent))


class TwoWayArcs(Arcs):
    """Arcs given in both directions with equal weights: one layout serves what hubs send and what they receive."""

    symmetric = True

    def gather_array(self, state: DataFrame, column: str, size: int, name: str) -> DataFrame:
        """Weighted sums of an array column of ``size`` doubles at the targets; null elements count as zero.

        As :meth:`gather`, but tasks add up whole arrays where an arc has a hub at one end: a node takes the
        values of its hubs from the broadcast ones, and a task sends one sum for every hub that it has arcs to.
        """
        at = [*self.by, "node"]

        def sums(of: str) -> Column:
            return F.expr("array(" + ", ".join(of.format(i=i) for i in range(size)) + ")").alias(name)

        weighted = sums(f"sum(weight * {column}[{{i}}])")
        if self.hubs is None:
            return self.gather(state, [column], [weighted])
        side = state.select(*self.by, F.col("node").alias("src"), column)
        loud = cut(side.join(F.broadcast(self.hubs), self.keys))
        values = np.zeros((self.hubs.count(), size))
        for row in loud.select("_no", column).collect():
            values[row[0]] = [x or 0.0 for x in row[1]]
        sent = state.sparkSession.sparkContext.broadcast(values)

        def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                starts, hub, weight = _flat_arcs(batch.column("_arcs"))
                out = np.zeros((batch.num_rows, size))
                for rows, arcs, firsts, some in _chunks(starts):
                    out[rows][some] = np.add.reduceat(sent.value[hub[arcs]] * weight[arcs, None], firsts)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], array_lists(out)], names=[*at, name])

        def push(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, met = np.zeros(sent.value.shape), np.zeros(len(sent.value), bool)
            for batch in batches:
                starts, hub, weight = _flat_arcs(batch.column("_arcs"))
                own = np.nan_to_num(list_values(batch.column(column), size))
                source = np.repeat(np.arange(batch.num_rows), np.diff(starts))
                order = np.argsort(hub, kind="stable")
                for begin in range(0, len(order), CHUNK_ARCS):
                    arcs = order[begin : begin + CHUNK_ARCS]
                    targets, firsts = np.unique(hub[arcs], return_index=True)
                    total[targets] += np.add.reduceat(own[source[arcs]] * weight[arcs, None], firsts)
                    met[targets] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(met)), array_lists(total[met])], names=["_no", name])

        kind = {f.name: f.dataType.simpleString() for f in self.nodes.schema}
        schema = ", ".join(f"{c} {kind[c]}" for c in at) + f", {name} array<double>"
        pulled = self.outward.select(*self.by, F.col("src").alias("node"), "_arcs").mapInArrow(pull, schema)
        pushed = self.outward.join(self.apart(side), self.keys).select("_arcs", column).mapInArrow(push, f"_no bigint, {name} array<double>")
        pushed = pushed.join(F.broadcast(self.hubs), "_no").select(*self.by, F.col("src").alias("node"), name)
        if self.between is not None:
            pushed = pushed.unionByName(self.between.join(F.broadcast(loud), self.keys).groupBy(*self.by, F.col("dst").alias("node")).agg(weighted))
        added = sums(f"sum({name}[{{i}}])")
        if self.mixed:
            rows = self._unpacked(self.outward.join(self.apart(side), self.keys), *self.by, column).where("_hub IS NULL")
            return pulled.unionByName(pushed).unionByName(rows.groupBy(*self.by, F.col("dst").alias("node")).agg(weighted)).groupBy(*at).agg(added)
        return pulled.unionByName(pushed.groupBy(*at).agg(added))


def _flat_arcs(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the rows, hub numbers and weights of all arcs of a batch; arcs without a hub weigh nothing."""
    starts, arcs = lists.offsets.to_numpy(), lists.flatten()
    hub, weight = arcs.field("_hub"), arcs.field("weight").to_numpy(zero_copy_only=False).astype("float64")
    if hub.null_count:
        weight = np.where(hub.is_null().to_numpy(zero_copy_only=False), 0.0, weight)
        hub = hub.fill_null(0)
    return starts - starts[0], hub.to_numpy(zero_copy_only=False), weight


def _chunks(starts: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """Consecutive rows of at most :data:`CHUNK_ARCS` arcs (one row at least), without those that have none.

    A chunk is its rows, its arcs, the first arc of every row that has any, counted from the chunk's first, and which rows have any.
    """
    row = 0
    while row < len(starts) - 1:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + CHUNK_ARCS, "right")) - 1)
        some = np.diff(starts[row : end + 1]) > 0
        if some.any():
            yield slice(row, end), slice(int(starts[row]), int(starts[end])), starts[row:end][some] - starts[row], some
        row = end


def array_lists(values: np.ndarray) -> pa.ListArray:
    """A list column with one row of ``values`` each, null where a value is no number."""
    rows, size = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * size), pa.array(values.ravel(), from_pandas=True))


def list_values(lists: pa.ListArray, size: int) -> np.ndarray:
    """Rows of a list column as doubles, ``size`` of them a row; nulls are no numbers, and so is a row that is null."""
    out = np.full((len(lists), size), np.nan)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, size)
    out[lists.is_valid().to_numpy(zero_copy_only=False)] = values
    return out


def _keyed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def _unkeyed(df: DataFrame, by: list[str]) -> DataFrame:
    return df if by else df.drop(_ALL)


def components(edges: DataFrame, by: list[str], nodes: DataFrame | None = None) -> DataFrame:
    """Weakly connected components labelled by their smallest node.

    Each round takes the grandparent label, the smallest label among neighbours, and hooks
    whole trees onto smaller roots, so the number of rounds grows with the logarithm of the
    graph. Labels only fall, and a round without a change is the answer. A round is one write,
    which also tells whether a label changed and about how many labels are left. The giant component's
    label is a hot key of the look-up by label: labels are looked up once per label and then
    broadcast to the nodes once they are few, else joined with adaptive splitting.
    """
    edges, keys = _keyed(edges, by)
    plain = edges.where(F.col("src") != F.col("dst")).select(*keys, "src", "dst", F.lit(1).alias("weight"))
    arcs = TwoWayArcs(both_ways(plain, keys).distinct(), keys)
    start = arcs.nodes.select(*keys, "node")
    if nodes is not None:
        extra, _ = _keyed(nodes, by)
        start = start.union(extra.select(*keys, "node")).distinct()
    labels = F.approx_count_distinct(F.struct(*keys, "label"))
    state, facts = cut_observed(start.withColumn("label", F.col("node")), labels=labels)
    while True:
        own = state.select(*keys, "label").distinct()  # one row per label: partial sums leave no hot key
        parents = own.join(arcs.apart(state.select(*keys, F.col("node").alias("label"), F.col("label").alias("_up"))), [*keys, "label"])
        few = facts["labels"] * 5 <= BROADCAST_ROWS * 4  # the count is an estimate, within a few per cent
        parents = F.broadcast(parents) if few else shuffled(parents)
        lifted = state.join(parents, [*keys, "label"])
        near = arcs.gather(lifted, ["_up"], [F.min("_up").alias("_near")])
        seen = lifted.join(near, [*keys, "node"], "left")
        hooks = seen.groupBy(*keys, F.col("label").alias("node")).agg(F.min("_near").alias("_hook"))
        merged = seen.join(hooks, [*keys, "node"], "left")
        lowest = F.least("label", "_up", F.coalesce("_near", "label"), F.coalesce("_hook", "label"))
        moved = merged.select(*keys, "node", lowest.alias("label"), (lowest != F.col("label")).alias("_changed"))
        new, facts = cut_observed(moved, changed=F.max("_changed"), labels=labels)
        discard(state)
        if not facts["changed"]:
            return _unkeyed(new.select(*keys, "node", F.col("label").alias("component")), by)
        state = new


def component_sizes(labels: DataFrame, by: list[str]) -> DataFrame:
    """Node count, component count and share of the largest component per graph."""
    sizes = labels.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy(*by).agg(
        F.sum("size").alias("node_count"),
        F.count(F.lit(1)).alias("component_count"),
        F.max("size").alias("largest_component"),
        (F.max("size") / F.sum("size")).alias("largest_component_share"),
    )


def core_numbers(edges: DataFrame, by: list[str], rounds_per_cut: int = 2, tail_round: int = 6, flat: bool = False) -> DataFrame:
    """k-core number of every node of the unweighted undirected graph.

    Starting from degrees, each node takes the h-index of its neighbours' values until
    nothing changes; the fixed point is the core number. A node sees its neighbours as counts
    per value: distinct values at a node number at most twice the square root of the edges,
    so a hub is never collected into one group.

    Values travel one arc per pass, so a long tail would settle slowly. After every ``tail_round``
    rounds, nodes of value two that hang on by trees are found by contraction (:func:`tails`)
    and take their core number, one, at once. There is no limit on the rounds. ``flat`` edges are
    undirected and distinct already, without edges of a node to itself.
    """
    edges, keys = _keyed(edges, by)
    arcs = TwoWayArcs(both_ways(edges.select(*keys, "src", "dst", F.lit(1).alias("weight")) if flat else undirected(edges, keys), keys), keys)
    falling = Window.partitionBy(*keys, "node").orderBy(F.col("core").desc()).rowsBetween(Window.unboundedPreceding, 0)

    def settle(counted: DataFrame) -> DataFrame:
        reach = counted.withColumn("_reach", F.sum("_n").over(falling))
        return reach.groupBy(*keys, "node").agg(F.max(F.least("core", "_reach")).alias("core"))

    def step(state: DataFrame) -> DataFrame:
        return arcs.gather(state, ["core"], [F.count(F.lit(1)).alias("_n")], extra=["core"], finish=settle)

    state = cut(arcs.nodes.select(*keys, "node", F.col("degree").alias("core")))
    sums = None
    for round_ in count(1):
        before = state
        if arcs.hubs is None:
            for _ in range(rounds_per_cut):
                state = step(state)
            moved = state.join(arcs.apart(before.withColumnRenamed("core", "_was")), [*keys, "node"])
            state, facts = cut_observed(moved, fell=F.max(F.col("core") < F.col("_was")), twos=F.max(F.col("core") == 2))
            state = _kept_path(state, state.drop("_was"))
            fell = facts["fell"]
        else:  # with hubs a state is read several times, so every round is written; values only fall, so their sum tells
            state, facts = cut_observed(step(state), twos=F.max(F.col("core") == 2))
            was, sums = sums, state.agg(F.sum("core")).first()[0]
            fell = sums != was
        discard(before)
        if not fell:
            return _unkeyed(state, by)
        if round_ % tail_round == 0 and facts["twos"]:
            hanging = tails(arcs, state)
            one = F.when(F.col("_tail").isNotNull(), 1).otherwise(F.col("core")).alias("core")
            new = cut(state.join(arcs.apart(hanging.withColumn("_tail", F.lit(True))), [*keys, "node"], "left").select(*keys, "node", one))
            discard(state)
            state = new


def _kept_path(table: DataFrame, view: DataFrame) -> DataFrame:
    """``view`` of a written table, which :func:`discard` can still delete."""
    view._cut_path = table._cut_path
    return view


def tails(arcs: Arcs, state: DataFrame) -> DataFrame:
    """Nodes of value two that lie on no cycle and on no path between cycles or higher nodes.

    Only nodes of value two and their arcs to values of two or more take part; higher nodes count
    as fixed, which can hide a tail but can't make one. A phase removes all nodes with one
    neighbour or none and all chains of nodes with two neighbours at once. A chain's two ends come
    from doubled pointers: one pointer per direction of each chain node, which after k doublings
    looks 2^k nodes ahead, so a chain takes the logarithm of its length. Pointers that no doubling
    finishes run round a cycle. A chain that ends at a removed node goes with it; any other becomes
    an arc between its ends. Nodes with parallel arcs or an arc to themselves lie on a cycle and are
    held. Phases end when no node has fewer than two neighbours; each halves the branches of a tree
    at least. Chains that were made arcs go later if one of their ends has gone.
    """
    keys, at = arcs.by, [*arcs.by, "node"]
    two = cut(state.where("core = 2").select(*at))
    reachable = state.where("core >= 2").select(*keys, F.col("node").alias("dst"), (F.col("core") > 2).alias("fixed"))
    side = arcs.table.join(two.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi").join(reachable, [*keys, "dst"])
    links = cut(side.select(*keys, F.col("src").alias("node"), F.col("dst").alias("to"), "fixed"))
    nodes = two.withColumn("held", F.lit(False))
    gone, chains = [], []
    while True:
        degrees = links.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
        kind = F.when(F.col("held"), "branch").when(F.coalesce("_n", F.lit(0)) < 2, "leaf").when(F.col("_n") == 2, "chain").otherwise("branch")
        kinds, facts = cut_observed(nodes.join(degrees, at, "left").select(*at, "held", kind.alias("kind")), leaf=F.max(F.col("kind") == "leaf"))
        if not facts["leaf"]:
            break
        ends = _chain_ends(links, kinds, keys)
        of_chain = ends.groupBy(*at).agg(F.max(F.coalesce(F.col("end_kind") == "leaf", F.lit(False))).alias("lost"), F.min("end").alias("a"), F.max("end").alias("b"))
        of_chain = cut(of_chain)
        gone.append(kinds.where("kind = 'leaf'").select(*at).unionByName(of_chain.where("lost").select(*at)))
        chains.append(of_chain.where("NOT lost AND a IS NOT NULL").select(*at, "a", "b"))
        # arcs of branches: to branches and fixed nodes as before, and over chains that are not lost
        branch = kinds.where("kind = 'branch'").select(*at)
        inner = kinds.where("kind <> 'branch'").select(*keys, F.col("node").alias("to"))
        old = links.join(branch, at, "left_semi").join(inner, [*keys, "to"], "left_anti").select(*at, "to", "fixed")
        over = ends.where("start_kind = 'branch' AND end_kind IN ('branch', 'fixed')")
        over = over.select(*keys, F.col("came").alias("node"), F.col("end").alias("to"), (F.col("end_kind") == "fixed").alias("fixed"))
        made = cut(old.unionByName(over).groupBy(*at, "to", "fixed").agg(F.count(F.lit(1)).alias("_n")))
        rings = made.groupBy(*at).agg(F.max((F.col("_n") > 1) | (F.col("to") == F.col("node"))).alias("_ring"))
        held = F.col("held") | F.coalesce("_ring", F.lit(False))
        nodes = cut(kinds.where("kind = 'branch'").join(rings, at, "left").select(*at, held.alias("held")))
        links = made.where(F.col("to") != F.col("node")).select(*at, "to", "fixed")
    lost = two.limit(0)
    for removed, chain in zip(reversed(gone), reversed(chains), strict=True):
        for end in ("a", "b"):
            named = lost.withColumnRenamed("node", end).withColumn(f"_{end}", F.lit(True))
            chain = chain.join(named, [*keys, end], "left")
        lost = cut(lost.unionByName(removed).unionByName(chain.where("_a OR _b").select(*at)))
    return lost


def _chain_ends(links: DataFrame, kinds: DataFrame, keys: list[str]) -> DataFrame:
    """Both directions of every chain node: ``came`` (its neighbour behind) and the ``end`` ahead with its kind.

    ``start_kind`` is the kind of the neighbour behind. Without an end the chain is a ring.
    """
    at = [*keys, "node"]
    own = links.join(kinds.where("kind = 'chain'").select(*at), at, "left_semi")
    pairs = own.groupBy(*at).agg(F.min(F.struct("to", "fixed")).alias("x"), F.max(F.struct("to", "fixed")).alias("y"))
    both = F.explode(F.array(F.struct(F.col("x").alias("came"), F.col("y").alias("to")), F.struct(F.col("y").alias("came"), F.col("x").alias("to"))))
    darts = pairs.select(*at, both.alias("_d")).select(
        *at, F.col("_d.came.to").alias("came"), F.col("_d.came.fixed").alias("_came_fixed"), F.col("_d.to.to").alias("to"), F.col("_d.to.fixed").alias("_to_fixed"),
    )
    ahead = kinds.select(*keys, F.col("node").alias("to"), F.col("kind").alias("_ahead"))
    behind = kinds.select(*keys, F.col("node").alias("came"), F.col("kind").alias("_behind"))
    darts = darts.join(ahead, [*keys, "to"], "left").join(behind, [*keys, "came"], "left")
    ahead_kind = F.when(F.col("_to_fixed"), "fixed").otherwise(F.col("_ahead"))
    behind_kind = F.when(F.col("_came_fixed"), "fixed").otherwise(F.col("_behind"))
    done = ahead_kind != "chain"
    first = darts.select(
        *at, "came", behind_kind.alias("start_kind"), F.when(done, F.col("to")).alias("end"), F.when(done, ahead_kind).alias("end_kind"),
        F.when(~done, F.col("to")).alias("next"), F.when(~done, F.col("node")).alias("next_came"),
    )
    table, facts = cut_observed(first, open=F.count_if(F.col("end").isNull()))
    left = None
    while facts["open"] and facts["open"] != left:
        left = facts["open"]
        after = table.select(
            *keys, F.col("node").alias("next"), F.col("came").alias("next_came"), F.col("end").alias("_end"), F.col("end_kind").alias("_kind"),
            F.col("next").alias("_next"), F.col("next_came").alias("_next_came"),
        )
        joined = table.join(after, [*keys, "next", "next_came"], "left")
        moved = joined.select(
            *at, "came", "start_kind", F.coalesce("end", "_end").alias("end"), F.coalesce("end_kind", "_kind").alias("end_kind"),
            F.col("_next").alias("next"), F.col("_next_came").alias("next_came"),
        )
        new, facts = cut_observed(moved, open=F.count_if(F.col("end").isNull()))
        discard(table)
        table = new
    return table


def pagerank(edges: DataFrame, by: list[str], alpha: float = 0.85, maximum_rounds: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """Weighted PageRank: uniform start, dangling mass spread over all nodes of the graph, and
    each graph stops at the first round whose L1 change is below nodes * tolerance. It fails if
    one hasn't after ``maximum_rounds``.

    A round is one write. It sums up each graph's change of the round before, leaves graphs that
    have settled as they are, and tells whether any was still open.
    """
    edges, keys = _keyed(edges, by)
    edges = cut(edges.select(*keys, "src", "dst", F.col("weight").cast("double").alias("weight")))
    arcs = Arcs(edges, keys)
    nodes = nodes_of(edges, keys).select(*keys, "node", F.col("out_strength").alias("_out"))
    counts = cut(nodes.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_count")))
    few = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    state = nodes.join(F.broadcast(counts) if few else counts, keys)
    state = cut(state.select(*keys, "node", "_out", (F.lit(1.0) / F.col("_count")).alias("rank"), F.lit(None).cast("double").alias("_delta")))
    for _ in range(maximum_rounds + 1):
        # one row per graph: size, change in the last round (none before the first), and its dangling mass
        dangling = F.sum(F.when(F.col("_out") > 0, 0.0).otherwise(F.col("rank")))
        facts = state.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_count"), F.sum("_delta").alias("_change"), dangling.alias("_dangling"))
        facts = facts.withColumn("_live", F.coalesce(F.col("_change") >= F.col("_count") * F.lit(tolerance), F.lit(True))).drop("_change")
        known = state.join(F.broadcast(facts) if few else facts, keys)
        sending = known.where("_live AND _out > 0").withColumn("_send", F.col("rank") / F.col("_out"))
        inflow = arcs.gather(sending, ["_send"], [F.sum(F.col("weight") * F.col("_send")).alias("_in")])
        base = F.lit(1.0 - alpha) / F.col("_count") + F.lit(alpha) * F.col("_dangling") / F.col("_count")
        updated = F.when(F.col("_live"), base + F.lit(alpha) * F.coalesce("_in", F.lit(0.0))).otherwise(F.col("rank"))
        joined = known.join(inflow, [*keys, "node"], "left")
        new, seen = cut_observed(joined.select(*keys, "node", "_out", updated.alias("rank"), F.abs(updated - F.col("rank")).alias("_delta"), "_live"), live=F.max("_live"))
        discard(state)
        state = _kept_path(new, new.drop("_live"))
        if not seen["live"]:
            return _unkeyed(state.select(*keys, "node", F.col("rank").alias("pagerank")), by)
    raise RuntimeError(f"pagerank did not settle in {maximum_rounds} rounds")


def reciprocity(edges: DataFrame, by: list[str]) -> DataFrame:
    """Share of directed edges whose reverse exists: two directions under one unordered key."""
    pair = [F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")]
    pairs = edges.where(F.col("src") != F.col("dst")).groupBy(*by, *pair).agg(F.count(F.lit(1)).alias("_n"))
    mutual = F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(F.lit(0)))
    return pairs.groupBy(*by).agg((mutual / F.sum("_n")).alias("directed_reciprocity"))


def _hhi(column: str) -> Column:
    value = F.col(column).cast("double")
    total = F.sum(value)
    return F.when(total > 0, F.sum(value * value) / (total * total)).otherwise(F.lit(0.0))


def topology(edges: DataFrame, by: list[str]) -> DataFrame:
    """Structural row per graph from its directed weighted edges."""
    edges = cut(edges)
    strengths = nodes_of(edges, by)
    base = strengths.groupBy(*by).agg(
        F.count(F.lit(1)).alias("topology_node_count"),
        _hhi("out_strength").alias("weighted_out_degree_hhi"),
        _hhi("in_strength").alias("weighted_in_degree_hhi"),
    )
    size = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("topology_edge_count"))
    ranks = pagerank(edges, by).groupBy(*by).agg(_hhi("pagerank").alias("pagerank_hhi"), F.max("pagerank").alias("maximum_pagerank_share"))
    parts = component_sizes(components(edges, by), by).select(*by, F.col("largest_component_share").alias("largest_weak_component_share"))
    cores = core_share(core_numbers(edges, by), by)
    out = base
    for part in (size, reciprocity(edges, by), ranks, parts, cores):
        out = out.join(part, by, "left")
    return out


def core_share(cores: DataFrame, by: list[str]) -> DataFrame:
    """Maximum core and the share of nodes in it."""
    shells = cores.groupBy(*by, "core").agg(F.count(F.lit(1)).alias("_n"))
    return shells.groupBy(*by).agg(
        F.max("core").alias("maximum_k_core"), (F.max_by("_n", "core") / F.sum("_n")).alias("maximum_core_node_share")
    )


def topology_panel(events: DataFrame, by: list[str], actions: str = "action") -> DataFrame:
    """Topology of all actions and of each action layer, every layer solved in the same jobs.

    Events are reduced to per-action edges before they are repeated for the all-actions layer.
    """
    layered = [*by, "layer"]
    per_action = role_edges(events, [*by, actions])
    layers = F.explode(F.array(F.lit("all_actions"), F.col(actions)))
    edges = per_action.withColumn("layer", layers).groupBy(*layered, "src", "dst").agg(F.sum("weight").alias("weight"))
    counts = self_directed(events, [*by, actions]).withColumn("layer", layers)
    events_weight = F.col("self_directed_event_share") * F.col("event_count")
    totals = counts.groupBy(*layered).agg(
        F.sum("event_count").alias("event_count"),
        (F.sum(events_weight) / F.sum("event_count")).alias("self_directed_event_share"),
        F.sum("delegated_event_count").alias("delegated_event_count"),
    )
    out = totals.join(topology(edges, layered), layered, "left")
    measures = [f for f in out.schema.fields if f.name not in layered]
    filled = {f.name: F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)) for f in measures}
    return out.withColumns(filled).withColumns(
        {"observed_unit": F.lit("address_role"), "interpretation_status": F.lit("descriptive_noncausal")}
    )


def snapshot_metrics(transfers: DataFrame, by: list[str], src: str = "from_entity", dst: str = "to_entity", value: str = "value") -> DataFrame:
    """Snapshot row per graph. A self-loop keeps its node and counts twice in activity."""
    from tallyweave.operators.concentration import concentration_of_units

    flows = cut(transfers.groupBy(*by, F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.sum(value).cast("double").alias("weight")))
    nodes = nodes_of(flows, by).withColumn("weight", F.col("out_strength") + F.col("in_strength"))
    links = flows.where(F.col("src") != F.col("dst"))
    activity = concentration_of_units(nodes, by, top=(), gini=True, real=True).select(
        *by,
        F.col("units").alias("active_nodes"),
        F.col("hhi").alias("activity_hhi"),
        F.col("inverse_hhi").alias("effective_entities"),
        F.col("gini").alias("activity_gini"),
    )
    value_sum = flows.groupBy(*by).agg(F.sum("weight").alias("total_value"))
    edge_count = links.groupBy(*by).agg(F.count(F.lit(1)).alias("edge_count"))
    giant = component_sizes(components(links, by, nodes=nodes.select(*by, "node")), by).select(
        *by, F.col("largest_component_share").alias("giant_component_ratio")
    )
    cores = core_numbers(links, by)
    top = cores.groupBy(*by, "core").agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.max_by("_n", "core").alias("_top"))
    out = activity
    for part in (value_sum, edge_count, giant, top):
        out = out.join(part, by, "left")
    n, m = F.col("active_nodes").cast("double"), F.coalesce("edge_count", F.lit(0)).cast("bigint")
    return out.withColumns(
        {
            "edge_count": m,
            "density": F.when(n > 1, m / (n * (n - 1))).otherwise(F.lit(0.0)),
            "core_share": F.when((n >= 2) & (m > 0), F.col("_top") / n).otherwise(F.lit(1.0)),
        }
    ).drop("_top")


def temporal_snapshots(transfers: DataFrame, by: list[str], ts: str = "timestamp", src: str = "from_entity", dst: str = "to_entity") -> DataFrame:
    """Snapshots per Sunday-start week and ``by``, all graphs solved together."""
    from tallyweave.operators.calendars import week_start_sunday

    framed = transfers.withColumn("period", week_start_sunday(F.col(ts)))
    return snapshot_metrics(framed, ["period", *by], src, dst)


def core_persistence(events: DataFrame, by: list[str], week: str = "event_week", minimum: int | None = None, maximum: int | None = None) -> DataFrame:
    """Per node: active weeks, weeks in the weekly maximum core, share, mean normalised core."""
    if minimum is not None:
        events = events.where(F.col(week).between(minimum, maximum))
    ends = [F.least("actor_address", "beneficiary_address").alias("src"), F.greatest("actor_address", "beneficiary_address").alias("dst")]
    flat = events.where("actor_address <> beneficiary_address").select(*by, week, *ends).distinct()
    cores = core_numbers(flat, [*by, week], flat=True)
    top = cores.groupBy(*by, week).agg(F.max("core").alias("_max"))
    joined = cores.join(top, [*by, week])
    out = joined.groupBy(*by, "node").agg(
        F.count(F.lit(1)).alias("topology_active_weeks"),
        F.count_if(F.col("core") == F.col("_max")).alias("maximum_core_weeks"),
        F.avg(F.col("core") / F.col("_max")).alias("mean_normalized_weekly_core"),
    )
    return out.withColumn("maximum_core_persistence", F.col("maximum_core_weeks") / F.col("topology_active_weeks"))


def _radius_rounds(edges: DataFrame, by: list[str], tolerance: float, maximum_rounds: int) -> Iterator[tuple[DataFrame, float, float, bool]]:
    """Rounds of power iteration: radius per graph, the bounds below and above the largest of them, and whether it settled.

    A round is shifted by the graph's last estimate. Two-sided graphs have a least eigenvalue of minus the
    radius, which a small shift hardly damps; this one takes it out. For a symmetric graph the Rayleigh
    quotient is never above the radius, and for positive x the largest (A x) / x is never below it.
    """
    edges, keys = _keyed(edges, by)
    arcs = TwoWayArcs(both_ways(undirected(edges, keys), keys), keys)
    state = cut(arcs.nodes.select(*keys, "node").withColumns({"x": F.lit(1.0), "_shift": F.lit(1.0)}))
    before = None
    for _ in range(maximum_rounds):
        inflow = arcs.gather(state, ["x"], [F.sum(F.col("weight") * F.col("x")).alias("_y")])
        moved = cut(state.join(inflow, [*keys, "node"], "left").withColumn("_y", F.coalesce("_y", F.lit(0.0)) + F.col("_shift") * F.col("x")))
        shift = F.max("_shift")
        norms = moved.groupBy(*keys).agg(
            (F.sum(F.col("_y") * F.col("x")) / F.sum(F.col("x") * F.col("x")) - shift).alias("radius"),
            (F.max(F.col("_y") / F.col("x")) - shift).alias("_above"), F.sqrt(F.sum(F.col("_y") * F.col("_y"))).alias("_norm"),
        )
        norms = cut(norms)
        low, high, total = norms.agg(F.max("radius"), F.max("_above"), F.sum("radius")).first()
        settled = total is None or (before is not None and abs(total - before) <= tolerance * max(1.0, abs(total)))
        yield _unkeyed(norms.drop("_norm", "_above"), by), low or 0.0, high or 0.0, settled
        before = total
        state = moved.join(norms, keys).select(*keys, "node", (F.col("_y") / F.col("_norm")).alias("x"), F.greatest("radius", F.lit(0.0)).alias("_shift"))
    raise RuntimeError(f"the radius did not settle in {maximum_rounds} rounds")


def spectral_radius(edges: DataFrame, by: list[str], tolerance: float = 1e-9, maximum_rounds: int = 300) -> DataFrame:
    """Largest eigenvalue of each symmetric non-negative graph by shifted power iteration."""
    return next(radius for radius, _, _, settled in _radius_rounds(edges, by, tolerance, maximum_rounds) if settled)


def katz_bonacich(
    edges: DataFrame, benefit: DataFrame | None, by: list[str], beta: float, tolerance: float = 1e-12, maximum_rounds: int = 500
) -> DataFrame:
    """Linear network activity x = b + beta * A x, floored at zero, per graph.

    Needs beta >= 0 and beta * spectral radius < 1. The largest node strength bounds the
    radius from above, so the power iteration runs only when that bound does not settle it, and only
    until its own bounds do.
    ``benefit`` holds ``(by..., node, benefit)``; without it every node has benefit one.
    """
    if beta < 0:
        raise ValueError("beta must not be negative")
    edges, keys = _keyed(edges, by)
    flat = undirected(edges, keys)
    arcs = TwoWayArcs(both_ways(flat, keys).withColumn("weight", F.col("weight").cast("double")), keys)
    strength = arcs.table.groupBy(*keys, "src").agg(F.sum("weight").alias("s")).agg(F.max("s")).first()[0] or 0.0
    if beta * strength >= 1:
        for _, low, high, settled in _radius_rounds(flat, keys, 1e-9, 300):
            if beta * low >= 1:
                raise ValueError("beta * spectral radius must stay below one")
            if beta * high < 1 or settled:
                break
    nodes = arcs.nodes.select(*keys, "node")
    if benefit is not None:
        given, _ = _keyed(benefit, by)
        nodes = nodes.join(given.select(*keys, "node", "benefit"), [*keys, "node"], "full_outer").fillna(0.0, ["benefit"])
    else:
        nodes = nodes.withColumn("benefit", F.lit(1.0))
    state = cut(nodes.withColumn("x", F.col("benefit").cast("double")))
    for _ in range(maximum_rounds):
        inflow = arcs.gather(state, ["x"], [F.sum(F.col("weight") * F.col("x")).alias("_in")])
        moved = state.join(inflow, [*keys, "node"], "left")
        updated = F.col("benefit") + F.lit(beta) * F.coalesce("_in", F.lit(0.0))
        settled = moved.select(*keys, "node", "benefit", updated.alias("x"), F.abs(updated - F.col("x")).alias("_d"))
        new, seen = cut_observed(settled, largest=F.max("_d"), scale=F.max(F.abs(F.col("x"))))
        discard(state)
        state = _kept_path(new, new.drop("_d"))
        if (seen["largest"] or 0.0) <= tolerance * max(1.0, seen["scale"] or 0.0):
            break
    else:
        raise RuntimeError("activity did not settle")
    return _unkeyed(state.select(*keys, "node", F.greatest("x", F.lit(0.0)).alias("activity")), by)


def scale_diagnostics(summary: DataFrame) -> DataFrame:
    """Scale-aware projections over one row per graph with node counts and PageRank HHI."""
    n, h = F.col("node_count"), F.col("pagerank_hhi")
    return summary.withColumns(
        {
            "scaled_pagerank_hhi": n * h,
            "effective_pagerank_fraction": F.lit(1.0) / (n * h),
            "be_containment": F.col("be_nodes_in_maximum_k_core") / F.col("be_core_node_count"),
            "persistent_share": F.col("persistent_addresses") / n,
        }
    )
