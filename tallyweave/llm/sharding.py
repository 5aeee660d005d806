"""Consistent-hash ring with virtual nodes and bounded loads, as DataFrame operations.

The ring has ``CELLS`` cells. Each shard owns ``replicas`` virtual nodes, a row belongs to the
next virtual node clockwise of its hash. A shard first takes its own rows, in ring order, up to
its capacity; the rest continue clockwise to the next shard that has room. Capacities sum to the
number of rows and differ by one at most, so counts are equal to within one row, while only the
rows above capacity leave their own shard.

Rows take part in this as intervals of one global order around the ring. Data-sized work is one
range-partitioned ordinal over narrow rows; all else runs on tables with one row per virtual node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.operators.ordering import global_ordinal
from tallyweave.session import cut

#: Cells of the ring: bounds the look-up table from cell to virtual node.
CELLS = 1 << 16
#: Virtual nodes per shard.
REPLICAS = 128


def _ring_hash(*columns: Column | str) -> Column:
    return F.xxhash64(F.lit("ring"), *columns)


def ring(spark: SparkSession, shards: int, replicas: int = REPLICAS) -> DataFrame:
    """Virtual nodes in ring order: ``node`` (0 to n - 1), ``cell``, ``shard``.

    Two virtual nodes in one cell: the smaller shard stays. A virtual node's cell depends on its
    shard and number alone, so another shard adds nodes and moves none.
    """
    nodes = spark.range(shards * replicas, numPartitions=1).select(
        F.expr(f"cast(id div {replicas} as int)").alias("shard"), F.expr(f"id % {replicas}").alias("replica")
    )
    placed = nodes.select("shard", F.pmod(_ring_hash(F.lit("node"), "shard", "replica"), F.lit(CELLS)).cast("int").alias("cell"))
    one = placed.groupBy("cell").agg(F.min("shard").alias("shard"))
    return one.withColumn("node", F.row_number().over(Window.orderBy("cell")) - 1)


def _owners(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Every cell with the virtual node at or after it; the last cells wrap to node 0."""
    cells = spark.range(CELLS, numPartitions=1).select(F.col("id").cast("int").alias("cell"))
    onward = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cells.join(F.broadcast(nodes.select(F.col("cell").alias("_c"), "node")), F.col("cell") == F.col("_c"), "left")
    return joined.select("cell", F.coalesce(F.last("node", ignorenulls=True).over(onward), F.lit(0)).alias("node"))


def _capacities(total: int, shards: int) -> Column:
    """Rows that a shard takes: the first ``total % shards`` shards take one more."""
    return F.lit(total // shards).cast("bigint") + F.when(F.col("shard") < total % shards, 1).otherwise(0)


def _settle(counts: DataFrame, nodes: DataFrame, total: int, shards: int) -> DataFrame:
    """Intervals of the global order with their shard: ``lo``, ``hi``, ``shard``, ``slot`` of ``lo``.

    ``counts``: rows per virtual node. Intervals never cross a virtual node's range, and there
    are at most (virtual nodes + shards) of them, whatever the data.
    """
    ringward = Window.orderBy("node")
    own = nodes.join(counts, "node", "left").select("node", "shard", F.coalesce("rows", F.lit(0)).alias("rows"))
    own = own.withColumn("start", F.sum("rows").over(ringward) - F.col("rows"))
    mine = Window.partitionBy("shard").orderBy("node")
    own = own.withColumn("before", F.sum("rows").over(mine) - F.col("rows")).withColumn("cap", _capacities(total, shards))
    own = cut(own.withColumn("take", F.greatest(F.lit(0), F.least("rows", F.col("cap") - F.col("before")))))
    settled = own.filter("take > 0").select(
        F.col("start").alias("lo"), (F.col("start") + F.col("take")).alias("hi"), "shard", F.col("before").alias("slot")
    )
    pending = own.filter("rows > take").select(
        (F.col("start") + F.col("take")).alias("lo"), (F.col("start") + F.col("rows")).alias("hi"), F.col("node").alias("at")
    )
    room = own.groupBy("shard").agg(F.first("cap").alias("cap"), F.sum("take").alias("held"))
    room = cut(room)
    last = own.count()
    while pending.limit(1).count():
        # every pending interval goes to the next virtual node clockwise whose shard has room
        open_nodes = own.select("node", "shard").join(room.filter("held < cap"), "shard").select("node", "shard")
        unrolled = open_nodes.unionByName(open_nodes.withColumn("node", F.col("node") + last))
        marks = unrolled.select("node", F.col("shard").alias("to"), F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"))
        asks = pending.select(F.col("at").alias("node"), F.lit(None).cast("int").alias("to"), "lo", "hi")
        onward = Window.orderBy(F.desc("node"), F.col("to").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.when(F.col("to").isNotNull(), F.struct("node", "to"))
        sent = (
            marks.unionByName(asks)
            .withColumn("next", F.last(ahead, ignorenulls=True).over(onward))
            .filter("to is null")
            .select("lo", "hi", (F.col("next.node") % last).alias("at"), F.col("next.to").alias("shard"))
        )
        arriving = Window.partitionBy("shard").orderBy("lo")
        sent = sent.join(room, "shard").withColumn("n", F.col("hi") - F.col("lo"))
        sent = sent.withColumn("slot", F.col("held") + F.sum("n").over(arriving) - F.col("n"))
        sent = cut(sent.withColumn("take", F.greatest(F.lit(0), F.least("n", F.col("cap") - F.col("slot")))))
        taken = sent.filter("take > 0").select("lo", (F.col("lo") + F.col("take")).alias("hi"), "shard", "slot")
        settled = settled.unionByName(taken)
        pending = sent.filter("n > take").select((F.col("lo") + F.col("take")).alias("lo"), "hi", "at")
        added = sent.groupBy("shard").agg(F.sum("take").alias("_added"))
        room = cut(room.join(added, "shard", "left").select("shard", "cap", (F.col("held") + F.coalesce("_added", F.lit(0))).alias("held")))
    return settled


def shard_documents(
    docs: DataFrame, shards: int = 24, replicas: int = REPLICAS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Shard and slot of every row: ``key``, ``size``, ``text_crc32``, ``home``, ``shard``, ``slot``.

    ``home`` is the shard of the row's own virtual node; ``shard`` differs where that was full.
    Slots run from 0 without gaps in each shard and counts differ by one at most. A null text
    counts as no bytes; size is the bytes plus 8. Rows with a null key spread over the ring by
    their position in the input, repeated rows with one key stay neighbours and are told apart
    by that position. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = cut(
        docs.select(F.col(key).alias("_key"), (F.octet_length(whole) + 8).cast("bigint").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"))
    ).withColumn("_row", F.monotonically_increasing_id())
    total = slim.count()
    spot = _ring_hash(F.lit("row"), F.col("_key").cast("string"), F.when(F.col("_key").isNull(), F.col("_row")))
    keyed = slim.withColumn("_spot", spot).withColumn("_cell", F.pmod("_spot", F.lit(CELLS)).cast("int"))
    nodes = cut(ring(spark, shards, replicas))
    owners = cut(_owners(spark, nodes))
    keyed = keyed.join(F.broadcast(owners.withColumnRenamed("cell", "_cell")), "_cell")  # CELLS rows
    # node 0 also owns the cells past the last node; they come first in its range
    ordered = global_ordinal(keyed, ["node", "_spot", "_key", "_row"], "_at")
    counts = cut(ordered.groupBy("node").agg(F.count(F.lit(1)).alias("rows")))
    spans = _settle(counts, nodes, total, shards)
    starts = nodes.join(counts, "node", "left").select("node", F.col("shard").alias("home"), F.coalesce("rows", F.lit(0)).alias("rows"))
    starts = starts.withColumn("_start", F.sum("rows").over(Window.orderBy("node")) - F.col("rows")).filter("rows > 0")
    # the intervals of each virtual node as one array: (virtual nodes) rows, (virtual nodes + shards) intervals in all
    spans = spans.join(starts, (F.col("lo") >= F.col("_start")) & (F.col("hi") <= F.col("_start") + F.col("rows")))
    table = cut(spans.groupBy("node", "home").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard", "slot"))).alias("_spans")))
    at = F.col("_at") - 1
    placed = ordered.join(F.broadcast(table), "node").withColumn(
        "_span", F.filter("_spans", lambda s: (s["lo"] <= at) & (at < s["hi"])).getItem(0)
    )
    return placed.select(
        F.col("_key").alias(key), "size", "text_crc32", "home", F.col("_span.shard").alias("shard"),
        (F.col("_span.slot") + at - F.col("_span.lo")).cast("bigint").alias("slot"),
    )
