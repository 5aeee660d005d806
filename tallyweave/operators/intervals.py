"""Joins on intervals and as-of joins that stay equi-joins and bounded tasks at any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators.sizing import BROADCAST_ROWS, shuffled
from tallyweave.session import pin

#: Ends of intervals are moved into this range, so that no sum overflows.
FAR = 1 << 61
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def dyadic_blocks(low: Column, high: Column) -> Column:
    """The least number of blocks [b * 2^level, (b + 1) * 2^level) that make up [low, high]: (level, block).

    At most two blocks of each level; none for an empty or null interval.
    """
    given = low.isNotNull() & high.isNotNull()  # greatest and least pass over nulls
    low, end = F.greatest(low.cast("bigint"), F.lit(-FAR)), F.least(high.cast("bigint"), F.lit(FAR)) + 1
    # at a level, the whole blocks inside are [first, last); one that its parent would leave out is taken here
    whole = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.floor(F.log2((end - low).cast("double"))).cast("int") + 1),
            lambda level: F.struct(level.alias("level"), (-_shift(-low, level)).alias("first"), _shift(end, level).alias("last")),
        ),
        lambda x: x["first"] < x["last"],
    )
    lefts = F.transform(F.filter(whole, lambda x: x["first"] % 2 != 0), lambda x: F.struct(x["level"].alias("level"), x["first"].alias("block")))
    rights = F.transform(F.filter(whole, lambda x: x["last"] % 2 != 0), lambda x: F.struct(x["level"].alias("level"), (x["last"] - 1).alias("block")))
    return F.when(given & (low < end), F.concat(lefts, rights))


def _shift(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def containing(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, on: list[str] | None = None) -> DataFrame:
    """Every row of ``points`` with every interval [low, high] that contains its ``point``, equal in ``on``.

    Intervals are cut into dyadic blocks and a point names the one block of each level that holds
    it, so the join is on equal (level, block, ``on``) and finds each pair once. The side that is counted
    to be small is broadcast; if neither is, both are shuffled, as the blocks are many more than Spark
    expects. The columns of the two tables other than ``on`` must differ.
    """
    on = on or []
    points, intervals = points.where(F.col(point).isNotNull()), intervals.where(F.col(low) <= F.col(high))
    longest = intervals.agg(F.max(F.least(F.col(high).cast("bigint"), F.lit(FAR)) - F.greatest(F.col(low).cast("bigint"), F.lit(-FAR)) + 1)).first()[0] or 0
    levels = F.array(*[F.lit(i) for i in range(max(longest, 1).bit_length())])
    cut_up = intervals.withColumn("_b", F.explode(dyadic_blocks(F.col(low), F.col(high))))
    cut_up = cut_up.withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")
    near = F.greatest(F.least(F.col(point).cast("bigint"), F.lit(FAR)), F.lit(-FAR))
    tagged = points.withColumn("_level", F.explode(levels)).withColumn("_block", _shift(near, F.col("_level")))
    if tagged.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        tagged = F.broadcast(tagged)
    elif cut_up.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        cut_up = F.broadcast(cut_up)
    else:
        tagged = shuffled(tagged)
    return tagged.join(cut_up, [*on, "_level", "_block"]).drop("_level", "_block")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, name: str, ties: bool = True, forward: bool = False) -> DataFrame:
    """Each left row with the last right row of its group at or before ``at``, as the struct ``name``.

    ``forward`` takes the first at or after instead; without ``ties`` equal places don't count. Left rows
    with a null place or group, or without such a row, get null. Both tables go through one range
    partitioning by (``by``, place), so a long group is spread over many tasks; within a range the
    last right row is carried forward, and the first rows of a range take that of the ranges before
    it, of which there is one row each.
    """
    arrow_left, hit = F.struct(*[F.col(c) for c in left.columns]), F.struct(*[F.col(c) for c in right.columns])
    place = left.schema[at].dataType
    first = 0 if ties else 1
    own = left.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(at).alias("_at"), F.lit(1 - first).alias("_tag"), arrow_left.alias("_left"))
    other = right.where(F.col(right_at).isNotNull()).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(right_at).cast(place).alias("_at"), F.lit(first).alias("_tag"), hit.alias("_hit")
    )
    keys = [f"_k{i}" for i in range(len(by))]
    order = [*keys, F.col("_at").desc() if forward else F.col("_at").asc(), "_tag"]
    rows = own.unionByName(other, allowMissingColumns=True)
    # keys travel with a hit, so that one group's last row isn't taken for the next group
    rows = rows.withColumn("_hit", F.when(F.col("_hit").isNotNull(), F.struct(*keys, F.col("_hit").alias("row"))))
    placed = pin(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = placed.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    lasts = placed.groupBy("_part").agg(F.max_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("_mid"))).alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))  # one row per range
    ready = placed.join(F.broadcast(carried), "_part", "left").select("_left", "_hit", "_carried")
    schema = T.StructType([T.StructField("_left", ready.schema["_left"].dataType), T.StructField("_found", ready.schema["_hit"].dataType)])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            mine, hits = batch.column(0), batch.column(1)
            last = batch.column(2).slice(0, 1) if last is None else last
            known = np.where(hits.is_valid().to_numpy(zero_copy_only=False), np.arange(1, len(batch) + 1), 0)
            found = pa.concat_arrays([last, hits]).take(pa.array(np.maximum.accumulate(known)))
            last = found.slice(len(batch) - 1, 1)
            keep = mine.is_valid()
            yield pa.RecordBatch.from_arrays([mine.filter(keep), found.filter(keep)], schema=pa.schema([("_left", mine.type), ("_found", found.type)]))

    filled = ready.mapInArrow(fill, schema)
    same = F.col(f"_left.{at}").isNotNull()
    for key, c in zip(keys, by, strict=True):
        same = same & F.coalesce(F.col(f"_found.{key}") == F.col(f"_left.{c}"), F.lit(False))
    return filled.select(*[F.col(f"_left.{c}").alias(c) for c in left.columns], F.when(same, F.col("_found.row")).alias(name))
