"""Ordinals, ranks, stable top-k and deterministic samples without single-partition windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.sizing import attach, small_side
from tallyweave.session import cut, pin

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def global_ordinal(
    df: DataFrame, order: list[str | Column], name: str = "ordinal", partitions: int | None = None
) -> DataFrame:
    """One-based position of every row in a total order.

    Range partitioning sorts the data; only the row count of each partition (one row per
    partition) goes through the running sum, and it is broadcast because its size is the
    partition count. ``order`` must end in a unique column so that ranges stay balanced.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = pin(ranged.sortWithinPartitions(*order))
    placed = placed.withColumn("_mid", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (local + F.col("_offset") + 1).cast("bigint"))
        .drop("_mid", "_part", "_offset")
    )


def group_ordinal(
    df: DataFrame, by: list[str], order: list[str | Column], name: str = "ordinal"
) -> DataFrame:
    """One-based position inside each group, for groups of any size.

    With groups, ordered rows are written once; ``discard`` of the result deletes them.
    """
    if not by:
        return global_ordinal(df, order, name)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = cut(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", _ROW_BITS)
    # rows of a group in earlier partitions, and its first row in this one: about one row per group and partition
    sizes = placed.groupBy(*by, part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sizes.select(*by, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift")))
    found = attach(placed.withColumn("_part", part), small_side(offsets), [*by, "_part"])
    out = found.withColumn(name, F.col("_mid") + F.col("_shift")).drop("_mid", "_part", "_shift")
    out._cut_path = placed._cut_path
    return out


def value_bucket(value: Column) -> Column:
    """Monotone integer bucket of a real number: about 0.1 % wide steps of magnitude.

    It depends on the value alone, so it needs no sampling pass, and it splits the running
    totals of a large group over many tasks.
    """
    magnitude = F.floor(F.ln(F.abs(value)) * F.lit(1024.0)).cast("bigint")
    shift = F.lit(1 << 21).cast("bigint")
    return (
        F.when(value > 0, magnitude + shift)
        .when(value < 0, -magnitude - shift)
        .otherwise(F.lit(0).cast("bigint"))
    )


def running_before(
    df: DataFrame, by: list[str], value: str, sums: dict[str, str], ascending: bool = True, bucketed: bool = True
) -> DataFrame:
    """Exclusive running sums by ``value`` inside each group.

    ``sums`` maps an output name to the column that is summed. With ``bucketed`` the running
    sum is taken inside narrow value buckets and shifted by the totals of earlier buckets, so
    no task sees a whole group; without it one window per group is used, which is right when
    the caller has bounded the number of distinct values.
    """
    def direction(c: str) -> Column:
        return F.col(c).asc() if ascending else F.col(c).desc()

    unbounded = Window.unboundedPreceding
    if not bucketed:
        window = Window.partitionBy(*by).orderBy(direction(value)).rowsBetween(unbounded, -1)
        return df.withColumns(
            {name: F.coalesce(F.sum(source).over(window), F.lit(0)) for name, source in sums.items()}
        )
    tagged = df.withColumn("_bucket", value_bucket(F.col(value).cast("double")))
    totals = tagged.groupBy(*by, "_bucket").agg(
        *[F.sum(source).alias(f"_t_{name}") for name, source in sums.items()]
    )
    outer = Window.partitionBy(*by).orderBy(direction("_bucket")).rowsBetween(unbounded, -1)
    totals = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{name}").over(outer), F.lit(0)).alias(f"_o_{name}") for name in sums],
    )
    inner = Window.partitionBy(*by, "_bucket").orderBy(direction(value)).rowsBetween(unbounded, -1)
    tagged = tagged.withColumns(
        {f"_i_{name}": F.coalesce(F.sum(source).over(inner), F.lit(0)) for name, source in sums.items()}
    )
    joined = attach(tagged, totals, [*by, "_bucket"])
    joined = joined.withColumns({name: F.col(f"_o_{name}") + F.col(f"_i_{name}") for name in sums})
    return joined.drop("_bucket", *[f"_o_{n}" for n in sums], *[f"_i_{n}" for n in sums])


def average_rank(df: DataFrame, by: list[str], value: str, name: str = "rank", weight: str | None = None) -> DataFrame:
    """One row per distinct value with its average rank and percentile rank.

    ``weight`` counts how many rows share the value when the input is already a histogram.
    """
    count = F.sum(weight) if weight else F.count(F.lit(1))
    histogram = df.groupBy(*by, value).agg(count.alias("_ties"))
    placed = running_before(histogram, by, value, {"_below": "_ties"})
    totals = histogram.groupBy(*by).agg(F.sum("_ties").alias("_rows"))
    placed = attach(placed, totals, by)
    rank = F.col("_below") + (F.col("_ties") + 1) / F.lit(2.0)
    return placed.select(
        *by, value, rank.alias(name), (rank / F.col("_rows")).alias(f"{name}_pct"), F.col("_ties").alias("ties")
    )


def spearman(df: DataFrame, by: list[str], left: str, right: str, name: str = "spearman") -> DataFrame:
    """Rank correlation per group; zero when a side has no spread or fewer than two rows.

    Rows are first reduced to counts of value pairs, so a value shared by a third of all rows
    is a single row in the rank joins.
    """
    pairs = cut(df.groupBy(*by, left, right).agg(F.count(F.lit(1)).alias("_n")))
    first = average_rank(pairs, by, left, "_rl", weight="_n").select(*by, left, "_rl")
    second = average_rank(pairs, by, right, "_rr", weight="_n").select(*by, right, "_rr")
    joined = attach(attach(pairs, first, [*by, left]), second, [*by, right])
    n, x, y = F.col("_n").cast("double"), F.col("_rl"), F.col("_rr")
    sums = joined.groupBy(*by).agg(
        F.sum(n).alias("n"),
        F.sum(n * x).alias("sx"),
        F.sum(n * y).alias("sy"),
        F.sum(n * x * x).alias("sxx"),
        F.sum(n * y * y).alias("syy"),
        F.sum(n * x * y).alias("sxy"),
    )
    vx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    value = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).otherwise(F.lit(0.0))
    return sums.select(*by, value.alias(name))


def stable_top(df: DataFrame, field: str, key: str, k: int) -> DataFrame:
    """Top ``k`` rows by field descending, key ascending (a distributed take-ordered)."""
    return df.orderBy(F.col(field).desc(), F.col(key).asc()).limit(k)


def audit_sample(
    registry: DataFrame, size: int, stratum: str, weight: str, key: str, salt: str
) -> DataFrame:
    """Deterministic sample: the heaviest quarter of each stratum, then lowest salted hashes."""
    if size < 4:
        raise ValueError("sample size must be at least four")
    quarter = max(1, size // 4)
    heavy = None
    for flag in (True, False):
        top = stable_top(registry.where(F.col(stratum) == F.lit(flag)), weight, key, quarter)
        heavy = top if heavy is None else heavy.unionByName(top)
    heavy = cut(heavy.withColumn("sample_source", F.lit("heaviest_of_stratum")))
    rest = registry.join(F.broadcast(heavy.select(key)), key, "left_anti")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256)
    filler = rest.orderBy(digest, F.col(key)).limit(max(0, size - heavy.count()))
    return heavy.unionByName(filler.withColumn("sample_source", F.lit("hash_rank"))).limit(size)


def sample_windows(
    df: DataFrame, position: str, count: int, width: int, minimum: int, maximum: int
) -> DataFrame:
    """Evenly spaced windows over the distinct sorted positions, clamped and deduplicated."""
    if count < 1 or width < 1:
        raise ValueError("count and width must be positive")
    distinct = global_ordinal(df.select(position).distinct(), [position], "_ord")
    last = distinct.agg((F.max("_ord") - 1).alias("_last"))
    if count == 1:
        picks = last.select(F.call_function("div", F.col("_last") + 1, F.lit(2)).alias("_pick"))
    else:
        index = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        picks = last.select("_last", index.alias("_i")).select(
            F.bround(F.col("_i") * F.col("_last") / F.lit(float(count - 1))).cast("bigint").alias("_pick")
        )
    chosen = distinct.join(F.broadcast(picks.distinct()), F.col("_ord") - 1 == F.col("_pick"))
    low = F.least(
        F.greatest(F.lit(minimum), F.col(position) - F.lit(width // 2)), F.lit(maximum - width + 1)
    )
    return (
        chosen.select(low.cast("bigint").alias("from_block"))
        .withColumn("to_block", F.least(F.lit(maximum), F.col("from_block") + F.lit(width - 1)).cast("bigint"))
        .distinct()
    )
