"""Event-time calendars, period labels and block boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators import sizing
from tallyweave.operators.intervals import as_of, containing
from tallyweave.operators.sizing import attach, small_side

#: Up to so many targets are held as an array beside the headers.
SLOTS = 1_000


def event_calendar(cohorts: DataFrame, pre: int, post: int, days: int = 7, activation: str = "activation_utc") -> DataFrame:
    """One row per cohort and week in [-pre, post] with half-open bounds from the activation."""
    weeks = cohorts.withColumn("event_week", F.explode(F.sequence(F.lit(-pre), F.lit(post))))
    start = F.col(activation) + F.make_interval(days=F.col("event_week") * F.lit(days))
    end = F.col(activation) + F.make_interval(days=(F.col("event_week") + 1) * F.lit(days))
    return weeks.withColumns({"window_start_utc": start, "window_end_utc_exclusive": end})


def boundary_targets(calendar: DataFrame, key: str = "cohort_id") -> DataFrame:
    """Week starts plus the end of the last week, the instants whose blocks are needed."""
    starts = calendar.select(key, F.col("event_week").alias("boundary_event_week"), F.col("window_start_utc").alias("target_utc"))
    closing = calendar.groupBy(key).agg(
        (F.max("event_week") + 1).alias("boundary_event_week"),
        F.max("window_end_utc_exclusive").alias("target_utc"),
    )
    return starts.unionByName(closing)


def donor_calendar(calendar: DataFrame, donor: DataFrame, strict: bool = True) -> DataFrame:
    """A treated calendar re-keyed to each donor whose market and clocks cover all of it.

    ``donor`` holds ``cohort_id, chain, chain_id, market_available_by_utc,
    own_anticipation_utc``. A donor that fails a clock of a calendar fails the job; without
    ``strict`` the pair is left out, as when donors are searched for.
    """
    span = calendar.groupBy("cohort_id").agg(
        F.min("window_start_utc").alias("_first"), F.max("window_end_utc_exclusive").alias("_last")
    )
    treated = span.withColumnRenamed("cohort_id", "calendar_cohort_id")
    fits = (F.col("market_available_by_utc") <= F.col("_first")) & (F.col("own_anticipation_utc") >= F.col("_last"))
    pairs = small_side(donor.select("cohort_id", "chain", "chain_id", "market_available_by_utc", "own_anticipation_utc"))
    other = F.col("cohort_id") != F.col("calendar_cohort_id")
    if strict:
        eligible = treated.join(pairs, other)
        late = F.raise_error(F.concat(F.lit("donor does not cover the calendar: "), F.col("cohort_id").cast("string"))).cast("boolean")
        eligible = eligible.where(F.coalesce(fits, F.lit(False)) | late)
    else:
        eligible = treated.join(pairs, fits & other)
    weeks = calendar.select(
        F.col("cohort_id").alias("calendar_cohort_id"), "event_week", "window_start_utc", "window_end_utc_exclusive"
    )
    return weeks.join(eligible.drop("_first", "_last", "market_available_by_utc", "own_anticipation_utc"), "calendar_cohort_id")


def assign_weeks(
    events: DataFrame,
    boundaries: DataFrame,
    key: list[str],
    block: str = "block_number",
    strict: bool = True,
) -> DataFrame:
    """Week of each event: the last boundary at or below its block.

    The final boundary only closes the panel. With ``strict`` an event outside the panel is an
    error raised by the job itself; otherwise ``event_week`` stays null for it. A counted small
    table of boundaries is broadcast; a larger one is merged with the events in ranges of blocks,
    so no task holds all boundaries of a key.
    """
    starts = boundaries.select(*key, F.col("boundary_event_week").alias("event_week"), F.col("start_block").alias("_from"))
    if starts.limit(sizing.BROADCAST_ROWS + 1).count() <= sizing.BROADCAST_ROWS:
        order = Window.partitionBy(*key).orderBy("_from")
        ranges = starts.withColumn("_until", F.lead("_from").over(order)).where(F.col("_until").isNotNull())
        ranges = F.broadcast(ranges.withColumnsRenamed({c: f"_b_{c}" for c in key}))
        inside = (F.col(block) >= F.col("_from")) & (F.col(block) < F.col("_until"))
        for name in key:
            inside = inside & (F.col(name) == F.col(f"_b_{name}"))
        joined = events.join(ranges, inside, "left").drop("_from", "_until", *[f"_b_{k}" for k in key])
    else:
        closing = attach(starts, starts.groupBy(*key).agg(F.max("_from").alias("_closing")), key)
        weeks = closing.select(*key, "_from", F.when(F.col("_from") < F.col("_closing"), F.col("event_week")).alias("event_week"))
        joined = as_of(events, weeks, key, block, "_from", "_week")
        joined = joined.withColumn("event_week", F.col("_week.event_week")).drop("_week")
    if strict:
        outside = F.raise_error(F.concat(F.lit("event block is outside the panel: "), F.col(block).cast("string")))
        joined = joined.withColumn("event_week", F.coalesce("event_week", outside.cast("int")))
    return joined


def assign_periods(df: DataFrame, periods: DataFrame, week: str = "event_week") -> DataFrame:
    """Overlapping periods: a row is repeated for every period that contains its week.

    The distinct weeks meet the periods by dyadic blocks, and rows meet their week's periods.
    """
    if periods.limit(sizing.BROADCAST_ROWS + 1).count() <= sizing.BROADCAST_ROWS:
        return df.join(F.broadcast(periods), F.col(week).between(F.col("minimum_event_week"), F.col("maximum_event_week")))
    weeks = df.select(F.col(week).alias("_w")).distinct()
    found = containing(weeks, periods, "_w", "minimum_event_week", "maximum_event_week")
    return df.join(found, F.col(week) == F.col("_w")).drop("_w")


def first_at_or_after(headers: DataFrame, targets: list, ts: str = "timestamp", block: str = "block_number") -> DataFrame:
    """First block whose time is at or after each target, with the adjacent-header proof.

    ``targets`` is the sorted list of instants (a calendar, so a few dozen values). Headers
    are reduced once to one row per interval between targets; the answer for a target is the
    first non-empty interval behind it, and the proof is the last header before it.
    """
    spark = headers.sparkSession
    instants = sorted(targets)
    literal = F.array(*[F.lit(t) for t in instants])
    slot = F.size(F.filter(literal, lambda t: t <= F.col(ts)))  # how many targets are reached
    reduced = headers.groupBy(slot.alias("slot")).agg(
        F.min_by(F.struct(F.col(block).alias("b"), F.col(ts).alias("t")), F.struct(ts, block)).alias("first"),
        F.max_by(F.struct(F.col(block).alias("b"), F.col(ts).alias("t")), F.struct(ts, block)).alias("last"),
    )
    frame = spark.createDataFrame(
        [(i, t) for i, t in enumerate(instants)], "target_index int, target_utc timestamp"
    ).withColumn("target_utc", F.col("target_utc").cast(headers.schema[ts].dataType))
    reached = frame.join(F.broadcast(reduced), F.col("slot") > F.col("target_index"), "left").groupBy("target_index", "target_utc").agg(
        F.min_by("first", "slot").alias("first")
    )
    earlier = frame.join(F.broadcast(reduced), F.col("slot") <= F.col("target_index"), "left").groupBy("target_index").agg(
        F.max_by("last", "slot").alias("previous")
    )
    lag = F.unix_seconds(F.col("first.t").cast("timestamp")) - F.unix_seconds(F.col("target_utc").cast("timestamp"))
    return reached.join(earlier, "target_index").select(
        "target_index",
        "target_utc",
        F.col("first.b").alias("start_block"),
        F.col("first.t").alias("start_block_timestamp"),
        F.col("previous.t").alias("previous_block_timestamp"),
        lag.alias("lag_seconds"),
        ((F.col("first.t") >= F.col("target_utc")) & (F.col("previous.t").isNull() | (F.col("previous.t") < F.col("target_utc")))).alias("adjacent_proof"),
    )


def boundary_blocks(headers: DataFrame, targets: DataFrame, key: str = "cohort_id", ts: str = "timestamp", block: str = "block_number") -> DataFrame:
    """Boundary block of every target of every cohort, with the time of the header before it.

    ``targets`` holds ``key, boundary_event_week, target_utc`` and, where a cohort's own
    activation block is known, ``activation_block`` on the row of its activation instant (null
    elsewhere). Such a row takes that very block, also if several blocks share its second, and
    fails unless the block's time is the target. Other rows take the first block at or after the
    target. Headers are reduced to one row per cohort and stretch between targets, so the rest
    works on tables of calendar size. More than ``SLOTS`` targets are merged with the headers in
    ranges of time instead.
    """
    if targets.limit(SLOTS + 1).count() <= SLOTS:
        sides = _slotted_sides(headers, targets, key, ts, block)
    else:
        sides = _merged_sides(headers, targets, key, ts, block)
    anchors = targets.where("activation_block is not null").select(key, F.col("activation_block").alias("_anchor"))
    around = headers.select(key, F.col(block).alias("_b"), F.col(ts).alias("_t")).join(small_side(anchors), key).where("_b <= _anchor")
    anchored = around.groupBy(key, "_anchor").agg(
        F.max(F.when(F.col("_b") == F.col("_anchor"), F.col("_t"))).alias("_time"), F.max_by("_t", F.when(F.col("_b") < F.col("_anchor"), F.col("_b"))).alias("_previous"),
        F.max(F.when(F.col("_b") < F.col("_anchor"), True)).alias("_has_previous"),
    )
    out = targets.join(sides, [key, "boundary_event_week"], "left").join(anchored, [key], "left")
    mine = F.col("activation_block").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("activation block isn't at its instant: "), F.col("activation_block").cast("string")))
    kind = headers.schema[ts].dataType
    time = F.when(~mine, F.when(F.col("_reached"), F.col("_first.t"))).when(F.col("_time") == F.col("target_utc"), F.col("_time")).otherwise(wrong.cast(kind))
    before = F.when(mine, F.when(F.col("_has_previous"), F.col("_previous"))).otherwise(F.when(F.col("_preceded"), F.col("_last.t")))
    return out.select(
        key, "boundary_event_week", "target_utc", F.when(mine, F.col("activation_block")).otherwise(F.when(F.col("_reached"), F.col("_first.b"))).alias("start_block"),
        time.alias("start_block_timestamp"), before.alias("previous_block_timestamp"),
        (F.unix_seconds(time.cast("timestamp")) - F.unix_seconds(F.col("target_utc").cast("timestamp"))).alias("lag_seconds"),
    )


def _slotted_sides(headers: DataFrame, targets: DataFrame, key: str, ts: str, block: str) -> DataFrame:
    """Headers on both sides of each target, from headers reduced to one row per stretch between targets."""
    instants = targets.groupBy(key).agg(F.array_sort(F.collect_set("target_utc")).alias("_instants"))
    near = headers.select(key, F.col(block).alias("_b"), F.col(ts).alias("_t")).join(small_side(instants), key)
    slot = F.size(F.filter("_instants", lambda t: t <= F.col("_t")))
    point, place = F.struct(F.col("_b").alias("b"), F.col("_t").alias("t")), F.struct("_t", "_b")
    reduced = near.groupBy(key, slot.alias("_slot")).agg(F.min_by(point, place).alias("first"), F.max_by(point, place).alias("last"))
    wanted = targets.join(small_side(instants), key).withColumn("_at", F.array_position("_instants", F.col("target_utc")).cast("int"))
    return wanted.join(reduced, key).groupBy(key, "boundary_event_week").agg(
        F.min_by("first", F.when(F.col("_slot") >= F.col("_at"), F.col("_slot"))).alias("_first"),
        F.max_by("last", F.when(F.col("_slot") < F.col("_at"), F.col("_slot"))).alias("_last"),
        F.max(F.when(F.col("_slot") >= F.col("_at"), True)).alias("_reached"), F.max(F.when(F.col("_slot") < F.col("_at"), True)).alias("_preceded"),
    )


def _merged_sides(headers: DataFrame, targets: DataFrame, key: str, ts: str, block: str) -> DataFrame:
    """Headers on both sides of each target, by two as-of joins on time."""
    times = headers.groupBy(key, F.col(ts).alias("t")).agg(F.min(block).alias("b"))
    wanted = targets.select(key, "boundary_event_week", "target_utc")
    found = as_of(wanted, times, [key], "target_utc", "t", "_first", forward=True)
    found = as_of(found, times, [key], "target_utc", "t", "_last", ties=False)
    return found.drop("target_utc").withColumns({"_reached": F.col("_first").isNotNull(), "_preceded": F.col("_last").isNotNull()})


def first_code_block(snapshots: DataFrame, address: str = "address", block: str = "block_number", code: str = "code") -> DataFrame:
    """First block at which each contract shows runtime code."""
    there = ~F.coalesce(F.col(code), F.lit("0x")).isin("0x", "0x0")
    return snapshots.where(there).groupBy(address).agg(F.min(block).alias("first_code_block"))


def week_start_sunday(ts: Column) -> Column:
    day = F.to_date(ts)
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_start_monday(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


DESIGN_PERIODS = (
    # label, first week, last week
    ("clean_pre", -16, -9),
    ("anticipation_excluded", -8, -1),
    ("event_week_zero_excluded", 0, 0),
    ("post", 1, 16),
)


def period_label(week: Column, periods=DESIGN_PERIODS) -> Column:
    label = F.lit(None).cast("string")
    for name, first, last in reversed(list(periods)):
        label = F.when(week.between(first, last), F.lit(name)).otherwise(label)
    return label


def periods_partition(periods, minimum: int, maximum: int) -> bool:
    """Whether the labelled periods cover [minimum, maximum] once, in order."""
    covered = [w for _, first, last in periods for w in range(first, last + 1)]
    return covered == list(range(minimum, maximum + 1))


def pre_flags(calendar: DataFrame, anticipation: str = "anticipation_utc") -> DataFrame:
    """Clean-pre, contaminated-pre, post and required flags of each cohort week."""
    before = F.col("event_week") < 0
    clean = before & (F.col("window_end_utc_exclusive") <= F.col(anticipation))
    return calendar.withColumns(
        {
            "clean_pre": clean,
            "contaminated_pre": before & ~clean,
            "post": F.col("event_week") >= 0,
            "required": clean | (F.col("event_week") >= 0),
        }
    )


def calendar_checks(boundaries: DataFrame, key: str = "cohort_id", minimum: int = -16, maximum: int = 16, policy: str | None = None) -> DataFrame:
    """One verdict row per cohort: complete weeks, increasing blocks, header proof, lag, hash.

    Week zero is ``anchored`` (the block at the activation instant itself, which others may share)
    or ``adjacent`` (the first block at or after it, as every other week); ``policy`` names a
    column that says which, anchored without it.
    """
    order = Window.partitionBy(key).orderBy("boundary_event_week")
    seen = boundaries.withColumn("_before", F.lag("start_block").over(order)).withColumn(
        "_week_before", F.lag("boundary_event_week").over(order)
    )
    target, first, previous = F.col("target_utc"), F.col("start_block_timestamp"), F.col("previous_block_timestamp")
    zero = (F.col("boundary_event_week") == 0) & (F.col(policy) == "anchored" if policy else F.lit(True))
    adjacent = F.when(zero, (first == target) & (previous <= target)).otherwise((first >= target) & (previous < target))
    lag = F.unix_seconds(first.cast("timestamp")) - F.unix_seconds(target.cast("timestamp"))
    bad = {
        "gap_count": F.col("_week_before").isNotNull() & (F.col("boundary_event_week") != F.col("_week_before") + 1),
        "not_increasing_count": F.col("_before").isNotNull() & (F.col("start_block") <= F.col("_before")),
        "unproven_count": ~F.coalesce(adjacent, F.lit(False)),
        "lag_mismatch_count": F.col("lag_seconds") != lag,
        "malformed_hash_count": ~(F.col("start_block_hash").startswith("0x") & (F.length("start_block_hash") == 66)),
    }
    out = seen.groupBy(key).agg(
        F.count(F.lit(1)).alias("boundary_count"),
        F.min("boundary_event_week").alias("_first"),
        F.max("boundary_event_week").alias("_last"),
        *[F.count_if(F.coalesce(rule, F.lit(True))).alias(name) for name, rule in bad.items()],
    )
    complete = (F.col("_first") == minimum) & (F.col("_last") == maximum + 1) & (F.col("gap_count") == 0)
    clean = F.lit(True)
    for name in bad:
        clean = clean & (F.col(name) == 0)
    return out.withColumn("weeks_complete", complete).withColumn("calendar_valid", complete & clean).drop("_first", "_last")
