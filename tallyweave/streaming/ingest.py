"""Incremental jobs on Structured Streaming: resumable ingest and weekly action counts."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators.contracts import reject_rows, split_valid
from tallyweave.operators.sizing import with_scalar


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def resumable_ingest(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    store: str,
    rules: dict[str, Column],
    keys: list[str],
    fmt: str = "json",
    glob: str | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    on_duplicate: str = "error",
    max_files: int = 200,
) -> dict[str, str]:
    """Ingest the chunk files that no earlier run has finished, then stop.

    The streaming checkpoint remembers finished files, so a run after a failure or with new
    chunks continues where the last one ended. Each micro-batch is validated, checked for
    keys already stored, and written under its own batch folder; a replayed batch replaces its
    folder, so rows are stored once. A micro-batch takes ``max_files`` chunks at most, so a backlog
    is worked off in steps and a failure repeats one of them. One receipt row per chunk file
    records counts and a digest.
    """
    paths = {name: f"{store}/{name}" for name in ("accepted", "rejected", "receipts", "ledger", "checkpoint")}
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.load(source).withColumn("chunk", F.col("_metadata.file_path"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        tagged = reject_rows(rows, rules).persist()
        try:
            good, bad = split_valid(tagged)
            repeated = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("chunk").alias("_first")).where("_n > 1")
            clash = None
            if _exists(spark, paths["ledger"]):
                suspects = suspect_batches(spark, paths["ledger"], good, keys, batch_id)
                other = F.col("batch_id").isin(suspects) if suspects else None
            elif _exists(spark, paths["accepted"]):  # a store without a ledger is read whole
                other = F.col("batch_id") != batch_id
            else:
                other = None
            if other is not None:
                stored = spark.read.parquet(paths["accepted"]).where(other).select(*keys)
                clash = good.join(stored, keys, "left_semi").select(*keys)
                good = good.join(stored, keys, "left_anti")
            if on_duplicate == "error":
                found = repeated.limit(1).count() or (clash is not None and clash.limit(1).count())
                if found:
                    raise ValueError(f"repeated keys {keys} across chunks")
            else:
                good = good.dropDuplicates(keys)
            batch_ledger(good, keys).write.mode("overwrite").parquet(f"{paths['ledger']}/batch_id={batch_id}")
            good.write.mode("overwrite").parquet(f"{paths['accepted']}/batch_id={batch_id}")
            bad.write.mode("overwrite").parquet(f"{paths['rejected']}/batch_id={batch_id}")
            digest = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256), 1, 15), 16, 10)
            receipt = tagged.groupBy("chunk").agg(
                F.count(F.lit(1)).alias("log_count"),
                F.count_if(F.size("failed_rules") > 0).alias("rejected_count"),
                F.sum(digest.cast("decimal(20,0)")).cast("string").alias("key_digest"),
            )
            chunks = [row.chunk for row in receipt.select("chunk").collect()]  # at most max_files
            content = spark.read.format("binaryFile").load([unquote(c) for c in chunks]) if chunks else None
            if content is not None:
                facts = content.select(F.col("_metadata.file_path").alias("chunk"), F.col("length").alias("content_bytes"), F.sha2("content", 256).alias("content_sha256"))
                receipt = receipt.join(F.broadcast(facts), "chunk", "left")
            receipt.write.mode("overwrite").parquet(f"{paths['receipts']}/batch_id={batch_id}")
        finally:
            tagged.unpersist()

    job = stream.writeStream.foreachBatch(write).option("checkpointLocation", paths["checkpoint"]).trigger(availableNow=True).start()
    job.awaitTermination()
    return paths


#: A filter is a row of the ledger with so many bits; a batch has enough of them for 32 bits a key or so.
FILTER_BITS = 32_768
KEYS_PER_FILTER = 1_024
PROBES = 16


def _probes(keys: list[str], filters: Column) -> Column:
    """A key's filter and the places of its bits in it: (filter, bit)."""
    values = [F.col(k) for k in keys]
    place = F.pmod(F.xxhash64(F.lit("filter"), *values), filters)
    return F.array(*[F.struct(place.alias("filter"), F.pmod(F.xxhash64(F.lit(i), *values), F.lit(FILTER_BITS)).alias("bit")) for i in range(PROBES)])


def batch_ledger(stored: DataFrame, keys: list[str]) -> DataFrame:
    """What a batch holds, in little: bitmaps of its keys' hashes, and the range of its first key.

    A row per filter: ``filter``, ``filters`` (how many the batch has), ``bits``, ``low``, ``high``. The bitmaps
    are aggregates, so they are made where the rows are; a batch takes four bytes a key or so.
    """
    rows = stored.count()
    filters = max(1, -(-rows // KEYS_PER_FILTER))
    span = stored.agg(F.min(keys[0]).cast("string").alias("low"), F.max(keys[0]).cast("string").alias("high"))
    probed = stored.select(F.explode(_probes(keys, F.lit(filters))).alias("_p"))
    maps = probed.groupBy(F.col("_p.filter").alias("filter")).agg(F.bitmap_construct_agg(F.col("_p.bit")).alias("bits"))
    return with_scalar(maps.withColumn("filters", F.lit(filters).cast("bigint")), span)


def suspect_batches(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], batch_id: int) -> list[int]:
    """Earlier batches that may hold one of the keys: their range meets the rows' and a filter has all bits of a key.

    No batch with such a key is missed; about one key in three million is suspected of a batch for
    nothing. The list has a number per batch at most.
    """
    if not _exists(spark, path):
        return []
    ledger = spark.read.parquet(path).where(F.col("batch_id") != batch_id)
    kind = rows.schema[keys[0]].dataType
    span = rows.agg(F.min(keys[0]).alias("_low"), F.max(keys[0]).alias("_high"))
    meets = (F.col("low").cast(kind) <= F.col("_high")) & (F.col("high").cast(kind) >= F.col("_low"))
    near = with_scalar(ledger, span).where(meets).select("batch_id", "filter", "filters", "bits")
    sizes = [row.filters for row in near.select("filters").distinct().collect()]  # a few sizes of batches
    if not sizes:
        return []
    wanted = rows.select(*keys).distinct()
    asked = wanted.withColumn("filters", F.explode(F.array(*[F.lit(n).cast("bigint") for n in sizes])))
    asked = asked.withColumn("_p", _probes(keys, F.col("filters"))).select("filters", F.col("_p")[0]["filter"].alias("filter"), F.transform("_p", lambda p: p["bit"]).alias("_bits"))

    def held(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bits", (F.call_function("div", bit, F.lit(8)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1

    found = asked.join(near, ["filters", "filter"]).where(F.forall("_bits", held))
    return [row.batch_id for row in found.select("batch_id").distinct().collect()]


def weekly_action_counts(stream: DataFrame, delay: str = "1 day", width: str = "7 days") -> DataFrame:
    """Weekly counts per (chain, action) on an event stream with ``ts, chain_id, action,
    tx_hash, log_index``. Repeats inside the watermark are dropped; later ones are late data,
    and the batch panel over the stored table stays the reference result. Windows come out once
    the watermark has passed them; :func:`close_panel` adds those that are still open."""
    return (
        stream.withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["chain_id", "tx_hash", "log_index"])
        .groupBy(F.window("ts", width), "chain_id", "action")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "chain_id", "action", "event_count"
        )
    )


def close_panel(closed: DataFrame, stored: DataFrame, width: str = "7 days") -> DataFrame:
    """Closed windows of a stream and the windows after them, counted from the stored rows."""
    edge = closed.agg(F.max("window_end").alias("_edge"))
    later = with_scalar(stored, edge).where(F.col("_edge").isNull() | (F.col("ts") >= F.col("_edge"))).drop("_edge")
    counted = later.dropDuplicates(["chain_id", "tx_hash", "log_index"]).groupBy(F.window("ts", width), "chain_id", "action")
    counts = counted.agg(F.count(F.lit(1)).alias("event_count"))
    opened = counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "chain_id", "action", "event_count")
    return closed.unionByName(opened)


def run_to_table(result: DataFrame, store: str) -> str:
    """Drain a windowed stream into a Parquet table of closed windows and stop."""
    job = (
        result.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{store}/closed")
        .option("checkpointLocation", f"{store}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return f"{store}/closed"
