"""Session settings and the two ways this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(app: str = "tallyweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew-join splitting)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is used only by a
    local session, where driver and executors are one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        current = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder beside the session's intermediate tables; it goes when the application ends."""
    path = f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, forgetting how it was made.

    The written table survives the loss of any executor, and unlike a checkpointed plan it
    carries its real size, so later joins are planned from facts rather than from estimates
    that multiply round after round. The tables go when the application ends.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "tables")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def cut_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """As :func:`cut`, with aggregates over the written rows taken by the write itself.

    A loop reads from them whether it has settled, so a round is one job. A task that is run again
    may be counted again: use what is null, zero or an extreme for such a decision, not sums.
    """
    seen = Observation()
    table = cut(df.observe(seen, *[column.alias(name) for name, column in metrics.items()]))
    return table, seen.get


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`cut` returned, once nothing reads it any more (a loop's last round)."""
    path = getattr(table, "_cut_path", None)
    if path:
        spark = table.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def pin(df: DataFrame, laid: bool = False) -> DataFrame:
    """Reliable checkpoint that keeps the row order of ``df``, and with ``laid`` its partitioning too.

    For layouts that later jobs rely on: a table hash-partitioned on a join key is not
    shuffled again, and sorted ranges keep their order. Adaptive plans don't tell how their rows are partitioned, so
    a table that is to be ``laid`` is planned without; its last shuffle must name its number of partitions.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    if not laid:
        return df.checkpoint(eager=True)
    key = "spark.sql.adaptive.enabled"
    adaptive = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(key, adaptive)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
