"""Folders and checkpoints that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one stands in only where that is unset and driver and executors are one
    process, as in tests: on a cluster each machine would write to a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = tempfile.gettempdir() + "/terravane-checkpoints"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a Parquet table in a shared folder, read again: this cuts lineage, survives lost executors, and
    gives the planner true sizes, where estimates multiplied over an iteration's joins would run off."""
    folder = folder or shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def push_filters(spark: SparkSession) -> None:
    """Lets Python sources take part in filters: Spark refuses a source that does while this setting is off, so it is switched on once for a session, and stays so."""
    key = "spark.sql.python.filterPushdown.enabled"
    if spark.conf.get(key, "false") != "true":
        spark.conf.set(key, "true")


def bounded_batches(spark: SparkSession) -> None:
    """Batches of some megabyte between the JVM and Python, where Spark's own bound of 64 MB lets 10,000 texts into each: a task holds several
    copies of one on either side. It is switched on once for a session, unless that has a bound of its own, and stays so."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "1m")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> SparkSession:
    """A session for stateful processors, which need RocksDB as their state store; that of the caller, whose streams may
    run at the same time, keeps its own."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    return own
