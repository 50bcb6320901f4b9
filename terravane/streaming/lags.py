"""Feeds whose sources arrive with lags of their own: a watermark each, windows that wait for the slowest, and late rows kept aside."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The slowest source holds all windows back ("min"), or the fastest one closes them ("max"). Read when a stream first starts.
POLICY = "spark.sql.streaming.multipleWatermarkPolicy"


def union_of_sources(sources: Mapping[str, tuple[DataFrame, str]], ts: str) -> DataFrame:
    """Streams {name: (rows, lag)} as one, each under a watermark of its own lag, with a column `source`."""
    parts = [rows.withWatermark(ts, lag).withColumn("source", F.lit(name)) for name, (rows, lag) in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def source_windows(feed: DataFrame, ts: str, width: str) -> DataFrame:
    """(start, source, n): rows by window and source; with the policy "min" a window closes when every source has passed it by its lag."""
    return feed.groupBy(F.window(ts, width), "source").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "source", "n")


def _marks(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """(source, seen): the newest time of each source over the batches before one; batches that ran twice count once."""
    if before <= 0:
        return None
    rows = spark.read.schema("source string, seen timestamp, batch long").parquet(f"{folder}/marks").where(F.col("batch") < before)
    return rows.groupBy("source").agg(F.max("seen").alias("seen"))


def keep_late(feed: DataFrame, lags: Mapping[str, str], ts: str, width: str, folder: str):
    """A writer of the rows that come when their window is closed already (all sources have passed its end by their lag) to folder/late, by batch.
    It keeps the newest time of each source by batch, as the engine's watermark does, so that a batch that runs again after a crash finds the same
    rows. Start it on the trigger and source options of the windows' own stream, so that both see the same batches."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        marks = _marks(spark, folder, number)
        late = batch.limit(0)
        if marks is not None:
            lag = F.create_map(*(x for k, v in lags.items() for x in (F.lit(k), F.lit(int(_seconds(v) * 1e6)).cast("long"))))
            passed = marks.select((F.unix_micros("seen") - F.element_at(lag, F.col("source"))).alias("at"))
            ends = passed.agg(F.min("at").alias("_closed"), F.count("*").alias("_n")).where(F.col("_n") == len(lags))  # one row; none while a source is silent
            windows = batch.withColumn("_end", F.window(ts, width)["end"])
            late = windows.join(F.broadcast(ends), F.unix_micros("_end") <= F.col("_closed")).select(batch.columns)
        late.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        batch.groupBy("source").agg(F.max(ts).alias("seen")).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")
        batch.unpersist()

    return feed.writeStream.foreachBatch(write)


def _seconds(interval: str) -> float:
    import pandas as pd

    return pd.Timedelta(interval).total_seconds()


def silent_sources(newest: DataFrame, lags: Mapping[str, str], patience: str) -> DataFrame:
    """(source, seen, behind_s): sources that hold the others back: those never seen, and those whose newest time less their lag is further behind that
    of the most advanced one than `patience`. newest: (source, seen)."""
    spark = newest.sparkSession
    named = spark.createDataFrame([(k, float(_seconds(v))) for k, v in lags.items()], "source string, lag double")
    marks = named.join(newest, "source", "left").withColumn("_at", F.unix_micros("seen") / 1e6 - F.col("lag"))
    first = marks.agg(F.max("_at").alias("_first"))  # one row
    behind = F.col("_first") - F.col("_at")
    return marks.join(F.broadcast(first)).select("source", "seen", behind.alias("behind_s")).where(F.col("seen").isNull() | (F.col("behind_s") > _seconds(patience)))
