"""Structured Streaming: feeds of detections, scenes and weather.

Functions take and return streaming DataFrames; `available` drives one over all data at hand and returns
what its sink holds. Timestamps are cast from TIMESTAMP_NTZ, which watermarks refuse.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.fire import DC_DAYLENGTH, DC_TROPICS, START, TROPICS, dc_fold
from ..session import shared_folder


def stream(spark: SparkSession, path: str, timestamp: str | None = None) -> DataFrame:
    """A stream of the Parquet files at a path (a folder or one file), with the schema that they have now."""
    now = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(now.schema)
    if any(f.endswith(f"/{name}") for f in now.inputFiles()):  # streams read folders
        reader, path = reader.option("pathGlobFilter", name), folder
    out = reader.parquet(path)
    return out.withColumn(timestamp, F.col(timestamp).cast("timestamp")) if timestamp else out


def available(df: DataFrame, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """Runs a stream over all data there are and returns its result, from files in the shared folder: all that was appended, the latest
    of the updates of each of `keys`, or the complete result of the last batch. Updates let the watermark drop old state, and only what
    changed is written."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{folder}/out").awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{folder}/out")
    if mode == "update":

        def add(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

        writer.foreachBatch(add).start().awaitTermination()
        values = [c for c in df.columns if c not in keys]
        updates = spark.read.schema(StructType([*df.schema, StructField("batch", LongType())])).parquet(f"{folder}/out")
        newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
        return newest.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in values)).select(df.columns)
    last = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        last[:] = [number]

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out/{last[0]}") if last else spark.createDataFrame([], df.schema)


def closed(spark: SparkSession, path: str, ts: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The whole result of an append-mode stream over what there is at a path, its last windows among it: after all data a row far in the
    future moves the watermark past them, as later data would. build: from the feed to windows of which that row's own stays open."""
    folder = shared_folder(spark)
    data = spark.read.parquet(path)
    end = data.agg(F.max(ts).alias("last")).select(F.expr("last + INTERVAL 10 YEARS").cast(data.schema[ts].dataType).alias(ts))
    end = end.select(*(F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in data.schema))
    end.limit(0).write.parquet(f"{folder}/end")
    feed = stream(spark, path, ts).unionByName(stream(spark, f"{folder}/end", ts))
    out = build(feed)
    for k in range(3):  # data, the last row, and a batch that the moved watermark closes windows in
        if k == 1:
            end.coalesce(1).write.mode("append").parquet(f"{folder}/end")
        run = out.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        run.format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def frames(feed: DataFrame, ts: str = "ts", width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and means of tumbling windows. Rows later than `late` are dropped; see lags.py for a feed that keeps them."""
    w = feed.withWatermark(ts, late).groupBy(F.window(ts, width))
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def glow(feed: DataFrame, ts: str = "ts", reach: str = "12 hours", every: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Detections of the last hours at each frame, the latest weighing most: weights fall to 0 over the window. Rows later than
    `late` are dropped."""
    w = feed.withWatermark(ts, late).withColumn("_w", F.window(ts, reach, every))
    span = F.unix_timestamp("_w.end") - F.unix_timestamp("_w.start")
    weight = 1 - (F.unix_timestamp("_w.end") - F.unix_timestamp(ts)) / span
    return w.withColumn("_weight", weight).groupBy("_w").agg(F.count("*").alias("n"), F.sum("_weight").alias("glow")).select(F.col("_w.end").alias("frame"), "n", "glow")


def counters(feed: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts by day and kind; a day is closed `late` after its end, and rows that come later are dropped."""
    return feed.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def sessions(feed: DataFrame, key: str, ts: str = "ts", gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Episodes: runs of detections with no gap longer than `gap`, by key."""
    s = feed.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key)
    return s.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def first_seen(feed: DataFrame, key: list[str], ts: str = "ts", late: str = "60 days") -> DataFrame:
    """Each key once, as scenes of a poll that repeats itself."""
    return feed.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


class DroughtCode(StatefulProcessor):
    """Drought code by cell over days that come in any order. State: the code at a base day, and a log of the days after it, at most `keep` of them.
    A day that comes late is put in its place and the code of every day from it on is given anew, with a higher revision; a day that comes again
    replaces the one before. Days up to the base day can't be folded in any more: they give a row marked late, without a code."""

    def __init__(self, lat: float, keep: int):
        self.lat, self.keep = lat, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", "dc double, day date, revision long")
        self.log = handle.getListState("log", "day date, t double, rain double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        dc, day, revision = self.base.get() if self.base.exists() else (START["dc"], None, 0)
        nan = float("nan")
        number = lambda x: nan if x is None else float(x)
        days = {d: (number(t), number(rain)) for d, t, rain in self.log.get()}
        first, late = None, []
        new = pd.concat(list(rows))
        for d, t, rain in zip(new.day, new.t, new.rain):
            if day is not None and d <= day:
                late.append(d)
            else:
                days[d] = (number(t), number(rain))
                first = d if first is None else min(first, d)
        order, revision = sorted(days), revision + 1
        factors = [DC_TROPICS if abs(self.lat) < TROPICS else DC_DAYLENGTH[d.month - 1] for d in order]
        codes = dc_fold(number(dc), ((*days[d], f) for d, f in zip(order, factors)))
        out = [(key[0], d, x, revision, False) for d, x in zip(order, codes) if first is not None and d >= first] + [(key[0], d, nan, revision, True) for d in late]
        old = max(len(order) - self.keep, 0)
        if old:
            dc, day = codes[old - 1], order[old - 1]
        self.base.update((number(dc), day, revision))
        self.log.put([(d, *days[d]) for d in order[old:]])
        yield pd.DataFrame(out, columns=["cell", "day", "dc", "revision", "late"])

    def close(self) -> None:
        pass


def drought_codes(weather: DataFrame, lat: float = 0.0, keep: int = 40) -> DataFrame:
    """(cell, day, dc, revision, late) from daily weather (cell, day, t, rain), a masked value NULL: the code of each day, given anew with a higher revision
    when an earlier day comes late by up to `keep` days; see DroughtCode. The session's state store must be RocksDB (session.py)."""
    return weather.groupBy("cell").transformWithStateInPandas(DroughtCode(lat, keep), "cell long, day date, dc double, revision long, late boolean", "Append", "None")


def latest_codes(revisions: DataFrame) -> DataFrame:
    """(cell, day, dc): the newest revision of each day that was folded in."""
    newest = revisions.where("NOT late").groupBy("cell", "day").agg(F.max_by(F.struct("dc"), "revision").alias("_last"))
    return newest.select("cell", "day", F.col("_last.dc").alias("dc"))
