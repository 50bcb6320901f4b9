"""Jobs that may be asked for again and again, but are submitted once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def known_jobs(spark: SparkSession, ledger: str) -> DataFrame:
    """(name, batch) of what was submitted so far."""
    try:
        return spark.read.schema("name string, batch long").parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "name string, batch long")


def submit(jobs: DataFrame, ledger: str, batch: int, send: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Submits those of `jobs` (name, ...) whose name no earlier batch submitted, and returns them. A batch that is run again finds its own
    part of the ledger and rewrites it, so a crash between sending and recording repeats at most that batch."""
    spark = jobs.sparkSession
    earlier = known_jobs(spark, ledger).where(F.col("batch") != batch).select("name").distinct()
    fresh = jobs.dropDuplicates(["name"]).join(earlier, "name", "left_anti")
    if send is not None:
        send(fresh)
    fresh.select("name").write.mode("overwrite").parquet(f"{ledger}/batch={batch}")
    return fresh


def submitting(requests: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Submits a stream of requests (name, ...) once each."""
    return requests.writeStream.foreachBatch(lambda df, k: submit(df, ledger, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
