"""Work repeated at an interval, as streams with a processing-time trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

# Seconds between runs of the collecting jobs.
RECONCILE_SECONDS = 5
SNAPSHOT_SECONDS = 300


def every(spark: SparkSession, seconds: float, step: Callable[[int], None], checkpoint: str, name: str) -> StreamingQuery:
    """A query that calls ``step`` with the run's number at each interval.

    A run that takes longer than the interval skips the ticks it misses. The
    checkpoint keeps the number over restarts; a run that failed is repeated.
    """

    def run(_: DataFrame, number: int) -> None:
        step(number)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return ticks.writeStream.queryName(name).trigger(processingTime=f"{round(seconds * 1000)} milliseconds").option("checkpointLocation", checkpoint).foreachBatch(run).start()


def on_arrival(stream: DataFrame, seconds: float, step: Callable[[DataFrame, int], None], checkpoint: str, name: str) -> StreamingQuery:
    """``step`` with what arrived since the last run, at each interval."""
    return stream.writeStream.queryName(name).trigger(processingTime=f"{round(seconds * 1000)} milliseconds").option("checkpointLocation", checkpoint).foreachBatch(step).start()
