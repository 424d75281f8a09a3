"""Streams of observations: repeats, quotas and late targets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is available now to Parquet files under ``path``."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def first_keys(stream: DataFrame, keys: list[str], at: str | None = None, late: str | None = None) -> DataFrame:
    """Each key once. With a time column and a bound on lateness the state is
    dropped once no repeat can come; without, every key is remembered."""
    if at and late:
        return stream.select(*keys, at).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return stream.select(*keys).dropDuplicates(keys)


def admitted(stream: DataFrame, source: str, at: str, ident: str, limit: int, forget_after: float | None = None) -> DataFrame:
    """(ident, source, admitted): the first ``limit`` of each source and clock
    hour, in the order of arrival and, within a batch, of the identifier.

    The state is one counter per source and hour, and memory holds ``limit``
    identifiers of it at most. A spent place stays spent; with ``forget_after``
    an hour is forgotten so many seconds after its last row, by when no more of
    it must come.
    """

    def count(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        free = limit - used
        first = np.empty(0, np.int64)
        for pdf in rows:
            ids = np.sort(np.concatenate([first, pdf["id"].to_numpy()]))
            first, rest = ids[:free], ids[free:]
            yield pd.DataFrame({"id": rest, "source": key[0], "admitted": False})
        yield pd.DataFrame({"id": first, "source": key[0], "admitted": True})
        state.update((used + len(first),))
        if forget_after is not None:
            state.setTimeoutDuration(round(forget_after * 1000))

    hour = F.date_trunc("hour", F.col(at)).cast("string").alias("hour")
    keyed = stream.select(F.col(ident).cast("bigint").alias("id"), F.col(source).cast("string").alias("source"), hour)
    counted = keyed.groupBy("source", "hour").applyInPandasWithState(
        count, "id bigint, source string, admitted boolean", "used bigint", "append",
        GroupStateTimeout.NoTimeout if forget_after is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
    return counted.select(F.col("id").alias(ident), F.col("source").alias(source), "admitted")


def arrived_links(torrents: DataFrame, pending: DataFrame) -> DataFrame:
    """Pending links whose torrent arrives on the stream; the others stay
    staged, since the staged side is read anew with every batch."""
    return torrents.select("info_hash").join(pending, "info_hash")


def ingest(stream: DataFrame, keys: list[str], known: Callable[[], DataFrame], sink: Callable[[DataFrame], None], mark: Callable[[DataFrame], None], checkpoint: str) -> None:
    """Per batch: keep the rows whose key isn't known, give them to the sink,
    and only then mark their keys. A batch that is run again after a failure
    between the two is delivered twice rather than lost."""

    def batch(df: DataFrame, _: int) -> None:
        fresh = df.dropDuplicates(keys).join(known().select(*keys).distinct(), keys, "left_anti").persist()
        try:
            sink(fresh)
            mark(fresh.select(*keys))
        finally:
            fresh.unpersist()

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
