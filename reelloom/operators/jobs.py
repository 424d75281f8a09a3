"""Jobs that search sources on request: a queue as a small table.

Every transition is a function from a table to the next one; the caller
writes the result as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelloom.functions.scalars import INT_MAX, truncated_error
from reelloom.operators.pacing import hourly_quota

# Most items of a search, and of an immediate batch.
SEARCH_LIMIT = 1000
BATCH = 250


def claimed(jobs: DataFrame, as_of: Column) -> tuple[DataFrame, int | None]:
    """(jobs, id) after the queued job of the smallest id was started."""
    first = jobs.where("status = 'queued'").agg(F.min("id")).first()[0]
    if first is None:
        return jobs, None
    mine = F.col("id") == first
    change = {"status": F.lit("running"), "phase": F.lit("searching"), "started_at": as_of, "finished_at": F.lit(None), "error": F.lit(None)}
    return jobs.withColumns({c: F.when(mine, v).otherwise(F.col(c)).cast(jobs.schema[c].dataType) for c, v in change.items()}), first


def requeued(jobs: DataFrame) -> DataFrame:
    """Jobs after those that were running when the worker ended wait again."""
    running = F.col("status") == "running"
    change = {"status": F.lit("queued"), "phase": F.lit("queued"), "started_at": F.lit(None)}
    return jobs.withColumns({c: F.when(running, v).otherwise(F.col(c)).cast(jobs.schema[c].dataType) for c, v in change.items()})


def in_phase(jobs: DataFrame, job: int, phase: str) -> DataFrame:
    """A running job's phase set."""
    mine = (F.col("id") == job) & (F.col("status") == "running")
    return jobs.withColumn("phase", F.when(mine, F.lit(phase)).otherwise(F.col("phase")))


def finished(jobs: DataFrame, totals: DataFrame, as_of: Column) -> DataFrame:
    """Jobs with the totals (id, counters, status, error) of those that ended."""
    ended = totals.withColumn("error", truncated_error(F.col("error"))).select("id", F.struct(*[c for c in totals.columns if c != "id"]).alias("t"))
    rows = jobs.join(ended, "id", "left")
    change = {c: F.col("t")[c] for c in totals.columns if c != "id"} | {"finished_at": as_of, "phase": F.lit("finished")}
    return rows.withColumns({c: F.when(F.col("t").isNotNull(), v).otherwise(F.col(c)).cast(jobs.schema[c].dataType) for c, v in change.items()}).select(*jobs.columns)


def recent(jobs: DataFrame, n: int = 50) -> DataFrame:
    return jobs.orderBy(F.col("id").desc()).limit(n)


def source_progress(fetched: Column, skipped: Column, unseen: Column, limit: int = SEARCH_LIMIT) -> Column:
    """Struct (fetched, skipped, saturated): what a source's page adds."""
    held = lambda c: F.least(c, F.lit(INT_MAX)).cast("int")
    return F.struct(held(fetched).alias("fetched"), held(skipped + fetched - unseen).alias("skipped"), (fetched >= limit).alias("saturated"))


def immediate_batch(records: DataFrame, order: list[Column], batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(now, later): one record per hash, the first ``batch`` by ``order`` and the rest."""
    first = records.groupBy("info_hash").agg(F.min(F.struct(*[c for c in records.columns if c != "info_hash"])).alias("v")).select("info_hash", "v.*")
    now = first.orderBy(*order).limit(batch)
    return now, first.join(now.select("info_hash"), "info_hash", "left_anti")


def select_feed(items: DataFrame, year: int | None = None, search: str | None = None, limit: int | None = None) -> DataFrame:
    """Items a feed request asks for: recent ones, those of a year, or those
    whose name holds every word of a search; at most ``limit``, the newest first."""
    rows = items
    if year is not None:
        rows = rows.where(F.col("name").rlike(rf"\b{year}\b"))
    for word in (search or "").lower().split():
        rows = rows.where(F.lower("name").contains(word))
    return rows if limit is None else rows.orderBy(F.col("published_at").desc_nulls_last(), "info_hash").limit(limit)


def resolutions(pending: DataFrame, cache: DataFrame, order: list[Column], limit: int = 50) -> DataFrame:
    """``pending`` (source, locator, at) with ``outcome``: cached ones don't
    count, of the others the first ``limit`` of a source and hour are
    admitted, the rest deferred. ``cache``: source, locator, info_hash."""
    known = pending.join(cache, ["source", "locator"], "left")
    hits = known.where("info_hash is not null").withColumn("outcome", F.lit("cached"))
    misses = hourly_quota(known.where("info_hash is null"), "source", "at", order, limit)
    outcome = F.when(F.col("admitted"), F.lit("admitted")).otherwise(F.lit("deferred"))
    return hits.unionByName(misses.withColumn("outcome", outcome).drop("admitted"))
