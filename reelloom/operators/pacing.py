"""Quotas, repeats, checkpoints and counters of the collecting jobs."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelloom.functions.scalars import saturated

# Fixed value: equal pages in a row after which a walk ends.
MAX_REPEATED_PAGES = 2


def hourly_quota(df: DataFrame, source: str, at: str, order: list[Column], limit: int) -> DataFrame:
    """Rows with ``admitted``: the first ``limit`` of each source and clock hour.

    Ranks are needed only up to the limit, so each group is cut to its first
    rows by hour before the rest join as deferred.
    """
    window = Window.partitionBy(source, F.date_trunc("hour", at)).orderBy(*order)
    return df.withColumn("admitted", F.row_number().over(window) <= limit)


def repeat_counts(pages: DataFrame, partition: str, ordinal: str, fingerprint: str, empty: Column) -> DataFrame:
    """How often a page repeats the one before it, in a row; an empty page and
    a new fingerprint start at zero."""
    window = Window.partitionBy(partition).orderBy(ordinal)
    same = F.col(fingerprint).eqNullSafe(F.lag(fingerprint).over(window)) & F.col(fingerprint).isNotNull() & ~empty
    rows = pages.withColumn("_same", F.coalesce(same, F.lit(False)).cast("int"))
    rows = rows.withColumn("_run", F.sum(1 - F.col("_same")).over(window))
    counted = Window.partitionBy(partition, "_run").orderBy(ordinal)
    return rows.withColumn("repeated_pages", F.sum("_same").over(counted).cast("int")).drop("_same", "_run")


def page_fingerprint(identities: Column) -> Column:
    """Digest of a set of identities that doesn't depend on their order: each
    is preceded by its length as eight bytes, most significant first."""
    framed = F.transform(
        F.array_sort(identities),
        lambda i: F.concat(F.lpad(F.lower(F.hex(F.octet_length(i))), 16, "0"), F.lower(F.hex(i))),
    )
    return F.sha2(F.unhex(F.array_join(framed, "")), 256)


@dataclass(frozen=True)
class BackfillState:
    """Where the walk back through the years of one source stands."""

    next_year: int
    min_year: int
    last_fingerprint: str | None = None
    repeated_pages: int = 0
    completed: bool = False


def backfill_step(state: BackfillState, records: int, fingerprint: str | None, deferred: int) -> BackfillState:
    """State after a year's page. With deferred work the year is tried again."""
    if records == 0:
        repeated = 0
    elif state.last_fingerprint is not None and state.last_fingerprint == fingerprint:
        repeated = state.repeated_pages + 1
    else:
        repeated = 0
    if deferred:
        return state
    done = state.next_year <= state.min_year or repeated >= MAX_REPEATED_PAGES
    kept = fingerprint if records else state.last_fingerprint
    return BackfillState(state.next_year - 1, state.min_year, kept, repeated, done)


def backfill_walks(states: DataFrame, attempts: DataFrame) -> DataFrame:
    """Where each source's walk stands after its attempts.

    ``states``: source, next_year, min_year; ``attempts``: source, attempt,
    records, fingerprint, deferred, in order of attempt. Attempts after the
    walk is complete don't count. A source has few attempts: one per year and
    retry.
    """

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for source, following, least in zip(left["source"], left["next_year"], left["min_year"]):
            state = BackfillState(int(following), int(least))
            for records, fingerprint, deferred in right.sort_values("attempt")[["records", "fingerprint", "deferred"]].itertuples(index=False):
                if state.completed:
                    break
                state = backfill_step(state, int(records), fingerprint, int(deferred))
            out.append((source, state.next_year, state.last_fingerprint, state.repeated_pages, state.completed))
        return pd.DataFrame(out, columns=["source", "next_year", "last_fingerprint", "repeated_pages", "completed"])

    schema = "source string, next_year int, last_fingerprint string, repeated_pages int, completed boolean"
    return states.groupBy("source").cogroup(attempts.groupBy("source")).applyInPandas(walk, schema)


def reopened(state: BackfillState, min_year: int) -> BackfillState:
    """The earliest wanted year only falls; a completed walk then goes on."""
    if min_year < state.min_year:
        return replace(state, min_year=min_year, completed=False)
    return state


def advance_cursor(states: DataFrame, source: str, expected: int, following: int, completed: bool) -> DataFrame:
    """The state table with one cursor moved; an error unless exactly one row
    has the source and the expected page."""
    hit = (F.col("source") == source) & (F.col("next_page") == expected) & ~F.col("completed")
    found = states.where(hit).count()
    if found != 1:
        raise ValueError(f"cursor of {source} isn't at {expected}: {found} rows")
    moved = {"next_page": F.lit(following), "completed": F.lit(completed)}
    return states.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in moved.items()})


def least_advanced(states: DataFrame, group: str) -> DataFrame:
    """Of each group the open partition with the smallest next page, the first
    listed of equals."""
    return (
        states.where(~F.col("completed"))
        .groupBy(group)
        .agg(F.min_by("kind", F.struct("next_page", "ordinal")).alias("kind"), F.min("next_page").alias("next_page"))
    )


def job_totals(sources: DataFrame, job: str, counters: list[str]) -> DataFrame:
    """Sums of the counters of each job, held at the largest int."""
    return sources.groupBy(job).agg(*[saturated(F.sum(F.coalesce(c, F.lit(0)))).alias(c) for c in counters])


def job_status(source_failures: Column, sources: Column, failed: Column, deferred: Column, saturated_sources: Column) -> Column:
    """``failed`` if every source failed; ``partial`` if anything failed, was
    deferred or reached its limit; else ``completed``."""
    return (
        F.when(source_failures >= sources, F.lit("failed"))
        .when((failed > 0) | (deferred > 0) | (saturated_sources > 0), F.lit("partial"))
        .otherwise(F.lit("completed"))
    )
