"""Which torrents need metadata, and what to decide about each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelloom.functions.names import normalized_title, parse_release_name, titles_match, years_match
from reelloom.functions.scalars import is_imdb_id, truncated_error
from reelloom.operators.merge import first_of_each, keep, merge, overwrite

RETRY_SECONDS = 6 * 3600
# Words that mark a name as media.
MEDIA_WORDS = r"(?i)\b(2160p|1080p|720p|480p|web[-._ ]?dl|webrip|bluray|brrip|hdtv|s[0-9]{1,2}e[0-9]{1,3})\b"


def classification_order() -> list[Column]:
    """IMDb ids first, then known types, then the latest; a missing id or type
    ranks before either, as in the catalogue."""
    return [
        F.col("content_id").rlike("^tt[0-9]{5,}$").desc_nulls_first(),
        F.col("content_type").isin("movie", "tv_show").desc_nulls_first(),
        F.col("updated_at").desc_nulls_first(),
        F.col("content_source").asc_nulls_last(),
        F.col("content_id").asc_nulls_last(),
    ]


def worklist(ingested: DataFrame, torrents: DataFrame, links: DataFrame, attempts: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Torrents to look up, by urgency, one row per ingesting source.

    A torrent qualifies if it was never tried or failed ``RETRY_SECONDS`` ago,
    has a size, and is media by its type, a resolution or its name.
    """
    best = first_of_each(links, ["info_hash"], classification_order()).select(
        "info_hash", "content_type", F.when(is_imdb_id(F.col("content_id")), F.col("content_id")).alias("external_id")
    )
    sharp = links.where("video_resolution is not null").select("info_hash").distinct().withColumn("sharp", F.lit(True))
    tried = attempts.select("info_hash", "status", "attempted_at")
    again = (F.col("status") == "error") & (F.col("attempted_at") <= as_of - F.make_interval(secs=F.lit(RETRY_SECONDS)))
    typed = F.coalesce(F.col("content_type").isin("movie", "tv_show"), F.lit(False))
    media = typed | F.col("sharp").isNotNull() | F.col("name").rlike(MEDIA_WORDS)
    rows = (
        ingested.join(torrents.where("size > 0"), "info_hash")
        .join(best, "info_hash", "left")
        .join(sharp, "info_hash", "left")
        .join(tried, "info_hash", "left")
        .where((F.col("status").isNull() | again) & media)
        .withColumn("priority", F.when(F.col("external_id").isNotNull(), 0).when(typed, 1).otherwise(2))
    )
    if limit is not None:
        rows = rows.orderBy("priority", F.col("imported_at").desc(), "info_hash", "source").limit(limit)
    return rows.select("info_hash", "source", "name", "content_type", "external_id", "priority", "imported_at")


def attempt_failed(attempts: DataFrame, failures: DataFrame, as_of: Column) -> DataFrame:
    """Attempts after failures (info_hash, torrent_name, status, error): they
    replace name, status and error, cut to 1000 characters, of an earlier
    attempt; what it had parsed stays. One failure per hash."""
    fresh = failures.select("info_hash", "torrent_name", "status", truncated_error(F.col("error")).alias("error"), as_of.alias("attempted_at"))
    return _upserted(attempts, fresh)


def attempt_matched(attempts: DataFrame, matches: DataFrame, as_of: Column) -> DataFrame:
    """Attempts after matches (info_hash, torrent_name, parsed_title,
    parsed_kind, parsed_year, content_type, content_id): these replace all and
    clear the error. One match per hash."""
    fresh = matches.select(
        "info_hash", "torrent_name", "parsed_title", "parsed_kind", "parsed_year", F.lit("matched").alias("status"), F.lit(None).cast("string").alias("error"),
        "content_type", F.lit("tmdb").alias("content_source"), "content_id", as_of.alias("attempted_at"), as_of.alias("matched_at"),
    )
    return _upserted(attempts, fresh)


def _upserted(attempts: DataFrame, fresh: DataFrame) -> DataFrame:
    missing = [F.lit(None).cast(attempts.schema[c].dataType).alias(c) for c in attempts.columns if c not in fresh.columns]
    kept = {c: keep for c in attempts.columns if c not in fresh.columns}
    return merge(attempts, fresh.select("*", *missing), ["info_hash"], kept, default=overwrite)


def decide(candidates: DataFrame, titles: DataFrame) -> DataFrame:
    """(info_hash, status, id) for each candidate (info_hash, name, content_type,
    external_id).

    A known IMDb id decides; else the parsed title is looked up among
    ``titles`` (kind, id, title, year, imdb_id). Without a title the status is
    unparsed, without a work no_match; of several works the least id is taken.
    Titles are compared where they are equal or share their first eight
    characters, so the lookup is a join on equal values.
    """
    parsed = candidates.withColumn("p", parse_release_name(F.col("name"), F.col("content_type")))
    exact = parsed.join(titles.select("imdb_id", F.col("id").alias("by_imdb")).where("imdb_id is not null"), F.col("external_id") == F.col("imdb_id"), "left")
    asked = exact.where("by_imdb is null and p.title is not null").select("info_hash", "p").distinct()
    found = title_matches(asked.select("info_hash", F.col("p.kind").alias("kind"), F.col("p.title").alias("title"), F.col("p.year").alias("year")), titles)
    best = found.groupBy("info_hash").agg(F.min("id").alias("by_title"))
    chosen = exact.join(best, "info_hash", "left")
    status = (
        F.when(F.col("by_imdb").isNotNull() | F.col("by_title").isNotNull(), F.lit("matched"))
        .when(F.col("p.title").isNull(), F.lit("unparsed"))
        .otherwise(F.lit("no_match"))
    )
    return chosen.groupBy("info_hash").agg(F.min(status).alias("status"), F.min(F.coalesce("by_imdb", "by_title")).alias("id"))


def title_matches(wanted: DataFrame, titles: DataFrame) -> DataFrame:
    """(info_hash, id): works whose title equals or holds the wanted one, or is
    held by it, of the same kind and within a year.

    Containment of eight characters or more shares a run of eight, so both
    sides are keyed by such runs: any run of the shorter one is one of the
    longer one's. That makes the test an equality join; of the shorter one's
    runs the rarest is taken, so a run that many titles share keys few.
    """
    run = 8
    runs = lambda t: F.when(F.length(t) >= run, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - run + 1), lambda i: F.substring(t, i, F.lit(run))))).otherwise(F.array(t))
    a = wanted.withColumn("plain", normalized_title(F.col("title"))).where("plain <> ''")
    b = titles.select("kind", "id", F.col("title").alias("found"), F.col("year").alias("found_year"))
    b = b.withColumn("found_plain", normalized_title(F.col("found"))).where("found_plain <> ''")
    every = [t.withColumn("run", F.explode(runs(F.col(c)))) for t, c in ((a, "plain"), (b, "found_plain"))]

    def rarest(short: DataFrame, long: DataFrame, names: list[str]) -> DataFrame:
        held = long.groupBy("kind", "run").agg(F.count(F.lit(1)).alias("n"))
        return short.join(held, ["kind", "run"]).groupBy(*names).agg(F.min_by("run", F.struct("n", "run")).alias("run"))

    one = rarest(every[0], every[1], a.columns).join(every[1], ["kind", "run"])
    two = rarest(every[1], every[0], b.columns).join(every[0], ["kind", "run"])
    pairs = one.unionByName(two).where(titles_match(F.col("title"), F.col("found")) & years_match(F.col("year"), F.col("found_year")))
    return pairs.select("info_hash", "id").distinct()
