"""The catalogue's functions for callers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelloom.functions.infohash import hash_of_delivery
from reelloom.functions.text import non_blank
from reelloom.operators.merge import insert_missing, unseen
from reelloom.plans import correlate, enrich
from reelloom.plans.catalog import (
    SnapshotStore,
    browse_page,
    catalogue_documents,
    resolve_show,
    show_documents,
    show_episodes,
    show_torrents,
    snapshot_items,
    snapshot_summary,
    snapshot_torrents,
)


@dataclass
class Tables:
    """The live tables."""

    contents: DataFrame  # type, source, id, title, release_year, adult, overview, ...
    attributes: DataFrame  # key columns, source, key, value
    genres: DataFrame  # key columns, name
    torrents: DataFrame  # info_hash, name, size
    links: DataFrame  # info_hash, key columns, seeders, leechers, video_resolution, episodes, created_at, updated_at
    torrent_links: DataFrame  # info_hash, source
    sources: DataFrame  # key, name
    correlations: DataFrame  # key columns, canonical key columns, evidence


def valid_records(observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of observations: source, info_hash, name, size.

    A record has a source, a name and a hash; a bad or missing size is 0.
    """
    rows = observed.select(
        non_blank(F.col("source")).alias("source"), hash_of_delivery(F.col("info_hash")).alias("hash"), non_blank(F.col("name")).alias("name"),
        F.greatest(F.lit(0), F.coalesce(F.col("size").try_cast("bigint"), F.lit(0))).alias("size"), F.col("info_hash").alias("raw"),
    )
    good = F.col("source").isNotNull() & F.col("hash").isNotNull() & F.col("name").isNotNull()
    return rows.where(good).select("source", F.col("hash").alias("info_hash"), "name", "size"), rows.where(~good)


def ingest(observed: DataFrame, ingested: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(new records, ingested keys after them)."""
    records, _ = valid_records(observed)
    fresh = unseen(records, ingested, ["source", "info_hash"])
    marked = fresh.select("source", "info_hash").distinct().withColumn("imported_at", as_of)
    return fresh, insert_missing(ingested, marked, ["source", "info_hash"])


def import_payload(records: DataFrame) -> DataFrame:
    """One JSON line per record, for the importer."""
    return records.select(F.to_json(F.struct("source", F.col("info_hash").alias("infoHash"), "name", "size")).alias("value"))


def correlations_of(t: Tables) -> DataFrame:
    """Correlations after repair from shared torrents and external ids."""
    shared = correlate.ignore_known(t.correlations, correlate.repair_shared(t.links))
    return correlate.upgrade(shared, correlate.repair_exact(t.contents, t.attributes, t.links))


def build_snapshot(t: Tables, store: SnapshotStore) -> int:
    """Publish a new generation; its number."""
    rows = snapshot_torrents(t.links, t.correlations, t.contents, t.torrents, t.torrent_links, t.sources)
    return store.publish(snapshot_items(rows, t.contents, t.attributes, t.genres), rows)


def browse(store: SnapshotStore, spark, **choice) -> DataFrame:
    """JSON documents of a page; choices as in ``browse_page``."""
    return catalogue_documents(browse_page(store.read(spark, "items"), store.read(spark, "torrents"), **choice)).orderBy("page_rank")


def stats(store: SnapshotStore, spark) -> DataFrame:
    return snapshot_summary(store.read(spark, "items"), store.read(spark, "torrents"))


def show_detail(t: Tables, files: DataFrame, asked: str) -> tuple[DataFrame, DataFrame] | None:
    """(torrents, episodes) of the show an identity means; None if there is none."""
    found = resolve_show(t.contents, t.attributes, t.correlations, asked).first()  # at most one
    if found is None:
        return None
    rows = show_torrents(t.links, t.correlations, t.torrents, t.torrent_links, t.sources, found.source, found.id)
    return rows, show_episodes(rows, files)


def show_document(t: Tables, files: DataFrame, asked: str) -> str | None:
    """The JSON of the show an identity means; None if there is none."""
    found = show_detail(t, files, asked)
    if found is None:
        return None
    show = resolve_show(t.contents, t.attributes, t.correlations, asked).first()  # at most one
    spark = files.sparkSession
    shows = spark.createDataFrame([(show.source, show.id, show.title)], "content_source string, content_id string, title string")
    rows = found[0].withColumn("content_source", F.lit(show.source)).withColumn("content_id", F.lit(show.id))
    return show_documents(shows, rows, files).first().document  # one show


def worklist(t: Tables, ingested: DataFrame, attempts: DataFrame, as_of: Column, limit: int = 100) -> DataFrame:
    """Torrents to look up next."""
    return enrich.worklist(ingested, t.torrents, t.links, attempts, as_of, limit)


def accept_matches(t: Tables, matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, correlations, rejected matches) after matches (info_hash,
    content_type, tmdb_id, imdb_id) whose aliases don't conflict."""
    bound = correlate.match_aliases(matches, t.contents, t.attributes, t.links)
    rejected = correlate.conflicting(bound, t.correlations)
    keys = ["info_hash", "content_type", "tmdb_id"]
    accepted = bound.join(rejected, keys, "left_anti")
    found = accepted.select(
        "content_type", "content_source", "content_id", F.col("content_type").alias("canonical_type"), F.lit("tmdb").alias("canonical_source"),
        F.col("tmdb_id").alias("canonical_id"), F.col("info_hash").alias("evidence_info_hash"), "evidence_kind",
    )
    links = correlate.attach_canonical(t.links, matches.join(rejected, keys, "left_anti"))
    return links, correlate.renew(t.correlations, correlate.unambiguous(found)), rejected
