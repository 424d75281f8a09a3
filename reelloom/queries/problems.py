"""Queries over the driver's tables, by name, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelloom.operators.snapshot_diff import SnapshotTable, generations_with_rows, snapshot_changes
from reelloom.operators.units import level_shifts, sizes_in_bytes
from reelloom.session import table

CONTENT_KEY = ["content_type", "content_source", "content_id"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = SnapshotTable(
        table(spark, sf_dir, "catalog_snapshot_items"),
        "generation_id",
        CONTENT_KEY,
        exact=["title", "release_year", "overview", "original_language", "poster_path", "backdrop_path"],
        sets=["genres"],
        near={"vote_average": 0.000001},
    )
    torrents = SnapshotTable(
        table(spark, sf_dir, "catalog_snapshot_torrents"),
        "generation_id",
        [*CONTENT_KEY, "info_hash"],
        exact=["torrent_name", "size", "video_resolution", "provider"],
    )
    generations, counts = generations_with_rows(items, torrents)

    def shaped(changes: DataFrame, entity: str) -> DataFrame:
        hashed = F.col("info_hash") if entity == "torrent" else F.lit("")
        return changes.select(
            F.col("generation").cast("bigint").alias("generation_id"),
            F.lit(entity).alias("entity"),
            *CONTENT_KEY,
            hashed.alias("info_hash"),
            "change_kind",
        )

    return shaped(snapshot_changes(items, generations, counts[0]), "item").unionByName(
        shaped(snapshot_changes(torrents, generations, counts[1]), "torrent")
    )


P1_FOUND_SQL = """
WITH gens AS (
  SELECT id, lag(id) OVER (ORDER BY id) AS prev FROM (
    SELECT generation_id AS id FROM catalog_snapshot_items
    UNION SELECT generation_id FROM catalog_snapshot_torrents)
),
items AS (
  SELECT generation_id AS g, content_type AS ct, content_source AS cs, content_id AS ci,
    min(struct_pack(title := title, release_year := release_year, overview := overview,
      original_language := original_language, poster_path := poster_path,
      backdrop_path := backdrop_path, genres := list_sort(list_distinct(genres)))) AS v,
    min(vote_average) AS vote
  FROM catalog_snapshot_items GROUP BY ALL
),
torrents AS (
  SELECT generation_id AS g, content_type AS ct, content_source AS cs, content_id AS ci, info_hash AS h,
    min(struct_pack(torrent_name := torrent_name, size := size, video_resolution := video_resolution,
      provider := provider)) AS v
  FROM catalog_snapshot_torrents GROUP BY ALL
),
item_now AS (SELECT items.*, gens.prev FROM items JOIN gens ON gens.id = items.g WHERE gens.prev IS NOT NULL),
item_before AS (SELECT items.*, gens.id AS next FROM items JOIN gens ON gens.prev = items.g),
torrent_now AS (SELECT torrents.*, gens.prev FROM torrents JOIN gens ON gens.id = torrents.g WHERE gens.prev IS NOT NULL),
torrent_before AS (SELECT torrents.*, gens.id AS next FROM torrents JOIN gens ON gens.prev = torrents.g)
SELECT CAST(coalesce(a.g, b.next) AS BIGINT) AS generation_id, 'item' AS entity,
  coalesce(a.ct, b.ct) AS content_type, coalesce(a.cs, b.cs) AS content_source,
  coalesce(a.ci, b.ci) AS content_id, '' AS info_hash,
  CASE WHEN b.g IS NULL THEN 'added' WHEN a.g IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM item_now a FULL JOIN item_before b ON a.g = b.next AND a.ct = b.ct AND a.cs = b.cs AND a.ci = b.ci
WHERE a.g IS NULL OR b.g IS NULL OR a.v IS DISTINCT FROM b.v OR (a.vote IS DISTINCT FROM b.vote
  AND coalesce(abs(a.vote - b.vote) >= 0.000001, true))
UNION ALL
SELECT CAST(coalesce(a.g, b.next) AS BIGINT), 'torrent',
  coalesce(a.ct, b.ct), coalesce(a.cs, b.cs), coalesce(a.ci, b.ci), coalesce(a.h, b.h),
  CASE WHEN b.g IS NULL THEN 'added' WHEN a.g IS NULL THEN 'removed' ELSE 'changed' END
FROM torrent_now a FULL JOIN torrent_before b
  ON a.g = b.next AND a.ct = b.ct AND a.cs = b.cs AND a.ci = b.ci AND a.h = b.h
WHERE a.g IS NULL OR b.g IS NULL OR a.v IS DISTINCT FROM b.v
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sizes_in_bytes(table(spark, sf_dir, "torrent_records"), table(spark, sf_dir, "torrent_sources"))
    return sizes.where("not stands").select("record_id", "size_bytes")


def p5_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_shifts(table(spark, sf_dir, "torrent_records"), table(spark, sf_dir, "torrent_sources"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p5_found": p5_found,
    "p5_levels": p5_levels,
}

SQL: dict[str, str] = {
    "p1_found": P1_FOUND_SQL,
}
