"""Links between torrents and contents as catalogue sources deliver them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelloom.functions.scalars import genre_slug, video_resolution
from reelloom.operators.merge import insert_missing, merge, overwrite
from reelloom.plans.catalog import KEY, resolved

FILE_KEY = ["info_hash", *KEY, "season", "episode"]


def grouped_links(torrents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, files) of the torrents of items.

    ``torrents``: key columns, ordinal, info_hash, quality, seeders, leechers,
    season, episode, file. Per content and hash the peers are the largest, the
    resolution is the first known one, and the season map marks each episode;
    file paths go to a table of their own, the last delivered counts.
    """
    known = video_resolution(F.col("quality"))
    first = F.min_by(known, F.when(known.isNotNull(), F.col("ordinal")))
    placed = F.col("season").isNotNull() & F.col("episode").isNotNull()
    pairs = F.collect_set(F.when(placed, F.struct(F.col("season").cast("string").alias("s"), F.col("episode").cast("string").alias("e"))))
    links = torrents.groupBy("info_hash", *KEY).agg(
        F.max("seeders").alias("seeders"), F.max("leechers").alias("leechers"), first.alias("video_resolution"), pairs.alias("_pairs")
    )
    files = torrents.where(placed & F.col("file").isNotNull()).groupBy(*FILE_KEY).agg(F.max_by("file", "ordinal").alias("file_path"))
    return links.withColumn("episodes", season_map(F.col("_pairs"))).drop("_pairs"), files


def season_map(pairs: Column) -> Column:
    """Map of season to map of episode to true; null without pairs."""
    seasons = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["s"])))
    inner = lambda s: F.map_from_entries(
        F.transform(F.array_sort(F.filter(pairs, lambda p: p["s"] == s)), lambda p: F.struct(p["e"], F.lit("true")))
    )
    return F.when(F.size(pairs) > 0, F.map_from_entries(F.transform(seasons, lambda s: F.struct(s, inner(s)))))


def paths_in_maps(links: DataFrame) -> DataFrame:
    """Rows of the file table that stand in season maps as paths.

    ``episodes`` is JSON text; only objects of objects count, keys must be
    whole numbers in range and values texts that aren't empty.
    """
    rows = links.select("info_hash", *KEY, F.explode(F.from_json("episodes", "map<string,string>")).alias("season", "inner"))
    rows = rows.select("info_hash", *KEY, "season", F.explode(F.from_json("inner", "map<string,string>")).alias("episode", "file_path"))
    whole = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).try_cast("int"))
    return rows.select("info_hash", *KEY, whole("season").alias("season"), whole("episode").alias("episode"), "file_path").where(
        "season is not null and episode >= 1 and file_path <> '' and file_path not in ('true', 'false', 'null')"
    )


def compacted(links: DataFrame) -> DataFrame:
    """Links whose season maps (JSON text) mark episodes only; rows whose map
    is so already, or isn't an object, stay as they are."""
    marks = F.transform_values(
        F.from_json("episodes", "map<string,string>"),
        lambda _, inner: F.transform_values(F.from_json(inner, "map<string,string>"), lambda k, v: F.lit(True)),
    )
    text = F.to_json(F.map_filter(marks, lambda _, m: m.isNotNull()))
    return links.withColumn("episodes", F.when(F.col("episodes").eqNullSafe(text) | text.isNull(), F.col("episodes")).otherwise(text))


def upsert_genres(genres: DataFrame, members: DataFrame, delivered: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(genres, members) after a delivery of genre names.

    ``genres``: source, id, name, updated_at; the latest name of an id wins.
    ``members``: key columns and genre_id; those there are stay.
    ``delivered``: key columns, ordinal and name. Names without an id are left
    out; of equal ids the last delivered name counts.
    """
    rows = delivered.withColumn("genre_id", genre_slug(F.col("name"))).where("genre_id <> ''")
    latest = rows.groupBy(F.col("content_source").alias("source"), F.col("genre_id").alias("id")).agg(F.max_by("name", F.struct("ordinal", "name")).alias("name"))
    named = merge(genres, latest.withColumn("updated_at", as_of), ["source", "id"], {}, default=overwrite)
    return named, insert_missing(members, rows.select(*KEY, "genre_id").distinct(), [*KEY, "genre_id"])


def upsert_files(files: DataFrame, fresh: DataFrame) -> DataFrame:
    """The file table after newer paths replaced older ones."""
    return merge(files, fresh, FILE_KEY, {}, default=overwrite)


def episode_file_maps(files: DataFrame, correlations: DataFrame) -> DataFrame:
    """(info_hash, key columns, episode_files): season maps of file paths by
    canonical content; of several paths the latest counts."""
    latest = resolved(files, correlations).groupBy(*FILE_KEY).agg(F.max_by("file_path", F.struct("updated_at", "file_path")).alias("file_path"))
    text = lambda c: F.col(c).cast("string")
    inner = latest.groupBy("info_hash", *KEY, text("season").alias("season")).agg(
        F.map_from_entries(F.collect_list(F.struct(text("episode"), "file_path"))).alias("m")
    )
    return inner.groupBy("info_hash", *KEY).agg(F.map_from_entries(F.collect_list(F.struct("season", "m"))).alias("episode_files"))
