"""Building and reading the published catalogue.

Contents are keyed by (type, source, id). An alias has one correlation to a
canonical content; resolution is one hop, and an alias never shows in a
snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelloom.functions.scalars import (
    clamp_rating,
    episode_of_path,
    image_url,
    magnet_link,
    non_negative,
    normalized_quality,
)
from reelloom.operators import fulltext
from reelloom.operators.merge import merge_episodes
from reelloom.session import remove_path

KEY = ["content_type", "content_source", "content_id"]
# Contents of a page, and where relative picture paths lead.
PAGE_SIZE = 50
POSTERS, BACKDROPS = "https://image.tmdb.org/t/p/w500", "https://image.tmdb.org/t/p/w1280"
# The orders of browse pages; every order ends in the content's key.
SORTS = {
    "trending": ("popularity-", "activity_at-", "title"),
    "popularity": ("popularity-", "activity_at-", "title"),
    "updated": ("activity_at-", "popularity-", "title"),
    "last added": ("added_at-", "popularity-", "title"),
    "year": ("release_year-", "popularity-", "title"),
    "title": ("title", "release_year-"),
    "name": ("title", "release_year-"),
    "rating": ("vote_average-", "popularity-", "title"),
}


def sort_columns(sort: str | None) -> list[Column]:
    """The order of a sort name, in any case; trending for an unknown one."""
    names = SORTS.get((sort or "").lower(), SORTS["trending"])
    fall = lambda n: F.col(n[:-1]).desc_nulls_last() if n.endswith("-") else F.col(n).asc_nulls_last()
    return [*map(fall, names), F.col("content_source").asc(), F.col("content_id").asc()]


def resolved(links: DataFrame, correlations: DataFrame) -> DataFrame:
    """Links with their content's key replaced by the canonical one, if any."""
    canonical = correlations.select(*KEY, "canonical_type", "canonical_source", "canonical_id")
    own = [c for c in links.columns if c not in KEY]
    return links.join(canonical, KEY, "left").select(
        *own,
        F.coalesce("canonical_type", "content_type").alias("content_type"),
        F.coalesce("canonical_source", "content_source").alias("content_source"),
        F.coalesce("canonical_id", "content_id").alias("content_id"),
    )


def latest_value(value: str, at: str) -> Column:
    """The value of the latest row that has one; of equal times the largest value."""
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(F.col(at), F.col(value))))


def provider_names(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(info_hash, provider): distinct names in order, joined by commas."""
    named = links.join(sources.select(F.col("key").alias("source"), F.col("name").alias("provider_name")), "source")
    return named.groupBy("info_hash").agg(F.array_join(F.array_sort(F.collect_set("provider_name")), ", ").alias("provider"))


def snapshot_torrents(
    links: DataFrame, correlations: DataFrame, contents: DataFrame, torrents: DataFrame, torrent_links: DataFrame, sources: DataFrame
) -> DataFrame:
    """One row per canonical content and torrent: peers at their largest, the
    latest known resolution, first and last times, provider names or DHT.

    Contents that are aliases or for adults don't show. Links have a row per
    torrent and content, so they are grouped once, after aliases are resolved;
    the joins that follow move grouped rows only.
    """
    known = links.where(F.col("content_type").isin("movie", "tv_show") & F.col("content_source").isNotNull() & F.col("content_id").isNotNull())
    grouped = (
        resolved(known, correlations)
        .groupBy("info_hash", *KEY)
        .agg(
            latest_value("video_resolution", "updated_at").alias("video_resolution"),
            F.max("seeders").alias("seeders"),
            F.max("leechers").alias("leechers"),
            F.min("created_at").alias("created_at"),
            F.max("updated_at").alias("updated_at"),
        )
    )
    shown = (
        contents.where(~F.col("adult").eqNullSafe(F.lit(True)))
        .select(F.col("type").alias("content_type"), F.col("source").alias("content_source"), F.col("id").alias("content_id"))
        .join(correlations.select(*KEY), KEY, "left_anti")
    )
    named = torrents.select("info_hash", F.col("name").alias("torrent_name"), "size")
    return (
        grouped.join(shown, KEY)
        .join(named, "info_hash")
        .join(provider_names(torrent_links, sources), "info_hash", "left")
        .select(
            *KEY, "info_hash", "torrent_name", "size", "video_resolution", "seeders", "leechers",
            F.coalesce("provider", F.lit("DHT")).alias("provider"), "created_at", "updated_at",
        )
    )


def snapshot_items(snapshot: DataFrame, contents: DataFrame, attributes: DataFrame, genres: DataFrame) -> DataFrame:
    """One row per content with a torrent: its fields, own picture paths,
    sorted genres, first and last times of its torrents.

    ``attributes``: key columns, source, key, value; ``genres``: key columns, name.
    """
    times = snapshot.groupBy(*KEY).agg(F.max("updated_at").alias("activity_at"), F.min("created_at").alias("added_at"))
    own = attributes.where(F.col("source") == F.col("content_source"))
    pictures = own.groupBy(*KEY).agg(
        F.min(F.when(F.col("key") == "poster_path", F.col("value"))).alias("poster_path"),
        F.min(F.when(F.col("key") == "backdrop_path", F.col("value"))).alias("backdrop_path"),
    )
    names = genres.groupBy(*KEY).agg(F.array_sort(F.collect_list("name")).alias("genres"))
    none = F.array().cast("array<string>")
    fields = contents.select(
        F.col("type").alias("content_type"), F.col("source").alias("content_source"), F.col("id").alias("content_id"),
        "title", "release_year", "overview", "vote_average", "popularity", "original_language",
    )
    return (
        times.join(fields, KEY)
        .join(pictures, KEY, "left")
        .join(names, KEY, "left")
        .withColumn("genres", F.coalesce("genres", none))
        .withColumn("normalized_genres", F.array_sort(F.transform("genres", F.lower)))
    )


def snapshot_summary(items: DataFrame, torrents: DataFrame) -> DataFrame:
    """Films, shows and distinct torrents in one pass over both tables."""
    none = F.lit(None).cast("string")
    rows = items.select("content_type", none.alias("info_hash")).unionByName(torrents.select(none.alias("content_type"), "info_hash"))
    return rows.agg(
        F.count_if(F.col("content_type") == "movie").alias("movies"),
        F.count_if(F.col("content_type") == "tv_show").alias("shows"),
        F.count_distinct("info_hash").alias("torrents"),
    )


def browse_page(
    items: DataFrame,
    torrents: DataFrame,
    kind: str = "movie",
    sort: str | None = None,
    page: int = 1,
    genre: str | None = None,
    keywords: str | None = None,
) -> DataFrame:
    """Torrent rows of one page of contents, with ``page_rank``, in the order
    of ``page_order``.

    ``kind`` is movie, series or anime. The page is cut by contents before
    their torrents join, so the join sees ``PAGE_SIZE`` contents. Page 0 is
    empty. Blank genre and keywords don't filter.
    """
    rows = items.where(F.col("content_type") == ("movie" if kind == "movie" else "tv_show"))
    japanese = (F.col("original_language") == "ja") & F.array_contains("normalized_genres", "animation")
    if kind == "anime":
        rows = rows.where(japanese)
    elif kind == "series":
        rows = rows.where(~japanese)
    if (genre or "").strip():
        rows = rows.where(F.array_contains("normalized_genres", genre.strip().lower()))
    if (keywords or "").strip():
        rows = rows.where(fulltext.matches(fulltext.tokens(F.col("title")), keywords))
    order = sort_columns(sort)
    chosen = rows.orderBy(*order).offset(max(0, page - 1) * PAGE_SIZE).limit(PAGE_SIZE if page > 0 else 0)
    ranked = chosen.withColumn("page_rank", F.row_number().over(Window.orderBy(*order)))  # one page
    links = torrents.select(*KEY, "info_hash", "torrent_name", "size", "video_resolution", "seeders", "leechers", "provider")
    return F.broadcast(ranked).join(links, KEY).orderBy(*page_order())


def torrent_order() -> list[Column]:
    return [F.col("seeders").desc_nulls_last(), F.col("torrent_name"), F.col("info_hash")]


def page_order() -> list[Column]:
    """The order of a page's rows: contents by rank, their torrents by seeders."""
    return [F.col("page_rank"), *torrent_order()]


def quality_keys(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``quality_key``: the quality, with -2, -3 and so on for further rows of it."""
    quality = normalized_quality(F.col("video_resolution"))
    window = Window.partitionBy(*group, "quality").orderBy(*order)
    place = F.row_number().over(window)
    return (
        rows.withColumn("quality", quality)
        .withColumn("_place", place)
        .withColumn("quality_key", F.when(F.col("_place") == 1, F.col("quality")).otherwise(F.concat_ws("-", "quality", "_place")))
        .drop("_place")
    )


def _torrent_fields() -> list[Column]:
    return [
        F.col("provider"), F.col("quality"), non_negative(F.col("seeders")).alias("seeds"), non_negative(F.col("leechers")).alias("peers"),
        F.col("size"), magnet_link(F.col("info_hash")).alias("url"), F.col("torrent_name").alias("name"),
    ]


def show_documents(shows: DataFrame, rows: DataFrame, files: DataFrame) -> DataFrame:
    """(content_source, content_id, document): the JSON of each show's detail.

    ``shows``: content_source, content_id, title; ``rows``: these keys and the
    torrents' columns with their season maps; ``files`` as in
    ``show_episodes``. Episodes come in order of season and number; a show
    without any has an empty list.
    """
    key = ["content_source", "content_id"]
    torrents = rows.drop("episodes", "episode_files")
    # One season map per torrent and show.
    maps = rows.withColumn("info_hash", F.struct("info_hash", *key))
    listed = show_episodes(maps, files.join(rows.select("info_hash", *key).distinct(), "info_hash").withColumn("info_hash", F.struct("info_hash", *key)))
    episodes = listed.select("info_hash.*", "season", "episode", "file").distinct().join(torrents, ["info_hash", *key])
    place = [*key, "season", "episode"]
    keyed = quality_keys(episodes, place, [*torrent_order(), F.col("file")])
    torrent = F.struct(*_torrent_fields(), F.col("file"))
    by_episode = keyed.groupBy(*place).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("quality_key", torrent)))).alias("torrents"))
    episode = F.struct("season", "episode", F.concat(F.lit("Episode "), F.col("episode")).alias("title"), F.lit("").alias("overview"), "torrents")
    # Seasons and numbers are in range, so a show has a bounded list; maps can't be sorted, so the place is.
    entry = F.struct(F.struct("season", "episode").alias("at"), F.to_json(episode).alias("text"))
    by_show = by_episode.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("episodes"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("episodes", F.array().cast("array<struct<at:struct<season:int,episode:int>,text:string>>")), lambda e: e["text"]), ","), F.lit("]"))
    head = F.to_json(F.struct(F.concat_ws(".", *key).alias("_id"), "title"))
    document = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"episodes":'), listed, F.lit("}"))
    return shows.join(by_show, key, "left").select(*key, document.alias("document"))


def catalogue_documents(page: DataFrame) -> DataFrame:
    """(page_rank, document): the JSON of each content of a browse page."""
    keyed = quality_keys(page, KEY, torrent_order())
    torrent = F.struct(*_torrent_fields())
    grouped = keyed.groupBy("page_rank", *KEY, "title", "release_year", "overview", "vote_average", "poster_path", "backdrop_path", "genres").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("quality_key", torrent)))).alias("torrents")
    )
    document = F.struct(
        F.concat_ws(".", "content_source", "content_id").alias("_id"),
        "title",
        F.col("release_year").alias("year"),
        F.coalesce("overview", F.lit("")).alias("synopsis"),
        clamp_rating(F.col("vote_average")).alias("rating"),
        F.struct(image_url(POSTERS, F.col("poster_path")).alias("poster"), image_url(BACKDROPS, F.col("backdrop_path")).alias("fanart")).alias("images"),
        "genres",
        F.when(F.col("content_type") == "movie", F.lit("movie")).otherwise(F.lit("show")).alias("type"),
        F.create_map(F.lit("en"), F.col("torrents")).alias("torrents"),
    )
    return grouped.select("page_rank", F.to_json(document).alias("document"))


def resolve_show(contents: DataFrame, attributes: DataFrame, correlations: DataFrame, asked: str) -> DataFrame:
    """The show an identity means: at most one row (source, id, title).

    ``source.id`` names a content; without a dot, an IMDb id given by an
    attribute comes before a bare id. One hop leads to the canonical content;
    the canonical source is preferred.
    """
    shows = contents.where(F.col("type") == "tv_show").select(*[F.col(a).alias(b) for a, b in zip(("type", "source", "id"), KEY)], "title")
    source, dot, rest = asked.partition(".")
    if dot:
        found = shows.where((F.col("content_source") == source) & (F.col("content_id") == rest)).select(*KEY, F.lit(0).alias("priority"))
    else:
        imdb = ((F.col("source") == "tmdb") & (F.col("key") == "imdb_id")) | ((F.col("source") == "imdb") & (F.col("key") == "id"))
        external = attributes.where(imdb & (F.col("value") == asked)).select(*KEY).join(shows.select(*KEY), KEY, "left_semi")
        bare = shows.where(F.col("content_id") == asked)
        found = external.select(*KEY, F.lit(0).alias("priority")).unionByName(bare.select(*KEY, F.lit(1).alias("priority")))
    return (
        resolved(found, correlations)
        .withColumn("content_type", F.lit("tv_show"))
        .join(shows, KEY)
        .groupBy("content_source", "content_id", "title")
        .agg(F.min("priority").alias("priority"))
        .orderBy("priority", (F.col("content_source") != "tmdb"), "content_source", "content_id")
        .limit(1)
        .select(F.col("content_source").alias("source"), F.col("content_id").alias("id"), "title")
    )


def links_of(links: DataFrame, correlations: DataFrame, source: str, content_id: str) -> DataFrame:
    """Links of one show, its own and its aliases', as a union of two filters
    that both reach the scan."""
    asked = (F.col("content_source") == source) & (F.col("content_id") == content_id)
    shows = links.where(F.col("content_type") == "tv_show")
    own = shows.where(asked)
    aliases = correlations.where(
        (F.col("canonical_type") == "tv_show") & (F.col("canonical_source") == source) & (F.col("canonical_id") == content_id)
    ).select(*KEY)
    return own.unionByName(shows.where(~asked).join(aliases, KEY, "left_semi"))


def show_torrents(links: DataFrame, correlations: DataFrame, torrents: DataFrame, torrent_links: DataFrame, sources: DataFrame, source: str, content_id: str) -> DataFrame:
    """One row per torrent of a show: latest season map and resolution, largest peers."""
    mine = resolved(links_of(links, correlations, source, content_id), correlations)
    mine = mine.where((F.col("content_source") == source) & (F.col("content_id") == content_id))
    grouped = mine.groupBy("info_hash", *KEY).agg(
        F.max_by("episodes", F.when(F.col("episodes").isNotNull(), F.col("updated_at"))).alias("episodes"),
        latest_value("video_resolution", "updated_at").alias("video_resolution"),
        F.max("seeders").alias("seeders"),
        F.max("leechers").alias("leechers"),
    )
    return (
        grouped.join(torrents.select("info_hash", F.col("name").alias("torrent_name"), "size"), "info_hash")
        .join(provider_names(torrent_links, sources), "info_hash", "left")
        .withColumn("provider", F.coalesce("provider", F.lit("DHT")))
    )


def show_episodes(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(info_hash, season, episode, file): the episodes of each torrent.

    File paths that name an episode count; only a torrent without any falls
    back to its season map, in which paths of ``episode_files``, if that
    column is there, replace mere marks. ``rows``: info_hash and episodes, a
    map of maps; ``files``: info_hash and path.
    """
    if "episode_files" in rows.columns:
        rows = rows.withColumn("episodes", merge_episodes(F.col("episodes"), F.col("episode_files")))
    exact = (
        files.select("info_hash", "path", episode_of_path(F.col("path")).alias("e"))
        .where("e is not null")
        .select("info_hash", "e.season", "e.episode", F.col("path").alias("file"))
    )
    listed = (
        rows.join(exact.select("info_hash").distinct(), "info_hash", "left_anti")
        .select("info_hash", F.explode("episodes").alias("season", "inner"))
        .select("info_hash", F.col("season").try_cast("int").alias("season"), F.explode("inner").alias("episode", "file"))
        .select("info_hash", "season", F.col("episode").try_cast("int").alias("episode"), F.when(F.col("file") != "true", F.col("file")).alias("file"))
        .where("season is not null and episode is not null and season between 0 and 65535 and episode between 0 and 65535")
    )
    return exact.join(rows.select("info_hash").distinct(), "info_hash", "left_semi").unionByName(listed)


@dataclass
class SnapshotStore:
    """Published generations under a folder.

    A publish writes the data of a new generation and then one marker, which
    appears at once or not at all; the largest marked generation is active. A
    reader looks it up once and reads one immutable generation. The active
    generation and the one before it are kept.
    """

    root: str

    def published(self, spark: SparkSession) -> list[int]:
        try:
            rows = spark.read.schema("generation_id bigint").json(f"{self.root}/published/*").collect()  # two markers are kept
        except AnalysisException:  # nothing published yet
            return []
        return sorted(r[0] for r in rows)

    def publish(self, items: DataFrame, torrents: DataFrame) -> int:
        spark = items.sparkSession
        before = self.published(spark)
        generation = (before[-1] if before else 0) + 1
        for name, df in (("items", items), ("torrents", torrents)):
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/generation_id={generation}")
        marker = spark.createDataFrame([(generation,)], "generation_id bigint").coalesce(1)
        marker.write.json(f"{self.root}/published/{generation}")
        for old in before[:-1]:
            for path in (f"published/{old}", f"items/generation_id={old}", f"torrents/generation_id={old}"):
                remove_path(spark, f"{self.root}/{path}")
        return generation

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        known = self.published(spark)
        if not known:
            raise ValueError("no generation is published")
        return spark.read.parquet(f"{self.root}/{name}/generation_id={known[-1]}").withColumn("generation_id", F.lit(known[-1]))
