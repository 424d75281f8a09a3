"""Catalogue pages and show details in JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from reelloom.functions.infohash import hash_of_delivery
from reelloom.functions.scalars import rating_of_json, stable_item_id, title_of_slug

TORRENT = StructType(
    [
        *[StructField(n, StringType()) for n in ("locator", "name", "size", "quality", "seeders", "leechers", "file")],
        StructField("season", IntegerType()),
        StructField("episode", IntegerType()),
    ]
)
# The names a field may have, the preferred first.
NAMES = {
    "locator": ("url", "magnet"),
    "name": ("name", "title", "filename", "file"),
    "size": ("size", "bytes"),
    "quality": ("quality",),
    "seeders": ("seed", "seeds", "seeders"),
    "leechers": ("peer", "peers", "leechers"),
    "file": ("file", "filename"),
}


def _text(node: dict, field: str) -> str | None:
    for name in NAMES[field]:
        value = node.get(name)
        if field in ("size", "seeders", "leechers") and isinstance(value, int) and not isinstance(value, bool):
            return str(value)
        if isinstance(value, str) and value.strip():
            return value.strip()
    return None


def _valid(locator: str | None) -> bool:
    return bool(locator) and locator.lower().startswith("magnet:") and "urn:btih:" in locator.lower()


def torrents_in(node: object, fallback: str, key: str | None = None, **place: int) -> Iterator[dict]:
    """Nodes with a magnet link anywhere among nested objects; lists aren't
    entered. The key a node stands under is its quality if it states none."""
    if not isinstance(node, dict):
        return
    locator = _text(node, "locator")
    if _valid(locator):
        got = {n: _text(node, n) for n in NAMES}
        yield got | {"locator": locator.replace("&amp;", "&"), "name": got["name"] or fallback, "quality": got["quality"] or key, **place}
        return
    for name, child in node.items():
        yield from torrents_in(child, fallback, name, **place)


def _whole(value: object) -> int | None:
    """A whole number from 0 to 65535, as number or text."""
    try:
        n = int(value.strip()) if isinstance(value, str) else value if type(value) is int else None
    except ValueError:
        return None
    return n if n is not None and 0 <= n <= 65535 else None


def show_torrents(detail: dict, title: str) -> list[dict]:
    """Torrents of a show and of its episodes, these with their numbers."""
    out = list(torrents_in(detail.get("torrents"), title))
    episodes = detail.get("episodes")
    for e in episodes if isinstance(episodes, list) else []:
        if isinstance(e, dict) and (s := _whole(e.get("season"))) is not None and (n := _whole(e.get("episode"))) is not None:
            out += torrents_in(e.get("torrents"), f"{title} S{s:02d}E{n:02d}", season=s, episode=n)
    return out


@F.pandas_udf(ArrayType(TORRENT))
def _collected(text: pd.Series, title: pd.Series) -> pd.Series:
    fields = TORRENT.fieldNames()

    def read(t: str, name: str) -> list[dict]:
        try:
            node = json.loads(t)
        except (ValueError, TypeError):
            return []
        found = show_torrents(node, name or "") if isinstance(node, dict) else []
        return [{f: x.get(f) for f in fields} for x in found]

    return pd.Series([read(t, n) for t, n in zip(text, title)])


def _first(item: Column, names: tuple[str, ...]) -> Column:
    trimmed = [F.nullif(F.trim(F.try_variant_get(item, f"$.{n}", "string")), F.lit("")) for n in names]
    return F.coalesce(*trimmed)


def page_items(pages: DataFrame) -> DataFrame:
    """One row per item of catalogue pages (kind, body): a top-level list, or
    an object with ``results``, ``movies`` or ``shows``. Items without a title
    are left out; one without an id gets a digest of title and year."""
    body = F.try_parse_json("body")
    lists = F.coalesce(
        *[F.try_variant_get(body, p, "array<variant>") for p in ("$", "$.results", "$.movies", "$.shows")]
    )
    items = pages.select("kind", F.explode(lists).alias("item"))
    item = F.col("item")
    title = F.coalesce(_first(item, ("title", "name")), title_of_slug(_first(item, ("slug",))))
    year = F.coalesce(F.try_variant_get(item, "$.year", "bigint"), F.try_variant_get(item, "$.year", "string").try_cast("bigint"))
    tmdb = F.coalesce(F.try_variant_get(item, "$.tmdb_id", "bigint"), F.try_variant_get(item, "$.tmdb_id", "string").try_cast("bigint"))
    genres = F.coalesce(F.try_variant_get(item, "$.genres", "array<string>"), F.try_variant_get(item, "$.genre", "array<string>"))
    rows = items.select(
        "kind",
        title.alias("title"),
        year.alias("year"),
        _first(item, ("imdb_id", "tvdb_id", "id", "_id")).alias("given"),
        F.when(tmdb > 0, tmdb.cast("string")).alias("tmdb_id"),
        _first(item, ("synopsis", "description", "overview")).alias("synopsis"),
        rating_of_json(F.try_variant_get(item, "$.rating", "variant")).alias("rating"),
        _first(item, ("images.poster",)).alias("poster"),
        _first(item, ("images.fanart", "images.backdrop")).alias("fanart"),
        F.filter(F.transform(F.coalesce(genres, F.array().cast("array<string>")), lambda g: F.trim(g)), lambda g: g != "").alias("genres"),
        F.to_json(item).alias("item"),
    ).where("title <> ''")
    return rows.withColumn("id", F.coalesce("given", stable_item_id(F.col("title"), F.col("year")))).drop("given")


def one_catalogue(items: DataFrame) -> DataFrame:
    """Items (endpoint, kind, id, …) of all endpoints as one catalogue: of items
    that several deliver, that of the first endpoint, the least by content."""
    own = [c for c in items.columns if c not in ("kind", "id")]
    rest = F.struct("endpoint", *[c for c in own if c != "endpoint"])
    return items.groupBy("kind", "id").agg(F.min(rest).alias("_i")).select("kind", "id", "_i.*")


def item_torrents(items: DataFrame) -> DataFrame:
    """(id, info_hash, name, size, quality, seeders, leechers, season, episode,
    file) of the torrents anywhere in each item; broken hashes are left out."""
    rows = items.select("id", F.explode(_collected("item", "title")).alias("t"))
    whole = lambda c: F.when(F.col(c).try_cast("int") > 0, F.col(c).try_cast("int")).when(F.col(c).try_cast("int").isNotNull(), F.lit(0))
    return rows.select(
        "id", hash_of_delivery(F.col("t.locator")).alias("info_hash"), "t.name", F.coalesce(F.col("t.size").try_cast("bigint"), F.lit(0)).alias("size"),
        "t.quality", whole("t.seeders").alias("seeders"), whole("t.leechers").alias("leechers"), "t.season", "t.episode", "t.file",
    ).where("info_hash is not null")
