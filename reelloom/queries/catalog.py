"""Snapshot, browse, show, correlation and enrichment queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelloom.operators import fulltext
from reelloom.operators.merge import insert_missing
from reelloom.plans import correlate, enrich
from reelloom.plans.catalog import (
    KEY,
    browse_page,
    catalogue_documents,
    latest_value,
    provider_names,
    quality_keys,
    resolve_show,
    show_episodes,
    show_torrents,
    snapshot_items,
    snapshot_summary,
    snapshot_torrents,
)
from reelloom.plans.derive import ctes, derived
from reelloom.queries.scalars import PARSE_SQL
from reelloom.session import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column)).alias(column)


def _correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents, attributes, links = derived(spark, sf_dir, "contents", "attributes", "links")
    return correlate.repair_exact(contents, attributes, links)


def _stored_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlations as a table, as the catalogue keeps them."""
    return materialize(_correlations(spark, sf_dir), "correlations")


def _snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    contents, attributes, genres, torrents, links, torrent_links, providers = derived(
        spark, sf_dir, "contents", "attributes", "genres", "torrents", "links", "torrent_links", "providers"
    )
    rows = snapshot_torrents(links, _stored_correlations(spark, sf_dir), contents, torrents, torrent_links, providers)
    return snapshot_items(rows, contents, attributes, genres), rows


# Correlations by external id, as another engine states them.
EXACT_CTES = (
    """main_imdb as (select content_type, content_id, value from attributes
        where content_source = 'tmdb' and ((source = 'tmdb' and key = 'imdb_id') or (source = 'imdb' and key = 'id')))""",
    """latest as (select content_type, content_source, content_id,
          (array_agg(info_hash order by updated_at desc, info_hash))[1] as evidence_info_hash
        from links group by all)""",
    """id_pairs as (
        select a.type as content_type, a.source as content_source, a.id as content_id, m.content_id as canonical_id, 'exact_imdb_id' as evidence_kind
        from contents a join main_imdb m on m.content_type = a.type and (m.value = a.id or exists (
          select 1 from attributes x where x.content_type = a.type and x.content_source = a.source and x.content_id = a.id
            and (x.key = 'imdb_id' or (x.source = 'imdb' and x.key = 'id')) and x.value = m.value))
        where a.source <> 'tmdb'
        union all
        select a.type, a.source, a.id, c.id, 'exact_tmdb_id'
        from contents a join attributes x on x.content_type = a.type and x.content_source = a.source and x.content_id = a.id and x.key = 'tmdb_id'
          join contents c on c.type = a.type and c.source = 'tmdb' and c.id = x.value
        where a.source <> 'tmdb')""",
    """correlations as (
        select content_type, content_source, content_id, content_type as canonical_type, 'tmdb' as canonical_source,
          min(canonical_id) as canonical_id, min(evidence_info_hash) as evidence_info_hash,
          case when bool_or(evidence_kind = 'exact_tmdb_id') then 'exact_tmdb_id' else 'exact_imdb_id' end as evidence_kind
        from id_pairs join latest using (content_type, content_source, content_id)
        group by content_type, content_source, content_id having count(distinct canonical_id) = 1)""",
)
SNAPSHOT_CTES = (
    *EXACT_CTES,
    """hops as (select l.info_hash, l.content_type, coalesce(c.canonical_source, l.content_source) as content_source,
          coalesce(c.canonical_id, l.content_id) as content_id, l.video_resolution, l.seeders, l.leechers, l.created_at, l.updated_at
        from links l left join correlations c using (content_type, content_source, content_id))""",
    """grouped as (select info_hash, content_type, content_source, content_id,
          (array_agg(video_resolution order by updated_at desc, video_resolution desc) filter (where video_resolution is not null))[1] as video_resolution,
          max(seeders) as seeders, max(leechers) as leechers, min(created_at) as created_at, max(updated_at) as updated_at
        from hops group by info_hash, content_type, content_source, content_id)""",
    """provider_lists as (select info_hash, string_agg(distinct p.name, ', ' order by p.name) as provider
        from torrent_links t join providers p on p.key = t.source group by info_hash)""",
    """snap as (select g.content_type, g.content_source, g.content_id, g.info_hash, t.name as torrent_name, t.size, g.video_resolution,
          g.seeders, g.leechers, coalesce(p.provider, 'DHT') as provider, g.created_at, g.updated_at
        from grouped g join contents c on c.type = g.content_type and c.source = g.content_source and c.id = g.content_id
          join torrents t on t.info_hash = g.info_hash left join provider_lists p on p.info_hash = g.info_hash
        where c.adult is distinct from true and not exists (select 1 from correlations x
          where x.content_type = c.type and x.content_source = c.source and x.content_id = c.id))""",
    """pictures as (select content_type, content_source, content_id, min(value) as poster_path
        from attributes where source = content_source and key = 'poster_path' group by all)""",
    """genre_lists as (select content_type, content_source, content_id, list_sort(list(name)) as genres from genres group by all)""",
    """items as (select c.type as content_type, c.source as content_source, c.id as content_id, c.title, c.release_year, c.overview,
          c.vote_average, c.popularity, c.original_language, p.poster_path, coalesce(g.genres, []) as genres,
          list_transform(coalesce(g.genres, []), lambda x: lower(x)) as normalized_genres, s.activity_at, s.added_at
        from contents c join (select content_type, content_source, content_id, max(updated_at) as activity_at, min(created_at) as added_at
            from snap group by content_type, content_source, content_id) s
          on s.content_type = c.type and s.content_source = c.source and s.content_id = c.id
          left join pictures p on p.content_type = c.type and p.content_source = c.source and p.content_id = c.id
          left join genre_lists g on g.content_type = c.type and g.content_source = c.source and g.content_id = c.id)""",
)


def snapshot_torrents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _snapshot(spark, sf_dir)
    return rows.withColumns({"created_at": micros("created_at"), "updated_at": micros("updated_at")})


def snapshot_items_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = _snapshot(spark, sf_dir)
    flat = {c: F.array_join(c, "|") for c in ("genres", "normalized_genres")}
    return items.withColumns({**flat, "activity_at": micros("activity_at"), "added_at": micros("added_at")}).drop("backdrop_path")


def snapshot_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_summary(*_snapshot(spark, sf_dir))


SNAPSHOT_SQL = {
    "snapshot_torrents": ctes(*SNAPSHOT_CTES)
    + "select * exclude (created_at, updated_at), epoch_us(created_at) as created_at, epoch_us(updated_at) as updated_at from snap",
    "snapshot_items": ctes(*SNAPSHOT_CTES)
    + """select * exclude (genres, normalized_genres, activity_at, added_at), array_to_string(genres, '|') as genres,
      array_to_string(normalized_genres, '|') as normalized_genres, epoch_us(activity_at) as activity_at, epoch_us(added_at) as added_at from items""",
    "snapshot_summary": ctes(*SNAPSHOT_CTES)
    + """select count(*) filter (where content_type = 'movie') as movies, count(*) filter (where content_type = 'tv_show') as shows,
      (select count(distinct info_hash) from snap) as torrents from items""",
}


TORRENT_COLUMNS = ["seeders", "leechers", "torrent_name", "size", "video_resolution", "provider"]


def _active(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items of the active generation, repeats folded, and its torrents as delivered."""
    ids = [r.id for r in table(spark, sf_dir, "catalog_snapshot_generations").where("active").collect()]  # one row
    items = table(spark, sf_dir, "catalog_snapshot_items").where(F.col("generation_id").isin(ids))
    torrents = table(spark, sf_dir, "catalog_snapshot_torrents").where(F.col("generation_id").isin(ids))
    order = ["title", "release_year", "popularity", "vote_average", "activity_at", "added_at"]
    one = items.groupBy(*KEY).agg(
        F.min(F.struct(*order, "overview", "original_language", "poster_path", "backdrop_path", "genres", "normalized_genres")).alias("v")
    )
    return one.select(*KEY, "v.*"), torrents.select(*KEY, "info_hash", *TORRENT_COLUMNS)


def _folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and torrent, its best; what else the rows have follows from the key."""
    rest = [c for c in rows.columns if c not in (*keys, "info_hash", *TORRENT_COLUMNS)]
    best = rows.groupBy(*keys, "info_hash").agg(F.max(F.struct(*TORRENT_COLUMNS)).alias("v"), *[F.first(c).alias(c) for c in rest])
    return best.select(*keys, "info_hash", *rest, "v.*")


def browse_query(spark: SparkSession, sf_dir: str, **choice) -> DataFrame:
    # Repeated torrents are folded after the page has cut the contents to fifty.
    page = _folded(browse_page(*_active(spark, sf_dir), **choice), ["page_rank", *KEY])
    return page.select(
        "page_rank", *KEY, "title", "release_year", F.round("vote_average", 4).alias("vote_average"), F.array_join("genres", "|").alias("genres"),
        "info_hash", "torrent_name", "size", "video_resolution", "seeders", "leechers", "provider",
    )


# Orders of browse pages, as another engine states them.
SQL_SORTS = {
    "trending": "popularity desc nulls last, activity_at desc nulls last, title nulls last",
    "updated": "activity_at desc nulls last, popularity desc nulls last, title nulls last",
    "last added": "added_at desc nulls last, popularity desc nulls last, title nulls last",
    "year": "release_year desc nulls last, popularity desc nulls last, title nulls last",
    "title": "title nulls last, release_year desc nulls last",
    "rating": "vote_average desc nulls last, popularity desc nulls last, title nulls last",
}


def browse_sql(kind: str = "movie", sort: str = "trending", page: int = 1, genre: str | None = None, condition: str = "true") -> str:
    japanese = "original_language = 'ja' and list_contains(normalized_genres, 'animation')"
    test = {"movie": "content_type = 'movie'", "anime": f"content_type = 'tv_show' and {japanese}", "series": f"content_type = 'tv_show' and not ({japanese})"}[kind]
    wanted = f" and list_contains(normalized_genres, '{genre.lower()}')" if genre else ""
    order = SQL_SORTS[sort] + ", content_source, content_id"
    return f"""
    with ids as (select id from catalog_snapshot_generations where active),
    one as (select content_type, content_source, content_id, min(struct_pack(title := title, release_year := release_year, popularity := popularity,
        vote_average := vote_average, activity_at := activity_at, added_at := added_at, overview := overview, original_language := original_language,
        poster_path := poster_path, backdrop_path := backdrop_path, genres := genres, normalized_genres := normalized_genres)) as v
      from catalog_snapshot_items where generation_id in (select id from ids) group by all),
    items as (select content_type, content_source, content_id, unnest(v) from one),
    best as (select content_type, content_source, content_id, info_hash, (array_agg(struct_pack(seeders := seeders, leechers := leechers,
        torrent_name := torrent_name, size := size, video_resolution := video_resolution, provider := provider)
        order by seeders desc nulls last, leechers desc nulls last, torrent_name desc nulls last, size desc nulls last,
          video_resolution desc nulls last, provider desc nulls last))[1] as v
      from catalog_snapshot_torrents where generation_id in (select id from ids) group by all),
    chosen as (select * from items where {test}{wanted} and {condition} order by {order} limit 50 offset {(page - 1) * 50}),
    ranked as (select *, cast(row_number() over (order by {order}) as int) as page_rank from chosen)
    select r.page_rank, r.content_type, r.content_source, r.content_id, r.title, r.release_year, round(r.vote_average, 4) as vote_average,
      array_to_string(r.genres, '|') as genres, b.info_hash, b.v.torrent_name as torrent_name, b.v.size as size,
      b.v.video_resolution as video_resolution, b.v.seeders as seeders, b.v.leechers as leechers, b.v.provider as provider
    from ranked r join best b using (content_type, content_source, content_id)"""


_TOKENS = "' ' || trim(regexp_replace(lower(coalesce(title, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"
BROWSES: dict[str, tuple[dict, dict]] = {
    **{f"browse_{s.replace(' ', '_')}": ({"sort": s}, {"sort": s}) for s in SQL_SORTS},
    "browse_series": ({"kind": "series"}, {"kind": "series"}),
    "browse_anime": ({"kind": "anime"}, {"kind": "anime"}),
    "browse_genre": ({"genre": " Comedy "}, {"genre": "Comedy"}),
    "browse_page3": ({"page": 3, "sort": "title"}, {"page": 3, "sort": "title"}),
    "browse_keywords_and": ({"keywords": "fire the"}, {"condition": f"contains({_TOKENS}, ' fire ') and contains({_TOKENS}, ' the ')"}),
    "browse_keywords_or": ({"keywords": "harbor or bridge"}, {"condition": f"(contains({_TOKENS}, ' harbor ') or contains({_TOKENS}, ' bridge '))"}),
    "browse_keywords_not": ({"keywords": "the -river"}, {"condition": f"contains({_TOKENS}, ' the ') and not contains({_TOKENS}, ' river ')"}),
    "browse_keywords_phrase": ({"keywords": '"fire of"'}, {"condition": f"contains({_TOKENS}, ' fire of ')"}),
}


def browse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_documents(_folded(browse_page(*_active(spark, sf_dir)), ["page_rank", *KEY]))


def list_quality_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, torrents = _active(spark, sf_dir)
    keyed = quality_keys(_folded(torrents, KEY), KEY, [F.col("seeders").desc_nulls_last(), F.col("torrent_name"), F.col("info_hash")])
    return keyed.select(*KEY, "info_hash", "quality_key", F.concat(F.lit("magnet:?xt=urn:btih:"), F.upper("info_hash")).alias("url"))


QUALITY_SQL = """
with best as (select content_type, content_source, content_id, info_hash, (array_agg(struct_pack(seeders := seeders, torrent_name := torrent_name,
    video_resolution := video_resolution) order by seeders desc nulls last, leechers desc nulls last, torrent_name desc nulls last,
    size desc nulls last, video_resolution desc nulls last, provider desc nulls last))[1] as v
  from catalog_snapshot_torrents where generation_id in (select id from catalog_snapshot_generations where active) group by all),
named as (select *, coalesce(nullif(lower(case when v.video_resolution like 'V%' then substr(v.video_resolution, 2) end), ''), 'unknown') as quality from best),
placed as (select *, row_number() over (partition by content_type, content_source, content_id, quality
  order by v.seeders desc nulls last, v.torrent_name nulls first, info_hash) as place from named)
select content_type, content_source, content_id, info_hash,
  case when place = 1 then quality else quality || '-' || place end as quality_key, 'magnet:?xt=urn:btih:' || upper(info_hash) as url
from placed
"""


def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published generations with their counts; the active one is marked."""
    items, torrents = table(spark, sf_dir, "catalog_snapshot_items"), table(spark, sf_dir, "catalog_snapshot_torrents")
    by_kind = items.groupBy("generation_id").agg(
        F.count_distinct(F.when(F.col("content_type") == "movie", F.struct(*KEY))).alias("movies"),
        F.count_distinct(F.when(F.col("content_type") == "tv_show", F.struct(*KEY))).alias("shows"),
    )
    hashes = torrents.groupBy("generation_id").agg(F.count_distinct("info_hash").alias("torrents"))
    generations = table(spark, sf_dir, "catalog_snapshot_generations").select(F.col("id").alias("generation_id"), "active")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return generations.join(by_kind, "generation_id", "left").join(hashes, "generation_id", "left").select("generation_id", "active", zero("movies"), zero("shows"), zero("torrents"))


STATS_SQL = """
select g.id as generation_id, g.active,
  (select count(distinct (content_type, content_source, content_id)) from catalog_snapshot_items i where i.generation_id = g.id and content_type = 'movie') as movies,
  (select count(distinct (content_type, content_source, content_id)) from catalog_snapshot_items i where i.generation_id = g.id and content_type = 'tv_show') as shows,
  (select count(distinct info_hash) from catalog_snapshot_torrents t where t.generation_id = g.id) as torrents
from catalog_snapshot_generations g
"""


def retained_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active generation and the one activated before it."""
    known = table(spark, sf_dir, "catalog_snapshot_generations").where("activated_at is not null")
    return known.orderBy(F.col("active").desc(), F.col("activated_at").desc(), F.col("id").desc()).limit(2).select("id", "active")


RETAINED_SQL = """
select id, active from catalog_snapshot_generations where activated_at is not null
order by active desc, activated_at desc, id desc limit 2
"""


def corr_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correlations(spark, sf_dir)


def _id_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents, attributes, links = derived(spark, sf_dir, "contents", "attributes", "links")
    return correlate.exact_id_pairs(correlate.alias_keys(contents), contents, attributes).join(correlate.latest_hash(links), KEY)


def corr_ambiguous_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _id_pairs(spark, sf_dir).groupBy(*KEY).agg(F.count_distinct("canonical_id").alias("canonicals"))
    return pairs.where("canonicals > 1")


def _shared_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as links: equal texts are one torrent."""
    source = F.when(F.col("doc_id") % 2 == 0, F.lit("tmdb")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select(
        F.sha1("text").alias("info_hash"), F.coalesce("lang", F.lit("und")).alias("content_type"), source.alias("content_source"), F.col("doc_id").cast("string").alias("content_id")
    )


def corr_shared_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.repair_shared(_shared_links(spark, sf_dir))


SHARED_SQL = """
with links as (select sha1(text) as info_hash, coalesce(lang, 'und') as content_type,
    case when doc_id % 2 = 0 then 'tmdb' else source end as content_source, cast(doc_id as varchar) as content_id from documents),
pairs as (select a.content_type, a.content_source, a.content_id, c.content_id as canonical_id, min(a.info_hash) as evidence_info_hash
  from links a join links c on c.info_hash = a.info_hash and c.content_type = a.content_type and c.content_source = 'tmdb'
  where a.content_source <> 'tmdb' group by all)
select content_type, content_source, content_id, content_type as canonical_type, 'tmdb' as canonical_source, min(canonical_id) as canonical_id,
  min(evidence_info_hash) as evidence_info_hash, 'shared_info_hash' as evidence_kind
from pairs group by content_type, content_source, content_id having count(*) = 1
"""


def _item_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Contents, attributes, links and torrents from delivered items and works:
    the rows of a canonical item share a torrent, which has arrived once one of
    them has a date."""
    items, works = table(spark, sf_dir, "catalog_items"), table(spark, sf_dir, "tmdb_content")
    key = [F.col("kind").alias("content_type"), F.col("source").alias("content_source"), F.col("id").alias("content_id")]
    main = [F.col("kind").alias("content_type"), F.lit("tmdb").alias("content_source"), F.col("id").cast("string").alias("content_id")]
    contents = items.select(*key).unionByName(works.select(*main)).distinct()
    contents = contents.toDF("type", "source", "id")
    number = F.trim("tmdb_id")
    own = items.where((F.col("source") != "tmdb") & number.rlike("^[1-9][0-9]*$")).select(*key, "source", F.lit("tmdb_id").alias("key"), number.alias("value"))
    imdb = works.where("imdb_id is not null").select(*main, F.lit("tmdb").alias("source"), F.lit("imdb_id").alias("key"), F.col("imdb_id").alias("value"))
    hashed = F.sha1("canonical_id").alias("info_hash")
    links = items.where("canonical_id is not null").select(hashed, *key).distinct()
    torrents = items.where("updated_at is not null and canonical_id is not null").select(hashed).distinct()
    return contents, own.unionByName(imdb).distinct(), links, torrents


def corr_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents, attributes, links, torrents = _item_tables(spark, sf_dir)
    return correlate.correlate_pending(links.where("content_source <> 'tmdb'"), torrents, links, contents, attributes)


PENDING_SQL = f"""
with attributes as (
    select distinct kind as content_type, source as content_source, id as content_id, source, 'tmdb_id' as key, trim(tmdb_id, ' ') as value
    from catalog_items where source <> 'tmdb' and regexp_matches(trim(tmdb_id, ' '), '^[1-9][0-9]*$')
    union all select distinct kind, 'tmdb', cast(id as varchar), 'tmdb', 'imdb_id', imdb_id from tmdb_content where imdb_id is not null),
contents as (select kind as type, source, id from catalog_items union select kind, 'tmdb', cast(id as varchar) from tmdb_content),
links as (select distinct sha1(canonical_id) as info_hash, kind as content_type, source as content_source, id as content_id from catalog_items where canonical_id is not null),
torrents as (select distinct sha1(canonical_id) as info_hash from catalog_items where canonical_id is not null and updated_at is not null),
{EXACT_CTES[0]},
aliases as (select distinct content_type, content_source, content_id from links where content_source <> 'tmdb' and info_hash in (select info_hash from torrents)),
mine as (select l.* from links l join aliases using (content_type, content_source, content_id)),
raw as (
    select m.content_type, m.content_source, m.content_id, c.content_id as canonical_id, m.info_hash, 3 as strength
    from mine m join links c on c.info_hash = m.info_hash and c.content_type = m.content_type and c.content_source = 'tmdb'
    union all
    select m.content_type, m.content_source, m.content_id, c.id, m.info_hash, 1
    from mine m join attributes x on x.content_type = m.content_type and x.content_source = m.content_source and x.content_id = m.content_id and x.key = 'tmdb_id'
      join contents c on c.type = m.content_type and c.source = 'tmdb' and c.id = x.value
    union all
    select m.content_type, m.content_source, m.content_id, i.content_id, m.info_hash, 2
    from mine m join main_imdb i on i.content_type = m.content_type and i.value = m.content_id
    union all
    select m.content_type, m.content_source, m.content_id, i.content_id, m.info_hash, 2
    from mine m join attributes x on x.content_type = m.content_type and x.content_source = m.content_source and x.content_id = m.content_id and x.key = 'imdb_id'
      join main_imdb i on i.content_type = m.content_type and i.value = x.value)
select content_type, content_source, content_id, content_type as canonical_type, 'tmdb' as canonical_source, min(canonical_id) as canonical_id,
  min(info_hash) as evidence_info_hash,
  case min(strength) when 1 then 'exact_tmdb_id' when 2 then 'exact_imdb_id' else 'shared_info_hash' end as evidence_kind
from raw group by content_type, content_source, content_id having count(distinct canonical_id) = 1
"""


def _matches(torrents: DataFrame, links: DataFrame) -> DataFrame:
    """Pretended matches: each torrent with its least canonical link."""
    least = links.where(F.col("content_source") == "tmdb").groupBy("info_hash", "content_type").agg(F.min("content_id").alias("tmdb_id"))
    imdb = F.concat(F.lit("tt"), F.lpad("tmdb_id", 7, "0"))
    return least.join(torrents.select("info_hash"), "info_hash", "left_semi").withColumn("imdb_id", imdb)


def corr_match_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents, attributes, links, torrents = derived(spark, sf_dir, "contents", "attributes", "links", "torrents")
    return correlate.match_aliases(_matches(torrents, links), contents, attributes, links)


def corr_conflict_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.conflicting(corr_match_evidence(spark, sf_dir), _correlations(spark, sf_dir))


MATCH_CTES = (
    """matches as (select info_hash, content_type, min(content_id) as tmdb_id, 'tt' || lpad(min(content_id), 7, '0') as imdb_id
        from links where content_source = 'tmdb' group by info_hash, content_type)""",
    """bound as (
        select m.info_hash, m.content_type, m.tmdb_id, x.content_source, x.content_id, 1 as strength
        from matches m join attributes x on x.content_type = m.content_type and x.key = 'tmdb_id' and x.source = x.content_source and x.value = m.tmdb_id
        where x.content_source <> 'tmdb'
        union all
        select m.info_hash, m.content_type, m.tmdb_id, c.source, c.id, 2 from matches m join contents c on c.type = m.content_type and c.id = m.imdb_id and c.source <> 'tmdb'
        union all
        select m.info_hash, m.content_type, m.tmdb_id, l.content_source, l.content_id, 3
        from matches m join links l on l.info_hash = m.info_hash and l.content_type = m.content_type and l.content_source <> 'tmdb')""",
    """evidence as (select info_hash, content_type, tmdb_id, content_source, content_id,
          case min(strength) when 1 then 'exact_tmdb_id' when 2 then 'exact_imdb_id' else 'shared_info_hash' end as evidence_kind from bound group by all)""",
)


def merge_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact correlations merged over those from shared torrents."""
    contents, attributes, links = derived(spark, sf_dir, "contents", "attributes", "links")
    return correlate.upgrade(correlate.repair_shared(links), correlate.repair_exact(contents, attributes, links))


UPGRADE_SQL = ctes(
    *EXACT_CTES,
    """shared as (select a.content_type, a.content_source, a.content_id, c.content_id as canonical_id, min(a.info_hash) as evidence_info_hash
        from links a join links c on c.info_hash = a.info_hash and c.content_type = a.content_type and c.content_source = 'tmdb'
        where a.content_source <> 'tmdb' group by all)""",
    """old as (select content_type, content_source, content_id, min(canonical_id) as canonical_id, min(evidence_info_hash) as evidence_info_hash
        from shared group by content_type, content_source, content_id having count(*) = 1)""",
) + """
select coalesce(o.content_type, n.content_type) as content_type, coalesce(o.content_source, n.content_source) as content_source,
  coalesce(o.content_id, n.content_id) as content_id, coalesce(o.content_type, n.canonical_type) as canonical_type, 'tmdb' as canonical_source,
  coalesce(o.canonical_id, n.canonical_id) as canonical_id,
  case when o.content_id is null or o.canonical_id = n.canonical_id then n.evidence_info_hash else o.evidence_info_hash end as evidence_info_hash,
  case when o.content_id is null or o.canonical_id = n.canonical_id then n.evidence_kind else 'shared_info_hash' end as evidence_kind
from old o full join correlations n using (content_type, content_source, content_id)
"""


def _ask_show(asked: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        contents, attributes = derived(spark, sf_dir, "contents", "attributes")
        return resolve_show(contents, attributes, _stored_correlations(spark, sf_dir), asked)

    return query


def _show_sql(asked: str) -> str:
    source, dot, rest = asked.partition(".")
    if dot:
        found = f"select type, source, id, 0 as priority from contents where type = 'tv_show' and source = '{source}' and id = '{rest}'"
    else:
        found = f"""select content_type as type, content_source as source, content_id as id, 0 as priority from attributes
            where content_type = 'tv_show' and ((source = 'tmdb' and key = 'imdb_id') or (source = 'imdb' and key = 'id')) and value = '{asked}'
          union all select type, source, id, 1 from contents where type = 'tv_show' and id = '{asked}'"""
    return ctes(*EXACT_CTES, f"found as ({found})") + """
      select c.source, c.id, c.title from found f
        left join correlations x on x.content_type = f.type and x.content_source = f.source and x.content_id = f.id
        join contents c on c.type = 'tv_show' and c.source = coalesce(x.canonical_source, f.source) and c.id = coalesce(x.canonical_id, f.id)
      group by c.source, c.id, c.title order by min(f.priority), c.source <> 'tmdb', c.source, c.id limit 1"""


SHOWS = {"resolve_qualified": "butter-a.tt0000019", "resolve_external": "tt0000019", "resolve_bare": "fb-19"}
SHOWN = ("tmdb", "19")


def _links_with_episodes(links: DataFrame) -> DataFrame:
    """Links with their season map; every fourth torrent has none."""
    one = F.create_map(F.col("season").cast("string"), F.create_map(F.col("episode").cast("string"), F.lit("true")))
    return links.withColumn("episodes", F.when(F.col("l_orderkey") % 4 != 0, one)).drop("l_orderkey", "season", "episode")


def show_torrents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, torrents, torrent_links, providers = derived(spark, sf_dir, "links", "torrents", "torrent_links", "providers")
    rows = show_torrents(_links_with_episodes(links), _stored_correlations(spark, sf_dir), torrents, torrent_links, providers, *SHOWN)
    return rows.select("info_hash", "torrent_name", "size", "video_resolution", "seeders", "leechers", "provider")


SHOW_TORRENTS_SQL = ctes(*SNAPSHOT_CTES) + """
select g.info_hash, t.name as torrent_name, t.size, g.video_resolution, g.seeders, g.leechers, coalesce(p.provider, 'DHT') as provider
from grouped g join torrents t using (info_hash) left join provider_lists p using (info_hash)
where g.content_type = 'tv_show' and g.content_source = 'tmdb' and g.content_id = '19'
"""


def show_episodes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of every show's torrents: from names that state one, else from the season maps."""
    links, torrents = derived(spark, sf_dir, "links", "torrents")
    rows = _links_with_episodes(links).where("content_type = 'tv_show' and episodes is not null").select("info_hash", "episodes")
    files = torrents.select("info_hash", F.col("name").alias("path"))
    return show_episodes(rows, files).select("info_hash", "season", "episode", "file").distinct()


SHOW_EPISODES_SQL = ctes(
    """mine as (select * from links where content_type = 'tv_show' and l_orderkey % 4 <> 0)""",
    """named as (select info_hash, name, regexp_extract(name, '(?i)s(\\d{1,3})[ ._-]*e(\\d{1,3})|(\\d{1,3})x(\\d{1,3})', ['a', 'b', 'c', 'd']) as m from torrents)""",
    """exact as (select info_hash, cast(coalesce(nullif(m.a, ''), m.c) as int) as season, cast(coalesce(nullif(m.b, ''), m.d) as int) as episode, name as file
        from named where m.a <> '' or m.c <> '')""",
) + """
select distinct info_hash, season, episode, file from exact where info_hash in (select info_hash from mine)
union all
select distinct info_hash, season, episode, cast(null as varchar) from mine where info_hash not in (select info_hash from exact)
"""


def _worklist_inputs(spark: SparkSession, sf_dir: str):
    torrents, links = derived(spark, sf_dir, "torrents", "links")
    ingested = torrents.where(F.col("o_orderkey") % 3 != 0).select(
        "info_hash", F.when(F.col("o_orderkey") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("source"), F.col("o_orderdate").alias("imported_at")
    )
    attempts = torrents.where(F.col("o_orderkey") % 5 < 2).select(
        "info_hash",
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("error")).otherwise(F.lit("no_match")).alias("status"),
        F.col("o_orderdate").alias("attempted_at"),
    )
    return ingested, torrents.select("info_hash", "name", "size"), links, attempts


def enrich_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    rows = enrich.worklist(*_worklist_inputs(spark, sf_dir), as_of)
    return rows.select("info_hash", "source", "name", "content_type", "external_id", "priority", micros("imported_at"))


WORKLIST_SQL = ctes(
    """best as (select * from (select info_hash, content_type, case when regexp_matches(content_id, '^tt[0-9]{5,}$') then content_id end as external_id,
          row_number() over (partition by info_hash order by regexp_matches(content_id, '^tt[0-9]{5,}$') desc nulls first,
            content_type in ('movie', 'tv_show') desc nulls first, updated_at desc nulls first, content_source nulls last, content_id nulls last) as place
        from links) where place = 1)""",
) + """
select t.info_hash, case when t.o_orderkey % 2 = 0 then 'a' else 'b' end as source, t.name, b.content_type, b.external_id,
  case when b.external_id is not null then 0 when b.content_type in ('movie', 'tv_show') then 1 else 2 end as priority, epoch_us(t.o_orderdate) as imported_at
from torrents t left join best b on b.info_hash = t.info_hash
where t.o_orderkey % 3 <> 0 and t.size > 0
  and (t.o_orderkey % 5 >= 2 or (t.o_orderkey % 5 = 0 and t.o_orderdate <= timestamp '1997-01-01' - interval 6 hour))
  and (coalesce(b.content_type in ('movie', 'tv_show'), false)
    or exists (select 1 from links l where l.info_hash = t.info_hash and l.video_resolution is not null)
    or regexp_matches(t.name, '(?i)\\b(2160p|1080p|720p|480p|web[-._ ]?dl|webrip|bluray|brrip|hdtv|s[0-9]{1,2}e[0-9]{1,3})\\b'))
"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "tmdb_content")
    return works.select("kind", "id", "title", F.col("release_year").alias("year"), "imdb_id").distinct()


def enrich_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision for each distinct name of torrent_records, keyed by its digest."""
    names = table(spark, sf_dir, "torrent_records").where("name is not null").select("name").distinct()
    none = F.lit(None).cast("string")
    asked = names.select(F.sha1("name").alias("info_hash"), "name", none.alias("content_type"), none.alias("external_id"))
    return enrich.decide(asked, _titles(spark, sf_dir))


def provider_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    torrent_links, providers = derived(spark, sf_dir, "torrent_links", "providers")
    return provider_names(torrent_links, providers)


def genre_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    (genres,) = derived(spark, sf_dir, "genres")
    return genres.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("genres"))


def latest_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    (links,) = derived(spark, sf_dir, "links")
    return links.groupBy("info_hash").agg(latest_value("video_resolution", "updated_at").alias("video_resolution"))


def attr_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    (attributes,) = derived(spark, sf_dir, "attributes")
    names = ["imdb_id", "poster_path", "tmdb_id"]
    return attributes.groupBy(*KEY).agg(*[F.min(F.when(F.col("key") == n, F.col("value"))).alias(n) for n in names])


def snapshot_merge_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations from pending links added where none is known."""
    return insert_missing(_correlations(spark, sf_dir), corr_pending(spark, sf_dir), KEY)


def keyword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "tmdb_content")
    return works.select("kind", "id", F.array_join(fulltext.tokens(F.col("title")), " ").alias("tokens"))


def decision_sql(parsed: str) -> str:
    """Decisions as another engine states them, from a parse of the names."""
    return f"""
    with names as (select distinct name from torrent_records where name is not null), parsed as ({parsed}),
    asked as (select sha1(name) as info_hash, kind, title, year,
        translate(regexp_replace(title, '[^\\p{{L}}\\p{{N}}]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as plain from parsed),
    works as (select distinct kind, id, release_year as year,
        translate(regexp_replace(title, '[^\\p{{L}}\\p{{N}}]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as plain from tmdb_content),
    hits as (select info_hash, min(id) as id from asked a join works w on a.kind = w.kind and a.plain <> '' and w.plain <> ''
        and (a.plain = w.plain or (length(a.plain) >= 8 and contains(w.plain, a.plain)) or (length(w.plain) >= 8 and contains(a.plain, w.plain)))
        and (a.year is null or coalesce(abs(a.year - w.year) <= 1, false)) group by info_hash)
    select a.info_hash, case when h.id is not null then 'matched' when a.title is null then 'unparsed' else 'no_match' end as status, h.id
    from asked a left join hits h using (info_hash)"""


QUERIES: dict[str, Query] = {
    "snapshot_torrents": snapshot_torrents_query,
    "snapshot_items": snapshot_items_query,
    "snapshot_summary": snapshot_summary_query,
    "snapshot_stats": snapshot_stats,
    "retained_generations": retained_generations,
    **{name: partial(browse_query, **choice) for name, (choice, _) in BROWSES.items()},
    "browse_documents": browse_documents,
    "list_quality_keys": list_quality_keys,
    **{name: _ask_show(asked) for name, asked in SHOWS.items()},
    "show_torrents": show_torrents_query,
    "show_episodes": show_episodes_query,
    "corr_exact": corr_exact,
    "corr_ambiguous_rejected": corr_ambiguous_rejected,
    "corr_shared_hash": corr_shared_hash,
    "corr_pending": corr_pending,
    "corr_match_evidence": corr_match_evidence,
    "corr_conflict_guard": corr_conflict_guard,
    "merge_upgrade": merge_upgrade,
    "merge_new_only": snapshot_merge_new,
    "enrich_worklist": enrich_worklist,
    "enrich_decision": enrich_decision,
    "provider_listagg": provider_listagg,
    "genre_arrays": genre_arrays,
    "latest_nonnull": latest_nonnull,
    "attr_pivot": attr_pivot,
    "keyword_tokens": keyword_tokens,
}

SQL: dict[str, str] = {
    **SNAPSHOT_SQL,
    "snapshot_stats": STATS_SQL,
    "retained_generations": RETAINED_SQL,
    **{name: browse_sql(**choice) for name, (_, choice) in BROWSES.items()},
    "list_quality_keys": QUALITY_SQL,
    **{name: _show_sql(asked) for name, asked in SHOWS.items()},
    "show_torrents": SHOW_TORRENTS_SQL,
    "show_episodes": SHOW_EPISODES_SQL,
    "corr_exact": ctes(*EXACT_CTES) + "select * from correlations",
    "corr_ambiguous_rejected": ctes(*EXACT_CTES)
    + """select content_type, content_source, content_id, count(distinct canonical_id) as canonicals from id_pairs
      join latest using (content_type, content_source, content_id) group by all having count(distinct canonical_id) > 1""",
    "corr_shared_hash": SHARED_SQL,
    "corr_pending": PENDING_SQL,
    "corr_match_evidence": ctes(*MATCH_CTES) + "select * from evidence",
    "corr_conflict_guard": ctes(*EXACT_CTES, *MATCH_CTES)
    + """select distinct e.info_hash, e.content_type, e.tmdb_id from evidence e join correlations c using (content_type, content_source, content_id)
      where c.canonical_id <> e.tmdb_id""",
    "merge_upgrade": UPGRADE_SQL,
    "enrich_worklist": WORKLIST_SQL,
    "enrich_decision": decision_sql(PARSE_SQL.replace("record_id", "name").replace("from torrent_records)", "from names)")),
    "provider_listagg": ctes(SNAPSHOT_CTES[6]) + "select * from provider_lists",
    "genre_arrays": ctes() + "select content_type, content_source, content_id, string_agg(name, '|' order by name) as genres from genres group by all",
    "latest_nonnull": ctes()
    + """select info_hash, (array_agg(video_resolution order by updated_at desc, video_resolution desc) filter (where video_resolution is not null))[1]
      as video_resolution from links group by info_hash""",
    "attr_pivot": ctes()
    + """select content_type, content_source, content_id, min(case when key = 'imdb_id' then value end) as imdb_id,
      min(case when key = 'poster_path' then value end) as poster_path, min(case when key = 'tmdb_id' then value end) as tmdb_id
      from attributes group by all""",
    "merge_new_only": ctes(*EXACT_CTES)
    + f"""select * from correlations union all select p.* from ({PENDING_SQL}) p
      where not exists (select 1 from correlations c where c.content_type = p.content_type and c.content_source = p.content_source and c.content_id = p.content_id)""",
    "keyword_tokens": "select kind, id, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')) as tokens from tmdb_content",
}
