"""Catalogue-shaped tables derived from the driver's star schema.

The definitions are SQL that Spark and other engines read alike, so that both
sides of a comparison start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelloom.session import table

_FAMILY = "(p_partkey - p_partkey % 6 + p_partkey % 2)"
_TEXT = "cast({} as varchar(20))".format

# The derivation's text, in order of dependence.
VIEWS = {
    "contents": f"""
        select case when p_partkey % 2 = 0 then 'movie' else 'tv_show' end as type,
          case when p_partkey % 6 < 2 then 'tmdb' when p_partkey % 6 < 4 then 'butter-a' else 'butter-b' end as source,
          case when p_partkey % 6 < 2 then {_TEXT(_FAMILY)}
            when p_partkey % 6 < 4 then concat('tt', lpad({_TEXT(_FAMILY)}, 7, '0'))
            else concat('fb-', {_TEXT(_FAMILY)}) end as id,
          p_name as title,
          case when p_partkey % 11 = 0 then null else 1950 + p_size end as release_year,
          case when p_partkey % 7 = 0 then null else p_partkey % 50 = 0 end as adult,
          concat('About ', p_name) as overview,
          p_retailprice as popularity,
          case when p_partkey % 13 = 0 then null else cast(p_size % 11 as double) end as vote_average,
          case when p_partkey % 5 = 0 then 'ja' when p_partkey % 5 = 1 then null else 'en' end as original_language,
          p_partkey, p_type, p_brand, {_FAMILY} as family
        from {{part}}""",
    "attributes": """
        select type as content_type, source as content_source, id as content_id, 'tmdb' as source, 'imdb_id' as key,
          concat('tt', lpad(cast(family as varchar(20)), 7, '0')) as value
        from {contents} where source = 'tmdb' and family % 4 < 3
        union all
        select type, source, id, source, 'tmdb_id', cast(family as varchar(20)) from {contents} where source = 'butter-b' and family % 3 = 0
        union all
        select type, source, id, source, 'imdb_id', concat('tt', lpad(cast(family + 6 as varchar(20)), 7, '0'))
        from {contents} where source = 'butter-b' and p_partkey % 12 = 4
        union all
        select type, source, id, source, 'poster_path', concat('/p', cast(p_partkey as varchar(20)), '.jpg') from {contents} where p_partkey % 3 <> 0""",
    "genres": """
        select type as content_type, source as content_source, id as content_id, p_type as name from {contents}
        union all select type, source, id, p_brand from {contents}
        union all select type, source, id, 'Animation' from {contents} where p_partkey % 4 < 2""",
    "torrents": """
        select sha1(concat('order-', cast(o_orderkey as varchar(20)))) as info_hash,
          case o_orderkey % 6
            when 0 then concat('Harvest.Moon.', cast(o_orderkey as varchar(20)), '.', cast(1950 + o_orderkey % 70 as varchar(4)), '.1080p.WEB-DL.mkv')
            when 1 then concat('Night_Watch_', cast(o_orderkey as varchar(20)), '_S01E0', cast(o_orderkey % 9 as varchar(1)), '_720p')
            when 2 then concat('[Group A] Silent River ', cast(o_orderkey as varchar(20)), ' - 0', cast(o_orderkey % 9 as varchar(1)), ' (1080p).mkv')
            when 3 then concat('Long Road ', cast(o_orderkey as varchar(20)), ' Season 2 HDTV')
            when 4 then cast(o_orderkey as varchar(20))
            else concat('Plain title ', cast(o_orderkey as varchar(20))) end as name,
          cast(floor(o_totalprice) as bigint) as size, o_orderkey, o_orderdate
        from {orders}""",
    "links": """
        select sha1(concat('order-', cast(l_orderkey as varchar(20)))) as info_hash,
          type as content_type, source as content_source, id as content_id,
          case when l_orderkey % 10 = 0 then null else cast(max(l_quantity) as int) end as seeders,
          cast(max(l_linenumber) as int) as leechers,
          case min(l_linenumber) % 5 when 1 then 'V1080p' when 2 then 'V720p' when 3 then 'V2160p' end as video_resolution,
          min(l_shipdate) as created_at, max(l_shipdate) as updated_at,
          cast(1 + l_orderkey % 3 as int) as season, cast(min(1 + l_partkey % 12) as int) as episode, l_orderkey
        from {lineitem} join {contents} on l_partkey = p_partkey
        group by l_orderkey, type, source, id""",
    "torrent_links": """
        select distinct sha1(concat('order-', cast(l_orderkey as varchar(20)))) as info_hash, cast(l_suppkey as varchar(20)) as source
        from {lineitem} where l_suppkey % 4 <> 0""",
    "providers": "select cast(s_suppkey as varchar(20)) as key, s_name as name from {supplier}",
}
TABLES = ("part", "orders", "lineitem", "supplier")


def derived(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables, in order."""
    made: dict[str, DataFrame] = {t: table(spark, sf_dir, t) for t in TABLES}
    for name, text in VIEWS.items():
        used = {t: df for t, df in made.items() if "{" + t + "}" in text}
        made[name] = spark.sql(text, **used)
    return [made[n] for n in names]


def ctes(*extra: str) -> str:
    """``with`` clause that defines all tables for another engine."""
    plain = {t: t for t in (*TABLES, *VIEWS)}
    parts = [f"{name} as ({text.format(**plain)})" for name, text in VIEWS.items()]
    return "with " + ",\n".join([*parts, *extra]) + "\n"
