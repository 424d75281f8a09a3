"""Merges, pending links, streams and documents read from sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelloom.operators.merge import fill_text, greatest, insert_missing, keep, merge, merge_episodes, overwrite
from reelloom.operators import jobs
from reelloom.plans import correlate, links
from reelloom.plans.catalog import KEY
from reelloom.plans.derive import ctes, derived
from reelloom.session import is_folder, scratch_path, table
from reelloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Works as a target with gaps, and others of the same keys as a source."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    target = part.where(k % 4 < 3).select(
        k.alias("id"), F.when(k % 5 == 0, F.lit("")).otherwise(F.col("p_name")).alias("title"), F.when(k % 3 != 0, F.col("p_size")).alias("year"), F.when(k % 2 == 0, F.col("p_retailprice")).alias("peers")
    )
    source = part.where(k % 4 > 0).select(k.alias("id"), F.col("p_type").alias("title"), (F.col("p_size") + 1).alias("year"), (F.col("p_retailprice") + k % 3 - 1).alias("peers"))
    return target, source


HALVES = """with t as (select p_partkey as id, case when p_partkey % 5 = 0 then '' else p_name end as title, case when p_partkey % 3 <> 0 then p_size end as year,
    case when p_partkey % 2 = 0 then p_retailprice end as peers from part where p_partkey % 4 < 3),
  s as (select p_partkey as id, p_type as title, p_size + 1 as year, p_retailprice + p_partkey % 3 - 1 as peers from part where p_partkey % 4 > 0)
"""


def merge_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge(*_halves(spark, sf_dir), ["id"], {"title": fill_text, "year": keep, "peers": keep})


def merge_greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge(*_halves(spark, sf_dir), ["id"], {"peers": greatest})


def merge_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge(*_halves(spark, sf_dir), ["id"], {}, default=overwrite)


def merge_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge(*_halves(spark, sf_dir), ["id"], {}, default=overwrite, only_if=lambda t, s: t["year"] + 1 == s["year"])


def merge_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_missing(*_halves(spark, sf_dir), ["id"])


def _merge_sql(title: str, year: str, peers: str) -> str:
    pick = lambda c, rule: f"case when t.id is null then s.{c} when s.id is null then t.{c} else {rule} end as {c}"
    return f"{HALVES} select coalesce(t.id, s.id) as id, {pick('title', title)}, {pick('year', year)}, {pick('peers', peers)} from t full join s on t.id = s.id"


def _episode_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Season maps of two deliveries: orders as shows, days and hours as numbers."""
    lines = table(spark, sf_dir, "lineitem")

    def side(rows: DataFrame, mark: str) -> DataFrame:
        season, episode = (F.col("l_linenumber") % 2).cast("string"), (F.col("l_partkey") % 5).cast("string")
        one = rows.select(F.col("l_orderkey").alias("id"), season.alias("season"), episode.alias("episode")).distinct()
        inner = one.groupBy("id", "season").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("episode", F.lit(mark))))).alias("m"))
        return inner.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("season", "m")), lambda a, b: F.when(a["season"] < b["season"], -1).otherwise(1))).alias("episodes"))

    return side(lines.where("l_orderkey % 3 < 2"), "old"), side(lines.where("l_orderkey % 3 > 0 and l_quantity > 20"), "new")


def merge_episode_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge(*_episode_sides(spark, sf_dir), ["id"], {"episodes": merge_episodes})
    seasons = merged.select("id", F.explode("episodes").alias("season", "m"))
    return seasons.select("id", "season", F.explode("m").alias("episode", "delivery"))


EPISODES_SQL = """
with x as (select l_orderkey as id, cast(l_linenumber % 2 as varchar) as season, cast(l_partkey % 5 as varchar) as episode,
    bool_or(l_orderkey % 3 > 0 and l_quantity > 20) as fresh, bool_or(l_orderkey % 3 < 2) as old from lineitem group by all)
select id, season, episode, case when fresh then 'new' else 'old' end as delivery from x where fresh or old
"""


def _staged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links known, links pending, and the torrents that have arrived."""
    links, torrents = derived(spark, sf_dir, "links", "torrents")
    one = F.create_map(F.col("season").cast("string"), F.create_map(F.col("episode").cast("string"), F.lit("true")))
    links = links.withColumn("episodes", one)
    columns = ["info_hash", *KEY, "seeders", "leechers", "video_resolution", "episodes"]
    known = links.where("l_orderkey % 4 < 3").select(*columns)
    pending = links.where("l_orderkey % 4 > 1").withColumn("seeders", F.col("seeders") + 1).withColumn("video_resolution", F.lit("V480p")).select(*columns)
    return known, pending, torrents.where("o_orderkey % 4 <> 3 or o_orderkey % 3 = 0").select("info_hash", "size")


def pending_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, pending, arrived = _staged(spark, sf_dir)
    merged, _ = correlate.materialize_pending(pending, arrived, known)
    return merged.withColumn("episodes", F.to_json("episodes"))


def pending_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, pending, arrived = _staged(spark, sf_dir)
    _, rest = correlate.materialize_pending(pending, arrived, known)
    return rest.select("info_hash", *KEY)


RECONCILE_SQL = ctes("arrived as (select info_hash from torrents where o_orderkey % 4 <> 3 or o_orderkey % 3 = 0)") + """
select info_hash, content_type, content_source, content_id,
  case when l_orderkey % 4 = 2 then seeders + 1 when l_orderkey % 4 = 3 then seeders + 1 else seeders end as seeders, leechers,
  case when l_orderkey % 4 = 3 then 'V480p' when l_orderkey % 4 = 2 then coalesce(video_resolution, 'V480p') else video_resolution end as video_resolution,
  '{"' || season || '":{"' || episode || '":"true"}}' as episodes
from links where l_orderkey % 4 < 3 or info_hash in (select info_hash from arrived)
"""
CLEAR_SQL = ctes("arrived as (select info_hash from torrents where o_orderkey % 4 <> 3 or o_orderkey % 3 = 0)") + """
select info_hash, content_type, content_source, content_id from links where l_orderkey % 4 > 1 and info_hash not in (select info_hash from arrived)
"""


def attach_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each torrent of an even order also linked to the canonical content 0."""
    links, torrents = derived(spark, sf_dir, "links", "torrents")
    matches = torrents.where("o_orderkey % 2 = 0").select("info_hash", F.lit("movie").alias("content_type"), F.lit("0").alias("tmdb_id"))
    rows = correlate.attach_canonical(links.drop("l_orderkey", "season", "episode"), matches)
    return rows.groupBy("content_type", "content_source").agg(
        F.count(F.lit(1)).alias("links"), F.sum(F.col("seeders").cast("bigint")).alias("seeders"), F.count("video_resolution").alias("resolutions")
    )


ATTACH_SQL = ctes(
    """best as (select * from (select *, row_number() over (partition by info_hash order by (content_source = 'tmdb') desc, updated_at desc, content_id) as place from links) where place = 1)""",
    """rows as (
        select l.content_type, l.content_source, case when m.info_hash is null then l.seeders else greatest(l.seeders, m.seeders) end as seeders,
          case when m.info_hash is null then l.video_resolution else coalesce(l.video_resolution, m.video_resolution) end as video_resolution
        from links l left join best m on m.info_hash = l.info_hash and l.l_orderkey % 2 = 0 and l.content_type = 'movie' and l.content_source = 'tmdb' and l.content_id = '0'
        union all
        select 'movie', 'tmdb', b.seeders, b.video_resolution from best b where b.l_orderkey % 2 = 0 and not exists (
          select 1 from links l where l.info_hash = b.info_hash and l.content_type = 'movie' and l.content_source = 'tmdb' and l.content_id = '0'))""",
) + "select content_type, content_source, count(*) as links, sum(seeders)::bigint as seeders, count(video_resolution) as resolutions from rows group by all"


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as torrents of shows: suppliers are shows, orders torrents."""
    flag = F.col("l_returnflag")
    quality = F.when(flag == "R", F.lit("1080p WEB")).when(flag == "A", F.lit("720p"))
    return table(spark, sf_dir, "lineitem").select(
        F.lit("tv_show").alias("content_type"), F.lit("butter-a").alias("content_source"), F.col("l_suppkey").cast("string").alias("content_id"),
        (F.col("l_partkey") * 100 + F.col("l_linenumber") * 10 + F.when(flag == "R", 2).when(flag == "A", 1).otherwise(0)).alias("ordinal"),
        F.sha1(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string"))).alias("info_hash"), quality.alias("quality"),
        F.col("l_quantity").cast("int").alias("seeders"), F.col("l_linenumber").alias("leechers"),
        F.when(F.col("l_partkey") % 5 > 0, F.col("l_linenumber")).alias("season"), (F.col("l_partkey") % 5).cast("int").alias("episode"), F.lit(None).cast("string").alias("file"),
    )


def link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = links.grouped_links(_delivered(spark, sf_dir))
    seasons = F.array_join(F.array_sort(F.map_keys("episodes")), ",")
    return made.select("info_hash", "content_id", "seeders", "leechers", "video_resolution", seasons.alias("seasons"))


LINK_GROUPS_SQL = """
with d as (select sha1('order-' || l_orderkey) as info_hash, cast(l_suppkey as varchar) as content_id, cast(l_quantity as int) as seeders, l_linenumber as leechers,
    case l_returnflag when 'R' then 'V1080p' when 'A' then 'V720p' end as quality,
    l_partkey * 100 + l_linenumber * 10 + case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end as ordinal,
    case when l_partkey % 5 > 0 then cast(l_linenumber as varchar) end as season from lineitem)
select info_hash, content_id, max(seeders) as seeders, max(leechers) as leechers,
  (array_agg(quality order by ordinal) filter (where quality is not null))[1] as video_resolution, string_agg(distinct season, ',' order by season) as seasons
from d group by info_hash, content_id
"""


def resolution_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as downloads to resolve: users of even number are known already."""
    events = table(spark, sf_dir, "events")
    pending = events.select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("locator"), F.col("ts").alias("at"), "event_id")
    cache = events.where("user_id % 2 = 0").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("locator")).distinct()
    rows = jobs.resolutions(pending, cache.withColumn("info_hash", F.sha1("locator")), [F.col("event_id")], 2)
    return rows.select("event_id", "outcome")


CACHE_SQL = """
with e as (select *, user_id % 2 = 0 as known from events)
select event_id, case when known then 'cached' when row_number() over (partition by event_type, date_trunc('hour', ts), known order by event_id) <= 2
  then 'admitted' else 'deferred' end as outcome from e
"""


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's file, or its folder's files, as a stream."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    path = f"{sf_dir}/{name}.parquet"
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _collected(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All that a stream gives now, by way of files in the shared folder."""
    root = scratch_path(spark, "stream")
    ingest.run_to_end(stream, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collected(spark, ingest.first_keys(_streamed(spark, sf_dir, "events"), ["event_type", "user_id"]))


def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collected(spark, ingest.admitted(_streamed(spark, sf_dir, "events"), "event_type", "ts", "event_id", 2))


def stream_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    (links,) = derived(spark, sf_dir, "links")
    pending = links.where("l_orderkey % 4 > 1").select("info_hash", *KEY)
    orders = _streamed(spark, sf_dir, "orders").where("o_orderkey % 4 <> 3")
    torrents = orders.select(F.sha1(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))).alias("info_hash"))
    return _collected(spark, ingest.arrived_links(torrents, pending))


KEPT = "case when coalesce(t.title, '') = '' then s.title else t.title end"
QUERIES: dict[str, Query] = {
    "merge_fill_missing": merge_fill_missing,
    "merge_greatest": merge_greatest,
    "merge_overwrite": merge_overwrite,
    "merge_conditional": merge_conditional,
    "merge_insert_ignore": merge_insert_ignore,
    "merge_episode_maps": merge_episode_maps,
    "pending_reconcile": pending_reconcile,
    "pending_clear": pending_clear,
    "attach_canonical": attach_canonical,
    "link_groups": link_groups,
    "resolution_cache": resolution_cache,
    "stream_dedup": stream_dedup,
    "stream_quota": stream_quota,
    "stream_pending": stream_pending,
}

SQL: dict[str, str] = {
    "merge_fill_missing": _merge_sql(KEPT, "coalesce(t.year, s.year)", "coalesce(t.peers, s.peers)"),
    "merge_greatest": _merge_sql("coalesce(t.title, s.title)", "coalesce(t.year, s.year)", "greatest(t.peers, s.peers)"),
    "merge_overwrite": _merge_sql("s.title", "s.year", "s.peers"),
    "merge_conditional": _merge_sql(*[f"case when t.year + 1 = s.year then s.{c} else t.{c} end" for c in ("title", "year", "peers")]),
    "merge_insert_ignore": HALVES + "select * from t union all select * from s where id not in (select id from t)",
    "merge_episode_maps": EPISODES_SQL,
    "pending_reconcile": RECONCILE_SQL,
    "pending_clear": CLEAR_SQL,
    "attach_canonical": ATTACH_SQL,
    "link_groups": LINK_GROUPS_SQL,
    "resolution_cache": CACHE_SQL,
    "stream_dedup": "select distinct event_type, user_id from events",
    "stream_quota": "select event_id, event_type, row_number() over (partition by event_type, date_trunc('hour', ts) order by event_id) <= 2 as admitted from events",
    "stream_pending": ctes() + "select info_hash, content_type, content_source, content_id from links where l_orderkey % 4 > 1 and l_orderkey % 4 <> 3",
}
