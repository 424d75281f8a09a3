"""Conversions, filters, joins and aggregates, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelloom.functions import names, scalars
from reelloom.functions.infohash import hash_of_delivery, normalize_info_hash
from reelloom.functions.sizes import name_bytes, size_text_bytes
from reelloom.operators import pacing
from reelloom.operators.merge import first_of_each, unseen
from reelloom.operators.pairs import sharing_pairs, whole
from reelloom.plans.catalog import BACKDROPS, POSTERS
from reelloom.plans.enrich import title_matches
from reelloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "torrent_records").select("record_id", "name")


def parse_release_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _names(spark, sf_dir).withColumn("p", names.parse_release_name(F.col("name")))
    return rows.select("record_id", "p.kind", "p.title", "p.year")


PARSE_SQL = r"""
with t as (select record_id, trim(regexp_replace(trim(regexp_replace(name, '(?i)\.(mkv|mp4|avi|mov|wmv|m4v)$', ''), ' '), '^\[[A-Za-z0-9 \-_.]*\]', ''), ' ') as x from torrent_records),
m as (select *, case when regexp_matches(x, '(?i)\bS\d{1,2}E\d{1,3}\b|\bSeason\s+\d{1,2}\b|\s-\s\d{1,3}\b') then 'tv_show' else 'movie' end as kind,
  nullif(regexp_extract(x, '\b(?:19|20)\d{2}\b'), '') as y,
  case when regexp_matches(x, '(?i)\bS\d{1,2}E\d{1,3}\b|\bSeason\s+\d{1,2}\b|\s-\s\d{1,3}\b')
    then length(regexp_extract(x, '(?is)^(.*?)(?:\bS\d{1,2}E\d{1,3}\b|\bSeason\s+\d{1,2}\b|\s-\s\d{1,3}\b)', 1)) end as mark,
  case when regexp_matches(x, '(?i)\b(?:2160p|1080p|720p|480p|web-?dl|webrip|bluray|brrip|x264|x265|h\.?264|h\.?265|hevc)\b')
    then length(regexp_extract(x, '(?is)^(.*?)(?:\b(?:2160p|1080p|720p|480p|web-?dl|webrip|bluray|brrip|x264|x265|h\.?264|h\.?265|hevc)\b)', 1)) end as noise from t),
c as (select *, case when kind = 'tv_show' then coalesce(least(mark, strpos(x, y) - 1), length(x))
  else coalesce(strpos(x, y) - 1, noise, length(x)) end as cut from m),
d as (select *, trim(trim(regexp_replace(translate(substr(x, 1, cut), '._', '  '), '\s+', ' ', 'g'), ' '), '-:[]() ') as title from c)
select record_id, kind, case when length(regexp_replace(title, '[^\p{L}\p{M}\p{N}]', '', 'g')) >= 3 then title end as title, cast(y as int) as year from d
"""


def normalized_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "tmdb_content")
    return works.select("kind", "id", names.normalized_title(F.col("title")).alias("plain"), names.normalized_title(F.col("original_title")).alias("original"))


NORMALIZED_SQL = r"""
select kind, id, translate(regexp_replace(title, '[^\p{L}\p{N}]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as plain,
  translate(regexp_replace(original_title, '[^\p{L}\p{N}]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as original
from tmdb_content
"""


def genre_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    genres = table(spark, sf_dir, "content_collections").select("id", "name", scalars.genre_slug(F.col("name")).alias("slug"))
    return genres.withColumn("title", scalars.title_of_slug(F.col("slug")))


SLUG_SQL = r"""
with s as (select id, name, trim(lower(regexp_replace(regexp_replace(name, '\s', '-', 'g'), '[^A-Za-z0-9\-]', '', 'g')), '-') as slug from content_collections)
select id, name, slug, array_to_string(list_transform(list_filter(string_split(slug, '-'), lambda p: p <> ''), lambda p: upper(p[1]) || p[2:]), ' ') as title from s
"""


def resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scalars.video_resolution(F.col("name"))
    return _names(spark, sf_dir).select("record_id", found.alias("video_resolution"), scalars.normalized_quality(found).alias("quality"))


RESOLUTION_SQL = """
with r as (select record_id, case when contains(lower(name), '2160p') then 'V2160p' when contains(lower(name), '1080p') then 'V1080p'
  when contains(lower(name), '720p') then 'V720p' when contains(lower(name), '480p') then 'V480p' end as video_resolution from torrent_records)
select record_id, video_resolution, coalesce(lower(substr(video_resolution, 2)), 'unknown') as quality from r
"""


def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "tmdb_content")
    return works.select("kind", "id", scalars.stable_item_id(F.col("title"), F.col("release_year")).alias("stable_id"), scalars.checkpoint_id(F.col("kind"), F.col("title")).alias("checkpoint"))


STABLE_SQL = """
select kind, id, substr(sha256(lower(title) || chr(0) || coalesce(release_year, 0)), 1, 32) as stable_id,
  kind || ':' || substr(sha256(title), 1, 16) as checkpoint from tmdb_content
"""


def size_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "torrent_records").where("size_text is not null")
    return rows.select("record_id", scalars.page_size_bytes(F.col("size_text")).alias("bytes"))


SIZE_SQL = r"""
with s as (select record_id, regexp_extract(size_text, '(?i)\b(\d+(?:[.,]\d+)?)\s*(bytes?|[kmgt]i?b)\b', ['v', 'u']) as m from torrent_records where size_text is not null),
f as (select record_id, try_cast(replace(m.v, ',', '.') as decimal(20, 5)) as v, case lower(m.u) when 'byte' then 1 when 'bytes' then 1 when 'kb' then 1000 when 'kib' then 1024
  when 'mb' then 1000000 when 'mib' then 1048576 when 'gb' then 1000000000 when 'gib' then 1073741824 when 'tb' then 1000000000000 when 'tib' then 1099511627776 end as n from s)
select record_id, cast(round(v * cast(n as decimal(14, 0))) as bigint) as bytes from f
"""


def size_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in all notations, from size_text and from names."""
    rows = table(spark, sf_dir, "torrent_records")
    return rows.select("record_id", size_text_bytes(F.col("size_text")).alias("stated"), name_bytes(F.col("name")).alias("named"))


def episode_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).withColumn("e", scalars.episode_of_path(F.col("name"))).where("e is not null").select("record_id", "e.season", "e.episode")


EPISODE_SQL = r"""
with e as (select record_id, regexp_extract(name, '(?i)s(\d{1,3})[ ._-]*e(\d{1,3})|(\d{1,3})x(\d{1,3})', ['a', 'b', 'c', 'd']) as m from torrent_records)
select record_id, cast(coalesce(nullif(m.a, ''), m.c) as int) as season, cast(coalesce(nullif(m.b, ''), m.d) as int) as episode from e where m.a <> '' or m.c <> ''
"""


def hash_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "torrent_records")
    return rows.select("record_id", normalize_info_hash(F.col("info_hash")).alias("bare"), hash_of_delivery(F.col("info_hash")).alias("delivered"))


_BASE32 = """array_to_string(list_transform(range(0, 4), lambda g: printf('%010x', list_reduce(list_transform(range(1, 9), lambda i:
    CAST(strpos('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', substr(upper({x}), CAST(g * 8 + i AS BIGINT), 1)) - 1 AS BIGINT)), lambda a, b: a * 32 + b))), '')"""


def _hash_sql(x: str) -> str:
    return f"""case when regexp_matches({x}, '^[0-9A-Fa-f]{{40}}$') then lower({x}) when regexp_matches({x}, '^[A-Za-z2-7]{{32}}$') then {_BASE32.format(x=x)} end"""


HASH_SQL = f"""
with t as (select record_id, trim(info_hash, e' \\t\\n\\r\\f' || chr(11) || chr(160) || chr(8203) || chr(12288)) as x from torrent_records),
u as (select *, case when lower(x) like 'magnet:%' then regexp_extract(x, '(?i)[?&]xt=urn(?::|%3a)btih(?::|%3a)([^&#]*)', 1) else x end as y from t)
select record_id, {_hash_sql('x')} as bare, {_hash_sql('y')} as delivered from u
"""


def imdb_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "catalog_items")
    return items.select("row_id", scalars.is_imdb_id(F.col("id")).alias("imdb"))


def image_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "catalog_items")
    return items.select("row_id", scalars.image_url(POSTERS, F.col("poster")).alias("poster"), scalars.image_url(BACKDROPS, F.col("fanart")).alias("fanart"))


def _image_sql(base: str, column: str) -> str:
    text = f"trim({column}, e' \\t\\n\\r')"
    return f"""case when coalesce({text}, '') = '' then null when starts_with({text}, 'http://') or starts_with({text}, 'https://') then {text}
      else '{base}/' || ltrim({text}, '/') end as {column}"""


def rating_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "catalog_items")
    return items.select("row_id", scalars.clamp_rating(F.col("rating")).alias("rating"))


def title_match_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of works of which one's title holds the other's, within a year."""
    works = table(spark, sf_dir, "tmdb_content").select("kind", "id", "title", F.col("release_year").alias("year")).distinct()
    wanted = works.select(F.concat_ws("-", "kind", "id").alias("info_hash"), "kind", "title", "year")
    return title_matches(wanted, works).select(F.col("info_hash").alias("work"), F.col("id").alias("match"))


THETA_SQL = r"""
with w as (select distinct kind, id, release_year as year,
    translate(regexp_replace(title, '[^\p{L}\p{N}]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as plain from tmdb_content)
select distinct a.kind || '-' || a.id as work, b.id as match from w a join w b on a.kind = b.kind and a.plain <> '' and b.plain <> ''
  and (a.plain = b.plain or (length(a.plain) >= 8 and contains(b.plain, a.plain)) or (length(b.plain) >= 8 and contains(a.plain, b.plain)))
  and (a.year is null or coalesce(abs(a.year - b.year) <= 1, false))
"""


def unseen_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type, user and hour of the day didn't occur in the first
    half of the log."""
    events = table(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    half = events.agg(F.max("event_id") / 2).first()[0]
    return unseen(events.where(F.col("event_id") > half), events.where(F.col("event_id") <= half), ["event_type", "user_id", "hour"]).select("event_id", "event_type", "user_id")


UNSEEN_SQL = """
with h as (select max(event_id) / 2 as half from events)
select event_id, event_type, user_id from events a, h where event_id > half and not exists (
  select 1 from events b where b.event_id <= h.half and b.event_type = a.event_type and b.user_id = a.user_id and hour(b.ts) = hour(a.ts))
"""


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return first_of_each(events, ["event_type", "user_id"], [F.col("event_id")]).select("event_id", "event_type", "user_id")


def in_list_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the customers of one segment with a negative balance."""
    wanted = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def quota_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pacing.hourly_quota(table(spark, sf_dir, "events"), "event_type", "ts", [F.col("event_id")], 2)
    return rows.select("event_id", "event_type", "admitted")


def repeat_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of the order status along each customer's orders."""
    orders = table(spark, sf_dir, "orders")
    rows = pacing.repeat_counts(orders, "o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderpriority").isNull())
    return rows.select("o_orderkey", "repeated_pages")


REPEAT_SQL = """
with s as (select *, coalesce(o_orderstatus = lag(o_orderstatus) over (partition by o_custkey order by o_orderkey), false) and o_orderpriority is not null as same from orders),
r as (select *, sum(case when same then 0 else 1 end) over (partition by o_custkey order by o_orderkey) as run from s)
select o_orderkey, cast(sum(case when same then 1 else 0 end) over (partition by o_custkey, run order by o_orderkey) as int) as repeated_pages from r
"""


def schedule_least_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation the customer with the fewest orders, as a cursor table."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("next_page"))
    states = table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_nationkey", F.col("c_name").alias("kind"), "next_page", F.col("c_custkey").alias("ordinal"), (F.col("c_acctbal") < 0).alias("completed")
    )
    return pacing.least_advanced(states, "c_nationkey")


SCHEDULE_SQL = """
with s as (select c_nationkey, c_name as kind, c_custkey as ordinal, c_acctbal < 0 as completed, count(*) as next_page
  from customer join orders on o_custkey = c_custkey group by all)
select c_nationkey, (array_agg(kind order by next_page, ordinal))[1] as kind, min(next_page) as next_page from s where not completed group by c_nationkey
"""


def page_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the set of users of each type and day."""
    identities = F.transform(F.collect_list(F.col("user_id").cast("string")), lambda u: F.concat(F.lit("h"), u))
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day"))
    return rows.agg(pacing.page_fingerprint(identities).alias("fingerprint"))


FINGERPRINT_SQL = """
with i as (select event_type, cast(cast(ts as date) as varchar) as day, 'h' || user_id as x from events)
select event_type, day, sha256(from_hex(string_agg(lpad(lower(to_hex(strlen(x))), 16, '0') || lower(hex(encode(x))), '' order by x))) as fingerprint from i group by all
"""


def job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("fetched", (F.col("value") * 100000).cast("bigint")).withColumn("one", F.lit(1))
    return pacing.job_totals(rows, "event_type", ["fetched", "one"])


TOTALS_SQL = """
select event_type, cast(least(sum(cast(trunc(value * 100000) as bigint)), 2147483647) as int) as fetched, cast(least(count(*), 2147483647) as int) as one from events group by event_type
"""


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the sources of a job."""
    n = lambda i: F.count_if(F.col("event_id") % 7 == i)
    jobs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("sources"), n(0).alias("failed"), n(1).alias("deferred"), n(2).alias("saturated"))
    return jobs.select("user_id", pacing.job_status(*[F.col(c) for c in ("failed", "sources", "failed", "deferred", "saturated")]).alias("status"))


STATUS_SQL = """
with j as (select user_id, count(*) as n, count(*) filter (event_id % 7 = 0) as f, count(*) filter (event_id % 7 = 1) as d, count(*) filter (event_id % 7 = 2) as s
  from events group by user_id)
select user_id, case when f >= n then 'failed' when f > 0 or d > 0 or s > 0 then 'partial' else 'completed' end as status from j
"""


def lateral_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest line of each order."""
    lines = table(spark, sf_dir, "lineitem")
    best = lines.groupBy("l_orderkey").agg(
        F.max_by(F.struct("l_partkey", "l_extendedprice"), F.struct("l_extendedprice", "l_partkey", "l_suppkey")).alias("b")
    )
    return best.select("l_orderkey", "b.*")


def exists_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are urgent or have a returned line: the flag is aggregated
    before the join."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("returned", F.lit(True))
    orders = table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left")
    return orders.where((F.col("o_orderpriority") == "1-URGENT") | F.col("returned").isNotNull()).select("o_orderkey")


EXISTS_SQL = "select o_orderkey from orders o where o_orderpriority = '1-URGENT' or exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l_returnflag = 'R')"


def disjunctive_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of one nation or of one balance."""
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nation = F.col("c_nationkey"), F.col("s_nationkey")
    balance = whole(F.col("c_acctbal")), whole(F.col("s_acctbal"))
    return sharing_pairs(customers, suppliers, "c_custkey", "s_suppkey", [nation, balance])


DISJUNCTIVE_SQL = """
select distinct c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey or floor(c_acctbal) = floor(s_acctbal)
"""


def json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(props).alias("key", "value"))


JSON_SQL = "select event_id, unnest(json_keys(props)) as key, unnest(list_transform(json_keys(props), lambda k: props ->> k)) as value from events"


def json_object_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each key over the events of a type, as one object."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    last = rows.where("k is not null").groupBy("event_type", "k").agg(F.max_by("event_id", "event_id").alias("v"))
    pairs = F.array_sort(F.collect_list(F.struct("k", F.col("v").cast("string").alias("v"))))
    return last.groupBy("event_type").agg(F.array_join(F.transform(F.map_entries(F.map_from_entries(pairs)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("latest"))


OBJECT_SQL = """
with l as (select event_type, props ->> 'k' as k, max(event_id) as v from events where props ->> 'k' is not null group by all)
select event_type, string_agg(k || '=' || v, ',' order by k) as latest from l group by event_type
"""


def json_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", value.alias("k")).where("k between 0 and 65535")


GUARDS_SQL = "select event_id, try_cast(props ->> 'k' as bigint) as k from events where try_cast(props ->> 'k' as bigint) between 0 and 65535"


def window_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows ordered within each customer, as a numbered list."""
    window = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(window).cast("bigint").alias("place"))


QUERIES: dict[str, Query] = {
    "parse_release_name": parse_release_name,
    "normalized_title": normalized_title,
    "genre_slug": genre_slug,
    "resolution": resolution,
    "stable_id": stable_id,
    "size_text": size_text,
    "size_statements": size_statements,
    "episode_path": episode_path,
    "hash_normalize": hash_normalize,
    "imdb_test": imdb_test,
    "image_url": image_url,
    "rating_clamp": rating_clamp,
    "title_match_theta": title_match_theta,
    "unseen_anti": unseen_anti,
    "dedup_keep_first": dedup_keep_first,
    "in_list_semi": in_list_semi,
    "quota_hourly": quota_hourly,
    "repeat_counter": repeat_counter,
    "schedule_least_advanced": schedule_least_advanced,
    "page_fingerprint": page_fingerprint,
    "job_totals": job_totals,
    "job_status": job_status,
    "lateral_top1": lateral_top1,
    "exists_or": exists_or,
    "disjunctive_join": disjunctive_join,
    "json_explode": json_explode,
    "json_object_agg": json_object_agg,
    "json_guards": json_guards,
    "rank_rows": window_share,
}

SQL: dict[str, str] = {
    "parse_release_name": PARSE_SQL,
    "normalized_title": NORMALIZED_SQL,
    "genre_slug": SLUG_SQL,
    "resolution": RESOLUTION_SQL,
    "stable_id": STABLE_SQL,
    "size_text": SIZE_SQL,
    "episode_path": EPISODE_SQL,
    "hash_normalize": HASH_SQL,
    "imdb_test": "select row_id, coalesce(regexp_matches(id, '^tt[0-9]{5,}$'), false) as imdb from catalog_items",
    "image_url": f"select row_id, {_image_sql(POSTERS, 'poster')}, {_image_sql(BACKDROPS, 'fanart')} from catalog_items",
    "rating_clamp": "select row_id, greatest(0.0::double, least(10.0::double, coalesce(case when isnan(rating) then 0 else rating end, 0))) as rating from catalog_items",
    "title_match_theta": THETA_SQL,
    "unseen_anti": UNSEEN_SQL,
    "dedup_keep_first": "select min(event_id) as event_id, event_type, user_id from events group by event_type, user_id",
    "in_list_semi": "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)",
    "quota_hourly": "select event_id, event_type, row_number() over (partition by event_type, date_trunc('hour', ts) order by event_id) <= 2 as admitted from events",
    "repeat_counter": REPEAT_SQL,
    "schedule_least_advanced": SCHEDULE_SQL,
    "page_fingerprint": FINGERPRINT_SQL,
    "job_totals": TOTALS_SQL,
    "job_status": STATUS_SQL,
    "lateral_top1": """select l_orderkey, b.l_partkey as l_partkey, b.l_extendedprice as l_extendedprice from (
      select l_orderkey, (array_agg(struct_pack(l_partkey := l_partkey, l_extendedprice := l_extendedprice)
        order by l_extendedprice desc, l_partkey desc, l_suppkey desc))[1] as b from lineitem group by l_orderkey)""",
    "exists_or": EXISTS_SQL,
    "disjunctive_join": DISJUNCTIVE_SQL,
    "json_explode": JSON_SQL,
    "json_object_agg": OBJECT_SQL,
    "json_guards": GUARDS_SQL,
    "rank_rows": "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders",
}
