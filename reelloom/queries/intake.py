"""Documents read from sources, guards of requests, jobs and their tables.

Documents are written from the driver's tables and parsed again, so the rows
they must give follow from the tables in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelloom.api import import_payload, valid_records
from reelloom.functions.scalars import chosen_sources, folded_query, parse_boolean, truncated_error, year_of_date
from reelloom.operators import jobs
from reelloom.operators.pacing import advance_cursor, backfill_walks
from reelloom.plans import correlate, enrich, links
from reelloom.plans.catalog import browse_page, catalogue_documents, page_order, show_documents
from reelloom.plans.derive import ctes, derived
from reelloom.session import table
from reelloom.sources import bencode, catalog_json, feed, metadata_json, pages

Query = Callable[[SparkSession, str], DataFrame]
BASE = "https://feed.example/"
# White space as in ``functions.text``, for another engine's patterns.
SQL_BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}\x{b}]"
AS_OF = "2026-01-01 00:00:00"


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _stripped(column: str) -> str:
    return f"regexp_replace({column}, '^{SQL_BLANKS}+|{SQL_BLANKS}+$', '', 'g')"


def _hash_sql(t: str) -> str:
    """A hash in hex or base 32, as 40 lower-case hex characters."""
    return f"""case when regexp_matches({t}, '^[0-9A-Fa-f]{{40}}$') then lower({t})
      when regexp_matches({t}, '^[A-Za-z2-7]{{32}}$') then array_to_string(list_transform(range(0, 4), lambda g:
        printf('%010x', list_reduce(list_transform(range(1, 9), lambda i:
          cast(strpos('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', substr(upper({t}), cast(g * 8 + i as bigint), 1)) - 1 as bigint)),
          lambda a, b: a * 32 + b))), '') end"""


# Feeds and records.


def _escaped(column: Column) -> Column:
    """Text for XML, in which control characters have no place."""
    text = F.regexp_replace(column, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f￾￿]", " ")
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of torrent_records as a feed of one item, parsed again.

    A third has its hash as an attribute, a third as a link, a third as a magnet attribute; absent names and hashes leave their part out."""
    rows = table(spark, sf_dir, "torrent_records")
    place = F.col("record_id") % 3
    value = _escaped(F.col("info_hash"))
    attribute = lambda name: F.concat(F.lit(f'<torznab:attr name="{name}" value="'), value, F.lit('"/>'))
    stated = F.when(place == 0, attribute("infohash")).when(place == 1, F.concat(F.lit("<link>"), value, F.lit("</link>"))).otherwise(attribute("magneturl"))
    item = F.concat(
        F.lit('<rss xmlns:torznab="http://torznab.com/schemas/2015/feed"><channel><item>'),
        F.coalesce(F.concat(F.lit("<title>"), _escaped(F.col("name")), F.lit("</title>")), F.lit("")),
        F.coalesce(F.concat(F.lit("<size>"), _text("size"), F.lit("</size>")), F.lit("")), F.coalesce(stated, F.lit("")), F.lit("</item></channel></rss>"),
    )
    read = feed.parse_feeds(rows.select(_text("record_id").alias("indexer"), item.alias("xml")))
    return read.select("source", "entry", "info_hash", "name", "size")


FEED_ITEMS_SQL = f"""
with r as (select record_id, {_stripped("regexp_replace(coalesce(name, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g')")} as name, size,
    {_stripped("regexp_replace(coalesce(info_hash, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g')")} as given from torrent_records),
bare as (select *, case when regexp_matches(given, '(?i)^magnet:') then regexp_extract(given, '(?i)[?&]xt=urn(?::|%3a)btih(?::|%3a)([^&#]*)', 1) else '' end as linked from r),
hashed as (select *, case when record_id % 3 = 0 then {_hash_sql("given")} else {_hash_sql("linked")} end as info_hash from bare)
select 'jackett-' || record_id as source,
  case when name = '' then 'skipped' when info_hash is not null then 'record' when record_id % 3 = 0 and given <> '' then 'skipped'
    when record_id % 3 = 1 and regexp_matches(given, '(?i)^https?://') then 'pending' else 'skipped' end as entry,
  info_hash, nullif(name, '') as name, case when size >= 0 then size else 0 end as size from hashed
"""


def feed_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "torrent_records").select("info_hash", "name", "record_id", F.col("observed_at").alias("published_at"))
    return jobs.select_feed(items, year=2011).select("record_id")


def feed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "torrent_records").select("info_hash", "name", "record_id", F.col("observed_at").alias("published_at"))
    return jobs.select_feed(items, search="The  1080P").select("record_id")


def feed_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred orders, as a feed asked for recent items gives them."""
    items = table(spark, sf_dir, "orders").select(F.lpad(_text("o_orderkey"), 12, "0").alias("info_hash"), F.lit("x").alias("name"), F.col("o_orderdate").alias("published_at"))
    return jobs.select_feed(items, limit=100).select("info_hash")


def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as lines for the importer, read again."""
    records, _ = valid_records(table(spark, sf_dir, "torrent_records"))
    lines = import_payload(records)
    return lines.select(F.from_json("value", "source string, infoHash string, name string, size bigint").alias("r")).select("r.*")


IMPORT_SQL = f"""
with r as (select {_stripped("source")} as source, {_stripped("info_hash")} as given, {_stripped("name")} as name, size from torrent_records),
bare as (select *, case when regexp_matches(given, '(?i)^magnet:') then regexp_extract(given, '(?i)[?&]xt=urn(?::|%3a)btih(?::|%3a)([^&#]*)', 1) else given end as t from r),
hashed as (select *, {_hash_sql("t")} as "infoHash" from bare)
select source, "infoHash", name, greatest(0, coalesce(size, 0)) as size from hashed where source <> '' and name <> '' and "infoHash" is not null
"""


# Catalogue JSON.


def _catalogue_pages(works: DataFrame) -> DataFrame:
    torrent = lambda q: F.struct(F.concat(F.lit("magnet:?xt=urn:btih:"), F.sha1(F.concat(_text("id"), F.lit(q)))).alias("url"), F.col("vote_count").alias("seed"), F.lit("7").alias("peer"), F.lit(12).alias("size"))
    languages = F.create_map(F.lit("en"), F.create_map(F.lit("720p"), torrent("a"), F.lit("1080p"), torrent("b")))
    episode = F.array(F.struct(F.lit(2).alias("season"), F.lit("3").alias("episode"), F.create_map(F.lit("480p"), torrent("c")).alias("torrents")))
    item = F.struct(
        "title", _text("release_year").alias("year"), F.col("imdb_id"), F.struct((F.col("vote_average") * 10).alias("percentage")).alias("rating"),
        F.col("genres"), F.col("overview").alias("synopsis"), F.struct(F.col("poster_path").alias("poster"), F.col("backdrop_path").alias("fanart")).alias("images"),
        languages.alias("torrents"), F.when(F.col("kind") == "tv_show", episode).alias("episodes"),
    )
    wrapped = F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"results":['), F.to_json(item), F.lit("]}"))).otherwise(F.concat(F.lit("["), F.to_json(item), F.lit("]")))
    return works.select("kind", wrapped.alias("body"))


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched works, once each, the least of a work's fetches."""
    columns = ["title", "release_year", "imdb_id", "vote_average", "vote_count", "overview", "poster_path", "backdrop_path", "genres"]
    return table(spark, sf_dir, "tmdb_content").groupBy("kind", "id").agg(F.min(F.struct(*columns)).alias("w")).select("kind", "id", "w.*")


# The least fetch by column order, where a null comes first.
WORKS_SQL = """works as (select kind, id, unnest(w) from (select kind, id,
    first(struct_pack(title, release_year, imdb_id, vote_average, vote_count, overview, poster_path, backdrop_path, genres)
      order by title nulls first, release_year nulls first, imdb_id nulls first, vote_average nulls first, vote_count nulls first, overview nulls first,
        poster_path nulls first, backdrop_path nulls first, genres nulls first) as w from tmdb_content group by kind, id)),
items as (select *, trim(title) as named, coalesce(nullif(trim(imdb_id), ''), substr(sha256(lower(trim(title)) || chr(0) || coalesce(release_year, 0)), 1, 32)) as key
    from works where trim(title) <> '')"""


def catalogue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = catalog_json.page_items(_catalogue_pages(_works(spark, sf_dir)))
    return items.select("kind", "id", "title", "year", F.round("rating", 3).alias("rating"), "synopsis", "poster", "fanart", F.array_join("genres", "|").alias("genres"))


CATALOGUE_ITEMS_SQL = f"""with {WORKS_SQL}
select kind, key as id, named as title, cast(release_year as bigint) as year, case when vote_average is not null then round(greatest(0, least(10, vote_average * 10 / 10)), 3) end as rating, nullif(trim(overview), '') as synopsis,
  nullif(trim(poster_path), '') as poster, nullif(trim(backdrop_path), '') as fanart,
  array_to_string(list_filter(list_transform(coalesce(genres, []), lambda g: trim(g)), lambda g: g <> ''), '|') as genres from items
"""


def catalogue_torrents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Torrents anywhere in catalogue items, those of episodes with their numbers."""
    return catalog_json.item_torrents(catalog_json.page_items(_catalogue_pages(_works(spark, sf_dir))))


CATALOGUE_TORRENTS_SQL = f"""with {WORKS_SQL},
parts as (select * from (values ('a', '720p', null, null), ('b', '1080p', null, null), ('c', '480p', 2, 3)) p(mark, quality, season, episode))
select key as id, sha1(id || mark) as info_hash, case when season is null then named else named || ' S02E03' end as name, cast(12 as bigint) as size, quality,
  cast(greatest(vote_count, 0) as int) as seeders, 7 as leechers, season, episode, cast(null as varchar) as file
from items, parts where mark <> 'c' or kind = 'tv_show'
"""


def one_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three endpoints deliver overlapping works; the first to have one counts."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    sides = [
        part.where(k % m == 0).select(F.lit(n).alias("endpoint"), F.lit("movie").alias("kind"), _text("p_partkey").alias("id"), F.concat(F.col("p_name"), F.lit(f" {n}")).alias("title"))
        for n, m in enumerate((4, 3, 2))
    ]
    return catalog_json.one_catalogue(sides[2].unionByName(sides[1]).unionByName(sides[0]).unionByName(sides[0]))


def metadata_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "tmdb_content")
    movie = F.col("kind") == "movie"
    named = lambda a, c: F.when(movie if a else ~movie, F.col(c))
    answer = F.struct(
        "id", named(True, "title").alias("title"), named(False, "title").alias("name"), named(True, "original_title").alias("original_title"), named(False, "original_title").alias("original_name"),
        named(True, "release_date").alias("release_date"), named(False, "release_date").alias("first_air_date"), "overview", named(True, "runtime").alias("runtime"),
        F.when(~movie & F.col("runtime").isNotNull(), F.array("runtime")).alias("episode_run_time"), "popularity", "vote_average", "vote_count", "poster_path", "backdrop_path",
        "original_language", "adult", F.transform("genres", lambda g: F.struct(F.lit(1).alias("id"), g.alias("name"))).alias("genres"),
    )
    read = metadata_json.details(works.select("kind", F.to_json(answer).alias("body")))
    return read.withColumn("genres", F.array_join("genres", "|")).withColumn("adult", _text("adult"))


DETAILS_SQL = f"""select kind, id, coalesce(title, cast(id as varchar)) as title, original_title, release_date, try_cast(substr(release_date, 1, 4) as int) as release_year,
  nullif({_stripped("overview")}, '') as overview, runtime, popularity, vote_average, vote_count, poster_path, backdrop_path, original_language, cast(adult as varchar) as adult, array_to_string(genres, '|') as genres from tmdb_content
"""


def metadata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "tmdb_content")
    movie = F.col("kind") == "movie"
    result = F.struct("id", F.when(movie, F.col("title")).alias("title"), F.when(~movie, F.col("title")).alias("name"), F.when(movie, F.col("original_title")).alias("original_title"), F.when(~movie, F.col("original_title")).alias("original_name"), F.when(movie, F.col("release_date")).alias("release_date"), F.when(~movie, F.col("release_date")).alias("first_air_date"))
    return metadata_json.search_results(works.select("kind", F.concat(F.lit('{"results":['), F.to_json(result), F.lit("]}")).alias("body")))


# Pages, robots, torrent files.


def _page(order: Column) -> Column:
    """The page of an order: a magnet link unless its number is a multiple of 7."""
    text = order.cast("string")
    magnet = F.concat(F.lit("magnet:?xt=urn:btih:"), F.sha1(F.concat(F.lit("order-"), text)), F.when(order % 5 == 0, F.concat(F.lit("&dn=Linked%20"), text)).otherwise(F.lit("")))
    own = F.when(order % 3 == 0, F.concat(F.lit(' data-name="Own '), text, F.lit('" data-size="'), text, F.lit('"'))).otherwise(F.lit(""))
    anchor = F.when(order % 7 > 0, F.concat(F.lit('<a href="'), magnet, F.lit('"'), own, F.lit(">m</a>"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("<html><title>Page "), text, F.lit("</title><p>Size: 1,5 KiB</p>"), anchor, F.lit('<a href="/torrent/'), text, F.lit('">t</a><a href="https://other.example/torrent/1">o</a><a href="/about">a</a></html>')
    )


def html_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return pages.page_records(orders.select(_text("o_orderkey").alias("path"), _page(F.col("o_orderkey")).alias("html")))


HTML_RECORDS_SQL = """select cast(o_orderkey as varchar) as path, sha1('order-' || o_orderkey) as info_hash,
  case when o_orderkey % 3 = 0 then 'Own ' || o_orderkey when o_orderkey % 5 = 0 then 'Linked ' || o_orderkey else 'Page ' || o_orderkey end as name,
  case when o_orderkey % 3 = 0 then o_orderkey else 1536 end::bigint as size from orders where o_orderkey % 7 > 0"""


def html_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return pages.page_errors(orders.select(_text("o_orderkey").alias("path"), _page(F.col("o_orderkey")).alias("html")))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return pages.page_links(orders.select(F.lit("http://host.example/list").alias("base"), _page(F.col("o_orderkey")).alias("html")))


ROBOTS = "User-agent: *\nDisallow: /\n\nUser-agent: collector # ours\nDisallow: /a\nAllow: /a/b\nDisallow: /*/c$\nAllow: /a/even*\nCrawl-delay: 7\n"


def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, delay = pages.robots_rules(ROBOTS, "Collector")
    k = F.col("o_orderkey")
    place = F.element_at(F.array(*[F.lit(p) for p in ("/a/x", "/a/b/", "/x/c", "/a/even/", "/a/even/c", "?q=")]), (k % 6 + 1).cast("int"))
    tail = F.when((k % 6).isin(2, 4), F.lit("")).otherwise(_text("o_orderkey"))
    urls = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("https://host.example"), place, tail).alias("url"))
    return pages.robots_allowed(urls, rules).select("o_orderkey", "allowed", F.lit(delay).alias("delay"))


def torrent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's torrent file; every seventh has something after its end."""
    text = _text("o_orderkey")
    info = F.concat(F.lit("d6:lengthi"), text, F.lit("e4:name"), F.length(text).cast("string"), F.lit(":"), text, F.lit("e"))
    body = F.concat(F.lit("d8:announce3:url4:info"), info, F.lit("e"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("x")).otherwise(F.lit(""))).cast("binary")
    files = table(spark, sf_dir, "orders").select(text.alias("path"), body.alias("content"), F.length(body).cast("bigint").alias("length"))
    return bencode.torrent_hashes(files).select("path", "info_hash", F.col("error").isNotNull().alias("broken"))


TORRENT_FILES_SQL = """select cast(o_orderkey as varchar) as path,
  case when o_orderkey % 7 > 0 then sha1('d6:lengthi' || o_orderkey || 'e4:name' || length(cast(o_orderkey as varchar)) || ':' || o_orderkey || 'e') end as info_hash, o_orderkey % 7 = 0 as broken from orders"""


# Guards and small conversions.


def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = ("https://feed.example/dl/", "HTTPS://Feed.example:443/dl/", "http://feed.example/dl/", "https://feed.example/x/dl/", "https://feed.example.org/dl/")
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("o_orderkey") % len(heads) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", feed.downloadable(BASE, F.concat(head, _text("o_orderkey"))).alias("allowed"))


def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text("o_orderkey")
    url = F.concat(F.lit("HTTPS://Feed.Example/dl/"), text, F.lit("?apikey=K&id="), text, F.lit("&JACKETT_APIKEY=9&e="))
    return table(spark, sf_dir, "orders").select("o_orderkey", feed.locator_fingerprint(url).alias("fingerprint"))


def query_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as search texts: some cut short, some long, one in nine with a control character."""
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.substring("p_name", 1, 2)).when(k % 5 == 1, F.repeat(F.concat("p_name", F.lit(" ")), 12)).otherwise(F.concat(F.lit(" \t"), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" ")))
    text = F.when(k % 9 == 0, F.concat(text, F.lit("\x07"))).otherwise(text)
    wanted = F.when(k % 4 == 1, F.array(F.lit("birch"), F.lit(" alder "), F.lit("birch"))).when(k % 4 == 2, F.array(F.lit("alder"), F.lit("nowhere"))).when(k % 4 == 3, F.array(F.lit(" ")))
    chosen = F.array_join(chosen_sources(wanted, ["alder", "birch", "cedar"]), ",")
    return table(spark, sf_dir, "part").select("p_partkey", folded_query(text).alias("query"), chosen.alias("sources"))


QUERY_CHECK_SQL = """
with t as (select p_partkey, case when p_partkey % 5 = 0 then substr(p_name, 1, 2) when p_partkey % 5 = 1 then repeat(p_name || ' ', 12) else p_name end as raw from part),
f as (select p_partkey, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as folded from t)
select p_partkey, case when length(folded) between 3 and 200 and p_partkey % 9 > 0 then folded end as query,
  case p_partkey % 4 when 1 then 'birch,alder' when 2 then null else 'alder,birch,cedar' end as sources from f
"""


def dates_and_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year of each work's date, and a word for true or false."""
    words = ("true", " YES ", "on", "1", "false", "No", "off", "0", "maybe", "")
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("id") % len(words) + 1).cast("int"))
    return table(spark, sf_dir, "tmdb_content").select("kind", "id", year_of_date(F.col("release_date")).alias("year"), parse_boolean(word).cast("string").alias("flag"))


def cut_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = truncated_error(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).alias("length"), F.md5(cut).alias("digest"))


# Upserts.


def genre_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    named, _ = _genre_tables(spark, sf_dir)
    return named.select("source", "id", "name", F.col("updated_at").isNotNull().alias("dated"))


def genre_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = _genre_tables(spark, sf_dir)
    return members


def _genre_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Types of parts as genres: some known under an older name, some memberships there."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    key = [F.lit("movie").alias("content_type"), F.when(k % 2 == 0, F.lit("butter-a")).otherwise(F.lit("butter-b")).alias("content_source"), _text("p_partkey").alias("content_id")]
    delivered = part.select(*key, k.alias("ordinal"), F.when(k % 3 == 0, F.upper("p_type")).otherwise(F.initcap("p_type")).alias("name"))
    slug = F.lower(F.replace("p_type", F.lit(" "), F.lit("-")))
    genres = part.select(F.lit("butter-a").alias("source"), slug.alias("id"), F.lit("old").alias("name"), F.lit(None).cast("timestamp").alias("updated_at")).distinct()
    genres = genres.unionByName(spark.createDataFrame([("tmdb", "kept", "Kept", None)], genres.schema))
    members = part.where(k % 4 == 0).select(*key, slug.alias("genre_id"))
    return links.upsert_genres(genres, members, delivered, F.lit(AS_OF).cast("timestamp"))


GENRE_UPSERT_SQL = """
with d as (select case when p_partkey % 2 = 0 then 'butter-a' else 'butter-b' end as source, lower(replace(p_type, ' ', '-')) as id,
    arg_max(case when p_partkey % 3 = 0 then upper(p_type) else list_aggregate(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') end, p_partkey) as name
    from part group by all),
g as (select distinct 'butter-a' as source, lower(replace(p_type, ' ', '-')) as id, 'old' as name from part union all select 'tmdb', 'kept', 'Kept')
select coalesce(g.source, d.source) as source, coalesce(g.id, d.id) as id, coalesce(d.name, g.name) as name, d.id is not null as dated
from g full join d on g.source = d.source and g.id = d.id
"""


def _attempts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Column]:
    """Orders as torrents, those of odd customers tried before."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    tried = orders.where("o_custkey % 2 = 1").select(
        _text("o_orderkey").alias("info_hash"), F.lit("old").alias("torrent_name"), F.lit("parsed").alias("parsed_title"), F.lit("movie").alias("parsed_kind"), F.lit(1999).alias("parsed_year"),
        F.lit("error").alias("status"), F.lit("timeout").alias("error"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("string").alias("content_source"),
        F.lit(None).cast("string").alias("content_id"), F.lit("2025-01-01").cast("timestamp").alias("attempted_at"), F.lit(None).cast("timestamp").alias("matched_at"),
    )
    now = orders.where(k % 3 < 2).select(k, _text("o_orderkey").alias("info_hash"), F.col("o_clerk").alias("torrent_name") if "o_clerk" in orders.columns else F.lit("new").alias("torrent_name"))
    return tried, now, F.lit(AS_OF).cast("timestamp")


def attempts_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried, now, as_of = _attempts(spark, sf_dir)
    failures = now.select("info_hash", F.lit("new").alias("torrent_name"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("unparsed")).otherwise(F.lit("no_match")).alias("status"), F.repeat(F.lit("e"), (F.col("o_orderkey") % 2000).cast("int")).alias("error"))
    out = enrich.attempt_failed(tried, failures, as_of)
    return out.select("info_hash", "torrent_name", "parsed_title", "status", F.length("error").alias("error_length"), "content_id", F.date_format("attempted_at", "yyyy").alias("attempted"))


ATTEMPTS_FAILED_SQL = """
with t as (select * from orders where o_custkey % 2 = 1), n as (select * from orders where o_orderkey % 3 < 2)
select cast(coalesce(t.o_orderkey, n.o_orderkey) as varchar) as info_hash, case when n.o_orderkey is null then 'old' else 'new' end as torrent_name,
  case when t.o_orderkey is not null then 'parsed' end as parsed_title,
  case when n.o_orderkey is null then 'error' when n.o_orderkey % 2 = 0 then 'unparsed' else 'no_match' end as status,
  cast(case when n.o_orderkey is null then 7 else least(1000, n.o_orderkey % 2000) end as int) as error_length, cast(null as varchar) as content_id,
  case when n.o_orderkey is null then '2025' else '2026' end as attempted from t full join n on t.o_orderkey = n.o_orderkey
"""


def attempts_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried, now, as_of = _attempts(spark, sf_dir)
    matches = now.select("info_hash", F.lit("new").alias("torrent_name"), F.lit("Title").alias("parsed_title"), F.lit("series").alias("parsed_kind"), F.lit(2001).alias("parsed_year"), F.lit("tv_show").alias("content_type"), F.col("info_hash").alias("content_id"))
    out = enrich.attempt_matched(tried, matches, as_of)
    return out.select("info_hash", "torrent_name", "parsed_title", "parsed_kind", "parsed_year", "status", "error", "content_type", "content_source", "content_id", F.date_format("matched_at", "yyyy").alias("matched"))


ATTEMPTS_MATCHED_SQL = """
with t as (select * from orders where o_custkey % 2 = 1), n as (select * from orders where o_orderkey % 3 < 2),
j as (select cast(coalesce(t.o_orderkey, n.o_orderkey) as varchar) as info_hash, n.o_orderkey is not null as fresh from t full join n on t.o_orderkey = n.o_orderkey)
select info_hash, case when fresh then 'new' else 'old' end as torrent_name, case when fresh then 'Title' else 'parsed' end as parsed_title, case when fresh then 'series' else 'movie' end as parsed_kind,
  case when fresh then 2001 else 1999 end as parsed_year, case when fresh then 'matched' else 'error' end as status, case when fresh then null else 'timeout' end as error,
  case when fresh then 'tv_show' end as content_type, case when fresh then 'tmdb' end as content_source, case when fresh then info_hash end as content_id, case when fresh then '2026' end as matched from j
"""


def maps_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season maps of orders: some hold paths, some marks, some aren't objects."""
    k = F.col("o_orderkey")
    text = F.when(k % 4 < 2, F.concat(F.lit('{"'), (k % 3).cast("string"), F.lit('":{"'), (k % 5).cast("string"), F.lit('":"f'), k.cast("string"), F.lit('.mkv"}}')))
    text = text.when(k % 4 == 2, F.concat(F.lit('{"'), (k % 3).cast("string"), F.lit('":{"'), (k % 5).cast("string"), F.lit('":true}}'))).otherwise(F.lit("[1]"))
    return links.compacted(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("episodes")))


MAPS_COMPACTED_SQL = """select o_orderkey, case when o_orderkey % 4 = 3 then '[1]' else '{"' || o_orderkey % 3 || '":{"' || o_orderkey % 5 || '":true}}' end as episodes from orders"""


def pending_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(_text("o_orderkey").alias("info_hash"), "o_orderkey")
    found = correlate.any_arrived(orders.where("o_orderkey % 2 = 0"), orders)
    none = correlate.any_arrived(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"))
    return spark.createDataFrame([(found, none)], "arrived boolean, others_arrived boolean")


# Jobs and cursors.


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: those open wait, those in part run, the rest are done."""
    status = F.when(F.col("o_orderstatus") == "O", F.lit("queued")).when(F.col("o_orderstatus") == "P", F.lit("running")).otherwise(F.lit("completed"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), status.alias("status"), status.alias("phase"), F.lit("2025-01-01").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"),
        F.lit("e").alias("error"), F.lit(0).alias("fetched"),
    )


QUEUE_SQL = "with q as (select o_orderkey as id, case o_orderstatus when 'O' then 'queued' when 'P' then 'running' else 'completed' end as status from orders)\n"


def jobs_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = jobs.claimed(_queue(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return made.select("id", "status", "phase", "error", F.date_format("started_at", "yyyy").alias("started"))


def jobs_requeued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.requeued(_queue(spark, sf_dir)).select("id", "status", "phase", F.col("started_at").isNotNull().alias("started"))


def jobs_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recent(_queue(spark, sf_dir)).select("id", "status")


def jobs_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _queue(spark, sf_dir)
    totals = queue.where("status = 'running'").select("id", F.col("id").cast("int").alias("fetched"), F.lit("partial").alias("status"), F.repeat(F.lit("x"), 1500).alias("error"))
    out = jobs.finished(queue, totals, F.lit(AS_OF).cast("timestamp"))
    return out.select("id", "status", "phase", "fetched", F.length("error").alias("error_length"), F.date_format("finished_at", "yyyy").alias("finished"))


def source_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = jobs.source_progress(F.col("l_partkey") % 1500, F.col("l_suppkey") % 7, F.col("l_partkey") % 1500 - F.col("l_linenumber") % 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", progress.alias("p")).select("l_orderkey", "l_linenumber", "p.*")


def first_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as records of orders' torrents: the batch now, the rest later."""
    records = table(spark, sf_dir, "lineitem").select(F.lpad(_text("l_orderkey"), 12, "0").alias("info_hash"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("part"))
    now, later = jobs.immediate_batch(records, [F.col("info_hash")])
    return now.withColumn("now", F.lit(True)).unionByName(later.withColumn("now", F.lit(False)))


FIRST_BATCH_SQL = """
with r as (select lpad(cast(l_orderkey as varchar), 12, '0') as info_hash, l_linenumber as ordinal, l_partkey as part from lineitem),
f as (select info_hash, ordinal, part from (select *, row_number() over (partition by info_hash order by ordinal, part) as n from r) where n = 1)
select *, row_number() over (order by info_hash) <= 250 as now from f
"""


def cursor_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources; the cursor of the first moves from its page."""
    states = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source"), (F.col("s_suppkey") % 7).cast("int").alias("next_page"), F.lit(False).alias("completed"))
    first = states.agg(F.min(F.struct("source", "next_page"))).first()[0]
    return advance_cursor(states, first[0], first[1], first[1] + 1, True)


CURSOR_SQL = """select s_name as source, cast(s_suppkey % 7 + case when s_name = (select min(s_name) from supplier) then 1 else 0 end as int) as next_page,
  s_name = (select min(s_name) from supplier) as completed from supplier"""


def backfill_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources that walk back from 2000, eight attempts each."""
    k = F.col("s_suppkey")
    sources = table(spark, sf_dir, "supplier")
    states = sources.select(_text("s_suppkey").alias("source"), F.lit(2000).alias("next_year"), (F.lit(1990) + k % 8).cast("int").alias("min_year"))
    tried = sources.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    i = F.col("attempt")
    fingerprint = F.concat(F.lit("f"), F.floor(i / (k % 4 + 1)).cast("string"))
    attempts = tried.select(_text("s_suppkey").alias("source"), "attempt", ((k + i) % 5).alias("records"), fingerprint.alias("fingerprint"), F.when((k + i) % 7 == 0, 1).otherwise(0).alias("deferred"))
    return backfill_walks(states, attempts).withColumn("completed", F.col("completed").cast("string"))


BACKFILL_SQL = """
with recursive w as (
  select s_suppkey as k, 0 as i, 2000 as next_year, cast(null as varchar) as fp, 0 as repeated, false as completed from supplier
  union all
  select k, i + 1, case when d then next_year else next_year - 1 end, case when d or n = 0 then fp else now end, case when d then repeated else r end,
    case when d then false else next_year <= 1990 + k % 8 or r >= 2 end
  from (select *, case when n = 0 then 0 when fp = now then repeated + 1 else 0 end as r
    from (select *, (k + i) % 5 as n, (k + i) % 7 = 0 as d, 'f' || (i // (k % 4 + 1)) as now from w where not completed and i < 8)))
select cast(k as varchar) as source, cast(next_year as int) as next_year, fp as last_fingerprint, cast(repeated as int) as repeated_pages, cast(completed as varchar) as completed
from (select *, row_number() over (partition by k order by i desc) as n from w) where n = 1
"""


# Pages of the catalogue.


def browse_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the rows of the first page of delivered films, in final order."""
    rows = _delivered_page(spark, sf_dir)
    ordered = rows.orderBy(*page_order()).select("content_id", "info_hash")
    return spark.createDataFrame([(n, *r) for n, r in enumerate(ordered.collect())], "place int, content_id string, info_hash string")  # one page


def _delivered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    key = [F.lit("movie").alias("content_type"), F.lit("tmdb").alias("content_source")]
    items = part.select(
        *key, _text("p_partkey").alias("content_id"), F.col("p_name").alias("title"), F.col("p_size").alias("release_year"), F.lit("").alias("overview"), F.col("p_retailprice").alias("popularity"),
        F.lit(1.0).alias("vote_average"), F.lit("en").alias("original_language"), F.lit("").alias("poster_path"), F.lit("").alias("backdrop_path"), F.array().cast("array<string>").alias("genres"),
        F.array().cast("array<string>").alias("normalized_genres"), F.lit(AS_OF).cast("timestamp").alias("activity_at"), F.lit(AS_OF).cast("timestamp").alias("added_at"), F.lit(1).alias("torrents"), F.lit(1).alias("max_seeders"),
    )
    torrents = lines.groupBy("l_partkey", "l_orderkey").agg(F.max("l_quantity").cast("int").alias("q")).select(
        *key, _text("l_partkey").alias("content_id"), _text("l_orderkey").alias("info_hash"), F.concat(F.lit("n"), (F.col("l_orderkey") % 3).cast("string")).alias("torrent_name"), F.lit(1).cast("bigint").alias("size"),
        F.lit("V720p").alias("video_resolution"), F.when(F.col("q") % 4 > 0, F.col("q")).alias("seeders"), F.lit(1).alias("leechers"), F.lit("p").alias("provider"),
    )
    return browse_page(items, torrents, sort="name")


BROWSE_ORDERED_SQL = """
with page as (select p_partkey, row_number() over (order by p_name, p_size desc nulls last, cast(p_partkey as varchar)) as page_rank from part),
rows as (select page_rank, cast(l_partkey as varchar) as content_id, cast(l_orderkey as varchar) as info_hash, l_orderkey % 3 as name, cast(max(l_quantity) as int) as q
  from lineitem join page on l_partkey = p_partkey where page_rank <= 50 group by page_rank, l_partkey, l_orderkey)
select cast(row_number() over (order by page_rank, case when q % 4 > 0 then q end desc nulls last, name, info_hash) - 1 as int) as place, content_id, info_hash from rows
"""


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the first page of delivered films, read again."""
    schema = "_id string, title string, year int, rating double, type string, torrents map<string,map<string,struct<provider:string,quality:string,seeds:int,peers:int,size:bigint,url:string,name:string>>>"
    read = catalogue_documents(_delivered_page(spark, sf_dir)).select("page_rank", F.from_json("document", schema).alias("d"))
    return read.select("page_rank", F.col("d._id").alias("content"), "d.title", "d.year", "d.rating", "d.type", F.explode(F.col("d.torrents")["en"]).alias("key", "t")).select(
        "page_rank", "content", "title", "year", "rating", "type", "key", "t.*"
    )


PAGE_DOCUMENTS_SQL = """
with page as (select p_partkey, p_name, p_size, row_number() over (order by p_name, p_size desc nulls last, cast(p_partkey as varchar)) as page_rank from part),
rows as (select page_rank, 'tmdb.' || l_partkey as content, p_name, p_size, cast(l_orderkey as varchar) as info_hash, 'n' || l_orderkey % 3 as name, cast(max(l_quantity) as int) as q
  from lineitem join page on l_partkey = p_partkey where page_rank <= 50 group by page_rank, l_partkey, p_name, p_size, l_orderkey),
keyed as (select *, row_number() over (partition by page_rank order by case when q % 4 > 0 then q end desc nulls last, name, info_hash) as n from rows)
select cast(page_rank as int) as page_rank, content, p_name as title, cast(p_size as int) as year, 1.0::double as rating, 'movie' as type, case when n = 1 then '720p' else '720p-' || n end as key, 'p' as provider,
  '720p' as quality, case when q % 4 > 0 then q else 0 end as seeds, 1 as peers, cast(1 as bigint) as size, 'magnet:?xt=urn:btih:' || info_hash as url, name from keyed
"""


def show_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail documents of all shows, read again: an entry per episode and torrent."""
    contents, found, torrents = derived(spark, sf_dir, "contents", "links", "torrents")
    shows = contents.where("type = 'tv_show'").select(F.col("source").alias("content_source"), F.col("id").alias("content_id"), "title")
    one = F.create_map(_text("season"), F.create_map(_text("episode"), F.lit("true")))
    rows = (
        found.where("content_type = 'tv_show'").withColumn("episodes", one).join(torrents.select("info_hash", F.col("name").alias("torrent_name"), "size"), "info_hash").withColumn("provider", F.lit("DHT"))
        .select("info_hash", "content_source", "content_id", "episodes", "torrent_name", "size", "video_resolution", "seeders", "leechers", "provider")
    )
    files = torrents.select("info_hash", F.col("name").alias("path"))
    schema = "_id string, title string, episodes array<struct<season:int,episode:int,title:string,torrents:map<string,struct<quality:string,seeds:int,peers:int,url:string,name:string,file:string>>>>"
    read = show_documents(shows, rows, files).select(F.from_json("document", schema).alias("d"))
    parts = read.select("d._id", "d.title", F.explode_outer("d.episodes").alias("e")).select("_id", "title", "e.season", "e.episode", F.explode_outer("e.torrents").alias("key", "t"))
    return parts.select(F.col("_id").alias("show"), "title", "season", "episode", "key", "t.seeds", "t.url", "t.file")


SHOW_DETAILS_SQL = ctes(
    """named as (select info_hash, name, regexp_extract(name, '(?i)s(\\d{1,3})[ ._-]*e(\\d{1,3})|(\\d{1,3})x(\\d{1,3})', ['a', 'b', 'c', 'd']) as m from torrents)""",
    """exact as (select info_hash, cast(coalesce(nullif(m.a, ''), m.c) as int) as season, cast(coalesce(nullif(m.b, ''), m.d) as int) as episode, name as file from named where m.a <> '' or m.c <> '')""",
    """mine as (select l.*, t.name from links l join torrents t using (info_hash) where l.content_type = 'tv_show')""",
    """placed as (select m.content_source, m.content_id, m.info_hash, m.name, m.seeders, lower(substr(coalesce(m.video_resolution, 'Vunknown'), 2)) as quality,
        coalesce(e.season, m.season) as season, coalesce(e.episode, m.episode) as episode, e.file from mine m left join exact e using (info_hash))""",
    """keyed as (select *, row_number() over (partition by content_source, content_id, season, episode, quality order by seeders desc nulls last, name, info_hash, file) as n from placed)""",
) + """
select c.source || '.' || c.id as show, c.title, season, episode, case when n is null then null when n = 1 then quality else quality || '-' || n end as key,
  case when info_hash is not null then greatest(coalesce(seeders, 0), 0) end as seeds, 'magnet:?xt=urn:btih:' || upper(info_hash) as url, file
from contents c left join keyed k on k.content_source = c.source and k.content_id = c.id where c.type = 'tv_show'
"""


QUERIES: dict[str, Query] = {
    "feed_items": feed_items,
    "feed_year": feed_year,
    "feed_search": feed_search,
    "feed_recent": feed_recent,
    "import_lines": import_lines,
    "catalogue_items": catalogue_items,
    "catalogue_torrents": catalogue_torrents,
    "one_catalogue": one_catalogue,
    "metadata_details": metadata_details,
    "metadata_search": metadata_search,
    "html_records": html_records,
    "html_errors": html_errors,
    "html_links": html_links,
    "robots_decisions": robots_decisions,
    "torrent_files": torrent_files,
    "url_guard": url_guard,
    "locators": locators,
    "query_check": query_check,
    "dates_and_words": dates_and_words,
    "cut_errors": cut_errors,
    "genre_upsert": genre_upsert,
    "genre_members": genre_members,
    "attempts_failed": attempts_failed,
    "attempts_matched": attempts_matched,
    "maps_compacted": maps_compacted,
    "pending_any": pending_any,
    "jobs_claimed": jobs_claimed,
    "jobs_requeued": jobs_requeued,
    "jobs_recent": jobs_recent,
    "jobs_finished": jobs_finished,
    "source_progress": source_progress,
    "first_batch": first_batch,
    "cursor_moved": cursor_moved,
    "backfill_walk": backfill_walk,
    "browse_ordered": browse_ordered,
    "page_documents": page_documents,
    "show_details": show_details,
}

SQL: dict[str, str] = {
    "feed_items": FEED_ITEMS_SQL,
    "feed_year": "select record_id from torrent_records where regexp_matches(name, '\\b2011\\b')",
    "feed_search": "select record_id from torrent_records where contains(lower(name), 'the') and contains(lower(name), '1080p')",
    "feed_recent": "select lpad(cast(o_orderkey as varchar), 12, '0') as info_hash from orders order by o_orderdate desc nulls last, lpad(cast(o_orderkey as varchar), 12, '0') limit 100",
    "import_lines": IMPORT_SQL,
    "catalogue_items": CATALOGUE_ITEMS_SQL,
    "catalogue_torrents": CATALOGUE_TORRENTS_SQL,
    "one_catalogue": """select 'movie' as kind, cast(p_partkey as varchar) as id, case when p_partkey % 4 = 0 then 0 when p_partkey % 3 = 0 then 1 else 2 end as endpoint,
        p_name || case when p_partkey % 4 = 0 then ' 0' when p_partkey % 3 = 0 then ' 1' else ' 2' end as title from part where p_partkey % 4 = 0 or p_partkey % 3 = 0 or p_partkey % 2 = 0""",
    "metadata_details": DETAILS_SQL,
    "metadata_search": "select kind, id, title, original_title, try_cast(substr(release_date, 1, 4) as int) as year from tmdb_content",
    "html_records": HTML_RECORDS_SQL,
    "html_errors": "select cast(o_orderkey as varchar) as path, 'no magnet link' as error from orders where o_orderkey % 7 = 0",
    "html_links": "select 'http://host.example/torrent/' || o_orderkey as url from orders group by o_orderkey",
    "robots_decisions": "select o_orderkey, o_orderkey % 6 in (1, 3, 4, 5) as allowed, 7.0::double as delay from orders",
    "torrent_files": TORRENT_FILES_SQL,
    "url_guard": "select o_orderkey, o_orderkey % 5 < 2 as allowed from orders",
    "locators": "select o_orderkey, sha256('https://feed.example/dl/' || o_orderkey || '?id=' || o_orderkey || '&e=') as fingerprint from orders",
    "query_check": QUERY_CHECK_SQL,
    "dates_and_words": """select kind, id, try_cast(substr(release_date, 1, 4) as int) as year, case when id % 10 < 4 then 'true' when id % 10 < 8 then 'false' end as flag from tmdb_content""",
    "cut_errors": "select doc_id, cast(length(substr(text, 1, 1000)) as int) as length, md5(substr(text, 1, 1000)) as digest from documents",
    "genre_upsert": GENRE_UPSERT_SQL,
    "genre_members": """select distinct 'movie' as content_type, case when p_partkey % 2 = 0 then 'butter-a' else 'butter-b' end as content_source, cast(p_partkey as varchar) as content_id,
        lower(replace(p_type, ' ', '-')) as genre_id from part""",
    "attempts_failed": ATTEMPTS_FAILED_SQL,
    "attempts_matched": ATTEMPTS_MATCHED_SQL,
    "maps_compacted": MAPS_COMPACTED_SQL,
    "pending_any": "select count(*) > 0 as arrived, false as others_arrived from orders where o_orderkey % 2 = 0",
    "jobs_claimed": QUEUE_SQL
    + """select id, case when c then 'running' else status end as status, case when c then 'searching' else status end as phase, case when c then null else 'e' end as error,
        case when c then '2026' else '2025' end as started from (select *, id = (select min(id) from q where status = 'queued') as c from q)""",
    "jobs_requeued": QUEUE_SQL + "select id, case when status = 'running' then 'queued' else status end as status, case when status = 'running' then 'queued' else status end as phase, status <> 'running' as started from q",
    "jobs_recent": QUEUE_SQL + "select id, status from q order by id desc limit 50",
    "jobs_finished": QUEUE_SQL
    + """select id, case when status = 'running' then 'partial' else status end as status, case when status = 'running' then 'finished' else status end as phase,
        case when status = 'running' then cast(id as int) else 0 end as fetched, case when status = 'running' then 1000 else 1 end as error_length, case when status = 'running' then '2026' end as finished from q""",
    "source_progress": "select l_orderkey, l_linenumber, cast(l_partkey % 1500 as int) as fetched, cast(l_suppkey % 7 + l_linenumber % 3 as int) as skipped, l_partkey % 1500 >= 1000 as saturated from lineitem",
    "first_batch": FIRST_BATCH_SQL,
    "cursor_moved": CURSOR_SQL,
    "backfill_walk": BACKFILL_SQL,
    "browse_ordered": BROWSE_ORDERED_SQL,
    "page_documents": PAGE_DOCUMENTS_SQL,
    "show_details": SHOW_DETAILS_SQL,
}
