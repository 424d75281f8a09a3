import hashlib

import pytest
from pyspark.sql import functions as F

from reelloom.sources import bencode, catalog_json, feed, metadata_json, pages

HASH = "c0ffee15900d5eed1234abcd9f8e7d6c5b4a3928"
FEED = f"""<rss xmlns:t="http://torznab.com/schemas/2015/feed"><channel>
<item><title>One</title><size>12</size><t:attr name="infohash" value="{HASH.upper()}"/></item>
<item><title><![CDATA[Two & more]]></title><t:attr name="magneturl" value="magnet:?xt=urn:btih:{HASH}"/><t:attr name="size" value="7"/></item>
<item><title>Three</title></item>
<item><title>Four</title><enclosure url="https://host/dl/x?apikey=1" length="1"/><size>bad</size></item>
<item><title>  </title><t:attr name="infohash" value="{HASH}"/></item>
<item><title>Six</title><t:attr name="infohash" value="zz"/></item>
</channel></rss>"""


def test_feed(spark):
    feeds = spark.createDataFrame([("ix", FEED), ("bad", "<rss><item>"), ("none", None), ("empty", "<rss/>")], "indexer string, xml string")
    out = [(r.source, r.entry, r.info_hash, r.name, r.size) for r in feed.parse_feeds(feeds).collect()]
    mine = [r[1:] for r in out if r[0] == "jackett-ix"]
    assert mine == [("record", HASH, "One", 12), ("record", HASH, "Two & more", 7), ("skipped", None, "Three", 0), ("pending", None, "Four", 0), ("skipped", HASH, None, 0), ("skipped", None, "Six", 0)]
    assert [r[:2] for r in out if r[1] == "error"] == [("jackett-bad", "error"), ("jackett-none", "error")]
    assert not [r for r in out if r[0] == "jackett-empty"]


def test_locators(spark):
    df = spark.createDataFrame([("https://h/dl/a?apikey=1&id=2", "https://H/dl/a?id=2&jackett_apikey=9")], "a string, b string")
    row = df.select(feed.locator_fingerprint(F.col("a")).alias("a"), feed.locator_fingerprint(F.col("b")).alias("b")).first()
    assert row.a == row.b
    cases = [("https://h/dl/a", True), ("https://h:443/dl/a", True), ("http://h/dl/a", False), ("https://h/x/dl/a", False), ("https://hh/dl/a", False)]
    df = spark.createDataFrame(cases, "u string, e boolean").select("e", feed.downloadable("https://h/", F.col("u")).alias("x"))
    assert all(r.e == r.x for r in df.collect())


PAGE = f"""{{"results": [
 {{"title": " A Show ", "imdb_id": "tt0090210", "year": "2011", "rating": {{"percentage": 86}}, "images": {{"poster": "/p.jpg"}}, "genres": ["drama", " "],
   "torrents": {{"en": {{"1080p": {{"url": "magnet:?xt=urn:btih:{HASH}&amp;dn=x", "seed": 3, "size": "5"}}, "list": [{{"url": "x"}}]}}}},
   "episodes": [{{"season": 4, "episode": "11", "torrents": {{"720p": {{"url": "magnet:?xt=urn:btih:{HASH[::-1]}", "file": "f.mkv"}}}}}}, {{"season": 99999, "episode": 1, "torrents": {{}}}}]}},
 {{"slug": "the-other-one"}}, {{"title": ""}}, 5]}}"""


def test_catalogue_json(spark):
    pages_ = spark.createDataFrame([("show", PAGE), ("movie", '[{"name": "N", "id": 9}]'), ("movie", "broken"), ("movie", None)], "kind string, body string")
    items = catalog_json.page_items(pages_)
    out = {r.title: r for r in items.collect()}
    assert set(out) == {"A Show", "The Other One", "N"}
    show = out["A Show"]
    assert (show.id, show.year, show.rating, show.poster, show.genres) == ("tt0090210", 2011, 8.6, "/p.jpg", ["drama"])
    assert out["The Other One"].id == hashlib.sha256(b"the other one\x000").hexdigest()[:32]
    found = sorted((r.info_hash, r.name, r.quality, r.seeders, r.size, r.season, r.episode) for r in catalog_json.item_torrents(items).collect())
    assert found == [(HASH[::-1], "f.mkv", "720p", None, 0, 4, 11), (HASH, "A Show", "1080p", 3, 5, None, None)]


def test_metadata_json(spark):
    body = '{"id": 5, "name": "S", "first_air_date": "2019-02-01", "episode_run_time": [24], "overview": "  ", "genres": [{"id": 1, "name": "Drama"}]}'
    row = metadata_json.details(spark.createDataFrame([("tv_show", body), ("movie", "x")], "kind string, body string")).collect()
    assert [(r.id, r.title, r.release_year, r.runtime, r.overview, r.genres) for r in row] == [(5, "S", 2019, 24, None, ["Drama"])]
    found = metadata_json.search_results(spark.createDataFrame([("movie", '{"results": [{"id": 1, "title": "T", "release_date": "2001-01-01"}]}')], "kind string, body string"))
    assert [(r.id, r.title, r.year) for r in found.collect()] == [(1, "T", 2001)]


def test_bencode():
    info = b"d6:lengthi5e4:name1:xe"
    assert bencode.info_hash(b"d8:announce1:a4:info" + info + b"e") == hashlib.sha1(info).hexdigest()
    deep = b"l" * 70 + b"e" * 70
    for bad in (b"", b"le", b"d4:info" + info + b"ex", b"de", b"d4:infoi1ee", b"d4:info" + info + b"4:info" + info + b"e", b"d01:a1:b4:info" + info + b"e", b"d1:ai-0e4:info" + info + b"e", b"d1:a" + deep + b"4:info" + info + b"e", b"d4:info9:x"):
        with pytest.raises(ValueError):
            bencode.info_hash(bad)


HTML = f"""<html><head><title>Page</title></head><body><h1>Detail</h1><p>Size: 2.5 GiB</p>
<a href="magnet:?xt=urn:btih:{HASH}&dn=From%20Link">m</a> <a href="magnet:?xt=urn:btih:bad" data-name="x">n</a>
<a href="/torrent/2">t</a> <a href="https://other/torrent/3">o</a> <a href="/torrents/1#x">u</a></body></html>"""


def test_pages(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/1.html", "b.HTML", "c.txt"):
        (tmp_path / name).write_text(HTML)
    got = [(r.info_hash, r.name, r.size) for r in pages.folder_records(spark, str(tmp_path)).collect()]
    assert got == [(HASH, "From Link", 2684354560)]
    df = spark.createDataFrame([("http://host/x", HTML), ("http://host/x", None)], "base string, html string")
    assert sorted(r.url for r in pages.page_links(df).collect()) == ["http://host/torrent/2", "http://host/torrents/1#x"]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: mine\nDisallow: /a\nAllow: /a/b$\nAllow: /*/c\nCrawl-delay: 7\n"
    rules, delay = pages.robots_rules(text, "Mine")
    assert delay == 7
    cases = {"http://h/a": False, "http://h/a/b": True, "http://h/a/bx": False, "http://h/x": True, "http://h": True, "http://h/a/c": True}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.allowed for r in pages.robots_allowed(df, rules).collect()} == cases
    assert pages.robots_rules("", "x") == ([], pages.LEAST_DELAY)
    with pytest.raises(ValueError):
        pages.robots_rules("User-agent: *\nCrawl-delay: -1", "x")


def test_pages_without_magnets_and_links_of_folders(spark, tmp_path):
    inside, outside = tmp_path / "in", tmp_path / "out"
    inside.mkdir()
    outside.mkdir()
    (inside / "a b.html").write_text(HTML)
    (inside / "none.html").write_text("<a href='/x'>x</a>")
    (outside / "o.html").write_text(HTML.replace(HASH, HASH[::-1]))
    (inside / "link.html").symlink_to(outside / "o.html")
    (inside / "large.html").write_text(HTML.replace(HASH, HASH[1:] + "0") + " " * (9 << 20))
    read = pages.read_folder(spark, str(inside))
    assert sorted(r.path.rpartition("/")[2] for r in read.select("path").collect()) == ["a b.html", "large.html", "none.html"]
    assert [(r.path.rpartition("/")[2], r.error) for r in pages.page_errors(read).collect()] == [("none.html", "no magnet link")]
    assert {r.info_hash for r in pages.folder_records(spark, str(inside)).collect()} == {HASH, HASH[1:] + "0"}


def test_endpoints_as_one_catalogue(spark):
    items = spark.createDataFrame([(1, "movie", "a", "B"), (0, "movie", "a", "A"), (0, "movie", "a", "A"), (1, "show", "a", "C"), (1, "movie", None, "D")], "endpoint int, kind string, id string, title string")
    assert sorted((r.kind, str(r.id), r.title) for r in catalog_json.one_catalogue(items).collect()) == [("movie", "None", "D"), ("movie", "a", "A"), ("show", "a", "C")]
    assert catalog_json.one_catalogue(items.limit(0)).count() == 0
