import datetime as dt

from pyspark.sql import functions as F

from reelloom import api
from reelloom.plans import correlate
from reelloom.plans.catalog import SnapshotStore
from reelloom.streaming import ingest

T0 = dt.datetime(2026, 1, 1)
H = [f"{i:040x}" for i in range(10)]
KEYS = "content_type string, content_source string, content_id string"
CORR = f"{KEYS}, canonical_type string, canonical_source string, canonical_id string, evidence_info_hash string, evidence_kind string"


def tables(spark):
    make = spark.createDataFrame
    contents = make(
        [("tv_show", "tmdb", "1", "Main", 2000, None, "o", 5.0, 1.0, "en"), ("tv_show", "b", "tt0000001", "Alias", None, False, None, None, None, None), ("movie", "tmdb", "2", "Adult", 2000, True, None, None, None, None), ("movie", "b", "x", "Lone", 2001, None, None, None, 2.0, None)],
        "type string, source string, id string, title string, release_year int, adult boolean, overview string, vote_average double, popularity double, original_language string",
    )
    attributes = make([("tv_show", "tmdb", "1", "tmdb", "imdb_id", "tt0000001"), ("movie", "b", "x", "b", "poster_path", "/x.jpg")], f"{KEYS}, source string, key string, value string")
    links = make(
        [(H[0], "tv_show", "tmdb", "1", 1, None, None, {"1": {"1": "true"}}, T0, T0), (H[0], "tv_show", "b", "tt0000001", 5, 2, "V720p", None, T0, T0 + dt.timedelta(1)), (H[1], "tv_show", "b", "tt0000001", None, None, None, None, T0, T0), (H[2], "movie", "tmdb", "2", 1, 1, None, None, T0, T0), (H[3], "movie", "b", "x", 9, 9, "V1080p", None, T0, T0), (H[4], None, None, None, 1, 1, None, None, T0, T0)],
        f"info_hash string, {KEYS}, seeders int, leechers int, video_resolution string, episodes map<string,map<string,string>>, created_at timestamp, updated_at timestamp",
    )
    torrents = make([(h, f"Name S01E0{i}", 100 + i) for i, h in enumerate(H[:5])], "info_hash string, name string, size bigint")
    return api.Tables(contents, attributes, make([("movie", "b", "x", "Drama")], f"{KEYS}, name string"), torrents, links, make([(H[3], "s2"), (H[3], "s1")], "info_hash string, source string"), make([("s1", "Zed"), ("s2", "Abe")], "key string, name string"), make([], CORR))


def test_correlate_build_and_read(spark, tmp_path):
    t = tables(spark)
    t.correlations = api.correlations_of(t).cache()
    assert [(r.content_id, r.canonical_id, r.evidence_kind) for r in t.correlations.collect()] == [("tt0000001", "1", "exact_imdb_id")]
    store = SnapshotStore(str(tmp_path / "store"))
    assert [api.build_snapshot(t, store) for _ in range(3)] == [1, 2, 3]
    assert store.published(spark) == [2, 3]
    rows = {(r.content_id, r.info_hash): r for r in store.read(spark, "torrents").collect()}
    assert set(rows) == {("1", H[0]), ("1", H[1]), ("x", H[3])}
    main = rows[("1", H[0])]
    assert (main.seeders, main.leechers, main.video_resolution, main.provider) == (5, 2, "V720p", "DHT")
    assert rows[("x", H[3])].provider == "Abe, Zed"
    items = {r.content_id: r for r in store.read(spark, "items").collect()}
    assert items["x"].poster_path == "/x.jpg" and items["x"].genres == ["Drama"] and items["1"].genres == []
    (page,) = api.browse(store, spark, kind="movie").collect()
    assert '"1080p"' in page.document and '"_id":"b.x"' in page.document
    assert api.browse(store, spark, kind="movie", page=0).count() == 0
    assert tuple(api.stats(store, spark).first()) == (1, 1, 3)


def test_show_detail(spark):
    t = tables(spark)
    t.correlations = api.correlations_of(t)
    files = spark.createDataFrame([(H[1], "x.s02e03.mkv")], "info_hash string, path string")
    for asked in ("tmdb.1", "tt0000001", "b.tt0000001", "1"):
        torrents, episodes = api.show_detail(t, files, asked)
        assert {r.info_hash for r in torrents.collect()} == {H[0], H[1]}
        assert sorted((r.info_hash, r.season, r.episode, r.file) for r in episodes.collect()) == [(H[0], 1, 1, None), (H[1], 2, 3, "x.s02e03.mkv")]
    assert api.show_detail(t, files, "nothing") is None


def test_conflicting_match_is_rejected(spark):
    t = tables(spark)
    t.correlations = spark.createDataFrame([("tv_show", "b", "tt0000001", "tv_show", "tmdb", "77", H[0], "shared_info_hash")], CORR)
    matches = spark.createDataFrame([(H[1], "tv_show", "1", None), (H[3], "movie", "3", None)], "info_hash string, content_type string, tmdb_id string, imdb_id string")
    links, correlations, rejected = api.accept_matches(t, matches)
    assert [r.info_hash for r in rejected.collect()] == [H[1]]
    assert links.where("content_source = 'tmdb' and content_id = '3'").count() == 1
    assert {(r.content_id, r.canonical_id) for r in correlations.collect()} == {("tt0000001", "77"), ("x", "3")}
    assert links.count() == t.links.count() + 1


def test_conflict_rules(spark):
    old = spark.createDataFrame([("m", "b", "1", "m", "tmdb", "5", "h0", "exact_imdb_id"), ("m", "b", "2", "m", "tmdb", "6", "h0", "shared_info_hash")], CORR)
    new = spark.createDataFrame([("m", "b", "1", "m", "tmdb", "5", "h1", "shared_info_hash"), ("m", "b", "2", "m", "tmdb", "7", "h1", "exact_tmdb_id"), ("m", "b", "3", "m", "tmdb", "8", "h1", "shared_info_hash")], CORR)
    read = lambda df: {r.content_id: (r.canonical_id, r.evidence_info_hash, r.evidence_kind) for r in df.collect()}
    assert read(correlate.upgrade(old, new)) == {"1": ("5", "h1", "exact_imdb_id"), "2": ("6", "h0", "shared_info_hash"), "3": ("8", "h1", "shared_info_hash")}
    assert read(correlate.renew(old, new))["1"] == ("5", "h1", "shared_info_hash")
    assert read(correlate.ignore_known(old, new))["1"] == ("5", "h0", "exact_imdb_id")


def test_ingest_marks_after_the_sink(spark, tmp_path):
    source, sink, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = "source string, info_hash string, n int"
    spark.createDataFrame([("a", "h", 1), ("a", "h", 2), ("b", "h", 3)], schema).write.parquet(source)
    spark.createDataFrame([("b", "h")], "source string, info_hash string").write.parquet(marks)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    run = lambda: ingest.ingest(stream(), ["source", "info_hash"], lambda: spark.read.parquet(marks), lambda d: d.write.mode("append").parquet(sink), lambda d: d.write.mode("append").parquet(marks), str(tmp_path / "cp"))
    run()
    spark.createDataFrame([("a", "h", 4), ("c", "h", 5)], schema).write.mode("append").parquet(source)
    run()
    assert sorted(r.source for r in spark.read.parquet(sink).collect()) == ["a", "c"]


def test_valid_records(spark):
    observed = spark.createDataFrame([(" a ", H[1].upper(), " n ", "5"), ("a", "bad", "n", "5"), (None, H[1], "n", None), ("a", H[1], " ", None), ("b", H[2], "m", "x")], "source string, info_hash string, name string, size string")
    good, bad = api.valid_records(observed)
    assert sorted(map(tuple, good.collect())) == [("a", H[1], "n", 5), ("b", H[2], "m", 0)] and bad.count() == 3
    fresh, marked = api.ingest(observed, spark.createDataFrame([("a", H[1], T0)], "source string, info_hash string, imported_at timestamp"), F.lit(T0))
    assert [r.source for r in fresh.collect()] == ["b"] and marked.count() == 2
    assert '"infoHash"' in api.import_payload(good).first().value
