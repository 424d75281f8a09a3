import datetime as dt

from pyspark.sql import functions as F

from reelloom.operators import jobs
from reelloom.plans import links

T0 = dt.datetime(2026, 1, 1)
KEYS = "content_type string, content_source string, content_id string"
JOBS = "id bigint, status string, phase string, started_at timestamp, finished_at timestamp, fetched int, error string"


def test_queue(spark):
    table = spark.createDataFrame([(2, "queued", "queued", None, None, 0, None), (1, "completed", "finished", T0, T0, 5, None), (3, "queued", "queued", None, None, 0, "old")], JOBS)
    table, job = jobs.claimed(table, F.lit(T0))
    read = lambda df: {r.id: (r.status, r.phase, r.error) for r in df.collect()}
    assert job == 2 and read(table)[2] == ("running", "searching", None) and read(table)[3] == ("queued", "queued", "old")
    assert read(jobs.in_phase(table, 2, "enriching"))[2][1] == "enriching" and read(jobs.in_phase(table, 3, "x"))[3][1] == "queued"
    assert read(jobs.requeued(table))[2][:2] == ("queued", "queued")
    totals = spark.createDataFrame([(2, 7, "partial", "e" * 2000)], "id bigint, fetched int, status string, error string")
    done = {r.id: r for r in jobs.finished(table, totals, F.lit(T0)).collect()}
    assert (done[2].status, done[2].fetched, len(done[2].error), done[2].finished_at, done[2].phase) == ("partial", 7, 1000, T0, "finished")
    assert done[3].status == "queued" and done[3].finished_at is None
    assert jobs.claimed(table.where("status = 'none'"), F.lit(T0))[1] is None
    assert [r.id for r in jobs.recent(table, 2).collect()] == [3, 2]


def test_progress_and_batches(spark):
    row = spark.range(1).select(jobs.source_progress(F.lit(1000), F.lit(3), F.lit(900)).alias("p")).first().p
    assert tuple(row) == (1000, 103, True)
    records = spark.createDataFrame([(f"h{i % 7}", f"n{i}") for i in range(20)], "info_hash string, name string")
    now, later = jobs.immediate_batch(records, [F.col("info_hash")], 4)
    assert [r.info_hash for r in now.orderBy("info_hash").collect()] == ["h0", "h1", "h2", "h3"] and later.count() == 3


def test_feed_requests(spark):
    items = spark.createDataFrame([("a", "Fire 2010", T0), ("b", "fire storm 2011", None), ("c", "Storm 20101", T0)], "info_hash string, name string, published_at timestamp")
    ask = lambda **k: sorted(r.info_hash for r in jobs.select_feed(items, **k).collect())
    assert ask() == ["a", "b", "c"] and ask(year=2010) == ["a"] and ask(search="STORM fire") == ["b"] and ask(limit=2) == ["a", "c"]


def test_cache_before_quota(spark):
    pending = spark.createDataFrame([("s", f"l{i}", T0) for i in range(5)], "source string, locator string, at timestamp")
    cache = spark.createDataFrame([("s", "l0", "h")], "source string, locator string, info_hash string")
    out = {r.locator: r.outcome for r in jobs.resolutions(pending, cache, [F.col("locator")], 2).collect()}
    assert out == {"l0": "cached", "l1": "admitted", "l2": "admitted", "l3": "deferred", "l4": "deferred"}


def test_grouped_links(spark):
    schema = f"{KEYS}, ordinal int, info_hash string, quality string, seeders int, leechers int, season int, episode int, file string"
    data = [("tv_show", "b", "1", 1, "h", "x", None, 2, 1, 1, "a"), ("tv_show", "b", "1", 2, "h", "1080p web", 5, None, 1, 2, None), ("tv_show", "b", "1", 3, "h", "720p", 4, None, 1, 1, "b"), ("movie", "b", "2", 4, "g", None, None, None, None, None, None)]
    made, files = links.grouped_links(spark.createDataFrame(data, schema))
    out = {r.info_hash: r for r in made.collect()}
    assert (out["h"].seeders, out["h"].leechers, out["h"].video_resolution, out["h"].episodes) == (5, 2, "V1080p", {"1": {"1": "true", "2": "true"}})
    assert out["g"].episodes is None and out["g"].seeders is None
    assert [(r.season, r.episode, r.file_path) for r in files.collect()] == [(1, 1, "b")]


def test_paths_move_out_of_maps(spark):
    texts = {"a": '{"1": {"2": "x.mkv", "3": true, "z": "n", "0": "n", "4": ""}, "b": {"1": "n"}, "5": 7}', "b": '{"1":{"1":true}}', "c": None, "d": "[1]"}
    df = spark.createDataFrame([(k, "tv_show", "b", "1", v) for k, v in texts.items()], f"info_hash string, {KEYS}, episodes string")
    assert [(r.info_hash, r.season, r.episode, r.file_path) for r in links.paths_in_maps(df).collect()] == [("a", 1, 2, "x.mkv")]
    out = {r.info_hash: r.episodes for r in links.compacted(df).collect()}
    assert '"2":true' in out["a"] and "x.mkv" not in out["a"]
    assert {k: out[k] for k in "bcd"} == {k: texts[k] for k in "bcd"}


def test_file_maps(spark):
    schema = f"info_hash string, {KEYS}, season int, episode int, file_path string, updated_at timestamp"
    files = spark.createDataFrame([("h", "tv_show", "b", "1", 1, 1, "old", T0), ("h", "tv_show", "tmdb", "9", 1, 1, "new", T0 + dt.timedelta(1)), ("h", "tv_show", "b", "1", 2, 3, "other", T0)], schema)
    correlations = spark.createDataFrame([("tv_show", "b", "1", "tv_show", "tmdb", "9")], f"{KEYS}, canonical_type string, canonical_source string, canonical_id string")
    (row,) = links.episode_file_maps(files, correlations).collect()
    assert row.content_id == "9" and row.episode_files == {"1": {"1": "new"}, "2": {"3": "other"}}
    fresh = spark.createDataFrame([("h", "tv_show", "b", "1", 1, 1, "newest", T0)], schema)
    assert "newest" in {r.file_path for r in links.upsert_files(files, fresh).collect()}
