import hashlib

import pytest
from pyspark.sql import functions as F

from reelloom.operators import pacing
from reelloom.operators.merge import fill_text, first_of_each, greatest, insert_missing, merge, merge_episodes, overwrite, remove, unseen


def frame(spark, data, schema="k int, t string, n int"):
    return spark.createDataFrame(data, schema)


def test_merge_rules(spark, rows):
    target = frame(spark, [(1, "", 5), (2, "x", None), (None, "null key", 1), (4, "only", 4)])
    source = frame(spark, [(1, "new", 3), (2, "y", 7), (None, "other", 9), (5, "fresh", 5)])
    out = merge(target, source, ["k"], {"t": fill_text, "n": greatest})
    assert rows(out) == sorted([(1, "new", 5), (2, "x", 7), (None, "null key", 9), (4, "only", 4), (5, "fresh", 5)], key=repr)
    out = merge(target, source, ["k"], {}, default=overwrite, only_if=lambda t, s: t["n"] > s["n"])
    assert (1, "new", 3) in rows(out) and (2, "x", None) in rows(out)
    empty = frame(spark, [])
    assert rows(merge(empty, source, ["k"], {})) == rows(source) and rows(merge(target, empty, ["k"], {})) == rows(target)


def test_episode_maps(spark):
    schema = "k int, e map<string,map<string,string>>"
    a = spark.createDataFrame([(1, {"1": {"1": "true"}}), (2, None), (3, {"1": {}})], schema)
    b = spark.createDataFrame([(1, {"1": {"1": "f", "2": "true"}, "2": {"1": "g"}}), (2, {"3": {"4": "h"}}), (3, None)], schema)
    out = {r.k: r.e for r in merge(a, b, ["k"], {"e": merge_episodes}).collect()}
    assert out == {1: {"1": {"1": "f", "2": "true"}, "2": {"1": "g"}}, 2: {"3": {"4": "h"}}, 3: {"1": {}}}


def test_keyed_sets(spark, rows):
    a, b = frame(spark, [(1, "a", 1)]), frame(spark, [(1, "b", 2), (2, "c", 3), (2, "c", 3)])
    assert rows(insert_missing(a, b, ["k"])) == [(1, "a", 1), (2, "c", 3)]
    assert rows(unseen(b, a, ["k"])) == [(2, "c", 3), (2, "c", 3)]
    assert rows(remove(b, a, ["k"])) == [(2, "c", 3), (2, "c", 3)]
    assert rows(first_of_each(b, ["k"], [F.col("n").desc()])) == [(1, "b", 2), (2, "c", 3)]


def test_fingerprint_ignores_order(spark):
    ids = ["hb", "ha", "uxyz"]
    digest = hashlib.sha256(b"".join(len(i).to_bytes(8, "big") + i.encode() for i in sorted(ids))).hexdigest()
    for order in (ids, ids[::-1]):
        df = spark.createDataFrame([(order,)], "i array<string>")
        assert df.select(pacing.page_fingerprint(F.col("i")).alias("f")).first().f == digest


def test_repeats(spark):
    data = [(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, None), (6, None), (7, "b"), (8, "b")]
    df = spark.createDataFrame([("p", i, f) for i, f in data], "p string, i int, f string")
    out = pacing.repeat_counts(df, "p", "i", "f", F.col("f").isNull()).orderBy("i")
    assert [r.repeated_pages for r in out.collect()] == [0, 1, 2, 0, 0, 0, 0, 1]


def test_backfill_steps():
    s = pacing.BackfillState(2020, 2018)
    s = pacing.backfill_step(s, 5, "f", 0)
    assert (s.next_year, s.repeated_pages, s.completed) == (2019, 0, False)
    assert pacing.backfill_step(s, 5, "f", 1) == s
    s = pacing.backfill_step(s, 5, "f", 0)
    assert s.repeated_pages == 1
    s = pacing.backfill_step(s, 5, "f", 0)
    assert s.completed and s.repeated_pages == 2
    assert pacing.backfill_step(s, 0, "e", 0).repeated_pages == 0
    assert not pacing.reopened(s, 2010).completed and pacing.reopened(s, 2018).completed and pacing.reopened(s, 2020).min_year == 2018


def test_cursor_compares_before_it_moves(spark, rows):
    states = spark.createDataFrame([("a", 1, False), ("b", 4, True)], "source string, next_page int, completed boolean")
    assert rows(pacing.advance_cursor(states, "a", 1, 2, False)) == [("a", 2, False), ("b", 4, True)]
    with pytest.raises(ValueError):
        pacing.advance_cursor(states, "a", 3, 4, False)


def test_job_status(spark):
    cases = [(2, 2, 0, 0, "failed"), (1, 2, 0, 0, "partial"), (0, 2, 1, 0, "partial"), (0, 2, 0, 1, "partial"), (0, 2, 0, 0, "completed"), (0, 0, 0, 0, "failed")]
    df = spark.createDataFrame(cases, "f int, n int, d int, s int, e string")
    assert all(r.e == r.x for r in df.select("e", pacing.job_status(F.col("f"), F.col("n"), F.col("f"), F.col("d"), F.col("s")).alias("x")).collect())


def test_a_cursor_that_completes_moves_too(spark):
    states = spark.createDataFrame([("a", 3, False), ("b", 3, False)], "source string, next_page int, completed boolean")
    assert sorted(map(tuple, pacing.advance_cursor(states, "a", 3, 4, True).collect())) == [("a", 4, True), ("b", 3, False)]
