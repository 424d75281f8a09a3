import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelloom.llm.fusion import STAND_INS, fused, picture_address, says_something, sharing_model, survivors, usable_tmdb_id

SCHEMA = "row_id bigint, source string, canonical_id string, tmdb_id string, title string, synopsis string, rating double, poster string, updated_at timestamp_ntz, trust_rank int, field string"
T = [dt.datetime(2026, 1, d) for d in (1, 2, 3)]


def items(spark, data):
    return spark.createDataFrame([(*r, 0, "x") for r in data], SCHEMA)


def trusted(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 9)], "key string, trust_rank int")


def test_survivors(spark):
    data = [
        (1, "b", "g", "17", "T", "A story.", 5.0, "/p/b.jpg", T[0]),
        (2, "c", "g", " 18 ", "T", "Other story.", 0.0, "https://x/img/c.png", T[1]),
        (3, "a", "g", "0", "T", "TBA", float("nan"), "none", T[2]),
        (4, "zz", "g", "19", "T", None, 7.0, None, None),
        (5, "a", "h", "5", "T", "Solo", 5.0, "/x.jpg", T[0]),
        (6, "a", None, "5", "T", "No group", 5.0, "/x.jpg", T[0]),
        (8, "b", "i", "5", "T", "T (2020)", 10.0, "N/A", None),
        (7, "b", "i", "6", "T", "<p>&nbsp;</p>", 10.1, "", None),
        (7, "b", "i", "6", "T", "<p>&nbsp;</p>", 10.1, "", None),
    ]
    out = {(r.canonical_id, r.field_name): r.row_id for r in survivors(items(spark, data), trusted(spark), STAND_INS).collect()}
    assert out == {("g", "synopsis"): 2, ("g", "poster"): 2, ("g", "rating"): 1, ("g", "tmdb_id"): 2, ("i", "rating"): 8, ("i", "tmdb_id"): 7}
    assert survivors(items(spark, []), trusted(spark)).count() == 0


def test_shared_pictures_and_texts_are_stand_ins(spark):
    """No list tells them: only that they are claimed for many items."""
    data = [(i, "a", f"g{i % 40}", "1", "T", "Nothing here yet" if i < 40 else f"Story {i}", 5.0, "/p/shared.jpg" if i < 40 else f"/p/{i}.jpg", T[i % 3]) for i in range(400)]
    out = {(r.canonical_id, r.field_name): r.row_id for r in survivors(items(spark, data), trusted(spark)).collect()}
    for field in ("synopsis", "poster"):
        assert all(out[f"g{g}", field] >= 40 for g in range(40))


def test_sharing_model():
    odds, exponent, norm = sharing_model({1: 90_000, 2: 900, 3: 90, 6: 12, 2400: 12}, 50_000)
    posterior = lambda k: odds - np.log(k) - np.log(np.log(50_000) + 1) + exponent * np.log(k) + norm
    assert posterior(6) < 0 < posterior(2400)
    assert sharing_model({}, 0)[0] < 0


@pytest.mark.parametrize(
    "text, title, usable",
    [("No overview map can show this town.", "T", True), ("No overview available.", "T", False), ("…", "T", False), ("The Storm", "THE STORM (2011)", False), ("Plot", None, True), ("", "T", False), (None, "T", False), ("Keine Beschreibung vorhanden.", "T", False)],
)
def test_synopses(spark, text, title, usable):
    data = [(1, "a", "g", None, title, text, None, None, T[0]), (2, "a", "g", None, title, None, None, None, T[0])]
    assert survivors(items(spark, data), trusted(spark), STAND_INS).count() == usable
    df = spark.createDataFrame([("the storm 2011", "The Storm"), ("", "x"), ("a storm", None)], "s string, t string")
    assert [r[0] for r in df.select(says_something(F.col("s"), F.col("t"))).collect()] == [False, False, True]


def test_addresses_and_ids(spark):
    addresses = {"/a1b2.jpg": True, "https://img.x/p/1.png": True, "none": False, "N/A": False, "/": False, None: False}
    df = spark.createDataFrame([(a,) for a in addresses], "a string")
    assert {r.a: r.u for r in df.select("a", picture_address(F.col("a")).alias("u")).collect()} == addresses
    ids = {" 12\t": True, "0": False, "0000": False, "-1": False, "tt1": False, "007": True, None: False, "": False}
    df = spark.createDataFrame([(a,) for a in ids], "a string")
    assert {r.a: r.u for r in df.select("a", usable_tmdb_id(F.col("a")).alias("u")).collect()} == ids


def test_fusion_sees_through_copies(spark):
    """b errs often and c copies b; where only one honest source speaks too,
    two copied votes count as one."""
    rng = random.Random(2)
    data, truth, n = [], {}, 0
    for g in range(400):
        right, wrong = str(1000 + g), str(5000 + g)
        truth[f"g{g}"] = right
        b = wrong if rng.random() < 0.4 else right
        claims = [("a", right if rng.random() < 0.95 else str(9000 + g)), ("b", b), ("c", b)]
        if g % 2:
            claims += [("d", right if rng.random() < 0.9 else str(8000 + g)), ("e", right if rng.random() < 0.9 else str(7000 + g))]
        for source, value in claims:
            n += 1
            data.append((n, source, f"g{g}", value, "T", None, None, None, T[0]))
    ids = {r[0]: r[3] for r in data}
    rank = spark.createDataFrame([(s, 3) for s in "abcde"], "key string, trust_rank int")
    out = {r.canonical_id: r for r in fused(items(spark, data), rank).collect()}
    assert all(0 < r.posterior <= 1 for r in out.values())
    assert sum(ids[out[g].row_id] == v for g, v in truth.items()) > 360
    assert fused(items(spark, []), rank).count() == 0
