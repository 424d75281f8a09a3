import random

import numpy as np

from reelloom.llm import entity_match
from reelloom.llm.entity_match import Vectors, matched
from reelloom.llm.titles import parse_release, slips, title_distance, title_form, work_forms, words_of

WORKS = "kind string, id int, title string, original_title string, release_date string, release_year int, year int, form string"
RECORDS = "record_id bigint, name string, kind string, number int"
SYLLABLES = ["ba", "che", "dro", "fun", "gri", "hon", "kra", "lin", "mo", "nub", "pen", "ran", "sti", "tru", "ven", "zo"]


def test_parsing():
    cases = {
        "[nestL] The Storm of Fonfongrosu 2 (1957) (1080p).mkv": ([("storm of fonfongrosu", 2)], 1957, "movie"),
        "Tower_of_Dunsenannen,_The_1997_2160p": ([("tower of dunsenannen", 1)], 1997, "movie"),
        "Kagizukri.Part.Two.1080p [1.5 GB]": ([("kagizukri", 2)], None, "movie"),
        "A Road AKA La route 2011": ([("a road", 1), ("route", 1), ("a road aka route", 1)], 2011, "movie"),
        "Brunvin S02E03 720p": ([("brunvin", 1)], None, "tv_show"),
        "Зеркало Рогиннандун 3 (1985)": ([("zerkalo roginnandun", 3)], 1985, "movie"),
        "th mirror of zed 1990": ([("mirror of zed", 1)], 1990, "movie"),
        "2012": ([("2012", 1)], None, "movie"),
        "": ([], None, "movie"),
        "   [..] ": ([], None, "movie"),
    }
    for name, expected in cases.items():
        assert parse_release(name) == expected, name
    assert work_forms("The Fire III", "Das Feuer 3")[:2] == [("fire", 3), ("feuer", 3)] and work_forms(None, None) == []
    assert title_form(words_of("Zrebin’s Road")) == ("zrebins road", 1)


def test_distances():
    assert slips("abcd", "abdc", 2) == 1 and slips("kitten", "sitting", 2) == 3 and slips("a", "abcd", 2) == 3
    assert title_distance("storm of fonfon", "strom of fonfon") == 1
    assert title_distance("storm of fonfon", "fire of fonfon") > 2 and title_distance("a b", "a b c") > 2


def name_of(rng):
    return "".join(rng.choices(SYLLABLES, k=rng.randrange(3, 6))).title()


def slip(rng, text):
    i = rng.randrange(2, len(text) - 2)
    kind = rng.randrange(4)
    if kind == 0:
        return text[:i] + text[i + 1 :]
    if kind == 1:
        return text[:i] + text[i] + text[i:]
    if kind == 2:
        return text[:i] + rng.choice("qxj") + text[i + 1 :]
    return text[:i] + text[i + 1] + text[i] + text[i + 2 :]


def test_matches(spark):
    rng = random.Random(5)
    generic = ["Storm", "Garden", "Mirror", "Silence", "Bridge"]
    works, records, truth = [], [], {}
    names = sorted({name_of(rng) for _ in range(300)})
    for i, n in enumerate(names):
        title = f"The {rng.choice(generic)} of {n}"
        works.append((("tv_show", "movie")[i % 2], i, title, None, f"{1960 + i % 60}-01-01", None if i % 3 else 1960 + i % 60, 0, "x"))
    works += works[:50]
    for r in range(1200):
        kind, i, title, _, date, *_ = works[rng.randrange(len(names))]
        year = int(date[:4]) + rng.choice([0, 0, 0, 1, -1])
        shown = slip(rng, title) if rng.random() < 0.4 else title
        mark = " S01E02" if kind == "tv_show" else ""
        records.append((r, f"{shown.replace(' ', '.')}.{year}{mark}.1080p", "x", 1))
        truth[r] = i
    records += [(5000, None, "x", 1), (5001, "", "x", 1), (5002, "The.Storm.of.Nothingness.1999", "x", 1), (5003, f"The Storm of {names[1]} 7 2001", "x", 1), (5004, "x " * 3000, "x", 1)]
    kind, i, title, _, date, *_ = works[1]
    records.append((5005, f"{title} {int(date[:4]) + 9} 1080p", "x", 1))
    out = {r.record_id: r for r in matched(spark.createDataFrame(records, RECORDS), spark.createDataFrame(works, WORKS)).collect()}
    right = sum(r in out and out[r].tmdb_id == i for r, i in truth.items())
    assert right >= 0.9 * len(truth)
    assert all(out[r].tmdb_id == truth.get(r) for r in out)
    assert all(0 <= r.confidence <= 1 for r in out.values())


def test_buckets_grow_finer():
    forms = [f"storm of {name_of(random.Random(i)).lower()}" for i in range(400)]
    vectors = Vectors.fit(forms)
    assert vectors.sized_for(1000).planes["title"] == 18 and vectors.longer == 0
    fine = vectors.sized_for(10_000_000)
    assert fine.planes == {"title": 24, "name": 24, "head": 24, "tail": 24} and fine.longer == 2
    assert fine.parts("storm of chedrofungrihon")["head"] == ["chedrof"] and fine.parts("storm of bache")["head"] == ["ba"]
    assert abs(np.linalg.norm(fine.of(["storm", "of"]), axis=1) - 1).max() < 1e-9


def test_rivals_and_remakes(spark):
    works = [("movie", 1, "The Storm of Bachedro", None, None, 1990, 0, ""), ("movie", 2, "The Storm of Bachedro", None, None, 2010, 0, ""), ("tv_show", 3, "Night of Grihonmo", None, None, 2000, 0, ""), ("movie", 4, "Night of Grihonmo", None, None, 1980, 0, ""), ("movie", 5, "Zopenran", "Зопенран", None, None, 0, "")]
    names = {"Storm.of.Bachedro.1990": 1, "Storm.of.Bachedro.2010": 2, "Storm.of.Bachedro.1991": None, "Storm.of.Bachedro": None, "Night of Grihonmo S01E01": 3, "Night of Grihonmo": 4, "Night of Grihonmo 2001 S01E01": None, "Zopenran 1987": 5, "Зопенран (1980)": 5, "Zopenran 2": None, "Zopenran S01E01": None}
    records = spark.createDataFrame([(i, n, "", 0) for i, n in enumerate(names)], RECORDS)
    out = {r.record_id: r.tmdb_id for r in matched(records, spark.createDataFrame(works, WORKS)).collect()}
    assert {n: out.get(i) for i, n in enumerate(names)} == names


def test_empty(spark):
    some = spark.createDataFrame([(1, "A Film 2000", "", 0)], RECORDS)
    works = spark.createDataFrame([("movie", 1, "A Film", None, None, 2000, 0, "")], WORKS)
    assert matched(some.limit(0), works).count() == 0 and matched(some, works.limit(0)).count() == 0


LETTERS = "bcdfghklmnprstvz"


def test_pairs_do_not_depend_on_the_number_of_works(spark, monkeypatch):
    rng = random.Random(8)
    names = sorted({"".join(rng.choice(LETTERS) + rng.choice("aeiou") for _ in range(6 + i % 2)) for i in range(300)})
    works = spark.createDataFrame([("movie", i, n.title(), None, None, 2000, 0, "") for i, n in enumerate(names)], WORKS)
    records = spark.createDataFrame([(i, f"{slip(rng, slip(rng, n))}.2000.1080p", "", 0) for i, n in enumerate(names)], RECORDS)
    found = lambda: sorted(map(tuple, matched(records, works).collect()))
    expected = found()
    # As many works as 600 million would be.
    monkeypatch.setattr(entity_match, "BASE_WORKS", 0.05)
    assert found() == expected and len(expected) > 200
    monkeypatch.setattr(entity_match, "BIG_BUCKET", 0)
    assert found() == expected


def test_confidences_hold_on_other_planted_pairs():
    rng = random.Random(3)
    works = sorted({("the " if i % 2 else "night ") + "".join(rng.choice(LETTERS) + rng.choice("aeiou") for _ in range(3 + i % 4)) for i in range(3000)})
    vectors = entity_match.Vectors.fit(works)
    cosine, own = entity_match.planted_pairs([(w, 1) for w in works], vectors)
    assert len(own) > 3000 and 0 < own.mean() < 1
    fit = np.arange(len(own)) % 2 == 0
    slope, intercept = entity_match.calibration(cosine[fit], own[fit])
    said = 1 / (1 + np.exp(-(slope * cosine[~fit] + intercept)))
    assert slope > 0
    for low in (0.0, 0.5):
        part = (said >= low) & (said < low + 0.5 + low)
        if part.sum() > 100:
            assert abs(said[part].mean() - own[~fit][part].mean()) < 0.08


def test_calibration_of_nothing():
    slope, _ = entity_match.calibration(*entity_match.planted_pairs([], entity_match.Vectors.fit([])))
    assert slope > 0
