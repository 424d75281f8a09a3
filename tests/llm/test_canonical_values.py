import random

from pyspark.sql import functions as F

from reelloom.llm.canonical_values import map_item_values, map_values, slipped
from reelloom.llm.genre_names import OTHER_NAMES

CASES = {
    "drama": "8", "DRMA": "8", "Genre: Drama": "8", "genre=drama": "8", "Drama (US)": "8", "drama series": "8", "#drama": "8", "D R A M A": "8", "Dr​ama ": "8", "драма": "8",
    "Drame": "8", "Sci-Fi": "9", "SCIENCE FCITION": "9", "Science Ficti0n": "9", "Ciencia ficción": "9", "Dramamine": "", "Warsaw": "", "war": "7", "Krieg": "7", "1080p": "", "4K": "",
    "": "", "???": "", "Comet": "", "c0medy": "5", "comeyd": "5", "Comédie": "5", "Romania": "", "Reality TV": "6", "N/A": "",
}
NAMES = [("8", "Drama"), ("9", "Science Fiction"), ("7", "War"), ("5", "Comedy"), ("6", "Reality"), ("4", "Romance")]


def reference(spark):
    return spark.createDataFrame(NAMES, "id string, name string")


def others(spark):
    return spark.createDataFrame([(n, o) for n, listed in OTHER_NAMES.items() for o in listed.split("|")], "name string, other string")


def test_values(spark):
    values = spark.createDataFrame([(v, 1, "x") for v in [*CASES, None, "drama", "x" * 5000]], "value string, id int, plain string")
    found = {r.value: r.id for r in map_values(values, reference(spark), others(spark)).collect()}
    assert found == CASES | {"x" * 5000: ""}


def test_items(spark):
    items = spark.createDataFrame([("a", ["Drama", "drma", "drma", None]), ("a", ["drma"]), ("b", None), ("c", [])], "k string, genres array<string>")
    out = map_item_values(items, ["k"], "genres", reference(spark), others(spark))
    assert sorted(map(tuple, out.collect())) == [("a", "drma", "8")]


def test_without_other_names(spark):
    values = spark.createDataFrame([("Drame",), ("драма",)], "value string")
    assert {r.value: r.id for r in map_values(values, reference(spark)).collect()} == {"Drame": "8", "драма": ""}
    assert map_values(values.limit(0), reference(spark)).count() == 0
    assert {r.id for r in map_values(values, reference(spark).limit(0)).collect()} == {""}


def test_equally_near_entries_are_not_told_apart(spark):
    twins = spark.createDataFrame([("1", "Morpex"), ("2", "Morpey")], "id string, name string")
    assert map_values(spark.createDataFrame([("Morpe",)], "value string"), twins).first().id == ""


def test_slips(spark):
    made = spark.createDataFrame([("abc",)], "t string").select(slipped(F.col("t"))).first()[0]
    assert set(made) == {"bc", "ac", "ab", "\x01bc", "a\x01c", "ab\x01", "\x01abc", "a\x01bc", "ab\x01c", "abc\x01", "bac", "acb"}


def test_held_out_slips_are_mapped_and_strangers_are_not(spark):
    """Slips with real letters, which the thresholds never saw."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = sorted({"".join(rng.choices("aeiou", k=1) + rng.choices(letters, k=rng.randrange(5, 11))) for _ in range(120)})
    expected = {}
    for i, w in enumerate(names):
        for _ in range(4):
            k = rng.randrange(len(w) - 1)
            expected[rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :]])] = str(i)
    strangers = {"".join(rng.choices(letters, k=rng.randrange(4, 12))) for _ in range(400)}
    reference = spark.createDataFrame([(str(i), w) for i, w in enumerate(names)], "id string, name string")
    out = {r.value: r.id for r in map_values(spark.createDataFrame([(v,) for v in {*expected, *strangers}], "value string"), reference).collect()}
    assert sum(out[v] == i for v, i in expected.items()) >= 0.99 * len(expected)
    assert sum(out[v] != "" for v in strangers) <= 0.01 * len(strangers)


def test_very_long_values_and_names(spark):
    long = "prefix " + "".join(chr(97 + i * i % 26) for i in range(300))
    reference = spark.createDataFrame([("1", long), ("2", "Drama")], "id string, name string")
    values = spark.createDataFrame([(long.replace("x ", "xx "),), ("d" * 100_000,), (long * 40,)], "value string")
    assert sorted((len(r.value), r.id) for r in map_values(values, reference).collect()) == [(308, "1"), (12280, ""), (100_000, "")]
