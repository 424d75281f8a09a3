import random

import numpy as np
import pytest

from reelloom.llm.leaks import EXCHANGED, WHOLE, Patterns, leaked, repeated_share
from reelloom.llm.wordscan import Scan

WORDS = [f"w{i}" for i in range(400)]


@pytest.mark.parametrize("length", [3, 8, 15, 40])
def test_search_finds_every_window(length):
    rng = random.Random(length)
    items = [(i, " ".join(rng.choices(WORDS[:30], k=rng.randrange(0, length + 1)))) for i in range(30)] + [(99, " ".join(WORDS[:length]))]
    patterns = Patterns(items)
    texts = [" ".join(rng.choices(WORDS[:30], k=n)) + " " + items[-1][1] for n in (3000, 0, 20)]
    joined = "\n".join(texts).encode() + b"\n"
    scan = Scan(joined, np.array([0, len(texts[0]) + 1, len(texts[0]) + len(texts[1]) + 2]))
    words, text = scan.hashes, scan.text
    found = set(zip(*(x.tolist() for x in patterns.search(words, text))))
    brute = {
        (p, n, a)
        for n, w in enumerate(patterns.words)
        if (size := patterns.size[n])
        for a in range(len(w) - size + 1)
        for p in range(len(words) - size + 1)
        if (words[p : p + size] == w[a : a + size]).all() and text[p] == text[p + size - 1]
    }
    assert found == brute and found


def test_needed_windows_are_always_there():
    """However exchanges fall, the least repeated words of an item hold as
    many windows as the search asks for."""
    for n in range(WHOLE, 60):
        patterns = Patterns([(1, " ".join(WORDS[:n]))])
        size, half = patterns.size[0], -(-n // 2)
        for cut in range(half + 1):
            most = half // EXCHANGED
            runs = most + 2 if 0 < cut < half else most + 1
            equal = half - most
            # Runs of nearly equal length hold the fewest windows.
            spread = [equal // runs + (k < equal % runs) for k in range(runs)]
            assert sum(max(0, r - size + 1) for r in spread) >= patterns.needed[0]


def share(spark, doc, item, schema="doc_id bigint, text string, item_id int, share int"):
    docs = spark.createDataFrame([(1, doc, 0, 0)], schema)
    items = spark.createDataFrame([(9, "t", item)], "item_id bigint, task string, text string")
    rows = leaked(docs, items).collect()
    return rows[0].share if rows else 0.0


ITEM = " ".join(WORDS[:48])


@pytest.mark.parametrize(
    "doc, found",
    [
        (f"before {ITEM} after", 1.0),
        ("<p>" + ITEM.upper().replace("W7 ", "<b>w7</b>, ").replace(" W20", "\n> W20") + "!</p>", 1.0),
        (" ".join(WORDS[:24]), 0.5),
        (" ".join(WORDS[:23]), 0.0),
        (" ".join(WORDS[:14]) + " inserted words here " + " ".join(WORDS[30:42]), 26 / 48),
        (" ".join(WORDS[30:42]) + " other order " + " ".join(WORDS[:14]), 0.0),
        (" ".join(w if i % 8 != 4 else "exchanged" for i, w in enumerate(WORDS[:48])), 1.0),
        (" ".join(w if i % 3 != 1 else "exchanged" for i, w in enumerate(WORDS[:48])), 0.0),
        ("", 0.0),
        (None, 0.0),
    ],
)
def test_shares(spark, doc, found):
    assert share(spark, doc, ITEM) == pytest.approx(found)


def test_neighbouring_documents_are_apart(spark):
    docs = spark.createDataFrame([(1, " ".join(WORDS[:20])), (2, " ".join(WORDS[20:40])), (3, ITEM), (3, ITEM), (4, "x " * 200_000 + ITEM)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short"), (4, ITEM)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaked(docs, items).collect()) == [(3, 1), (3, 1), (3, 4), (3, 4), (4, 1), (4, 4)]
    assert leaked(docs.limit(0), items).count() == 0 and leaked(docs, items.limit(0)).count() == 0


def test_share_counts_overlapping_stretches_once():
    assert repeated_share([(0, 30, 0, 0), (20, 48, 0, 12)], 48) == 1.0
    assert repeated_share([(0, 30, 0, 0), (20, 48, 0, -30)], 48) == 30 / 48
    assert repeated_share([(0, 10, 2, 0), (10, 30, 1, 5)], 60) == 30 / 60  # exchanges are judged over both
    assert repeated_share([(0, 10, 2, 0)], 20) == 0 and repeated_share([], 20) == 0


def brute_share(found, length):
    best = max((b - a for a, b, x, _ in found if x * EXCHANGED <= b - a), default=0)
    for a, b, x, o in found:
        for e, f, y, u in found:
            start = max(e, b, b + o - u)
            total = b - a + f - start
            if start < f and (x + y) * EXCHANGED <= total:
                best = max(best, total)
    return best / length


def test_share_agrees_with_all_pairs():
    rng = random.Random(5)
    for _ in range(300):
        found = [(a, a + rng.randrange(3, 12), rng.randrange(2), rng.randrange(-60, 60)) for a in rng.choices(range(30), k=rng.randrange(1, 25))]
        assert repeated_share(found, 48) == brute_share(found, 48)


def test_markup_of_any_length_does_not_count(spark):
    attributes = "".join(f' data-x{i}="{"y" * 90}"' for i in range(11))
    tagged = "".join(f"{w} <span{attributes}></span>[quote={'q ' * 200}]&CounterClockwiseContourIntegral;" if i % 9 == 5 else f"{w} " for i, w in enumerate(WORDS[:48]))
    assert len(attributes) > 1000 and share(spark, f"a {tagged} b", ITEM) == 1.0
    assert share(spark, "x < y " * 50_000 + "[a=" * 50_000 + "<a" * 50_000 + " " + ITEM, ITEM) == 1.0


@pytest.mark.parametrize(
    "item, doc, found",
    [
        ("Lantern", "the LANTERN.", True), ("lantern", "lanterns", False), ("quick brown fox", "a quick <b>brown</b> fox!", True),
        ("quick brown fox", "a quick brown dog", False), ("quick brown fox", "a quick brown", False), ("one two three four five six seven eight", "x one two three four five six seven eight y", True),
        ("one two three four five six seven eight", "one two three four nine six seven eight", True), ("one two three four five six seven", "one two three four nine six seven", False),
        (" ".join(WORDS[:9]), " ".join(WORDS[:5]), True), (" ".join(WORDS[:9]), " ".join(WORDS[:4]), False), (" ".join(WORDS[:18]), f"{WORDS[0]} {WORDS[1]} {WORDS[2]} x {WORDS[4]} {WORDS[5]} {WORDS[6]} y {WORDS[8]}", False),
        ("...", "...", False), ("", "", False),
    ],
)
def test_short_items(spark, item, doc, found):
    assert (share(spark, doc, item) > 0) == found


def test_many_items_are_searched_in_parts(spark):
    rng = random.Random(3)
    items = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=30))) for i in range(40)], "item_id bigint, text string")
    docs = items.selectExpr("item_id + 100 as doc_id", "concat('x ', text, ' y') as text")
    rows = lambda n: sorted(map(tuple, leaked(docs, items, part_words=n).collect()))
    assert rows(200) == rows(1_000_000) == [(i + 100, i, 1.0) for i in range(40)]


def test_many_repeats_of_a_part(spark):
    doc = " ".join((" ".join(WORDS[5:25]) + f" filler{i}") for i in range(4000))
    assert share(spark, doc, ITEM) == 0.0
    assert share(spark, doc + " " + " ".join(WORDS[30:40]), ITEM) == pytest.approx(30 / 48)
