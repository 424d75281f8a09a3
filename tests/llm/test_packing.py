import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reelloom.llm.packing import best_fit_decreasing, fill_report, packed, pieces
from reelloom.llm.queries import TOKENIZERS, VOCABULARY


def plain(sizes, capacity):
    """Best fit decreasing by scanning all containers."""
    rooms, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [c for c, r in enumerate(rooms) if r >= sizes[i]]
        if fits:
            least = min(rooms[c] for c in fits)
            c = [c for c in fits if rooms[c] == least][-1]
        else:
            rooms.append(capacity)
            c = len(rooms) - 1
        rooms[c] -= sizes[i]
        out[i] = c
    return sorted(rooms), out


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.data())
def test_as_good_as_the_scan(capacity, data):
    sizes = np.array(data.draw(st.lists(st.integers(1, capacity), max_size=60)), dtype=np.int64)
    where = best_fit_decreasing(sizes, capacity)
    used = np.bincount(where, sizes) if len(sizes) else np.empty(0)
    assert (used <= capacity).all()
    assert sorted(capacity - used) == plain(sizes.tolist(), capacity)[0]


def test_pieces():
    row, piece, size = pieces(np.array([1, 2, 3]), np.array([5, 10, 21]), 10)
    assert row.tolist() == [0, 1, 2, 2, 2] and piece.tolist() == [0, 0, 0, 1, 2] and size.tolist() == [5, 10, 10, 10, 1]


def test_packed(spark):
    rng = random.Random(1)
    texts = [(i, "word " * rng.randrange(0, 90)) for i in range(300)] + [(998, None), (999, ""), (7, "again"), (1000, "long " * 5000)]
    docs = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id bigint, text string, tokens int, block int")
    windows = spark.createDataFrame([(1, 64), (2, 256), (3, 0), (None, 9), (4, None)], "window_id int, capacity_tokens int")
    rows = packed(docs, windows, TOKENIZERS, VOCABULARY).collect()
    for window, capacity in ((1, 64), (2, 256)):
        mine = [r for r in rows if r.window_id == window]
        fill = {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
        assert max(fill.values()) <= capacity
        whole = {}
        for r in mine:
            whole.setdefault(r.doc_id, []).append(r)
        assert all(len(p) == 1 or sum(r.tokens for r in p) > capacity or d == 7 for d, p in whole.items())
        assert {998, 999}.isdisjoint(whole)
    assert {r.window_id for r in rows} == {1, 2}
    report = {r.window_id: r for r in fill_report(packed(docs, windows, TOKENIZERS, VOCABULARY), windows).collect()}
    assert report[1].containers >= report[1].least_containers and 0 <= report[1].unused < 0.1
    assert packed(docs.limit(0), windows, TOKENIZERS, VOCABULARY).count() == 0 and packed(docs, windows.limit(0), TOKENIZERS, VOCABULARY).count() == 0
