import random

import pytest

from reelloom.operators.snapshot_diff import SnapshotTable, generations_with_rows, snapshot_changes

SCHEMA = "g bigint, k string, k2 string, a string, n double, tags array<string>, ord int, leaf int"


def changes(spark, data, **kw):
    df = spark.createDataFrame(data, SCHEMA)
    t = SnapshotTable(df, "g", ["k", "k2"], exact=["a"], sets=["tags"], near={"n": 1e-6})
    gens, counts = generations_with_rows(t)
    return sorted((tuple(r) for r in snapshot_changes(t, gens, counts[0], **kw).collect()), key=repr)


def brute(data):
    by = {}
    for g, k, k2, a, n, tags, *_ in data:
        if g is None:
            continue
        value = (a, n, None if tags is None else tuple(sorted(set(tags), key=lambda x: (x is not None, x))))
        key = lambda v: tuple((x is not None, x) for x in (v[0], v[2], v[1]))
        held = by.setdefault(g, {}).get((k, k2))
        if held is None or key(value) < key(held):
            by[g][(k, k2)] = value
    out = []
    gens = sorted(by)
    for before, now in zip(gens, gens[1:]):
        for key in by[now].keys() | by[before].keys():
            x, y = by[now].get(key), by[before].get(key)
            if y is None:
                out.append((now, *key, "added"))
            elif x is None:
                out.append((now, *key, "removed"))
            elif x[0] != y[0] or x[2] != y[2] or not (x[1] == y[1] or (x[1] is not None and y[1] is not None and abs(x[1] - y[1]) < 1e-6)):
                out.append((now, *key, "changed"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_leaf", [1, 8, 10_000])
def test_against_brute_force(spark, per_leaf):
    rng = random.Random(per_leaf)
    data = []
    for g in (3, 5, 9, 10):
        for i in range(300):
            if rng.random() < 0.85:
                a = rng.choice(["x", "y", None]) if rng.random() < 0.1 else f"v{i % 7}"
                n = None if i % 11 == 0 else i / 10 + rng.choice([0, 0, 0, 4e-7, 1e-3])
                row = (g, f"k{i}" if i % 13 else None, "z" if i % 5 else None, a, n, rng.sample(["a", "b"], 2) if i % 3 else None, 7, 8)
                data += [row] * (2 if i % 17 == 0 else 1)
    assert changes(spark, data, rows_per_leaf=per_leaf) == brute(data)


def test_order_and_tolerance_are_no_change(spark):
    data = [(1, "a", "", "x", 5.0, ["p", "q"], 0, 0), (2, "a", "", "x", 5.0000004, ["q", "p", "p"], 1, 1)]
    assert changes(spark, data) == []


def test_null_differs_from_a_value(spark):
    data = [(1, "a", "", None, 1.0, None, 0, 0), (2, "a", "", "", 1.0, None, 0, 0), (2, None, None, "n", None, [], 0, 0), (3, "a", "", "", None, None, 0, 0)]
    assert changes(spark, data) == [(2, "a", "", "changed"), (2, None, None, "added"), (3, "a", "", "changed"), (3, None, None, "removed")]


def test_empty_and_single(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(1, "a", "b", "c", 1.0, [], 0, 0), (None, "a", "b", "c", 1.0, [], 0, 0)]) == []


def test_hot_key_repeated(spark):
    data = [(1, "hot", "", "x", 1.0, None, 0, 0)] * 500 + [(2, "hot", "", "y", 1.0, None, 0, 0)] * 500
    assert changes(spark, data) == [(2, "hot", "", "changed")]
