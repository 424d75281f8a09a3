import random

import pyarrow as pa
import pytest

from reelloom.llm.topn import first_n_of_sorted, top_n

SCHEMA = "g string, r string, s int, i string, c0 int, rank int"


def brute(data, n):
    best = {}
    for g, r, s, i, *_ in data:
        held = best.setdefault((g, r), {})
        if i not in held or (held[i] is None and s is not None) or (s is not None and s > held[i]):
            held[i] = s
    out = []
    for key, items in best.items():
        order = sorted(items.items(), key=lambda x: (x[1] is None, -(x[1] or 0), x[0] is not None, x[0]))
        out += [(*key, s, i) for i, s in order[:n]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 3])
def test_against_brute_force(spark, n):
    rng = random.Random(n)
    data = []
    for _ in range(3000):
        g = "hot" if rng.random() < 0.4 else rng.choice([None, *map(str, range(200))])
        data.append((g, rng.choice([None, "", "a"]), rng.choice([None, *range(5)]), rng.choice([None, *[f"i{k}" for k in range(60)]]), 1, 2))
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    out = top_n(df, ["g", "r"], "s", "i", n)
    assert out.columns == df.columns
    assert sorted(((x.g, x.r, x.s, x.i) for x in out.collect()), key=repr) == brute(data, n)


def test_small_batches_carry_over():
    groups = ["a"] * 5 + ["b"] * 2 + [None] * 3
    items = ["x", "y", "x", "z", "w", "x", "x", "q", "q", "r"]
    table = pa.table({"g": groups, "i": pa.array(items)})
    for size in (1, 2, 3, 10):
        out = pa.Table.from_batches(first_n_of_sorted(iter(table.to_batches(size)), ["g"], "i", 2))
        assert list(zip(out["g"].to_pylist(), out["i"].to_pylist())) == [("a", "x"), ("a", "y"), ("b", "x"), (None, "q"), (None, "r")]


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert top_n(empty, ["g"], "s", "i", 3).count() == 0
    assert top_n(empty, ["g"], "s", "i", 0).count() == 0
