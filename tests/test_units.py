import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelloom.functions.sizes import declared_factor, name_bytes, size_text_bytes
from reelloom.operators.units import changepoints, level_shifts, sizes_in_bytes


def brute_cost(n, s, q, cuts, penalty):
    edges = [0, *cuts, len(n)]
    return sum(q[a:b].sum() - s[a:b].sum() ** 2 / n[a:b].sum() for a, b in zip(edges, edges[1:])) + penalty * len(cuts)


@pytest.mark.parametrize("seed", range(6))
def test_changepoints_are_exact(seed):
    rng = np.random.default_rng(seed)
    size = 9
    n = rng.integers(1, 5, size).astype(float)
    level = np.repeat(rng.choice([0, 7, 14], 3), 3)
    s = n * (level + rng.normal(0, 1, size))
    q = s * s / n + rng.random(size)
    found = changepoints(n, s, q, 3.0)
    best = min(brute_cost(n, s, q, c, 3.0) for k in range(size) for c in itertools.combinations(range(1, size), k))
    assert found[0] == 0
    assert brute_cost(n, s, q, tuple(found[1:]), 3.0) == pytest.approx(best)


def test_no_history_has_no_segment():
    assert changepoints(np.array([]), np.array([]), np.array([]), 1.0) == []


CASES = {
    "1.73 GB": 1_730_000_000, "0,89 GiB": 955_630_223, "7,441,450,571 B": 7_441_450_571, "9 226 730 536 bytes": 9_226_730_536, "3.401 gio": 3_651_795_943,
    "size=2.5GB": 2_500_000_000, "ca. 3.73 GB": 3_730_000_000, "2.19 ГБ": 2_190_000_000, "683 Mo": 683_000_000, "2,786.49 MB": 2_786_490_000,
    "1318867 KiB": 1_350_519_808, "1,424GB": 1_424_000_000, "n/a": None, "": None, "-- MB": None, "0 B": 0, "unknown": None, "12 kbps": None,
}


def test_size_texts(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string").select("t", size_text_bytes(F.col("t")).alias("b"))
    assert {r.t: r.b for r in df.collect()} == CASES


def test_sizes_in_names(spark):
    cases = {
        "A Part 2 325 MB": 325_000_000, "X.DDP5.1.2010.10bit": None, "Storm - 07 (1080p) [1,69GB]": 1_690_000_000, "S | 5.2 GiB": 5_583_457_485, "plain": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", name_bytes(F.col("t")).alias("b"))
    assert {r.t: r.b for r in df.collect()} == cases


def test_declared_units(spark):
    cases = {"B": 1, "bytes": 1, "octets": 1, "KiB": 1024, "MB (10^6)": 10**6, "MB (2^20)": 2**20, "kilobytes": 1000, "mebibytes": 2**20, "unknown": None, None: None}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", declared_factor(F.col("t")).alias("f"))
    assert {r.t: None if r.f is None else int(r.f) for r in df.collect()} == cases


RECORDS = "record_id bigint, source string, info_hash string, name string, size bigint, size_text string, observed_at timestamp_ntz, factor int, units string"
START = dt.datetime(2026, 1, 1)


def test_learned_units(spark):
    rng = random.Random(1)
    data, expected = [], {}
    for i in range(3000):
        size = int(np.exp(rng.gauss(21, 1.2)))
        h = f"{i % 900:040x}"
        if i % 900 != i:
            size = sizes[i % 900]
        else:
            sizes = locals().get("sizes", {})
            sizes[i] = size
        source = ("plain", "kib", "changing")[i % 3 if i >= 900 else 0]
        at = START + dt.timedelta(minutes=i)
        late = i >= 2000
        factor = {"plain": 1, "kib": 1024, "changing": 2**20 if late else 1}[source]
        delivered = max(1, size // factor)
        data.append((i, f" {source}\t", h, "n", delivered, None, at, 0, "x"))
        if factor != 1:
            expected[i] = delivered * factor
    data += [(9001, "plain", None, "n", None, "1.5 GB", None, 0, ""), (9002, "plain", "", "N [2 GiB]", 0, "n/a", None, 0, ""), (9003, None, None, "n", 5, "1 GB", None, 0, ""), (9004, "plain", None, None, -1, "0 B", None, 0, ""), (9005, "changing", None, "n", 1500, None, None, 0, "")]
    expected |= {9001: 1_500_000_000, 9002: 2 * 2**30, 9005: 1500 * 2**20}
    sources = spark.createDataFrame([("plain", "bytes"), ("kib", None), ("changing", None)], "key string, size_unit string")
    out = sizes_in_bytes(spark.createDataFrame(data, RECORDS), sources)
    assert {r.record_id: r.size_bytes for r in out.collect() if not r.stands} == expected


def test_empty_tables(spark):
    out = sizes_in_bytes(spark.createDataFrame([], RECORDS), spark.createDataFrame([], "key string, size_unit string"))
    assert out.count() == 0


def sized(spark, data, units):
    """Bytes by record id of (source, size, time[, thing]) rows, in order."""
    rows = [(i, source, f"{(thing or [i])[0]:040x}", "n", size, None, at, 0, "x") for i, (source, size, at, *thing) in enumerate(data)]
    sources = spark.createDataFrame(list(units.items()), "key string, size_unit string")
    return {r.record_id: r.size_bytes for r in sizes_in_bytes(spark.createDataFrame(rows, RECORDS), sources).collect()}


def test_a_stray_time_hides_no_change(spark):
    """A change within 8 days is found beside rows dated 1970, of another
    source and of its own."""
    rng = random.Random(4)
    real = [int(np.exp(rng.gauss(21, 1.2))) for _ in range(4000)]
    data = [("changing", size // (1024 if i >= 1000 else 1), START + dt.timedelta(minutes=i * 5)) for i, size in enumerate(real[:2000])]
    data += [("plain", size, START + dt.timedelta(hours=i)) for i, size in enumerate(real[2000:])]
    strays = [("plain", 10**9, dt.datetime(1970, 1, 1)), ("changing", 2 * 10**9, dt.datetime(1970, 1, 1, 1))]
    out = sized(spark, data + strays, {"plain": "bytes", "changing": None})
    assert all(out[i] == size // (1024 if i >= 1000 else 1) * (1024 if i >= 1000 else 1) for i, size in enumerate(real[:2000]))
    assert out[4000] == 10**9 and out[4001] == 2 * 10**9


def test_a_short_phase_is_found_and_ends(spark):
    """Twelve rows in another unit, far fewer than a bin holds."""
    rng = random.Random(9)
    real = [int(np.exp(rng.gauss(21, 1.0))) for _ in range(24_000)]
    data = [("changing", size // (2**20 if 7000 <= i < 7012 else 1), START + dt.timedelta(seconds=i)) for i, size in enumerate(real[:20_000])]
    data += [("plain", size, START + dt.timedelta(minutes=i)) for i, size in enumerate(real[20_000:])]
    data += [("plain", real[i], START + dt.timedelta(minutes=i), i) for i in range(7000, 7012, 2)]
    out = sized(spark, data, {"plain": "B", "changing": None})
    for i in range(20_000):
        assert out[i] == (real[i] // 2**20 * 2**20 if 7000 <= i < 7012 else real[i])


def test_a_shift_of_the_sizes_stays(spark):
    """Sizes a hundred times larger from some day on are no change of unit."""
    rng = random.Random(6)
    data = [("grows", int(np.exp(rng.gauss(21, 0.8))) // (1 if i >= 500 else 100), START + dt.timedelta(minutes=i)) for i in range(1000)]
    data += [("plain", int(np.exp(rng.gauss(21, 0.8))), START + dt.timedelta(minutes=i)) for i in range(1000)]
    for unit in (None, "byte"):
        out = sized(spark, data, {"plain": "B", "grows": unit})
        assert all(out[i] == data[i][1] for i in range(2000))
    rows = [(i, source, None, None, size, None, at, 0, "x") for i, (source, size, at) in enumerate(data)]
    found = [r for r in level_shifts(spark.createDataFrame(rows, RECORDS), spark.createDataFrame([("plain", "B")], "key string, size_unit string")).collect() if r.source == "grows"]
    assert len(found) == 2 and not any(r.unit_change for r in found)
    assert abs(max(found, key=lambda r: r.segment)["shift"] - np.log(100)) < 0.2


def test_sources_without_times_or_of_one_time(spark):
    rows = [(1, "k", None, None, 5, None, None, 0, ""), (2, "m", None, None, 5, "1 GB", None, 0, "")]
    rows += [(10 + i, "same", None, None, 1000 * (1024 if i % 2 else 1), None, START, 0, "") for i in range(40)]
    sources = spark.createDataFrame([("k", "KiB"), ("same", "B"), ("same", "B")], "key string, size_unit string")
    out = {r.record_id: r.size_bytes for r in sizes_in_bytes(spark.createDataFrame(rows, RECORDS), sources).collect()}
    assert out[1] == 5 * 1024 and out[2] == 10**9 and out[10] == 1000 and len(out) == 42
