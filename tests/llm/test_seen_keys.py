import base64
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reelloom.llm.seen_keys import GolombSet, seen_before, wrong_answers

SCHEMA = "record_id bigint, source string, info_hash string, hash string, epoch int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=700), st.integers(1, 20), st.integers(1, 200))
def test_round_trip(values, bits, block):
    hashes = np.array(values, dtype=np.int64)
    made = GolombSet.unpack(GolombSet.build(hashes, bits).pack())
    assert made.contains(hashes).all()
    every = np.arange(len(made.first))
    assert np.array_equal(made._decode(every), np.sort(GolombSet.reduce(hashes, max(1, len(hashes)), bits)))
    some = every[::2]
    assert len(made._decode(some)) == sum(min(128, len(hashes) - 128 * b) for b in some)


def test_false_positives_are_as_rare_as_said():
    rng = np.random.default_rng(0)
    made = GolombSet.build(rng.integers(-(2**63), 2**63, 20_000, dtype=np.int64), 8)
    rate = made.contains(rng.integers(-(2**63), 2**63, 100_000, dtype=np.int64)).mean()
    assert 0.5 / 256 < rate < 1.5 / 256
    assert len(made.pack()) * 8 / 20_000 < 12


def brute(records, ingested):
    def key(source, raw):
        source, raw = (source or "").strip(), (raw or "").strip()
        if raw.lower().startswith("magnet:"):
            raw = raw.partition("btih:")[2].partition("&")[0]
        if len(raw) == 32:
            try:
                raw = base64.b32decode(raw.upper()).hex()
            except ValueError:
                return None
        return (source, raw.lower()) if source and len(raw) == 40 else None

    seen = {key(*r[:2]) for r in ingested} - {None}
    out = set()
    for rid, source, raw, *_ in sorted(records):
        k = key(source, raw)
        if k is None:
            continue
        if k in seen:
            out.add(rid)
        seen.add(k)
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    hashes = [bytes(rng.randrange(256) for _ in range(20)) for _ in range(400)]
    shapes = [lambda h: h.hex(), lambda h: f" {h.hex().upper()}\n", lambda h: base64.b32encode(h).decode(), lambda h: f"magnet:?dn=a&xt=urn:btih:{h.hex()}&tr=b", lambda h: h.hex()[:-1], lambda h: None, lambda h: ""]
    pick = lambda: rng.choices(shapes, [5, 2, 2, 2, 1, 1, 1])[0](hashes[0] if rng.random() < 0.34 else rng.choice(hashes))
    sources = ["a", " a", "b\t", "", None, "c", " "]
    records = [(i, rng.choice(sources), pick(), "x", 1) for i in range(3000)]
    ingested = [(rng.choice(["a", "b"]), hashes[i].hex()) for i in range(100)] * 2 + [("", hashes[0].hex()), (None, None)]
    rng.shuffle(records)
    out = seen_before(spark.createDataFrame(records, SCHEMA), spark.createDataFrame(ingested, "source string, info_hash string"))
    found = [r.record_id for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(records, ingested)


def test_empty(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", "0" * 40)], "source string, info_hash string")
    assert seen_before(none, some).count() == 0
    one = spark.createDataFrame([(7, "a", "0" * 40, "", 0)], SCHEMA)
    assert [r.record_id for r in seen_before(one, some).collect()] == [7]
    assert seen_before(one, some.limit(0)).count() == 0
    assert wrong_answers(one, some).first().true_positives == 1


def test_a_far_record_leaves_the_stretches_even(spark):
    # Every key comes twice, half of all records apart; one record_id is far off.
    records = [(i, "a", f"{i % 1600:040x}", "", 0) for i in range(3200)] + [(10**12, "a", f"{5:040x}", "", 0)]
    records = spark.createDataFrame(records, SCHEMA)
    none = spark.createDataFrame([], "source string, info_hash string")
    audit = wrong_answers(records, none).collect()
    assert len(audit) > 8 and max(r.records for r in audit) < 3201 / 8
    assert sum(r.true_positives for r in audit) == 1601 and sum(r.folded_records for r in audit) == 0
    found = sorted(r.record_id for r in seen_before(records, none).collect())
    assert found == [*range(1600, 3200), 10**12]
