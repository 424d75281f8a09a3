"""Has this key been seen before?

Earlier keys are kept as Golomb-coded sets: hashes reduced to a range of
``keys * 2**bits``, sorted, and stored as Golomb-Rice coded gaps in blocks. A
probe finds its block in the directory, and only probed blocks are decoded. A
set answers "no" for certain, and "yes" wrongly with probability ``2**-bits``.

Keys are spread over hash buckets of about ``KEYS_PER_BUCKET``; arrivals are
cut into ``EPOCHS`` stretches of about as many records, each with a set per
bucket. A record probes the sets of all stretches before its own. Repeats of a
key within one stretch collapse in a partial aggregate before any shuffle, so a
key that holds a third of all rows costs no more than others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelloom.functions.infohash import hash_of_delivery
from reelloom.functions.text import non_blank
from reelloom.session import materialize

KEYS_PER_BUCKET = 50_000
EPOCHS = 32
QUANTILE_ERROR = 1e-3  # of all records; a stretch is off by at most twice that
BITS = 12
BLOCK = 128


class GolombSet:
    """A Golomb-coded set of 64-bit hashes."""

    def __init__(self, n: int, bits: int, first: np.ndarray, unary_at: np.ndarray, rest_at: np.ndarray, unary: np.ndarray, rest: np.ndarray):
        self.n, self.bits = n, bits
        self.first, self.unary_at, self.rest_at = first, unary_at, rest_at
        self.unary, self.rest = unary, rest

    @staticmethod
    def reduce(hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
        """Hashes brought to ``0 .. n * 2**bits - 1``, order kept."""
        part = (hashes.astype(np.int64).view(np.uint64) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        return np.minimum(np.floor(part * (n * 2.0**bits)), n * 2.0**bits - 1).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray, bits: int = BITS, block: int = BLOCK) -> GolombSet:
        n = len(hashes)
        values = np.sort(cls.reduce(hashes, max(n, 1), bits))
        heads = np.arange(0, n, block)
        gaps = np.diff(values, prepend=values[:1])
        inside = np.ones(n, dtype=bool)
        inside[heads] = False
        gaps = gaps[inside]
        owner = np.arange(n)[inside] // block
        quotient, rest = gaps >> bits, gaps & ((1 << bits) - 1)
        # Unary part: each block is padded to whole bytes, so blocks can be cut out.
        length = np.bincount(owner, quotient + 1, minlength=len(heads)).astype(np.int64)
        unary_at = np.concatenate([[0], np.cumsum((length + 7) // 8)])
        ends = np.cumsum(quotient + 1) - 1
        before = np.concatenate([[0], np.cumsum(length)])[:-1]
        stream = np.zeros(int(unary_at[-1]) * 8, dtype=np.uint8)
        stream[ends - before[owner] + unary_at[:-1][owner] * 8] = 1
        count = np.bincount(owner, minlength=len(heads)).astype(np.int64)
        rest_at = np.concatenate([[0], np.cumsum((count * bits + 7) // 8)])
        at = np.arange(len(gaps)) - np.concatenate([[0], np.cumsum(count)])[:-1][owner]
        rest_stream = np.zeros(int(rest_at[-1]) * 8, dtype=np.uint8)
        base = rest_at[:-1][owner] * 8 + at * bits
        for b in range(bits):
            rest_stream[base + b] = (rest >> (bits - 1 - b)) & 1
        return cls(n, bits, values[heads], unary_at, rest_at, np.packbits(stream), np.packbits(rest_stream))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        if not self.n or not len(hashes):
            return np.zeros(len(hashes), dtype=bool)
        values = self.reduce(hashes, self.n, self.bits)
        block = np.searchsorted(self.first, values, side="right") - 1
        held = self._decode(np.unique(block[block >= 0]))
        at = np.minimum(np.searchsorted(held, values), max(len(held) - 1, 0))
        return held[at] == values if len(held) else np.zeros(len(values), dtype=bool)

    def _decode(self, blocks: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Sorted values of some blocks."""
        if not len(blocks):
            return np.empty(0, dtype=np.int64)
        count = np.minimum(block, self.n - blocks * block) - 1
        cut = lambda at, data: data[_ranges(at[blocks], at[blocks + 1])]
        ones = np.flatnonzero(np.unpackbits(cut(self.unary_at, self.unary)))
        owner = np.repeat(np.arange(len(blocks)), count)
        width = (self.unary_at[blocks + 1] - self.unary_at[blocks]) * 8
        begin = np.concatenate([[0], np.cumsum(width)])[:-1]
        head = np.concatenate([[0], np.cumsum(count)])[:-1]
        first = np.zeros(len(ones), dtype=bool)
        first[head[count > 0]] = True
        quotient = np.diff(ones, prepend=-1) - 1
        quotient[first] = ones[first] - begin[owner[first]]
        bits = np.unpackbits(cut(self.rest_at, self.rest))
        width = (self.rest_at[blocks + 1] - self.rest_at[blocks]) * 8
        base = np.concatenate([[0], np.cumsum(width)])[:-1][owner] + (np.arange(len(owner)) - head[owner]) * self.bits
        rest = np.zeros(len(owner), dtype=np.int64)
        for b in range(self.bits):
            rest = (rest << 1) | bits[base + b]
        gaps = (quotient.astype(np.int64) << self.bits) | rest
        values = np.empty(len(blocks) + len(gaps), dtype=np.int64)
        heads = head + np.arange(len(blocks))
        mask = np.ones(len(values), dtype=bool)
        mask[heads] = False
        values[mask] = gaps
        values[heads] = 0
        total = np.cumsum(values)
        return total - np.repeat(total[heads] - self.first[blocks], count + 1)

    def pack(self) -> bytes:
        head = np.array([self.n, self.bits, len(self.first), len(self.unary), len(self.rest)], dtype=np.int64)
        return b"".join(x.tobytes() for x in (head, self.first, self.unary_at, self.rest_at, self.unary, self.rest))

    @classmethod
    def unpack(cls, data: bytes) -> GolombSet:
        n, bits, blocks, unary, rest = np.frombuffer(data, dtype=np.int64, count=5)
        at = 40
        parts = []
        for size in (blocks, blocks + 1, blocks + 1):
            parts.append(np.frombuffer(data, dtype=np.int64, count=int(size), offset=at))
            at += int(size) * 8
        first = np.frombuffer(data, dtype=np.uint8, count=int(unary), offset=at)
        second = np.frombuffer(data, dtype=np.uint8, count=int(rest), offset=at + int(unary))
        return cls(int(n), int(bits), *parts, first, second)


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The concatenation of ``start[i] .. stop[i] - 1``."""
    length = stop - start
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + length, length)


def build_sets(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """One set for each (bucket, epoch) of ``keys`` (bucket, epoch, h)."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = GolombSet.build(pdf["h"].to_numpy(), bits)
        return pd.DataFrame({"bucket": [key[0]], "epoch": [key[1]], "data": [made.pack()]})

    return keys.select("bucket", "epoch", "h").groupBy("bucket", "epoch").applyInPandas(build, "bucket int, epoch int, data binary")


def probe_sets(sets: DataFrame, probes: DataFrame) -> DataFrame:
    """The (h, epoch) of ``probes`` (bucket, epoch, h) that a set of an earlier
    epoch seems to hold."""

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = sorted((e, GolombSet.unpack(d)) for e, d in zip(left["epoch"], left["data"]))
        out = [pd.DataFrame({"h": np.empty(0, np.int64), "epoch": np.empty(0, np.int32)})]
        for epoch, rows in right.groupby("epoch"):
            h = rows["h"].to_numpy()
            hit = np.zeros(len(h), dtype=bool)
            for e, filled in held:
                if e < epoch:
                    open_ = np.flatnonzero(~hit)
                    hit[open_] = filled.contains(h[open_])
            out.append(pd.DataFrame({"h": h[hit], "epoch": np.full(hit.sum(), epoch, np.int32)}))
        return pd.concat(out)

    return (
        sets.groupBy("bucket")
        .cogroup(probes.select("bucket", "epoch", "h").groupBy("bucket"))
        .applyInPandas(probe, "h bigint, epoch int")
    )


def keyed_records(records: DataFrame) -> DataFrame:
    """record_id, source and 20-byte hash of the rows that have both."""
    return records.select(
        "record_id", non_blank(F.col("source")).alias("source"), F.unhex(hash_of_delivery(F.col("info_hash"))).alias("hash")
    ).where("source is not null and hash is not null and record_id is not null")


def arrivals(records: DataFrame, ingested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with their epoch, and the distinct keys of every epoch.

    Epoch 0 holds the keys ingested before; the others cut the records at
    quantiles of record_id, whatever the order of rows.
    """
    shares = [k / EPOCHS for k in range(1, EPOCHS)]
    n, ends = records.agg(F.count(F.lit(1)), F.percentile_approx("record_id", shares, int(1 / QUANTILE_ERROR))).first()
    epoch = F.lit(1)
    for end in sorted(set(ends or [])):
        epoch = epoch + (F.col("record_id") > end).cast("int")
    rows = keyed_records(records).withColumn("epoch", epoch)
    before = ingested.select(
        F.lit(-1).cast("bigint").alias("record_id"),
        non_blank(F.col("source")).alias("source"),
        F.unhex(hash_of_delivery(F.col("info_hash"))).alias("hash"),
        F.lit(0).alias("epoch"),
    ).where("source is not null and hash is not null")
    buckets = max(1, -(-(n + ingested.count()) // KEYS_PER_BUCKET))
    h = F.xxhash64("source", "hash")
    keys = (
        rows.unionByName(before)
        .groupBy("source", "hash", "epoch")
        .agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .withColumn("h", h)
        .withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int"))
    )
    return rows, materialize(keys, "keys")


def _checked(keys: DataFrame) -> DataFrame:
    """Keys of epochs after the first for which a set said yes, with the truth."""
    maybe = probe_sets(build_sets(keys), keys.where("epoch > 0"))
    claimed = maybe.groupBy("h").agg(F.collect_set("epoch").alias("claims"))  # at most one per epoch
    # Only claimed keys are looked up; h follows from the key, so its partitioning serves the grouping too.
    seen = F.collect_list(F.struct("epoch", "first_id")).alias("seen")
    return (
        keys.join(claimed, "h")
        .groupBy("h", "source", "hash")
        .agg(F.min("epoch").alias("earliest"), F.first("claims").alias("claims"), seen)
        .withColumn("s", F.explode("seen"))
        .where(F.array_contains("claims", F.col("s.epoch")))
        .select("source", "hash", "s.epoch", "s.first_id", (F.col("earliest") < F.col("s.epoch")).alias("confirmed"))
    )


def seen_before(records: DataFrame, ingested: DataFrame) -> DataFrame:
    """record_id of every record whose key was ingested or delivered earlier.

    ``records``: record_id, source, info_hash; ``ingested``: source,
    info_hash. The key is the source without surrounding white space and the
    20-byte hash in any notation; records without either are no cases. Keys
    that a Golomb-coded set claims are checked against the exact keys, so the
    result has no false positives; a key repeated within its own epoch is seen
    from its second record on. Of records that share a record_id the row may
    repeat. Empty tables give no rows.
    """
    rows, keys = arrivals(records, ingested)
    first = _checked(keys).where("confirmed").select(F.col("first_id").alias("record_id"))
    repeated = keys.where("epoch > 0 and n > 1").select("source", "hash", "epoch", "first_id")
    later = rows.join(repeated, ["source", "hash", "epoch"]).where("record_id > first_id").select("record_id")
    return first.unionByName(later)


def wrong_answers(records: DataFrame, ingested: DataFrame, bits: int = BITS) -> DataFrame:
    """How often the sets alone are wrong, by epoch: distinct keys probed, keys
    never seen before, false positives, the rate in theory and as audited; and
    the records of the keys, those the fold decides as repeats within the epoch,
    their share of all repeats, and the audited rate by record."""
    _, keys = arrivals(records, ingested)
    checked = _checked(keys).groupBy("epoch").agg(
        F.count_if("confirmed").alias("true_positives"), F.count_if(~F.col("confirmed")).alias("false_positives")
    )
    probes = keys.where("epoch > 0").groupBy("epoch").agg(
        F.count(F.lit(1)).alias("keys_probed"), F.sum("n").alias("records"), F.sum(F.col("n") - 1).alias("folded_records")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        probes.join(checked, "epoch", "left")
        .withColumn("true_positives", zero("true_positives"))
        .withColumn("false_positives", zero("false_positives"))
        .withColumn("new_keys", F.col("keys_probed") - F.col("true_positives"))
        .withColumn("theoretical_rate", 1 - F.pow(F.lit(1 - 2.0**-bits), F.col("epoch")))
        .withColumn("audited_rate", F.col("false_positives") / F.greatest(F.col("new_keys"), F.lit(1)))
        .withColumn("folded_share", F.col("folded_records") / F.greatest(F.col("folded_records") + F.col("true_positives"), F.lit(1)))
        .withColumn("audited_record_rate", F.col("false_positives") / F.col("records"))
    )
