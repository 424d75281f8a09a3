"""Items of varying length in containers of fixed capacity.

Best-fit decreasing: items in falling order of size each go to the open
container with the least room that still holds them. A segment tree over the
room left, 0 to capacity, counts the open containers with each room and finds
the tightest in logarithmic time.

Size: documents are spread over blocks of about ``BLOCK`` by hash and each
block is packed by itself, so at most the last container of each block is
poorly filled; no task sees more than a block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelloom.session import broadcast_small, materialize

BLOCK = 20_000
# Fixed value: how a byte-level BPE of English cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class RoomTree:
    """Counts of open containers by room; finds the least room of at least n."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, (capacity + 1 - 1).bit_length())
        while self.size < capacity + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, container: int) -> None:
        self.open.setdefault(room, []).append(container)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, container) of the tightest fit."""
        count, at = self.count, least + self.size
        if least >= self.size:
            return None
        if not count[at]:
            # Up to the first right sibling with a container, then down to its leftmost.
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at <<= 1
                if not count[at]:
                    at += 1
        room = at - self.size
        container = self.open[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, container


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; all sizes are from 1 to ``capacity``."""
    tree, out, made = RoomTree(capacity), np.empty(len(sizes), dtype=np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fit = tree.take(n)
        room, container = fit if fit else (capacity, made)
        made += fit is None
        out[i] = container
        if room > n:
            tree.add(room - n, container)
    return out


def pieces(ids: np.ndarray, tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, size): only texts above the capacity are split, into full
    pieces and a rest."""
    parts = -(-tokens // capacity)
    row = np.repeat(np.arange(len(ids)), parts)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    return row, piece, np.minimum(capacity, tokens[row] - piece * capacity)


def token_counts(documents: DataFrame, tokenizers: str, vocabulary: str) -> DataFrame:
    """(doc_id, tokens) of every document; a null text has none."""
    ranks_text = (Path(tokenizers) / vocabulary).read_bytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_text.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, "doc_id bigint, tokens bigint")


def packed(documents: DataFrame, windows: DataFrame, tokenizers: str, vocabulary: str) -> DataFrame:
    """(window_id, container, doc_id, piece, tokens): where each text goes.

    ``windows`` has window_id and capacity_tokens, a few rows; capacities
    below one and nulls are left out. Texts without tokens need no container.
    A text above the capacity is split into full pieces and a rest; no other
    is. A repeated doc_id counts as often as it occurs.
    """
    sizes = materialize(token_counts(documents, tokenizers, vocabulary).where("tokens > 0"), "tokens")
    wanted = [(r[0], r[1]) for r in windows.where("capacity_tokens > 0 and window_id is not null").select("window_id", "capacity_tokens").collect()]
    blocks = max(1, -(-sizes.count() // BLOCK))
    listed = F.array(*[F.struct(F.lit(w).cast("int").alias("window_id"), F.lit(c).cast("int").alias("capacity")) for w, c in wanted])
    if not wanted:
        listed = F.array().cast("array<struct<window_id:int,capacity:int>>")

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        window, capacity, block = key
        pdf = pdf.sort_values(["doc_id", "tokens"], kind="stable")
        ids, tokens = pdf["doc_id"].to_numpy(), pdf["tokens"].to_numpy()
        row, piece, size = pieces(ids, tokens, int(capacity))
        where = best_fit_decreasing(size, int(capacity))
        return pd.DataFrame({"window_id": np.int32(window), "container": (np.int64(block) << 32) + where, "doc_id": ids[row], "piece": piece, "tokens": size})

    return (
        sizes.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
        .withColumn("w", F.explode(listed))
        .select("doc_id", "tokens", "block", "w.window_id", "w.capacity")
        .groupBy("window_id", "capacity", "block")
        .applyInPandas(pack, "window_id int, container bigint, doc_id bigint, piece bigint, tokens bigint")
    )


def fill_report(packing: DataFrame, windows: DataFrame) -> DataFrame:
    """Containers, tokens, unused share and the least possible number of
    containers, by window."""
    used = packing.groupBy("window_id").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    room = F.col("containers") * F.col("capacity_tokens")
    return used.join(broadcast_small(windows), "window_id").select(
        "window_id",
        "capacity_tokens",
        "containers",
        "tokens",
        F.round(1 - F.col("tokens") / room, 6).alias("unused"),
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
    )
