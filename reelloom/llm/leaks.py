"""Evaluation texts that leak into a corpus.

Wu-Manber multi-pattern search over words: the patterns are all windows of a
few words of the evaluation texts. A table gives for each block of two words
how far the window may move on; where it is zero, the hash of the whole window
selects the patterns to compare. Many stretches of text are searched in step,
so each step is one array operation. Places of one item are then joined along
their offset, and what they cover is compared with the item letter by letter.

Windows have ``WINDOW`` words, in items of up to ``SHORT`` words one less: half
of an item in two stretches, one word in eight exchanged, always holds one.
Items of fewer than ``WHOLE`` words are searched whole.

The corpus isn't shuffled. Evaluation texts are few; their pattern tables go to
every task. Beyond ``PART_WORDS`` words they are searched in parts, each with a
scan of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelloom.llm.wordscan import Scan, chunks, hash_words, words_in

WINDOW = 4
SHORT = 20
WHOLE = 9
LANES = 4096
TABLE_BITS = 18
EXCHANGED = 8  # at most one word in so many is exchanged
PART_WORDS = 1_000_000
_MIX = np.uint64(0xD6E8FEB86659FD93)


def without_markup(text: Column) -> Column:
    """Lower-case text without tags, entities and invisible characters.

    No part of a pattern is given back, so the time is linear in the text.
    """
    bare = F.regexp_replace(text, r"</?+[A-Za-z!][^<>]*+>|\[/?+[A-Za-z]++(?:=[^\[\]]*+)?+\]|&(?:[A-Za-z][A-Za-z0-9]*+|#[0-9]++|#[Xx][0-9A-Fa-f]++);", " ")
    return F.translate(F.lower(bare), "­​‌‍⁠﻿", "")


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row."""
    n = max(0, len(words) - size + 1)
    total = words[:n].copy()
    for k in range(1, size):
        total = total * _MIX ^ words[k : n + k]
    return total


class Windows:
    """Shift table and sorted windows of ``size`` words of some items."""

    def __init__(self, size: int, items: list[tuple[int, np.ndarray]]):
        self.size, self.block = size, min(2, size)
        self.shift = np.full(1 << TABLE_BITS, size - self.block + 1, dtype=np.int8)
        keys, owner, at = [], [], []
        for n, words in items:
            places = len(words) - size + 1
            slot = self._slot(words)
            for k in range(size - self.block + 1):  # a block that starts k words into a window
                np.minimum.at(self.shift, slot[k : places + k], size - self.block - k)
            keys.append(_windows(words, size))
            owner.append(np.full(places, n))
            at.append(np.arange(places))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.at = key[order], np.concatenate(owner)[order], np.concatenate(at)[order]

    def _slot(self, words: np.ndarray) -> np.ndarray:
        """The table entry of each block."""
        return ((_windows(words, self.block) * _MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the window's first word, item, place in the item)."""
        none = (np.empty(0, np.int64),) * 3
        size = self.size
        if len(words) < size:
            return none
        shift = self.shift[self._slot(words)]
        last = len(shift) - 1
        lane = max(size, -(-len(words) // LANES))
        place = np.arange(size - self.block, last + 1, lane)  # of a window's last block
        stop = np.minimum(place + lane - 1, last)
        hits = []
        while len(place):
            step = shift[place]
            hits.append(place[step == 0])
            place = place + np.maximum(step, 1)
            going = place <= stop
            place, stop = place[going], stop[going]
        found = np.sort(np.concatenate(hits))
        if not len(found):
            return none
        first = found - (size - self.block)
        whole = words[first].copy()
        for k in range(1, size):
            whole = whole * _MIX ^ words[first + k]
        low = np.searchsorted(self.key, whole, side="left")
        count = np.searchsorted(self.key, whole, side="right") - low
        ends = np.cumsum(count)
        row = np.repeat(np.arange(len(first)), count)
        pick = np.arange(int(ends[-1])) - np.repeat(ends - count, count) + np.repeat(low, count)
        return first[row], self.owner[pick], self.at[pick]


class Patterns:
    """The evaluation texts, by the size of their windows."""

    def __init__(self, items: list[tuple[int, str]], least: float = 0.5):
        self.ids = [i for i, _ in items]
        self.texts = [words_in(t) for _, t in items]
        self.words = [hash_words(t) for _, t in items]
        self.least = np.array([1.0 if len(w) < WHOLE else least for w in self.words])
        self.size = [min(WINDOW, len(w)) if not WHOLE <= len(w) <= SHORT else WINDOW - 1 for w in self.words]
        half = np.array([int(np.ceil(len(w) * x)) for w, x in zip(self.words, self.least)], dtype=np.int64)
        exchanged, size = half // EXCHANGED, np.array(self.size, dtype=np.int64)
        # So many windows remain of the least repeated words, in two stretches with all exchanges.
        self.needed = np.maximum(1, half - exchanged * size - 2 * (size - 1))
        sizes = sorted({s for s in self.size if s})
        self.tables = [Windows(s, [(n, w) for n, w in enumerate(self.words) if self.size[n] == s]) for s in sizes]

    def search(self, words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, place in the item) of the windows that lie in one text."""
        found = []
        for t in self.tables:
            place, owner, at = t.search(words)
            inside = text[place + t.size - 1] == text[place]
            found.append((place[inside], owner[inside], at[inside]))
        return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))


def stretches(same: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(from, to, exchanged) of the stretches in ``same``, which tells the equal
    words at one offset: they start and end with equal words, hold ``size``
    equal words in a row, and exchange single words, at most one in
    ``EXCHANGED`` of all."""
    edge = np.diff(same.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = []
    for i in range(len(begin)):
        long = False
        for j in range(i, len(begin)):
            if j > i and begin[j] - end[j - 1] > 1 or (j - i) * EXCHANGED > len(same):
                break
            long = long or end[j] - begin[j] >= size
            if long:
                out.append((int(begin[i]), int(end[j]), j - i))
    return out


def repeated_share(found: list[tuple[int, int, int, int]], length: int) -> float:
    """Largest share of an item's ``length`` words in one or two stretches,
    given as (from, to, exchanged, offset), in the item's order.

    Of a stretch that a document repeats, the first place counts before and
    the last after another, so the work follows the item's length, however
    often the document repeats it.
    """
    if not found:
        return 0.0
    ends: dict[tuple[int, int, int], list[int]] = {}
    for a, b, x, o in found:
        low_high = ends.setdefault((a, b, x), [o, o])
        low_high[0], low_high[1] = min(low_high[0], o), max(low_high[1], o)
    a, b, x = (np.array(v, dtype=np.int64) for v in zip(*ends))
    low, high = (np.array(v, dtype=np.int64) for v in zip(*ends.values()))
    best = int(np.max(np.where(x * EXCHANGED <= b - a, b - a, 0)))
    for i in range(len(a)):
        # Where the two overlap, in item or document, the later one is cut.
        start = np.maximum(np.maximum(a, b[i]), b[i] + low[i] - high)
        total = np.where(start < b, b[i] - a[i] + b - start, 0)
        total = np.where((x + x[i]) * EXCHANGED <= total, total, 0)
        best = max(best, int(total.max()))
    return best / max(1, length)


def _parts(items: DataFrame, words: int) -> Iterator[list[tuple[int, str]]]:
    """Texts in parts of about ``words`` words at most, or of a single text."""
    texts = items.where("text is not null").select("item_id", without_markup(F.col("text")).alias("text"))
    counted = texts.agg(F.sum(F.size(F.split("text", r"[^\\p{L}\\p{N}]+")))).first()[0]
    parts = -(-(counted or 0) // words)
    for k in range(parts):
        mine = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield [tuple(r) for r in mine.collect()]  # about ``words`` words


def leaked(corpus: DataFrame, items: DataFrame, least: float = 0.5, part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, item_id, share) of documents that repeat at least ``least`` of
    an item's words, in their order, in one or two stretches.

    Case, punctuation, spacing and markup don't count. A stretch holds
    ``WINDOW`` equal words in a row (one less in items of up to ``SHORT``
    words). Items of fewer than ``WHOLE`` words must be repeated whole. Null
    texts and texts without words match nothing. Repeated rows of the corpus
    give repeated results; of equal items each is named.
    """
    texts = corpus.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), without_markup(F.col("text")).alias("text"))
    schema = "doc_id bigint, item_id bigint, share double"
    found = [texts.mapInArrow(_searcher(Patterns(part, least)), schema) for part in _parts(items, part_words)]
    return reduce(DataFrame.unionByName, found) if found else corpus.sparkSession.createDataFrame([], schema)


def _searcher(patterns: Patterns):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            doc, item, share = [], [], []
            for first, _, joined, starts in chunks(batch.column(1)):
                scan = Scan(joined, starts)
                words = scan.hashes
                place, owner, at = patterns.search(words, scan.text)
                text = scan.text[place]
                pair, index, count = np.unique(text * len(patterns.ids) + owner, return_inverse=True, return_counts=True)
                by_pair = np.argsort(index, kind="stable")
                edges = np.concatenate([[0], np.cumsum(count)])
                for p in np.flatnonzero(count >= patterns.needed[pair % len(patterns.ids)]):
                    t, n = divmod(int(pair[p]), len(patterns.ids))
                    low, high = np.searchsorted(scan.text, [t, t + 1])
                    mine = by_pair[edges[p] : edges[p + 1]]
                    got = _share(patterns, n, scan, words, low, high, np.unique(place[mine] - low - at[mine]))
                    if got >= patterns.least[n]:
                        doc.append(ids[first + t])
                        item.append(patterns.ids[n])
                        share.append(got)
            if doc:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "share"]
                )

    return search


def _share(patterns: Patterns, n: int, scan: Scan, words: np.ndarray, low: int, high: int, offsets: np.ndarray) -> float:
    """Share of item ``n`` that the text from word ``low`` to ``high`` repeats.
    Words of equal hash are compared by their letters."""
    item, letters = patterns.words[n], patterns.texts[n]
    found = []
    for o in offsets.tolist():
        a, b = max(0, -o), min(len(item), high - low - o)
        same = item[a:b] == words[low + a + o : low + b + o]
        edge = np.diff(same.astype(np.int8), prepend=0, append=0)
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            at = low + a + o
            if scan.letters(at + i, at + j) != b"".join(letters[a + i : a + j]):
                same[i:j] = [letters[a + k] == scan.letters(at + k, at + k + 1) for k in range(i, j)]
        found += [(a + i, a + j, x, o) for i, j, x in stretches(same, patterns.size[n]) if x * EXCHANGED <= len(item)]
    return repeated_share(found, len(item))
