"""Words and lines of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, stop, joined bytes, start of each text): runs of texts of about
    ``CHUNK_BYTES``, joined by line ends. A null text is empty."""
    raw = [t.encode("utf-8", "replace") if t is not None else b"" for t in texts.to_pylist()]
    first, size = 0, 0
    for i, t in enumerate(raw):
        size += len(t) + 1
        if size >= CHUNK_BYTES or i + 1 == len(raw):
            part = raw[first : i + 1]
            lengths = np.array([len(x) + 1 for x in part], dtype=np.int64)
            yield first, i + 1, b"\n".join(part) + b"\n", np.cumsum(lengths) - lengths
            first, size = i + 1, 0


def _folded(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII, Latin-1 and Cyrillic letters in lower case."""
    out = _LOWER[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) | (data[:-1] == 0xD0))
    if len(lead):
        first, second = data[lead], data[lead + 1]
        near = ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)) | ((first == 0xD0) & (second >= 0x90) & (second <= 0x9F))
        far = (first == 0xD0) & (second >= 0xA0) & (second <= 0xAF)
        out[lead[near] + 1] += 0x20
        out[lead[far]] = 0xD1
        out[lead[far] + 1] -= 0x20
    return out


class Scan:
    """Words of joined texts.

    A word is a run of letters and digits; symbols outside ASCII (general
    punctuation, blanks, arrows, boxes) separate like ASCII ones. ``hashes``
    are those of the words in lower case.
    """

    def __init__(self, joined: bytes, starts: np.ndarray):
        data = np.frombuffer(joined, dtype=np.uint8)
        mask = _WORD[data]
        for lead, second, width in ((0xE2, None, 3), (0xC2, None, 2), (0xEF, 0xBB, 3), (0xE3, 0x80, 3)):
            at = np.flatnonzero(data == lead)
            if second is not None:
                at = at[data[np.minimum(at + 1, len(data) - 1)] == second]
            for k in range(width):
                mask[np.minimum(at + k, len(data) - 1)] = False
        edge = np.diff(mask.view(np.int8), prepend=0, append=0)
        self.begin = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.data, self.mask = data, mask
        self.length = self.end - self.begin
        self.text = np.searchsorted(starts, self.begin, side="right") - 1

    def letters(self, i: int, j: int) -> bytes:
        """Words ``i`` to ``j - 1`` in lower case, with a blank after each."""
        part = slice(self.begin[i], self.end[j - 1])
        inside = self.mask[part]
        # One separator is kept after each word.
        kept = inside | np.concatenate([[False], inside[:-1]])
        return np.where(inside, _folded(self.data[part]), 32)[kept].astype(np.uint8).tobytes() + b" "

    @property
    def hashes(self) -> np.ndarray:
        if not len(self.begin):
            return np.empty(0, dtype=np.uint64)
        at = np.flatnonzero(self.mask)
        depth = at - np.repeat(self.begin, self.length)
        power = np.full(int(self.length.max()), _BASE, dtype=np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        value = (_folded(self.data)[at].astype(np.uint64) + np.uint64(1)) * power[depth]
        head = np.cumsum(self.length) - self.length
        mixed = np.add.reduceat(value, head) * _BASE
        return mixed ^ (mixed >> np.uint64(29))


def hash_words(text: str) -> np.ndarray:
    joined = text.encode("utf-8", "replace") + b"\n"
    return Scan(joined, np.zeros(1, dtype=np.int64)).hashes


def words_in(text: str) -> list[bytes]:
    """The words of a text in lower case, with a blank after each."""
    scan = Scan(text.encode("utf-8", "replace") + b"\n", np.zeros(1, dtype=np.int64))
    return [scan.letters(i, i + 1) for i in range(len(scan.begin))]
