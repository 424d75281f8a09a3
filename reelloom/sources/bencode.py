"""Info hash of ``.torrent`` metadata."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MAX_DEPTH = 64
RESULT = StructType([StructField("info_hash", StringType()), StructField("error", StringType())])


class _Reader:
    """Walks bencoded bytes without building values."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self) -> int:
        if self.at >= len(self.data):
            raise ValueError("ends early")
        return self.data[self.at]

    def text(self) -> bytes:
        colon = self.data.find(b":", self.at)
        digits = self.data[self.at : colon] if colon >= 0 else b""
        if not digits.isdigit() or (len(digits) > 1 and digits[:1] == b"0"):
            raise ValueError("bad string length")
        start, size = colon + 1, int(digits)
        if start + size > len(self.data):
            raise ValueError("string exceeds the data")
        self.at = start + size
        return self.data[start : self.at]

    def number(self) -> None:
        end = self.data.find(b"e", self.at)
        body = self.data[self.at + 1 : end] if end >= 0 else b""
        digits = body[1:] if body[:1] == b"-" else body
        if not digits.isdigit() or body == b"-0" or (len(digits) > 1 and digits[:1] == b"0"):
            raise ValueError("bad integer")
        self.at = end + 1

    def skip(self, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise ValueError("nested too deep")
        mark = self.peek()
        if mark == ord("i"):
            self.number()
        elif mark in (ord("l"), ord("d")):
            self.at += 1
            while self.peek() != ord("e"):
                if mark == ord("d"):
                    self.text()
                self.skip(depth + 1)
            self.at += 1
        else:
            self.text()


def info_hash(data: bytes) -> str:
    """SHA-1 of the exact bytes of the one ``info`` dictionary; a ValueError
    for anything that isn't canonical bencode with one of it and nothing after."""
    reader = _Reader(bytes(data))
    if reader.peek() != ord("d"):
        raise ValueError("root isn't a dictionary")
    reader.at += 1
    info = None
    while reader.peek() != ord("e"):
        key = reader.text()
        start = reader.at
        reader.skip(1)
        if key == b"info":
            if info is not None:
                raise ValueError("two info dictionaries")
            if data[start] != ord("d"):
                raise ValueError("info isn't a dictionary")
            info = data[start : reader.at]
    if reader.at + 1 != len(data):
        raise ValueError("trailing data")
    if info is None:
        raise ValueError("no info dictionary")
    return hashlib.sha1(info).hexdigest()


@F.pandas_udf(RESULT)
def _hashed(data: pd.Series) -> pd.DataFrame:
    out = []
    for d in data:
        try:
            out.append((info_hash(bytes(d)), None))
        except (ValueError, TypeError) as e:
            out.append((None, str(e)))
    return pd.DataFrame(out, columns=["info_hash", "error"])


def torrent_hashes(files: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """(path, info_hash, error) of files as read by ``binaryFile``; larger ones
    than ``limit`` are left out before their content is read."""
    small = files.where(F.col("length") <= limit)
    return small.select("path", _hashed("content").alias("h")).select("path", "h.*")
