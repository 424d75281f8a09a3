"""Null-safe row hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_safe_hash(columns: list[Column], salt: int = 0) -> Column:
    """64-bit hash in which a null is a value of its own.

    ``xxhash64`` alone skips nulls, so ``(null, 'a')`` and ``('a', null)``
    would agree; the null flags keep them apart.
    """
    parts: list[Column] = [F.lit(salt)]
    for column in columns:
        parts += [column.isNull(), column]
    return F.xxhash64(*parts)


def bucket_of(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets)).cast("int")
