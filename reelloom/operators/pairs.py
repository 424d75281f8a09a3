"""Pairs of keys that share a value of one of several columns, each pair once.

An equality join puts all rows of a value into one partition: few values leave
most tasks idle, and a hot value keeps one task as long as all its pairs take.
Here the keys of a value are packed into blocks, the blocks are joined and
dealt out, and only then opened into pairs. A pair that would come up several
times is kept where it comes up first, so no pair is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows in a block, about; two blocks are opened in one task.
BLOCK = 1000
# Pairs of a task, about.
TASK_PAIRS = 1 << 23


def whole(value: Column) -> Column:
    """The floor of ``value`` as a double. From 2^53 on doubles are whole; they,
    infinities and NaN stay as they are, where ``floor`` would give a bigint."""
    return F.when(F.abs(value) < 2.0**53, F.floor(value).cast("double")).otherwise(value)


def _keyed(df: DataFrame, key: str, shared: list[Column]) -> DataFrame:
    """One row for each key, with the set of its values of each column."""
    # collect_set keeps each NaN.
    sets = [F.array_distinct(F.collect_set(c)).alias(f"v{i}") for i, c in enumerate(shared)]
    return df.groupBy(F.col(key).alias("key")).agg(*sets)


def _blocks(keyed: DataFrame, sizes: DataFrame, side: str, i: int) -> DataFrame:
    """The keys of each value of column ``i``, in blocks. Where a pair may come
    up elsewhere, its sets go along: if a key has several values, or if other
    columns come before."""
    several = F.when(F.size(f"v{i}") > 1, F.col(f"v{i}")).alias("several")
    row = F.struct("key", *[f"v{j}" for j in range(i)], several)
    rows = keyed.select(F.explode(f"v{i}").alias("value"), row.alias("row")).join(sizes, "value")
    block = F.pmod(F.xxhash64("row.key"), F.ceil(F.col("rows") / BLOCK)).alias(f"{side}_block")
    blocks = rows.groupBy("value", block).agg(F.collect_list("row").alias("held"), (F.bool_and(F.isnull("row.several")) & F.lit(not i)).alias("lone"))
    return blocks.select("value", f"{side}_block", F.col("held.key").alias(f"{side}_keys"), F.when(~F.col("lone"), F.col("held")).alias(f"{side}_held"))


def _opened(left: DataFrame, right: DataFrame, tasks: int, i: int) -> DataFrame:
    """The pairs of two sides' blocks that share no value before."""
    met = left.join(right, "value").repartition(tasks, "value", "left_block", "right_block")
    outer = met.select("*", F.posexplode("left_keys").alias("l", "left"))
    pairs = outer.select("*", F.posexplode("right_keys").alias("r", "right"))
    a, b = F.col("left_held")[F.col("l")], F.col("right_held")[F.col("r")]
    first = a["several"].isNull() | b["several"].isNull() | (F.col("value") == F.array_min(F.array_intersect(a["several"], b["several"])))
    for j in range(i):
        first = first & ~F.arrays_overlap(a[f"v{j}"], b[f"v{j}"])
    # A key with one value can share no other.
    alone = F.isnull("left_held") | F.isnull("right_held")
    return pairs.where((alone | first) if not i else first).select("left", "right")


def sharing_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, shared: list[tuple[Column, Column]]) -> DataFrame:
    """The pairs of ``left_key`` and ``right_key`` with rows that are equal in
    one of ``shared``, columns of ``left`` and ``right``.

    A key may have any number of rows, and may be null; null values are equal
    to none.
    """
    sizes = [[df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("rows")) for df, c in zip((left, right), cs)] for cs in shared]
    met = [a.join(b.withColumnRenamed("rows", "others"), "value").agg(F.lit(i).alias("i"), F.sum(F.col("rows") * F.col("others")).alias("n")) for i, (a, b) in enumerate(sizes)]
    pairs = {r.i: r.n or 0 for r in reduce(DataFrame.unionByName, met).collect()}
    keyed = [_keyed(left, left_key, [a for a, _ in shared]), _keyed(right, right_key, [b for _, b in shared])]
    found = []
    for i, (a, b) in enumerate(sizes):
        blocks = _blocks(keyed[0], a, "left", i), _blocks(keyed[1], b, "right", i)
        found.append(_opened(*blocks, 1 + pairs[i] // TASK_PAIRS, i))
    return reduce(DataFrame.unionByName, found).toDF(left_key, right_key)
