"""Keyed merges of a source into a target, with a rule per column.

A merge is a full outer join on the keys and one expression per column; the
result is a new version of the target, written elsewhere and swapped in by the
caller. Keys match null-safely. Both sides must have unique keys; ``latest``
makes them so.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def keep(old: Column, new: Column) -> Column:
    """The target's value unless it has none."""
    return F.coalesce(old, new)


def fill_text(old: Column, new: Column) -> Column:
    """The target's text unless it is null or empty."""
    return F.when(F.coalesce(old, F.lit("")) == "", new).otherwise(old)


def overwrite(old: Column, new: Column) -> Column:
    return new


def greatest(old: Column, new: Column) -> Column:
    """The larger of the values there are."""
    return F.greatest(old, new)


def merge_episodes(old: Column, new: Column) -> Column:
    """Season maps joined season by season; within one the newer episode wins."""
    none = F.create_map().cast("map<string,string>")
    joined = F.map_zip_with(
        old,
        new,
        lambda _, a, b: F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda _, x, y: F.coalesce(y, x)),
    )
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(joined)


def _joined(target: DataFrame, source: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    a = target.select(F.struct(*target.columns).alias("t"), *[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)])
    b = source.select(F.struct(*source.columns).alias("s"), *[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)])
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"_t{i}").eqNullSafe(F.col(f"_s{i}"))
    return a.join(b, on, how)


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    rules: dict[str, Rule],
    default: Rule = keep,
    only_if: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """The target after an upsert of ``source``.

    Rows of one side only are kept or inserted as they are. Where both have a
    key each column follows its rule; rows for which ``only_if`` isn't true
    stay as they were. Columns are those of the target, by name.
    """
    joined = _joined(target, source, keys, "full")
    t, s = F.col("t"), F.col("s")
    update = F.lit(True) if only_if is None else F.coalesce(only_if(t, s), F.lit(False))
    out = []
    for c in target.columns:
        if c in keys:
            value = F.when(t.isNull(), s[c]).otherwise(t[c])
        elif c in source.columns:
            ruled = rules.get(c, default)(t[c], s[c])
            value = F.when(t.isNull(), s[c]).when(s.isNull() | ~update, t[c]).otherwise(ruled)
        else:
            value = t[c]
        out.append(value.alias(c))
    return joined.select(*out)


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target with the source's rows whose key it lacks, one per key."""
    fresh = source.dropDuplicates(list(keys)).join(target.select(*keys).distinct(), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def unseen(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key the target lacks; repeats are kept."""
    return source.join(target.select(*keys).distinct(), list(keys), "left_anti")


def remove(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target without the rows whose key the source has."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_anti")


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``, which should be total.

    Ranking per key prunes within each task first (a window group limit), so
    one hot key costs a task its own rows only.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(window)).where("_row = 1").drop("_row")
