"""The N best items of every group, with one tie rule.

Secondary sort: rows are hash-partitioned by group and sorted within each
partition by score and identifier; sorted Arrow batches stream through a
function that emits the first N distinct items of each group and holds no more
than those of the group at hand.

Before the shuffle the same function runs over each input partition, so a
group of any size sends N rows per input partition to its reducer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """True where a row's value differs from the row before; null equals null."""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.fill_null(pc.not_equal(now, before), False)
    nulls = pc.not_equal(pc.is_null(now), pc.is_null(before))
    return np.concatenate([[True], pc.or_(differs, nulls).to_numpy()])


def first_n_of_sorted(batches: Iterator[pa.RecordBatch], groups: list[str], item: str, n: int) -> Iterator[pa.RecordBatch]:
    """The first ``n`` rows of distinct ``item`` of each run of equal groups."""
    carry: pa.Table | None = None  # rows already emitted for the last group
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        done = carry.num_rows if carry is not None else 0
        if done:
            table = pa.concat_tables([carry, table])
        starts = np.zeros(table.num_rows, dtype=bool)
        for g in groups:
            starts |= _changes(table[g])
        group = np.cumsum(starts) - 1
        codes = table[item].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = group * (table.num_rows + 1) + codes + 1
        fresh = np.sort(np.unique(pairs, return_index=True)[1])
        heads = np.searchsorted(group[fresh], np.arange(group[-1] + 1))
        rank = np.arange(len(fresh)) - heads[group[fresh]]
        taken = fresh[rank < n]
        carry = table.take(pa.array(taken[group[taken] == group[-1]]))
        out = taken[taken >= done]
        if len(out):
            yield from table.take(pa.array(out)).combine_chunks().to_batches()


def top_n(df: DataFrame, groups: list[str], score: str, item: str, n: int) -> DataFrame:
    """Rows of the ``n`` highest scores of each group.

    A null in a group column is a group of its own. An item repeated in a
    group counts once, with its highest score; null scores come last; ties go
    to the smaller item; a null item counts as one item, before all others.
    All columns of ``df`` are kept, whatever their names. Empty tables, and
    ``n`` below one, give no rows.
    """
    if n < 1:
        return df.limit(0)
    schema = df.schema
    inner = df.toDF(*[f"c{i}" for i in range(len(schema))])
    name = {c: f"c{schema.names.index(c)}" for c in [*groups, score, item]}
    keys = [name[g] for g in groups]
    order = [*keys, F.col(name[score]).desc_nulls_last(), F.col(name[item]).asc_nulls_first()]
    item_name = name[item]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return first_n_of_sorted(batches, keys, item_name, n)

    near = inner.sortWithinPartitions(*order).mapInArrow(stream, inner.schema)
    best = near.repartition(*keys).sortWithinPartitions(*order).mapInArrow(stream, inner.schema)
    return best.toDF(*schema.names)
