"""What changed between consecutive full snapshots.

Keys fall into hash ranges, the leaves of a Merkle tree. Every generation has
a digest per leaf; digests of inner nodes combine those below. Trees of
consecutive generations are compared from the root down, and only rows of
leaves whose digests differ are compared row by row.

Size: the leaf table has one small row per leaf and generation and is an
eighth of the input's rows at most. All comparisons are joins or aggregates;
the driver learns only the list of generations and the row count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelloom.functions.hashing import null_safe_hash
from reelloom.session import materialize

LEVEL_BITS = 8
BROADCAST_LEAVES = 1 << 17


@dataclass
class SnapshotTable:
    """A table of full snapshots and how two versions of a row compare."""

    rows: DataFrame
    generation: str
    keys: list[str]
    exact: list[str]
    sets: list[str] = field(default_factory=list)
    near: dict[str, float] = field(default_factory=dict)

    def values(self) -> DataFrame:
        """Keys and compared values; sets are sorted, so order can't matter."""
        return self.rows.select(
            F.col(self.generation).alias("_generation"),
            *[F.col(k).alias(f"k_{i}") for i, k in enumerate(self.keys)],
            *[F.col(c).alias(f"e_{i}") for i, c in enumerate(self.exact)],
            *[F.array_sort(F.array_distinct(c)).alias(f"s_{i}") for i, c in enumerate(self.sets)],
            *[F.col(c).cast("double").alias(f"n_{i}") for i, c in enumerate(self.near)],
        )

    @property
    def key_columns(self) -> list[str]:
        return [f"k_{i}" for i in range(len(self.keys))]

    @property
    def value_columns(self) -> list[str]:
        kinds = (("e", self.exact), ("s", self.sets), ("n", list(self.near)))
        return [f"{letter}_{i}" for letter, columns in kinds for i in range(len(columns))]

    def digest_inputs(self) -> list[Column]:
        """Values within a tolerance mostly share a cell of that width; two
        values in one cell are always within it."""
        cells = [F.round(F.col(f"n_{i}") / tol) for i, tol in enumerate(self.near.values())]
        plain = [F.col(c) for c in self.key_columns + self.value_columns if not c.startswith("n_")]
        return plain + cells

    def differs(self, a: str, b: str) -> Column:
        tests = [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in self.value_columns if not c.startswith("n_")]
        for i, tol in enumerate(self.near.values()):
            x, y = F.col(f"{a}.n_{i}"), F.col(f"{b}.n_{i}")
            apart = F.coalesce(F.abs(x - y) >= tol, F.lit(True)) & ~(F.isnan(x) & F.isnan(y))
            tests.append(~x.eqNullSafe(y) & apart)
        return reduce(lambda p, q: p | q, tests, F.lit(False))


def generations_with_rows(*tables: SnapshotTable) -> tuple[list, list[int]]:
    """Generations that have rows in any table, in order, and each table's rows."""
    seen: set = set()
    counts = []
    for t in tables:
        found = t.rows.groupBy(F.col(t.generation)).count().collect()  # one row per generation
        seen |= {g for g, _ in found if g is not None}
        counts.append(sum(n for _, n in found))
    return sorted(seen), counts


def _differing(leaves: DataFrame, bits: int, last: int) -> DataFrame:
    """(leaf, ord): leaves whose digest differs from generation ``ord - 1``.

    Levels are visited from the root. Before a level is summed up, leaves below
    nodes that agree are dropped, so equal parts of two generations are looked
    at no further. Digests combine by exclusive or, so that of two generations
    together is zero where they agree.
    """
    both = F.array(F.struct(F.col("ord"), F.lit(1).alias("sign")), F.struct((F.col("ord") + 1).alias("ord"), F.lit(-1).alias("sign")))
    pairs = leaves.select("leaf", "d1", "d2", "n", F.explode(both).alias("p")).select("leaf", "p.ord", "d1", "d2", (F.col("n") * F.col("p.sign")).alias("n")).where(F.col("ord").between(1, last))
    below = pairs
    for depth in [*range(0, bits, LEVEL_BITS), bits]:
        node = F.shiftright("leaf", bits - depth)
        nodes = (
            below.groupBy(node.alias("node"), "ord")
            .agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum("n").alias("n"))
            .where("d1 <> 0 or d2 <> 0 or n <> 0")
            .select("node", "ord")
        )
        below = pairs.withColumn("node", node).join(nodes, ["node", "ord"], "left_semi").drop("node")
    return nodes.withColumnRenamed("node", "leaf")


def snapshot_changes(
    t: SnapshotTable, generations: list, row_count: int, rows_per_leaf: int = 8
) -> DataFrame:
    """Rows (generation, key columns, change_kind) between consecutive generations.

    ``change_kind`` is ``added``, ``removed`` or ``changed``; generation is the
    later one. Null keys are keys like any other. Rows repeated within one
    generation count once; where they disagree, the least by column order
    stands for the key. Rows without a generation belong to none. With fewer
    than two generations the result is empty. A digest has 128 bits, so an
    unseen change is about as likely as two equal random 128-bit numbers.
    """
    out = [F.col(f"k_{i}").alias(k) for i, k in enumerate(t.keys)]
    if len(generations) < 2:
        return t.values().where(F.lit(False)).select(F.col("_generation").alias("generation"), *out, F.lit("").alias("change_kind"))
    per_generation = max(1, row_count // len(generations))
    bits = max(1, math.ceil(math.log2(max(2, per_generation / rows_per_leaf))))
    order = F.create_map(*[F.lit(x) for pair in ((g, i) for i, g in enumerate(generations)) for x in pair])
    rows = (
        t.values()
        .where(F.col("_generation").isNotNull())
        .withColumn("ord", order[F.col("_generation")])
        .withColumn("leaf", F.shiftrightunsigned(null_safe_hash([F.col(c) for c in t.key_columns]), 64 - bits))
    )

    light = rows.select(
        "leaf", "ord", null_safe_hash(t.digest_inputs(), 1).alias("d1"), null_safe_hash(t.digest_inputs(), 2).alias("d2")
    )
    # Repeats of a row collapse before they move, so a key that holds a third of all rows moves a few.
    leaves = materialize(
        light.distinct()
        .groupBy("leaf", "ord")
        .agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.count(F.lit(1)).alias("n")),
        "leaves",
    )
    flagged = _differing(leaves, bits, len(generations) - 1).groupBy("leaf").agg(F.collect_set("ord").alias("pairs"))  # at most one per generation
    if 1 << bits <= BROADCAST_LEAVES and len(generations) <= 64:
        flagged = F.broadcast(flagged)

    suspects = (
        rows.join(flagged, "leaf")
        .withColumn("as_later", F.array_contains("pairs", F.col("ord")))
        .withColumn("as_earlier", F.array_contains("pairs", F.col("ord") + 1))
        .where("as_later or as_earlier")
    )
    once = suspects.groupBy(*t.key_columns, "ord").agg(
        F.min(F.struct(*t.value_columns)).alias("value"),
        F.first("as_later").alias("as_later"),
        F.first("as_earlier").alias("as_earlier"),
    )
    history = once.groupBy(*t.key_columns).agg(
        F.map_from_entries(F.collect_list(F.struct("ord", F.struct("ord", "as_later", "as_earlier", "value")))).alias("by_ord")
    )
    entries = (
        history.withColumn("e", F.explode(F.map_values("by_ord")))
        .withColumn("now", F.col("e.value"))
        .withColumn("before", F.try_element_at("by_ord", F.col("e.ord") - 1)["value"])
        .withColumn("later", F.try_element_at("by_ord", F.col("e.ord") + 1)["value"])
    )
    last = len(generations) - 1
    arriving = F.when(
        F.col("e.as_later") & (F.col("e.ord") > 0),
        F.when(F.col("before").isNull(), F.lit("added")).when(t.differs("now", "before"), F.lit("changed")),
    )
    leaving = F.when(F.col("e.as_earlier") & (F.col("e.ord") < last) & F.col("later").isNull(), F.lit("removed"))
    events = entries.withColumn(
        "event",
        F.explode(
            F.array(
                F.struct(F.col("e.ord").alias("ord"), arriving.alias("kind")),
                F.struct((F.col("e.ord") + 1).alias("ord"), leaving.alias("kind")),
            )
        ),
    ).where(F.col("event.kind").isNotNull())
    ids = F.array(*[F.lit(g) for g in generations])
    return events.select(ids[F.col("event.ord")].alias("generation"), *out, F.col("event.kind").alias("change_kind"))
