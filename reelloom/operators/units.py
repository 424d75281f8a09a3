"""Quantities recorded in different units, brought to bytes.

Each source's history of log values is cut into segments of constant level by
exact penalised changepoint search (optimal partitioning with pruning). A shift
between two levels that matches a ratio of known units marks a change of unit;
any other shift is one of the sizes themselves and is left alone. What unit a
run of segments has follows from the unit its source declares, from records of
the same thing at sources whose unit is known, or from its level.

Size: a source's history is first binned at quantiles of its own times, so
neither other sources nor stray times matter. The search runs over the bins'
count, sum and sum of squares. Bins beside a cut, and bins whose scatter leaves
room for a change inside, are split and the search repeated until no bin of
several times is left in doubt. Rows are only aggregated, never grouped into one
task; a task sees the bins of one source, and the driver whether any is in doubt.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelloom.functions.infohash import hash_of_delivery
from reelloom.functions.sizes import declared_factor, name_bytes, size_text_bytes
from reelloom.functions.text import non_blank
from reelloom.session import broadcast_small, materialize

BINS = 512  # of a source's history at first
PARTS = 512  # of bins in doubt, for each of a source's rounds
FEWEST = 5  # rows of a level; fewer can't be told from senseless sizes
# Bytes per unit.
FACTORS = [1, 1000, 1024, 1000**2, 1024**2, 1000**3, 1024**3, 1000**4, 1024**4]
RATIOS = sorted({abs(math.log(a / b)) for a in FACTORS for b in FACTORS if a >= 500 * b})
MEDIAN_OF_SQUARE = 0.455  # of a squared standard normal
TOLERANCE = math.log(2)  # of a level shift from a ratio of units
MOST_TOLERANCE = math.log(1000) / 4
LEVEL_TOLERANCE = math.log(1000) / 3  # of a run's level from that of known sources
FAR = 1 << 62
# A row of edges has up to BINS + PARTS times for each round.
BROADCAST_SOURCES = 1000


def changepoints(n: np.ndarray, total: np.ndarray, squares: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments that minimise within-segment squared error plus
    ``penalty`` per cut; exact, with pruning of starts that can't win again.

    ``n``, ``total``, ``squares`` are count, sum and sum of squares of
    consecutive bins. An empty history has no segment.
    """
    size = len(n)
    if not size:
        return []
    cn, cs, cq = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, total, squares))
    best = np.empty(size + 1)
    best[0] = -penalty
    origin = np.zeros(size + 1, dtype=np.int64)
    alive = np.array([0])
    for end in range(1, size + 1):
        dn, ds, dq = cn[end] - cn[alive], cs[end] - cs[alive], cq[end] - cq[alive]
        cost = best[alive] + dq - ds * ds / np.maximum(dn, 1)
        at = int(np.argmin(cost))
        best[end] = cost[at] + penalty
        origin[end] = alive[at]
        alive = np.append(alive[cost <= best[end]], end)
    starts, end = [], size
    while end > 0:
        end = int(origin[end])
        starts.append(end)
    return starts[::-1]


def _parts_of(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> tuple[list[int], np.ndarray, float]:
    """Starts of the segments, which bins are in doubt, and the rows' variance."""
    # Rows of one level scatter this much; neighbouring bins tell, and a few changes don't disturb the median.
    mean = total / n
    scatter = np.diff(mean) ** 2 / (1 / n[1:] + 1 / n[:-1])
    variance = max(0.05, float(np.median(scatter)) / MEDIAN_OF_SQUARE) if len(scatter) else 1.0
    penalty = 4 * variance * math.log(max(3.0, n.sum()))
    starts = changepoints(n, total, squares, penalty)
    inner = squares - total * total / n
    usual = np.median(inner[n > 1] / (n[n > 1] - 1)) if (n > 1).any() else variance
    doubt = inner - (n - 1) * usual > penalty
    cuts = np.array(starts[1:], dtype=np.int64)
    doubt[cuts] = True
    doubt[cuts - 1] = True
    return starts, doubt, variance


def _matches(shift: float, error: float) -> bool:
    """Whether a level shift is a ratio of units, up to the levels' own error."""
    slack = min(MOST_TOLERANCE, max(TOLERANCE, 3 * error))
    return min(abs(abs(shift) - r) for r in RATIOS) <= slack


def _runs(n: np.ndarray, level: np.ndarray, variance: float) -> np.ndarray:
    """The run of one unit each segment belongs to, by number.

    A shift is judged from the segment before and from the run's largest
    segment; segments of fewer than ``FEWEST`` rows belong to their run.
    """
    run = np.zeros(len(n), dtype=np.int64)
    largest = before = -1
    for i in range(len(n)):
        run[i] = run[i - 1] if i else 0
        if n[i] < FEWEST:
            continue
        if largest >= 0:
            error = lambda k: math.sqrt(variance * (1 / n[k] + 1 / n[i]))
            if any(_matches(level[i] - level[k], error(k)) for k in {before, largest}):
                run[i] += 1
                largest = i
        if largest < 0 or n[i] > n[largest]:
            largest = i
        before = i
    return run


BIN_SCHEMA = "source string, first_us bigint, last_us bigint, n bigint, segment int, run int, level double, split int"


def _searched(bins: pd.DataFrame) -> pd.DataFrame:
    """The bins of one source with their segment, its run and level, and into
    how many parts each is to be split."""
    bins = bins.sort_values("first_us", kind="stable")
    n, total, squares = (bins[c].to_numpy(float) for c in ("n", "total", "squares"))
    starts, doubt, variance = _parts_of(n, total, squares)
    segment = np.repeat(np.arange(len(starts)), np.diff([*starts, len(n)]))
    rows = np.bincount(segment, n)
    level = np.bincount(segment, total) / rows
    doubt &= (bins["last_us"] > bins["first_us"]).to_numpy()
    parts = max(2, PARTS // max(1, int(doubt.sum())))
    return pd.DataFrame(
        {
            "source": bins["source"],
            "first_us": bins["first_us"],
            "last_us": bins["last_us"],
            "n": bins["n"],
            "segment": segment.astype(np.int32),
            "run": _runs(rows, level, variance)[segment].astype(np.int32),
            "level": level[segment],
            "split": np.where(doubt, parts, 1).astype(np.int32),
        }
    )


def _place(edges: Column, at: Column, most: int) -> Column:
    """How many of the sorted ``edges`` are not after ``at``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(edges, p + s - 1) <= at, p + s).otherwise(p))


def history_segments(history: DataFrame) -> DataFrame:
    """Segments of every source: source, segment, run, start, n, level.

    ``history`` has source, us (bigint) and size; ``start`` is the time of the
    segment's first row. Rows without any of the three don't count.
    """
    timed = history.where(F.col("us").isNotNull() & F.col("source").isNotNull() & (F.col("size") > 0)).select(
        "source", "us", F.log(F.col("size").cast("double")).alias("x")
    )
    quantiles = F.percentile_approx("us", [k / BINS for k in range(BINS)], 10 * BINS)
    edges = materialize(timed.groupBy("source").agg(F.array_distinct(F.array_sort(quantiles)).alias("edges")), "edges")
    while True:
        most = edges.agg(F.max(F.size("edges"))).first()[0] or 1
        binned = timed.join(broadcast_small(edges, BROADCAST_SOURCES), "source").withColumn("bin", _place(F.col("edges"), F.col("us"), most))
        bins = binned.groupBy("source", "bin").agg(
            F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("x").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares")
        )
        found = materialize(bins.groupBy("source").applyInPandas(_searched, BIN_SCHEMA), "bins")
        if not found.where("split > 1").limit(1).count():
            break
        width = (F.col("last_us") - F.col("first_us")) / F.col("split")
        cut = F.transform(F.sequence(F.lit(0), F.col("split") - 1), lambda k: F.col("first_us") + F.ceil(k * width).cast("bigint"))
        # The time after a bin in doubt is an edge too, so a bin of one time stays alone.
        inside = F.when(F.col("split") > 1, F.concat(cut, F.array("last_us"))).otherwise(F.array("first_us"))
        edges = materialize(found.groupBy("source").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(inside)))).alias("edges")), "edges")
    return found.groupBy("source", "segment").agg(
        F.min("run").alias("run"), F.min("first_us").alias("start"), F.sum("n").alias("n"), F.first("level").alias("level")
    )


def _unit_runs(segments: DataFrame) -> DataFrame:
    """source, run, start, stop, n, level, levels, runs: stretches of one unit,
    the level of their largest segment and those of all."""
    by_source = Window.partitionBy("source")
    return (
        segments.groupBy("source", "run")
        .agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.max_by("level", F.struct("n", -F.col("segment"))).alias("level"), F.collect_list("level").alias("levels"))
        .withColumn("stop", F.coalesce(F.lead("start").over(by_source.orderBy("run")), F.lit(FAR)))
        .withColumn("start", F.when(F.lag("run").over(by_source.orderBy("run")).isNull(), F.lit(-FAR)).otherwise(F.col("start")))
        .withColumn("runs", F.count(F.lit(1)).over(by_source))
    )


def unit_factors(records: DataFrame, declared: DataFrame) -> DataFrame:
    """Bytes per unit of each run of each source: source, run, start, stop,
    level, factor.

    ``records``: source, us, size, info_hash; ``declared``: source, factor.
    A source of one run has the unit it declares. Otherwise, and where no unit
    is declared, the factor is the one under which most of the run's records
    agree with records of the same hash at sources of a declared single unit,
    among those that bring a level of the run nearest to theirs; without such
    records the nearest, a declared unit of the same size first. A level that
    no factor brings within ``LEVEL_TOLERANCE`` and no record confirms has no
    factor. Without any declared source the largest level is taken for bytes.
    """
    runs = materialize(_unit_runs(history_segments(records)).join(broadcast_small(declared.withColumnRenamed("factor", "stated")), "source", "left"), "runs")
    single = (F.col("runs") == 1) & F.col("stated").isNotNull()
    known = runs.where(single).withColumn("factor", F.col("stated").cast("bigint"))
    open_ = runs.where(~single)
    weighted = F.sum(F.col("n") * (F.col("level") + F.log(F.col("factor").cast("double")))) / F.sum("n")
    usual = known.agg(weighted).first()[0]
    if usual is None:
        usual = open_.agg(F.max("level")).first()[0] or 0.0
    sized = records.where((F.col("size") > 0) & F.col("info_hash").isNotNull())
    truth = (
        sized.join(broadcast_small(known.select("source", "factor")), "source")
        .groupBy("info_hash")
        .agg(F.min(F.struct("factor", (F.col("size") * F.col("factor")).alias("bytes"))).alias("t"))
    )
    probes = (
        sized.join(broadcast_small(open_.select("source", "run", "start", "stop")), "source")
        .where("us >= start and us < stop")
        .select("info_hash", "source", "run", "size")
        .distinct()
    )
    agrees = [
        F.count_if(F.abs(F.col("size") * F.lit(f).cast("double") - F.col("t.bytes")) <= (F.lit(f) + F.col("t.factor")) * 0.5 + 0.5)
        for f in FACTORS
    ]
    votes = probes.join(truth, "info_hash").groupBy("source", "run").agg(F.array(*agrees).alias("votes"), F.count(F.lit(1)).alias("asked"))
    nearest = lambda goal: F.array_min(F.transform("levels", lambda x: F.abs(x - F.lit(goal))))
    apart = F.array(*[nearest(usual - math.log(f)) for f in FACTORS])
    # A wide unit's slack swallows small differences, so only factors of the level's size compete.
    ranked = F.array(
        *[
            F.when(
                F.col("apart")[i] < F.array_min("apart") + math.log(1.2),
                F.struct(
                    F.coalesce(F.col("votes")[i], F.lit(0)).alias("votes"), F.coalesce(F.col("stated") == f, F.lit(False)).alias("stated_"), (-F.col("apart")[i]).alias("near"), F.lit(f).cast("bigint").alias("factor")
                ),
            )
            for i, f in enumerate(FACTORS)
        ]
    )
    confirmed = (F.col("best.votes") >= 3) & (F.col("best.votes") * 2 >= F.col("asked"))
    near = -F.col("best.near") <= LEVEL_TOLERANCE
    learned = (
        open_.join(votes, ["source", "run"], "left")
        .withColumn("apart", apart)
        .withColumn("best", F.array_max(ranked))
        .withColumn("factor", F.when(near | F.coalesce(confirmed, F.lit(False)), F.col("best.factor")))
    )
    columns = ["source", "run", "start", "stop", "level", "factor"]
    return known.select(*columns).unionByName(learned.select(*columns))


def _cleaned(records: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records with a source, their history, and the declared units."""
    rows = records.select(
        "record_id",
        non_blank(F.col("source")).alias("source"),
        F.col("size").cast("bigint").alias("size"),
        "size_text",
        "name",
        "info_hash",
        F.unix_micros(F.col("observed_at").cast("timestamp")).alias("us"),
    ).where("source is not null")
    declared = sources.select(non_blank(F.col("key")).alias("source"), declared_factor(F.col("size_unit")).alias("factor"))
    declared = declared.where("source is not null").groupBy("source").agg(F.min("factor").alias("factor"))
    hashed = F.unhex(hash_of_delivery(F.col("info_hash"))).alias("info_hash")
    # Read in every round of the search, so written once, in binary.
    history = materialize(rows.where("size > 0").select("source", "us", "size", hashed), "history")
    return rows, history, declared


def level_shifts(records: DataFrame, sources: DataFrame) -> DataFrame:
    """What the search found: source, segment, n, level, its shift from the
    segment before, and whether that changes the unit or only the sizes."""
    _, history, _ = _cleaned(records, sources)
    order = Window.partitionBy("source").orderBy("segment")
    segments = history_segments(history)
    shift = F.col("level") - F.lag("level").over(order)
    return segments.select("source", "segment", "n", "level", shift.alias("shift"), F.coalesce(F.col("run") > F.lag("run").over(order), F.lit(False)).alias("unit_change"))


def sizes_in_bytes(records: DataFrame, sources: DataFrame) -> DataFrame:
    """record_id, size_bytes and whether ``size`` holds those bytes already.

    A positive ``size`` comes first, in the unit of its source's run; then,
    also where that unit can't be known, the size stated by size_text, then by
    name. Rows without a source, and rows whose size can't be known, are
    absent. A row without a time belongs to the run of its source whose level
    its size is nearest to; a source without any time has the unit it declares.
    ``records`` may have further columns; repeated rows give repeated results.
    """
    rows, history, declared = _cleaned(records, sources)
    units = materialize(unit_factors(history, declared), "units")
    # A few runs per source.
    by_source = units.groupBy("source").agg(F.collect_list(F.struct("start", "stop", "level", "factor")).alias("units"))
    by_source = by_source.join(broadcast_small(declared.withColumnRenamed("factor", "stated")), "source", "full")
    x = F.log(F.col("size").cast("double"))
    timed = F.filter("units", lambda u: (F.col("us") >= u["start"]) & (F.col("us") < u["stop"]))[0]["factor"]
    likely = F.array_min(F.transform("units", lambda u: F.struct(F.abs(x - u["level"]), u["factor"].alias("factor"))))["factor"]
    factor = F.when(F.col("units").isNull(), F.col("stated").cast("bigint")).when(F.col("us").isNotNull(), timed).otherwise(likely)
    positive = (F.col("size") > 0) & F.col("factor").isNotNull()
    stated = size_text_bytes(F.col("size_text"))
    value = F.when(positive, (F.col("size").cast("decimal(19,0)") * F.col("factor")).try_cast("bigint")).otherwise(
        F.coalesce(stated, name_bytes(F.col("name")))
    )
    return (
        rows.join(broadcast_small(by_source), "source", "left")
        .withColumn("factor", factor)
        .select("record_id", value.alias("size_bytes"), F.coalesce(positive & (F.col("factor") == 1), F.lit(False)).alias("stands"))
        .where("size_bytes > 0")
    )
