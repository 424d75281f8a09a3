"""The best representative of each group of duplicate records.

``usable_claims`` reduces rows to what each says about each field, leaving out
stand-ins. A text or picture claimed for many different items is a shared false
value; the posterior of that, given for how many items a value is claimed,
decides (``stand_ins``). Two policies choose among the claims:

* ``survivors`` follows the order trust, recency, row id exactly;
* ``fused`` is Bayesian fusion with copy detection: source accuracies and the
  probability that one source copies another are estimated in turns from
  agreements on true and on false values; votes of copies are discounted, and
  the value of the largest posterior wins.

Claims of one group and field are one per source at most, so groups stay small
however many rows they have; sources are few, and only their accuracies and
pairs reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelloom.functions.text import strip_blanks
from reelloom.session import broadcast_small, materialize

FIELDS = ("synopsis", "poster", "rating", "tmdb_id")
ROUNDS = 12  # at most; the fusion stops once accuracies settle
SETTLED = 1e-3
FALSE_VALUES = 20  # assumed number of wrong values a field could have
COPY_RATE = 0.8  # assumed share of values that a copying source copies
COPY_PRIOR = 0.1

# Texts that stand for a missing one, in lower case, letters and digits only.
STAND_INS = [
    "tba", "tbd", "tbc", "n a", "na", "null", "none", "nil", "nan", "undefined", "unknown", "empty", "todo", "test", "x", "xxx",
    "no description", "no description yet", "no description available", "description not available", "description unavailable",
    "no synopsis", "no synopsis yet", "no synopsis available", "synopsis to follow", "synopsis not available", "synopsis unavailable",
    "no overview", "no overview yet", "no overview available", "overview not available", "overview to follow", "add an overview",
    "no plot", "no plot yet", "no plot available", "plot unknown", "plot to follow", "plot not available", "plot unavailable",
    "plot details unknown", "plot kept under wraps", "add a plot", "add plot", "add a synopsis", "add a description", "add description",
    "no summary", "no summary available", "no information", "no information available", "no info", "not available", "not yet available",
    "unavailable", "not specified", "coming soon", "to be announced", "to be added", "to be confirmed", "to be determined",
    "description coming soon", "synopsis coming soon", "placeholder", "lorem ipsum", "details to follow", "more to follow",
    "keine beschreibung", "keine beschreibung vorhanden", "keine beschreibung verfügbar", "beschreibung folgt", "folgt", "unbekannt",
    "pas de description", "aucune description", "aucune description disponible", "pas de résumé", "résumé à venir", "à venir", "inconnu",
    "sin descripción", "sin sinopsis", "sinopsis no disponible", "no disponible", "próximamente", "desconocido",
    "нет описания", "описание отсутствует", "описание появится позже", "скоро", "неизвестно",
]
KNOWN_PRIOR = 0.9  # that a text of a caller's list is a stand-in


def plain_text(text: Column) -> Column:
    """Text without tags and blank entities."""
    bare = F.regexp_replace(text, r"(?s)<[^<>]*>", " ")
    return strip_blanks(F.regexp_replace(bare, r"(?i)&(nbsp|#160|#xa0|ensp|emsp|thinsp|zwnj|zwj|shy|#8203);", " "))


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def says_something(words: Column, title: Column) -> Column:
    """Neither blank nor just the title (its year aside)."""
    year = r" \d{4}$"
    only_title = F.regexp_replace(words, year, "") == F.regexp_replace(_words(title), year, "")
    return F.coalesce((words != "") & ~F.coalesce(only_title, F.lit(False)), F.lit(False))


def picture_address(poster: Column) -> Column:
    """A path or web address of a picture."""
    return F.coalesce(strip_blanks(poster).rlike(r"(?i)^(https?:/)?/[^\s]*[^\s/]+$"), F.lit(False))


def usable_rating(rating: Column) -> Column:
    return F.coalesce((rating > 0) & (rating <= 10) & ~F.isnan(rating), F.lit(False))


def usable_tmdb_id(tmdb_id: Column) -> Column:
    return F.coalesce(strip_blanks(tmdb_id).rlike("^0*[1-9][0-9]*$"), F.lit(False))


def sharing_model(histogram: dict[int, int], groups: int) -> tuple[float, float, float]:
    """Prior odds of a stand-in, exponent and log normaliser of genuine values.

    ``histogram`` tells how many values are claimed for k of ``groups`` items.
    A genuine value is claimed for k items with a chance that falls as a power
    of k, a stand-in for any number alike on a log scale; both shares and the
    exponent follow by expectation and maximisation.
    """
    k = np.array(sorted(histogram) or [1], dtype=float)
    n = np.array([histogram[int(x)] for x in k] if histogram else [0], dtype=float)
    flat = -np.log(k) - math.log(math.log(max(groups, 2)) + 1)
    exponents = np.linspace(1.5, 12, 211)
    series = np.arange(1, 2001)[:, None] ** -exponents
    norms = np.log(series.sum(axis=0) + 2000.5 ** (1 - exponents) / (exponents - 1))
    exponent, norm, share = 4.0, math.log(1.0823), 0.01
    for _ in range(50):
        odds = math.log(share / (1 - share)) + flat + exponent * np.log(k) + norm
        shared = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        genuine = n * (1 - shared)
        likelihood = -exponents * (genuine * np.log(k)).sum() - norms * genuine.sum()
        best = int(np.argmax(likelihood))
        exponent, norm = float(exponents[best]), float(norms[best])
        share = float(np.clip((n * shared).sum() / max(1.0, n.sum()), 1e-9, 0.5))
    return math.log(share / (1 - share)), exponent, norm


def stand_ins(claims: DataFrame, value: str, known: list[str] | None = None) -> DataFrame:
    """(value, posterior) of the values of a column, as 128-bit hashes, that
    are likelier stand-ins than values of the items they are claimed for.

    ``claims`` has canonical_id and the column; null values count for nothing.
    ``known`` lists values thought stand-ins before any claim is seen.
    """
    spark = claims.sparkSession
    hashed = claims.where(F.col(value).isNotNull()).select("canonical_id", _hashed(F.col(value)).alias("value"))
    counted = materialize(hashed.distinct().groupBy("value").agg(F.count(F.lit(1)).alias("k")), "shared")
    histogram = {r[0]: r[1] for r in counted.groupBy("k").count().collect()}  # one row per count
    groups = claims.agg(F.approx_count_distinct("canonical_id")).first()[0]
    odds, exponent, norm = sharing_model(histogram, groups)
    listed = spark.createDataFrame([(v,) for v in known or []], "text string").select(_hashed(F.col("text")).alias("value"), F.lit(math.log(KNOWN_PRIOR / (1 - KNOWN_PRIOR))).alias("known"))
    logs = F.log(F.col("k").cast("double"))
    total = F.coalesce("known", F.lit(odds)) - logs - math.log(math.log(max(groups, 2)) + 1) + exponent * logs + norm
    return (
        counted.join(broadcast_small(listed), "value", "left")
        .select("value", (1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), total))))).alias("posterior"))
        .where("posterior > 0.5")
    )


def _hashed(value: Column) -> Column:
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))


def usable_claims(items: DataFrame, sources: DataFrame, known: list[str] | None = None) -> DataFrame:
    """What each row says: canonical_id, source, row_id, trust_rank, updated_at
    and, for every field, whether and what it says.

    Rows without canonical_id belong to no group. Unknown sources are trusted
    least. ``sources`` (key, trust_rank) has one row per source, a handful.
    ``known`` texts are thought stand-ins unless the claims say otherwise.
    """
    trust = sources.groupBy(F.col("key").alias("source")).agg(F.min("trust_rank").alias("trust_rank"))
    words = _words(plain_text(F.col("synopsis")))
    rows = items.where("canonical_id is not null").select(
        "canonical_id",
        "row_id",
        "source",
        "updated_at",
        F.when(says_something(words, F.col("title")), words).alias("synopsis"),
        F.when(picture_address(F.col("poster")), strip_blanks(F.col("poster"))).alias("poster"),
        F.when(usable_rating(F.col("rating")), F.round("rating", 1).cast("string")).alias("rating"),
        F.when(usable_tmdb_id(F.col("tmdb_id")), F.regexp_replace(strip_blanks(F.col("tmdb_id")), "^0+", "")).alias("tmdb_id"),
    )
    own = rows
    for field, listed in (("synopsis", known), ("poster", None)):
        shared = stand_ins(rows, field, listed).select(F.col("value").alias("hashed"), F.lit(True).alias("shared"))
        own = own.withColumn("hashed", _hashed(F.col(field))).join(broadcast_small(shared), "hashed", "left").withColumn(field, F.when(F.col("shared").isNull(), F.col(field))).drop("hashed", "shared")
    return own.join(broadcast_small(trust), "source", "left").select("canonical_id", "row_id", "source", "trust_rank", "updated_at", *FIELDS)


def survivors(items: DataFrame, sources: DataFrame, known: list[str] | None = None) -> DataFrame:
    """(canonical_id, field_name, row_id): who supplies each field of each
    group of two rows or more.

    Of rows with a usable value the smallest trust_rank wins (none last), then
    the latest updated_at (null last), then the smallest row_id. A field that
    no row can supply is absent. A repeated row counts as often as it occurs.
    """
    claims = usable_claims(items, sources, known)
    order = F.struct(
        F.coalesce("trust_rank", F.lit(2**31 - 1)).alias("rank"),
        F.col("updated_at").isNull().alias("undated"),
        (-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("age"),
        "row_id",
    )
    best = claims.groupBy("canonical_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(F.when(F.col(f).isNotNull(), order)).alias(f) for f in FIELDS]
    )
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f)["row_id"].alias("row_id")) for f in FIELDS])
    return (
        best.where("n >= 2")
        .select("canonical_id", F.explode(fields).alias("x"))
        .select("canonical_id", "x.field_name", "x.row_id")
        .where("row_id is not null")
    )


def _votes(claims: DataFrame) -> DataFrame:
    """(canonical_id, field, votes): one claim per source, its latest."""
    long = claims.select(
        "canonical_id",
        "source",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col("row_id"), F.col("updated_at").alias("at"))
                    for f in FIELDS
                ]
            )
        ).alias("c"),
    ).where("c.value is not null and source is not null")
    latest = long.groupBy("canonical_id", "c.field", "source").agg(
        F.max_by("c", F.struct("c.at", -F.col("c.row_id"))).alias("c")
    )
    return latest.groupBy("canonical_id", "field").agg(
        F.sort_array(F.collect_list(F.struct("source", F.col("c.value").alias("value"), F.col("c.row_id").alias("row_id")))).alias("votes")
    )


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    if not table:
        return F.lit(default)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def _posteriors(votes: DataFrame, accuracy: dict[str, float], copying: dict[str, float]) -> DataFrame:
    """Each vote with the posterior of its value.

    A vote's weight falls by the chance that it was copied from a more
    accurate source that says the same.
    """

    def weight(v: Column) -> Column:
        a = F.greatest(F.lit(0.01), F.least(F.lit(0.99), _lookup(accuracy, F.concat_ws("|", v["source"], F.col("field")), 0.8)))
        return F.log(FALSE_VALUES * a / (1 - a))

    ranked = F.transform(
        "votes", lambda v: F.struct((-weight(v)).alias("order"), v["source"].alias("source"), v["value"].alias("value"), v["row_id"].alias("row_id"))
    )
    rows = votes.withColumn("ranked", F.array_sort(ranked))
    own = lambda v: F.aggregate(
        F.filter("ranked", lambda u: (u["value"] == v["value"]) & ((u["order"] < v["order"]) | ((u["order"] == v["order"]) & (u["source"] < v["source"])))),
        F.lit(1.0),
        lambda total, u: total * (1 - COPY_RATE * _lookup(copying, F.concat_ws("|", F.least(u["source"], v["source"]), F.greatest(u["source"], v["source"])), 0.0)),
    )
    rows = rows.withColumn(
        "scored", F.transform("ranked", lambda v: F.struct(v["source"].alias("source"), v["value"].alias("value"), v["row_id"].alias("row_id"), (-v["order"] * own(v)).alias("vote")))
    )
    total = lambda v: F.aggregate(F.filter("scored", lambda u: u["value"] == v["value"]), F.lit(0.0), lambda t, u: t + u["vote"])
    rows = rows.withColumn(
        "scored", F.transform("scored", lambda v: F.struct(v["source"].alias("source"), v["value"].alias("value"), v["row_id"].alias("row_id"), total(v).alias("score")))
    )
    values = F.array_distinct(F.transform("scored", lambda v: F.struct(v["value"].alias("value"), v["score"].alias("score"))))
    rows = rows.withColumn("values", values).withColumn(
        "mass",
        F.aggregate("values", F.lit(0.0), lambda t, v: t + F.exp(v["score"])) + F.greatest(F.lit(0.0), F.lit(float(FALSE_VALUES + 1)) - F.size("values")),
    )
    return rows.select(
        "canonical_id",
        "field",
        F.transform("scored", lambda v: F.struct(v["source"].alias("source"), v["value"].alias("value"), v["row_id"].alias("row_id"), (F.exp(v["score"]) / F.col("mass")).alias("p"))).alias("votes"),
    )


def _accuracies(scored: DataFrame) -> dict[str, float]:
    rows = (
        scored.select("field", F.explode("votes").alias("v"))
        .groupBy("v.source", "field")
        .agg(F.avg("v.p").alias("a"))
        .collect()  # sources x fields
    )
    return {f"{r[0]}|{r[1]}": r[2] for r in rows}


def _copying(scored: DataFrame, accuracy: dict[str, float]) -> dict[str, float]:
    """Probability that the sources of a pair depend on each other.

    Independent sources may well agree on what is true, so agreements on the
    likeliest value don't count; they seldom make the same mistake, so shared
    less likely values speak for copying, and differences against it.
    """
    top = F.array_max(F.transform("votes", lambda v: v["p"]))
    pairs = scored.withColumn("top", top).select(
        F.explode(
            F.flatten(
                F.transform(
                    "votes",
                    lambda a: F.transform(
                        F.filter("votes", lambda b: a["source"] < b["source"]),
                        lambda b: F.struct(
                            F.concat_ws("|", a["source"], b["source"]).alias("pair"),
                            (a["value"] == b["value"]).alias("same"),
                            (a["p"] < F.col("top") - 0.05).alias("false"),
                        ),
                    ),
                )
            )
        ).alias("x")
    )
    counts = (
        pairs.groupBy("x.pair")
        .agg(F.count_if(F.col("x.same") & F.col("x.false")).alias("f"), F.count_if(~F.col("x.same")).alias("d"))
        .collect()  # pairs of sources
    )
    error = 1 - min(0.99, max(0.5, sum(accuracy.values()) / max(1, len(accuracy))))
    apart = 1 - (1 - error) ** 2 - error**2 / FALSE_VALUES
    alone_false, alone_apart = error**2 / FALSE_VALUES, apart
    copied_false = COPY_RATE * error + (1 - COPY_RATE) * alone_false
    copied_apart = (1 - COPY_RATE) * alone_apart
    share = lambda x, y: x / (x + y)
    gain = math.log(share(copied_false, copied_apart) / share(alone_false, alone_apart))
    loss = math.log(share(copied_apart, copied_false) / share(alone_apart, alone_false))
    out = {}
    for pair, same_false, differ in counts:
        odds = same_false * gain + differ * loss + math.log(COPY_PRIOR / (1 - COPY_PRIOR))
        out[pair] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return out


def fused(items: DataFrame, sources: DataFrame, known: list[str] | None = None) -> DataFrame:
    """(canonical_id, field_name, row_id, posterior): the value of the largest
    posterior for each field of each group; ties go to the smaller row_id."""
    votes = materialize(_votes(usable_claims(items, sources, known)), "votes")
    # A few sources; the better trusted start as the more accurate.
    ranks = {r[0]: r[1] for r in sources.where("trust_rank is not null").select("key", "trust_rank").collect()}
    accuracy = {f"{s}|{f}": max(0.6, 0.9 - 0.03 * r) for s, r in ranks.items() for f in FIELDS}
    copying: dict[str, float] = {}
    for _ in range(ROUNDS):
        scored = _posteriors(votes, accuracy, copying)
        before, accuracy = accuracy, _accuracies(scored)
        copying = _copying(scored, accuracy)
        if max((abs(a - before.get(k, 0.0)) for k, a in accuracy.items()), default=0.0) < SETTLED:
            break
    final = _posteriors(votes, accuracy, copying)
    best = F.array_max(F.transform("votes", lambda v: F.struct(v["p"].alias("p"), (-v["row_id"]).alias("row"))))
    return final.select(
        "canonical_id", F.col("field").alias("field_name"), (-best["row"]).alias("row_id"), F.round(best["p"], 6).alias("posterior")
    )
