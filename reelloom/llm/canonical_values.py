"""Free-entered values mapped to the entries of a reference list.

Distinct values are normalised, candidates come from an inverted index of
character n-grams over the entries and their known other names, and the
weighted cosine of the n-grams scores them. The n-grams are letters, pairs of
letters up to one apart, and the whole with and without each of its letters.

A value is mapped if its cosine reaches the threshold of a name and leads the
next entry by a margin; all else means none of the entries. A name's threshold
is learned: the lowest cosine that one slip of the keyboard in the name leaves.
Nothing but cosines accepts or rejects a value.

Size: only distinct values enter, however often they occur. Of a name, the
index holds its rarest n-grams only: so many that a value which shares none of
them can't reach the threshold.
"""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelloom.functions.text import let
from reelloom.session import broadcast_small, materialize

MARGIN = 0.02
SLIP_LENGTH = 4  # shorter names must match exactly
OTHER_SLIP_LENGTH = 6  # other names, which are less certain, from here on
OTHER_CERTAINTY = 0.9  # of a score for another name
WHOLE_WEIGHT = 1.5  # of the whole and its parts, against letters and pairs
EQUAL = 1 - 1e-9
ANY_LETTER = "\x01"  # stands for a letter that no name has beside the others


def _unmarked() -> tuple[str, str]:
    """Lower-case letters with marks and the plain letters they stand for."""
    marked, plain = "øłđй", "oldи"
    for code in [*range(0xDF, 0x250), 0x451]:
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base != chr(code) and base.isalpha():
            marked, plain = marked + chr(code), plain + base
    return marked, plain


MARKED, PLAIN = _unmarked()
# Digits typed for the letters they look like.
LOOKALIKES = ("013457", "oieast")


def normalised(value: Column) -> Column:
    """Lower case without marks, invisible characters, decoration around the
    value and anything but letters and digits."""
    text = F.translate(F.lower(value), MARKED, PLAIN)
    text = F.regexp_replace(text, r"\p{M}|[­​-‍⁠﻿]", "")
    text = F.regexp_replace(text, r"^\W*(genres?|categor(y|ie)|tags?)\s*[:=]\s*", "")
    text = F.regexp_replace(text, r"\s*+[(\[][^()\[\]]++[)\]]\W*+$", "")
    text = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    text = F.regexp_replace(text, r"(?<=[\p{L}\d] ?)\s+(series|serie|film|films|movies?)$", "")
    swap = lambda t: F.translate(t, *LOOKALIKES)
    letters = lambda t: F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    digits = lambda t: F.length(F.regexp_replace(t, r"[^\d]", ""))
    text = let(text, lambda t: F.when((digits(t) > 0) & (letters(t) > digits(t)) & ~t.rlike(r"(^|\s)\d|\d(\s|$)(?<!0)"), swap(t)).otherwise(t))
    return F.regexp_replace(text, r"\s+", "")


def grams(text: Column, longest: Column | None = None) -> Column:
    """Distinct n-grams: 1 letters, 2 pairs, ends marked, 0 the whole and what
    is left of it without one letter. A text above ``longest`` has no 0."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    sub = lambda t, i, k: F.substring(t, i, F.lit(k))
    each = lambda n, piece: F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), piece)).otherwise(F.array().cast("array<string>"))

    def cut(t: Column) -> Column:
        n = F.length(t)
        return F.concat(
            each(n - 2, lambda i: F.concat(F.lit("1"), sub(t, i + 1, 1))),
            each(n - 1, lambda i: F.concat(F.lit("2"), sub(t, i, 2))),
            each(n - 2, lambda i: F.concat(F.lit("2"), sub(t, i, 1), sub(t, i + 2, 1))),
        )

    parts = F.concat(F.array(F.concat(F.lit("0"), text)), each(F.length(text), lambda i: F.concat(F.lit("0"), _without(text, i))))
    if longest is not None:
        parts = F.when(F.length(text) <= longest, parts).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(let(marked, cut), parts))


def _without(text: Column, i: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))


def slipped(text: Column) -> Column:
    """The text with a letter lost, exchanged, added or swapped with the next.

    ``ANY_LETTER`` stands for the letter typed, as its n-grams are the rarest."""
    n = F.length(text)
    head = lambda i: F.substring(text, F.lit(1), i - 1)
    tail = lambda i: F.substring(text, i, n)
    letter = F.lit(ANY_LETTER)
    at = lambda last, piece: F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), piece)).otherwise(F.array().cast("array<string>"))
    swap = lambda i: F.concat(head(i), F.substring(text, i + 1, F.lit(1)), F.substring(text, i, F.lit(1)), tail(i + 2))
    made = F.concat(
        at(n, lambda i: _without(text, i)),
        at(n, lambda i: F.concat(head(i), letter, tail(i + 1))),
        at(n + 1, lambda i: F.concat(head(i), letter, tail(i))),
        at(n - 1, swap),
    )
    return F.array_distinct(F.filter(made, lambda v: v != text))


def _weighted(texts: DataFrame, text: str, weights: DataFrame, rarest: float, longest: int | None = None) -> DataFrame:
    """``texts`` by n-gram, with its weight; one that no name has is as rare as any."""
    listed = texts.withColumn("gram", F.explode(grams(F.col(text), None if longest is None else F.lit(longest))))
    kind = F.when(F.col("gram").startswith("0"), WHOLE_WEIGHT).otherwise(1.0)
    return listed.join(broadcast_small(weights), "gram", "left").withColumn("w", kind * F.coalesce("rarity", F.lit(rarest)))


def _thresholds(names: DataFrame, index: DataFrame, weights: DataFrame, rarest: float) -> DataFrame:
    """id, called, least: the cosine a value must reach for each name."""
    long_enough = F.length("called") >= F.when(F.col("main"), SLIP_LENGTH).otherwise(OTHER_SLIP_LENGTH)
    typed = names.where(long_enough).select("id", "called", F.explode(slipped(F.col("called"))).alias("typed"))
    own = index.select("id", "called", "gram", F.col("w").alias("own"), "norm")
    cosines = (
        _weighted(typed, "typed", weights, rarest)
        .join(broadcast_small(own), ["id", "called", "gram"], "left")
        .groupBy("id", "called", "typed")
        .agg((F.sum(F.coalesce(F.col("w") * F.col("own"), F.lit(0.0))) / (F.max("norm") * F.sqrt(F.sum(F.col("w") * F.col("w"))))).alias("cosine"))
    )
    lowest = cosines.groupBy("id", "called").agg((F.min("cosine") - 1e-9).alias("least"))
    return names.join(lowest, ["id", "called"], "left").select("id", "called", F.coalesce("least", F.lit(EQUAL)).alias("least"))


def _index(reference: DataFrame, other_names: DataFrame | None) -> tuple[DataFrame, DataFrame, float]:
    """The names with their n-grams, weights, norm and threshold, the n-grams'
    rarity, and that of an n-gram no name has."""
    names = reference.select("id", F.col("name").alias("called"), F.lit(True).alias("main"))
    if other_names is not None:
        names = names.unionByName(reference.join(other_names, "name").select("id", F.col("other").alias("called"), F.lit(False).alias("main")))
    names = names.withColumn("called", normalised(F.col("called"))).where("called <> '' and id is not null").groupBy("id", "called").agg(F.max("main").alias("main"))
    names = materialize(names, "names")
    total = names.count() + 1.0
    rarest = math.log(total) + 0.2
    listed = names.withColumn("gram", F.explode(grams(F.col("called"))))
    weights = materialize(listed.groupBy("gram").agg((F.log(F.lit(total)) - F.log(F.count(F.lit(1)).cast("double")) + 0.2).alias("rarity")), "rarity")
    index = _weighted(names, "called", weights, rarest)
    norms = index.groupBy("id", "called").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    index = index.drop("rarity").join(norms, ["id", "called"])
    return materialize(index.join(_thresholds(names, index, weights, rarest), ["id", "called"]), "index"), weights, rarest


def map_values(values: DataFrame, reference: DataFrame, other_names: DataFrame | None = None) -> DataFrame:
    """(value, id, score) for each distinct ``value``; id is '' where none is meant.

    ``reference`` has id and name; ``other_names`` (name, other) gives further
    names of its entries. Null values are left out; blank ones mean none. If
    two entries are equally near, none is chosen. The score is the cosine, less
    for another name.
    """
    index, weights, rarest = _index(reference, other_names)
    limits = index.agg(F.max(F.length("called")), F.max(F.col("norm") / F.col("least"))).first()
    longest = (limits[0] or 0) + 1
    # Each letter of a text above ``longest`` adds an n-gram no name has; so long a text has no cosine that is enough.
    alone = (WHOLE_WEIGHT * rarest) ** 2
    most = max(longest, int((limits[1] or 0.0) ** 2 / alone) + 1)
    # The rest of a name's n-grams, the most common ones, can't make up its threshold alone.
    ranks = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("order"), "gram")))
    by_name = index.groupBy("id", "called", "main", "norm", "least").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("has"), ranks.alias("ranked"))
    left = F.aggregate(
        "ranked",
        F.struct(F.col("norm") * F.col("norm") * (1 + 1e-9), F.array().cast("array<string>")).cast("struct<rest:double,kept:array<string>>"),
        lambda t, g: F.struct(
            (t["rest"] - g["order"] * g["order"]).alias("rest"),
            F.when(t["rest"] >= F.pow(F.col("least") * F.col("norm"), F.lit(2)), F.concat(t["kept"], F.array(g["gram"]))).otherwise(t["kept"]).alias("kept"),
        ),
    )["kept"]
    named = materialize(by_name.withColumn("kept", left).drop("ranked"), "named")
    rare = named.select("id", "called", F.explode("kept").alias("gram"))

    distinct = values.select("value").where("value is not null").distinct().withColumn("plain", normalised(F.col("value")))
    distinct = materialize(distinct, "distinct")
    plains = distinct.select("plain").where((F.col("plain") != "") & (F.length("plain") <= most)).distinct()
    asked = _weighted(plains, "plain", weights, rarest, longest)
    unlisted = F.when(F.length("plain") > longest, (F.length("plain") + 1) * alone).otherwise(0.0)
    lengths = asked.groupBy("plain").agg(
        F.collect_list(F.when(F.col("rarity").isNotNull(), F.struct("gram", "w"))).alias("says"), F.sum(F.col("w") * F.col("w")).alias("squares")
    ).withColumn("length", F.sqrt(F.col("squares") + unlisted))
    candidates = asked.where("rarity is not null").select("plain", "gram").join(rare, "gram").select("plain", "id", "called").distinct()
    dot = F.aggregate("says", F.lit(0.0), lambda t, g: t + F.coalesce(F.try_element_at("has", g["gram"]) * g["w"], F.lit(0.0)))
    scored = (
        candidates.join(named.drop("kept"), ["id", "called"])
        .join(lengths, "plain")
        .withColumn("cosine", dot / (F.col("norm") * F.col("length")))
        .where("cosine >= least")
        .withColumn("score", F.least(F.lit(1.0), F.col("cosine")) * F.when(F.col("main"), 1.0).otherwise(OTHER_CERTAINTY))
    )
    by_id = scored.groupBy("plain", "id").agg(F.max("score").alias("score"))
    best = by_id.groupBy("plain").agg(
        F.max_by("id", F.struct("score", "id")).alias("id"), F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("scores")
    )
    clear = F.coalesce(F.col("scores")[0] - F.try_element_at("scores", F.lit(2)) >= MARGIN, F.lit(True))
    chosen = best.where(clear).select("plain", "id", F.col("scores")[0].alias("score"))
    return (
        distinct.join(chosen, "plain", "left")
        .select("value", F.coalesce("id", F.lit("")).alias("id"), F.coalesce("score", F.lit(0.0)).alias("score"))
    )


def map_item_values(items: DataFrame, keys: list[str], column: str, reference: DataFrame, other_names: DataFrame | None) -> DataFrame:
    """``keys``, genre_value and collection_id: one row for each distinct value
    of the array ``column`` of an item that isn't exactly a name."""
    listed = items.select(*keys, F.explode(column).alias("value")).where("value is not null").distinct()
    free = listed.join(broadcast_small(reference.select(F.col("name").alias("value"))), "value", "left_anti")
    mapped = map_values(free, reference, other_names)
    return free.join(mapped, "value").select(*keys, F.col("value").alias("genre_value"), F.col("id").alias("collection_id"))
