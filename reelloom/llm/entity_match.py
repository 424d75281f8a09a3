"""Records matched to the works they release, without a shared key.

Both sides become title forms (``titles``). Random walks over the graph of
forms, their words and character n-grams train skip-gram vectors of the
n-grams; a text's vector is the weighted sum of its n-grams'. Several tables
of random hyperplanes over the vectors of the whole title, of its name words
and of their halves put forms into buckets; forms of one bucket, sequel number
and word count are compared letter by letter, which accepts or rejects a pair;
of the accepted ones the largest exact cosine ranks first. Cosines become
confidences by a logistic curve fitted on planted slips in titles, against
other titles of the same buckets.

Size: the vectors have a fixed number of rows and are fitted on about
``FIT_FORMS`` forms; every form of either side is hashed, with the same planes
at every size. Buckets of many works are split without loss. Only distinct forms
meet, records join the result by form, and decisions need a few numbers per
form, kind and year.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelloom.llm.titles import MOST_SLIPS, parse_release, title_distance, work_forms
from reelloom.session import broadcast_small, materialize

TOKENS = 1 << 14
WORD_NODES = 1 << 12
DIMENSIONS = 32
FIT_FORMS = 20_000
WALKS, STEPS = 60_000, 6
MOST_NORM = 4.0
# Tables of hyperplanes by part: (part, tables, planes of each).
TABLES = (("title", 4, 18), ("name", 1, 24), ("head", 1, 24), ("tail", 1, 24))
# For ``Vectors.sized_for`` only.
BASE_WORKS = 100_000
MOST_PLANES = 24
FREQUENT = 0.002  # a word in a larger share of the forms names no work
PLANTED = 4_000  # titles with planted slips, for the calibration
BIG_BUCKET = 256  # a bucket of more works is split by what a slip changes by one at most
SPLIT = 3  # values in a part of a split bucket


def _ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token, text) of the pairs, spaced pairs and triples of characters."""
    joined = "".join(f"\x02{t}\x03" for t in texts).encode("utf-8", "replace")
    data = np.frombuffer(joined, dtype=np.uint8).astype(np.uint64)
    lengths = np.array([len(t.encode("utf-8", "replace")) + 2 for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    tokens, owners = [], []
    for salt, offsets in ((1, (0, 1)), (2, (0, 2)), (3, (0, 1, 2))):
        n = len(data) - offsets[-1]
        if n <= 0:
            continue
        inside = owner[:n] == owner[offsets[-1] :]
        code = np.full(n, salt, dtype=np.uint64)
        for o in offsets:
            code = code * np.uint64(0x100000001B3) ^ data[o : o + n]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TOKENS.bit_length() + 1)
        tokens.append(code[inside].astype(np.int64))
        owners.append(owner[:n][inside])
    token, text = np.concatenate(tokens), np.concatenate(owners)
    order = np.argsort(text, kind="stable")
    return token[order], text[order]


class Vectors:
    """Vectors and weights of the n-grams.

    Walks pull all vectors towards one direction. Each part has a centre and
    a scale, taken from the fitted forms, so that hyperplanes split its texts
    evenly; parts that must be equal are scaled the same in all directions.
    """

    def __init__(self, table: np.ndarray, weight: np.ndarray, frequent: frozenset[str]):
        self.table, self.weight, self.frequent = table, weight, frequent
        self.centre = {part: np.zeros(DIMENSIONS) for part, _, _ in TABLES}
        self.scale = {part: np.eye(DIMENSIONS) for part, _, _ in TABLES}
        self.planes = {part: planes for part, _, planes in TABLES}
        self.longer = 0

    def sized_for(self, works: int) -> Vectors:
        """Finer buckets for many works. They lose pairs with slips, so matching
        keeps its planes and halves at every size; see ``_met``."""
        more = max(0.0, math.log2(max(1, works) / BASE_WORKS))
        self.planes = {part: min(MOST_PLANES, planes + round(more)) for part, _, planes in TABLES}
        self.longer = round(more / math.log2(20))
        return self

    def _spread(self, forms: list[str]) -> None:
        split = [self.parts(f) for f in forms]
        for part in self.centre:
            x = self.of(sorted({t for s in split for t in s[part]}))
            self.centre[part] = x.mean(axis=0)
            if part != "title" and len(x) > 2 * DIMENSIONS:
                values, axes = np.linalg.eigh(np.cov(x.T) + 1e-6 * np.eye(DIMENSIONS))
                self.scale[part] = axes / np.sqrt(values)

    def cosine(self, left: list[str], right: list[str]) -> np.ndarray:
        """Cosines of pairs of titles, from the titles' centre."""
        a, b = (self.placed("title", t) for t in (left, right))
        size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        return (a * b).sum(axis=1) / np.maximum(size, 1e-9)

    def placed(self, part: str, texts: list[str]) -> np.ndarray:
        """Centred and scaled vectors of texts of one part."""
        return (self.of(texts) - self.centre[part]) @ self.scale[part]

    @classmethod
    def fit(cls, forms: list[str], seed: int = 7) -> Vectors:
        """Skip-gram with negative samples over random walks: form, n-gram or
        word, another form that has it, and so on."""
        rng = np.random.default_rng(seed)
        nodes = TOKENS + WORD_NODES
        table = rng.normal(0, DIMENSIONS**-0.5, (nodes, DIMENSIONS)).astype(np.float32)
        if not forms:
            return cls(table[:TOKENS], np.ones(TOKENS, np.float32), frozenset())
        token, owner = _ngrams(forms)
        words = [(TOKENS + zlib.crc32(w.encode()) % WORD_NODES, i) for i, f in enumerate(forms) for w in f.split()]
        token = np.concatenate([token, [w for w, _ in words]]).astype(np.int64)
        owner = np.concatenate([owner, [i for _, i in words]]).astype(np.int64)
        counts = np.bincount(token, minlength=nodes)
        weight = np.log((1.0 + len(forms)) / (1.0 + counts)) + 0.1
        by_form, by_token = np.argsort(owner, kind="stable"), np.argsort(token, kind="stable")
        form_at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(forms)))])
        token_at = np.concatenate([[0], np.cumsum(counts)])
        pick = lambda at, order, x: order[at[x] + (rng.random(len(x)) * (at[x + 1] - at[x])).astype(np.int64)]
        form = rng.integers(0, len(forms), WALKS)
        walk = []
        for _ in range(STEPS):
            step = token[pick(form_at, by_form, form)]
            walk.append(step)
            form = owner[pick(token_at, by_token, step)]
        centre = np.concatenate(walk[:-1])
        context = np.concatenate(walk[1:])
        other = rng.normal(0, 0.1, (nodes, DIMENSIONS)).astype(np.float32)
        order = rng.permutation(len(centre))
        for part in np.array_split(order, max(1, len(order) // 4096)):
            c, x = centre[part], np.concatenate([context[part][:, None], token[rng.integers(0, len(token), (len(part), 4))]], axis=1)
            target = np.zeros(x.shape, np.float32)
            target[:, 0] = 1
            a, b = table[c], other[x]
            error = (target - 1 / (1 + np.exp(-np.clip(np.einsum("nd,nkd->nk", a, b), -30, 30)))) * 0.05
            np.add.at(table, c, np.einsum("nk,nkd->nd", error, b))
            np.add.at(other, x.ravel(), (error[:, :, None] * a[:, None, :]).reshape(-1, DIMENSIONS))
            for side in (table, other):  # few nodes take many steps at once
                norm = np.linalg.norm(side, axis=1, keepdims=True)
                side /= np.maximum(1.0, norm / MOST_NORM)
        known = Counter(w for f in forms for w in set(f.split()))
        frequent = frozenset(w for w, n in known.items() if n >= max(3, FREQUENT * len(forms)))
        out = cls(table[:TOKENS], weight[:TOKENS].astype(np.float32), frequent)
        out._spread(forms)
        return out

    def of(self, texts: list[str]) -> np.ndarray:
        """A unit vector of each text."""
        out = np.zeros((len(texts), DIMENSIONS))
        for first in range(0, len(texts), 4096):
            part = texts[first : first + 4096]
            token, owner = _ngrams(part)
            rows = self.table[token] * self.weight[token][:, None]
            heads = np.searchsorted(owner, np.arange(len(part)))
            out[first : first + len(part)] = np.add.reduceat(rows, heads, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def parts(self, form: str, slipped: bool = False) -> dict[str, list[str]]:
        """The texts of each part: name words are the two longest that aren't
        frequent, and their halves leave out the middle. A form that may hold
        slips gives halves of all sizes its unslipped words might have."""
        words = sorted(form.split(), key=lambda w: (w in self.frequent, -len(w), w))
        names = [w for w in words[:2] if w not in self.frequent] or words[:1]
        size = lambda n: 5 + min(self.longer, (n - 10) // 2) if n >= 10 else 4 if n >= 8 else max(1, n // 2)
        reach = (-2, -1, 0, 1, 2) if slipped else (0,)
        cuts = [(w, k) for w in names for k in sorted({size(max(1, len(w) + r)) for r in reach})]
        return {"title": [form], "name": names, "head": [w[:k] for w, k in cuts], "tail": [w[-k:] for w, k in cuts]}


def _buckets(vectors: Vectors, seed: int = 11):
    """A function from forms to (row, key) of all tables."""
    rng = np.random.default_rng(seed)
    planes = [(part, rng.normal(size=(DIMENSIONS, vectors.planes[part]))) for part, tables, _ in TABLES for _ in range(tables)]

    def keys(forms: list[str], numbers: np.ndarray, slipped: bool) -> tuple[np.ndarray, np.ndarray]:
        split = [vectors.parts(f, slipped) for f in forms]
        length = np.array([len(f.split()) for f in forms], dtype=np.int64)
        rows, out = [], []
        made: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for t, (part, plane) in enumerate(planes):
            if part not in made:
                row = np.array([i for i, s in enumerate(split) for _ in s[part]], dtype=np.int64)
                made[part] = row, vectors.placed(part, [x for s in split for x in s[part]])
            row, vector = made[part]
            bits = (np.round(vector, 6) @ plane > 0).astype(np.int64) @ (1 << np.arange(plane.shape[1]))
            key = bits | (np.int64(t) << 25) | (np.minimum(length[row], 255) << 30) | (np.minimum(numbers[row], 1 << 20) << 40)
            rows.append(row)
            out.append(key)
        return np.concatenate(rows), np.concatenate(out)

    return keys


def record_forms(records: DataFrame) -> DataFrame:
    """(record_id, form, number, kind, year, alternatives): what each name
    says, a row for each title it gives."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, f, n, kind, year, len(forms)) for i, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for forms, year, kind in (parse_release(name),) for f, n in forms]
            columns = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["record_id", "form", "number", "kind", "year", "alternatives"])

    named = records.where("record_id is not null and name is not null").select("record_id", "name")
    return named.mapInArrow(parse, "record_id bigint, form string, number bigint, kind string, year int, alternatives int")


def work_table(works: DataFrame) -> DataFrame:
    """(form, number, kind, tmdb_id, year) of the distinct works."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = [(f, n, r["kind"], r["tmdb_id"], r["year"]) for r in rows for f, n in work_forms(r["title"], r["original_title"])]
            columns = list(zip(*out)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["form", "number", "kind", "tmdb_id", "year"])

    dated = F.regexp_extract("release_date", r"^\s*(\d{4})\b", 1).try_cast("int")
    once = works.where("id is not null").select(
        "kind", F.col("id").cast("bigint").alias("tmdb_id"), "title", "original_title", F.coalesce(F.col("release_year").cast("int"), dated).alias("year")
    )
    schema = "form string, number bigint, kind string, tmdb_id bigint, year int"
    return once.distinct().mapInArrow(parse, schema).groupBy("form", "number", "kind", "tmdb_id").agg(F.max("year").alias("year"))


def _hashed(forms: DataFrame, vectors: Vectors, slipped: bool) -> DataFrame:
    keys = _buckets(vectors)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, key = keys(batch.column(0).to_pylist(), batch.column(1).to_numpy(), slipped)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(key)], ["form", "number", "key"])

    return forms.select("form", "number").mapInArrow(bucket, "form string, number bigint, key bigint").distinct()


def _sample(df: DataFrame, key: str, limit: int) -> list:
    """About ``limit`` rows of a written table, chosen by hash."""
    share = min(1.0, limit / max(1, df.count()))
    chosen = F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.where(chosen).limit(2 * limit).collect()  # bounded by limit


def fitted_vectors(*sides: DataFrame, limit: int = FIT_FORMS) -> Vectors:
    """Vectors fitted on about ``limit`` forms of the sides, chosen by hash."""
    rows = [r[0] for s in sides for r in _sample(s.select("form"), "form", limit // len(sides))]
    return Vectors.fit(sorted(set(rows)))


def _split_values(form: str) -> tuple[Column, Column]:
    """Length, and how many letters are not of every second one: a slip changes
    either by one at most, so within ``MOST_SLIPS`` both are nearly equal."""
    return F.length(form), F.length(F.translate(form, "acegikmoqsuwy", ""))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """(form, number, work_form) of the pairs of one bucket whose split values
    allow ``MOST_SLIPS``; a pair may repeat.

    A bucket of more than ``BIG_BUCKET`` works is cut by both values into parts
    of ``SPLIT``; a record's form goes to all parts within its reach, so the
    pairs are the same as those of the whole bucket.
    """
    right = materialize(right, "hashed")
    big = broadcast_small(right.groupBy("key").agg(F.count(F.lit(1)).alias("works")).where(F.col("works") > BIG_BUCKET).select("key", F.lit(True).alias("big")))
    part = lambda v: F.floor(v / SPLIT).cast("int")
    reach = lambda v: F.sequence(part(v - MOST_SLIPS), part(v + MOST_SLIPS))
    whole = F.lit(-1)
    a, b = _split_values("work_form")
    works = right.join(big, "key", "left").select("key", "work_form", *(F.when(F.col("big"), part(v)).otherwise(whole).alias(n) for v, n in ((a, "a"), (b, "b"))))
    c, d = _split_values("form")
    asked = left.join(big, "key", "left")
    for v, n in ((c, "a"), (d, "b")):
        asked = asked.withColumn(n, F.explode(F.when(F.col("big"), reach(v)).otherwise(F.array(whole))))
    near = (F.abs(a - c) <= MOST_SLIPS) & (F.abs(b - d) <= MOST_SLIPS)
    return asked.join(works, ["key", "a", "b"]).where(near).select("form", "number", "work_form")


def form_pairs(record_side: DataFrame, work_side: DataFrame, vectors: Vectors) -> DataFrame:
    """(form, number, work_form, slips, cosine, same) of the candidate pairs
    whose letters are near.

    ``record_side`` and ``work_side`` have distinct form and number. Pairs of
    more than ``MOST_SLIPS`` slips aren't the same title; nor is a pair with a
    word that the works know and the other title lacks, which is no slip.
    Pairs of up to ``MOST_SLIPS`` have a cosine.
    """
    left = _hashed(record_side, vectors, slipped=True)
    right = _hashed(work_side, vectors, slipped=False).select(F.col("form").alias("work_form"), "key")
    near = (
        _met(left, right)
        .where(F.levenshtein("form", "work_form", 2 * MOST_SLIPS) >= 0)
        .distinct()
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pairs = list(zip(pdf["form"], pdf["work_form"]))
            pdf["slips"] = np.array([title_distance(a, b) for a, b in pairs], dtype=np.int32)
            cosine = np.where(pdf["slips"] == 0, 1.0, np.nan)
            need = np.flatnonzero(pdf["slips"].between(1, MOST_SLIPS))
            if len(need):
                cosine[need] = vectors.cosine(*([pairs[i][k] for i in need] for k in (0, 1)))
            pdf["cosine"] = cosine
            pdf["odd"] = [[x for x, y in zip(a.split(), b.split()) if x != y] for a, b in pairs]
            yield pdf

    compared = near.mapInPandas(compare, "form string, number bigint, work_form string, slips int, cosine double, odd array<string>")
    compared = materialize(compared, "pairs")
    vocabulary = work_side.select(F.explode(F.split("form", " ")).alias("word")).distinct()
    other = (
        compared.where("slips > 0")
        .select("form", "number", "work_form", F.explode("odd").alias("word"))
        .join(vocabulary, "word", "left_semi")
        .select("form", "number", "work_form", F.lit(True).alias("other"))
        .distinct()
    )
    same = (F.col("slips") <= MOST_SLIPS) & F.col("other").isNull()
    return compared.drop("odd").join(other, ["form", "number", "work_form"], "left").withColumn("same", same).drop("other")


def planted_slip(form: str, rng: np.random.Generator) -> str:
    """The form with one letter lost, exchanged, added or swapped in its longest word."""
    words = form.split()
    w = max(words, key=len)
    k, letter = int(rng.integers(0, len(w))), chr(97 + int(rng.integers(0, 26)))
    made = (w[:k] + w[k + 1 :], w[:k] + letter + w[k + 1 :], w[:k] + letter + w[k:], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :])[int(rng.integers(0, 4))]
    return " ".join(made if x == w else x for x in words if made or x != w) or form


def planted_pairs(works: list[tuple[str, int]], vectors: Vectors, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(cosine, one title) of pairs of a form with planted slips and a title of
    its buckets: its own, or another, which then is none of its works."""
    rng = np.random.default_rng(seed)
    forms, numbers = [f for f, _ in works], np.array([n for _, n in works], dtype=np.int64)
    typed = [planted_slip(planted_slip(f, rng) if rng.random() < 0.2 else f, rng) for f in forms]
    keys = _buckets(vectors)
    row, key = keys(typed, numbers, True)
    there, listed = keys(forms, numbers, False)
    order = np.argsort(listed, kind="stable")
    low, high = (np.searchsorted(listed[order], key, side=x) for x in ("left", "right"))
    count = np.minimum(high - low, 64)  # of a sample's pairs, for the fit only
    left = np.repeat(row, count)
    ends = np.cumsum(count)
    right = there[order[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(low, count)]]
    pairs = np.unique(np.stack([np.concatenate([left, np.arange(len(forms))]), np.concatenate([right, np.arange(len(forms))])]), axis=1)
    known = set(forms)
    kept = [(typed[i], forms[j], i == j) for i, j in pairs.T.tolist() if typed[i] not in known]
    if not kept:
        return np.empty(0), np.empty(0)
    return vectors.cosine([a for a, _, _ in kept], [b for _, b, _ in kept]), np.array([float(y) for _, _, y in kept])


def calibration(cosines: np.ndarray, same: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from cosine to the chance
    that a candidate pair is one title."""
    # One imagined pair of each kind keeps the curve finite.
    x, y = np.concatenate([cosines, [1.0, -1.0]]), np.concatenate([same, [1.0, 0.0]])
    design = np.stack([x, np.ones_like(x)], axis=1)
    theta = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grade = design.T @ (y - p) - 1e-3 * theta
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        theta = theta + np.linalg.solve(curve, grade)
    return float(theta[0]), float(theta[1])


def matched(records: DataFrame, works: DataFrame) -> DataFrame:
    """(record_id, tmdb_id, confidence): the work each record releases.

    Kind, sequel number and every word of the title must agree, slips of the
    keyboard aside; of the titles within reach that of the largest cosine
    counts. A name's
    year must be the work's; it may be off by one, or the work's unknown,
    where no other work has the title. A name without a year needs a title
    that one work of its kind has. Names that give several works match none.
    Null and empty names match nothing; a work fetched twice is one work;
    a repeated record gives its row again.
    """
    parsed = materialize(record_forms(records), "parsed")
    titles = materialize(work_table(works), "titles")
    asked, listed = (materialize(t.select("form", "number").distinct(), "forms") for t in (parsed, titles))
    vectors = fitted_vectors(listed, asked)
    pairs = materialize(form_pairs(asked, listed, vectors).where("same"), "scored")
    planted = sorted((r[0], r[1]) for r in _sample(listed, "form", PLANTED))
    slope, intercept = calibration(*planted_pairs(planted, vectors))
    # One shuffle by form serves all that follows up to the join with the records.
    good = pairs.join(titles.withColumnRenamed("form", "work_form"), ["work_form", "number"])
    near = good.repartition("form", "number").withColumn("nearest", F.max("cosine").over(Window.partitionBy("form", "number")))
    options = (
        near.where("cosine >= nearest - 1e-9")
        .groupBy("form", "number", "kind", "tmdb_id")
        .agg(F.max("year").alias("year"), F.max("cosine").alias("cosine"))
    )
    # What a record's decision needs of its form: works in all, by kind, and by kind and year.
    work = F.struct("tmdb_id", "year", "cosine")
    by_year = options.groupBy("form", "number", "kind", "year").agg(F.count(F.lit(1)).alias("n"), F.min(work).alias("w"))
    entry = F.when(F.col("year").isNotNull(), F.struct("year", F.struct("n", "w")))  # one per calendar year
    by_kind = by_year.groupBy("form", "number", "kind").agg(
        F.sum("n").alias("n"), F.min("w").alias("w"), F.map_from_entries(F.collect_list(entry)).alias("years")
    )
    kinds = by_kind.groupBy("form", "number").agg(F.sum("n").alias("n_all"), F.collect_list(F.struct("kind", "n", "w", "years")).alias("kinds"))
    dated = F.try_element_at("years", F.col("year"))
    alone = (F.col("n_all") == 1) & F.coalesce(F.abs(F.col("w.year") - F.col("year")) <= 1, F.lit(True))
    choice: Column = (
        F.when(F.col("year").isNull(), F.when(F.col("n") == 1, F.col("w")))
        .when(dated.isNotNull(), F.when(dated["n"] == 1, dated["w"]))
        .when(alone, F.col("w"))
    )
    chances = F.round(1 / (1 + F.exp(-(F.lit(slope) * F.col("choice.cosine") + F.lit(intercept)))), 6)
    decided = (
        parsed.join(kinds, ["form", "number"])
        .withColumn("k", F.get(F.filter("kinds", lambda k: k["kind"] == F.col("kind")), F.lit(0)))
        .where("k is not null")
        .select("record_id", "alternatives", "year", "n_all", "k.*")
        .withColumn("choice", choice)
        .where("choice is not null")
        .select("record_id", "alternatives", "choice.tmdb_id", chances.alias("confidence"))
    )
    several = decided.where("alternatives > 1").groupBy("record_id").agg(
        F.min("tmdb_id").alias("tmdb_id"), F.max("tmdb_id").alias("last"), F.max("confidence").alias("confidence")
    )
    return decided.where("alternatives = 1").drop("alternatives").unionByName(several.where("tmdb_id = last").drop("last"))
