"""Which alias means which canonical content, and why.

Every pipeline gathers candidate pairs with evidence as a union of equality
joins, keeps aliases with one canonical content, and merges them into the
correlation table under its own conflict rule. Canonical contents come from
the source ``tmdb``; types must agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelloom.operators.merge import insert_missing, keep, merge, merge_episodes, overwrite, remove
from reelloom.operators.merge import greatest as larger

KEY = ["content_type", "content_source", "content_id"]
CANONICAL = ["canonical_type", "canonical_source", "canonical_id"]
MAIN = "tmdb"
# Kinds of evidence, the strongest first.
EVIDENCE = ("exact_tmdb_id", "exact_imdb_id", "shared_info_hash")


def _imdb_attributes(attributes: DataFrame, alias: bool) -> DataFrame:
    named = F.col("key") == "imdb_id"
    if not alias:
        named = named & (F.col("source") == MAIN)
    return attributes.where(named | ((F.col("source") == "imdb") & (F.col("key") == "id")))


def shared_hash_pairs(aliases: DataFrame, canonical: DataFrame) -> DataFrame:
    """Aliases and canonical contents that have a torrent in common."""
    other = canonical.where(F.col("content_source") == MAIN).select(
        "info_hash", "content_type", F.col("content_source").alias("canonical_source"), F.col("content_id").alias("canonical_id")
    )
    mine = aliases.where((F.col("content_source") != MAIN) & F.col("content_id").isNotNull())
    return (
        mine.join(other, ["info_hash", "content_type"])
        .groupBy(*KEY, F.col("content_type").alias("canonical_type"), "canonical_source", "canonical_id")
        .agg(F.min("info_hash").alias("evidence_info_hash"))
        .withColumn("evidence_kind", F.lit("shared_info_hash"))
    )


def exact_id_pairs(aliases: DataFrame, contents: DataFrame, attributes: DataFrame) -> DataFrame:
    """Aliases and canonical contents that share an external id.

    ``aliases`` are key columns. An alias' own id or an IMDb attribute of it
    may equal the canonical content's IMDb attribute; its ``tmdb_id`` may be
    the canonical content's id. The two ways to have an IMDb id are a union,
    so no join has an OR.
    """
    own = aliases.select(*KEY, F.col("content_id").alias("value"))
    given = _imdb_attributes(attributes, alias=True).select(*KEY, "value").join(aliases.select(*KEY), KEY, "left_semi")
    main = _imdb_attributes(attributes, alias=False).where(F.col("content_source") == MAIN)
    main = main.select("content_type", F.col("content_source").alias("canonical_source"), F.col("content_id").alias("canonical_id"), "value")
    imdb = own.unionByName(given).distinct().join(main, ["content_type", "value"]).withColumn("evidence_kind", F.lit("exact_imdb_id"))
    tmdb_ids = attributes.where(F.col("key") == "tmdb_id").select(*KEY, "value").join(aliases.select(*KEY), KEY, "left_semi")
    listed = contents.where(F.col("source") == MAIN).select(
        F.col("type").alias("content_type"), F.col("source").alias("canonical_source"), F.col("id").alias("canonical_id"), F.col("id").alias("value")
    )
    tmdb = tmdb_ids.join(listed, ["content_type", "value"]).withColumn("evidence_kind", F.lit("exact_tmdb_id"))
    columns = [*KEY, F.col("content_type").alias("canonical_type"), "canonical_source", "canonical_id", "evidence_kind"]
    return imdb.select(*columns).unionByName(tmdb.select(*columns)).distinct()


def strongest(kind: Column) -> Column:
    """Aggregate: the strongest evidence of a group."""
    rank = F.lit(len(EVIDENCE))
    for i, name in enumerate(EVIDENCE):
        rank = F.when(kind == name, F.lit(i)).otherwise(rank)
    return F.array(*[F.lit(e) for e in EVIDENCE])[F.min(rank)]


def unambiguous(pairs: DataFrame) -> DataFrame:
    """One row per alias with exactly one canonical content: the least
    evidence hash and the strongest evidence."""
    return (
        pairs.groupBy(*KEY)
        .agg(
            F.count_distinct(F.struct(*CANONICAL)).alias("_n"),
            *[F.min(c).alias(c) for c in CANONICAL],
            F.min("evidence_info_hash").alias("evidence_info_hash"),
            strongest(F.col("evidence_kind")).alias("evidence_kind"),
        )
        .where("_n = 1")
        .drop("_n")
    )


def latest_hash(links: DataFrame) -> DataFrame:
    """(key columns, evidence_info_hash): the torrent of each content updated
    last, the least hash of equals."""
    return links.groupBy(*KEY).agg(
        F.min_by("info_hash", F.struct((-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("age"), "info_hash")).alias("evidence_info_hash")
    )


def alias_keys(contents: DataFrame) -> DataFrame:
    return contents.where(F.col("source") != MAIN).select(*[F.col(a).alias(b) for a, b in zip(("type", "source", "id"), KEY)])


def repair_shared(links: DataFrame) -> DataFrame:
    """Correlations from shared torrents."""
    known = links.where(F.col("content_source").isNotNull())
    return unambiguous(shared_hash_pairs(known, known))


def repair_exact(contents: DataFrame, attributes: DataFrame, links: DataFrame) -> DataFrame:
    """Correlations from external ids; aliases without a torrent drop out."""
    pairs = exact_id_pairs(alias_keys(contents), contents, attributes)
    return unambiguous(pairs.join(latest_hash(links), KEY))


def correlate_pending(pending: DataFrame, torrents: DataFrame, links: DataFrame, contents: DataFrame, attributes: DataFrame) -> DataFrame:
    """Correlations of contents with pending links whose torrent has arrived,
    from all three kinds of evidence."""
    aliases = pending.join(torrents.select("info_hash"), "info_hash", "left_semi").select(*KEY).distinct()
    mine = links.join(aliases, KEY, "left_semi")
    least = mine.groupBy(*KEY).agg(F.min("info_hash").alias("evidence_info_hash"))
    exact = exact_id_pairs(aliases, contents, attributes).join(least, KEY)
    shared = shared_hash_pairs(mine, links).select(*exact.columns)
    return unambiguous(exact.unionByName(shared))


def ignore_known(correlations: DataFrame, found: DataFrame) -> DataFrame:
    """Only aliases without a correlation get one."""
    return insert_missing(correlations, found, KEY)


def _same_canonical(t: Column, s: Column) -> Column:
    return (t["canonical_type"] == s["canonical_type"]) & (t["canonical_source"] == s["canonical_source"]) & (t["canonical_id"] == s["canonical_id"])


def upgrade(correlations: DataFrame, found: DataFrame) -> DataFrame:
    """As ``ignore_known``; where the canonical content agrees the evidence
    hash is renewed and the evidence may only get stronger."""
    stronger = lambda old, new: F.when((new == EVIDENCE[0]) | (old == EVIDENCE[2]), new).otherwise(old)
    return merge(correlations, found, KEY, {"evidence_info_hash": overwrite, "evidence_kind": stronger}, only_if=_same_canonical)


def renew(correlations: DataFrame, found: DataFrame) -> DataFrame:
    """As ``upgrade``, but the evidence is replaced, even by weaker."""
    return merge(correlations, found, KEY, {"evidence_info_hash": overwrite, "evidence_kind": overwrite}, only_if=_same_canonical)


def match_aliases(matches: DataFrame, contents: DataFrame, attributes: DataFrame, links: DataFrame) -> DataFrame:
    """Aliases that a match binds, with its evidence.

    ``matches``: info_hash, content_type, tmdb_id, imdb_id. An alias of the
    type is bound by its own ``tmdb_id`` attribute, by having the IMDb id as
    its id, or by a link to the torrent.
    """
    aliases = alias_keys(contents)
    target = ["info_hash", "content_type", "tmdb_id"]
    by_link = matches.select(*target).join(links.select("info_hash", *KEY), ["info_hash", "content_type"]).join(aliases, KEY, "left_semi")
    by_imdb = matches.where("imdb_id is not null").select(*target, F.col("imdb_id").alias("content_id")).join(aliases, ["content_type", "content_id"])
    own = attributes.where((F.col("key") == "tmdb_id") & (F.col("source") == F.col("content_source"))).select(*KEY, F.col("value").alias("tmdb_id"))
    by_tmdb = matches.select(*target).join(own, ["content_type", "tmdb_id"]).join(aliases, KEY, "left_semi")
    kinds = zip((by_tmdb, by_imdb, by_link), EVIDENCE)
    parts = [df.select(*target, "content_source", "content_id", F.lit(kind).alias("evidence_kind")) for df, kind in kinds]
    joined = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return joined.groupBy(*target, "content_source", "content_id").agg(strongest(F.col("evidence_kind")).alias("evidence_kind"))


def conflicting(bound: DataFrame, correlations: DataFrame) -> DataFrame:
    """(info_hash, content_type, tmdb_id) of matches with an alias that is
    correlated to another content already; such a match is rejected whole."""
    other = (F.col("canonical_type") != F.col("content_type")) | (F.col("canonical_source") != MAIN) | (F.col("canonical_id") != F.col("tmdb_id"))
    return bound.join(correlations.select(*KEY, *CANONICAL), KEY).where(other).select("info_hash", "content_type", "tmdb_id").distinct()


def any_arrived(pending: DataFrame, torrents: DataFrame) -> bool:
    """Whether any pending link's torrent is there; stops at the first."""
    return not pending.join(torrents.select("info_hash"), "info_hash", "left_semi").isEmpty()


def materialize_pending(pending: DataFrame, torrents: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, pending) after links whose torrent has arrived moved over.

    A link that exists keeps its resolution if it has one, takes larger peer
    counts, and joins season maps.
    """
    ready = pending.join(torrents.select("info_hash", "size"), "info_hash")
    rules = {"episodes": merge_episodes, "video_resolution": keep, "seeders": larger, "leechers": larger}
    columns = [c for c in links.columns if c in ready.columns]
    merged = merge(links, ready.select(*columns), ["info_hash", *KEY], rules)
    return merged, remove(pending, ready, ["info_hash", *KEY])


def attach_canonical(links: DataFrame, matches: DataFrame) -> DataFrame:
    """Links with each matched torrent also linked to its canonical content.

    The new link copies the torrent's best one: that of the main source, then
    any with a source, then the latest. An existing link fills what it lacks
    and takes larger counts.
    """
    best = links.groupBy("info_hash").agg(
        F.min_by(
            F.struct("video_resolution", "seeders", "leechers", "created_at", "updated_at"),
            F.struct(
                # As in the catalogue's order, a link without source ranks first.
                F.coalesce((F.col("content_source") != MAIN).cast("int"), F.lit(-1)).alias("a"),
                F.col("content_source").isNull().cast("int").alias("b"),
                (-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("c"),
                F.coalesce("content_id", F.lit("")).alias("d"),
            ),
        ).alias("best")
    )
    fresh = matches.join(best, "info_hash").select(
        "info_hash", "content_type", F.lit(MAIN).alias("content_source"), F.col("tmdb_id").alias("content_id"), "best.*"
    )
    rules = {"seeders": larger, "leechers": larger}
    return merge(links, fresh, ["info_hash", *KEY], rules)
