"""Queries of the llm operators, by name, and their SQL counterparts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelloom.llm.canonical_values import map_item_values
from reelloom.llm.entity_match import matched
from reelloom.llm.fusion import STAND_INS, fused, survivors
from reelloom.llm.genre_names import OTHER_NAMES
from reelloom.llm.leaks import leaked
from reelloom.llm.packing import fill_report, packed
from reelloom.llm.quality import document_quality
from reelloom.llm.seen_keys import seen_before, wrong_answers
from reelloom.llm.topn import top_n
from reelloom.session import table

CONTENT_KEY = ["content_type", "content_source", "content_id"]
TOP_TORRENTS = 3
# The public byte-level BPE of 50,256 ranks, and where its file is.
VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZERS = os.environ.get("REELLOOM_TOKENIZERS", "/opt/tokenizers")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_before(table(spark, sf_dir, "torrent_records"), table(spark, sf_dir, "ingested_torrents"))


def p2_wrong_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_answers(table(spark, sf_dir, "torrent_records"), table(spark, sf_dir, "ingested_torrents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    genres = table(spark, sf_dir, "content_collections").where("type = 'genre'").select("id", "name")
    items = table(spark, sf_dir, "catalog_snapshot_items")
    others = spark.createDataFrame([(n, o) for n, listed in OTHER_NAMES.items() for o in listed.split("|")], "name string, other string")
    return map_item_values(items, ["generation_id", *CONTENT_KEY], "genres", genres, others)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "catalog_items"), table(spark, sf_dir, "metadata_sources"), STAND_INS)


def p4_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(table(spark, sf_dir, "catalog_items"), table(spark, sf_dir, "metadata_sources"), STAND_INS)


def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(table(spark, sf_dir, "torrent_records"), table(spark, sf_dir, "tmdb_content"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_matches(spark, sf_dir).select("record_id", "tmdb_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = [r.id for r in table(spark, sf_dir, "catalog_snapshot_generations").where("active").select("id").collect()]
    rows = (
        table(spark, sf_dir, "catalog_snapshot_torrents")
        .where(F.col("generation_id").isin(active))
        .select(*CONTENT_KEY, "video_resolution", "info_hash", "seeders")
    )
    best = top_n(rows, [*CONTENT_KEY, "video_resolution"], "seeders", "info_hash", TOP_TORRENTS)
    return best.select(*CONTENT_KEY, F.coalesce("video_resolution", F.lit("")).alias("video_resolution"), "info_hash")


# White space as in ``functions.text``.
_SQL_BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}\x{b}]"

P2_FOUND_SQL = f"""
WITH raw AS (
  SELECT record_id, source, info_hash FROM torrent_records
  UNION ALL SELECT NULL, source, info_hash FROM ingested_torrents
),
trimmed AS (
  SELECT record_id, regexp_replace(source, '^{_SQL_BLANKS}+|{_SQL_BLANKS}+$', '', 'g') AS source,
    regexp_replace(info_hash, '^{_SQL_BLANKS}+|{_SQL_BLANKS}+$', '', 'g') AS t FROM raw
),
bare AS (
  SELECT record_id, source, CASE WHEN regexp_matches(t, '(?i)^magnet:')
    THEN regexp_extract(t, '(?i)[?&]xt=urn(?::|%3a)btih(?::|%3a)([^&#]*)', 1) ELSE t END AS t FROM trimmed
),
keyed AS (
  SELECT record_id, source, CASE
    WHEN regexp_matches(t, '^[0-9A-Fa-f]{{40}}$') THEN lower(t)
    WHEN regexp_matches(t, '^[A-Za-z2-7]{{32}}$') THEN array_to_string(list_transform(range(0, 4), lambda g:
      printf('%010x', list_reduce(list_transform(range(1, 9), lambda i:
        CAST(strpos('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', substr(upper(t), CAST(g * 8 + i AS BIGINT), 1)) - 1 AS BIGINT)),
        lambda a, b: a * 32 + b))), '') END AS hash
  FROM bare
),
firsts AS (SELECT source, hash, min(coalesce(record_id, -1)) AS first_id FROM keyed
  WHERE source <> '' AND hash IS NOT NULL GROUP BY ALL)
SELECT record_id FROM keyed JOIN firsts USING (source, hash) WHERE record_id > first_id
"""

def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_windows"), TOKENIZERS, VOCABULARY)


def p8_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p8_packed(spark, sf_dir), table(spark, sf_dir, "context_windows"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = document_quality(table(spark, sf_dir, "documents"))
    return quality.where(F.col("list") + F.col("table") + F.col("junk") > 0.5).select("doc_id")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_quality(table(spark, sf_dir, "documents"))


_STAND_IN_LIST = ", ".join(f"'{s}'" for s in STAND_INS)
# Parts of a file name that mark a picture as a stand-in.
_PICTURE = (
    r"(?i)(^|[/_.-])(no[_-]?(image|img|poster|photo|picture|cover|thumb(nail)?)|missing|blank|default|placeholder|not[_-]?found|"
    r"unavailable|coming[_-]?soon|dummy|spacer|empty|null|none|n/a)([/_.-]|\d|$)"
)


def _words_sql(column: str) -> str:
    bare = f"regexp_replace(regexp_replace({column}, '(?s)<[^<>]*>', ' ', 'g'), '(?i)&(nbsp|#160|#xa0|ensp|emsp|thinsp|zwnj|zwj|shy|#8203);', ' ', 'g')"
    return f"trim(regexp_replace(lower({bare}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


P4_FOUND_SQL = f"""
WITH texts AS (
  SELECT *, {_words_sql('synopsis')} AS words, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS name,
    trim(poster, e' \\t\\n\\r' || chr(160)) AS picture, trim(tmdb_id, e' \\t\\n\\r' || chr(160)) AS number
  FROM catalog_items WHERE canonical_id IS NOT NULL
),
pictures AS (SELECT picture FROM texts GROUP BY picture HAVING count(DISTINCT canonical_id) >= 3),
claims AS (
  SELECT t.*, coalesce(m.trust_rank, 2147483647) AS trust,
    coalesce(words <> '' AND words NOT IN ({_STAND_IN_LIST})
      AND regexp_replace(words, ' \\d{{4}}$', '') <> regexp_replace(coalesce(t.name, ''), ' \\d{{4}}$', ''), false) AS ok_synopsis,
    coalesce(regexp_matches(picture, '(?i)^(https?:/)?/\\S*[^\\s/]+$') AND NOT regexp_matches(picture, '{_PICTURE}'), false)
      AND picture NOT IN (SELECT picture FROM pictures WHERE picture IS NOT NULL) AS ok_poster,
    coalesce(rating > 0 AND rating <= 10 AND NOT isnan(rating), false) AS ok_rating,
    coalesce(regexp_matches(number, '^0*[1-9][0-9]*$'), false) AS ok_tmdb_id
  FROM texts t LEFT JOIN metadata_sources m ON m.key = t.source
),
fields AS (
  SELECT canonical_id, unnest(['synopsis', 'poster', 'rating', 'tmdb_id']) AS field_name,
    unnest([ok_synopsis, ok_poster, ok_rating, ok_tmdb_id]) AS ok, trust, updated_at, row_id FROM claims
)
SELECT canonical_id, field_name, row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY canonical_id, field_name ORDER BY trust, updated_at DESC NULLS LAST, row_id) AS place FROM fields WHERE ok)
WHERE place = 1 AND canonical_id IN (SELECT canonical_id FROM catalog_items GROUP BY 1 HAVING count(*) >= 2)
"""

P7_FOUND_SQL = """
SELECT content_type, content_source, content_id, coalesce(video_resolution, '') AS video_resolution, info_hash
FROM (
  SELECT *, row_number() OVER (
    PARTITION BY content_type, content_source, content_id, video_resolution
    ORDER BY seeders DESC NULLS LAST, info_hash) AS place
  FROM (
    SELECT content_type, content_source, content_id, video_resolution, info_hash, max(seeders) AS seeders
    FROM catalog_snapshot_torrents
    WHERE generation_id IN (SELECT id FROM catalog_snapshot_generations WHERE active)
    GROUP BY ALL)
) WHERE place <= 3
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_wrong_answers": p2_wrong_answers,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_fused": p4_fused,
    "p6_found": p6_found,
    "p6_matches": p6_matches,
    "p7_found": p7_found,
    "p8_packed": p8_packed,
    "p8_unused": p8_unused,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}

SQL: dict[str, str] = {
    "p2_found": P2_FOUND_SQL,
    "p4_found": P4_FOUND_SQL,
    "p7_found": P7_FOUND_SQL,
}
