"""Release names: kind, year, display title and its comparable form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelloom.functions.text import let

# File extensions, series marks and noise words of release names.
VIDEO_EXTENSION = r"(?i)\.(mkv|mp4|avi|mov|wmv|m4v)$"
SERIES_MARK = r"(?i)\bS\d{1,2}E\d{1,3}\b|\bSeason\s+\d{1,2}\b|\s-\s\d{1,3}\b"
NOISE_WORD = r"(?i)\b(?:2160p|1080p|720p|480p|web-?dl|webrip|bluray|brrip|x264|x265|h\.?264|h\.?265|hevc)\b"
YEAR = r"\b(?:19|20)\d{2}\b"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, VIDEO_EXTENSION, "")


def strip_group(name: Column) -> Column:
    """Without a leading ``[group]`` of ASCII letters, digits and `` -_.``."""
    return F.trim(F.regexp_replace(F.trim(name), r"^\[[A-Za-z0-9 \-_.]*\]", ""))


def release_year(name: Column) -> Column:
    """The first year 1900 to 2099 that stands as a word."""
    found = F.regexp_extract(name, f"({YEAR})", 1)
    return F.when(found != "", found.cast("int"))


def release_kind(name: Column, hint: Column | None = None) -> Column:
    by_name = F.when(name.rlike(SERIES_MARK), F.lit("tv_show")).otherwise(F.lit("movie"))
    if hint is None:
        return by_name
    return F.when(hint.isin("movie", "tv_show"), hint).otherwise(by_name)


def normalized_title(title: Column) -> Column:
    """Letters and digits only; ASCII letters in lower case."""
    return F.translate(F.regexp_replace(title, r"[^\p{IsAlphabetic}\p{N}]", ""), UPPER, LOWER)


def display_title(text: Column) -> Column:
    """Dots and underscores as blanks, blanks folded, outer marks dropped; null
    if fewer than three letters or digits remain."""
    folded = F.trim(F.regexp_replace(F.translate(text, "._", "  "), r"\s+", " "))
    bare = F.btrim(folded, F.lit("-:[]() "))
    return let(bare, lambda t: F.when(F.length(normalized_title(t)) >= 3, t))


def _position(text: Column, pattern: str) -> Column:
    """Characters before the first match; null without one."""
    before = F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1)
    return F.when(text.rlike(pattern), F.length(before))


def parse_release_name(name: Column, hint: Column | None = None) -> Column:
    """Struct (kind, title, year).

    A film's title ends at the first occurrence of its year's digits, else at
    the first noise word; a series' at the series mark or the year, whichever
    comes first. No title leaves title null.
    """

    def parsed(text: Column) -> Column:
        kind, year = release_kind(text, hint), release_year(text)
        digits = F.instr(text, year.cast("string")) - 1
        film = F.coalesce(digits, _position(text, NOISE_WORD), F.length(text))
        show = F.coalesce(F.least(_position(text, SERIES_MARK), digits), F.length(text))
        cut = F.when(kind == "tv_show", show).otherwise(film)
        return F.struct(kind.alias("kind"), display_title(F.substring(text, F.lit(1), cut)).alias("title"), year.alias("year"))

    return let(strip_group(strip_extension(name)), parsed)


def titles_match(wanted: Column, found: Column) -> Column:
    """Equal, or one contains the other, which then has eight characters or more."""

    def test(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return (a == b) | ((F.length(a) >= 8) & b.contains(a)) | ((F.length(b) >= 8) & a.contains(b))

    return let(F.struct(normalized_title(wanted).alias("a"), normalized_title(found).alias("b")), test)


def years_match(wanted: Column, found: Column) -> Column:
    """At most one apart; a wanted year needs a found one."""
    return F.when(wanted.isNull(), F.lit(True)).otherwise(F.coalesce(F.abs(found - wanted) <= 1, F.lit(False)))
