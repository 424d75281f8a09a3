"""Small conversions between what sources deliver and what the catalogue keeps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelloom.functions.text import let, non_blank

# Known resolutions, the one to prefer first.
RESOLUTIONS = ("2160p", "1080p", "720p", "480p")
INT_MAX = 2**31 - 1
# Units of sizes in page texts.
PAGE_UNITS = {
    "byte": 1, "bytes": 1, "kb": 10**3, "kib": 2**10, "mb": 10**6, "mib": 2**20,
    "gb": 10**9, "gib": 2**30, "tb": 10**12, "tib": 2**40,
}
# A size in a page text, and episode marks of a path.
PAGE_SIZE_TEXT = r"(?i)\b(\d+(?:[.,]\d+)?)\s*(bytes?|[kmgt]i?b)\b"
EPISODE_MARK = r"(?i)s(\d{1,3})[ ._-]*e(\d{1,3})|(\d{1,3})x(\d{1,3})"
# Words for true and false.
TRUE_WORDS = ("1", "true", "yes", "on")
FALSE_WORDS = ("0", "false", "no", "off")


def is_imdb_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^tt[0-9]{5,}$"), F.lit(False))


def year_of_date(value: Column) -> Column:
    return F.substring(value, 1, 4).try_cast("int")


def video_resolution(value: Column) -> Column:
    """``V`` and the first known resolution the text contains."""
    plain = F.lower(F.trim(value))
    out = F.lit(None).cast("string")
    for r in reversed(RESOLUTIONS):
        out = F.when(plain.contains(r), F.lit("V" + r)).otherwise(out)
    return out


def normalized_quality(resolution: Column) -> Column:
    """Without the leading ``V``, in lower case; ``unknown`` if nothing is left."""
    rest = F.when(resolution.startswith("V"), F.substring(resolution, 2, 100))
    return F.coalesce(F.nullif(F.lower(rest), F.lit("")), F.lit("unknown"))


def genre_slug(name: Column) -> Column:
    """ASCII letters and digits in lower case, a dash for each blank or dash,
    nothing for other characters, no outer dashes."""
    dashed = F.regexp_replace(name, r"[\s\p{Z}]", "-")
    return F.btrim(F.lower(F.regexp_replace(dashed, r"[^A-Za-z0-9\-]", "")), F.lit("-"))


def image_url(base: str, path: Column) -> Column:
    """A web address as it is, a path under ``base``, null for blank."""
    text = non_blank(path)
    absolute = text.startswith("http://") | text.startswith("https://")
    return F.when(absolute, text).otherwise(F.concat(F.lit(base + "/"), F.ltrim(text, F.lit("/"))))


def clamp_rating(rating: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(F.nanvl(rating, F.lit(0.0)), F.lit(0.0))))


def non_negative(value: Column) -> Column:
    return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0))


def saturated(total: Column) -> Column:
    return F.least(total, F.lit(INT_MAX)).cast("int")


def stable_item_id(title: Column, year: Column) -> Column:
    """32 hex characters of a digest of lower-case title and year, 0 if none."""
    text = F.concat(F.lower(title), F.char(F.lit(0)), F.coalesce(year, F.lit(0)).cast("string"))
    return F.substring(F.sha2(text, 256), 1, 32)


def checkpoint_id(source: Column, endpoint: Column) -> Column:
    return F.concat(source, F.lit(":"), F.substring(F.sha2(endpoint, 256), 1, 16))


def title_of_slug(slug: Column) -> Column:
    """Parts between dashes, the first letter of each in upper case."""
    parts = F.filter(F.split(slug, "-"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), " ")


def episode_of_path(path: Column) -> Column:
    """Struct (season, episode) of the leftmost ``s01e02`` or ``1x02``; null without one."""
    part = lambda i: F.nullif(F.regexp_extract(path, EPISODE_MARK, i), F.lit("")).cast("int")
    season, episode = F.coalesce(part(1), part(3)), F.coalesce(part(2), part(4))
    return F.when(season.isNotNull(), F.struct(season.alias("season"), episode.alias("episode")))


def page_size_bytes(text: Column) -> Column:
    """Bytes of the first size in a page text, half a byte rounded up; null if
    there is none or it overflows."""
    unit = F.lower(F.regexp_extract(text, PAGE_SIZE_TEXT, 2))
    factor = F.lit(None).cast("decimal(13,0)")
    for name, n in PAGE_UNITS.items():
        factor = F.when(unit == name, F.lit(n).cast("decimal(13,0)")).otherwise(factor)
    value = F.translate(F.regexp_extract(text, PAGE_SIZE_TEXT, 1), ",", ".").try_cast("decimal(24,5)")
    return F.round(value * factor, 0).try_cast("bigint")


def magnet_link(info_hash: Column) -> Column:
    return F.concat(F.lit("magnet:?xt=urn:btih:"), F.upper(info_hash))


def parse_boolean(text: Column) -> Column:
    plain = F.lower(F.trim(text))
    return F.when(plain.isin(*TRUE_WORDS), F.lit(True)).when(plain.isin(*FALSE_WORDS), F.lit(False))


def truncated_error(text: Column) -> Column:
    return F.substring(text, 1, 1000)


def folded_query(text: Column) -> Column:
    """Search text with folded blanks; null if under 3 or over 200 characters
    or with control characters."""

    def checked(t: Column) -> Column:
        return F.when((F.length(t) >= 3) & (F.length(t) <= 200) & ~t.rlike(r"\p{Cntrl}"), t)

    return let(F.trim(F.regexp_replace(text, r"\s+", " ")), checked)


def chosen_sources(wanted: Column, configured: list[str]) -> Column:
    """Wanted sources without repeats, in order; all configured ones if none
    is wanted; null if one isn't configured."""
    known = F.array(*[F.lit(c) for c in configured]).cast("array<string>")
    asked = F.array_distinct(F.filter(F.transform(F.coalesce(wanted, F.array().cast("array<string>")), lambda w: F.trim(w)), lambda w: w != ""))
    return let(asked, lambda a: F.when(F.size(a) == 0, known).when(F.size(F.array_except(a, known)) == 0, a))


def rating_of_json(value: Column) -> Column:
    """Rating of a variant: a number, a numeric text, ``rating`` or a tenth of
    ``percentage`` of an object; clamped to 0 to 10."""
    number = F.coalesce(
        F.try_variant_get(value, "$", "double"),
        F.try_variant_get(value, "$.rating", "double"),
        F.try_variant_get(value, "$.percentage", "double") / 10,
    )
    return F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")), clamp_rating(number))
