"""Info hashes in their several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelloom.functions.text import let, strip_blanks

# The base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_to_hex(text: Column) -> Column:
    """40 lower-case hex characters of 32 base32 characters.

    Eight characters are 40 bits, ten hex digits; each group of eight is one
    number.
    """

    def group(eight: Column) -> Column:
        digits = F.filter(F.split(eight, ""), lambda c: c != "")
        value = F.aggregate(
            digits, F.lit(0).cast("bigint"), lambda total, c: total * 32 + F.instr(F.lit(BASE32), c) - F.lit(1)
        )
        return F.lpad(F.lower(F.hex(value)), 10, "0")

    starts = F.array(*[F.lit(8 * g + 1) for g in range(4)])
    return let(text, lambda t: F.array_join(F.transform(starts, lambda s: group(F.substring(t, s, F.lit(8)))), ""))


def _normalized(text: Column) -> Column:
    return F.when(F.length(text) == 40, F.when(text.rlike("^[0-9A-Fa-f]{40}$"), F.lower(text))).when(
        F.length(text) == 32, F.when(text.rlike("^[A-Za-z2-7]{32}$"), base32_to_hex(F.upper(text)))
    )


def normalize_info_hash(raw: Column) -> Column:
    """40 lower-case hex characters of a hash in hex or base32, in any case,
    after trimming; null if it is neither."""
    return let(strip_blanks(raw), _normalized)


def hash_of_delivery(raw: Column) -> Column:
    """Hash of a field that holds a bare hash or a magnet link.

    In a link, the first ``xt=urn:btih:`` parameter counts; its value may be
    percent-encoded.
    """

    def found(text: Column) -> Column:
        value = F.regexp_extract(text, r"(?i)[?&]xt=urn(?::|%3a)btih(?::|%3a)([^&#]*)", 1)
        link = (F.length(text) > 40) & F.lower(F.substring(text, 1, 7)).eqNullSafe("magnet:")
        return F.when(link, let(value, _normalized)).otherwise(_normalized(text))

    return let(strip_blanks(raw), found)
