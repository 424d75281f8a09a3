"""Size texts and unit names to bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelloom.functions.text import let

# Multiples of a byte by prefix letter; an i after the letter makes it binary.
PREFIX_POWER = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4, "p": 5}
# Cyrillic unit letters and their Latin counterparts.
CYRILLIC_UNITS = ("кмгтби", "kmgtbi")

_SPACE = r"[\s    ]"
_GROUPED = rf"\d{{1,3}}(?:(?:[,.'’]|{_SPACE})\d{{3}})+"
_NUMBER = rf"(?:{_GROUPED}(?:[.,]\d+)?|\d+(?:[.,]\d+)?)"
_PREFIXED = r"([kmgtp]?)(i?)(b|o|bytes?|octets?)"
SIZE_PATTERN = rf"(?<![\p{{L}}\d.,])({_NUMBER}){_SPACE}*{_PREFIXED}(?![\p{{L}}\d])"
# In a name a blank separates; the greedy start makes the last statement count.
_NAME_NUMBER = r"\d{1,3}(?:[,.]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?"
NAME_PATTERN = rf"(?s)^.*(?<![\p{{L}}\d.,])({_NAME_NUMBER}){_SPACE}*([kmgtp])(i?)(b|o|bytes?|octets?)(?![\p{{L}}\d])"


def _plain(text: Column) -> Column:
    return F.translate(F.lower(text), *CYRILLIC_UNITS)


def _number(text: Column) -> Column:
    """The decimal number a text means.

    Blanks and apostrophes group digits. If comma and point both occur the
    last is the decimal mark; one that occurs twice groups digits; a lone one
    is the decimal mark.
    """

    def chosen(bare: Column) -> Column:
        without_commas, without_points = F.translate(bare, ",", ""), F.translate(bare, ".", "")
        commas = F.length(bare) - F.length(without_commas)
        points = F.length(bare) - F.length(without_points)
        last_is_comma = F.instr(F.reverse(bare), ",") < F.instr(F.reverse(bare), ".")
        return (
            F.when((commas > 0) & (points > 0), F.when(last_is_comma, F.translate(without_points, ",", ".")).otherwise(without_commas))
            .when(commas > 1, without_commas)
            .when(points > 1, without_points)
            .otherwise(F.translate(bare, ",", "."))
        )

    return let(F.regexp_replace(text, rf"{_SPACE}|['’]", ""), chosen).try_cast("decimal(20,6)")


def _factor(prefix: Column, binary: Column) -> Column:
    power = F.lit(None).cast("int")
    for letter, n in PREFIX_POWER.items():
        power = F.when(prefix == letter, F.lit(n)).otherwise(power)
    base = F.when(binary == "i", F.lit(1024.0)).otherwise(F.lit(1000.0))
    return F.pow(base, power).try_cast("decimal(17,0)")


def _bytes(text: Column, pattern: str) -> Column:
    def stated(plain: Column) -> Column:
        part = lambda i: F.regexp_extract(plain, pattern, i)
        amount = _number(part(1)) * _factor(part(2), part(3))
        return F.when(part(4) != "", F.round(amount, 0).try_cast("bigint"))

    return let(_plain(text), stated)


def size_text_bytes(text: Column) -> Column:
    """Bytes stated by a size text, half a byte rounded up; null if it states none."""
    return _bytes(text, SIZE_PATTERN)


def name_bytes(name: Column) -> Column:
    """Bytes stated in a release name; the unit must have a prefix letter, and
    the last statement counts."""
    return _bytes(name, NAME_PATTERN)


def declared_factor(unit: Column) -> Column:
    """Bytes per unit of a declared unit name, e.g. ``KiB``, ``MB (10^6)``,
    ``octets``; null if it names no unit."""
    head = r"^\W*([kmgtp]?)(i?)(b|o|bytes?|octets?)(?![\p{L}])"
    word = r"^\W*([kmgtp])(?:ilo|ega|iga|era|eta|([ieb])bi)-?(?:bytes?|octets?)(?![\p{L}])"
    plain = _plain(unit)
    said_binary = plain.rlike(r"2\s*\^|1024|1048576|binary")
    binary = lambda found: F.when((found != "") | said_binary, F.lit("i")).otherwise(F.lit(""))
    short = F.when(
        F.regexp_extract(plain, head, 3) != "",
        _factor(F.regexp_extract(plain, head, 1), binary(F.regexp_extract(plain, head, 2))),
    )
    spelt = F.when(
        F.regexp_extract(plain, word, 1) != "",
        _factor(F.regexp_extract(plain, word, 1), binary(F.regexp_extract(plain, word, 2))),
    )
    return F.coalesce(short, spelt)
