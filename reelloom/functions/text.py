"""Text clean-up as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space here, invisible joiners and the byte-order mark included.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u200b\u200c\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
)


def strip_blanks(text: Column) -> Column:
    """``text`` without surrounding white space of any kind."""
    return F.btrim(text, F.lit(BLANKS))


def non_blank(text: Column) -> Column:
    """The stripped text, null where nothing is left."""
    return F.nullif(strip_blanks(text), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
