"""Keyword search over token arrays, with the web search grammar.

Words are ANDed, ``or`` joins alternatives, ``-word`` excludes, and a quoted
text is a run of tokens in order. A query is compiled to one column
expression; tokens are lower-case runs of letters and digits.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text, in order; a null text has none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda t: t != "")


def _query_tokens(text: str) -> list[str]:
    return [t for t in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if t]


def _phrase(column: Column, words: list[str]) -> Column:
    if len(words) == 1:
        return F.array_contains(column, words[0])
    run = " " + " ".join(words) + " "
    return F.concat(F.lit(" "), F.array_join(column, " "), F.lit(" ")).contains(run)


def matches(column: Column, query: str) -> Column:
    """Whether a token array satisfies ``query``; a query without terms
    matches nothing."""
    groups: list[list[Column]] = [[]]
    for negative, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not quoted and not negative and word.lower() == "or":
            groups.append([])
            continue
        words = _query_tokens(quoted or word)
        if words:
            term = _phrase(column, words)
            groups[-1].append(~term if negative else term)
    parts = [reduce(lambda a, b: a & b, g) for g in groups if g]
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
