"""Release names and titles in one comparable form."""

from __future__ import annotations

import re
import unicodedata

# Words that open a title and don't tell works apart.
ARTICLES = ("the", "der", "die", "das", "le", "la", "les", "el", "los", "las", "l", "il", "lo", "gli")
# Number words and Roman numerals of sequels.
ROMAN = {"ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}
SPELT = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "i": 1, "first": 1, "second": 2, "third": 3, "eins": 1, "zwei": 2, "drei": 3, "deux": 2, "trois": 3, "dos": 2, "tres": 3,
}
PART = ("part", "pt", "teil", "partie", "parte", "chapter", "chapitre", "capitulo", "kapitel", "vol", "volume", "часть", "chast", "episode")
# Cyrillic letters and how release names write them.
LATIN = dict(
    zip(
        "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ",
        "a b v g d e zh z i y k l m n o p r s t u f h ts ch sh sch  y  e yu ya e i i e g".split(" "),
    )
)
_SIZE = re.compile(r"[\s._]*[\[({|–-]?\s*\d+(?:[.,]\d+)?[\s._]?[kmgt]i?[bo]\s*[\])}]?\s*$", re.I)
_EXTENSION = re.compile(r"\.(?:mkv|mp4|avi|m4v|mov|ts|m2ts|webm|wmv|mpg|mpeg)\s*$", re.I)
_GROUP = re.compile(r"^\s*\[[^\]]{0,40}\]\s*")
_SERIES = re.compile(
    r"\bs\d{1,3}(?:\s?e\d{1,4})?(?:-?e\d{1,4})?\b|\b\d{1,2}x\d{2,3}\b|\bseasons? \d{1,3}\b|\b(?:staffel|saison|temporada|сезон) \d{1,3}\b|\be(?:p)?\d{2,4}\b| - \d{2,3}(?=[ (\[]|$)|\bcomplete series\b",
)
_QUALITY = re.compile(
    r"[\[(]?\b(?:\d{3,4}[pi]|4k|8k|uhd|web(?:[ -]?dl|[ -]?rip)?|hdtv|pdtv|blu-?ray|b[dr]rip|dvd(?:rip|scr)?|remux|[xh] ?26[45]|hevc|av1|xvid|divx|aac|ac3|dts|flac|atmos|ddp? ?\d)\b",
)
_YEAR = re.compile(r"(?<![\d.])(?:19|20)\d\d(?![\dp])")
_SPLIT = re.compile(r"\s+(?:aka|a k a)\s+|\s*/\s*|\s*\|\s*")
_WORD = re.compile(r"[^\W_]+")


def one_off(word: str) -> set[str]:
    """All texts one typed slip away from a word."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {
        *(a + b[1:] for a, b in cuts if b),
        *(a + c + b[1:] for a, b in cuts if b for c in letters),
        *(a + c + b for a, b in cuts for c in letters),
        *(a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1),
    }


# Slips in "the"; shorter or foreign ones meet real words.
SLIPPED = {w for w in one_off("the") if len(w) > 1} - {"she", "he", "tie", "toe", "then", "them", "they"} | set(ARTICLES)


_known: dict[str, str] = {}


def _plain(word: str) -> str:
    """A word in lower-case Latin letters without marks."""
    plain = _known.get(word)
    if plain is None:
        if len(_known) > 100_000:
            _known.clear()
        plain = _known[word] = _latin(word)
    return plain


def _latin(word: str) -> str:
    text = unicodedata.normalize("NFKD", word.lower())
    if not text.isascii():
        # й and ё are letters of their own, not marked ones.
        text = "".join(LATIN.get(c, c) for c in unicodedata.normalize("NFC", "".join(c for c in text if not unicodedata.combining(c) or c in "̆̈")))
        text = "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("ł", "l")) if not unicodedata.combining(c))
    return text


def words_of(text: str) -> list[str]:
    text = text.replace("’", "").replace("'", "").replace("ʼ", "").replace("`", "").replace("´", "").replace("&", " and ").replace("+", " and ")
    return [p for w in _WORD.findall(text) if (p := _plain(w))]


def title_form(words: list[str]) -> tuple[str, int]:
    """Words without articles and sequel marks, and the sequel number, 1 if
    none is given."""
    kept, number, i = [], 1, 0
    while i < len(words):
        w = words[i]
        after = words[i + 1] if i + 1 < len(words) else ""
        if w in PART and kept and (after.isdigit() or after in ROMAN or after in SPELT):
            number = int(after) if after.isdigit() else ROMAN.get(after) or SPELT[after]
            i += 1
        elif kept and (w in ROMAN or w.isdigit() and len(w) < 3):
            number = ROMAN.get(w) or int(w)
        elif w not in ARTICLES:
            kept.append(w)
        i += 1
    for end in (0, -1):
        if len(kept) > 1 and kept[end] in SLIPPED:
            kept.pop(end)
    return " ".join(kept), number


def parse_release(name: str) -> tuple[list[tuple[str, int]], int | None, str]:
    """Title forms, year and kind of a release name.

    The title ends at the first season or episode mark, picture or sound term,
    or year that isn't its first word. Titles joined by AKA, slash or bar are
    alternatives; so is the whole.
    """
    text = name.strip()
    # A size or an extension can only stand at the end.
    for pattern, reach, ends in ((_SIZE, 24, "boBO])}"), (_EXTENSION, 6, "")):
        found = (not ends or text[-1:] in ends) and pattern.search(text, max(0, len(text) - reach))
        if found:
            text = text[: found.start()]
    if text.startswith("["):
        text = _GROUP.sub("", text)
    flat = text.replace("_", " ").replace(".", " ").lower()
    series = _SERIES.search(flat)
    cut = series.start() if series else len(flat)
    for m in _QUALITY.finditer(flat):
        if m.start():
            cut = min(cut, m.start())
            break
    years = [m for m in _YEAR.finditer(flat) if m.start() > 0]
    before = [m for m in years if m.start() <= cut and flat[: m.start()].strip(" ([-")]
    year = before[-1] if before else next(iter(years), None)
    if before:
        cut = min(cut, year.start())
    return _titles_of(flat[:cut].strip()), int(year.group()) if year else None, "tv_show" if series else "movie"


_forms: dict[str, list[tuple[str, int]]] = {}


def _titles_of(title: str) -> list[tuple[str, int]]:
    """Forms of a title and of its alternatives; many names share a title."""
    forms = _forms.get(title)
    if forms is None:
        parts = [p for p in _SPLIT.split(title) if p.strip()] if "/" in title or "|" in title or " a" in title else [title]
        made = [title_form(words_of(p)) for p in dict.fromkeys([*parts, title])]
        if len(_forms) > 200_000:
            _forms.clear()
        forms = _forms[title] = [f for f in dict.fromkeys(made) if f[0]]
    return forms


def work_forms(title: str | None, original: str | None) -> list[tuple[str, int]]:
    """Forms of a work's titles, each alone and both in a row."""
    a, b = words_of(title or ""), words_of(original or "")
    ways = [a, b, a + b, b + a] if a and b and a != b else [a or b]
    return [f for f in dict.fromkeys(map(title_form, ways)) if f[0]]


def slips(a: str, b: str, most: int) -> int:
    """Letters added, lost, exchanged or swapped with a neighbour; ``most + 1``
    stands for more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


MOST_SLIPS = 2


def title_distance(record: str, work: str) -> int:
    """Slips between two forms, word by word; ``MOST_SLIPS + 1`` if they are
    different titles. A word may hold one slip, a long one two."""
    if record == work:
        return 0
    a, b = record.split(), work.split()
    if len(a) != len(b):
        return MOST_SLIPS + 1
    total = 0
    for x, y in zip(a, b):
        if x != y:
            n = slips(x, y, 2 if min(len(x), len(y)) >= 5 else 1)
            if n > (2 if min(len(x), len(y)) >= 5 else 1):
                return MOST_SLIPS + 1
            total += n
    return min(total, MOST_SLIPS + 1)
