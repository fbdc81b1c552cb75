"""Text analysis: alphanumeric runs, lower case, folding, stems. The same rules index texts and read queries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import stem as stemmers

#: Tokens of so many bytes and more are not indexed.
LONG = 60
_RUN = re.compile(r"[^\W_]+")
_RUN_MARKS = regex.compile(r"[\p{Alphabetic}\p{N}]+")
#: Scripts in which marks belong to the alphabet; for all others letters and figures are what \\w knows.
_MARKED = re.compile("[\u0345\u0363-\u036f\u0590-\u1fff\u24b6-\u24e9\u2de0-\u2dff\u3000-\U0010ffff]")


def runs(text: str) -> list[str]:
    """Maximal runs of letters and figures. Scripts whose vowel signs are marks need the slower expression."""
    return _RUN_MARKS.findall(text) if _MARKED.search(text) else _RUN.findall(text)


@lru_cache(500_000)
def _normal(token: str, stem: bool) -> str:
    t = token.lower()
    cyrillic = latin = other = False
    for c in t:
        if "Ѐ" <= c <= "ӿ":
            cyrillic = True
        elif c.isascii() and c.isalpha():
            latin = True
        else:
            other = True
    if cyrillic:
        t = t.replace("ё", "е")
    if not stem or other or cyrillic and latin:
        return t
    if cyrillic:
        s = stemmers.russian(t)
    elif len(t) >= 3:
        s = stemmers.english(t)
    else:
        return t
    # A stem as long as the word is not used.
    return s if len(s) != len(t) else t


def analyse(text: str | None, stem: bool = True) -> list[tuple[int, str]]:
    """(position, term) of every token kept; dropped tokens leave their position empty."""
    if not text:
        return []
    return [(i, _normal(t, stem)) for i, t in enumerate(runs(text)) if len(t) < LONG // 4 or len(t.encode()) < LONG]


def terms(text: str, stem: bool = True) -> list[str]:
    return [t for _, t in analyse(text, stem)]


def postings(text: str | None, stem: bool) -> Iterator[tuple[str, list[int]]]:
    at: dict[str, list[int]] = {}
    for i, t in analyse(text, stem):
        at.setdefault(t, []).append(i)
    yield from at.items()


def tokens(text: Column) -> Column:
    """The unstemmed terms of a text as a column expression, for counting without an index."""
    kept = F.filter(F.regexp_extract_all(text, F.lit(r"([\p{IsAlphabetic}\p{N}\x{0345}\x{0363}-\x{036F}]+)"), F.lit(1)), lambda t: F.octet_length(t) < LONG)
    return F.transform(kept, lambda t: F.translate(F.lower(t), "ё", "е"))


def osa(a: str, b: str, limit: int) -> int:
    """Edits between a and b, a swap of neighbours counting one; anything above the limit as limit + 1."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > limit and (not last or min(last) > limit):
            return limit + 1
        before, last = last, row
    return min(last[-1], limit + 1)
