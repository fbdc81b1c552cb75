"""One consistent form for text that looks alike but is made of different characters.

Method: the confusables skeleton. A text is decomposed (compatibility form), every character is replaced by the
prototype of its look-alike class, and the result is decomposed again; originals with equal skeletons are one group.
The prototypes are the published table of the Unicode standard (security mechanisms), read from the ICU library that comes with
Spark; small letters whose capitals have the prototype of a Latin capital share that of its small form, since names are
also compared in lower case.

The skeleton is for comparing. ``canonical`` is the usual form for reading, found by prototypes too: invisible and styled
characters and detached accents go, and a word's stray letters go over to the letter of the same prototype in the script of
the rest of the word. A value is disguised if its usual form is another string with the same skeleton.

Defined results: null stays null and empty stays empty; texts of any length are read whole; repeated rows give equal
results; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import unicodedata
import zipfile
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import cut

INVISIBLE = "\xad͏؜᠎​‌‍‎‏‪-‮⁠-⁤⁦-⁩﻿"
SPACES = "\xa0  -   　"
#: Compatibility forms that only differ in style: full-width and half-width signs, styled letters and digits, ligatures.
STYLED = "！-～￠-￦\U0001d400-\U0001d7ffﬀ-ﬆĲĳǄ-ǌǱ-ǳℂℊ-ℓℕℙ-ℝℤℨℬℭℯ-ℱℳℴℹ‐‑"
COMBINING = "̀-͇ͅ-ͯ"

_INVISIBLE, _SPACES, _STYLED = re.compile(f"[{INVISIBLE}]"), re.compile(f"[{SPACES}]"), re.compile(f"[{STYLED}]")
_DETACHED = re.compile(f"[^\\W\\d_][{COMBINING}]+")
_PLAIN = re.compile(f"[{INVISIBLE}{SPACES}{STYLED}{COMBINING}]")
_WORD = re.compile("[^\\W\\d_]+")
# The letters of Russian, and those of Cyrillic that other modern languages have besides.
RUSSIAN = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
NEIGHBOURS = "іїєґўђѓљњћќџјѕ"
#: Classes of characters for the screen.
FINDING, LATIN, CYRILLIC, GREEK, COMBINES, FOREIGN, RARE = 1, 2, 3, 4, 5, 6, 7


def confusables(jar: str | None = None) -> dict[str, str]:
    """The published table, character to prototype, from the data of the ICU library among Spark's jars."""
    if jar is None:
        import pyspark

        homes = [os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)]
        jars = [j for h in homes if h for j in sorted(glob.glob(os.path.join(h, "jars", "icu4j-*.jar")))]
        if not jars:
            raise FileNotFoundError("Spark's jars hold no ICU library; name one that has the table of confusables")
        jar = jars[0]
    with zipfile.ZipFile(jar) as z:
        raw = z.read(next(n for n in z.namelist() if n.endswith("/confusables.cfu")))
    data = raw[struct.unpack(">H", raw[:2])[0] :]
    # Layout: three (offset, count) pairs follow magic number, version and length: keys, their values, strings.
    keys_at, n, values_at, _, strings_at, _ = struct.unpack(">6i", data[12:36])
    out = {}
    for key, value in zip(struct.unpack_from(f">{n}I", data, keys_at), struct.unpack_from(f">{n}H", data, values_at)):
        length = (key >> 24) + 1
        at = strings_at + 2 * value
        out[chr(key & 0xFFFFFF)] = chr(value) if length == 1 else data[at : at + 2 * length].decode("utf-16-be", "surrogatepass")
    return out


class Look:
    """The tables of look-alikes: prototypes, and for each character the usual Latin and Russian letter of its class."""

    def __init__(self, table: dict[str, str]) -> None:
        self.table = dict(table)
        ascii_letters = "abcdefghijklmnopqrstuvwxyz"
        for c in map(chr, [*range(0x370, 0x400), *range(0x400, 0x530)]):
            up = c.upper()
            if c.islower() and len(up) == 1:
                of = table.get(up, up)
                own = table.get(c, c)
                if len(of) == 1 and of.isascii() and of.isupper() and not (len(own) == 1 and own.isascii() and own.isalpha()):
                    self.table[c] = table.get(of.lower(), of.lower())
        strict = {c: table.get(c, c) for c in (*ascii_letters, *ascii_letters.upper())}
        self.latin = self._letters([*ascii_letters, *ascii_letters.upper()])
        self.cyrillic = self._letters([*RUSSIAN, *RUSSIAN.upper()])
        by = set(strict.values())
        #: Letters that are those of Latin at the same size, not only as capitals.
        self.exact = {c for c, p in table.items() if p in by}
        self._of = str.maketrans(self.table)
        self.classes = np.zeros(0x20000, np.uint8)
        known = set(RUSSIAN + RUSSIAN.upper() + NEIGHBOURS + NEIGHBOURS.upper())
        for n in range(0x20000):
            if 0xD800 <= n < 0xE000:
                continue
            c = chr(n)
            if _PLAIN.match(c):
                self.classes[n] = COMBINES if re.match(f"[{COMBINING}]", c) else FINDING
            elif not c.isalpha() or c in "ªºµ":
                continue
            elif n < 0x250:
                self.classes[n] = LATIN
            elif 0x400 <= n < 0x530:
                self.classes[n] = CYRILLIC if c in known or c not in self.latin else RARE
            elif 0x370 <= n < 0x400:
                self.classes[n] = GREEK
            elif c in self.latin or c in self.cyrillic:
                self.classes[n] = FOREIGN
        self._mixed: dict[str, str | None] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_mixed": {}}

    def _letters(self, letters: list[str]) -> dict[str, str]:
        """Every character with the letter that shares its prototype, of the same case where there is one."""
        of: dict[str, list[str]] = {}
        for x in letters:
            of.setdefault(self.table.get(x, x), []).append(x)
        out = {}
        for c, p in self.table.items():
            if c.isalpha() and c not in letters and (same := of.get(p)):
                out[c] = next((x for x in same if x.isupper() == c.isupper()), same[0])
        for x in letters:
            out.pop(x, None)
        for p, same in of.items():  # letters that are their own prototype, as Latin a for Cyrillic а
            if len(p) == 1 and p.isalpha() and p not in letters:
                out[p] = next((x for x in same if x.isupper() == p.isupper()), same[0])
        return out

    def kind(self, c: str) -> int:
        n = ord(c)
        return int(self.classes[n]) if n < 0x20000 else 0

    def word(self, word: str) -> str | None:
        """The word in one script, if letters that look like its own are all that differs; else None."""
        if word in self._mixed:
            return self._mixed[word]
        if len(self._mixed) > 200_000:
            self._mixed.clear()
        got = self._mixed[word] = self._word(word)
        return got

    def _word(self, word: str) -> str | None:
        kinds = [self.kind(c) for c in word]
        lat, cyr, gre, foreign, rare = (kinds.count(k) for k in (LATIN, CYRILLIC, GREEK, FOREIGN, RARE))
        if (lat > 0) + (cyr + rare > 0) + (gre > 0) + (foreign > 0) < 2 or not lat + cyr:
            # One script throughout: only letters no modern alphabet has, among others that are all Latin to the eye, tell.
            return "".join(self.latin[c] for c in word) if rare and cyr and cyr + rare == len(word) and all(c in self.exact and c in self.latin for c in word) else None
        if 0 in kinds:
            return None
        to_latin = all(k == LATIN or c in self.latin for c, k in zip(word, kinds))
        to_cyrillic = all(k in (CYRILLIC, RARE) or c in self.cyrillic for c, k in zip(word, kinds))
        if to_latin and to_cyrillic and lat and cyr:
            # Both would do: the letters that go are those that look alike in both cases; else the fewer go.
            sure_latin = all(self.both(c) for c, k in zip(word, kinds) if k == CYRILLIC)
            sure_cyrillic = all(self.both(c) for c, k in zip(word, kinds) if k == LATIN)
            to_cyrillic = sure_cyrillic if sure_latin != sure_cyrillic else lat < cyr
        if to_latin and (not to_cyrillic or not cyr) and lat:
            return "".join(c if k == LATIN else self.latin[c] for c, k in zip(word, kinds))
        if to_cyrillic and cyr:
            return "".join(c if k in (CYRILLIC, RARE) else self.cyrillic[c] for c, k in zip(word, kinds))
        return None

    def both(self, c: str) -> bool:
        """Whether a letter and its other case look like a letter of the other script and its other case."""
        to = self.latin.get(c) or self.cyrillic.get(c)
        return to is not None and self.table.get(c.swapcase(), c.swapcase()) == self.table.get(to.swapcase(), to.swapcase())

    def suspicious(self, s: str) -> bool:
        n = np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)
        k = self.classes[np.where(n < 0x20000, n, 0)]
        if (k == FINDING).any() or (k == COMBINES).any() or (k == RARE).any():
            return True
        a, b = k[:-1], k[1:]
        return bool(((a >= LATIN) & (b >= LATIN) & (a != b)).any())

    def canonical(self, s: str | None) -> str | None:
        """s in its one consistent form; a text without findings comes back as it is."""
        if not s or not self.suspicious(s):
            return s
        t = _INVISIBLE.sub("", _SPACES.sub(" ", s))
        t = _STYLED.sub(lambda m: unicodedata.normalize("NFKC", m[0]) if m[0] not in "‐‑" else "-", t)
        t = _DETACHED.sub(lambda m: unicodedata.normalize("NFC", m[0]), t)
        return _WORD.sub(lambda m: self.word(m[0]) or m[0], t)

    def disguised(self, s: str | None) -> bool:
        """Whether s is not its usual form but looks the same: both have one skeleton."""
        usual = self.canonical(s)
        return usual != s and self.skeleton(usual) == self.skeleton(s)

    def skeleton(self, s: str | None) -> str | None:
        """The prototype string that all texts looking like s share."""
        if s is None:
            return None
        t = unicodedata.normalize("NFKD", _SPACES.sub(" ", s))
        return unicodedata.normalize("NFKD", _INVISIBLE.sub("", t).translate(self._of))


@lru_cache(1)
def look() -> Look:
    return Look(confusables())


def canonical(s: str | None) -> str | None:
    return look().canonical(s)


def disguised(s: str | None) -> bool:
    return look().disguised(s)


def skeleton(s: str | None) -> str | None:
    return look().skeleton(s)


def _row_wise(f, kind: T.DataType):
    """A vectorised function over a text column; the tables, of fixed size, travel with it."""
    return F.pandas_udf(lambda values: values.map(f, na_action="ignore"), kind)


def is_disguised(c):
    return F.coalesce(_row_wise(look().disguised, T.BooleanType())(c), F.lit(False))


def canonical_of(c):
    return _row_wise(look().canonical, T.StringType())(c)


def skeleton_of(c):
    return _row_wise(look().skeleton, T.StringType())(c)


def unify(df: DataFrame, column: str, into: str = "canonical") -> DataFrame:
    """df with the consistent form of a column in ``into``; row-wise, no shuffle."""
    return df.withColumn(into, canonical_of(F.col(column)))


def look_alike_groups(df: DataFrame, column: str, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, group_id, value, records, forms): each distinct value of the column with how many records hold it and how many
    distinct values share its skeleton; groups do not reach across the columns ``within``. Values are counted before the skeleton is
    taken, so a value held by a third of all rows is one row from then on; the skeleton travels as its 128-bit hash. The
    values are cut with their hashes: counting the forms reads the hashes alone."""
    values = df.where(F.col(column).isNotNull()).groupBy(*within, F.col(column).alias("value")).agg(F.count("*").alias("records"))
    keyed = cut(values.withColumn("group_id", F.md5(skeleton_of("value"))), "skeletons")
    forms = keyed.groupBy(*within, "group_id").agg(F.count("*").alias("forms"))
    return keyed.join(forms, [*within, "group_id"]).select(*within, "group_id", "value", "records", "forms")
