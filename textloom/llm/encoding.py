"""Garbled text from wrong character encodings: detection and repair.

Method: best-first graph search. A node is a string, an edge re-encodes it in one character set and decodes the
bytes in another, or undoes an escape. Visited strings are kept by hash; a plausibility cost over characters and
their neighbours orders the open nodes, and the cheapest string reached wins. A search expands ``NODES`` nodes of at most
``DEPTH`` steps, whatever the length of the value.

Every suspicious token of a value is searched, however many there are. Tokens fall into classes by what they can be
(which sets make UTF-8 of them, which scripts they hold); tokens of a class are searched together, those the path found
does not make clean are searched again without the others, at last each by itself. A token then takes the cheapest of
all paths found for the value, so a value damaged in several ways is repaired in each. What a path makes of its tokens
must be plausible as text (letters as frequent as their language has them, common ideographs); otherwise the
restoration is withheld and the value keeps its form, though it is a case.

Defined results: null and empty values are no case and come back unchanged; values of any length are read whole;
repeated rows give equal results; extra columns are kept by ``repair`` and never clash (its results are one struct
column whose name the caller picks). Loss marks (U+FFFD, question marks in place of letters) are a case whose
text stays as it is.
"""

from __future__ import annotations

import heapq
import html
import re
import urllib.parse
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import ne

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of Western European languages with a mark, as correct text has them.
ACCENTED = "àâáãäåæçèéêëìíîïñòóôõöøùúûüýÿßœšžÀÂÁÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸŒŠŽ"
USUAL = "àâáãäåçèéêëíîïñóôöøùúûüßœÀÂÁÃÄÅÇÈÉÊËÍÎÏÑÓÔÖØÙÚÛÜŒ"
TYPOGRAPHIC = "“”„«»—–…’‘№€£°²³½™·¿¡§•"
# Characters that single-byte character sets put where letters belong, and that correct text here does not use.
ODD = "ĂĹĽĐŃ\x80-\x9f\ufffd\u2500-\u259fЂЃѓЉЊЌЋЏђљњќћџҐґЈјЅѕЎўЄєЇїІі‡†‰ˆ˜ŠšŽž¤¦¨¯±´µ¶¸¼¾¢¥×÷ÐðÞþ√≈≤≥∙⌠⌡⌐ⁿ∞∂∑∏∆π∫◊ƒ‹›©®ıłŁˇ˘˙˚˝˛∩⌂"
_LOW, _UP, _LAT = "а-яё", "А-ЯЁ", "A-Za-z"
_ACC = "".join(c for c in ACCENTED if c != "ß")
_ACC_UP = "".join(c for c in _ACC if c.isupper())
INVISIBLE = dict.fromkeys(map(ord, "\xad\u200b\u200c\u200d\u2060\ufeff"))

#: A token without a match of this has nothing to search for.
SUSPECT = re.compile(
    f"[{ODD}]|[{_ACC}]{{2}}|[{_ACC}][0-9]|[a-z][{_ACC_UP}]|[{_ACC}][A-Z]"
    f"|[{_LOW}][{_UP}]|[{_UP}]{{4}}|[{_LAT}{_ACC}][{_LOW}{_UP}]|[{_LOW}{_UP}][{_LAT}{_ACC}]"
    f"|[{_LAT}{_LOW}{_UP}][Α-ω]|[Α-ω][{_LAT}{_LOW}{_UP}]"
    f"|\\?\\?|\\?[{_LAT}{_LOW}{_UP}]"
    f"|[–—][^\\s–—-]?[–—]|[{_LOW}{_UP}{_LAT}{_ACC}][¡¿£§°€„]|¬[{_LAT}{_LOW}{_UP}]"
    "|(?:%[0-9A-Fa-f]{2}){2}|(?:=[0-9A-F]{2}){2}|&#?\\w{2,8};|\\\\u[0-9a-fA-F]{4}"
)
_ESCAPES = re.compile("(?:%[0-9A-Fa-f]{2}){2}|(?:=[0-9A-F]{2}){2}|&#?\\w{2,8};|\\\\u[0-9a-fA-F]{4}")


@lru_cache(None)
def _screen() -> tuple[np.ndarray, np.ndarray]:
    """Class of every BMP character, and which pairs of classes ask for a closer look: SUSPECT as table look-ups."""
    of = np.zeros(65536, np.uint8)

    def put(n: int, chars: str) -> None:
        for m in re.compile(f"[{chars}]").finditer("".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))):
            of[ord(m[0])] = n

    for n, chars in enumerate(("a-z", "A-Z", _LOW, _UP, "".join(c for c in _ACC if c.islower()), _ACC_UP, ODD, "?", "–—", "Α-ω", "¡¿£§°€„", "¬", "%=&\\\\", "\\s", "0-9"), 1):
        put(n, chars)
    bad = np.zeros((16, 16), bool)
    bad[7, :] = bad[:, 7] = bad[9, 9] = bad[8, 8] = bad[1, 6] = bad[3, 4] = True
    for i in (5, 6):
        bad[i, [5, 6, 2, 15]] = True
    for i in (1, 2, 5, 6):
        bad[i, [3, 4]] = bad[[3, 4], i] = True
    for i in (1, 2, 3, 4):
        bad[i, 10] = bad[10, i] = bad[8, i] = bad[12, i] = True
    bad[1:7, 11] = True
    of[65535] = 0
    return of, bad.ravel()


def suspicious(s: str) -> bool:
    """Whether s holds anything SUSPECT looks for; one vectorised pass over its code points."""
    of, bad = _screen()
    n = np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)
    k = of.take(n, mode="clip")  # what lies beyond the basic plane has the class of its last character, which is none
    if len(k) < 2:
        return bool(len(k)) and bool(k[0] == 7)
    if bad.take(k[:-1] * np.uint8(16) + k[1:]).any():
        return True
    d = np.flatnonzero(k == 9)
    if len(d) > 1 and any(b - a == 2 and k[a + 1] != 14 for a, b in zip(d.tolist(), d[1:].tolist())):
        return True
    u = k == 4
    v = u[:-1] & u[1:]
    if (v[:-2] & v[2:]).any():
        return True
    return bool((k == 13).any()) and _ESCAPES.search(s) is not None


_TOKEN = re.compile(r"[^ \n\t\r\f]+")
_LOSS = re.compile(r"�")
_MARKS = re.compile(f"\\?{{3,}}|(?<![^ \\n\\t\\r\\f«“„(\"])\\?{{2,}}(?=[ \\n,.;:-]|$)|[{_LAT}]\\?[{_LAT}]|(?<![^\\s«“„(\"-])\\?[a-zа-я]{{2}}")


def _table(codec: str, undefined: bool = True) -> tuple[str, dict[str, int]]:
    """Decode table of a one-byte character set; bytes it leaves undefined pass through as C1 controls."""
    chars = []
    for i in range(256):
        try:
            chars.append(bytes([i]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(i) if undefined else "￾")
    return "".join(chars), {c: i for i, c in enumerate(chars)}


# The character sets text of these languages has been stored in; those of Central Europe, Greece and Turkey;
# those that take several bytes a character.
BASE = ("cp1252", "cp1251", "cp866", "koi8-r", "mac-cyrillic", "mac-roman", "cp437", "cp850", "iso8859-5", "latin-1")
FURTHER = ("cp1250", "iso8859-2", "cp852", "cp1253", "cp1254")
WIDE = ("shift_jis", "gbk", "big5", "euc_jp", "euc_kr")
#: Sets as which text of FURTHER and WIDE is usually misread.
_READ_AS = ("latin-1", "cp1252", "cp1251")
DEPTH, NODES = 3, 12


@lru_cache(None)
def _codecs() -> dict[str, tuple[str, dict[str, int]]]:
    return {c: _table(c) for c in BASE + FURTHER}


def _targets(e: str) -> tuple[str, ...]:
    """The sets the bytes of a string encoded in ``e`` may really be in."""
    if e in FURTHER:
        return ("utf-8",)
    return ("utf-8", *BASE, *(FURTHER + WIDE if e in _READ_AS else ()))


def _encode(s: str, codec: str) -> bytes | None:
    to = _codecs()[codec][1]
    try:
        return bytes([to[c] for c in s])
    except KeyError:
        return None


def _decode(b: bytes, codec: str) -> str | None:
    if codec == "utf-8" or codec in WIDE:
        try:
            return b.decode(codec)
        except UnicodeDecodeError:
            return None
    return b.decode("latin-1").translate(_decode_map(codec))


@lru_cache(None)
def _decode_map(codec: str) -> dict[int, str]:
    return dict(enumerate(_codecs()[codec][0]))


def _unescape(s: str) -> Iterator[tuple[str, str]]:
    if "&" in s:
        yield "html", html.unescape(s)
    if "%" in s:
        try:
            yield "percent", urllib.parse.unquote(s, errors="strict")
        except UnicodeDecodeError:
            pass
    if "\\u" in s:
        yield "backslash", re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), s)
    if "=" in s and s.isascii():
        try:
            yield "quoted", re.sub("(?:=[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("=", "")).decode("utf-8"), s)
        except UnicodeDecodeError:
            pass


# Classes of characters for the cost: A ascii letter lower, U upper, C/D Cyrillic lower/upper, L/M accented lower/upper,
# G Greek, V/W lower/upper letter of Ukrainian or Belarusian, E Central European, d digit, s space, p punctuation, t typographic, o other letter, j kana, common ideograph or
# Hangul, r rare ideograph, x odd, b box, k control or loss.
@lru_cache(100_000)
def _class(c: str) -> str:
    n = ord(c)
    if n < 128:
        return "A" if "a" <= c <= "z" else "U" if "A" <= c <= "Z" else "d" if c.isdigit() else "s" if c.isspace() else "q" if c == "?" else "p"
    if "а" <= c <= "я" or c == "ё":
        return "C"
    if "А" <= c <= "Я" or c == "Ё":
        return "D"
    if c in "іїєґў":
        return "V"
    if c in "ІЇЄҐЎ":
        return "W"
    if n == 0xFFFD or 0x80 <= n < 0xA0:
        return "k"
    if c in USUAL:
        return "L" if c.islower() else "M"
    if c in TYPOGRAPHIC:
        return "t"
    if 0x2500 <= n < 0x25A0:
        return "b"
    if 0x370 <= n < 0x400:
        return "G"
    if 0x600 <= n < 0x2000 and c.isalpha():
        return "o"
    if c in CENTRAL:
        return "E"
    if 0x3001 <= n < 0x3020 or n in (0xFF01, 0xFF08, 0xFF09, 0xFF0C, 0xFF1A, 0xFF1B, 0xFF1F):
        return "p"
    if 0x3041 <= n < 0x3100:
        return "j"
    if n >= 0x3100 and c.isalpha():
        return "r" if n > 0xFF00 or not _common(c) else "j"
    if n in INVISIBLE:
        return "p"
    return "x"


# Letters with a mark of the languages of Central Europe and of Turkish.
CENTRAL = "ąćęłńśźżčďěňřťůžšőűășțđğışİĄĆĘŁŃŚŹŻČĎĚŇŘŤŮŐŰŠŽ"


def _common(c: str) -> bool:
    """Whether an ideograph or syllable is of the first level of a national set, which holds the common ones."""
    for codec, low, high in (("gb2312", 0xB0, 0xD7), ("euc_jp", 0xB0, 0xCF), ("euc_kr", 0xB0, 0xC8), ("big5", 0xA4, 0xC6)):
        try:
            b = c.encode(codec)
        except UnicodeEncodeError:
            continue
        if len(b) == 2 and low <= b[0] <= high:
            return True
    return False


class _Classes(dict):
    def __missing__(self, n: int) -> str:
        c = self[n] = _class(chr(n))
        return c


_CLASSES = _Classes()
_COST = {"A": 1.0, "U": 1.0, "C": 1.0, "D": 1.0, "d": 1.0, "s": 1.0, "p": 1.1, "q": 1.3, "t": 1.65, "L": 1.5, "M": 1.6, "G": 2.2, "V": 2.4, "W": 2.4, "E": 2.6, "o": 1.2, "j": 2.4, "r": 6.0, "x": 4.0, "b": 5.0, "k": 9.0}
# What two classes in a row cost, as (first, second, cost).
_TURNS = (
    ("ACLV", "UDMW", 3.0),  # a capital inside a word
    ("AULM", "CDVW", 3.0), ("CDVW", "AULM", 3.0), ("AULMCD", "G", 3.0), ("G", "AULMCD", 3.0),  # change of script inside a word
    ("LM", "LM", 1.8),  # accented letters in a row
    ("tx", "tx", 1.0),
    ("LMx", "d", 3.0),  # a letter with a mark before a figure
)
_LONE = re.compile("(?<![a-zA-Z])M(?=[A-Z]|$)")
_INNER = re.compile("[AUCDLM](?=t(?=[AUCDLM]))")


class _Pairs(dict):
    def __missing__(self, pair: tuple[str, str]) -> float:
        v = self[pair] = float(sum(c for a, b, c in _TURNS if pair[0] in a and pair[1] in b))
        return v


class _Zero(dict):
    def __missing__(self, key) -> float:
        return 0.0


_PAIRS = _Pairs()
# How often the letters of Russian occur, in per mille.
_RU = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 2, 1, 4)))
_RARE = _Zero({c: round(max(0.0, 1.6 - 0.35 * (n**0.5)), 2) for c, n in _RU.items()})
_CONSONANTS = re.compile("[бвгджзйклмнпрстфхцчшщъь]{4,}|[аеёиоуыэюя]{4,}", re.I)


def cost(s: str) -> float:
    """Implausibility of s as text: a sum over its characters and over neighbours that correct text does not put together."""
    k = s.translate(_CLASSES)
    total = sum(map(_COST.__getitem__, k)) + sum(map(_PAIRS.__getitem__, zip(k, k[1:])))
    if "M" in k:
        total += 0.5 * len(_LONE.findall(k))
    if "t" in k:
        total += 0.4 * len(_INNER.findall(k))
    if "C" in k or "D" in k:
        total += sum(map(_RARE.__getitem__, s.lower())) + 2.0 * len(_CONSONANTS.findall(s))
    if "o" in k:
        # Letters of several scripts in a row are what UTF-8 makes of other bytes.
        others = [ord(c) >> 7 for c, x in zip(s, k) if x == "o"]
        total += 4.0 * sum(map(ne, others, others[1:]))
    return total


#: What a step to a set of several-byte characters, or to one of the further sets, costs at once: a few accented letters must
#: not become ideographs or rarer accented letters.
_STEP = dict.fromkeys(WIDE, 6.0) | dict.fromkeys(FURTHER, 3.0)


def search(s: str, depth: int = DEPTH, nodes: int = NODES) -> tuple[str, tuple[tuple[str, str], ...], float]:
    """The cheapest string reachable from s, the operations that lead to it, and its cost."""
    best = (cost(s), s, ())
    start = best[0]
    heap = [(start, 0, s, ())]
    seen = {hash(s)}
    expanded = 0
    while heap and expanded < nodes:
        at, n, text, path = heapq.heappop(heap)
        if at > start * 1.25 + 4 or best[2] and _clean(best[1], best[0]):
            break
        expanded += 1
        if len(path) >= depth:
            continue
        nexts = list(_unescape(text))
        done: set[bytes] = set()
        for e in _codecs():
            raw = _encode(text, e)
            if raw is None or raw in done:
                continue
            done.add(raw)
            for d in _targets(e):
                if d != e and (t := _decode(raw, d)) is not None:
                    nexts.append(((e, d), t))
        for op, t in nexts:
            if hash(t) in seen:
                continue
            seen.add(hash(t))
            c = cost(t) + _STEP.get(op[1], 0.0) + 3.0 * max(0, t.count("\xad") - s.count("\xad"))  # no letter becomes invisible
            c += 0.01 * len(path)  # of equal texts the one fewer steps away
            if c < best[0]:
                best = (c, t, (*path, op))
            heapq.heappush(heap, (c, len(seen), t, (*path, op)))
    return best[1], best[2], best[0]


def _clean(s: str, c: float) -> bool:
    return c <= 1.3 * len(s) and not _BAD.search(s.translate(_CLASSES))


_BAD = re.compile("[xbkr]|[ACL](?=[UDM])|[AULM](?=[CDG])|[CDG](?=[AULM])|[LM](?=[LM])")


def apply(s: str, path: tuple) -> str | None:
    for op in path:
        if isinstance(op, str):
            got = dict(_unescape(s))
            if op not in got:
                return None
            s = got[op]
        else:
            raw = _encode(s, op[0])
            s = None if raw is None else _decode(raw, op[1])
            if s is None:
                return None
    return s


# Letters that look like one of another script.
_LOOK = set("асеорхуіѕјАВЕКМНОРСТХУІЅЈ") | set("ονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
_LOOK_LATIN = set("aceopxyuiABCEHKMOPTXYI")


def _lookalike_only(token: str) -> bool:
    """Whether the foreign letters of a token are all look-alikes of the letters around them, which is no encoding fault."""
    if any(c in _ACC for c in token):
        return False
    lat = [c for c in token if c.isascii() and c.isalpha()]
    cyr = [c for c in token if "Ѐ" <= c <= "ӿ"]
    gre = [c for c in token if "Ͱ" <= c <= "Ͽ"]
    if _ODD_REST.search(token) or not lat and not cyr and not gre:
        return False
    if not gre and not (lat and cyr):
        return False
    return all(c in _LOOK for c in cyr + gre) or all(c in _LOOK_LATIN for c in lat) and all(c in _LOOK for c in gre)


_ODD_REST = re.compile("[" + ODD.translate(dict.fromkeys(map(ord, "іІѕЅјЈ"))) + "]")
_MIXED = re.compile(f"[{_LAT}][{_LOW}{_UP}Α-ωіѕјІЅЈ]|[{_LOW}{_UP}Α-ωіѕјІЅЈ][{_LAT}]")
_CAPS = re.compile(f"[^{_LOW}{_LAT}]*[{_UP}][^{_LOW}{_LAT}]*$")
_CASES = ((("koi8-r", "cp1251"),), (("cp1251", "koi8-r"),), (("cp1251", "iso8859-5"),), (("iso8859-5", "cp1251"),))


@lru_cache(50_000)
def _odd(token: str) -> bool:
    """Whether a token is to be searched: suspicious without its invisible characters and the words that only hold
    look-alikes, and, if it is in Cyrillic capitals throughout, cheaper in another Cyrillic character set."""
    t = _LETTERS.sub(lambda m: "a" if _lookalike_only(m[0]) else m[0], token.translate(INVISIBLE))
    if not SUSPECT.search(t):
        return False
    if _CAPS.match(t) and not _ODD_REST.search(t) and "?" not in t:
        here = cost(t)
        return any((f := apply(t, p)) is not None and here - cost(f) > 0.12 * len(t) for p in _CASES)
    return True


_LETTERS = re.compile(r"[^\W\d_]+")
#: A German noun whose capital came to stand last: a slip of letters, no encoding fault if it is all there is.
_ROTATED = re.compile("[^\\w]*[a-zäöüß]{3,}[ÄÖÜ][^\\w]*$")


@lru_cache(50_000)
def _path(probe: str) -> tuple:
    return search(probe)[1]


@lru_cache(50_000)
def _class_of(token: str) -> tuple:
    """What a token can be: the sets that make UTF-8 of it, the classes of its letters, whether it holds escapes."""
    utf8 = tuple(e for e in _codecs() if (raw := _encode(token, e)) is not None and not raw.isascii() and _decode(raw, "utf-8") is not None)
    kinds = "".join(sorted({{"U": "A", "D": "C", "M": "L", "k": "x", "E": "L", "W": "V"}.get(k, k) for k in token.translate(_CLASSES)} & set("ACLGVxb")))
    return utf8, kinds, bool(_ESCAPES.search(token))


#: Length of the strings in which tokens of one class are searched together.
_TOGETHER = 100


@lru_cache(200_000)
def _gain(t: str, path: tuple) -> float:
    f = apply(t, path)
    if f is None:
        return -1e9
    # A word of nothing but Cyrillic letters in which signs would come to stand holds a slip of letters, no fault.
    return cost(t) - cost(f) if not _CYRILLIC_WORD.fullmatch(t) or _INSIDE.search(f) is None else -1.0


_CYRILLIC_WORD = re.compile(f"[^\\w]*[{_LOW}{_UP}]+[^\\w]*")
_INSIDE = re.compile("\\w[^\\w\\s'’-]+\\w|€|[^\\w\\s]’|\\w’[а-яё]", re.I)


def _paths(odd: list[str]) -> Iterator[tuple]:
    """The paths that make tokens cheaper, as they are found; no token is left unsearched."""
    groups: dict[tuple, list[str]] = {}
    for t in odd:
        groups.setdefault(_class_of(t), []).append(t)
    for key in sorted(groups):
        left = sorted(groups[key], key=lambda t: (-len(set(t)), t))
        while left:
            some, n = [], 0
            for t in left:
                if n + len(t) <= _TOGETHER or not some:
                    some.append(t)
                    n += len(t) + 1
                    if n > _TOGETHER:
                        break
            path = _path(" ".join(some))
            if path:
                yield path
            done = {t for t in left if path and (f := apply(t, path)) is not None and (c := cost(f)) < cost(t) and _clean(f, c)}
            if len(some) > 1 and (own := _path(left[0])):
                yield own
            if not done:
                # Together they find nothing: the first was searched by itself, the others go once more without it.
                done = {left[0]}
            left = [t for t in left if t not in done]


def paths_of(odd: list[str]) -> tuple[dict[str, tuple], set[str]]:
    """(the path of every token, () where none makes it cheaper; the tokens that alone tell a fault: a path makes them cheaper by
    more than their margin)."""
    pool = list(dict.fromkeys(_paths(odd)))
    return _assigned(odd, pool), {t for t in odd if any(_gain(t, p) > _margin(t) for p in pool)}


def _assigned(odd: list[str], pool: list[tuple]) -> dict[str, tuple]:
    """The path of every token. The path that helps all tokens most goes first and keeps what it makes cheaper, unless another
    is better for a token by more than its margin: one short token can be cheap by chance in many sets."""
    gain = {p: {t: _gain(t, p) for t in odd} for p in pool}
    out: dict[str, tuple] = dict.fromkeys(odd, ())
    left, rest = set(odd), list(pool)
    while left and rest:
        total = {p: sum(max(-50.0, g) for t in left if (g := gain[p][t]) > -1e8) for p in rest}
        best = max(rest, key=lambda p: (round(total[p], 6), -len(p)))
        took = {t for t in left if gain[best][t] > 0}
        for t in took:
            out[t] = best
        left -= took
        rest.remove(best)
    for t in odd:
        other = max(pool, key=lambda p: gain[p][t], default=())
        if out[t] and gain[other][t] - gain[out[t]][t] > _margin(t):
            out[t] = other
    used = sorted({p for p in out.values() if p})
    for t in odd:
        other = max((p for p in used if (f := apply(t, p)) is not None and _clean(f, cost(f))), key=lambda p: gain[p][t], default=())
        if out[t] and other and gain[other][t] - gain[out[t]][t] > 0.5:
            out[t] = other
    return out


def plausible(texts: list[str]) -> bool:
    """Whether restored tokens are text: hardly any odd character, and Cyrillic letters about as frequent as in Russian."""
    s = " ".join(texts)
    k = s.translate(_CLASSES)
    letters = sum(c.isalpha() for c in s)
    if 4 * sum(k.count(x) for x in "xbkr") > letters or 3 * sum(bool(_BROKEN.search(t.translate(_APOSTROPHES).translate(_CLASSES))) for t in texts) > len(texts):
        return False
    low = [c for c in s.lower() if c in _RARE]
    if len(low) < 12:
        return not _NEVER.search(s.lower())
    vowels = sum(c in "аеёиоуыэюя" for c in low) / len(low)
    return sum(_RARE[c] for c in low) <= 0.32 * len(low) and 0.2 <= vowels <= 0.65 and 20 * len(_NEVER.findall(s.lower())) <= len(low)


#: A sign inside a word, a script that changes, a capital behind a small letter.
_BROKEN = re.compile("[AUCDLMG]t[AUCDLMG]|[AULM][CDG]|[CDG][AULM]|[ACL][UDM]|[LM]{3}")
_APOSTROPHES = dict.fromkeys(map(ord, "’‘–—"), "'")
#: What Russian words do not hold.
_NEVER = re.compile("\\b[ьъы]|[аеёиоуыэюя][ьъ]|[бвгджзклмнпрстфхцчшщьъ]й\\w|\\bй[^оеи]|[жшчщ][ыэя]|[гкх][ыэя]|ц[яюэ]")


def _suspects(s: str) -> tuple[Iterable[str], list[str]]:
    """(the tokens of a value, those to be searched)."""
    tokens = dict.fromkeys(_TOKEN.findall(s))
    odd = [t for t in tokens if _odd(t)]
    return tokens, [] if len(odd) == 1 and _ROTATED.match(odd[0]) else odd


def is_case(s: str | None) -> bool:
    """``examine`` without the restored text: it is enough that one token tells a fault by itself."""
    if not s or not suspicious(s):
        return False
    if _LOSS.search(s):
        return True
    _, odd = _suspects(s)
    for path in _paths(odd):
        if any(_gain(t, path) > _margin(t) for t in odd):
            return True
    return examine(s)[0]


def examine(s: str | None) -> tuple[bool, str | None]:
    """(whether s was wholly or partly read in a wrong encoding, s with what can be restored)."""
    if not s or not suspicious(s):
        return False, s
    if _LOSS.search(s):
        return True, s
    tokens, odd = _suspects(s)
    if odd:
        path_of, strong = paths_of(odd)
        by_path: dict[tuple, list[str]] = {}
        for t, p in path_of.items():
            if p:
                by_path.setdefault(p, []).append(t)
        sure = []
        for p, own in by_path.items():
            others = [t for t in odd if path_of[t] != p and t not in strong]
            together = sum(_gain(t, p) for t in own) + sum(max(-50.0, g) for t in others if (g := _gain(t, p)) > -1e8)
            if any(t in strong for t in own) or together > _margin(" ".join(own + others)):
                sure.append(p)
        if sure:
            return True, _restored(s, path_of, sure)
    else:
        mixed = [t for t in tokens if _MIXED.search(t)]
        fixed = [apply(t, (("cp1251", "cp1252"),)) for t in mixed]
        if mixed and all(f and _ENYE.fullmatch(f) for f in fixed) and _may_be_spanish(tokens):
            return True, _TOKEN.sub(lambda m: dict(zip(mixed, fixed)).get(m[0], m[0]), s)
    return bool(_MARKS.search(s)) and _lost_marks(s), s


def _restored(s: str, path_of: dict[str, tuple], sure: list[tuple]) -> str:
    """s with the paths that give plausible text applied: to the whole if one serves, else token by token; a token between
    two of the same path that is no suspect by itself goes with them if that makes it cheaper."""
    good = [p for p in sure if plausible([apply(t, p) for t, q in path_of.items() if q == p])]
    if not good:
        return s
    if len(good) == 1 and all(q == good[0] or _gain(t, good[0]) > -1e8 and not q for t, q in path_of.items()):
        t = apply(s, good[0])
        plain = [x for x in dict.fromkeys(_TOKEN.findall(s)) if x not in path_of and not x.isascii()]
        if t is not None and cost(t) < cost(s) and sum(_gain(x, good[0]) for x in plain) >= 0:
            return t
    parts = re.split("([ \n\t\r\f]+)", s)
    own = [path_of[t] if path_of.get(t) in good else None for t in parts[::2]]
    before, after, last = [], [], None
    for p in own:
        last = p or last
        before.append(last)
    last = None
    for p in reversed(own):
        last = p or last
        after.append(last)
    for i, (p, a, b) in enumerate(zip(own, before, reversed(after))):
        t = parts[2 * i]
        p = p or (a if a == b and a is not None and not t.isascii() and t not in path_of and _gain(t, a) > 0 else None)
        if p:
            parts[2 * i] = apply(t, p)
    return "".join(parts)


# A short word in which the only foreign letter becomes an n with tilde between vowels.
_ENYE = re.compile("[^a-z]*[a-z]?[aeiou]ñ[aeiou]s?[^a-z]*", re.I)
# Common words of Spanish.
_SPANISH = frozenset("de la el que los las en y un una por con del para se su al es".split())


def _may_be_spanish(tokens: Iterable[str]) -> bool:
    """Whether the words around do not speak against Spanish: they are too few to tell, or two common words are among them."""
    words = {w.lower() for t in tokens for w in _LETTERS.findall(t)}
    return len(words) < 12 or len(words & _SPANISH) >= 2


def _margin(t: str) -> float:
    return 2.4 if len(t) < 12 else 3.0 + 0.05 * len(t)


def _lost_marks(s: str) -> bool:
    """Question marks that stand for letters: runs of them as words, or one inside a word."""
    for m in _MARKS.finditer(s):
        t = m[0]
        if set(t) != {"?"} or len(t) >= 4:
            return True
    return len(re.findall(r"\?{2,}", s)) >= 3


def _frame(values: pd.Series) -> pd.DataFrame:
    got = [examine(v) for v in values]
    return pd.DataFrame({"garbled": [g for g, _ in got], "restored": [r for _, r in got]})


@F.pandas_udf(T.StructType([T.StructField("garbled", T.BooleanType()), T.StructField("restored", T.StringType())]))
def examined(values: pd.Series) -> pd.DataFrame:
    return _frame(values)


@F.pandas_udf(T.BooleanType())
def is_garbled(values: pd.Series) -> pd.Series:
    return pd.Series([is_case(v) for v in values], dtype="bool")


def repair(df: DataFrame, column: str, into: str = "encoding") -> DataFrame:
    """df with a struct column ``into`` of (garbled, restored); a row-wise operator without a shuffle."""
    return df.withColumn(into, examined(F.col(column)))


def garbled(df: DataFrame, column: str) -> DataFrame:
    """The rows of df whose value in the column is a case."""
    c: Column = F.col(column)
    return df.where(c.isNotNull() & is_garbled(c))
