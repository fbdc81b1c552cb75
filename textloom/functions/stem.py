"""Snowball stemmers for English (Porter2) and Russian, written from their published definitions."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the English algorithm.
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
_KEPT_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"),
    ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"),
    ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str, vowels: str) -> tuple[int, int]:
    m = re.search(f"[{vowels}][^{vowels}]", w)
    r1 = m.end() if m else len(w)
    m = re.search(f"[{vowels}][^{vowels}]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w)) or w == "past"


@lru_cache(200_000)
def english(word: str) -> str:
    if len(word) <= 2 or word in _UNCHANGED:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    w = word.lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w, "aeiouy")
    for p in ("gener", "commun", "arsen"):
        if w.startswith(p):
            r1 = len(p)
            m = re.search("[aeiouy][^aeiouy]", w[r1:])
            r2 = r1 + m.end() if m else len(w)
    # Step 0 and 1a.
    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _KEPT_1A:
        return w.lower()
    # Step 1b.
    if w.endswith(("eedly", "eed")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for e in ("ingly", "edly", "ing", "ed"):
            if w.endswith(e):
                base = w[: -len(e)]
                if re.search("[aeiouy]", base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    # Step 1c.
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for e, to in _STEP2:
        if w.endswith(e):
            if len(w) - len(e) >= r1:
                if e == "ogi":
                    w = w[:-3] + "og" if w[-4:-3] == "l" else w
                elif e == "li":
                    w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
                else:
                    w = w[: -len(e)] + to
            break
    for e, to in _STEP3:
        if w.endswith(e):
            if len(w) - len(e) >= r1 and (e != "ative" or len(w) - len(e) >= r2):
                w = w[: -len(e)] + to
            break
    for e in _STEP4:
        if w.endswith(e):
            if len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(e)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# Fixed values of the Russian algorithm: endings, those of the first group only after а or я.
_RV = "аеиоуыэюя"
_GERUND = (("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"))
_ADJECTIVE = tuple("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split())
_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
_VERB = (tuple("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()), tuple("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()))
_NOUN = tuple("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split())


def _cut(w: str, rv: int, groups: tuple) -> str | None:
    """w without its longest ending of the groups, all of it within the region; endings of the first need а or я before."""
    best = None
    after, free = groups
    for e in after:
        if w.endswith(e) and len(w) - len(e) - 1 >= rv and w[-len(e) - 1] in "ая" and (best is None or len(e) > best):
            best = len(e)
    for e in free:
        if w.endswith(e) and len(w) - len(e) >= rv and (best is None or len(e) > best):
            best = len(e)
    return None if best is None else w[:-best]


@lru_cache(200_000)
def russian(word: str) -> str:
    w = word.replace("ё", "е")
    m = re.search(f"[{_RV}]", w)
    if not m:
        return w
    rv = m.end()
    _, r2 = _regions(w, _RV)
    got = _cut(w, rv, _GERUND)
    if got is not None:
        w = got
    else:
        for e in ("ся", "сь"):
            if w.endswith(e) and len(w) - 2 >= rv:
                w = w[:-2]
                break
        got = _cut(w, rv, ((), _ADJECTIVE))
        if got is not None:
            w = got
            w = _cut(w, rv, _PARTICIPLE) or w
        else:
            got = _cut(w, rv, _VERB)
            if got is not None:
                w = got
            else:
                w = _cut(w, rv, ((), _NOUN)) or w
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    for e in ("ость", "ост"):
        if w.endswith(e) and len(w) - len(e) >= r2:
            w = w[: -len(e)]
            break
    if w.endswith(("ейше", "ейш")) and len(w) - (4 if w.endswith("ейше") else 3) >= rv:
        w = w[: -4 if w.endswith("ейше") else -3]
    if w.endswith("нн"):
        w = w[:-1]
    elif w.endswith("ь") and len(w) - 1 >= rv:
        w = w[:-1]
    return w
