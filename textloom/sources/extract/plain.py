"""Bytes to text when nothing says how: marks, zero bytes, UTF-8 as it is or nearly, else the likeliest single-byte set."""

from __future__ import annotations

import codecs
import re

_COMMON = frozenset("оеаинтсрвлкмдпу")


def utf16(data: bytes) -> str | None:
    """utf-16-le or -be if every other byte of the first 4 KiB is mostly zero, or mostly one Cyrillic high byte."""
    head = data[:4096]
    if len(head) < 4:
        return None
    even, odd = head[0::2], head[1::2]
    high = lambda b: sum(x in (0, 4) for x in b) / len(b)
    e, o = high(even), high(odd)
    if 0 not in head and 4 not in head:
        return None
    if o > 0.7 and e < 0.3:
        return "utf-16-le"
    if e > 0.7 and o < 0.3:
        return "utf-16-be"
    return None


def looks_binary(head: bytes) -> bool:
    if head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) or utf16(head):
        return False
    if b"\0" in head:
        return True
    bad = sum(b < 32 and b not in (7, 8, 9, 10, 12, 13, 27) for b in head)
    return bad * 20 > len(head)


def _score(text: str) -> float:
    """Plausibility of a decoded sample: usual letters good, odd signs and capitals inside words bad."""
    n = max(1, len(text))
    good = sum(c in _COMMON for c in text.lower()) + 0.5 * sum("а" <= c <= "я" or c.isascii() and c.isalnum() for c in text)
    bad = 3 * len(re.findall("[а-яё][А-ЯЁ]", text)) + 2 * sum(ord(c) > 127 and not ("А" <= c <= "я" or c in "ёЁ«»№—–“”„’…°·àâäçèéêëîïôöùûüßñáíóúÄÖÜÉ¿¡") for c in text)
    return (good - bad) / n


def decode(data: bytes) -> str:
    for bom, codec in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(bom):
            return data[len(bom) :].decode(codec, "replace")
    wide = utf16(data)
    if wide:
        return data.decode(wide, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    nearly = data.decode("utf-8", "replace")
    if nearly.count("�") * 100 < len(nearly) and any(ord(c) > 127 and c != "�" for c in nearly):
        return nearly
    head = data[: 64 << 10]
    best = max(("cp1251", "cp866", "koi8-r", "cp1252", "mac-cyrillic"), key=lambda c: _score(head.decode(c, "replace")))
    return data.decode(best, "replace")
