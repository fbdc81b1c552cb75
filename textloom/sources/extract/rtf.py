"""RTF: groups, code pages, Unicode escapes with their fallbacks, destinations that hold no text."""

from __future__ import annotations

import re

from textloom.sources.extract.doc import Doc, Extracted

# Destinations without text of the document, and words that stand for characters.
_SKIPPED = frozenset("fonttbl colortbl stylesheet info pict object themedata datastore generator listtable listoverridetable rsidtbl latentstyles xmlnstbl fldinst filetbl".split())
_BREAKS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "cell": "\t", "tab": "\t"}
_CHARS = {"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}
_TOKEN = re.compile(rb"\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def read(data: bytes, doc: Doc) -> Extracted:
    page, stack = "cp1252", []
    skip, after, left = False, 1, 0
    pending = bytearray()
    star = False

    def flush() -> None:
        if pending:
            doc.push(pending.decode(page, "replace"))
            pending.clear()

    for m in _TOKEN.finditer(data):
        if doc.full:
            break
        word, number, hexed, sign, brace, text = m.groups()
        if brace == b"{":
            stack.append((skip, after))
            star = False
            continue
        if brace == b"}":
            flush()
            if stack:
                skip, after = stack.pop()
            left = 0
            continue
        if sign == b"*":
            star = True
            continue
        if word:
            w, n = word.decode(), int(number) if number else None
            if star or w in _SKIPPED:
                skip, star = True, False
                continue
            if w == "ansicpg" and n:
                page = f"cp{n}" if n not in (0, 10000) else "cp1252"
                try:
                    b"".decode(page)
                except LookupError:
                    page = "cp1252"
            elif w == "uc":
                after = n or 0
            elif w == "bin" and n:
                left = 0
            elif not skip and w == "u" and n is not None:
                flush()
                doc.push(chr(n % 65536) if not 0xD800 <= n % 65536 < 0xE000 else "")
                left = after
                continue
            elif not skip and w in _BREAKS:
                flush()
                doc.tab() if _BREAKS[w] == "\t" else doc.newline()
            elif not skip and w in _CHARS:
                flush()
                doc.push(_CHARS[w])
            continue
        star = False
        if skip:
            continue
        if hexed:
            if left:
                left -= 1
            else:
                pending.append(int(hexed, 16))
        elif sign:
            if sign in b"\\{}":
                pending += sign
            elif sign == b"~":
                pending += b" "
            elif sign == b"_":
                pending += b"-"
        elif text:
            drop = min(left, len(text))
            left -= drop
            pending += text[drop:]
    flush()
    return doc.finish()
