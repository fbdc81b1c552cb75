"""Text of HTML without its tags."""

from __future__ import annotations

import html
import re

# Tags that end a line, and entities known by name.
_BLOCKS = "p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer blockquote pre hr td th dt dd title option".split()
_LINES = frozenset(b for b in _BLOCKS if b not in ("td", "th"))
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "laquo": "«", "raquo": "»", "mdash": "—", "ndash": "–", "hellip": "…", "copy": "©", "reg": "®", "deg": "°"}
# Fixed value: how many characters are looked at to tell HTML.
_SNIFFED = 512
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_HIDDEN = re.compile(r"<(script|style)\b.*?(?:</\1[^>]*>|\Z)", re.S | re.I)
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)[^>]*>|<[!?][^>]*>")
_ENTITY = re.compile(r"&(#[xX][0-9a-fA-F]{1,6}|#\d{1,7}|[a-zA-Z]\w{0,9});")


def looks_like_html(head: str) -> bool:
    """Whether a text begins like HTML: its declaration, or a telling tag among its first characters."""
    low = head.lstrip("\ufeff \t\r\n")[:_SNIFFED].lower()
    return low.startswith("<!doctype html") or any(tag in low for tag in ("<html", "<body", "<table"))


def entity(name: str) -> str | None:
    if name.startswith("#"):
        n = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return html.unescape(f"&#{n};") if 0 < n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else None
    return _NAMED.get(name)


def strip_html(text: str) -> str:
    t = _HIDDEN.sub(" ", _COMMENT.sub(" ", text))
    t = re.sub(r"\s+", " ", t)
    t = _TAG.sub(lambda m: "\n" if m[1] and m[1].lower() in _LINES else " ", t)
    t = _ENTITY.sub(lambda m: entity(m[1]) or m[0], t)
    lines = (re.sub(r"[ \t\xa0]+", " ", line).strip() for line in t.split("\n"))
    return "\n".join(line for line in lines if line)
