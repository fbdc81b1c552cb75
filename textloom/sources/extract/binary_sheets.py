"""Workbooks whose parts are binary records (XLSB): sheets as units, cells by rows.

A record is its kind (one or two bytes), its length (up to four bytes of seven bits) and its data."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from textloom.functions.values import is_date_format, number_text, serial_text
from textloom.sources.extract.doc import Doc, Extracted

# Kinds of records.
ROW, RK, REAL, TEXT, SHARED, FORMULA_TEXT, FORMULA_NUMBER = 0, 2, 5, 6, 7, 8, 9
STRING_ITEM, FORMAT, CELL_FORMAT, PROPERTIES, SHEET, BEGIN_FORMATS, END_FORMATS = 19, 44, 47, 153, 156, 617, 618


def records(part: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(part):
        kind = part[at]
        at += 1
        if kind & 128 and at < len(part):
            kind, at = kind & 127 | (part[at] & 127) << 7, at + 1
        size = shift = 0
        while at < len(part) and shift < 28:
            b = part[at]
            size, at, shift = size | (b & 127) << shift, at + 1, shift + 7
            if not b & 128:
                break
        yield kind, part[at : at + size]
        at += size


def wide(b: bytes, at: int) -> tuple[str, int]:
    """A string of 16-bit characters with its count before it, and where it ends; a count of all ones is no string."""
    n = struct.unpack_from("<I", b, at)[0]
    if n == 0xFFFFFFFF:
        return "", at + 4
    return b[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def short_number(v: int) -> float:
    """A number packed into 32 bits: 30 of an integer or of a double, and whether it is in hundredths."""
    n = float((v if v < 1 << 31 else v - (1 << 32)) >> 2) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return n / 100 if v & 1 else n


def _strings(part: bytes | None) -> list[str]:
    return [wide(b, 1)[0] for kind, b in records(part or b"") if kind == STRING_ITEM]


def _dates(part: bytes | None) -> list[bool]:
    codes: dict[int, str] = {}
    out, inside = [], False
    for kind, b in records(part or b""):
        if kind == FORMAT:
            codes[struct.unpack_from("<H", b)[0]] = wide(b, 2)[0]
        elif kind in (BEGIN_FORMATS, END_FORMATS):
            inside = kind == BEGIN_FORMATS
        elif kind == CELL_FORMAT and inside:
            n = struct.unpack_from("<H", b, 2)[0]
            out.append(is_date_format(n, codes.get(n)))
    return out


def _cell(kind: int, b: bytes, shared: list[str], dates: list[bool], epoch: bool) -> str:
    if kind == SHARED:
        n = struct.unpack_from("<I", b, 8)[0]
        return shared[n] if n < len(shared) else ""
    if kind in (TEXT, FORMULA_TEXT):
        return wide(b, 8)[0]
    if kind not in (RK, REAL, FORMULA_NUMBER):
        return ""
    number = short_number(struct.unpack_from("<I", b, 8)[0]) if kind == RK else struct.unpack_from("<d", b, 8)[0]
    style = int.from_bytes(b[4:7], "little")
    return style < len(dates) and dates[style] and serial_text(number, epoch) or number_text(number)


def read(package, main: str, doc: Doc) -> Extracted:
    rels = package.rels(main)
    of_kind = lambda kind: package.part(next((t for k, t in rels.values() if k == kind), ""))
    shared, dates = _strings(of_kind("sharedStrings")), _dates(of_kind("styles"))
    epoch = False
    for kind, b in records(package.part(main) or b""):
        if kind == PROPERTIES:
            epoch = bool(b[0] & 1)
        if kind != SHEET:
            continue
        rid, at = wide(b, 8)
        name = wide(b, at)[0]
        doc.add_meta(name)
        doc.begin_unit(f"Лист «{name}»")
        for cell, data in records(package.part(rels.get(rid, ("", ""))[1]) or b""):
            if doc.full:
                break
            if cell == ROW:
                doc.newline()
            elif text := _cell(cell, data, shared, dates, epoch) if len(data) >= 8 else "":
                doc.push(text)
                doc.tab()
        doc.newline()
    return doc.finish()
