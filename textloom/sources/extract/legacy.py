"""Text of the binary office formats: compound files, and in them Word 97-2003, PowerPoint 97-2003, Excel 97-2003."""

from __future__ import annotations

import re
import struct

from textloom.functions.values import is_date_format, number_text, serial_text
from textloom.sources.extract.doc import Doc, Extracted

_FREE = 0xFFFFFFFA  # sector numbers from here on are marks
_MOST = 512 << 20


class Compound:
    """Streams of a compound file by name."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        fat_n, start, _, self.cutoff, mini_start, _, difat, difat_n = struct.unpack_from("<IIIIIIII", data, 44)
        sectors = list(struct.unpack_from("<109I", data, 76))
        while difat < _FREE and difat_n > 0:
            more = struct.unpack(f"<{self.size // 4}I", self._sector(difat))
            sectors += more[:-1]
            difat, difat_n = more[-1], difat_n - 1
        self.fat: list[int] = []
        for s in sectors[:fat_n]:
            if s < _FREE:
                self.fat += struct.unpack(f"<{self.size // 4}I", self._sector(s))
        directory = self._chain(start, self.fat, self._sector)
        mini = self._chain(mini_start, self.fat, self._sector)
        self.mini_fat = list(struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4]))
        self.entries: dict[str, tuple[int, int]] = {}
        self.mini = b""
        for i in range(0, len(directory) - 127, 128):
            e = directory[i : i + 128]
            n, kind = struct.unpack_from("<H", e, 64)[0], e[66]
            name = e[: max(0, n - 2)].decode("utf-16-le", "ignore")
            at, size = struct.unpack_from("<IQ", e, 116)
            size &= 0xFFFFFFFF
            if kind == 5:
                self.mini = self._chain(at, self.fat, self._sector)
            elif kind == 2:
                self.entries.setdefault(name.lower(), (at, size))

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        return self.data[at : at + self.size]

    def _chain(self, n: int, table: list[int], get) -> bytes:
        out, seen = [], 0
        while n < _FREE and n < len(table) and seen <= len(table):
            out.append(get(n))
            n, seen = table[n], seen + 1
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name.lower() not in self.entries:
            return None
        at, size = self.entries[name.lower()]
        if size > _MOST:
            return None
        if size < self.cutoff:
            return self._chain(at, self.mini_fat, lambda n: self.mini[n * self.mini_size : (n + 1) * self.mini_size])[:size]
        return self._chain(at, self.fat, self._sector)[:size]


def controls(text: str) -> str:
    """Office text without its control codes: field codes go and their results stay, cells become tabs, soft hyphens nothing."""
    text = re.sub("\x13[^\x13\x14\x15]*\x14", "", text)
    text = re.sub("\x13[^\x13\x15]*\x15", "", text)
    text = text.replace("\x15", "").replace("\x14", "").replace("\x13", "").replace("\x07\x07", "\n").replace("\x07", "\t").replace("\x1f", "").replace("\xad", "").replace("\x1e", "-")
    return re.sub(r"[\x00-\x08\x0e-\x1f]", "", re.sub("[\r\x0b\x0c\x0e]", "\n", text))


def word(c: Compound, doc: Doc) -> Extracted:
    main = c.stream("WordDocument")
    flags = struct.unpack_from("<H", main, 10)[0]
    if flags & 0x100:
        return Extracted("", [], "", "encrypted", False)
    table = c.stream("1Table" if flags & 0x200 else "0Table")
    version = struct.unpack_from("<H", main, 2)[0]
    if version < 0xC1 or table is None:
        first, last = struct.unpack_from("<II", main, 24)
        doc.push(controls(main[first:last].decode("cp1251", "replace")))
        return doc.finish()
    counts = struct.unpack_from("<8i", main, 76)  # characters of the body, notes, headers, macros, comments, ...
    at, size = struct.unpack_from("<II", main, 0x1A2)
    clx, i = table[at : at + size], 0
    while i < len(clx) and clx[i] == 1:
        i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
    n = (struct.unpack_from("<I", clx, i + 1)[0] - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", clx, i + 5)
    text = []
    for k in range(n):
        fc = struct.unpack_from("<I", clx, i + 5 + 4 * (n + 1) + 8 * k + 2)[0]
        length = ends[k + 1] - ends[k]
        if fc & 0x40000000:
            start = (fc & 0x3FFFFFFF) // 2
            text.append(main[start : start + length].decode("cp1252", "replace"))
        else:
            text.append(main[fc : fc + 2 * length].decode("utf-16-le", "replace"))
    whole = "".join(text)
    doc.push(controls(whole[: counts[0]]).strip("\n"))
    # Headers, notes and comments follow the body; the same line is kept once.
    seen: set[str] = set()
    for line in controls(whole[counts[0] :]).split("\n"):
        if line.strip() and line.strip() not in seen:
            seen.add(line.strip())
            doc.newline()
            doc.push(line.strip())
    return doc.finish()


# Containers whose texts are captions of the program: master slides, handouts, environment.
_CONTAINERS_SKIPPED = (1016, 4041, 1010)


def slides(c: Compound, doc: Doc) -> Extracted:
    data = c.stream("PowerPoint Document")
    out: list[str] = []

    def down(lo: int, hi: int, depth: int) -> None:
        while lo + 8 <= hi:
            head, kind, size = struct.unpack_from("<HHI", data, lo)
            end = min(hi, lo + 8 + size)
            if head & 15 == 15:
                if kind not in _CONTAINERS_SKIPPED and depth < 32:
                    down(lo + 8, end, depth + 1)
            elif kind in (4000, 4008):
                raw = data[lo + 8 : end]
                t = controls(raw.decode("utf-16-le", "ignore") if kind == 4000 else raw.decode("cp1252", "ignore")).strip()
                if any(ch.isalnum() for ch in t):
                    out.append(t)
            lo = end if end > lo else hi

    down(0, len(data), 0)
    for t in out:
        doc.push(t)
        doc.newline()
    return doc.finish()


def _string(b: bytes, at: int, long: bool = True) -> tuple[str, int]:
    n = struct.unpack_from("<H" if long else "<B", b, at)[0]
    at += 2 if long else 1
    flag = b[at]
    at += 1
    runs = ext = 0
    if flag & 8:
        runs, at = struct.unpack_from("<H", b, at)[0], at + 2
    if flag & 4:
        ext, at = struct.unpack_from("<I", b, at)[0], at + 4
    size = n * 2 if flag & 1 else n
    text = b[at : at + size].decode("utf-16-le" if flag & 1 else "latin-1", "replace")
    return text, at + size + 4 * runs + ext


def _rk(v: int) -> float:
    x = (v >> 2 if v < 1 << 31 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


def sheets(c: Compound, doc: Doc) -> Extracted:
    data = c.stream("Workbook") or c.stream("Book")
    records, at = [], 0
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        if kind == 0x3C and records:
            records[-1][2].append(data[at + 4 : at + 4 + size])
        else:
            records.append((at, kind, [data[at + 4 : at + 4 + size]]))
        at += 4 + size
    if any(k == 0x2F for _, k, _ in records):
        return Extracted("", [], "", "encrypted", False)
    names, shared, formats, styles, epoch = {}, [], {}, [], False
    for _, kind, parts in records:
        b = parts[0]
        if kind == 0x85:
            names[struct.unpack_from("<I", b, 0)[0]] = _string(b, 6, False)[0]
        elif kind == 0x22:
            epoch = b[0] == 1
        elif kind == 0x41E:
            formats[struct.unpack_from("<H", b, 0)[0]] = _string(b, 2)[0]
        elif kind == 0xE0:
            styles.append(struct.unpack_from("<H", b, 2)[0])
        elif kind == 0xFC:
            shared = _shared(parts)
    dates = [is_date_format(s, formats.get(s)) for s in styles]

    def number(v: float, style: int) -> str:
        return (serial_text(v, epoch) or number_text(v)) if style < len(dates) and dates[style] else number_text(v)

    sheet = row = None
    for at, kind, parts in records:
        b = parts[0]
        if kind == 0x809:
            sheet, row = names.get(at), None
            if sheet is not None:
                doc.add_meta(sheet)
                doc.begin_unit(f"Лист «{sheet}»")
            continue
        if sheet is None or doc.full:
            continue
        cells: list[str] = []
        if kind == 0xFD:
            i = struct.unpack_from("<I", b, 6)[0]
            cells = [shared[i]] if i < len(shared) else []
        elif kind == 0x203:
            cells = [number(struct.unpack_from("<d", b, 6)[0], struct.unpack_from("<H", b, 4)[0])]
        elif kind == 0x27E:
            cells = [number(_rk(struct.unpack_from("<I", b, 6)[0]), struct.unpack_from("<H", b, 4)[0])]
        elif kind == 0xBD:
            cells = [number(_rk(struct.unpack_from("<I", b, i + 2)[0]), struct.unpack_from("<H", b, i)[0]) for i in range(4, len(b) - 7, 6)]
        elif kind == 0x204:
            cells = [_string(b, 6)[0]]
        elif kind == 0x06 and b[12:14] != b"\xff\xff":
            cells = [number(struct.unpack_from("<d", b, 6)[0], struct.unpack_from("<H", b, 4)[0])]
        elif kind == 0x207:
            cells = [_string(b, 0)[0]]
        if cells:
            here = struct.unpack_from("<H", b, 0)[0] if kind != 0x207 else row
            if row is not None and here != row:
                doc.newline()
            row = here
            for t in cells:
                doc.push(t)
                doc.tab()
    return doc.finish()


def _shared(parts: list[bytes]) -> list[str]:
    """The table of strings, whose characters may go on in a further record with a width of its own."""
    total = struct.unpack_from("<I", parts[0], 4)[0]
    out, p, at = [], 0, 8
    while len(out) < total and p < len(parts):
        if at >= len(parts[p]):
            p, at = p + 1, 0
            continue
        b = parts[p]
        n, flag = struct.unpack_from("<HB", b, at)
        at += 3
        runs = ext = 0
        if flag & 8:
            runs, at = struct.unpack_from("<H", b, at)[0], at + 2
        if flag & 4:
            ext, at = struct.unpack_from("<I", b, at)[0], at + 4
        text, wide = "", flag & 1
        while n:
            room = (len(parts[p]) - at) // (2 if wide else 1)
            take = min(n, room)
            text += parts[p][at : at + take * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")
            at += take * (2 if wide else 1)
            n -= take
            if n:
                p += 1
                if p >= len(parts):
                    return [*out, text]
                wide, at = parts[p][0] & 1, 1
        out.append(text)
        skip = 4 * runs + ext
        while skip and p < len(parts):
            step = min(skip, len(parts[p]) - at)
            skip, at = skip - step, at + step
            if skip:
                p, at = p + 1, 0
    return out


def read(data: bytes, doc: Doc) -> Extracted:
    c = Compound(data)
    names = c.entries
    if "encryptedpackage" in names:
        return Extracted("", [], "", "encrypted", False)
    if "worddocument" in names:
        return word(c, doc)
    if "powerpoint document" in names:
        return slides(c, doc)
    if "workbook" in names or "book" in names:
        return sheets(c, doc)
    return doc.skipped("unknown compound file")
