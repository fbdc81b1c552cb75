"""Word, PowerPoint and Excel packages, by the standard library's zip and XML readers."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from textloom.functions.values import is_date_format, natural_key, number_text, serial_text
from textloom.sources.extract import binary_sheets
from textloom.sources.extract.doc import Doc, Extracted

_MAX_PART = 1 << 30


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


class Package:
    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = {n.lower(): n for n in self.zip.namelist()}

    def part(self, name: str) -> bytes | None:
        real = self.names.get(name.lstrip("/").lower())
        if real is None or self.zip.getinfo(real).file_size > _MAX_PART:
            return None
        return self.zip.read(real)

    def tree(self, name: str) -> ET.Element | None:
        data = self.part(name)
        return None if data is None else ET.fromstring(data)

    def rels(self, name: str) -> dict[str, tuple[str, str]]:
        """id -> (kind, resolved target) of a part's relations."""
        folder, base = posixpath.split(name)
        root = self.tree(f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels")
        out = {}
        for r in root if root is not None else ():
            if r.get("TargetMode") == "External":
                continue
            target = r.get("Target", "")
            full = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], full)
        return out

    def of_kind(self, name: str, *kinds: str) -> list[str]:
        return sorted((t for k, t in self.rels(name).values() if k in kinds), key=natural_key)


def core_properties(p: Package, doc: Doc) -> None:
    root = p.tree("docProps/core.xml")
    for e in root if root is not None else ():
        if local(e.tag) in ("title", "subject", "creator", "keywords", "description", "category"):
            doc.add_meta(e.text)


def flow(root: ET.Element, doc: Doc, skip: frozenset[str] = frozenset()) -> None:
    """Text runs with paragraph, row, cell, tab and break boundaries, in document order."""
    todo: list[tuple[ET.Element, bool]] = [(root, False)]
    while todo and not doc.full:
        e, done = todo.pop()
        name = local(e.tag)
        if done:
            if name in ("p", "tr"):
                doc.newline()
            elif name == "tc":
                if doc.last == "\n":
                    doc.parts.pop()
                    doc.size -= 1
                doc.tab()
            continue
        if name in skip or name in ("pPr", "rPr", "Fallback", "delText", "instrText", "sectPr"):
            continue
        if name == "t":
            doc.push(e.text or "")
        elif name == "tab":
            doc.tab()
        elif name in ("br", "cr"):
            doc.newline()
        elif name == "noBreakHyphen":
            doc.push("-")
        todo.append((e, True))
        todo += [(c, False) for c in reversed(e)]


def word(p: Package, main: str, doc: Doc) -> Extracted:
    root = p.tree(main)
    if root is not None:
        flow(root, doc)
    for part in p.of_kind(main, "header", "footer", "footnotes", "endnotes", "comments", "diagramData"):
        root = p.tree(part)
        if root is not None:
            doc.newline()
            flow(root, doc)
    return doc.finish()


def slides(p: Package, main: str, doc: Doc) -> Extracted:
    root, rels = p.tree(main), p.rels(main)
    order = []
    for e in root.iter() if root is not None else ():
        if local(e.tag) == "sldId":
            rid = next((v for k, v in e.attrib.items() if k.startswith("{") and local(k) == "id"), "")
            if rid in rels:
                order.append(rels[rid][1])
    for n, part in enumerate(order or p.of_kind(main, "slide"), 1):
        root = p.tree(part)
        if root is None:
            continue
        doc.begin_unit(f"Слайд {n}")
        flow(root, doc, frozenset(["fld"]))
        for extra in p.of_kind(part, "notesSlide", "comments", "diagramData"):
            more = p.tree(extra)
            if more is not None:
                doc.newline()
                flow(more, doc, frozenset(["fld"]))
    return doc.finish()


def _shared(p: Package, main: str) -> list[str]:
    out = []
    for part in p.of_kind(main, "sharedStrings"):
        root = p.tree(part)
        for si in root if root is not None else ():
            text = ""
            for e in si:
                if local(e.tag) == "t":
                    text += e.text or ""
                elif local(e.tag) == "r":
                    text += "".join(t.text or "" for t in e if local(t.tag) == "t")
            out.append(text)
    return out


def _date_styles(p: Package, main: str) -> list[bool]:
    for part in p.of_kind(main, "styles"):
        root = p.tree(part)
        if root is None:
            continue
        codes = {int(e.get("numFmtId", 0)): e.get("formatCode", "") for e in root.iter() if local(e.tag) == "numFmt"}
        for e in root:
            if local(e.tag) == "cellXfs":
                ids = [int(x.get("numFmtId", 0)) for x in e]
                return [is_date_format(i, codes.get(i)) for i in ids]
    return []


def sheets(p: Package, main: str, doc: Doc) -> Extracted:
    root, rels = p.tree(main), p.rels(main)
    shared, dates = _shared(p, main), _date_styles(p, main)
    epoch = any(local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter())
    for e in root.iter():
        if local(e.tag) != "sheet":
            continue
        rid = next((v for k, v in e.attrib.items() if k.startswith("{") and local(k) == "id"), "")
        name = e.get("name", "")
        doc.add_meta(name)
        doc.begin_unit(f"Лист «{name}»")
        part = rels.get(rid, ("", ""))[1]
        sheet = p.tree(part) if part else None
        if sheet is None:
            continue
        for row in sheet.iter():
            if local(row.tag) != "row" or doc.full:
                continue
            for c in row:
                text = _cell(c, shared, dates, epoch)
                if text:
                    doc.push(text)
                    doc.tab()
            doc.newline()
        threaded = p.of_kind(part, "threadedComment")
        for extra in [*(threaded or p.of_kind(part, "comments")), *p.of_kind(part, "drawing")]:
            more = p.tree(extra)
            if more is not None:
                doc.newline()
                if local(more.tag) == "ThreadedComments":
                    for t in more.iter():
                        if local(t.tag) == "text":
                            doc.push(t.text or "")
                            doc.newline()
                else:
                    flow(more, doc)
    return doc.finish()


def _cell(c: ET.Element, shared: list[str], dates: list[bool], epoch: bool) -> str:
    kind = c.get("t", "n")
    if kind in ("b", "e"):
        return ""
    if kind == "inlineStr":
        return "".join(e.text or "" for e in c.iter() if local(e.tag) == "t")
    v = next((e.text for e in c if local(e.tag) == "v"), None)
    if v is None:
        return ""
    if kind == "s":
        return shared[int(v)] if int(v) < len(shared) else ""
    if kind in ("str", "d"):
        return v
    try:
        number = float(v)
    except ValueError:
        return v
    style = int(c.get("s", 0))
    if style < len(dates) and dates[style]:
        return serial_text(number, epoch) or number_text(number)
    return number_text(number)


def read(data: bytes, doc: Doc) -> Extracted:
    p = Package(data)
    if "encryptedpackage" in p.names:
        return Extracted("", [], "", "encrypted", False)
    core_properties(p, doc)
    main = next(iter(p.of_kind("", "officeDocument")), "")
    head = (p.part(main) or b"")[:2000]
    if re.search(rb"<(?:\w+:)?document[\s>]", head):
        return word(p, main, doc)
    if re.search(rb"<(?:\w+:)?presentation[\s>]", head):
        return slides(p, main, doc)
    if re.search(rb"<(?:\w+:)?workbook[\s>]", head):
        return sheets(p, main, doc)
    if main.endswith(".bin"):
        return binary_sheets.read(p, main, doc)
    return doc.skipped("unknown package")
