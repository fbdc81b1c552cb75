"""OpenDocument texts, tables and presentations."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET

from textloom.sources.extract.doc import Doc, Extracted
from textloom.sources.extract.ooxml import local

_SKIPPED = frozenset("page-number page-count date time slide-name tracked-changes forms".split())


def _walk(e: ET.Element, doc: Doc, slides: bool) -> None:
    name = local(e.tag)
    if doc.full or name in _SKIPPED:
        return
    attr = {local(k): v for k, v in e.attrib.items()}
    if name == "table" and not slides:
        doc.begin_unit(f"Лист «{attr.get('name', '')}»")
        doc.add_meta(attr.get("name"))
    elif name == "page" and slides:
        doc.begin_unit(f"Слайд {len(doc.units) + 1}")
    if name == "s":
        doc.push(" " * min(int(attr.get("c", 1)), 100))
    elif name == "tab":
        doc.tab()
    elif name == "line-break":
        doc.newline()
    inline = name in ("p", "h", "span", "a", "annotation")
    if inline and e.text:
        doc.push(" ".join(e.text.split("\n")))
    for c in e:
        _walk(c, doc, slides)
        if c.tail and name in ("p", "h", "span", "a"):
            doc.push(" ".join(c.tail.split("\n")))
    if name in ("p", "h", "table-row"):
        doc.newline()
    elif name == "table-cell":
        if doc.last == "\n":
            doc.parts.pop()
            doc.size -= 1
        doc.tab()


def read(data: bytes, doc: Doc) -> Extracted:
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    if "META-INF/manifest.xml" in names and b"encryption-data" in z.read("META-INF/manifest.xml"):
        return Extracted("", [], "", "encrypted", False)
    kind = z.read("mimetype").decode("ascii", "ignore") if "mimetype" in names else ""
    if "meta.xml" in names:
        for e in ET.fromstring(z.read("meta.xml")).iter():
            if local(e.tag) in ("title", "subject", "creator", "initial-creator", "keyword", "description"):
                doc.add_meta(e.text)
    root = ET.fromstring(z.read("content.xml"))
    body = next((e for e in root.iter() if local(e.tag) == "body"), root)
    if "spreadsheet" in kind:
        _walk(body, doc, False)
    elif "presentation" in kind:
        _walk(body, doc, True)
    else:
        _text(body, doc)
    return doc.finish()


def _text(e: ET.Element, doc: Doc) -> None:
    """A text document: tables are rows of cells, not units."""
    for t in e.iter():
        if local(t.tag) == "table":
            t.tag = "group"
    _walk(e, doc, False)
