"""Text, units and properties out of files. ``extract`` reads one file's bytes, ``extracted`` a DataFrame of them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.sources.extract import legacy, markup, odf, ooxml, pdf, plain, rtf
from textloom.sources.extract.doc import Doc, Extracted

# Limits, and extensions read as text or never read.
MAX_TEXT = 16 << 20
MAX_FILE = 512 << 20
TEXT_EXTS = frozenset("txt md csv tsv log json xml yaml yml ini cfg conf toml sql py rs go java js ts c h cpp hpp cs rb php pl sh bat ps1 tex srt vtt eml".split())
HTML_EXTS = frozenset("html htm xhtml shtml mht".split())
NEVER = frozenset("exe dll sys msi iso img bin dat zip rar 7z gz tar mp3 mp4 avi mkv mov wav flac png gif bmp ico webp ttf woff woff2 class jar o so a lib pdb".split())

# The version of extraction as a whole, and what single formats have been raised by since.
VERSION, RAISED = 1, {"pdf": 2}
MAX_PDF = 128 << 20

Reader = Callable[[bytes, Doc], Extracted]
READERS: dict[str, Reader] = {}


def register(ext: str, reader: Reader) -> None:
    """Adds or replaces the reader of an extension, for instance one for pages or for pictures."""
    READERS[ext] = reader


def version_of(ext: Column) -> Column:
    """The version of extraction for files of an extension: a record made by another is outdated."""
    out = F.lit(VERSION)
    for name, more in RAISED.items():
        out = F.when(F.lower(ext) == name, VERSION + more).otherwise(out)
    return out.cast("long")


def extract(data: bytes | None, ext: str | None, size: int | None = None, max_text: int = MAX_TEXT) -> Extracted:
    """What a file holds; failures become a status, never an exception."""
    doc = Doc(max_text)
    if size is not None and size > MAX_FILE:
        return doc.skipped("too large")
    if data is None:
        return doc.failed("not readable")
    if not data:
        return Extracted("", [], "", "empty", False)
    ext = (ext or "").lower()
    try:
        if ext in READERS:
            return READERS[ext](data, doc)
        if data[:4] == b"PK\x03\x04":
            names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
            if "[Content_Types].xml" in names:
                return ooxml.read(data, doc)
            if "mimetype" in names or "content.xml" in names:
                return odf.read(data, doc)
            return doc.skipped("archive")
        if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            return legacy.read(data, doc)
        if data[:5] == b"{\\rtf":
            return rtf.read(data, doc)
        if data[:5] == b"%PDF-":
            return pdf.read(data, doc) if len(data) <= MAX_PDF else doc.skipped("too large")
        if ext in NEVER or plain.looks_binary(data[:8192]):
            return doc.skipped("binary")
        text = plain.decode(data[: max_text * 4])
        if ext in HTML_EXTS or ext not in TEXT_EXTS and markup.looks_like_html(text[:4096]):
            text = markup.strip_html(text)
        doc.push(text.replace("\r\n", "\n").replace("\r", "\n"))
        return doc.finish()
    except (zipfile.BadZipFile, KeyError, ValueError, OSError, RecursionError, EOFError, LookupError, MemoryError) as e:
        return doc.failed(f"{type(e).__name__}: {e}"[:200])
    except Exception as e:  # a parser's own errors: the file fails, the run goes on
        return doc.failed(f"{type(e).__name__}"[:200])


# Fixed value: bytes a viewer shows.
MAX_VIEW = 4 << 20


def read_for_view(data: bytes) -> tuple[str, bool] | None:
    """(text with one kind of line end, whether it was cut) of a file a viewer may show as text; None for anything binary."""
    if plain.looks_binary(data[:8192]):
        return None
    return plain.decode(data[:MAX_VIEW]).replace("\r\n", "\n").replace("\r", "\n"), len(data) > MAX_VIEW


RESULT = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("units", T.ArrayType(T.StringType())), T.StructField("meta", T.StringType()), T.StructField("status", T.StringType()), T.StructField("truncated", T.BooleanType())]
)


def extracted(files: DataFrame, content: str = "content", ext: str = "ext") -> DataFrame:
    """The other columns of files and text, units, meta, status, truncated of every row; a broken file fails alone."""
    rest = [c for c in files.columns if c != content]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = [extract(None if d is None else bytes(d), e) for d, e in zip(df[content], df[ext])]
            out = df[rest].copy()
            for name in RESULT.names:
                out[name] = [getattr(g, name) for g in got]
            yield out

    return files.mapInPandas(run, T.StructType([*(files.schema[c] for c in rest), *RESULT.fields]))
