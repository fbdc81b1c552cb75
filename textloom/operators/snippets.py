"""Fragments of the hits of one page, with marks, place and surroundings; and the lines a viewer jumps to.

Only the page's records reach these functions, so their texts are read for at most a thousand keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.analysis import _normal, terms
from textloom.operators.index import Index
from textloom.operators.search import Options, ordered, matches
from textloom.plans import lang
from textloom.session import cut

LONGEST = 240
PREFIX_TERMS = 64
SNIPPET = "array<struct<text:string,hit:boolean>>"
_TOKEN = re.compile(r"[^\W_]+")


def _marks(text: str, words: set[str], prefixes: tuple[str, ...], stem: bool) -> list[tuple[int, int, str]]:
    out = []
    for m in _TOKEN.finditer(text):
        s, r = _normal(m[0], stem), _normal(m[0], False)
        if s in words or r in words or prefixes and s.startswith(prefixes):
            out.append((m.start(), m.end(), s))
    return out


def fragment(text: str | None, words: list[str], prefixes: list[str], weights: dict[str, float], stem: bool, longest: int = LONGEST) -> tuple[list[tuple[str, bool]], int, bool, bool] | None:
    """(parts, units before, more before, more after) of the best stretch of at most ``longest`` characters: that with
    the greatest weight of distinct terms, the earliest on ties, cut to the unit of its first hit; None without a hit."""
    if not text:
        return None
    marks = _marks(text, set(words), tuple(prefixes), stem)
    if not marks:
        return None
    best, lo = (-1.0, 0, 0), 0
    for hi in range(len(marks)):
        while marks[hi][1] - marks[lo][0] > longest and lo < hi:
            lo += 1
        w = sum(weights.get(t, 1.0) for t in {t for _, _, t in marks[lo : hi + 1]})
        if w > best[0]:
            best = (w, lo, hi)
    first, last = marks[best[1]], marks[best[2]]
    spare = max(0, longest - (last[1] - first[0])) // 2
    a, b = max(0, first[0] - spare), min(len(text), last[1] + spare)
    a = max(a, text.rfind("\f", 0, first[0]) + 1)
    end = text.find("\f", first[1])
    b = min(b, end if end >= 0 else b)
    while a > 0 and a < first[0] and text[a - 1].isalnum() and text[a].isalnum():
        a += 1
    while b < len(text) and b > last[1] and text[b].isalnum() and text[b - 1].isalnum():
        b -= 1
    parts, at = [], a
    for s, e, _ in marks:
        if s < a or e > b:
            continue
        parts += [(text[at:s], False), (text[s:e], True)]
        at = e
    parts.append((text[at:b], False))
    before, after = text[:a].replace("\f", "").strip(), text[b:].replace("\f", "").strip()
    return collapse(parts), text.count("\f", 0, first[0]), bool(before), bool(after)


def collapse(parts: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """White space runs, across parts too, become one space; the ends are trimmed and empty parts dropped."""
    out: list[tuple[str, bool]] = []
    space = True
    for text, hit in parts:
        t = ""
        for c in text:
            if c.isspace() or c == "\f":
                t, space = t + ("" if space else " "), True
            else:
                t, space = t + c, False
        if t:
            out.append((t, hit))
    while out and not out[-1][0].rstrip():
        out.pop()
    if out:
        out[-1] = (out[-1][0].rstrip(), out[-1][1])
    return out


def hits(ix: Index, o: Options) -> DataFrame:
    """The page of hits with location and snippet."""
    found, positive = matches(ix, o)
    return _shown(ix, o, ordered(found, o, positive))


def answer(ix: Index, o: Options) -> tuple[DataFrame, int]:
    """(page of hits with location and snippet, exact total) from one evaluation of the query."""
    found, positive = matches(ix, o)
    kept = cut(found.select("key", "path", "name_lc", "ext", "size", "mtime_ms", "score", "status"), "matches")
    return _shown(ix, o, ordered(kept, o, positive)), kept.count()


def _shown(ix: Index, o: Options, page: DataFrame) -> DataFrame:
    page = page.select("key", "path", "name_lc", "ext", "size", F.col("mtime_ms").alias("modified_ms"), "score", "status")
    words, prefixes = lang.highlight_words(lang.narrowed(lang.parse(o.query), o.mode), lambda t, s: terms(t, s and ix.stem))
    content = ix.vocabulary.where(F.col("field") == "content")
    weights = {r["term"]: float(r["w"]) for r in content.where(F.col("term").isin(words)).select("term", F.log(1 + ix.total / F.col("df")).alias("w")).collect()}
    for p in prefixes:
        words += [r["term"] for r in content.where(F.col("term").startswith(p)).select("term").orderBy("term").limit(PREFIX_TERMS).collect()]
    stem = ix.stem

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for text, labels in zip(df["content"], df["unit_labels"]):
                got = fragment(text, words, [], weights, stem)
                if got is None:
                    rows.append((None, [], None, None))
                    continue
                parts, unit, before, after = got
                place = labels[unit] if labels is not None and unit < len(labels) else None
                rows.append((place, [{"text": t, "hit": h} for t, h in parts], before, after))
            for i, c in enumerate(("location", "parts", "more_before", "more_after")):
                df[c] = [r[i] for r in rows]
            yield df.drop(columns=["content", "unit_labels"])

    schema = "key string, path string, name_lc string, ext string, size long, modified_ms long, score double, status string, location string, parts " + SNIPPET + ", more_before boolean, more_after boolean"
    return page.join(ix.contents.drop("doc"), "key", "left").select(*page.columns, "content", "unit_labels").mapInPandas(run, schema)


def viewer_marks(text: str, literals: list[str]) -> list[tuple[int, int]]:
    """Case-blind places of the literals, merged where they touch; none if lower case changes the length."""
    low = text.lower()
    if len(low.encode()) != len(text.encode()):
        return []
    spans = sorted((m.start(), m.end()) for t in literals if t for m in re.finditer(re.escape(t), low))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def match_lines(texts: DataFrame, literals: list[str], most: int = 5000, clip: int = 2000) -> DataFrame:
    """(key, line_no, line) of texts(key, content): the lines that hold the most distinct literals, in built-in functions."""
    lines = texts.select("key", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    low = F.lower("line")
    n = sum((low.contains(t).cast("int") for t in dict.fromkeys(x.lower() for x in literals)), F.lit(0))
    scored = lines.select("key", "line_no", F.substring("line", 1, clip).alias("line"), n.alias("n")).where("n > 0")
    top = scored.groupBy("key").agg(F.max("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("line_no"))
    return scored.join(top, ["key", "n"]).withColumn("_rank", rank).where(F.col("_rank") <= most).select("key", "line_no", "line")


def units(contents: DataFrame) -> DataFrame:
    """(key, unit_no, label, text) of every unit: texts cut at U+000C, labels beside them."""
    cut = contents.select("key", "unit_labels", F.posexplode(F.split("content", "\f")).alias("unit_no", "text"))
    label = F.when(F.col("unit_no") < F.size("unit_labels"), F.expr("element_at(unit_labels, unit_no + 1)"))
    return cut.select("key", "unit_no", label.alias("label"), "text")


def location(contents: DataFrame, needle: str) -> DataFrame:
    """(key, location): the unit label of the first place of the needle."""
    at = F.instr(F.lower("content"), needle.lower())
    before = F.size(F.split(F.expr(f"substring(content, 1, instr(lower(content), '{needle.lower()}'))"), "\f")) - 1
    return contents.where(at > 0).select("key", F.when(before < F.size("unit_labels"), F.element_at("unit_labels", before + 1)).alias("location"))
