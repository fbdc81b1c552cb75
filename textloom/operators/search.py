"""Search over an index: clauses to matches, boolean algebra, scores, filters, order, pages, counts.

A query becomes one DataFrame of leaf matches (doc, gid, score). All groups are decided by a single aggregation on
the document number: a record matches if every group is there, and its score is the sum of its leaves. Terms and prefixes are
ranges of the posting files, which are in term order; a word with typing errors is first looked up in the vocabulary.
Exclusions are an anti join, filters predicates on the attributes, pushed into their scan. Texts are read only for the page that is
returned. ``answer`` keeps the matches of a query once, for its page and its total.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.analysis import osa, terms
from textloom.functions.paths import covers
from textloom.operators.index import LENGTHS, Index
from textloom.plans import lang
from textloom.plans.lang import ANY, CONTENT, FUZZY, META, NAME, PATH, PHRASE, PREFIX, WORD, Clause, Parsed
from textloom.session import cut

K1, B = 1.2, 0.75
#: So many terms may stand in a scan's filter.
MOST_TERMS = 1000
# Weight of each field for words and phrases, prefixes, and words with typing errors.
RANKED = {"content": 1.0, "name": 4.0, "meta": 2.5, "folder": 1.0}
PREFIXED = {"content": 1.0, "name": 3.0, "meta": 2.0, "folder": 1.0}
MISTYPED = {"content": 1.0, "name": 3.0, "meta": 2.0}
NAME_PART, NAME_START = 3.0, 2.0
SCOPED = {ANY: ("content", "name", "meta", "folder"), CONTENT: ("content",), NAME: ("name",), PATH: ("name", "folder"), META: ("meta",)}
SORTS = {"newest": ("mtime_ms", False), "oldest": ("mtime_ms", True), "largest": ("size", False), "smallest": ("size", True)}


@dataclass
class Options:
    query: str = ""
    mode: str = "all"
    exts: list[str] = field(default_factory=list)
    dirs: list[str] = field(default_factory=list)
    min_size: int | None = None
    max_size: int | None = None
    after_ms: int | None = None
    before_ms: int | None = None
    limit: int = 20
    offset: int = 0
    sort: str = "relevance"
    snippets: bool = True


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def _bm25(ix: Index, name: str, tf: Column, weight: Column | float) -> Column:
    avgdl = ix.stats.get(name, (0, 1.0))[1]
    return (weight if isinstance(weight, Column) else F.lit(weight)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))


def _frequencies(ix: Index, name: str, words: list[str]) -> dict[str, int]:
    rows = ix.vocabulary.where((F.col("field") == name) & F.col("term").isin(words)).select("term", "df").collect()  # at most one per query term
    return {r["term"]: r["df"] for r in rows}


def _in_field(ix: Index, name: str, test: Column, *columns: str) -> DataFrame:
    """(term, doc, tf, dl and more) of the blocks of a field whose term passes; the test is pushed into the scan."""
    each = F.explode(F.arrays_zip("docs", "tfs", "dls", *columns)).alias("p")
    rows = ix.blocks.where((F.col("field") == name) & test).select("term", each)
    return rows.select("term", F.col("p.docs").alias("doc"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), *(F.col(f"p.{c}").alias(c) for c in columns))


def _term_leaf(ix: Index, name: str, words: list[str]) -> DataFrame | None:
    """Each of the terms is an alternative and adds its own score."""
    df = _frequencies(ix, name, words)
    if not df:
        return None
    w = reduce(lambda c, t: c.when(F.col("term") == t, idf(ix.total, df[t])), df, F.when(F.lit(False), 0.0))
    return _in_field(ix, name, F.col("term").isin(list(df))).select("doc", (F.lit(RANKED[name]) * _bm25(ix, name, F.col("tf"), w)).alias("score"))


def _phrase_leaf(ix: Index, name: str, words: list[str]) -> DataFrame | None:
    """The tokens one after another; the frequency is the number of places, the weight the sum over the tokens."""
    df = _frequencies(ix, name, words)
    if len(df) < len(set(words)):
        return None
    rows = _in_field(ix, name, F.col("term").isin(list(df)), "positions").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.first("dl").alias("dl"))
    rows = rows.where(F.size("at") == len(df))

    def begun(i: int, t: str) -> Column:
        return F.transform(F.col("at")[t], lambda p: p - F.lit(i))

    starts = [begun(i, t) for i, t in enumerate(words)]
    hits = rows.withColumn("tf", F.size(reduce(F.array_intersect, starts))).where("tf > 0")
    return hits.select("doc", (F.lit(RANKED[name]) * _bm25(ix, name, F.col("tf"), sum(idf(ix.total, df[t]) for t in words))).alias("score"))


def _all_leaf(ix: Index, name: str, words: list[str]) -> DataFrame | None:
    """All tokens in any order, for the field without positions."""
    unique = list(dict.fromkeys(words))
    df = _frequencies(ix, name, unique)
    if len(df) < len(unique):
        return None
    w = reduce(lambda c, t: c.when(F.col("term") == t, idf(ix.total, df[t]) * words.count(t)), df, F.when(F.lit(False), 0.0))
    scored = _in_field(ix, name, F.col("term").isin(unique)).select("doc", _bm25(ix, name, F.col("tf"), w).alias("s"))
    return scored.groupBy("doc").agg(F.count("*").alias("n"), F.sum("s").alias("s")).where(F.col("n") == len(unique)).select("doc", (F.lit(RANKED[name]) * F.col("s")).alias("score"))


def _holding(rows: DataFrame, weight: float) -> DataFrame:
    """A constant score for every document of blocks, once."""
    return rows.select(F.explode("docs").alias("doc")).distinct().select("doc", F.lit(weight).alias("score"))


def _prefix_leaf(ix: Index, name: str, prefix: str, weight: float) -> DataFrame:
    """Terms with a beginning are neighbours: a range of the posting files."""
    return _holding(ix.blocks.where((F.col("field") == name) & (F.col("term") != LENGTHS) & F.col("term").startswith(prefix)), weight)


def _mistyped_leaf(ix: Index, name: str, word: str, distance: int, weight: float) -> DataFrame:
    """The terms within the distance are looked up in the vocabulary; up to MOST_TERMS of them are named in the scan of the
    postings, more (which short words may have) are joined with it."""
    terms = ix.vocabulary.where((F.col("field") == name) & within(word, distance)).select("term")
    few = [r["term"] for r in terms.limit(MOST_TERMS + 1).collect()]
    rows = ix.blocks.where(F.col("field") == name)
    return _holding(rows.where(F.col("term").isin(few)) if len(few) <= MOST_TERMS else rows.join(terms, "term", "left_semi"), weight)


def within(word: str, distance: int) -> Column:
    """Whether the column term is within so many edits. A swap costs two plain edits, so twice the distance bounds the
    candidates the JVM leaves to Python, which sees vocabulary terms only."""
    exact = F.pandas_udf(lambda s: s.map(lambda t: osa(t, word, distance) <= distance), T.BooleanType())
    return (F.abs(F.length("term") - F.lit(len(word))) <= distance) & (F.levenshtein("term", F.lit(word), 2 * distance) >= 0) & exact(F.col("term"))


def _const(df: DataFrame, weight: float) -> DataFrame:
    return df.select("doc", F.lit(weight).alias("score"))


def clause_matches(ix: Index, c: Clause) -> DataFrame | None:
    """(doc, score) of every alternative of a clause; None if it has none, in which case it is dropped."""
    fields, out = SCOPED[c.scope], []
    if c.kind in (WORD, PHRASE):
        words, raw = terms(c.text, ix.stem), terms(c.text, False)
        if words:
            for name in fields:
                if len(words) == 1:
                    forms = list(dict.fromkeys([words[0], *(raw if c.kind == WORD and len(raw) == 1 else [])]))
                    out.append(_term_leaf(ix, name, forms))
                elif name == "folder":
                    out.append(_all_leaf(ix, name, words))
                else:
                    out.append(_phrase_leaf(ix, name, words))
        if c.kind == WORD and c.scope in (ANY, NAME) and len(c.text) >= 2:
            out.append(_const(ix.files.where(F.col("name_lc").contains(c.text.lower())), NAME_PART))
        elif not words:
            return None
    elif c.kind == PREFIX:
        p = c.text.lower().replace("ё", "е")
        out += [_prefix_leaf(ix, name, p, PREFIXED[name]) for name in fields]
        if c.scope in (ANY, NAME):
            out.append(_const(ix.files.where(F.col("name_lc").startswith(p)), NAME_START))
    elif c.kind == FUZZY:
        words = terms(c.text, ix.stem)
        if not words:
            return None
        out += [_mistyped_leaf(ix, name, words[0], c.distance, MISTYPED[name]) for name in fields if name in MISTYPED]
        if not out:
            return None
    out = [o for o in out if o is not None]
    return reduce(DataFrame.unionByName, out) if out else ix.files.limit(0).select("doc", F.lit(0.0).alias("score"))


def filters(o: Options, parsed: Parsed) -> Column | None:
    tests = []
    exts = list(dict.fromkeys([*parsed.exts, *(e.strip().lstrip(".").lower() for e in o.exts)]))
    if exts:
        tests.append(F.col("ext").isin(exts))
    dirs = [d.replace("\\", "/").lower().rstrip("/") for d in o.dirs]
    if dirs:
        tests.append(reduce(Column.__or__, [F.col("key").startswith(d + "/") for d in dirs]))
    for name, low, high in (("size", o.min_size, o.max_size), ("mtime_ms", o.after_ms, o.before_ms)):
        if low is not None:
            tests.append(F.col(name) >= low)
        if high is not None:
            tests.append(F.col(name) <= high)
    return reduce(Column.__and__, tests) if tests else None


def matches(ix: Index, o: Options) -> tuple[DataFrame, bool]:
    """(attributes and score of every matching record, whether a positive clause was given)."""
    parsed = lang.narrowed(lang.parse(o.query), o.mode)
    files, test = ix.files, filters(o, parsed)
    if test is not None:
        files = files.where(test)
    leaves = []
    for group in parsed.groups:
        got = [m for c in group if (m := clause_matches(ix, c)) is not None]
        if got:
            leaves.append(reduce(DataFrame.unionByName, got).select("doc", F.lit(len(leaves)).alias("gid"), "score"))
    if leaves:
        both = reduce(DataFrame.unionByName, leaves)
        # Sums are made before the shuffle; which groups are there is a bit each, a word of bits for every 32 groups.
        words = [F.bit_or(F.when(F.floor(F.col("gid") / 32) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gid") % 32)).otherwise(F.lit(0).cast("long"))).alias(f"g{w}") for w in range(-(-len(leaves) // 32))]
        every = reduce(Column.__and__, [F.col(f"g{w}") == (1 << min(32, len(leaves) - 32 * w)) - 1 for w in range(len(words))])
        per = both.groupBy("doc").agg(F.sum("score").alias("score"), *words).where(every)
        found = files.join(per.select("doc", "score"), "doc")
    else:
        found = files.withColumn("score", F.lit(1.0))
    excluded = [m.select("doc") for c in parsed.negatives if (m := clause_matches(ix, c)) is not None]
    if excluded:
        found = found.join(reduce(DataFrame.unionByName, excluded).distinct(), "doc", "left_anti")
    return found, bool(parsed.groups)


def ordered(found: DataFrame, o: Options, positive: bool) -> DataFrame:
    """One page. Without a positive clause relevance means newest; equal ranks go by key, so pages never overlap."""
    sort = "newest" if o.sort == "relevance" and not positive else o.sort
    limit = max(1, min(1000, o.limit))
    if sort == "relevance":
        by = [F.round("score", 6).desc(), F.col("key").asc()]
    else:
        name, up = SORTS[sort]
        value = F.coalesce(name, F.lit(0))
        by = [value.asc() if up else value.desc(), F.col("key").asc()]
        found = found.withColumn("score", F.lit(0.0))
    page = found.orderBy(*by)
    return (page.offset(o.offset) if o.offset else page).limit(limit)


def _hit(page: DataFrame) -> DataFrame:
    return page.select("key", "path", F.element_at(F.split("path", r"[\\/]"), -1).alias("name"), "ext", "size", F.col("mtime_ms").alias("modified_ms"), F.col("score").cast("float").alias("score"), "status")


def search(ix: Index, o: Options) -> DataFrame:
    """The page of hits: key, path, name, ext, size, modified_ms, score, status."""
    found, positive = matches(ix, o)
    return _hit(ordered(found, o, positive))


def answer(ix: Index, o: Options) -> tuple[DataFrame, int]:
    """(page of hits, exact total) from one evaluation of the query, whose matches are kept in the shared folder."""
    found, positive = matches(ix, o)
    kept = cut(found.select("key", "path", "ext", "size", "mtime_ms", "score", "status"), "matches")
    return _hit(ordered(kept, o, positive)), kept.count()


def count(ix: Index, o: Options) -> DataFrame:
    return matches(ix, o)[0].agg(F.count("*").alias("total"))


def facets(ix: Index, o: Options, groups: list[list[str]]) -> DataFrame:
    """(grp, hits): hits of the query per group of extensions, from one pass; a type named in the query joins each group."""
    parsed = lang.parse(o.query)
    free = Options(**{**o.__dict__, "exts": []})
    own = parsed.exts
    # The query's own types are unioned with each group, so the one pass takes in every extension any group wants.
    every = sorted({e for g in groups for e in g})
    base = matches(ix, Options(**{**free.__dict__, "exts": every}))[0] if own or every else matches(ix, free)[0]
    per = base.groupBy(F.coalesce("ext", F.lit("")).alias("ext")).agg(F.count("*").alias("n"))
    sums = [F.coalesce(F.sum(F.when(F.col("ext").isin([*g, *own]), F.col("n"))), F.lit(0)).alias(str(i)) for i, g in enumerate(groups)]
    one = per.agg(*sums)
    return one.select(F.posexplode(F.array(*[F.col(str(i)) for i in range(len(groups))])).alias("grp", "hits"))


def by_value(ix: Index, column: str) -> DataFrame:
    """(value, documents) of ext or status, missing as "", most frequent first."""
    return ix.files.groupBy(F.coalesce(column, F.lit("")).alias("value")).agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "value")


def contains_path(ix: Index, key: str) -> bool:
    return not ix.files.where(F.col("key") == key).limit(1).isEmpty()


def stored(ix: Index, asked: DataFrame) -> DataFrame:
    """(key, stored) of those of asked(key) that are in the index."""
    return ix.files.join(asked.select("key").distinct(), "key", "left_semi").select("key", F.lit(True).alias("stored"))


def below(ix: Index, prefix: str) -> DataFrame:
    return ix.files.where(covers(F.lit(prefix), F.col("key")))


def many(ix: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """Batched search: queries(qid, text) of plain words over contents, all words required; (qid, key, score, rank).

    One join of query terms with postings serves every query, so throughput grows with the batch and not with jobs."""
    stem = ix.stem
    words = F.pandas_udf(lambda s: s.map(lambda t: list(dict.fromkeys(terms(t or "", stem)))), T.ArrayType(T.StringType()))
    asked = queries.select("qid", words("text").alias("words")).where(F.size("words") > 0)
    each = asked.select("qid", F.size("words").alias("need"), F.explode("words").alias("term"))
    post = ix.blocks.where(F.col("field") == "content")
    df = ix.vocabulary.where(F.col("field") == "content").select("term", "df")
    n, avgdl = F.lit(ix.total), F.lit(ix.stats.get("content", (0, 1.0))[1])
    w = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # Blocks are joined before they are unfolded: a row per query, term and block.
    met = each.join(df, "term").join(post.select("term", "docs", "tfs", "dls"), "term").select("qid", "need", w.alias("w"), F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p"))
    tf, dl = F.col("p.tfs"), F.col("p.dls")
    hit = met.select("qid", "need", F.col("p.docs").alias("doc"), (F.col("w") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))).alias("s"))
    full = hit.groupBy("qid", "doc", "need").agg(F.count("*").alias("n"), F.sum("s").alias("score")).where("n = need").join(ix.files.select("doc", "key"), "doc")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 6).desc(), "key"))
    return full.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "key", "score", "rank")
