"""Runs that keep an index in step with directory trees: list, compare, read what changed, commit; and the smaller changes.

``maintain`` is a run over any listing and any way of loading texts: one full outer join of listing and records by key decides
what is new, changed, outdated, put off, unchanged, unreadable or vanished; only what must be read is loaded; a commit puts it in
and takes out what vanished. ``run`` lists and reads trees. ``apply`` brings single paths up to date, ``remove_root`` and
``delete_path`` take a folder out. All return the index of the new commit, and the commits before it stay readable.

What cannot be listed is not what vanished: records below a folder that could not be read, of a root that cannot be reached, or of a
network root that lists nothing though records exist, are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.marks import FIRST_WAIT_S, packed
from textloom.functions.paths import covers, path_key
from textloom.operators import index, maintenance
from textloom.operators.index import Index
from textloom.session import bounded_broadcast, cut, parallel
from textloom.sources import extract as extraction
from textloom.sources import tree

#: When a run commits in between: so many bytes or files to read per commit.
COMMIT_BYTES, COMMIT_FILES = 128 << 30, 50_000_000
LOADED = "content string, unit_labels array<string>, meta string, status string, truncated boolean"
ATTRIBUTES = ("key", "path", "name", "name_lc", "ext", "folder", "meta", "status", "size", "mtime_ms", "ver", *index.TEXTS)


def load_files(candidates: DataFrame, most: int = extraction.MAX_FILE) -> DataFrame:
    """The candidates with what extraction makes of the files at their paths. Files are opened where they are read from, by the
    executors; a stub is not opened, and a file that fails fails alone."""
    rest = [c for c in candidates.columns]

    def one(path: str, ext: str | None, size: int | None, cloud: bool) -> extraction.Extracted:
        if cloud:
            return extraction.Extracted("", [], "", "skipped: cloud", False)
        try:
            data = Path(path).read_bytes() if size is None or size <= most else b""
        except OSError as e:
            return extraction.Extracted("", [], "", f"error: {e.strerror}", False)
        return extraction.extract(data, ext, size)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = [one(*x) for x in zip(df["path"], df["ext"], df["size"], df["cloud"])]
            out = df[rest].copy()
            for name, of in (("content", "text"), ("unit_labels", "units"), ("meta", "meta"), ("status", "status"), ("truncated", "truncated")):
                out[name] = [getattr(g, of) for g in got]
            yield out

    return parallel(candidates).mapInPandas(read, T.StructType([*candidates.schema.fields, *T._parse_datatype_string(LOADED).fields]))


def _texts(column: str) -> Column:
    return F.when(F.col(column) == "", F.lit(None)).otherwise(F.col(column))


def _within(records: DataFrame, prefixes: list[str] | None) -> DataFrame:
    return records if prefixes is None else records.where(reduce(Column.__or__, [covers(F.lit(p), F.col("key")) for p in prefixes], F.lit(False)))


def maintain(
    ix: Index,
    listing: DataFrame,
    load: Callable[[DataFrame], DataFrame],
    versions: Column,
    now_s: int,
    *,
    prefixes: list[str] | None = None,
    protected: DataFrame | None = None,
    force: bool = False,
    cancelled: bool = False,
    rescan: bool = False,
    first_wait: int = FIRST_WAIT_S,
    commit_bytes: int = COMMIT_BYTES,
    commit_files: int = COMMIT_FILES,
) -> tuple[Index, dict[str, int]]:
    """One run: (the index after it, its counters). listing(path, size, mtime_ms, cloud, readable) holds each key once;
    ``load`` adds content, unit_labels, meta, status and truncated to the candidates; ``prefixes`` are the keys of the run's
    roots, whose records alone can vanish; below ``protected(prefix)`` nothing vanishes. A run of more than ``commit_bytes`` or
    ``commit_files`` to read commits in parts, so that what a failed run has done is kept."""
    listing = cut(maintenance.build_record(listing.select("path", "size", F.coalesce("mtime_ms", F.lit(0)).alias("mtime_ms"), F.coalesce("cloud", F.lit(False)).alias("cloud"), F.coalesce("readable", F.lit(True)).alias("readable"))).withColumn("version", versions), "listing")
    records = _within(ix.files, prefixes)
    again = F.col("status") == "scan" if rescan else None
    actions = cut(maintenance.classified(listing, records, F.col("version"), F.lit(now_s).cast("long"), force, first_wait, again), "actions")
    gone = maintenance.removed(actions.select("key", "action"), protected, cancelled)
    todo = listing.join(actions.where(F.col("action").isin("new", "changed", "stale")).select("key", "before"), "key")
    sums = todo.agg(F.count("*"), F.sum("size")).first()
    parts = max(1, -(-sums[0] // commit_files), -(-(sums[1] or 0) // commit_bytes))
    counters = {**maintenance.summary(actions).first().asDict(), "removed": 0}
    for part in range(parts):
        some = todo if parts == 1 else todo.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
        failed = F.col("status").startswith("error")
        loaded = cut(load(some).withColumns({"failed": failed, "ver": packed(F.col("version"), F.col("cloud"), failed, F.col("before"), F.lit(now_s).cast("long"))}), "loaded")
        took = maintenance.status_counts(loaded).first().asDict() | loaded.agg(F.count_if("truncated").alias("truncated"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("text_bytes")).first().asDict()
        for name, n in took.items():
            counters[name] = counters.get(name, 0) + n
        leave = gone if part == parts - 1 else None
        n = leave.count() if leave is not None else 0
        counters["removed"] += n
        if sum(v for k, v in took.items() if k not in ("truncated", "text_bytes")) or n:
            fresh = loaded.withColumns({"status": F.split("status", ":")[0], "content": _texts("content"), "meta": _texts("meta")})
            ix = index.upsert(ix, fresh.select(*ATTRIBUTES), leave)
    return ix, counters


def open_or_create(spark: SparkSession, path: str, stem: bool = True) -> Index:
    """The index of a folder; an empty one is made where there is none."""
    if index.commits(spark, path.rstrip("/")):
        return Index(spark, path)
    kinds = {"size": "long", "mtime_ms": "long", "ver": "long", "unit_labels": "array<string>"}
    return index.rebuilt(spark, spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in ATTRIBUTES)), path, stem)


def run(
    ix: Index, roots: list[str], *, excludes: list[str] | None = None, skip_dirs: list[str] | None = None, now_s: int | None = None,
    load: Callable[[DataFrame], DataFrame] = load_files, network: Callable[[str], bool] = tree.on_network, **options,
) -> tuple[Index, dict[str, int], list[str]]:
    """A run over directory trees: (the index after it, its counters, what could not be read). A root that cannot be reached is
    named among the problems and keeps its records; none that can be reached is an error."""
    usable, problems = tree.usable(roots)
    found = cut(tree.walked(ix.spark, usable), "walk")
    prefixes = [tree.prefix(r) for r in usable]
    errors = found.where(F.col("error").isNotNull())
    problems += [f"{r['path']}: {r['error']}" for r in errors.limit(200).collect()]  # a report; all of them protect their records
    protected = errors.select(F.regexp_replace(path_key(F.col("path")), "/+$", "").alias("prefix"))
    listed = {r["root"]: r["n"] for r in found.where(F.col("error").isNull()).groupBy("root").agg(F.count("*").alias("n")).collect()}
    empty = [tree.prefix(r) for r in usable if network(r) and not listed.get(r)]
    empty = [p for p in empty if not _within(ix.files, [p]).isEmpty()]
    if empty:
        problems += [f"{p}: lists nothing though records exist; they are kept" for p in empty]
        protected = protected.unionByName(ix.spark.createDataFrame([(p,) for p in empty], "prefix string"))
    listing = found.where(F.col("error").isNull() & ~maintenance.excluded(F.col("path"), excludes, skip_dirs))
    one = listing.withColumn("key", path_key(F.col("path"))).groupBy("key").agg(F.max(F.struct("mtime_ms", "size", "path", "cloud", "readable")).alias("r")).select("r.*")
    ix, counters = maintain(ix, one, load, extraction.version_of(F.col("ext")), now_s or int(time.time()), prefixes=prefixes, protected=protected, **options)
    return ix, counters, problems


def delete_path(ix: Index, path: str) -> Index:
    """Takes out a file, or a folder with all below it."""
    key = path.replace("\\", "/").lower().rstrip("/")
    return index.upsert(ix, _nothing(ix), ix.files.where(covers(F.lit(key), F.col("key"))).select("key"))


def remove_root(ix: Index, root: str) -> Index:
    """Takes out a root and writes what is left as one segment."""
    return index.compact(delete_path(ix, root))


def _nothing(ix: Index) -> DataFrame:
    return ix.records.select(*ATTRIBUTES).limit(0)


def below_any(records: DataFrame, gone: DataFrame) -> DataFrame:
    """Keys of records that are in gone(key) or lie below one of them: equality on the prefixes of the depths gone has."""
    deep = sorted(r[0] for r in gone.select(F.size(F.split("key", "/"))).distinct().collect())  # as many as trees are deep
    if not deep:
        return records.select("key").limit(0)
    each = records.select("key", F.explode(F.array(*(F.substring_index("key", "/", d) for d in deep))).alias("p"))
    return each.join(bounded_broadcast(gone.select(F.col("key").alias("p")).distinct()), "p", "left_semi").select("key").distinct()


def apply(ix: Index, due: DataFrame, *, excludes: list[str] | None = None, skip_dirs: list[str] | None = None, now_s: int | None = None, load: Callable[[DataFrame], DataFrame] = load_files) -> tuple[Index, dict[str, int]]:
    """Brings due(path, tree) up to date: a file is read again, a folder is walked if its tree flag is set, what is gone is taken
    out with all below it; left-out paths change nothing."""
    kept = due.where(~maintenance.excluded(F.col("path"), excludes, skip_dirs))
    seen = cut(tree.looked_at(kept.groupBy("path").agg(F.max("tree").alias("tree"))), "due")
    files = seen.where("kind = 'file'").where(~maintenance.excluded(F.col("path"), excludes, skip_dirs))
    one = files.withColumn("key", path_key(F.col("path"))).groupBy("key").agg(F.max(F.struct("mtime_ms", "size", "path", "cloud", "readable")).alias("r")).select("r.*")
    todo = maintenance.build_record(one).withColumn("version", extraction.version_of(F.col("ext")))
    failed = F.col("status").startswith("error")
    stamp = packed(F.col("version"), F.col("cloud"), failed, F.lit(None).cast("long"), F.lit(now_s or int(time.time())).cast("long"))
    loaded = cut(load(todo).withColumn("ver", stamp).withColumns({"status": F.split("status", ":")[0], "content": _texts("content"), "meta": _texts("meta")}), "loaded")
    gone = cut(below_any(ix.files, seen.where("kind = 'gone'").select(path_key(F.col("path")).alias("key"))), "gone")
    counters = {"updated": loaded.count(), "removed": gone.count()}
    return (index.upsert(ix, loaded.select(*ATTRIBUTES), gone) if any(counters.values()) else ix), counters
