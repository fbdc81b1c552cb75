"""Keeping stored records up to date: classify a listing, delete what vanished, upsert, count.

State is appended, never changed in place: each record carries its commit, a deletion is a record of its own, and the
state of a key is its last one. A run is one full outer join on key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.marks import FIRST_WAIT_S, verdict
from textloom.functions.paths import covers, extension, file_name, folder, path_key, stem

# What a walk leaves out.
SKIPPED_DIRS = ("$recycle.bin", "system volume information", ".git", ".svn", ".hg", "node_modules", "__pycache__")
SKIPPED_FILES = ("thumbs.db", "desktop.ini", ".ds_store")
SKIPPED_STARTS = ("~$", ".~lock.")


def glob_regex(glob: str) -> str:
    """A glob as an anchored, case-blind expression; * and ? cross slashes, ** is *, [..] and {a,b} as usual."""
    import re

    out, i, depth = "", 0, 0
    g = glob.replace("\\", "/")
    while i < len(g):
        c = g[i]
        if c == "*":
            while g[i + 1 : i + 2] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            j = g.find("]", i + 2)
            if j < 0:
                raise ValueError(f"unclosed bracket in {glob!r}")
            body = g[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = j
        elif c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed brace in {glob!r}")
    return f"(?isu)^(?:{out})$"


def excluded(path: Column, globs: list[str] | None = None, skip_dirs: list[str] | None = None) -> Column:
    """Whether a walk leaves the path out: a skipped directory on the way, a skipped file, a glob on path or name."""
    plain = F.translate(path, "\\", "/")
    parts = F.split(F.lower(plain), "/")
    name = F.lower(file_name(path))
    test = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: s.isin(*SKIPPED_DIRS)) | name.isin(*SKIPPED_FILES)
    test = reduce(Column.__or__, [name.startswith(s) for s in SKIPPED_STARTS], test)
    for g in globs or []:
        r = glob_regex(g)
        test = test | plain.rlike(r) | file_name(path).rlike(r)
    for d in skip_dirs or []:
        test = test | covers(path_key(F.lit(d)), path_key(path))
    return F.coalesce(test, F.lit(True))


def _prefixes(key: Column, own: bool) -> Column:
    """The folders above a key, and with ``own`` the key itself: what covers it, for joins by equality."""
    parts = F.split(key, "/")
    n = F.size(parts) if own else F.size(parts) - 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def usable_roots(roots: DataFrame) -> DataFrame:
    """Roots that lie in no other one, each once."""
    keyed = roots.where(F.col("root").isNotNull()).select(F.regexp_replace(path_key(F.col("root")), "/+$", "").alias("key"), "root").groupBy("key").agg(F.min("root").alias("root"))
    inner = keyed.select("key", F.explode(_prefixes(F.col("key"), False)).alias("p")).join(keyed.select(F.col("key").alias("p")), "p", "left_semi").select("key").distinct()
    return keyed.join(inner, "key", "left_anti").select("root")


def build_record(listing: DataFrame) -> DataFrame:
    """The attributes a record has from its path."""
    p = F.col("path")
    ext = extension(p)
    return listing.withColumns({"key": path_key(p), "name": stem(p), "name_lc": F.lower(file_name(p)), "ext": F.when(ext == "", F.lit(None)).otherwise(ext), "folder": folder(p)})


def classified(listing: DataFrame, existing: DataFrame, versions: Column, now_s: Column, force: bool = False, base: int = FIRST_WAIT_S, again: Column | None = None) -> DataFrame:
    """(key, action, before) of listing(key, size, mtime_ms, cloud, readable, ...) against existing(key, size, mtime_ms, ver):
    new, changed, stale, deferred, unchanged, unreadable, or vanished for records no longer listed; ``before`` is the mark a record
    had. ``again``, over the columns of existing, asks for another look at records that are otherwise fresh."""
    new = listing.select("key", F.lit(True).alias("listed"), "size", F.coalesce("mtime_ms", F.lit(0)).alias("mtime_ms"), F.coalesce("cloud", F.lit(False)).alias("cloud"), F.coalesce("readable", F.lit(True)).alias("readable"), versions.alias("version"), now_s.alias("now_s"))
    old = existing.select("key", F.lit(True).alias("stored"), F.col("size").alias("s"), F.coalesce("mtime_ms", F.lit(0)).alias("m"), F.coalesce("ver", F.lit(0)).cast("long").alias("before"), (F.lit(False) if again is None else F.coalesce(again, F.lit(False))).alias("again"))
    both = new.join(old, "key", "full_outer")
    fresh = verdict(F.col("before"), F.col("version"), F.col("cloud"), F.col("now_s"), base, None if again is None else F.col("again"))
    action = (
        F.when(F.col("listed").isNull(), "vanished")
        .when(~F.col("readable"), "unreadable")
        .when(F.col("stored").isNull(), "new")
        .when(F.lit(force) | ~(F.col("size").eqNullSafe(F.col("s")) & (F.col("mtime_ms") == F.col("m"))), "changed")
        .when(fresh == "stale", "stale")
        .when(fresh == "deferred", "deferred")
        .otherwise("unchanged")
    )
    return both.select("key", action.alias("action"), "before")


def classify(listing: DataFrame, existing: DataFrame, versions: Column, now_s: Column, force: bool = False, base: int = FIRST_WAIT_S) -> DataFrame:
    """(key, action), as ``classified``."""
    return classified(listing, existing, versions, now_s, force, base).select("key", "action")


def removed(actions: DataFrame, protected: DataFrame | None = None, cancelled: bool = False) -> DataFrame:
    """Keys to delete: vanished ones, unless under a protected prefix (what could not be read keeps its records)."""
    gone = actions.where((F.col("action") == "vanished") & F.lit(not cancelled)).select("key")
    if protected is None:
        return gone
    # A key is protected if one of its own folders is: equality on its prefixes, no pairwise test.
    prefixes = _prefixes(F.col("key"), True)
    wanted = protected.select(F.col("prefix").alias("p")).distinct()
    kept = gone.select("key", F.explode(prefixes).alias("p")).join(wanted, "p", "left_semi").select("key").distinct()
    return gone.join(kept, "key", "left_anti")


def latest(commits: DataFrame) -> DataFrame:
    """The state of each key in commits(key, commit_id, deleted, ...): its last row, gone if that is a deletion."""
    rest = [c for c in commits.columns if c not in ("key", "commit_id", "deleted")]
    last = commits.groupBy("key").agg(F.max(F.struct("commit_id", "deleted", *rest)).alias("r"))
    return last.where(~F.coalesce("r.deleted", F.lit(False))).select("key", "r.commit_id", *[f"r.{c}" for c in rest])


def delete_path(state: DataFrame, key: str, commit_id: int) -> DataFrame:
    """Deletions of a key and all below it, to be appended."""
    return state.where(covers(F.lit(key), F.col("key"))).withColumns({"commit_id": F.lit(commit_id), "deleted": F.lit(True)})


def summary(actions: DataFrame) -> DataFrame:
    """Counters of a run, one row."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    return actions.agg(n("new", "changed", "stale", "unchanged", "deferred", "unreadable").alias("scanned"), n("unchanged").alias("unchanged"), n("new", "changed", "stale").alias("indexed"), n("vanished").alias("removed"), n("deferred").alias("deferred"))


def status_counts(files: DataFrame) -> DataFrame:
    """Counters by status and the text of failures, one row."""
    s = F.split("status", ":")[0]
    return files.agg(*(F.count_if(s == x).alias(a) for x, a in (("ok", "ok"), ("empty", "empty"), ("encrypted", "encrypted"), ("skipped", "skipped"), ("scan", "scans"), ("ocr", "recognized"), ("error", "failed"))))


def batches(rows: DataFrame, size: str = "size", most_bytes: int = 128 << 20, most_rows: int = 50_000, slices: int = 64) -> DataFrame:
    """rows with ``batch``: commits of at most so many bytes or rows, per slice of keys, so that batches fill in parallel."""
    part = F.pmod(F.xxhash64("key"), F.lit(slices))
    w = Window.partitionBy(part).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    by_bytes = F.floor((F.sum(F.coalesce(size, F.lit(0))).over(w) - F.coalesce(size, F.lit(0))) / most_bytes)
    by_rows = F.floor((F.count("*").over(w) - 1) / most_rows)
    return rows.withColumn("batch", F.struct(part.alias("slice"), (by_bytes + by_rows).alias("n")))
