"""Walk of directory trees as a Spark data source: spark.read.format("tree").option("roots", ...).load().

A row per file, and a row with an error per entry that could not be read. Directories that are always left out are
pruned before they are entered; links are not followed; names beginning with a dot or underscore and empty files are
rows like any other. Each subtree of the first levels is a partition of its own, a folder of many entries there several.
"""

from __future__ import annotations

import json
import os
import stat
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from textloom.operators.maintenance import SKIPPED_DIRS, SKIPPED_FILES, SKIPPED_STARTS

SCHEMA = "root string, path string, size long, mtime_ms long, cloud boolean, readable boolean, error string"


# Attributes of files that are offline, or recalled when opened or read.
_ELSEWHERE = 0x1000 | 0x40000 | 0x400000


#: Entries of one folder that a task looks at, where the folder is met while partitions are made.
ENTRIES = 20_000


class _Subtree(InputPartition):
    def __init__(self, root: str, path: str, deep: bool, part: int = 0, parts: int = 1) -> None:
        self.root, self.path, self.deep, self.part, self.parts = root, path, deep, part, parts


def _skipped_dir(name: str) -> bool:
    return name.lower() in SKIPPED_DIRS


def _skipped_file(name: str) -> bool:
    low = name.lower()
    return low in SKIPPED_FILES or low.startswith(SKIPPED_STARTS)


def stub(s: os.stat_result) -> bool:
    """Whether a file's content is elsewhere, so that opening it would fetch it; only some systems say so."""
    return bool(getattr(s, "st_file_attributes", 0) & _ELSEWHERE)


def walk(root: str, path: str, deep: bool, part: int = 0, parts: int = 1) -> Iterator[tuple]:
    """Rows of the files of a directory, and with ``deep`` of all below it; of several parts of a directory only one."""
    todo = [path]
    while todo:
        here = todo.pop()
        try:
            with os.scandir(here) as found:
                entries = sorted((e for e in found if parts == 1 or zlib.crc32(e.name.encode("utf-8", "surrogateescape")) % parts == part), key=lambda e: e.name)
        except OSError as e:
            yield (root, here, None, None, False, False, str(e))
            continue
        for e in entries:
            try:
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if deep and not _skipped_dir(e.name):
                        todo.append(e.path)
                elif e.is_file(follow_symlinks=False) and not _skipped_file(e.name):
                    s = e.stat(follow_symlinks=False)
                    yield (root, e.path, s.st_size, s.st_mtime_ns // 1_000_000, stub(s), os.access(e.path, os.R_OK), None)
            except OSError as x:
                yield (root, e.path, None, None, False, False, str(x))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = json.loads(options["roots"])
        self.levels = int(options.get("levels", 2))
        self.entries = int(options.get("entries", ENTRIES))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        level = [(r, r) for r in self.roots]
        for _ in range(self.levels):
            below = []
            for root, path in level:
                n = 0
                try:
                    with os.scandir(path) as found:
                        for e in found:
                            n += 1
                            if not e.is_symlink() and e.is_dir() and not _skipped_dir(e.name):
                                below.append((root, e.path))
                except OSError:
                    pass  # the row of its own partition says so
                parts = max(1, -(-n // self.entries))
                out += [_Subtree(root, path, False, i, parts) for i in range(parts)]
            level = below
        return out + [_Subtree(root, path, True) for root, path in level]

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        yield from walk(partition.root, partition.path, partition.deep, partition.part, partition.parts)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def normal_root(path: str) -> str:
    """Absolute path of a root; it must be a directory that can be reached."""
    full = os.path.abspath(path + "\\" if len(path) == 2 and path[1] == ":" else path)
    if not os.path.isdir(full):
        raise NotADirectoryError(full)
    return full


def prefix(root: str) -> str:
    """The key of a root: what the keys of its files begin with, before the slash."""
    return root.replace("\\", "/").lower().rstrip("/")


def on_network(path: str) -> bool:
    """Whether a path names a share of another machine, also in the long form; devices and long local paths are none."""
    s = path.replace("/", "\\")
    if s.startswith("\\\\?\\"):
        return s[4:8].lower() == "unc\\"
    return s.startswith("\\\\") and s[2:3] not in ("", "\\") and not s.startswith("\\\\.\\")


def typed(text: str, windows: bool = os.name == "nt") -> str:
    """The path a user typed: quotes and schemes gone, a share in the form of the system; a ValueError says what is missing."""
    path = text.strip().strip("\"'").strip()
    if not path:
        raise ValueError("no path")
    for scheme in ("smb://", "file://", "cifs://"):
        if path.lower().startswith(scheme):
            path = "//" + path[len(scheme) :]
    if windows and path.startswith(("\\\\", "//")):
        path = path.replace("/", "\\")
        path = path[:3] + path[3:].rstrip("\\")
        if on_network(path) and not path.startswith("\\\\?\\") and len([p for p in path.split("\\") if p]) < 2:
            raise ValueError(f"{path} names a machine only: add the name of a share")
    elif not windows and path.startswith("//") and not os.path.exists(path):
        raise ValueError(f"{path}: shares are named so on Windows only; mount it and name the folder")
    return path


def usable(roots: list[str]) -> tuple[list[str], list[str]]:
    """(roots that can be reached and lie in no other one, what is wrong with the rest); an error if none can be reached. Roots are
    looked at side by side, since each that is switched off takes its time."""
    if not roots:
        raise ValueError("no root is named")
    good, problems = {}, []

    def look(root: str) -> tuple[str | None, str]:
        try:
            return normal_root(root), ""
        except OSError as e:
            return None, f"{root}: {type(e).__name__}: {e}"

    with ThreadPoolExecutor(min(32, len(roots))) as pool:
        for full, problem in pool.map(look, roots):
            if full is None:
                problems.append(problem)
            else:
                good.setdefault(prefix(full), full)
    if not good:
        raise NotADirectoryError("; ".join(problems))
    return [r for k, r in sorted(good.items()) if not any(k.startswith(o + "/") for o in good if o != k)], problems


def walked(spark: SparkSession, roots: list[str], levels: int = 2) -> DataFrame:
    """The listing of all files below the roots, with the rows of what could not be read."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("roots", json.dumps(roots)).option("levels", levels).load()


def listing(spark: SparkSession, roots: list[str], levels: int = 2) -> DataFrame:
    """The listing of all files below the usable ones of the roots."""
    return walked(spark, usable(roots)[0], levels)


def looked_at(due: DataFrame) -> DataFrame:
    """(path, kind, size, mtime_ms, cloud, readable) of what is at due(path, tree): the file, with the tree flag the files of a
    folder (kind file), or that nothing is there (kind gone). The executors look."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out: list[tuple] = []
            for path, tree in zip(df["path"], df["tree"]):
                try:
                    s = os.stat(path, follow_symlinks=False)
                except OSError:
                    out.append((path, "gone", None, None, False, False))
                    continue
                if stat.S_ISREG(s.st_mode):
                    out.append((path, "file", s.st_size, s.st_mtime_ns // 1_000_000, stub(s), os.access(path, os.R_OK)))
                elif stat.S_ISDIR(s.st_mode) and tree:
                    out += [(r[1], "file", *r[2:6]) for r in walk(path, path, True) if r[6] is None]
            for lo in range(0, len(out), 10_000):
                yield pd.DataFrame(out[lo : lo + 10_000], columns=["path", "kind", "size", "mtime_ms", "cloud", "readable"]).astype({"size": "Int64", "mtime_ms": "Int64"})

    return due.select("path", "tree").mapInPandas(look, "path string, kind string, size long, mtime_ms long, cloud boolean, readable boolean")
