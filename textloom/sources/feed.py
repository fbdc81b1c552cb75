"""Change feed of directory trees as a streaming source: spark.readStream.format("changes").option("roots", ...).

Spark's file source reports a file once and no deletions. This one compares listings: an offset is the number of a
listing kept in the state folder, and the rows between two offsets are what differs, written before they are given out,
so a batch that is replayed after a failure has the same rows. Rows: ts, path, op (create, modify, remove),
introduces_path.
"""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from textloom.sources.tree import walk

SCHEMA = "ts timestamp, path string, op string, introduces_path boolean"


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.roots = json.loads(options["roots"])
        self.state = options["state"]
        os.makedirs(self.state, exist_ok=True)

    def _file(self, kind: str, n: int) -> str:
        return os.path.join(self.state, f"{kind}-{n:09d}.json")

    def _load(self, kind: str, n: int, default):
        try:
            with open(self._file(kind, n), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return default

    def _store(self, kind: str, n: int, value) -> None:
        path = self._file(kind, n)
        with open(path + ".tmp", "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False)
        os.replace(path + ".tmp", path)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["listing"]
        if not os.path.exists(self._file("changes", n + 1)):
            old = self._load("listing", n, {})
            new, broken = {}, []
            for root in self.roots:
                for _, path, size, mtime, _, readable, error in walk(root, root, True):
                    if error is None:
                        new[path] = [size, mtime]
                    else:
                        broken.append(path)
            # What cannot be read now keeps the state it had.
            for path, was in old.items():
                if path not in new and any(path == b or path.startswith(b.rstrip(os.sep) + os.sep) for b in broken):
                    new[path] = was
            rows = [[p, "create", True] for p in new if p not in old] + [[p, "modify", False] for p in new if p in old and old[p] != new[p]] + [[p, "remove", False] for p in old if p not in new]
            if not rows:
                return iter(()), start
            self._store("listing", n + 1, new)
            self._store("changes", n + 1, [dt.datetime.now(dt.timezone.utc).timestamp(), sorted(rows)])
        return self._rows(n + 1), {"listing": n + 1}

    def _rows(self, n: int) -> Iterator[tuple]:
        at, rows = self._load("changes", n, [0, []])
        when = dt.datetime.fromtimestamp(at, dt.timezone.utc)
        return iter([(when, *r) for r in rows])

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for n in range(start["listing"] + 1, end["listing"] + 1):
            yield from self._rows(n)

    def commit(self, end: dict) -> None:
        for n in range(max(0, end["listing"] - 20), end["listing"]):
            for kind in ("listing", "changes"):
                try:
                    os.remove(self._file(kind, n))
                except FileNotFoundError:
                    pass


class ChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> StructType | str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Changes(self.options)
