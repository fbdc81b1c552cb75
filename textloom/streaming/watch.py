"""Change feed: debounce, throttle, and the follower that applies what is due to an index.

Streaming keeps one row of state per path (timers in processing time, as a watcher needs). The same rules over recorded
events, in event time, are plain window functions.
"""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.paths import covers, path_key
from textloom.operators import run
from textloom.operators.index import Index
from textloom.session import cut
from textloom.sources.tree import on_network, prefix

# Silence before a path is due, least time between two runs over it, full checks.
QUIET_MS = 1500
AGAIN_MS = 30_000
FULL_CHECK_S = 6 * 3600
FULL_CHECK_NETWORK_S = 600
TREE_OPS = ("create", "rename", "unknown")


def events(feed: DataFrame) -> DataFrame:
    """(key, ts_ms, tree): exact repeats once; a null op counts as unknown."""
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    op = F.coalesce("op", F.lit("unknown"))
    return feed.where(F.col("path").isNotNull() & F.col("ts").isNotNull()).select(path_key(F.col("path")).alias("key"), ms.alias("ts_ms"), (op.isin(*TREE_OPS) & F.coalesce("introduces_path", F.lit(True))).alias("tree")).distinct()


def debounced(feed: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """(key, first_ms, due_ms, events, tree): runs of events of a path with less than the quiet time between them."""
    w = Window.partitionBy("key").orderBy("ts_ms")
    gap = F.col("ts_ms") - F.lag("ts_ms").over(w)
    marked = events(feed).withColumn("start", F.when(gap.isNull() | (gap >= quiet_ms), 1).otherwise(0))
    runs = marked.withColumn("run", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("key", "run").agg(F.min("ts_ms").alias("first_ms"), (F.max("ts_ms") + quiet_ms).alias("due_ms"), F.count("*").alias("events"), F.max("tree").alias("tree")).drop("run")


def throttled(feed: DataFrame, quiet_ms: int = QUIET_MS, again_ms: int = AGAIN_MS) -> DataFrame:
    """(key, at_ms): when each debounced run is worked on, at its due time or again_ms after the last time, runs that
    wait together as one. Events of a path are in time order, folded in one pass by Arrow batches per key."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[int] = []
        for due in sorted(pdf["due_ms"]):
            if out and due <= out[-1]:
                continue  # waits with the run already put off
            out.append(max(due, out[-1] + again_ms) if out else due)
        return pd.DataFrame({"key": key[0], "at_ms": out})

    return debounced(feed, quiet_ms).select("key", "due_ms").groupBy("key").applyInPandas(fold, "key string, at_ms long")


def due_stream(feed: DataFrame, quiet_ms: int = QUIET_MS, again_ms: int = AGAIN_MS) -> DataFrame:
    """The streaming form over readStream events(path, op, introduces_path): a row (key, path, tree, events) once a path was
    quiet for quiet_ms, and not sooner than again_ms after its last row unless nothing is at the path any more. State is one small
    row per path that is pending or was due within again_ms."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            tree, n, path, last = state.get
            if not n:
                state.remove()
                return
            wait = last + again_ms - now
            if wait > 0 and os.path.lexists(path):
                state.setTimeoutDuration(wait)
                return
            yield pd.DataFrame({"key": [key[0]], "path": [path], "tree": [tree], "events": [n]})
            state.update((False, 0, path, now))
            state.setTimeoutDuration(again_ms)
            return
        tree, n, path, last = state.get if state.exists else (False, 0, "", -again_ms)
        for f in frames:
            tree, n, path = bool(tree or f["tree"].any()), n + len(f), f["path"].iloc[-1]
        state.update((tree, n, path, last))
        state.setTimeoutDuration(quiet_ms)

    op = F.coalesce("op", F.lit("unknown"))
    rows = feed.where(F.col("path").isNotNull()).select(path_key(F.col("path")).alias("key"), "path", (op.isin(*TREE_OPS) & F.coalesce("introduces_path", F.lit(True))).alias("tree"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, path string, tree boolean, events long", "tree boolean, events long, path string, last long", "append", "ProcessingTimeTimeout")


class Follower:
    """An index kept in step with its roots: a run to begin with, due paths from a feed of events, and full checks by the clock.

    The feed is any stream of (path, op, introduces_path); paths at which nothing is to be done cost a look. Batches and full checks
    commit one after another. ``wait`` gives time to the stream and sees to the full checks; ``rescan`` asks for one after lost events."""

    def __init__(self, ix: Index, roots: list[str], feed: DataFrame, checkpoint: str, quiet_ms: int = QUIET_MS, again_ms: int = AGAIN_MS, full_s: float | None = None, trigger: str = "1 second", **options) -> None:
        self.roots, self.options, self.lock = roots, options, threading.Lock()
        self.network = any(on_network(r) for r in roots)
        self.full_s, self.lost = full_s, False
        self.spark, self.path, self.log = ix.spark, ix.path, []
        self.last = self.event = time.monotonic()
        self.query = due_stream(feed, quiet_ms, again_ms).writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
        # The run comes once the feed has looked: what happens between the two is seen by one of them.
        while self.query.isActive and self.query.lastProgress is None and time.monotonic() - self.last < 60:
            self.query.awaitTermination(0.1)
        self._run()

    def _run(self) -> None:
        with self.lock:
            ix, counters, problems = run.run(Index(self.spark, self.path), self.roots, **self.options)
            self.last, self.lost, self.event = time.monotonic(), False, time.monotonic()
            self.log.append({"commit": ix.commit, "problems": problems, **counters})

    def _batch(self, due: DataFrame, n: int) -> None:
        # In a thread of its own: that of the stream has little stack left for generating code.
        with ThreadPoolExecutor(1) as pool:
            pool.submit(self._apply, cut(due.select("path", "tree"), "batch")).result()

    def _apply(self, due: DataFrame) -> None:
        # A batch that is repeated after a failure finds its paths as they are now and does no harm.
        prefixes = [prefix(r) for r in self.roots]
        own = due.select("path", "tree").where(reduce(Column.__or__, [covers(F.lit(p), path_key(F.col("path"))) for p in prefixes]))
        with self.lock:
            ix, counters = run.apply(Index(self.spark, self.path), own, **{k: v for k, v in self.options.items() if k in ("excludes", "skip_dirs", "load")})
            self.event = time.monotonic()
            if any(counters.values()):
                self.log.append({"commit": ix.commit, **counters})

    def rescan(self) -> None:
        self.lost = True

    def wait(self, seconds: float) -> None:
        end = time.monotonic() + seconds
        while time.monotonic() < end and self.query.isActive:
            self.query.awaitTermination(min(0.3, max(0.01, end - time.monotonic())))
            now = time.monotonic()
            if self.full_s is not None and now - self.last >= self.full_s or full_check_due(now - self.last, self.network, self.lost, (now - self.event) * 1000):
                self._run()

    def stop(self) -> None:
        self.query.stop()


def full_check_due(seconds_since: float, network: bool = False, overflow: bool = False, quiet_ms: float = 0) -> bool:
    """Whether to compare everything again: every six hours, ten minutes with network roots, or after lost events once it is quiet."""
    return seconds_since >= (FULL_CHECK_NETWORK_S if network else FULL_CHECK_S) or overflow and quiet_ms >= QUIET_MS


def windowed_counts(feed: DataFrame, length: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Events per window and kind; as a stream, windows close once the watermark has passed them."""
    ts = feed.withColumn("ts", F.col("ts").cast("timestamp"))
    if feed.isStreaming:
        ts = ts.withWatermark("ts", late)
    return ts.groupBy(F.window("ts", length), F.coalesce("op", F.lit("unknown")).alias("op")).agg(F.count("*").alias("events")).select("window.start", "window.end", "op", "events")
