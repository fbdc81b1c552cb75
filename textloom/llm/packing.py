"""Filling containers of fixed capacity with items of varying length.

Method: bulk-synchronous best fit. Items are sorted by size, and gaps by what is free in them. In each round one size
sweeps the gaps for its successor, the smallest gap that holds it; where more items want a gap than it takes, the lower
rank goes first; the gaps shrink and the next smaller size follows. Items of one size are interchangeable, as are
containers with the same gap, so a round moves runs of ranks into runs of containers: the sweep works on (size, count)
runs and its outcome, a plan of at most a few runs per size, is bounded by the capacities and not by the data. Each capacity is
swept by a task of its own on the cluster; the plan is applied where the items are: each finds its run by its rank within
its size. (Rounds in which all sizes sweep at once, each a job of the cluster, were simulated on the 0.1 tables: conflicts over
equal gaps make 81 rounds at capacity 256 and 1362 at 8192, and the fill falls to 0.90 there.)

Ranks are made without gathering a size in one task: a size has a salt for every ``PER_SALT`` of its items, items are counted
per (container kind, size, salt), the counts are summed up to offsets, and each salt numbers its own items.

Only an item larger than the capacity is split: into full pieces, each alone in a container, and a rest.

Defined results: items of size 0 or null size are not placed; repeated rows are separate items; ties of size go by id;
an empty table gives no containers; a capacity below 1 is refused; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import bounded_broadcast, cut

#: Items of one size that a task numbers.
PER_SALT = 200_000
#: Runs of the plan that are sent to every task at most, some 40 bytes each; a plan has a few runs per size below the capacity.
MOST_RUNS = 5_000_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (size, first rank, end rank, first container, items per container) of best fit over sizes in falling order."""
    gaps: list[int] = []  # sorted sizes of free room
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of containers
    out, containers = [], 0

    def free(gap: int, a: int, b: int) -> None:
        if gap <= 0 or a >= b:
            return
        if gap not in runs:
            runs[gap] = []
            insort(gaps, gap)
        runs[gap].append((a, b))

    for size in sorted(counts, reverse=True):
        rank, n = 0, counts[size]
        while rank < n:
            i = bisect_left(gaps, size)
            if i == len(gaps):
                break
            gap = gaps[i]
            per = gap // size
            a, b = runs[gap].pop()
            if not runs[gap]:
                del runs[gap]
                gaps.pop(i)
            full = min(b - a, (n - rank) // per)
            if full:
                out.append((size, rank, rank + full * per, a, per))
                free(gap - per * size, a, a + full)
                rank += full * per
            a += full
            if a < b and rank < n:
                rest = n - rank
                out.append((size, rank, n, a, rest))
                free(gap - rest * size, a, a + 1)
                rank, a = n, a + 1
            free(gap, a, b)
        if rank < n:
            per = capacity // size
            full, rest = divmod(n - rank, per)
            if full:
                out.append((size, rank, rank + full * per, containers, per))
                free(capacity - per * size, containers, containers + full)
                containers += full
                rank += full * per
            if rest:
                out.append((size, rank, n, containers, rest))
                free(capacity - rest * size, containers, containers + 1)
                containers += 1
    return out


def _plans(capacities: list[tuple[str, int]]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The plan of one container kind from its (size, count) runs."""

    def one(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
        rows = plan(dict(zip(runs["size"].tolist(), runs["n"].tolist())), int(capacities[key[0]][1]))
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["kind", "size", "first", "end", "container", "per"])

    return one


def pack(sizes: DataFrame, capacities: list[tuple[str, int]], per_salt: int = PER_SALT) -> DataFrame:
    """(pack_name, container_id, doc_id, piece, start_token, tokens) for sizes(doc_id, tokens) and every capacity."""
    if any(c < 1 for _, c in capacities):
        raise ValueError("a capacity is at least 1")
    spark = sizes.sparkSession
    kinds = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.lit(int(c)).cast("long").alias("capacity")) for i, (_, c) in enumerate(capacities))))
    kept = sizes.where("tokens > 0").select("doc_id", "tokens")
    pieces = F.expr("sequence(0L, case when tokens > capacity then (tokens - 1) div capacity else 0L end)")
    items = (
        kept.select("doc_id", "tokens", kinds.alias("k"))
        .select("k.kind", "k.capacity", "doc_id", "tokens")
        .select("kind", "capacity", "doc_id", "tokens", F.explode(pieces).alias("piece"))
        .select("kind", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.least(F.col("tokens") - F.col("piece") * F.col("capacity"), "capacity").alias("size"))
    )
    # One row per kind and size: bounded by the capacities.
    runs = cut(items.groupBy("kind", "size").agg(F.count("*").alias("n")), "runs")
    salts = bounded_broadcast(runs.select("kind", "size", F.ceil(F.col("n") / per_salt).cast("int").alias("salts")), sum(int(c) for _, c in capacities))
    items = items.join(salts, ["kind", "size"]).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")).cast("int")).drop("salts")
    counts = items.groupBy("kind", "size", "salt").agg(F.count("*").alias("n"))
    offset = F.sum("n").over(Window.partitionBy("kind", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("kind", "size", "salt", F.coalesce(offset, F.lit(0)).alias("offset"))
    plans = cut(runs.groupBy("kind").applyInPandas(_plans(capacities), "kind int, size long, first long, end long, container long, per long"), "plan")
    n = plans.count()
    if n > MOST_RUNS:
        raise ValueError(f"the plan has {n} runs, more than {MOST_RUNS}: the capacities are too large for it to be sent")
    table = plans.orderBy("kind", "size", "first").toPandas().to_numpy(np.int64).reshape(-1, 6)
    names = [n for n, _ in capacities]
    width = max(int(c) for _, c in capacities) + 1
    shared = spark.sparkContext.broadcast((table[:, 0] * width + table[:, 1], table[:, 2], table[:, 4], table[:, 5]))
    own = F.row_number().over(Window.partitionBy("kind", "size", "salt").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("own", own).join(offsets, ["kind", "size", "salt"]).select("kind", "size", (F.col("offset") + F.col("own")).cast("long").alias("rank"), "doc_id", "piece", "start_token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, container, per = shared.value
        order = keys.astype(np.float64)  # only to find the slice of a key; exact below 2**53
        for b in batches:
            kind, size, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            key = kind * width + size
            lo, hi = np.searchsorted(order, key, "left"), np.searchsorted(order, key, "right")
            # Binary search for the run of the rank, all rows at once.
            while True:
                mid = (lo + hi) // 2
                open_ = hi - lo > 1
                if not open_.any():
                    break
                up = open_ & (first[np.minimum(mid, len(first) - 1)] <= rank)
                lo = np.where(up, mid, lo)
                hi = np.where(open_ & ~up, mid, hi)
            at = container[lo] + (rank - first[lo]) // per[lo]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(names, object)[kind], pa.string()), pa.array(at), b.column(3), b.column(4), b.column(5), pa.array(size)],
                names=["pack_name", "container_id", "doc_id", "piece", "start_token", "tokens"],
            )

    kind = sizes.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"pack_name string, container_id long, doc_id {kind}, piece long, start_token long, tokens long")


def report(packed: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """(pack_name, capacity, containers, items, tokens, fill): how full the containers are on average."""
    caps = packed.sparkSession.createDataFrame([(n, int(c)) for n, c in capacities], "pack_name string, capacity long")
    per = packed.groupBy("pack_name", "container_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    total = per.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return total.join(F.broadcast(caps), "pack_name").select("pack_name", "capacity", "containers", "items", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
