"""Near-duplicate records: b-bit MinHash candidates, collision-corrected estimates, exact check, classes.

Method. Each value becomes its set of shingles. Of each of ``hashes`` minima only the low bits are kept: sixteen bits of
each are packed into the signature whose slices are the band keys, one bit of each into a 128-bit sketch. Records that
share a band key are candidates; the number of equal sketch bits, corrected for the half that agree by chance, estimates
their similarity, and only candidates within ``slack`` standard errors of the threshold live on. Those are checked
exactly on their whole texts. A band key is 64 bits of minima, so values that share nothing hardly meet by
chance: n values make n * n / 2**65 such pairs a band, less than one at a billion.

Scale. Values with equal shingle sets are one representative (fingerprint): a task sends the first of them it sees, and those
of several tasks fall together when band rows are sorted, before anything is compared. Band rows are shuffled once by band key
and compared in sorted runs; a run above ``run_cap`` is not compared in its task but cut into blocks whose pairs are spread over
the cluster, so no bucket lands in one task and none is dropped. For the exact check the candidate pairs are grouped by
their common neighbour, large groups in blocks: a text is sent to its group once, not with each of its pairs, and its
shingles are made once.

The result are links between representatives and the membership of records, ``classes`` names the class of every record.
``record_pairs`` is for queries that must list pairs of records: it keeps the keys of a set in packets of bounded size and
pairs packets, so a text held by a third of all records is spread as well.

Defined results: null values and values with fewer words or characters than a shingle have no shingles and no
partners; repeated (id, value) rows count once; very long texts are used whole; ties do not occur (similarity is compared
with >=); empty tables give empty results; columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import bounded_broadcast, cut

WORD = re.compile(r"[^\W_]+")
RUN_CAP = 1024
BLOCK = 8192
#: Pairs a group of the exact check takes before it is cut into blocks.
GROUP = 20_000
_M = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_HASH = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def units(text: str, kind: str) -> np.ndarray:
    """One hash per word, or per character, of the lower-cased text."""
    low = text.lower()
    if kind == "words":
        return np.array([_HASH[w] for w in WORD.findall(low)], np.uint64)
    return np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)


def shingles(texts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the distinct hashed shingles of all texts, n units in a row each, one text after another; every
    text has at least n units. Vectorised over the texts."""
    u = _mix(np.concatenate(texts))
    sizes = np.array([len(t) for t in texts])
    h = u[: len(u) - n + 1].copy()
    for i in range(1, n):
        h = (h * _M) ^ u[i : len(u) - n + 1 + i]
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[: len(h)] == owner[n - 1 :]
    h, owner = _mix(h[inside]), owner[: len(h)][inside]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
    h, owner = h[new], owner[new]
    return h, np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))


def shingle_set(text: str, kind: str, n: int) -> set:
    """The shingles of one text themselves."""
    low = text.lower()
    if kind == "words":
        w = WORD.findall(low)
        return set(zip(*(w[i:] for i in range(n))))
    return {low[i : i + n] for i in range(len(low) - n + 1)}


def _coefficients(hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 2**63, hashes, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, hashes, np.uint64)


def signatures(x: np.ndarray, starts: np.ndarray, hashes: int = 128, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(sixteen low bits of each minimum, one bit of each packed into 64-bit words) of the sets that begin at starts."""
    a, b = _coefficients(hashes, seed)
    low = np.empty((len(starts), hashes), np.uint16)
    buffer = np.empty_like(x)
    for i in range(hashes):
        np.multiply(x, a[i], out=buffer)
        buffer += b[i]
        m = np.minimum.reduceat(buffer, starts)
        low[:, i] = (_mix(m) >> np.uint64(20)).astype(np.uint16)
    bits = np.packbits((low & 1).astype(np.uint8), axis=1, bitorder="little")
    return low, np.ascontiguousarray(bits).view(np.uint64).reshape(len(starts), hashes // 64)


def _sign(kinds: dict[str, tuple[str, int]], skip: Callable[[str, str], bool] | None, used: int, hashes: int) -> Callable:
    schema = pa.schema([("place", pa.string()), ("key", pa.string()), ("fp", pa.int64()), ("first", pa.bool_()), ("sig", pa.binary()), ("s0", pa.int64()), ("s1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows: dict[str, list[tuple[str, np.ndarray]]] = {}
            for place, key, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not value or key is None or skip and skip(place, value):
                    continue
                kind, n = kinds[place]
                u = units(value, kind)
                if len(u) >= n:
                    rows.setdefault(place, []).append((key, u))
            for place, had in rows.items():
                for lo in range(0, len(had), 1000):
                    part = had[lo : lo + 1000]
                    x, starts = shingles([u for _, u in part], kinds[place][1])
                    fps = (_mix(np.add.reduceat(x, starts)) ^ np.bitwise_xor.reduceat(x, starts) ^ np.uint64(hash_place(place))).view(np.int64)
                    first = []
                    for fp in fps.tolist():
                        first.append(fp not in seen)
                        seen.add(fp)
                    if len(seen) > 1_000_000:
                        seen.clear()
                    low, words = signatures(x, starts, hashes)
                    low = np.ascontiguousarray(low[:, :used])
                    w = words.view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([place] * len(part), pa.string()),
                            pa.array([k for k, _ in part], pa.string()),
                            pa.array(fps),
                            pa.array(first, pa.bool_()),
                            pa.array([r.tobytes() if f else None for r, f in zip(low, first)], pa.binary()),
                            pa.array(np.ascontiguousarray(w[:, 0])),
                            pa.array(np.ascontiguousarray(w[:, 1])),
                        ],
                        schema=schema,
                    )

    return run


def hash_place(place: str) -> int:
    return xxhash.xxh32_intdigest(place)


def _least_bits(threshold: float, slack: float, bits: int = 128) -> int:
    """Equal sketch bits a pair at the threshold keeps but for chance: agreement is J + (1 - J) / 2."""
    p = (1 + threshold) / 2
    return int(np.floor(bits * p - slack * np.sqrt(bits * p * (1 - p))))


_PAIR = pa.schema([("hot", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("band", pa.int64()), ("at", pa.int64())])
_PAIR_DDL = "hot boolean, a long, b long, s0 long, s1 long, band long, at long"


def _close(x: tuple[np.ndarray, ...], i: np.ndarray, y: tuple[np.ndarray, ...], j: np.ndarray, least: int) -> np.ndarray:
    differ = np.bitwise_count((x[1][i] ^ y[1][j]).view(np.uint64)) + np.bitwise_count((x[2][i] ^ y[2][j]).view(np.uint64))
    return (differ <= 128 - least) & (x[0][i] != y[0][j])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    if len(lo):
        lo, hi = np.unique(np.stack([lo, hi], 1), axis=0).T
    n = len(lo)
    nil = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), pa.array(lo), pa.array(hi), nil, nil, nil, nil], schema=_PAIR)


def _runs(least: int, cap: int) -> Callable:
    """Compares the members of each run of equal band keys in a stream sorted by band key and fingerprint, where rows of one
    fingerprint become one; members of longer runs go on as rows."""

    def hot(band: int, fp: np.ndarray, s0: np.ndarray, s1: np.ndarray, at: int) -> pa.RecordBatch:
        n = len(fp)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(n, bool)), pa.array(fp), pa.nulls(n, pa.int64()), pa.array(s0), pa.array(s1), pa.array(np.full(n, band)), pa.array(np.arange(at, at + n))], schema=_PAIR
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 4
        passed: int | None = None  # the band whose run is passed on
        at, before = 0, None  # how many of it were, and the last fingerprint
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            band, fp, s0, s1 = (np.concatenate([r, x]) for r, x in zip(rest, new))
            if len(band):
                own = np.concatenate(([(band[0], fp[0]) != (passed, before)], (band[1:] != band[:-1]) | (fp[1:] != fp[:-1])))
                band, fp, s0, s1 = band[own], fp[own], s0[own], s1[own]
            if passed is not None:
                k = int(np.argmax(band != passed)) if (band != passed).any() else len(band)
                if k:
                    yield hot(passed, fp[:k], s0[:k], s1[:k], at)
                    at, before = at + k, fp[k - 1]
                band, fp, s0, s1 = band[k:], fp[k:], s0[k:], s1[k:]
                if not len(band):
                    rest = [band, fp, s0, s1]
                    continue
                passed = None
            if not len(band):
                continue
            last = len(band) - int(np.argmax((band != band[-1])[::-1])) if (band != band[-1]).any() else 0
            if len(band) - last > cap:
                passed, before = int(band[-1]), fp[-1]
                yield hot(passed, fp[last:], s0[last:], s1[last:], 0)
                at = len(band) - last
                rest = [x[:0] for x in (band, fp, s0, s1)]
            else:
                rest = [x[last:] for x in (band, fp, s0, s1)]
            yield from done(band[:last], fp[:last], s0[:last], s1[:last])
        if len(rest[0]):
            yield from done(*rest)

    def done(band: np.ndarray, fp: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(band) < 2:
            return
        starts = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
        size = np.diff(np.append(starts, len(band)))
        for k in np.flatnonzero(size > cap):
            i, n = starts[k], size[k]
            yield hot(int(band[i]), fp[i : i + n], s0[i : i + n], s1[i : i + n], 0)
        here = np.repeat(size <= cap, size)
        x = (fp, s0, s1)
        out_a, out_b = [], []
        i = np.flatnonzero(here[:-1] & (band[:-1] == band[1:]))
        d = 1
        while len(i):
            ok = _close(x, i, x, i + d, least)
            out_a.append(fp[i[ok]])
            out_b.append(fp[i[ok] + d])
            d += 1
            i = i[i + d < len(band)]
            i = i[band[i] == band[i + d]]
        if out_a:
            yield _pairs(np.concatenate(out_a), np.concatenate(out_b))

    return run


def _blocks(least: int) -> Callable:
    """Compares two blocks of one long run; a stream sorted by (band, left block, right block, side)."""

    def compare(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        side, fp, s0, s1 = rows
        left = tuple(x[side == 0] for x in (fp, s0, s1))
        right = tuple(x[side == 1] for x in (fp, s0, s1)) if (side == 1).any() else left
        every = np.arange(len(right[0]))
        for k in range(len(left[0])):
            ok = _close(left, np.full(len(every), k), right, every, least)
            if ok.any():
                yield _pairs(np.full(int(ok.sum()), left[0][k]), right[0][ok])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            ids = np.stack(cols[:3], 1)
            edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1), len(ids)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                here = tuple(ids[lo])
                if here != now and held:
                    yield from compare([np.concatenate(x) for x in zip(*held)])
                    held = []
                now = here
                held.append([c[lo:hi] for c in cols[3:]])
        if held:
            yield from compare([np.concatenate(x) for x in zip(*held)])

    return run


def _hot_pairs(hot: DataFrame, least: int, block: int) -> DataFrame:
    """Pairs of the long runs: every pair of blocks is one piece of work somewhere on the cluster."""
    sizes = hot.groupBy("band").agg((F.max("at") / block).cast("long").alias("last"))
    own = (F.col("at") / block).cast("long")
    spread = hot.join(bounded_broadcast(sizes), "band").select("band", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"), "a", "s0", "s1")
    keyed = spread.select("band", F.least("own", "other").alias("l"), F.greatest("own", "other").alias("r"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).cast("long").alias("side"), "a", "s0", "s1")
    return keyed.repartition("band", "l", "r").sortWithinPartitions("band", "l", "r").mapInArrow(_blocks(least), _PAIR_DDL)


def _check(kinds: dict[str, tuple[str, int]], threshold: float) -> Callable:
    """Exact similarity of the pairs of each group; a stream sorted by (group, pair or text), the texts of a group first."""
    schema = pa.schema([("place", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}
        for batch in batches:
            out = []
            for group, is_pair, place, a, b, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if group != now:
                    now, sets = group, {}
                if not is_pair:
                    sets[a] = (place, shingle_set(text, *kinds[place]))
                    continue
                (place, p), (_, q) = sets[a], sets[b]
                common = len(p & q)
                j = common / (len(p) + len(q) - common)
                if j >= threshold:
                    out.append((place, a, b, j))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _grouped(pairs: DataFrame, most: int) -> DataFrame:
    """(group, a, b): pairs by the least neighbour of their a, so that the pairs of one family meet; a group of more than ``most``
    pairs is cut into blocks of its texts, a group per pair of blocks, which bounds the texts a task holds."""
    low = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("hub"))
    at = cut(pairs.join(low, "a").select("hub", "a", "b"), "grouped")
    large = at.groupBy("hub").agg(F.ceil(F.sqrt(F.count("*") / F.lit(most))).cast("int").alias("n")).where("n > 1")
    some = at.join(bounded_broadcast(large), "hub", "left")
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.coalesce("n", F.lit(1)))
    return some.select(F.xxhash64("hub", block("a"), block("b")).alias("group"), "a", "b")


def only(values: DataFrame, wanted: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """The rows of values whose (place, key) may be wanted, by a bitmap of fixed size (``bits``, 1 MB): fewer rows are
    shuffled to the join that follows, which decides. The bitmap is the broadcast side and never grows."""
    per = 32768
    slot = F.pmod(F.xxhash64("place", "key"), F.lit(bits))
    marks = wanted.groupBy((slot / per).cast("long").alias("_page")).agg(F.expr(f"bitmap_construct_agg(pmod(xxhash64(place, key), {bits}) % {per})").alias("_bits"))
    at = values.withColumn("_slot", slot).withColumn("_page", (F.col("_slot") / per).cast("long"))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast((_slot % {per}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    mask = F.expr("shiftleft(1, cast(_slot % 8 as int))")
    return at.join(F.broadcast(marks), "_page").where(byte.bitwiseAND(mask) != 0).select(*values.columns)


def near_duplicates(
    values: DataFrame,
    kinds: dict[str, tuple[str, int]],
    threshold: float = 0.8,
    skip: Callable[[str, str], bool] | None = None,
    hashes: int = 128,
    rows_per_band: int = 4,
    bands: int = 32,
    slack: float = 4.0,
    run_cap: int = RUN_CAP,
    block: int = BLOCK,
    group: int = GROUP,
) -> tuple[DataFrame, DataFrame]:
    """(links, members) of values(place, key, value).

    links(place, a, b, similarity): pairs of different shingle sets, named by fingerprint, with similarity >= threshold.
    members(place, key, fp): the set of every record.
    ``kinds`` gives each place its shingle: ("words" or "characters", how many in a row). ``skip(place, value)`` leaves
    values out. With 32 bands of four minima, a pair at similarity 0.6 becomes a candidate with probability 0.988, at
    0.7 with 0.9998.
    """
    if bands * rows_per_band > hashes or hashes != 128:
        raise ValueError("the sketch takes 128 hashes, and the bands no more than there are")
    values = values.select("place", "key", "value")
    width = 2 * rows_per_band
    signed = cut(values.mapInArrow(_sign(kinds, skip, bands * rows_per_band, hashes), "place string, key string, fp long, first boolean, sig binary, s0 long, s1 long"), "signatures")
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width), F.col("place")) for i in range(bands)))
    rows = signed.where("first").select(F.explode(keys).alias("band"), "fp", "s0", "s1")
    least = _least_bits(threshold, slack)
    found = cut(rows.repartition("band").sortWithinPartitions("band", "fp").mapInArrow(_runs(least, run_cap), _PAIR_DDL), "candidates")
    hot = found.where("hot")
    pairs = found.where(~F.col("hot"))
    if not hot.isEmpty():
        pairs = pairs.unionByName(_hot_pairs(hot, least, block))
    grouped = _grouped(cut(pairs.select("a", "b").distinct(), "pairs"), group)
    needed = grouped.select("group", F.explode(F.array("a", "b")).alias("fp")).distinct()
    # One record stands for a set; its text is looked up by key, once.
    ends = grouped.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = cut(signed.where("first").select("place", "key", "fp").join(ends, "fp").groupBy("place", "fp").agg(F.min("key").alias("key")), "wanted")
    texts = only(values, wanted).join(wanted, ["place", "key"]).groupBy("place", "fp").agg(F.min("value").alias("value"))
    sent = needed.join(texts, "fp").select("group", F.lit(False).alias("is_pair"), "place", F.col("fp").alias("a"), F.lit(None).cast("long").alias("b"), "value")
    asked = grouped.select("group", F.lit(True).alias("is_pair"), F.lit(None).cast("string").alias("place"), "a", "b", F.lit(None).cast("string").alias("value"))
    links = sent.unionByName(asked).repartition("group").sortWithinPartitions("group", "is_pair").mapInArrow(_check(kinds, threshold), "place string, a long, b long, similarity double")
    return links, signed.select("place", "key", "fp")


def record_pairs(links: DataFrame, members: DataFrame, packet: int = 1000) -> DataFrame:
    """(place, key_a, key_b), key_a < key_b: links brought back to records, and the pairs of exact copies.

    The records of a set are kept in packets of about ``packet`` keys, and packets are paired: the output of a large set is as large as
    its pairs, but spread over the cluster."""
    links = cut(links.select("place", "a", "b"), "links")
    ends = links.select("place", F.explode(F.array("a", "b")).alias("fp"))
    sizes = members.groupBy("place", "fp").agg(F.count("*").alias("n"))
    busy = sizes.join(ends.distinct().withColumn("linked", F.lit(True)), ["place", "fp"], "left").where("n > 1 or linked").select("place", "fp", F.ceil(F.col("n") / packet).cast("int").alias("packets"))
    into = F.pmod(F.xxhash64("key"), F.col("packets")).cast("int")
    packets = members.join(busy, ["place", "fp"]).groupBy("place", "fp", "packets", into.alias("no")).agg(F.collect_set("key").alias("keys"))
    packets = cut(packets, "packets")
    a = packets.select("place", F.col("fp").alias("a"), F.col("keys").alias("ka"))
    b = packets.select("place", F.col("fp").alias("b"), F.col("keys").alias("kb"))
    across = links.join(a, ["place", "a"]).join(b, ["place", "b"]).select("place", "ka", "kb")
    within = packets.where("size(keys) > 1").select("place", F.col("keys").alias("ka"), F.col("keys").alias("kb"))
    # Sets of several packets only: each packet with every later one.
    several = packets.where("packets > 1")
    left = several.select("place", "fp", F.col("keys").alias("ka"), F.explode(F.expr("sequence(no, packets - 1)")).alias("with"), F.col("no").alias("i")).where("with > i")
    beside = left.join(several.select("place", "fp", F.col("no").alias("with"), F.col("keys").alias("kb")), ["place", "fp", "with"]).select("place", "ka", "kb")
    both = across.unionByName(within).unionByName(beside)
    each = both.select("place", F.explode("ka").alias("ka"), "kb").select("place", "ka", F.explode("kb").alias("kb"))
    return each.select("place", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).where("key_a < key_b").distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges (place, u, v), u > v: every edge goes on to the least smaller neighbour of its v, then all smaller
    neighbours of a vertex are tied to the least of them. ``moved`` tells which rows are not as they were."""
    up = edges.groupBy("place", F.col("u").alias("v")).agg(F.min("v").alias("m"))
    large = edges.join(up, ["place", "v"], "left").select("place", "u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
    large = large.groupBy("place", "u", "v").agg(F.max("moved").alias("moved"))
    least = large.groupBy("place", "u").agg(F.min("v").alias("m"))
    tied = F.array(F.struct("u", "m", (F.col("moved") | (F.col("v") != F.col("m"))).alias("moved")), F.struct(F.col("v").alias("u"), "m", F.lit(True).alias("moved")))
    small = large.join(least, ["place", "u"]).select("place", F.explode(tied).alias("e")).select("place", "e.u", F.col("e.m").alias("v"), "e.moved")
    return small.where("u != v").groupBy("place", "u", "v").agg(F.max("moved").alias("moved"))


def classes(links: DataFrame, members: DataFrame, rounds: int = 100) -> DataFrame:
    """(place, key, class_id, links): the class of every record, the least fingerprint connected with it, and how many links to other sets
    its set has. Large and small stars in turn over the linked sets only, until nothing moves: then every set is tied to the
    least of its class alone. Rounds grow with the logarithm of the size of a class; each is cut in the shared folder. Should ``rounds``
    not be enough, this raises rather than return unfinished classes."""
    links = cut(links.select("place", "a", "b"), "links")
    both = links.unionByName(links.select("place", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy("place", F.col("a").alias("fp")).agg(F.count("*").alias("links"))
    edges = links.select("place", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    for _ in range(rounds):
        new = cut(_stars(edges), "stars")
        edges = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"classes are not complete after {rounds} rounds")
    named = members.distinct().join(degree, ["place", "fp"], "left").join(edges.select("place", F.col("u").alias("fp"), "v"), ["place", "fp"], "left")
    return named.select("place", "key", F.coalesce("v", "fp").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
