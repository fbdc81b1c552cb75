"""The inverted index as tables that only grow: segments of records, posting blocks and vocabulary, tied together by commits.

A commit adds a segment (records with a document number each, their posting blocks, and by how much every term's counts
change) and a table of the document numbers that are gone; its manifest, a small file written last and renamed into place,
names the segments that count. A reader takes the last commit and keeps it, so it never sees half a run. ``compact`` writes what
is live as one segment.

Building analyses every document once in Arrow batches. A batch yields one row per term and field with arrays of document
numbers, frequencies, lengths and positions, so a frequent term is a row per batch and not a row per document. These blocks
are spread by range of (field, term, first document): a frequent term fills as many tasks as it needs, the files are in term
order, and a term or a prefix is a range whose pages alone are read. Counts of removed records are taken back by analysing their texts
again, so statistics are those of a fresh build after every commit; their postings stay until compaction and are kept out by
the join with the live records, which every search ends in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.analysis import analyse
from textloom.session import cut, delete, exists, fingerprint, parallel, shared_dir

FORMAT = 3
FIELDS = ("name", "folder", "meta", "content")
#: Documents of one posting block at most.
BATCH = 500
#: The row of a field without a term holds the lengths of its documents.
LENGTHS = ""
BLOCKS = "term string, first long, docs array<long>, tfs array<int>, dls array<int>, positions array<array<int>>, cf long, field string"
VOCABULARY = "term string, df long, cf long, field string"
TEXTS = ("content", "unit_labels")
#: The tables a segment has a part of.
KINDS = ("records", "postings", "vocabulary")


def joined(files: DataFrame, contents: DataFrame) -> DataFrame:
    """One row per key of files, with content and unit_labels. Exact repeats are one record, of several states the latest modified
    counts. One shuffle by key brings records and texts together."""
    rest = [c for c in files.columns if c != "key" and c not in TEXTS]
    first = [c for c in ("mtime_ms", "ver") if c in rest]
    order = [*first, *[c for c in rest if c not in first]]
    f = files.where(F.col("key").isNotNull()).select("key", F.struct(*order).alias("f"))
    c = contents.where(F.col("key").isNotNull()).select("key", F.struct(*TEXTS).alias("c"))
    nil = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    both = f.select("key", "f", nil(c, "c")).unionByName(c.select("key", nil(f, "f"), "c"))
    return both.groupBy("key").agg(F.max("f").alias("f"), F.max("c").alias("c")).where("f is not null").select("key", "f.*", "c.*")


def blocks(records: DataFrame, stem: bool) -> DataFrame:
    """Posting blocks of records(doc, name, folder, meta, content)."""
    schema = pa.schema([
        ("term", pa.string()), ("first", pa.int64()), ("docs", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("dls", pa.list_(pa.int32())),
        ("positions", pa.list_(pa.list_(pa.int32()))), ("cf", pa.int64()), ("field", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                docs = part.column(0).to_pylist()
                for i, field in enumerate(FIELDS, 1):
                    at: dict[str, list[tuple[int, int, list[int]]]] = {}
                    lengths = []
                    for doc, text in zip(docs, part.column(i).to_pylist()):
                        own: dict[str, list[int]] = {}
                        n = 0
                        for p, t in analyse(text, stem):
                            n += 1
                            if t in own:
                                own[t].append(p)
                            else:
                                own[t] = [p]
                        if n:
                            lengths.append((doc, n))
                            for t, places in own.items():
                                if t in at:
                                    at[t].append((doc, n, places))
                                else:
                                    at[t] = [(doc, n, places)]
                    if not lengths:
                        continue
                    terms = sorted(at)
                    rows = [r for t in terms for r in at[t]]
                    of_term = np.cumsum([0, *(len(at[t]) for t in terms)], dtype=np.int32)
                    tfs = np.array([len(r[2]) for r in rows], np.int32)
                    of_row = np.concatenate(([0], np.cumsum(tfs))).astype(np.int32)
                    every = np.fromiter(chain.from_iterable(r[2] for r in rows), np.int32, int(of_row[-1]))
                    ids = np.array([r[0] for r in rows], np.int64)
                    lists = lambda v, off=of_term: pa.ListArray.from_arrays(pa.array(off), pa.array(v))
                    places = pa.ListArray.from_arrays(pa.array(of_term), pa.ListArray.from_arrays(pa.array(of_row), pa.array(every)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(terms, pa.string()), pa.array(ids[of_term[:-1]]), lists(ids), lists(tfs), lists(np.array([r[1] for r in rows], np.int32)), places, pa.array(np.add.reduceat(tfs, of_term[:-1]).astype(np.int64)), pa.array([field] * len(terms), pa.string())],
                        schema=schema,
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([LENGTHS]), pa.array([lengths[0][0]]), pa.array([[d for d, _ in lengths]], pa.list_(pa.int64())), pa.array([[]], pa.list_(pa.int32())), pa.array([[n for _, n in lengths]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.list_(pa.int32()))), pa.array([sum(n for _, n in lengths)], pa.int64()), pa.array([field])],
                        schema=schema,
                    )

    return parallel(records.select("doc", *FIELDS)).mapInArrow(run, BLOCKS)


def _counts(found: DataFrame, sign: int = 1) -> DataFrame:
    """(term, df, cf, field) of blocks, for terms and, under LENGTHS, for the field itself."""
    return found.groupBy("field", "term").agg((F.sum(F.size("docs")) * sign).cast("long").alias("df"), (F.sum("cf") * sign).cast("long").alias("cf")).select("term", "df", "cf", "field")


class Index:
    """One commit of an index in a folder, the last one unless another is named."""

    def __init__(self, spark: SparkSession, path: str, commit: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        found = commits(spark, self.path)
        if not found:
            raise FileNotFoundError(f"{path} holds no index")
        self.manifest = json.loads(_read(spark, f"{self.path}/commits/{(commit or found[-1]):09d}.json"))
        if self.manifest["format"] != FORMAT:
            raise ValueError(f"the index has format {self.manifest['format']}, this library reads {FORMAT}: build it anew")
        self.commit, self.stem, self.total = self.manifest["commit"], bool(self.manifest["stem"]), self.manifest["total"]
        # One entry per field: a handful of numbers the driver keeps.
        self.stats = {f: (docs, length / docs) for f, (docs, length) in self.manifest["fields"].items() if docs}
        self.segments: list[str] = self.manifest["segments"]

    def reload(self) -> Index:
        """The index as of now."""
        return Index(self.spark, self.path)

    def _table(self, kind: str, schema: str | None = None) -> DataFrame:
        """One scan over the segments of a kind, however many there are."""
        read = self.spark.read.option("basePath", f"{self.path}/{kind}")
        if schema:
            read = read.schema(schema + ", segment string")
        return read.parquet(*(f"{self.path}/{kind}/segment={s}" for s in self.segments)).drop("segment")

    @property
    def records(self) -> DataFrame:
        """The live records: doc, the attributes, content and unit_labels. Columns that are not asked for are not read."""
        every = self._table("records")
        gone = [f"{self.path}/gone/{g}" for g in self.manifest["gone"]]
        return every.join(self.spark.read.schema("doc long").parquet(*gone), "doc", "left_anti") if gone else every

    @property
    def files(self) -> DataFrame:
        return self.records.drop(*TEXTS)

    @property
    def contents(self) -> DataFrame:
        return self.records.select("doc", "key", *TEXTS)

    @property
    def blocks(self) -> DataFrame:
        """The posting blocks of all segments, those of documents that are gone as well."""
        return self._table("postings", BLOCKS)

    @property
    def counts(self) -> DataFrame:
        deltas = self._table("vocabulary", VOCABULARY)
        if len(self.segments) == 1 and not self.manifest["gone"]:
            return deltas
        return deltas.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")

    @property
    def vocabulary(self) -> DataFrame:
        """(field, term, df, cf) over the live records."""
        return self.counts.where(F.col("term") != LENGTHS)

    def size(self) -> dict[str, int]:
        """Documents, segments and bytes on disk."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return {"documents": self.total, "segments": len(self.segments), "bytes": fs.getContentSummary(p).getLength()}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def commits(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all commits, in order."""
    fs, p = _fs(spark, f"{path}/commits")
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))


def _publish(spark: SparkSession, path: str, manifest: dict) -> Index:
    """Writes a manifest under another name and renames it: a commit is there or not, and of two writers one fails."""
    fs, tmp = _fs(spark, f"{path}/commits/.{uuid.uuid4().hex}")
    out = fs.create(tmp)
    out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
    out.close()
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{manifest['commit']:09d}.json")
    if fs.exists(final) or not fs.rename(tmp, final):
        fs.delete(tmp, False)
        raise RuntimeError(f"another writer made commit {manifest['commit']}")
    return Index(spark, path)


def _segment(spark: SparkSession, path: str, name: str, records: DataFrame, stem: bool, number: int, taken_back: DataFrame | None = None) -> tuple[int, dict[str, tuple[int, int]]]:
    """Writes a segment; returns how many records it has and by how much the fields' documents and lengths change."""
    if "doc" not in records.columns:
        records = records.withColumn("doc", F.lit(number << 48) + F.monotonically_increasing_id())
    at = {kind: f"{path}/{kind}/segment={name}" for kind in KINDS}
    records.write.mode("overwrite").parquet(at["records"])
    stored = spark.read.parquet(at["records"])
    found = cut(blocks(stored, stem), "blocks")
    by_term = ("field", "term", "first")
    counts = _counts(found)
    if taken_back is not None:
        counts = counts.unionByName(_counts(blocks(taken_back, stem), -1)).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df <> 0 or cf <> 0")
    bloom = {"parquet.bloom.filter.enabled#term": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    postings = found.repartitionByRange(*by_term).sortWithinPartitions(*by_term)
    # Both are made from the blocks, side by side.
    with ThreadPoolExecutor(2) as pool:
        jobs = [pool.submit(lambda: postings.write.mode("overwrite").partitionBy("field").parquet(at["postings"])), pool.submit(lambda: counts.sortWithinPartitions("field", "term").write.mode("overwrite").options(**bloom).partitionBy("field").parquet(at["vocabulary"]))]
        for job in jobs:
            job.result()
    lengths = spark.read.schema(VOCABULARY).parquet(at["vocabulary"]).where(F.col("term") == LENGTHS).collect()  # one row per field
    return stored.count(), {r["field"]: (r["df"], r["cf"]) for r in lengths}


def build(spark: SparkSession, files: DataFrame, contents: DataFrame, path: str, stem: bool = True) -> Index:
    """Builds the index of the folder anew; readers of an earlier commit are not disturbed until ``vacuum``."""
    return rebuilt(spark, joined(files, contents), path, stem)


def rebuilt(spark: SparkSession, records: DataFrame, path: str, stem: bool) -> Index:
    """The first commit of a folder, or one that takes the place of all segments before it."""
    path = path.rstrip("/")
    number = (commits(spark, path) or [0])[-1] + 1
    name = f"{number:09d}-{uuid.uuid4().hex[:8]}"
    total, fields = _segment(spark, path, name, records, stem, number)
    return _publish(spark, path, {"format": FORMAT, "stem": stem, "commit": number, "segments": [name], "gone": [], "total": total, "fields": fields})


def upsert(ix: Index, records: DataFrame, removed: DataFrame | None = None) -> Index:
    """The next commit: records(key, attributes, content, unit_labels) stored in place of what their keys had, and the keys of
    ``removed`` deleted. Work grows with the change, but for one pass over the keys of the live records."""
    spark, number = ix.spark, ix.commit + 1
    records = cut(records, "added")
    keys = records.select("key")
    if removed is not None:
        keys = keys.unionByName(removed.select("key"))
    old = cut(ix.records.join(keys.distinct(), "key", "left_semi").select("doc", *FIELDS), "replaced")
    name = gone = f"{number:09d}-{uuid.uuid4().hex[:8]}"
    added, change = _segment(spark, ix.path, name, records, ix.stem, number, old)
    old.select("doc").write.mode("overwrite").parquet(f"{ix.path}/gone/{gone}")
    lost = spark.read.parquet(f"{ix.path}/gone/{gone}").count()
    fields = {f: [a + b for a, b in zip(ix.manifest["fields"].get(f, (0, 0)), change.get(f, (0, 0)))] for f in FIELDS}
    return _publish(spark, ix.path, {
        "format": FORMAT, "stem": ix.stem, "commit": number, "segments": [*ix.segments, name], "gone": [*ix.manifest["gone"], *([gone] if lost else [])],
        "total": ix.total + added - lost, "fields": fields,
    })


def compact(ix: Index) -> Index:
    """A commit of one segment with what is live."""
    return rebuilt(ix.spark, ix.records.drop("doc"), ix.path, ix.stem)


def vacuum(ix: Index, keep: int = 1) -> int:
    """Deletes the commits but the last ``keep``, and the tables no kept one names; returns how many tables went. Not to be called
    while others read older commits."""
    spark = ix.spark
    numbers = commits(spark, ix.path)
    kept = [json.loads(_read(spark, f"{ix.path}/commits/{n:09d}.json")) for n in numbers[-keep:]]
    named = {f"segment={x}" for m in kept for x in m["segments"]} | {x for m in kept for x in m["gone"]}
    for n in numbers[:-keep]:
        delete(spark, f"{ix.path}/commits/{n:09d}.json")
    old = 0
    for kind in (*KINDS, "gone"):
        fs, p = _fs(spark, f"{ix.path}/{kind}")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName() not in named:
                fs.delete(s.getPath(), True)
                old += 1
    return old


def reset(spark: SparkSession, path: str) -> None:
    """Deletes the index of a folder, and nothing if the folder holds none."""
    if commits(spark, path):
        delete(spark, path)


_OPEN: dict[tuple, Index] = {}


def opened(spark: SparkSession, sf_dir: str, stem: bool) -> Index:
    """The index over the tables of a folder, built in the shared folder on first use and found there by other processes."""
    files, contents = spark.read.parquet(f"{sf_dir}/files.parquet"), spark.read.parquet(f"{sf_dir}/contents.parquet")
    path = f"{shared_dir(spark)}/index{FORMAT}-{fingerprint(files)[:16]}-{fingerprint(contents)[:16]}-{int(stem)}"
    at = (spark.sparkContext.applicationId, path)
    if at not in _OPEN:
        _OPEN[at] = Index(spark, path) if commits(spark, path) else build(spark, files, contents, path, stem)
    return _OPEN[at]
