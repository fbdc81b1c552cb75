"""Processing only new or changed records: a numbered log, a plan written ahead, replay, a deduplicating sink.

Method. What the runs see is appended to a log. Each partition of the log numbers its entries from 1, so (partition,
offset) names an entry for ever. A batch begins with its plan: for every partition the offsets after the last committed
one up to the end of the log, for every run how far it becomes durable and its time, and the versions in force. The plan is
written before any work. The batch then reads the log between the planned offsets and nothing else, folds the entries of
each key in the order of their runs over the last state, and writes what is processed to the sink. Last the planned ends
become the committed offsets. A job that breaks off anywhere finds the plan again and replays it as written: what the log
gained since waits for the next batch, and the sink keeps one row per (key, partition, offset). Nothing is skipped,
nothing repeated.

One entry stands for all sightings of a key in a run: of several the latest counts, so a redelivered row adds nothing. They are
combined before they are shuffled, so a path seen very often is one row per task. Entries become durable or not with the
run's plan; the others are left out before the second shuffle, by key, in which log and state meet. The log's partitions are
the tasks that write it, so numbering costs no shuffle.

Defined results: null modification times count as 0, a null batch or readability is not durable, null paths and run ids are no
records; repeated rows and repeated deliveries change nothing; of sightings at the same instant the greater
(batch, size, time) counts; a run the table of runs lacks is not durable; a row of a run that an earlier batch has processed
comes too late and stays in the log unprocessed (the plan counts it); empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.marks import CLOUD_MARK, verdict
from textloom.functions.paths import extension, path_key
from textloom.functions.times import epoch_s, epoch_us
from textloom.session import bounded_broadcast, delete, exists

NO_BATCH = 2**31 - 1
ENTRY = "part int, offset long, key string, run_id long, ext string, seen_us long, first_us long, batch_no int, readable boolean, cloud boolean, size long, mtime_ms long, sightings long"
OFFSETS = "part int, first_offset long, last_offset long"
RUNS = "run_id long, durable_batch int, now_s long, sightings long, first_us long, last_us long, late boolean"
VERSIONS = "ext string, run_id long, version long"
SINK = "key string, part int, offset long, run_id long, action string, size long, mtime_ms long, ver long"
STEPS = ("log", "plan", "sink", "commit")


def versions_in_force(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, ext, version): the highest version announced for an extension up to each run."""
    last = F.lit(runs.agg(F.max("run_id")).first()[0]).cast("long")
    seen = versions.where(F.col("since_run") <= last).select(F.lower("ext").alias("ext"), "version", F.explode(F.sequence(F.col("since_run").cast("long"), last)).alias("run_id"))
    return seen.groupBy("run_id", "ext").agg(F.max("version").alias("version"))


def entries(listing: DataFrame) -> DataFrame:
    """One row per key and run of listing(run_id, path, size, mtime_ms, cloud, readable, batch_no, listed_at): the latest sighting,
    how many there were and when the first and last was."""
    seen = F.coalesce(epoch_us("listed_at"), F.lit(-(2**62)).cast("long"))
    rows = listing.where(F.col("path").isNotNull() & F.col("run_id").isNotNull()).select(
        path_key(F.col("path")).alias("key"),
        F.col("run_id").cast("long").alias("run_id"),
        epoch_us("listed_at").alias("seen"),
        F.struct(
            seen.alias("seen_us"),
            F.coalesce(F.col("batch_no").cast("int"), F.lit(NO_BATCH)).alias("batch_no"),
            F.col("size").cast("long").alias("size"),
            F.coalesce(F.col("mtime_ms").cast("long"), F.lit(0)).alias("mtime_ms"),
            F.coalesce("cloud", F.lit(False)).alias("cloud"),
            F.coalesce("readable", F.lit(False)).alias("readable"),
            extension(F.col("path")).alias("ext"),
        ).alias("e"),
    )
    per = rows.groupBy("key", "run_id").agg(F.max("e").alias("e"), F.count("*").alias("sightings"), F.min("seen").alias("first_us"))
    return per.select("key", "run_id", "e.*", "sightings", "first_us")


class CaptureJob:
    """The log, the plans, the sink and the committed offsets in a folder that outlives failures.

    ``append`` takes in what runs saw, ``run`` processes what is pending. Every step is a table whose success marker is
    written last; a step without one is written again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, kind: str, n: int, table: str = "") -> str:
        return f"{self.root}/{kind}/{n:06d}" + (f"/{table}" if table else "")

    def _done(self, kind: str, table: str = "") -> int:
        """How many steps of the kind are complete; they are numbered from 1 without a gap."""
        n = 0
        while exists(self.spark, self._at(kind, n + 1, table) + "/_SUCCESS"):
            n += 1
        return n

    def _read(self, kind: str, schema: str, last: int, table: str = "") -> DataFrame:
        if not last:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self._at(kind, n, table) for n in range(1, last + 1)))

    def log(self) -> DataFrame:
        return self._read("log", ENTRY, self._done("ends"))

    def append(self, listing: DataFrame) -> int:
        """Adds the entries of a listing to the log, each partition going on from its last offset; returns the append's number."""
        n = self._done("ends") + 1
        ends = self._read("ends", "part int, last_offset long", n - 1)
        base = bounded_broadcast(ends.groupBy("part").agg(F.max("last_offset").alias("last_offset")))
        ordered = entries(listing).sortWithinPartitions("run_id", "key").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        if n > 1:
            numbered = ordered.join(base, "part", "left").withColumn("offset", F.coalesce("last_offset", F.lit(0)) + F.col("at") + 1)
        else:
            numbered = ordered.withColumn("offset", F.col("at") + 1)
        names = [c.split()[0] for c in ENTRY.split(", ")]
        numbered.select(*names).write.mode("overwrite").parquet(self._at("log", n))
        written = self.spark.read.schema(ENTRY).parquet(self._at("log", n))
        written.groupBy("part").agg(F.max("offset").alias("last_offset")).write.mode("overwrite").parquet(self._at("ends", n))
        return n

    def committed(self) -> DataFrame:
        """(part, offset): up to where the log is processed, per partition."""
        return self._read("commit", "part int, offset long", self._done("commit")).groupBy("part").agg(F.max("offset").alias("offset"))

    def plan(self, runs: DataFrame, versions: DataFrame) -> int | None:
        """Writes the plan of the next batch, unless there is one that was not carried out: that one stands. Returns the batch, or
        None if nothing is pending. Its tables have a row per partition, per run, and per run and extension."""
        batch = self._done("commit") + 1
        if exists(self.spark, self._at("plan", batch, "offsets") + "/_SUCCESS"):
            return batch
        log = self.log()
        ends = log.groupBy("part").agg(F.max("offset").alias("last_offset"))
        offsets = ends.join(bounded_broadcast(self.committed()), "part", "left").select("part", (F.coalesce("offset", F.lit(0)) + 1).alias("first_offset"), "last_offset").where("last_offset >= first_offset")
        if offsets.isEmpty():
            return None
        known = runs.select("run_id", F.coalesce(F.col("batches_committed"), F.lit(0)).cast("int").alias("durable_batch"), epoch_s("started_at").alias("now_s")).groupBy("run_id").agg(F.max("durable_batch").alias("durable_batch"), F.max("now_s").alias("now_s"))
        earlier = self._read("plan", RUNS, batch - 1, "runs").agg(F.max("run_id")).first()[0]
        pending = self._between(log, offsets).groupBy("run_id").agg(F.sum("sightings").alias("sightings"), F.min("first_us").alias("first_us"), F.max("seen_us").alias("last_us"))
        pending.join(bounded_broadcast(known), "run_id", "left").select(
            "run_id", F.coalesce("durable_batch", F.lit(0)).alias("durable_batch"), F.coalesce("now_s", F.lit(0).cast("long")).alias("now_s"), "sightings", "first_us", "last_us",
            (F.col("run_id") <= F.lit(earlier if earlier is not None else -(2**62)).cast("long")).alias("late"),
        ).write.mode("overwrite").parquet(self._at("plan", batch, "runs"))
        versions_in_force(versions, runs).select("ext", "run_id", F.col("version").cast("long").alias("version")).write.mode("overwrite").parquet(self._at("plan", batch, "versions"))
        offsets.write.mode("overwrite").parquet(self._at("plan", batch, "offsets"))
        return batch

    def planned(self, batch: int, table: str) -> DataFrame:
        schema = {"offsets": OFFSETS, "runs": RUNS, "versions": VERSIONS}[table]
        return self.spark.read.schema(schema).parquet(self._at("plan", batch, table))

    @staticmethod
    def _between(log: DataFrame, offsets: DataFrame) -> DataFrame:
        """The entries between the planned offsets; the ranges, one a partition, are the side that is sent."""
        return log.join(bounded_broadcast(offsets), "part").where("offset between first_offset and last_offset").drop("first_offset", "last_offset")

    def pending(self, batch: int) -> DataFrame:
        """What the plan gives the batch to replay: its durable entries, with time and version in force."""
        runs = self.planned(batch, "runs").where("not late").select("run_id", "durable_batch", "now_s")
        return (
            self._between(self.log(), self.planned(batch, "offsets"))
            .join(bounded_broadcast(runs), "run_id")
            .where("readable and batch_no <= durable_batch")
            .join(bounded_broadcast(self.planned(batch, "versions")), ["run_id", "ext"], "left")
            .select("key", "part", "offset", "run_id", "size", "mtime_ms", "cloud", F.coalesce("version", F.lit(1)).cast("long").alias("version"), "now_s")
        )

    def run(self, runs: DataFrame, state: DataFrame, versions: DataFrame, process: Callable[[DataFrame], DataFrame] | None = None, stop_after: str | None = None) -> int | None:
        """Processes what is pending over state(key, size, mtime_ms, ver), or takes up what was begun; returns the batch, None if
        nothing was to do. ``process`` gets the rows of SINK and returns them with columns of its own; work it repeats after a
        failure is written over. ``stop_after`` ends early, for tests of failures."""
        batch = self.plan(runs, versions)
        if batch is None or stop_after == "plan":
            return batch
        at = self._at("sink", batch)
        if not exists(self.spark, f"{at}/_SUCCESS"):
            rows = replay(self.pending(batch), self.state(state, batch - 1))
            (process(rows) if process else rows).write.mode("overwrite").parquet(at)
        if stop_after == "sink":
            return batch
        self.planned(batch, "offsets").select("part", F.col("last_offset").alias("offset")).write.mode("overwrite").parquet(self._at("commit", batch))
        return batch

    def stored(self, upto: int | None = None) -> DataFrame:
        """The sink: one row per (key, partition, offset) whatever was delivered twice, of committed batches only."""
        last = self._done("commit") if upto is None else upto
        return deduplicated(self.spark.read.parquet(*(self._at("sink", n) for n in range(1, last + 1)))) if last else self.spark.createDataFrame([], SINK)

    def state(self, base: DataFrame, upto: int | None = None) -> DataFrame:
        """(key, size, mtime_ms, ver): the base state with the last stored row of each key over it."""
        first = base.where(F.col("key").isNotNull()).select("key", F.lit(None).cast("long").alias("run_id"), F.col("size").cast("long").alias("size"), F.col("mtime_ms").cast("long").alias("mtime_ms"), F.col("ver").cast("long").alias("ver"))
        last = self._done("commit") if upto is None else upto
        if not last:
            return first.drop("run_id")
        both = first.unionByName(self.stored(last).select(*first.columns))
        return both.groupBy("key").agg(F.max(F.struct("run_id", "size", "mtime_ms", "ver")).alias("s")).select("key", "s.size", "s.mtime_ms", "s.ver")


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row per (key, partition, offset)."""
    return rows.dropDuplicates(["key", "part", "offset"])


def replay(pending: DataFrame, state: DataFrame) -> DataFrame:
    """(key, part, offset, run_id, action, size, mtime_ms, ver): the entries that are processed, action new, changed or stale.

    Stored records enter as run null of their key, so log and state meet in one shuffle by key; a key has at most one
    entry per run."""
    fields = ("run_id", "part", "offset", "size", "mtime_ms", "cloud", "version", "now_s")
    stored = state.where(F.col("key").isNotNull()).select(
        "key", F.lit(None).cast("long").alias("run_id"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("offset"), "size",
        F.coalesce("mtime_ms", F.lit(0)).cast("long").alias("mtime_ms"), F.lit(False).alias("cloud"), F.coalesce("ver", F.lit(0)).cast("long").alias("version"), F.lit(None).cast("long").alias("now_s"),
    )
    both = pending.select("key", *fields).unionByName(stored.select("key", *fields))
    # Nulls sort first: the stored record comes before what the runs saw.
    per_key = both.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("log"))
    kind = "array<struct<part:int,offset:long,run_id:long,action:string,size:long,mtime_ms:long,ver:long>>"
    start = F.struct(F.lit(False).alias("known"), F.lit(None).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ms"), F.lit(0).cast("long").alias("ver"), F.array().cast(kind).alias("done"))

    def step(s: Column, e: Column) -> Column:
        same = s["size"].eqNullSafe(e["size"]) & (s["mtime_ms"] == e["mtime_ms"])
        action = F.when(~s["known"], "new").when(~same, "changed").when(verdict(s["ver"], e["version"], e["cloud"], e["now_s"]) == "stale", "stale")
        ver = F.when(e["cloud"], F.lit(CLOUD_MARK).cast("long")).otherwise(e["version"])
        done = F.struct(e["part"].alias("part"), e["offset"].alias("offset"), e["run_id"].alias("run_id"), action.alias("action"), e["size"].alias("size"), e["mtime_ms"].alias("mtime_ms"), ver.alias("ver"))

        def became(ver: Column, log: Column) -> Column:
            return F.struct(F.lit(True).alias("known"), e["size"].alias("size"), e["mtime_ms"].alias("mtime_ms"), ver.alias("ver"), log.alias("done"))

        return F.when(e["run_id"].isNull(), became(e["version"], s["done"])).when(action.isNotNull(), became(ver, F.concat(s["done"], F.array(done)))).otherwise(s)

    folded = per_key.where("log[size(log) - 1].run_id is not null").select("key", F.aggregate("log", start, step, lambda s: s["done"]).alias("done"))
    return folded.select("key", F.explode("done").alias("d")).select("key", "d.*")


def found(listing: DataFrame, runs: DataFrame, state: DataFrame, versions: DataFrame, root: str) -> DataFrame:
    """(run_id, key) of every file the runs durably process from the given state, by a job at ``root``.

    The job has a folder per answer. One that was begun and not finished is taken up where it broke off: a log that is complete is
    not appended again, a plan that is written is replayed. A finished one is an answer to keep; the next call begins
    another and deletes those before the last."""
    spark = listing.sparkSession
    n = 1
    while exists(spark, f"{root}/{n:06d}/commit/000001/_SUCCESS") or exists(spark, f"{root}/{n:06d}/empty/_SUCCESS"):
        n += 1
    for old in range(max(1, n - 3), n - 1):
        delete(spark, f"{root}/{old:06d}/log")
    job = CaptureJob(spark, f"{root}/{n:06d}")
    if not job._done("ends"):
        job.append(listing)
    if job.run(runs, state, versions) is None:
        spark.createDataFrame([], OFFSETS).write.mode("overwrite").parquet(f"{root}/{n:06d}/empty")
    return job.stored().select("run_id", "key")
