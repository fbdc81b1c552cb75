import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from textloom import session
from textloom.functions import marks
from textloom.operators import capture, maintenance

T0 = dt.datetime(2025, 1, 1)
LIST = "run_id long, path string, size long, mtime_ms long, cloud boolean, readable boolean, batch_no int, listed_at timestamp"
RUNS = "run_id long, started_at timestamp, batches_committed int"
FILES = "key string, size long, mtime_ms long, ver long"
VERSIONS = "ext string, version long, since_run long"
CLOUD = marks.CLOUD_MARK


def retry(attempt, at, version):
    return 1 << 61 | version << 40 | attempt << 32 | at


def row(run, path, size=1, mtime=1, cloud=False, readable=True, batch=1, minute=0):
    return (run, path, size, mtime, cloud, readable, batch, T0 + dt.timedelta(days=run, minutes=minute))


def found(spark, listing, files=(), runs=None, versions=(("txt", 1, 1), ("odt", 1, 1), ("odt", 2, 3))):
    runs = runs or [(r, T0 + dt.timedelta(days=r), 9) for r in (1, 2, 3)]
    root = f"{session.shared_dir(spark)}/found-{uuid.uuid4().hex}"
    got = capture.found(spark.createDataFrame(listing, LIST), spark.createDataFrame(runs, RUNS), spark.createDataFrame(list(files), FILES), spark.createDataFrame(list(versions), VERSIONS), root)
    return sorted((r["run_id"], r["key"]) for r in got.collect())


def test_new_changed_and_unchanged(spark):
    listing = [row(1, "A\\x.txt"), row(1, "A\\x.txt"), row(2, "a/X.TXT"), row(3, "a/x.txt", size=2)]
    assert found(spark, listing) == [(1, "a/x.txt"), (3, "a/x.txt")]
    assert found(spark, listing, [("a/x.txt", 1, 1, 1)] * 2) == [(3, "a/x.txt")]


def test_lost_batches_come_again(spark):
    runs = [(1, T0, 1), (2, T0 + dt.timedelta(days=2), None), (3, T0 + dt.timedelta(days=3), 9)]
    listing = [row(r, f"{n}.txt", batch=b) for r in (1, 2, 3) for n, b in (("a", 1), ("b", 2))] + [row(3, "c.txt", batch=None)]
    assert found(spark, listing, runs=runs) == [(1, "a.txt"), (3, "b.txt")]


def test_latest_sighting_counts(spark):
    listing = [row(1, "a.txt", size=1, minute=1), row(1, "a.txt", size=2, minute=5, batch=99), row(2, "a.txt", size=2)]
    assert found(spark, listing, runs=[(1, T0, 5), (2, T0, 5)]) == [(2, "a.txt")]
    assert found(spark, [row(1, "a.txt", readable=False), row(1, "b.txt", readable=None), row(1, None)]) == []


def test_null_time_is_zero_and_versions_move(spark):
    assert found(spark, [row(1, "a.txt", mtime=None)], [("a.txt", 1, 0, 1)]) == []
    assert found(spark, [row(r, "a.ODT") for r in (1, 2, 3)], [("a.odt", 1, 1, 1)]) == [(3, "a.odt")]
    assert found(spark, [row(1, "a.unknown")], [("a.unknown", 1, 1, 1), ("b", 1, 1, 5)]) == []
    assert found(spark, [row(1, "b")], [("b", 1, 1, 5)]) == [(1, "b")]


def test_cloud_and_retry(spark):
    assert found(spark, [row(1, "a.txt", cloud=True), row(2, "a.txt", cloud=True), row(3, "a.txt")]) == [(1, "a.txt"), (3, "a.txt")]
    now = int((T0 + dt.timedelta(days=1) - dt.datetime(1970, 1, 1)).total_seconds())
    assert found(spark, [row(1, "a.txt")], [("a.txt", 1, 1, retry(1, now - 6 * 3600, 1))]) == [(1, "a.txt")]
    assert found(spark, [row(1, "a.txt")], [("a.txt", 1, 1, retry(1, now - 6 * 3600 + 1, 1))]) == []
    assert found(spark, [row(1, "a.txt")], [("a.txt", 1, 1, retry(1, now, 7))]) == [(1, "a.txt")]


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [row(1, "a.txt")], runs=[(9, T0, 1)], versions=()) == []


def tables(spark, listing, runs, files=()):
    return spark.createDataFrame(listing, LIST), spark.createDataFrame(runs, RUNS), spark.createDataFrame(list(files), FILES), spark.createDataFrame([("odt", 2, 3)], VERSIONS)


def rows_of(job):
    return sorted((r["run_id"], r["key"], r["action"], r["size"]) for r in job.stored().collect())


FULL = [row(1, f"{n}.txt", batch=b) for n, b in (("a", 1), ("b", 2), ("c", 9))] + [row(2, "a.txt", size=5), row(2, "b.txt"), row(2, "c.txt", batch=2)]
ENDS = [(1, T0, 2), (2, T0 + dt.timedelta(days=2), 3)]
WANT = [(1, "a.txt", "new", 1), (1, "b.txt", "new", 1), (2, "a.txt", "changed", 5), (2, "c.txt", "new", 1)]


@pytest.mark.parametrize("stop", ["log", "plan", "sink", "half"])
def test_a_job_that_breaks_off_is_taken_up(spark, tmp_path, stop):
    """Wherever it stops, the plan as written is replayed: neither runs announced since nor rows logged since change it."""
    listing, runs, files, versions = tables(spark, FULL, ENDS)
    job = capture.CaptureJob(spark, f"file://{tmp_path}/job")
    job.append(listing)
    if stop != "log":
        job.run(runs, files, versions, stop_after="plan" if stop == "half" else stop)
        assert job.stored().count() == 0 and job.committed().count() == 0
        if stop == "half":  # a sink that was written in part has no success marker
            job.pending(1).limit(1).write.parquet(f"file://{tmp_path}/job/sink/000001")
            (tmp_path / "job/sink/000001/_SUCCESS").unlink()
        job.append(spark.createDataFrame([row(2, "late.txt"), row(3, "d.txt"), row(3, "a.txt", size=5)], LIST))
        runs = spark.createDataFrame([(1, T0, 0), (2, T0, 0), (3, T0 + dt.timedelta(days=3), 1)], RUNS)
    again = capture.CaptureJob(spark, f"file://{tmp_path}/job")
    assert again.run(runs, files, versions) == 1 and rows_of(again) == WANT
    if stop == "log":
        assert again.run(runs, files, versions) is None and rows_of(again) == WANT
        return
    # What was logged since is the next batch; the row of a run already processed comes too late and is counted.
    assert again.run(runs, files, versions) == 2 and rows_of(again) == sorted([*WANT, (3, "d.txt", "new", 1)])
    assert [r["run_id"] for r in again.planned(2, "runs").where("late").collect()] == [2]
    assert again.run(runs, files, versions) is None
    assert {(r["key"], r["size"]) for r in again.state(files).collect()} == {("a.txt", 5), ("b.txt", 1), ("c.txt", 1), ("d.txt", 1)}


def test_offsets_number_every_entry_once(spark, tmp_path):
    job = capture.CaptureJob(spark, f"file://{tmp_path}/job")
    for run in (1, 2, 3):
        job.append(spark.createDataFrame([row(run, f"{i}.txt") for i in range(50)] * 3, LIST).repartition(5))
    log = job.log()
    per = log.groupBy("part").agg(F.min("offset").alias("a"), F.max("offset").alias("b"), F.count("*").alias("n"), F.countDistinct("offset").alias("d"))
    assert log.count() == 150 and log.agg(F.sum("sightings")).first()[0] == 450 and per.where("a <> 1 or b <> n or d <> n").count() == 0
    _, runs, files, versions = tables(spark, [], [(r, T0, 1) for r in (1, 2, 3)])
    assert job.run(runs, files, versions) == 1
    ends = {r["part"]: r["offset"] for r in job.committed().collect()}
    assert ends == {r["part"]: r["b"] for r in per.collect()} and job.stored().count() == 50


def test_answers_are_begun_anew_and_broken_ones_taken_up(spark, tmp_path):
    t = tables(spark, FULL, ENDS)
    root = f"file://{tmp_path}/answers"
    first = capture.found(*t[:2], t[2], t[3], root)
    job = capture.CaptureJob(spark, f"{root}/000002")
    job.append(t[0])
    job.run(t[1], t[2], t[3], stop_after="plan")
    second = capture.found(spark.createDataFrame([], LIST), *t[1:], root)  # the plan is replayed, the listing not read again
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect())) == sorted((w[0], w[1]) for w in WANT)
    assert capture.found(*t, root).count() == 4 and session.exists(spark, f"{root}/000003/commit")


def test_a_callers_work_is_stored(spark, tmp_path):
    listing, runs, files, versions = tables(spark, FULL, ENDS)
    job = capture.CaptureJob(spark, f"file://{tmp_path}/job")
    job.append(listing)
    job.run(runs, files, versions, lambda rows: rows.withColumn("text", F.upper("key")))
    assert {r["text"] for r in job.stored().collect()} == {"A.TXT", "B.TXT", "C.TXT"}


def test_a_key_seen_very_often_is_one_entry(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("run_id"), F.lit("hot.txt").alias("path"), F.col("id").alias("size"), F.lit(1).cast("long").alias("mtime_ms"), F.lit(False).alias("cloud"), F.lit(True).alias("readable"), F.lit(1).alias("batch_no"), F.lit(T0).alias("listed_at"))
    got = capture.entries(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.first()["sightings"] == 20_000 and "partial_" in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("attempt,hours", [(1, 6), (2, 12), (3, 24), (4, 48), (5, 96), (6, 168), (40, 168), (255, 168)])
def test_backoff(spark, attempt, hours):
    assert spark.range(1).select(marks.unpacked(F.lit(retry(attempt, 1000, 1)))["due"]).first()[0] == 1000 + hours * 3600


def test_marks(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(marks.packed(F.lit(2), F.lit(True), F.lit(True), F.lit(0), F.lit(5))) == CLOUD
    assert one(marks.packed(F.lit(258), F.lit(False), F.lit(True), F.lit(retry(255, 1, 1)), F.lit(5))) == retry(255, 5, 2)
    assert one(marks.packed(F.lit(2), F.lit(False), F.lit(False), F.lit(0), F.lit(5))) == 2
    fresh = lambda ver, v, cloud=False, rescan=None: one(marks.verdict(F.lit(ver), F.lit(v), F.lit(cloud), F.lit(100), again=rescan))
    assert fresh(1, 1) == "fresh" and fresh(1, 1, rescan=F.lit(True)) == "stale" and fresh(0, 1) == "stale" and fresh(CLOUD, 1, True) == "fresh" and fresh(CLOUD, 1) == "stale"
    assert fresh(retry(1, 99, 1), 1) == "deferred" and fresh(retry(1, 99, 2), 1) == "stale" and fresh(CLOUD | retry(1, 99, 1), 1) == "stale"


def test_classify_and_remove(spark):
    listing = spark.createDataFrame([("a", 1, 1, False, True), ("b", 2, 1, False, True), ("c", 1, None, False, True), ("d", 1, 1, False, False)], "key string, size long, mtime_ms long, cloud boolean, readable boolean")
    old = spark.createDataFrame([("a", 1, 1, 1), ("b", 1, 1, 1), ("d", 1, 1, 1), ("x/y", 1, 1, 1), ("z", 1, 1, 1)], FILES)
    acts = maintenance.classify(listing, old, F.lit(1), F.lit(0))
    assert {r["key"]: r["action"] for r in acts.collect()} == {"a": "unchanged", "b": "changed", "c": "new", "d": "unreadable", "x/y": "vanished", "z": "vanished"}
    assert [r["key"] for r in maintenance.removed(acts, spark.createDataFrame([("x",)], "prefix string")).collect()] == ["z"]
    assert maintenance.removed(acts, cancelled=True).count() == 0
    assert maintenance.summary(acts).first().asDict() == {"scanned": 4, "unchanged": 1, "indexed": 2, "removed": 2, "deferred": 0}


def test_state_exclusion_and_roots(spark):
    commits = spark.createDataFrame([("a", 1, False, 1), ("a", 2, True, 1), ("b", 1, False, 1), ("b", 2, False, 5), ("a/b", 1, False, 2)], "key string, commit_id long, deleted boolean, size long")
    assert {(r["key"], r["size"]) for r in maintenance.latest(commits).collect()} == {("b", 5), ("a/b", 2)}
    assert {r["key"] for r in maintenance.delete_path(commits.select("key").distinct(), "a", 3).collect()} == {"a", "a/b"}
    paths = spark.createDataFrame([("d:\\x\\.git\\y",), ("d:\\x\\Thumbs.db",), ("d:\\x\\~$a.doc",), ("d:\\Tmp\\a.BAK",), ("d:\\x\\a.txt",), ("d:\\skip\\a",), (None,)], "path string")
    got = {r["path"]: r["x"] for r in paths.select("path", maintenance.excluded(F.col("path"), ["*.bak"], ["d:\\skip"]).alias("x")).collect()}
    assert [p for p, x in got.items() if not x] == ["d:\\x\\a.txt"]
    roots = spark.createDataFrame([("D:\\a",), ("d:/A/",), ("d:\\a\\b",), ("d:\\ab",)], "root string")
    assert len(maintenance.usable_roots(roots).collect()) == 2
    with pytest.raises(ValueError):
        maintenance.glob_regex("a[b")


def test_batches(spark):
    rows = spark.range(100).select(F.format_string("k%03d", "id").alias("key"), F.lit(10).cast("long").alias("size"))
    got = maintenance.batches(rows, most_bytes=100, most_rows=7, slices=2)
    per = got.groupBy("batch").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    assert per.agg(F.max("n"), F.max("s"), F.sum("n")).first()[2] == 100 and per.agg(F.max("s")).first()[0] <= 100


def test_cuts_are_released(spark):
    from textloom import session

    df = session.cut(spark.range(5), "mine")
    path = session._CUTS[spark.sparkContext.applicationId][-1]
    assert df.count() == 5 and session.exists(spark, path)
    assert session.release(spark) >= 1 and not session.exists(spark, path) and session.release(spark) == 0
