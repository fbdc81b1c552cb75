import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import index, run, search
from textloom.operators.search import Options
from textloom.sources import tree

WORDS = "рожь овёс ячмень просо мука крупа мешок амбар мельница жёрнов barley wheat mill grain sack".split()


def names(ix, query="", **o):
    return sorted(r["key"].rpartition("/")[2] for r in search.matches(ix, Options(query, **o))[0].select("key").collect())


def statistics(ix):
    terms = {(r["field"], r["term"]): (r["df"], r["cf"]) for r in ix.vocabulary.collect()}
    return ix.total, terms, {f: (d, round(a, 9)) for f, (d, a) in ix.stats.items()}


def hits(ix, query):
    return {(r["key"], round(r["score"], 9)) for r in search.matches(ix, Options(query))[0].select("key", "score").collect()}


def same_as_fresh(spark, ix, at):
    fresh = index.rebuilt(spark, ix.records.drop("doc"), at, ix.stem)
    assert statistics(ix) == statistics(fresh)
    for q in ('мука OR grain OR "мука крупа"', "ме* -рожь"):
        assert hits(ix, q) == hits(fresh, q), q


@pytest.fixture
def docs(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    for name, text in (("a.txt", "рожь и мука"), ("b.txt", "овёс"), ("sub/c.txt", "мука крупа"), ("sub/d.txt", "grain")):
        (root / name).write_text(text)
    return root


@pytest.fixture
def ix(spark, tmp_path, docs):
    return run.run(run.open_or_create(spark, f"file://{tmp_path}/ix"), [str(docs)], now_s=1000)[0]


def touch(path, text, ahead=5):
    path.write_text(text)
    t = os.stat(path).st_mtime + ahead
    os.utime(path, (t, t))


def test_first_second_and_third_run(spark, tmp_path, docs, ix):
    assert ix.total == 4 and names(ix, "мука") == ["a.txt", "c.txt"]
    again, counters, problems = run.run(ix, [str(docs)], now_s=2000)
    assert again.commit == ix.commit and counters["unchanged"] == 4 and counters["indexed"] == counters["removed"] == 0 and not problems
    touch(docs / "a.txt", "просо")
    (docs / "e.txt").write_text("мельница мука")
    (docs / "sub/f.txt").write_text("amber")
    (docs / "b.txt").unlink()
    third, counters, _ = run.run(again, [str(docs)], now_s=3000)
    assert (counters["indexed"], counters["removed"], counters["unchanged"]) == (3, 1, 2) and third.total == 5
    assert names(third, "мука") == ["c.txt", "e.txt"] and names(third, "овёс") == [] and names(third, "просо") == ["a.txt"]
    assert names(ix, "мука") == ["a.txt", "c.txt"] and names(index.Index(spark, ix.path, ix.commit), "овёс") == ["b.txt"]  # a reader keeps its commit
    assert ix.reload().commit == third.commit
    same_as_fresh(spark, third, f"file://{tmp_path}/fresh")
    small = index.compact(third)
    assert len(small.segments) == 1 and statistics(small) == statistics(third) and index.vacuum(small) > 0 and names(small.reload(), "мука") == ["c.txt", "e.txt"]


def test_every_commit_equals_a_fresh_build(spark, tmp_path):
    """Random changes over several commits, deletions and repeated keys among them."""
    r = random.Random(11)
    kinds = "key string, path string, name string, name_lc string, ext string, folder string, meta string, status string, size long, mtime_ms long, ver long, content string, unit_labels array<string>"

    def record(i):
        text = " ".join(r.choice(WORDS) for _ in range(r.randint(0, 30))) or None
        return (f"d/{i}.txt", f"d/{i}.txt", f"{r.choice('ab')}{i}", f"a{i}.txt", "txt", "d", r.choice([None, "жёрнов"]), "ok", i, i, 1, text, None)

    ix = index.rebuilt(spark, spark.createDataFrame([record(i) for i in range(40)], kinds), f"file://{tmp_path}/ix", True)
    for step in range(2):
        change = spark.createDataFrame([record(i) for i in r.sample(range(60), 15)], kinds)
        gone = spark.createDataFrame([(f"d/{i}.txt",) for i in r.sample(range(60), 8)], "key string")
        ix = index.upsert(ix, change.join(gone, "key", "left_anti"), gone)
        same_as_fresh(spark, ix, f"file://{tmp_path}/fresh{step}")


def test_what_cannot_be_read_is_kept(spark, tmp_path, docs, ix):
    other = tmp_path / "other"
    other.mkdir()
    (other / "x.txt").write_text("ячмень")
    both, counters, problems = run.run(ix, [str(docs), str(other), str(docs / "sub")], now_s=2000)
    assert both.total == 5 and not problems
    (other / "x.txt").unlink()
    other.rmdir()
    kept, counters, problems = run.run(both, [str(docs), str(other)], now_s=3000)
    assert kept.total == 5 and counters["removed"] == 0 and len(problems) == 1 and str(other) in problems[0]
    with pytest.raises(NotADirectoryError):
        run.run(kept, [str(other)])
    other.mkdir()  # a network root that lists nothing is as good as out of reach; another root is empty
    guarded, counters, problems = run.run(kept, [str(other)], now_s=4000, network=lambda r: True)
    assert guarded.total == 5 and problems
    emptied, counters, _ = run.run(guarded, [str(other)], now_s=4000)
    assert emptied.total == 4 and counters["removed"] == 1


def test_cancelled_and_forced(spark, docs, ix):
    (docs / "b.txt").unlink()
    kept, counters, _ = run.run(ix, [str(docs)], now_s=2000, cancelled=True)
    assert kept.total == 4 and counters["removed"] == 0
    forced, counters, _ = run.run(kept, [str(docs)], now_s=2000, force=True)
    assert counters["indexed"] == 3 and counters["removed"] == 1 and forced.total == 3


def test_failed_reads_wait(spark, docs, ix):
    (docs / "bad.docx").write_bytes(b"PK\x03\x04broken")
    one, counters, _ = run.run(ix, [str(docs)], now_s=10_000)
    assert counters["failed"] == 1 and names(one, "ext:docx") == ["bad.docx"]
    assert run.run(one, [str(docs)], now_s=10_000 + 6 * 3600 - 1)[1]["deferred"] == 1
    two, counters, _ = run.run(one, [str(docs)], now_s=10_000 + 6 * 3600)
    assert counters["failed"] == 1 and run.run(two, [str(docs)], now_s=10_000 + 13 * 3600)[1]["deferred"] == 1


def test_outdated_extraction_and_rescan(spark, docs, ix):
    old = ix.records.where("name = 'a'").withColumns({"ver": F.lit(7).cast("long"), "content": F.lit("старое")}).drop("doc")
    stale = index.upsert(ix, old)
    back, counters, _ = run.run(stale, [str(docs)], now_s=2000)
    assert counters["indexed"] == 1 and names(back, "рожь") == ["a.txt"]
    scan = index.upsert(back, back.records.where("name = 'b'").withColumn("status", F.lit("scan")).drop("doc"))
    assert run.run(scan, [str(docs)], now_s=2000)[1]["indexed"] == 0 and run.run(scan, [str(docs)], now_s=2000, rescan=True)[1]["indexed"] == 1


def test_commits_in_parts(spark, docs, tmp_path):
    ix, counters, _ = run.run(run.open_or_create(spark, f"file://{tmp_path}/parts"), [str(docs)], now_s=1, commit_files=1)
    assert counters["indexed"] == 4 and ix.total == 4 and len(ix.segments) > 2 and names(ix, "мука") == ["a.txt", "c.txt"]


def test_folders_taken_out(spark, docs, ix):
    less = run.delete_path(ix, str(docs / "sub"))
    assert names(less) == ["a.txt", "b.txt"] and names(less, "мука") == ["a.txt"]
    same = run.delete_path(less, str(docs) + "x")
    assert same.total == 2 and run.remove_root(same, str(docs)).total == 0
    with pytest.raises(RuntimeError):
        run.delete_path(ix, str(docs / "a.txt"))  # another writer was first
    index.reset(spark, ix.path)
    with pytest.raises(FileNotFoundError):
        index.Index(spark, ix.path)


def test_due_paths(spark, tmp_path, docs, ix):
    touch(docs / "a.txt", "ячмень")
    (docs / "sub/c.txt").unlink()
    (docs / "new/deep").mkdir(parents=True)
    (docs / "new/deep/n.txt").write_text("просо")
    (docs / "seen").mkdir()
    (docs / "seen/s.txt").write_text("просо")
    (docs / ".git").mkdir()
    (docs / ".git/g.txt").write_text("просо")
    due = spark.createDataFrame([(str(docs / p), t) for p, t in (("a.txt", False), ("sub/c.txt", False), ("new", True), ("seen", False), (".git/g.txt", False), ("never", True))], "path string, tree boolean")
    after, counters = run.apply(ix, due, now_s=5)
    assert counters == {"updated": 2, "removed": 1} and names(after, "просо") == ["n.txt"] and names(after, "ячмень") == ["a.txt"] and names(after, "крупа") == []
    import shutil

    shutil.rmtree(docs / "sub")
    after, counters = run.apply(after, spark.createDataFrame([(str(docs / "sub"), False)], "path string, tree boolean"))
    assert counters == {"updated": 0, "removed": 1} and names(after) == ["a.txt", "b.txt", "n.txt"]
    assert run.apply(after, due.limit(0))[0].commit == after.commit


def test_stubs_are_not_opened(spark, ix):
    class Attributes:
        st_file_attributes = 0x400000

    assert tree.stub(Attributes()) and not tree.stub(os.stat(os.getcwd()))
    listing = spark.createDataFrame([("Z:\\none.txt", 5, 7, True, True)], "path string, size long, mtime_ms long, cloud boolean, readable boolean")
    got, counters = run.maintain(ix, listing, run.load_files, F.lit(1), 9, prefixes=[])
    row = got.files.where("name = 'none'").first()
    assert counters["skipped"] == 1 and row["ver"] == 1 << 62 and row["status"] == "skipped"
    assert run.maintain(got, listing, run.load_files, F.lit(1), 9, prefixes=["z:"])[1]["unchanged"] == 1
