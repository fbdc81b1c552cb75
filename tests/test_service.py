import datetime as dt
import json
import threading
import urllib.error
import urllib.request

import pytest

from textloom import service
from textloom.operators import run
from textloom.operators.search import Options
from textloom.sources.feed import ChangeSource
from textloom.streaming import watch


def test_parameters():
    p = service.parameters("q=%D1%80%D0%BE%D0%B6%D1%8C+b&ext=docx,pdf&empty=&q=second&flag&bad=%zz")
    assert p == {"q": "рожь b", "ext": "docx,pdf", "bad": "%zz"}
    o = service.options(service.parameters("q=a&mode=name&sort=oldest&ext=.docx,%20PDF&dir=D:/x&limit=500&offset=7&min=1K&max=2M&after=01.01.2023"))
    assert (o.query, o.mode, o.sort, o.limit, o.offset, o.min_size, o.max_size, o.dirs) == ("a", "name", "oldest", 100, 7, 1024, 2 << 20, ["D:/x"]) and o.exts == [".docx", "pdf"] and o.after_ms
    assert service.options({"mode": "x", "sort": "x", "limit": "x"}) == Options()
    with pytest.raises(ValueError):
        service.options({"min": "big"})


@pytest.fixture
def docs(tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    for i in range(5):
        (root / f"зерно{i}.txt").write_text(f"рожь овёс {i}")
    (root / "note.md").write_text("рожь и мельница")
    return root


@pytest.fixture
def ix(spark, tmp_path, docs):
    return run.run(run.open_or_create(spark, f"file://{tmp_path}/ix"), [str(docs)])[0]


def test_http(ix):
    with service.Server(ix) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_port}"

        def get(path, host=None):
            try:
                with urllib.request.urlopen(urllib.request.Request(base + path, headers={"Host": host} if host else {})) as r:
                    return r.status, r.read().decode(), dict(r.headers)
            except urllib.error.HTTPError as e:
                return e.code, e.read().decode(), dict(e.headers)

        status, body, headers = get("/api/search?q=%D0%BE%D0%B2%D1%91%D1%81&limit=2")
        got = json.loads(body)
        assert status == 200 and got["total"] == 5 and len(got["hits"]) == 2 and any(p["hit"] for p in got["hits"][0]["parts"]) and headers["Cache-Control"] == "no-store"
        stats = json.loads(get("/api/stats")[1])
        assert stats["documents"] == 6 and stats["segments"] >= 1 and stats["bytes"] > 0 and stats["by_ext"] == {"txt": 5, "md": 1} and stats["by_status"] == {"ok": 6}
        assert get("/")[0] == 200 and get("/none")[0] == 404 and get("/api/search?min=big")[0] == 400 and get("/", "evil.example")[0] == 403
        run.delete_path(ix, "none")
        run.delete_path(ix.reload(), next(r["path"] for r in ix.files.where("ext = 'md'").collect()))
        assert json.loads(get("/api/stats")[1])["documents"] == 5
        server.shutdown()


def test_shell(ix):
    shell = service.Shell(ix, Options(limit=2))
    assert shell.take("") == "" and shell.take(":help") == service.HELP == shell.take(":what") and shell.take(":limit 4") == "4 hits a page"
    first = shell.take("рожь")
    assert first.startswith("6 found") and "1. " in first and "[рожь]" in first
    second = shell.take(":n")
    assert "5. " in second and "1. " not in second and shell.take(":n") == "this is the last page" and "1. " in shell.take(":p")
    assert shell.take(":ext md") == "types: md" and shell.take("рожь").startswith("1 found") and shell.take(":ext") == "types: all"
    assert shell.take(":name") and shell.take("рожь").startswith("0 found") and shell.take(":sort newest") == "sorted by newest" and shell.take(":q") is None


def test_follower(spark, tmp_path, docs, ix):
    """Created, changed and removed files reach the index; a full check picks up what no event told of."""
    spark.dataSource.register(ChangeSource)
    feed = spark.readStream.format("changes").option("roots", json.dumps([str(docs)])).option("state", str(tmp_path / "state")).load()
    follower = watch.Follower(ix, [str(docs)], feed, str(tmp_path / "cp"), quiet_ms=200, again_ms=300, trigger="200 milliseconds")
    try:
        (docs / "new").mkdir()
        (docs / "new" / "ячмень.txt").write_text("ячмень")
        (docs / "note.md").unlink()
        for _ in range(40):
            follower.wait(1)
            now = ix.reload()
            if now.total == 6 and not now.files.where("ext = 'md'").count():
                break
        assert {r["name"] for r in now.files.collect()} == {"ячмень", *(f"зерно{i}" for i in range(5))}
        commit = now.commit
        follower.stop()
        (docs / "зерно0.txt").unlink()
        follower.rescan()
        follower.full_s = 0
        follower._run()
        assert ix.reload().total == 5 and ix.reload().commit > commit and follower.log[-1]["removed"] == 1
    finally:
        follower.stop()


def test_throttle_holds_back(spark, tmp_path):
    """A path that keeps changing comes again after the least time between two of its rows; one that is gone at once."""
    src = tmp_path / "in"
    src.mkdir()
    busy = tmp_path / "busy.txt"
    busy.write_text("x")
    feed = spark.readStream.schema("path string, op string, introduces_path boolean").json(str(src))
    seen = []

    def take(df, n):
        seen.extend((r["path"], dt.datetime.now()) for r in df.collect())

    def tell(n, *paths):
        (src / f".{n}").write_text("\n".join(json.dumps({"path": p, "op": "modify", "introduces_path": False}) for p in paths))
        (src / f".{n}").rename(src / f"{n}.json")

    q = watch.due_stream(feed, 200, 4000).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    try:
        tell(1, str(busy), "/gone/x")
        for n in range(2, 80):
            q.awaitTermination(0.3)
            if n == 10:
                tell(n, str(busy), "/gone/x")
            if len(seen) >= 4:
                break
    finally:
        q.stop()
    at = lambda p: [t for x, t in seen if x == p]
    assert len(at(str(busy))) == 2 and (at(str(busy))[1] - at(str(busy))[0]).total_seconds() >= 3.9 and len(at("/gone/x")) == 2
