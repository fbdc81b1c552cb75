"""Command line: index a tree, search it, show statistics, show what extraction makes of a file."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from textloom import service
from textloom.functions import values
from textloom.operators import index, run, search, snippets
from textloom.session import build
from textloom.sources import extract as extraction
from textloom.sources import feed
from textloom.streaming import watch


def _index(a: argparse.Namespace) -> None:
    spark = build()
    ix, counters, problems = run.run(run.open_or_create(spark, a.index), a.roots, excludes=a.exclude, skip_dirs=[a.index], force=a.force)
    print(", ".join(f"{k}: {v}" for k, v in counters.items() if v) or "nothing changed")
    for p in problems:
        print("not read:", p, file=sys.stderr)
    if len(ix.segments) > a.segments:
        ix = index.compact(ix)
        index.vacuum(ix)
    print(f"{ix.total} records")


def _forget(a: argparse.Namespace) -> None:
    spark = build()
    print(f"{run.remove_root(index.Index(spark, a.index), a.root).total} records")


def _reset(a: argparse.Namespace) -> None:
    if a.yes or input(f"delete the index in {a.index}? [y/N] ").strip().lower() in ("y", "yes"):
        index.reset(build(), a.index)
        print("deleted")


def _options(a: argparse.Namespace) -> search.Options:
    size = lambda s: values.parse_size(s) if s else None
    return search.Options(
        " ".join(a.query), "name" if a.name else "content" if a.content else "all", a.ext.split(",") if a.ext else [], a.dirs or [], size(a.min_size), size(a.max_size),
        values.parse_date_ms(a.after) if a.after else None, values.parse_date_ms(a.before, True) if a.before else None, a.limit, a.offset, a.sort, not a.no_snippets,
    )


def _search(a: argparse.Namespace) -> None:
    o = _options(a)
    if not o.query.strip() and not any((o.exts, o.dirs, o.min_size, o.max_size, o.after_ms, o.before_ms)):
        sys.exit("nothing to search for")
    ix = index.Index(build(), a.index)
    page, total = snippets.answer(ix, o) if o.snippets and not a.paths else search.answer(ix, o)
    rows = page.collect()  # one page of at most a thousand hits
    if a.json:
        print(json.dumps({"total": total, "hits": [r.asDict(True) for r in rows]}, ensure_ascii=False, indent=2))
        return
    for n, r in enumerate(rows, o.offset + 1):
        print(r["path"] if a.paths else f"{n}. {r['path']}  {values.format_size(r['size'] or 0)}")
        if not a.paths and o.snippets:
            print("   ", (r["location"] + ": " if r["location"] else "") + "".join(p["text"] for p in r["parts"] or []))


def _serve(a: argparse.Namespace) -> None:
    with service.Server(index.Index(build(), a.index), a.port) as server:
        print(f"http://127.0.0.1:{server.server_port}/")
        server.serve_forever()


def _shell(a: argparse.Namespace) -> None:
    shell = service.Shell(index.Index(build(), a.index))
    for line in sys.stdin:
        shown = shell.take(line)
        if shown is None:
            return
        print(shown)


def _watch(a: argparse.Namespace) -> None:
    spark = build()
    spark.dataSource.register(feed.ChangeSource)
    events = spark.readStream.format("changes").option("roots", json.dumps(a.roots)).option("state", a.state).load()
    follower = watch.Follower(run.open_or_create(spark, a.index), a.roots, events, f"{a.state}/checkpoint", excludes=a.exclude, skip_dirs=[a.index, a.state])
    shown = 0
    try:
        while follower.query.isActive:
            follower.wait(5)
            for entry in follower.log[shown:]:
                print(entry)
            shown = len(follower.log)
    except KeyboardInterrupt:
        follower.stop()


def _stats(a: argparse.Namespace) -> None:
    ix = index.Index(build(), a.index)
    size = ix.size()
    print(f"{size['documents']} records, {size['segments']} segments, {values.format_size(size['bytes'])}")
    search.by_value(ix, "ext").show(100, False)
    search.by_value(ix, "status").show(100, False)


def _extract(a: argparse.Namespace) -> None:
    p = Path(a.file)
    got = extraction.extract(p.read_bytes(), p.suffix.lstrip("."))
    print(f"{got.status}; {len(got.units)} units; {got.meta}")
    print(got.text if a.full else got.text[:3000])


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser("textloom")
    sub = top.add_subparsers(required=True)
    p = sub.add_parser("index")
    p.add_argument("roots", nargs="+")
    p.add_argument("--index", required=True)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--force", action="store_true", help="read every file again")
    p.add_argument("--segments", type=int, default=20, help="segments above which the index is written as one")
    p.set_defaults(run=_index)
    p = sub.add_parser("forget")
    p.add_argument("root")
    p.add_argument("--index", required=True)
    p.set_defaults(run=_forget)
    p = sub.add_parser("reset")
    p.add_argument("--index", required=True)
    p.add_argument("--yes", action="store_true")
    p.set_defaults(run=_reset)
    p = sub.add_parser("search")
    p.add_argument("query", nargs="*")
    p.add_argument("--index", required=True)
    for flag in ("--ext", "--min-size", "--max-size", "--after", "--before"):
        p.add_argument(flag)
    p.add_argument("--in", dest="dirs", action="append")
    for flag in ("--name", "--content", "--no-snippets", "--paths", "--json"):
        p.add_argument(flag, action="store_true")
    p.add_argument("-n", "--limit", type=int, default=20)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--sort", choices=["relevance", *search.SORTS], default="relevance")
    p.set_defaults(run=_search)
    p = sub.add_parser("watch")
    p.add_argument("roots", nargs="+")
    p.add_argument("--index", required=True)
    p.add_argument("--state", required=True, help="folder for the listings and the checkpoint of the feed")
    p.add_argument("--exclude", action="append", default=[])
    p.set_defaults(run=_watch)
    p = sub.add_parser("serve")
    p.add_argument("--index", required=True)
    p.add_argument("--port", type=int, default=0)
    p.set_defaults(run=_serve)
    p = sub.add_parser("shell")
    p.add_argument("--index", required=True)
    p.set_defaults(run=_shell)
    p = sub.add_parser("stats")
    p.add_argument("--index", required=True)
    p.set_defaults(run=_stats)
    p = sub.add_parser("extract")
    p.add_argument("file")
    p.add_argument("--full", action="store_true")
    p.set_defaults(run=_extract)
    a = top.parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
