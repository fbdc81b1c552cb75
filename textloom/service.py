"""Search over HTTP and line by line: both answer from the last commit of an index.

``serve`` offers GET /api/search and GET /api/stats as JSON and a plain page, to the own machine only unless told otherwise.
``Shell`` keeps a query, its filters and its page between lines of input. Opening files belongs to the machine that shows them, so
neither does it.
"""

from __future__ import annotations

import json
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from textloom.functions import values
from textloom.operators import search, snippets
from textloom.operators.index import Index
from textloom.operators.search import Options

# Headers that keep a browser from storing, sniffing or loading anything.
HEADERS = {
    "Cache-Control": "no-store", "X-Content-Type-Options": "nosniff", "Referrer-Policy": "no-referrer",
    "Content-Security-Policy": "default-src 'none'; script-src 'unsafe-inline'; style-src 'unsafe-inline'; connect-src 'self'; base-uri 'none'; form-action 'none'",
}
MOST_HITS = 100
PAGE = """<!doctype html><meta charset="utf-8"><title>textloom</title><input id="q" autofocus><ol id="hits"></ol><script>
q.onchange = async () => {
  const r = await (await fetch("/api/search?q=" + encodeURIComponent(q.value))).json();
  hits.replaceChildren(...(r.hits || []).map(h => { const li = document.createElement("li"); li.textContent = h.path + (h.location ? " — " + h.location : ""); return li; }));
};</script>"""


def parameters(query: str) -> dict[str, str]:
    """The parameters of a URL, decoded; the first of a name counts, empty ones do not, and what is no code stays as it is."""
    out: dict[str, str] = {}
    for name, value in parse_qsl(query, errors="replace"):
        out.setdefault(name, value)
    return out


def options(p: dict[str, str]) -> Options:
    """Search options from parameters; a size or date that cannot be read is a ValueError."""

    def read(name: str, parse) -> int | None:
        if name not in p:
            return None
        got = parse(p[name])
        if got is None:
            raise ValueError(f"{name} cannot be read: {p[name]}")
        return got

    def number(name: str, default: int) -> int:
        return int(p[name]) if p.get(name, "").isdigit() else default

    return Options(
        query=p.get("q", ""),
        mode=p["mode"] if p.get("mode") in ("name", "content") else "all",
        sort=p["sort"] if p.get("sort") in search.SORTS else "relevance",
        exts=[e.strip().lower() for e in p.get("ext", "").split(",") if e.strip()],
        dirs=[p["dir"]] if "dir" in p else [],
        limit=min(MOST_HITS, max(1, number("limit", 20))),
        offset=number("offset", 0),
        min_size=read("min", values.parse_size),
        max_size=read("max", values.parse_size),
        after_ms=read("after", values.parse_date_ms),
        before_ms=read("before", lambda v: values.parse_date_ms(v, True)),
    )


def result(ix: Index, o: Options) -> dict:
    page, total = snippets.answer(ix, o) if o.snippets else search.answer(ix, o)
    return {"total": total, "hits": [r.asDict(True) for r in page.collect()]}  # one page


def statistics(ix: Index) -> dict:
    each = lambda c: {r["value"]: r["documents"] for r in search.by_value(ix, c).collect()}  # noqa: E731  a row per type or status
    return {**ix.size(), "by_ext": each("ext"), "by_status": each("status")}


class _Handler(BaseHTTPRequestHandler):
    index: Index

    def do_GET(self) -> None:
        host = (self.headers.get("Host") or "").lower()
        if self.server.local and host not in {f"{h}:{self.server.server_port}" for h in ("127.0.0.1", "localhost")}:
            return self._send(403, "text/plain; charset=utf-8", b"host not allowed")
        url = urlsplit(self.path)
        try:
            if url.path == "/":
                return self._send(200, "text/html; charset=utf-8", PAGE.encode())
            if url.path == "/api/search":
                return self._json(200, result(self.server.current(), options(parameters(url.query))))
            if url.path == "/api/stats":
                return self._json(200, statistics(self.server.current()))
            self._send(404, "text/plain; charset=utf-8", b"not found")
        except ValueError as e:
            self._json(400, {"error": str(e)})
        except Exception as e:  # the service goes on
            self._json(500, {"error": f"{type(e).__name__}: {e}"[:500]})

    def _json(self, status: int, value: dict) -> None:
        self._send(status, "application/json; charset=utf-8", json.dumps(value, ensure_ascii=False).encode())

    def _send(self, status: int, kind: str, body: bytes) -> None:
        self.send_response(status)
        for name, value in {"Content-Type": kind, "Content-Length": str(len(body)), **HEADERS}.items():
            self.send_header(name, value)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_) -> None:
        pass


class Server(ThreadingHTTPServer):
    """The service over an index; every request sees the last commit."""

    def __init__(self, ix: Index, port: int = 0, address: str = "127.0.0.1") -> None:
        super().__init__((address, port), _Handler)
        self.ix, self.local = ix, address in ("127.0.0.1", "localhost")

    def current(self) -> Index:
        self.ix = self.ix.reload()
        return self.ix


HELP = """A line is a query: word word, "phrase", -not, pre*, typo~, a OR b, name: content: path: meta: ext:
:n :p next and previous page   :ext docx,pdf types (none: all)   :name :content :all where   :sort newest   :limit N   :help   :q"""


class Shell:
    """Search line by line: ``take`` gets a line and returns what to show, None at the end."""

    def __init__(self, ix: Index, o: Options | None = None) -> None:
        self.ix, self.o, self.total, self.shown = ix, o or Options(), 0, 0

    def take(self, line: str) -> str | None:
        line = line.strip()
        if not line:
            return ""
        if not line.startswith(":"):
            self.o = replace(self.o, query=line, offset=0)
            return self._page()
        name, _, arg = line[1:].partition(" ")
        arg = arg.strip()
        if name in ("q", "quit", "exit"):
            return None
        if name in ("n", "next"):
            if self.o.offset + self.shown >= self.total:
                return "this is the last page"
            self.o = replace(self.o, offset=self.o.offset + self.o.limit)
            return self._page()
        if name in ("p", "prev"):
            self.o = replace(self.o, offset=max(0, self.o.offset - self.o.limit))
            return self._page()
        if name == "ext":
            self.o = replace(self.o, exts=[e.strip().lstrip(".").lower() for e in arg.split(",") if e.strip()])
            return "types: " + (", ".join(self.o.exts) or "all")
        if name in ("name", "content", "all"):
            self.o = replace(self.o, mode=name)
            return f"searching {name}"
        if name == "sort" and arg in ("relevance", *search.SORTS):
            self.o = replace(self.o, sort=arg)
            return f"sorted by {arg}"
        if name == "limit" and arg.isdigit() and int(arg):
            self.o = replace(self.o, limit=min(200, int(arg)))
            return f"{self.o.limit} hits a page"
        return HELP

    def _page(self) -> str:
        got = result(self.ix, self.o)
        self.total, self.shown = got["total"], len(got["hits"])
        return render(got, self.o)


def render(got: dict, o: Options) -> str:
    """A page as text: ranks from the offset on, paths, sizes, places and fragments with their hits in brackets."""
    lines = [f"{got['total']} found"]
    for n, h in enumerate(got["hits"], o.offset + 1):
        lines.append(f"{n}. {h['path']}  {values.format_size(h['size'] or 0)}")
        if h.get("parts"):
            text = "".join(f"[{p['text']}]" if p["hit"] else p["text"] for p in h["parts"])
            lines.append("    " + (f"{h['location']}: " if h.get("location") else "") + ("… " if h.get("more_before") else "") + text + (" …" if h.get("more_after") else ""))
    return "\n".join(lines)
