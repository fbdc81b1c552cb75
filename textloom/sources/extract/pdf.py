"""Text of PDF files by the standard library: objects, filters, page order, text operators, Unicode maps.

Pages are units. A file that a password only keeps from being changed opens with the empty one (40 to 128 bit RC4; other ciphers
count as encrypted). Pages with next to no letters are pictures of text: they go to the recogniser, if one is registered under
``PAGES``, which keeps what has more letters than the page had; a file of nothing else has status "scan", or "ocr" if it was
recognised."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable

from textloom.sources.extract.doc import Doc, Extracted

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|-?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_STRING = rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>"
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
# Letters of a whole file, and of a page, below which it is a picture; pages and seconds a recogniser is given.
FEW, THIN, MOST_PAGES = 3, 20, 30
#: Recognisers of pages: (the file's bytes, page number from 1) -> text or None.
PAGES: list[Callable[[bytes, int], str | None]] = []
# Fixed value: what a password is filled up with.
_FILL = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s = list(range(256))
    j = 0
    for i in range(256):
        j = j + s[i] + key[i % len(key)] & 255
        s[i], s[j] = s[j], s[i]
    out = bytearray(len(data))
    i = j = 0
    for n, c in enumerate(data):
        i = i + 1 & 255
        j = j + s[i] & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[s[i] + s[j] & 255]
    return bytes(out)


def open_key(owner: bytes, user: bytes, rights: int, first_id: bytes, revision: int, length: int, plain_meta: bool = False) -> bytes | None:
    """The key of a file the empty password opens, or None."""
    n = 5 if revision == 2 else length // 8
    key = hashlib.md5(_FILL + owner + (rights & 0xFFFFFFFF).to_bytes(4, "little") + first_id + (b"\xff" * 4 if plain_meta and revision >= 4 else b"")).digest()
    if revision == 2:
        return key[:n] if rc4(key[:n], _FILL) == user else None
    for _ in range(50):
        key = hashlib.md5(key[:n]).digest()
    key = key[:n]
    proof = hashlib.md5(_FILL + first_id).digest()
    for i in range(20):
        proof = rc4(bytes(b ^ i for b in key), proof)
    return key if proof == user[:16] else None


class _File:
    def __init__(self, data: bytes) -> None:
        found = list(_OBJECT.finditer(data))
        self.objects: dict[int, bytes] = {int(m[1]): m[3] for m in found}
        self.plain: dict[bytes, bytes] = {}  # streams of an encrypted file
        self.locked = re.search(rb"/Encrypt\s", data) is not None
        key = self._key(data) if self.locked else None
        if key:
            self.locked = False
            for m in found:
                if (x := _STREAM.search(m[3])) and b"/XRef" not in m[3][: x.start()]:
                    own = hashlib.md5(key + int(m[1]).to_bytes(3, "little") + int(m[2]).to_bytes(2, "little")).digest()
                    self.plain[m[3]] = rc4(own[: min(16, len(key) + 5)], x[1])
        for body in list(self.objects.values()):
            if b"/ObjStm" in body[:300]:
                self._unpack(body)

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        raw, head = self.plain.get(body, m[1]), body[: m.start()]
        if b"FlateDecode" in head:
            d = zlib.decompressobj()
            try:
                raw = d.decompress(raw)
            except zlib.error:
                return b""
        elif b"ASCIIHexDecode" in head:
            raw = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw).decode())
        return raw

    def _key(self, data: bytes) -> bytes | None:
        m = re.search(rb"/Encrypt\s+(?:(\d+)\s+\d+\s+R|(<<.*?>>))", data, re.S)
        how = (self.objects.get(int(m[1]), b"") if m[1] else m[2]) if m else b""
        number = lambda name, default: int(x[1]) if (x := re.search(rb"/" + name + rb"\s+(-?\d+)", how)) else default
        text = lambda where, name: _bytes(x[1]) if (x := re.search(rb"/" + name + rb"\s*\[?\s*(" + _STRING + rb")", where, re.S)) else b""
        if b"/Standard" not in how or b"AESV" in how or number(b"V", 0) not in (1, 2, 4):
            return None
        return open_key(text(how, b"O")[:32], text(how, b"U"), number(b"P", 0), text(data, b"ID"), number(b"R", 2), number(b"Length", 40 if number(b"V", 1) < 4 else 128), b"/EncryptMetadata false" in how)

    def _unpack(self, body: bytes) -> None:
        n, first = (re.search(rb"/%s\s+(\d+)" % k, body) for k in (b"N", b"First"))
        data = self.stream(body)
        if not n or not first or not data:
            return
        head = data[: int(first[1])].split()
        pairs = list(zip(head[0::2], head[1::2]))[: int(n[1])]
        for (num, at), nxt in zip(pairs, [*pairs[1:], (b"", str(len(data) - int(first[1])).encode())]):
            self.objects.setdefault(int(num), data[int(first[1]) + int(at) : int(first[1]) + int(nxt[1])])

    def value(self, body: bytes, name: bytes) -> bytes:
        """What follows a name: a dictionary or array as it stands, or the object a reference leads to."""
        m = re.search(rb"/" + name + rb"(?![A-Za-z])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        ref = _REF.match(rest)
        if ref:
            return self.objects.get(int(ref[1]), b"")
        if rest[:2] == b"<<" or rest[:1] == b"[":
            depth = 0
            for t in re.finditer(rb"<<|>>|\[|\]", rest):
                depth += 1 if t[0] in (b"<<", b"[") else -1
                if not depth:
                    return rest[: t.end()]
        return re.match(rb"[^/>\]]*", rest)[0]

    def pages(self) -> list[bytes]:
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out: list[bytes] = []
        seen: set[bytes] = set()

        def down(node: bytes, resources: bytes) -> None:
            if node in seen or len(out) > 20_000:
                return
            seen.add(node)
            own = self.value(node, b"Resources") or resources
            if b"/Kids" in node:
                for r in _REF.finditer(self.value(node, b"Kids")):
                    down(self.objects.get(int(r[1]), b""), own)
            elif re.search(rb"/Type\s*/Page\b", node):
                out.append(node + b" /InheritedResources " + own)

        down(self.value(root, b"Pages"), b"")
        return out or [b for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b)]


def _unicode_map(cmap: bytes) -> tuple[dict[int, str], int]:
    out, width = {}, 1
    text = lambda h: bytes.fromhex(h.decode().replace(" ", "").ljust(4, "0") if len(h) % 2 == 0 else "0" + h.decode()).decode("utf-16-be", "ignore")
    space = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
    if space:
        width = max(1, len(space[1]) // 2)
    for block in re.finditer(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for m in re.finditer(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", block[1]):
            out[int(m[1], 16)] = text(m[2])
    for block in re.finditer(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for m in re.finditer(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block[1], re.S):
            lo, hi = int(m[1], 16), int(m[2], 16)
            if m[3]:
                base = text(m[3])
                for i in range(min(hi - lo + 1, 65536)):
                    out[lo + i] = base[:-1] + chr(ord(base[-1]) + i) if base else ""
            else:
                for i, h in enumerate(re.findall(rb"<([0-9A-Fa-f]*)>", m[4])):
                    out[lo + i] = text(h)
    return out, width


def _bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        h = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())

    def un(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else _ESCAPES.get(c, b"" if c in b"\r\n" else c)

    return re.sub(rb"\\([0-7]{1,3}|.)", un, token[1:-1], flags=re.S)


def page_text(f: _File, page: bytes) -> str:
    resources = f.value(page, b"Resources") or f.value(page, b"InheritedResources")
    fonts = {}
    for m in re.finditer(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", f.value(resources, b"Font")):
        body = f.objects.get(int(m[2]), b"")
        cmap = f.value(body, b"ToUnicode")
        fonts[m[1]] = _unicode_map(f.stream(cmap)) if cmap else (None, 2 if b"/Type0" in body else 1)
    contents = f.value(page, b"Contents")
    parts = [f.stream(contents)] if b"stream" in contents else [f.stream(f.objects.get(int(r[1]), b"")) for r in _REF.finditer(contents)]
    out, args, font, y = [], [], (None, 1), None

    def show(raw: bytes) -> None:
        table, width = font
        if table is None:
            out.append(raw.decode("cp1252", "replace") if width == 1 else "")
        else:
            out.append("".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width)))

    for m in _TOKEN.finditer(b"\n".join(parts)):
        t = m[0]
        if t[:1] in b"(<[]/" or re.fullmatch(rb"-?\d*\.?\d+", t):
            args.append(t)
            continue
        if t == b"Tf" and len(args) >= 2:
            font = fonts.get(args[-2][1:], (None, 1))
        elif t in (b"Tj", b"'", b'"') and args:
            if t != b"Tj":
                out.append("\n")
            show(_bytes(args[-1]))
        elif t == b"TJ":
            for a in args:
                if a[:1] in b"(<":
                    show(_bytes(a))
                elif a[:1] not in b"[]/" and float(a) < -180:
                    out.append(" ")
        elif t in (b"Td", b"TD") and len(args) >= 2 and args[-1][:1] not in b"(<[]/":
            out.append("\n" if float(args[-1]) else " ")
        elif t == b"T*":
            out.append("\n")
        elif t == b"Tm" and len(args) >= 6 and args[-1][:1] not in b"(<[]/":
            out.append("\n" if y is not None and y != args[-1] else " ")
            y = args[-1]
        elif t == b"ET":
            out.append("\n")
        args = []
    text = re.sub(r"[ \t]+", " ", "".join(out))
    return "\n".join(line.strip() for line in text.split("\n") if line.strip())


def _recognised(data: bytes, n: int, had: str) -> str | None:
    """What a recogniser makes of a page, if it has more letters than the page had."""
    for recogniser in PAGES:
        got = recogniser(data, n)
        if got and _letters(got) > _letters(had):
            return got
    return None


def _letters(text: str) -> int:
    return sum(c.isalpha() for c in text)


def read(data: bytes, doc: Doc) -> Extracted:
    f = _File(data)
    if f.locked:
        return Extracted("", [], "", "encrypted", False)
    pages = f.pages()
    letters = asked = read_by_eye = 0
    for n, page in enumerate(pages, 1):
        text = page_text(f, page)
        if PAGES and _letters(text) < THIN and asked < MOST_PAGES:
            asked += 1
            if (got := _recognised(data, n, text)) is not None:
                text, read_by_eye = got, read_by_eye + 1
        letters += _letters(text)
        doc.begin_unit(f"Стр. {n}")
        doc.push(text)
        if doc.full:
            break
    if not pages:
        return doc.failed("no pages")
    got = doc.finish()
    if letters < FEW:
        return Extracted("", [], got.meta, "scan", False)
    return Extracted(got.text, got.units, got.meta, "ocr", got.truncated) if read_by_eye else got
