"""What extraction gathers: text with unit boundaries, labels, properties, a limit."""

from __future__ import annotations

from dataclasses import dataclass

UNIT = "\f"
MAX_META = 64 << 10


@dataclass
class Extracted:
    text: str
    units: list[str]
    meta: str
    status: str
    truncated: bool


class Doc:
    """Text under construction: separators never pile up, blanks before a line break go, the limit cuts whole characters."""

    def __init__(self, limit: int) -> None:
        self.limit, self.parts, self.size, self.truncated = limit, [], 0, False
        self.units: list[str] = []
        self.unit_start = 0
        self.meta: list[str] = []

    @property
    def full(self) -> bool:
        return self.size >= self.limit

    @property
    def last(self) -> str:
        return self.parts[-1][-1] if self.parts else ""

    def push(self, text: str) -> None:
        text = text.replace(UNIT, " ") if self.units or UNIT in text else text
        if not text:
            return
        raw = len(text.encode("utf-8", "replace"))
        if self.size + raw > self.limit:
            text = text.encode("utf-8", "replace")[: max(0, self.limit - self.size)].decode("utf-8", "ignore")
            raw = self.limit - self.size
            self.truncated = True
        if text:
            self.parts.append(text)
        self.size += raw

    def _trim(self) -> None:
        while self.parts and self.last in " \t":
            kept = self.parts.pop().rstrip(" \t")
            if kept:
                self.parts.append(kept)

    def newline(self) -> None:
        self._trim()
        if self.last not in ("", "\n", UNIT):
            self.push("\n")

    def tab(self) -> None:
        if self.last not in ("", "\n", "\t", UNIT):
            self.push("\t")

    def space(self) -> None:
        if self.last not in ("", " ", "\n", "\t", UNIT):
            self.push(" ")

    def begin_unit(self, label: str) -> None:
        """A sheet, slide or page begins; one that stayed empty is replaced."""
        label = " ".join(label.replace(UNIT, " ").split("\n"))
        self.newline()
        if self.units and not "".join(self.parts[self.unit_start :]).strip():
            del self.parts[self.unit_start :]
            self.units[-1] = label
            return
        if self.units or self.parts:
            self.parts.append(UNIT)
        self.unit_start = len(self.parts)
        self.units.append(label)

    def add_meta(self, text: str | None) -> None:
        text = " ".join((text or "").split())
        if text and sum(map(len, self.meta)) < MAX_META:
            self.meta.append(text)

    def finish(self) -> Extracted:
        if self.units and not "".join(self.parts[self.unit_start :]).strip():
            del self.parts[max(0, self.unit_start - 1) :]
            self.units.pop()
        text = "".join(self.parts).rstrip()
        meta = "; ".join(dict.fromkeys(self.meta))[:MAX_META]
        return Extracted(text, self.units, meta, "ok" if text.strip(" \n\t\f") or meta else "empty", self.truncated)

    def skipped(self, why: str) -> Extracted:
        return Extracted("", [], "", f"skipped: {why}", False)

    def failed(self, why: str) -> Extracted:
        return Extracted("", [], "", f"error: {why}", False)
