"""The query language: text to a tree of clauses, and the rewrites that need no data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

ANY, NAME, CONTENT, PATH, META = "any", "name", "content", "path", "meta"
WORD, PHRASE, PREFIX, FUZZY = "word", "phrase", "prefix", "fuzzy"
# Fixed values of the language.
SCOPES = {"name:": NAME, "имя:": NAME, "content:": CONTENT, "text:": CONTENT, "текст:": CONTENT, "path:": PATH, "путь:": PATH, "meta:": META, "title:": META}
TYPES = ("ext:", "тип:")
QUOTES = '"«»“”'


@dataclass(frozen=True)
class Clause:
    kind: str
    text: str
    scope: str = ANY
    distance: int = 0


@dataclass
class Parsed:
    """Groups are all required, clauses of a group are alternatives; negatives exclude."""

    groups: list[list[Clause]] = field(default_factory=list)
    negatives: list[Clause] = field(default_factory=list)
    exts: list[str] = field(default_factory=list)


def split(query: str) -> list[str]:
    """Tokens at white space outside quotes. Every kind of quote toggles; one left open takes the rest."""
    out, now, quoted = [], "", False
    for c in query:
        if c in QUOTES:
            quoted = not quoted
            now += '"'
        elif c.isspace() and not quoted:
            out, now = out + [now] * bool(now), ""
        else:
            now += c
    return out + [now] * bool(now)


def _clause(token: str, scope: str) -> Clause | None:
    if token.startswith('"'):
        inner = token[1:].rstrip('"').strip()
        return Clause(PHRASE, inner, scope) if inner else None
    word, tilde, n = token.rpartition("~")
    if tilde and word:
        if not n:
            return Clause(FUZZY, word, scope, 1)
        if re.fullmatch(r"\+?[0-9]+", n) and int(n) < 256:
            return Clause(FUZZY, word, scope, max(1, min(2, int(n))))
        return Clause(WORD, token, scope)
    if len(token) > 1 and token.endswith("*"):
        return Clause(PREFIX, token[:-1], scope)
    return Clause(WORD, token, scope)


def parse(query: str) -> Parsed:
    """Tokens are joined by AND; OR ties the next positive clause to the group before; NOT, - and ! exclude."""
    parsed, either, negative = Parsed(), False, False
    for token in split(query):
        if token in ("OR", "||"):
            either = bool(parsed.groups)
            continue
        if token == "NOT":
            negative = True
            continue
        negate, negative = negative, False
        if token[0] in "-!+" and any(c.isalnum() or c == '"' for c in token[1:]):
            negate, token = negate or token[0] != "+", token[1:]
        prefix = next((p for p in SCOPES if token.startswith(p)), "")
        scope, token = SCOPES.get(prefix, ANY), token[len(prefix) :]
        kind = next((t for t in TYPES if token.startswith(t)), None)
        if kind:
            if not negate:  # a negated type is left out
                parsed.exts += [e for e in (x.strip().lstrip(".").lower() for x in token[len(kind) :].split(",")) if e]
            continue
        clause = _clause(token, scope)
        if clause is None:
            continue
        if negate:
            parsed.negatives.append(clause)
        elif either:
            parsed.groups[-1].append(clause)
            either = False
        else:
            parsed.groups.append([clause])
    return parsed


def narrowed(parsed: Parsed, mode: str) -> Parsed:
    """Mode "name" or "content" takes the place of the scope of clauses that have none."""
    if mode == "all":
        return parsed

    def one(c: Clause) -> Clause:
        return replace(c, scope=mode) if c.scope == ANY else c

    return Parsed([[one(c) for c in g] for g in parsed.groups], [one(c) for c in parsed.negatives], parsed.exts)


def highlight_words(parsed: Parsed, analyse) -> tuple[list[str], list[str]]:
    """(terms, prefixes) to mark in contents: of positive clauses without scope or with that of contents."""
    words, prefixes = set(), set()
    for c in (c for g in parsed.groups for c in g):
        if c.scope not in (ANY, CONTENT):
            continue
        if c.kind == PREFIX:
            prefixes.add(c.text.lower().replace("ё", "е"))
            continue
        words.update(analyse(c.text, True))
        if c.kind == WORD:
            raw = analyse(c.text, False)
            if len(raw) == 1:
                words.update(raw)
    return sorted(words), sorted(prefixes)


def literal_terms(parsed: Parsed) -> list[str]:
    """Lower-cased literal terms of positive clauses over contents, each once, in order: what a viewer marks."""
    seen = dict.fromkeys(c.text.lower() for g in parsed.groups for c in g if c.scope in (ANY, CONTENT) and c.text.strip())
    return list(seen)
