"""Noise in text from scanned pages: running headers, page numbers, broken words, misread characters.

Method. The lines of each page are labelled by a linear-chain conditional model with four states: head (running header or page
number above the text), body, break (body whose last word goes on in the next line) and foot. ``TRANSITIONS`` allows heads
first and feet last and weighs a further line of either; a line's potential is a weighted sum of features (``WEIGHTS``): the shape
of page numbers and whether they count up through the document, the shape of a header, how many pages repeat the line, the
words it begins and ends with, how its neighbours continue, table surroundings. Viterbi over all non-blank lines of the page
finds the best labelling: a line that has no feature of a head or foot has no potential for it, wherever it stands, and one that
every page repeats has, wherever it stands. The labels give the dropped lines and the lines to be joined; paragraphs are
put together from what is kept.

Which words headers begin and end with is learned from the collection itself: lines that several pages of a document repeat
at their edges against lines of the same shape inside pages (``header_words``). No list of words is given.

Whether a hyphen belongs to its word and whether a word is misread is decided against the words of the whole
collection: a first pass counts all words (counts per partition before the shuffle), variants of frequent words under
the confusions of recognition are matched with rare words, and the second pass looks them up. What is broadcast for that
are a bitmap, sized by the count of words it holds up to 16 MB, that only says which words may be misread (a join decides), and
the words of headers, at most 10,000.

Defined results: null and blank texts have no findings; texts are read whole; repeated rows give one finding; empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut

# What recognition takes for what, in the scripts at hand (right -> misread).
CONFUSIONS = [
    ("о", "0"), ("и", "н"), ("н", "и"), ("т", "г"), ("г", "т"), ("л", "1"), ("п", "л"), ("ч", "4"), ("б", "6"), ("з", "3"), ("ы", "ь1"), ("ц", "и,"), ("ш", "щ"), ("й", "и"),
    ("e", "c"), ("o", "0"), ("l", "1"), ("s", "5"), ("i", "!"), ("g", "9"), ("m", "rn"), ("h", "li"), ("rn", "m"), ("w", "vv"), ("t", "f"), ("d", "cl"), ("n", "ri"), ("i", "1"), ("u", "ii"), ("b", "6"),
]
BREAKS = "-¬\xad‐"
_LINE = re.compile("[\n\f]")
_NUM = r"[0-9lOI]{1,5}"
_ROMAN = r"[ivxlc]{1,7}"
_DECORATED = re.compile(rf"\s*(?:[—–-] ?({_NUM}) ?[—–-]|\[({_NUM})\]|({_NUM}) \||\| ({_NUM})|(?:[Cc]тр|[Сс]тр|[Сс]|[Pp]|[Pp]age|[Ss]eite|[Pp]ág|S)[.,:]? ({_NUM})(?: (?:из|of|von|de|sur|/) {_NUM})?)\s*")
_PLAIN = re.compile(rf"\s*({_NUM})\s*")
_ROMAN_LINE = re.compile(rf"\s*({_ROMAN})\s*")
_LEAD, _TRAIL = re.compile(rf"\s*({_NUM})\s{{2,}}(\S.*?)\s*$"), re.compile(rf"\s*(\S.*?)\s{{2,}}({_NUM})\s*$")
_END = re.compile(r"[.!?…:;,)”»\"]\s*$")
_TABLE = re.compile(r"\s*[\d\s.,%]+\s*")
#: What recognition leaves of a character it did not make out, in headers.
_NOISE = "'|:.1"
_NOISY = re.compile("['|:.]")
_BROKEN = re.compile(rf"([^\W\d_][^\W_]*(?:['’][^\W_]+)?(?:-[^\W_]+)*)([{BREAKS}])[ \t]*$")
_FIRST = re.compile(r"[ \t]*([^\W_]+)")
_WORD = re.compile(r"[^\W\d_]+")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
#: Characters that recognition puts into words: figures and signs behind, between and before letters. One class of characters comes
#: first, so that the search passes over the rest.
_TRIGGER = re.compile(r"[01345689!иь](?:(?<=[^\W\d_][01345689!])(?=[^\W\d_])|(?<=[^\W\d_]{3}[01345689])(?![\w!])|(?<=1)(?<![\w.]1)(?=[^\W\d_]{3})|(?<=[^\W\d_]и),(?=[^\W\d_])|(?<=ь)1)")
_REPAIR = {"ru": str.maketrans("013464", "олзчбч"), "en": str.maketrans("01!5936", "oliseeb")}
#: Bits of the bitmap of words that may be misread: sixteen a word, a power of two, within these bounds.
_LEAST_BITS, _MOST_BITS = 1 << 20, 1 << 27


def number(s: str) -> int | None:
    t = s.translate(str.maketrans("lIO", "110"))
    return int(t) if t.isdigit() else None


def _roman(s: str) -> int | None:
    v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in s]
    n = sum(-a if b > a else a for a, b in zip(v, [*v[1:], 0]))
    return n if 0 < n < 200 else None


def _like(a: str, b: str) -> bool:
    """Whether b is a with at most a quarter of its characters misread; recognition replaces one by one."""
    return len(a) == len(b) and sum(map(ne, a, b)) * 4 <= len(a)


def _core(s: str) -> str:
    return "".join(s.split()).casefold()


# States, and what it costs to go from one to the next; what is not named cannot be. A page may begin in head or body and end
# in any state.
HEAD, BODY, BREAK, FOOT = "head", "body", "break", "foot"
TRANSITIONS = {
    (HEAD, HEAD): -0.1, (HEAD, BODY): 0.0, (HEAD, BREAK): 0.0, (HEAD, FOOT): 0.0, (BODY, BODY): 0.0, (BODY, BREAK): 0.0, (BREAK, BODY): 0.0, (BREAK, BREAK): 0.0,
    (BODY, FOOT): 0.0, (BREAK, FOOT): 0.0, (FOOT, FOOT): -0.1,
}
#: The weights of the features of a head or foot.
WEIGHTS = {
    "bias": -2.5, "decorated": 5.0, "plain": 1.0, "roman": 2.0, "both": 2.0, "counts_up": 2.5, "indented": 1.6, "in_table": -4.0,
    "long": -4.0, "sentence": -5.0, "no_letters": -2.0, "title": 1.5, "no_title": -3.0, "word": 2.0, "likely_word": 1.0,
    "repeated": 3.0, "repeated_no_title": 1.0, "every_page": 8.0, "text_goes_on": 0.9,
}
#: Lines without a feature of a head or foot cannot be one.
NEVER = -1e9
#: A header's length at most, in characters and words.
WIDEST, MOST_WORDS = 60, 7

Words = dict[str, float]


def _edge_words(s: str) -> tuple[str, str]:
    """What a line begins and ends with, as header words are counted."""
    t = s.split()
    return ("^" + t[0].strip("«»\"',;").casefold(), "$" + t[-1].strip("«»\"',;").casefold()) if t else ("", "")


def _worded(s: str, words: Words) -> float:
    """The weight of the header word a line begins or ends with; a character may be misread, also one that stands for a space."""
    first, last = _edge_words(s)
    forms = [first, last]
    if parts := [x for x in _NOISY.split(first[1:]) if x]:
        forms.append("^" + parts[0])
    if parts := [x for x in _NOISY.split(last[1:-1]) if x]:
        forms.append("$" + parts[-1] + last[-1:])
    for w in forms:
        v = words.get(w)
        if v is None and len(w) > 3:
            v = next((words[x] for x in _blurred(w) if x in words), None)
        if v:
            return v
    return 0.0


def _blurred(w: str) -> list[str]:
    """w with each character in turn unknown."""
    return [w[:i] + "\0" + w[i + 1 :] for i in range(1, len(w))]


def known_words(weights: Words) -> Words:
    """The words of headers, also under one unknown character."""
    return {**{x: v for w, v in weights.items() if len(w) > 3 for x in _blurred(w)}, **weights}


def _header(s: str, words: Words) -> float:
    """How much a text by itself looks like a running header: short, no sentence, capitals at the beginning of its words."""
    tokens = s.split()
    if not 1 <= len(tokens) <= MOST_WORDS or len(s.strip()) > WIDEST:
        return WEIGHTS["long"]
    word = _worded(s, words)
    if _END.search(s) and not (word and tokens[-1][-1] in ".»"):
        return WEIGHTS["sentence"]
    if not any(c.isalpha() for c in s):
        return WEIGHTS["no_letters"]
    named = [t for t in tokens[1:] if any(c.isalpha() for c in t)]
    raised = sum(t[0] in _NOISE or next((c for c in t if c.isalpha()), "A").isupper() for t in [tokens[0], *named])
    title = raised >= (0.75 if word else 0.8) * (len(named) + 1) and (named or word)
    score = WEIGHTS["title"] if title else WEIGHTS["no_title"]
    if word and named and not re.search(r"\d{3,}|№", s):
        score += word
    return score


def _number_of(line: str, words: Words) -> tuple[str, int, str] | None:
    """(kind, number, rest of the line) of a line that is or holds a page number."""
    if m := _DECORATED.fullmatch(line):
        n = number(next(g for g in m.groups() if g))
        return "decorated", -1 if n is None else n, ""
    if (m := _PLAIN.fullmatch(line)) and any(c.isdigit() or c == "l" for c in m[1]) and (n := number(m[1])) is not None:
        return "plain", n, ""
    if (m := _ROMAN_LINE.fullmatch(line)) and (n := _roman(m[1])):
        return "roman", n, ""
    for pattern, at, rest in ((_LEAD, 1, 2), (_TRAIL, 2, 1)):
        if (m := pattern.match(line)) and _header(m[rest], words) > -2 and (n := number(m[at])) is not None:
            return "both", n, m[rest]
    return None


class _Document:
    """The features of the lines of a document that more than one line has a part in."""

    def __init__(self, pages: list[list[str]], words: Words) -> None:
        self.pages, self.words = pages, words
        self.real = [[i for i, line in enumerate(lines) if line and not line.isspace()] for lines in pages]
        self.many = sum(bool(ids) for ids in self.real)
        self.numbers: dict[tuple[int, int], tuple[str, int]] = {}
        self.heads: dict[tuple[int, int], str] = {}
        self.core: dict[tuple[int, int], str] = {}
        on: Counter[str] = Counter()
        #: On how many pages a line stands, wherever and letter by letter.
        self.lines: Counter[str] = Counter()
        for p, ids in enumerate(self.real):
            lines = pages[p]
            if self.many > 2:
                self.lines.update(set(map(str.strip, lines)))
            here = set()
            for i in {*ids[:2], *ids[-2:]}:
                found = _number_of(lines[i], words)
                if found:
                    self.numbers[p, i] = found[:2]
                text = found[2] if found else lines[i]
                if text and (core := _core(text)):
                    self.core[p, i] = core
                    here.add(core)
                    self.heads[p, i] = text
            on.update(here)
        # Recognition misreads a character here and there: what is alike at the edges counts for one another.
        self.on = on
        edges: dict[int, set[str]] = {}
        for at in self.heads:
            if len(self.core[at]) >= 5:
                edges.setdefault(len(self.core[at]), set()).add(self.core[at])
        self.alike: dict[str, int] = {}
        self.nearly: dict[str, int] = {}
        pages_of: dict[str, set[int]] = {}
        for (p, i), c in self.core.items():
            if (p, i) in self.heads:
                pages_of.setdefault(c, set()).add(p)
        for same in edges.values():
            for c in same:
                like = [d for d in same if d == c or _like(c, d)]
                self.alike[c] = len(set().union(*(pages_of[d] for d in like)))
                self.nearly[c] = len(set().union(*(pages_of[d] for d in like if sum(map(ne, c, d)) <= 1 + len(c) // 16)))
        # Pages that repeat nearly all they hold are copies; that tells nothing of single lines.
        self.copies = {p for p, ids in enumerate(self.real) if self.many > 2 and 3 * sum(self.everywhere(p, i) for i in ids) > 2 * len(ids)}
        self.bases = Counter((kind == "roman", n - p) for (p, _), (kind, n) in self.numbers.items())

    def everywhere(self, p: int, i: int) -> bool:
        """Whether at least three pages, and three fifths of all, hold the line."""
        line = self.pages[p][i].strip()
        core = self.core.get((p, i), "")
        sure = max(self.lines[line] if len(line) >= 5 else 0, self.on[core] if len(core) >= 5 else 0, self.nearly.get(core, 0))
        return sure >= 3 and 5 * sure >= 3 * self.many

    def potential(self, p: int, k: int) -> float:
        """The potential of line k of page p for head and foot."""
        ids, lines = self.real[p], self.pages[p]
        i = ids[k]
        at, line = (p, i), lines[i]
        core = self.core.get(at, "")
        pages = max(self.on[core], self.alike.get(core, 0)) if len(core) >= 5 else 0
        edge = k < 2 or k >= len(ids) - 2
        every = self.many > 2 and p not in self.copies and self.everywhere(p, i)
        if not edge and len(line) <= 40 and (found := _number_of(line, self.words)) and found[0] == "decorated":
            self.numbers[at] = found[:2]  # a number further in, which must count up
            if self.bases[False, found[1] - p] < 2:
                self.numbers.pop(at)
        if at not in self.numbers and not every and (not edge or at not in self.heads or len(line.strip()) > WIDEST):
            return NEVER
        s = WEIGHTS["bias"]
        if at in self.numbers:
            kind, n = self.numbers[at]
            base = self.bases[kind == "roman", n - p]
            s += WEIGHTS[kind] + (WEIGHTS["counts_up"] if base > 1 else 0.0)
            if kind == "plain":
                near = [lines[j] for j in (ids[k - 1 : k] if k else []) + ids[k + 1 : k + 2] if not _DECORATED.fullmatch(lines[j])]
                s += WEIGHTS["indented"] if line.startswith("   ") else 0.0
                s += WEIGHTS["in_table"] if n > 2000 or any(_TABLE.fullmatch(x) for x in near) and not line.startswith("   ") and base < 3 else 0.0
        text = self.heads.get(at) or (line if every and at not in self.numbers else "")
        if text:
            own = _header(text, self.words)
            s += own
            if pages > 1:
                s += WEIGHTS["repeated"] if own > -2 else WEIGHTS["repeated_no_title"]
            if every:
                s += WEIGHTS["every_page"]
            nxt = ids[k + 1 : k + 2]
            if nxt and self.many > 1 and p and lines[nxt[0]].lstrip()[:1].islower():
                s += WEIGHTS["text_goes_on"]
        return s


def labels(pages: list[list[str]], words: Words, breaks: set[tuple[int, int]] = frozenset()) -> dict[tuple[int, int], str]:
    """(page, line) -> state of every non-blank line; ``breaks`` are the lines with the feature of a broken word."""
    doc = _Document(pages, words)
    out: dict[tuple[int, int], str] = {}
    for p, ids in enumerate(doc.real):
        if not ids:
            continue
        n = len(ids)
        kept = [BREAK if (p, i) in breaks else BODY for i in ids] if breaks else [BODY] * n  # the feature decides between the two
        # Up to the first line that cannot be a head, and from the last that cannot be a foot; what lies between can only be body.
        top: list[float] = []
        while len(top) < n and (not top or top[-1] > NEVER):
            top.append(doc.potential(p, len(top)))
        if top[-1] > NEVER:
            states = _viterbi(top, kept, True)
        else:
            foot: list[float] = []
            while not foot or foot[-1] > NEVER:
                foot.append(doc.potential(p, n - 1 - len(foot)))
            a, b = len(top), len(foot)
            states = kept[:]
            states[:a] = _viterbi(top, kept[:a], True)
            states[n - b :] = _viterbi(foot[::-1], kept[n - b :], False)
        for i, state in zip(ids, states):
            out[p, i] = state
    return out


def _viterbi(potentials: list[float], kept: list[str], first: bool) -> list[str]:
    """The best states of lines in a row, the first of which begins a page or follows body."""
    best = {HEAD: 0.0, BODY: 0.0} if first else {BODY: 0.0}
    back = []
    for k, (w, own) in enumerate(zip(potentials, kept)):
        now: dict[str, float] = {}
        came_from: dict[str, str | None] = {}
        for s, g in ((own, 0.0), (HEAD, w), (FOOT, w)):
            if g <= NEVER:
                continue
            if k == 0 and first:
                now[s], came_from[s] = g, None
                continue
            v, t = max(((v + TRANSITIONS[t, s], t) for t, v in best.items() if (t, s) in TRANSITIONS), default=(None, None))
            if t is not None:
                now[s], came_from[s] = v + g, t
        back.append(came_from)
        best = now
    state = max(best, key=lambda s: best[s])
    out = []
    for came_from in reversed(back):
        out.append(state)
        state = came_from[state]
    return out[::-1]


def drops(pages: list[list[str]], words: Words | None = None) -> set[tuple[int, int]]:
    """(page, line) of running headers, footers and page numbers."""
    return {at for at, state in labels(pages, words or {}).items() if state in (HEAD, FOOT)}


_TITLE = re.compile(r"(?m)^[ \t]*([«\"(]?[^\W\d_a-zа-яё]\S*(?:[ \t]+[«\"(]?[^\W\d_a-zа-яё]\S*){1,6})[ \t]*$")


def _raised(line: str) -> float:
    """The share of a line's words that begin with a capital; 0 for less than two words."""
    first = [next((c for c in t if c.isalpha()), "") for t in line.split()]
    first = [c for c in first if c]
    return sum(c.isupper() for c in first) / len(first) if len(first) > 1 else 0.0


def header_lines(text: str) -> tuple[list[str], list[str]]:
    """(lines that several pages repeat at their edges, lines of a header's shape inside pages) of a document of three pages or more."""
    pages = [[line for line in page.split("\n") if line.strip()] for page in text.split("\f")]
    pages = [page for page in pages if page]
    if len(pages) < 3:
        return [], [m[1].strip() for page in pages for m in _TITLE.finditer("\n".join(page[2:-2])) if len(m[1]) <= WIDEST]
    edge = [{_core(line): line for line in (*page[:2], *page[-2:]) if len(line.strip()) <= WIDEST} for page in pages]
    on = Counter(c for e in edge for c in e)
    repeated = [line for e in edge for c, line in e.items() if on[c] > 1 and len(c) >= 5 and _raised(line) >= 0.75]
    return repeated, [m[1].strip() for page in pages for m in _TITLE.finditer("\n".join(page[2:-2])) if len(m[1]) <= WIDEST]


def _lower_start(a: str, b: str) -> bool:
    return b[:1].islower() or a.isupper() and len(a) > 1 and b.isupper()


def _repaired(word: str) -> list[str]:
    """What a word with misread characters may have been."""
    w = word.lower()
    if any("а" <= c <= "я" or c == "ё" for c in w):
        return [w.replace("ь1", "ы").replace("и,", "ц").translate(_REPAIR["ru"])]
    w = w.replace("9", "g")
    return list(dict.fromkeys([w.translate(_REPAIR["en"]), w.replace("1", "i").translate(_REPAIR["en"])]))


def _around(low: str, at: int, end: int) -> str | None:
    """The word around a misread character, or None if it is part of a code, a version or a file name."""
    a, b = at, end
    while a and (low[a - 1].isalnum() or low[a - 1] == "!" and a > 1 and low[a - 2].isalpha()):
        a -= 1
    while b < len(low) and (low[b].isalnum() or low[b] == "!" and low[b + 1 : b + 2].isalpha()):
        b += 1
    if a and low[a - 1] in "._@/\\" or b < len(low) and (low[b] in "_@" or low[b] == "." and low[b + 1 : b + 2].isalnum()):
        return None
    return low[a:b] if _misread_shape(low[a:b]) else None


def _misread_shape(word: str) -> bool:
    """A word with a figure or sign among its letters, as recognition leaves it; codes, versions and 3D are none."""
    letters = sum(c.isalpha() for c in word)
    odd = len(word) - letters
    if letters < 3 or odd > 2 or odd == 0:
        return False
    return not re.search(r"\d{2}", word)


def analyse(text: str | None, words: Words | None = None) -> tuple[list[str], set[int], dict[int, tuple[str, str, str, int]]]:
    """(lines, numbers of dropped lines, for each kept line with a break its first half, second half, mark and the line of the second half)."""
    if not text or not text.strip():
        return [], set(), {}
    lines = _LINE.split(text)
    pages: list[list[str]] = []
    starts: list[int] = []
    at = 0
    for page in text.split("\f"):
        n = page.count("\n") + 1
        pages.append(lines[at : at + n])
        starts.append(at)
        at += n
    state = labels(pages, words or {})
    gone = {starts[p] + i for (p, i), s in state.items() if s in (HEAD, FOOT)}
    kept = [i for i, line in enumerate(lines) if i not in gone and line.strip()]
    broken = {}
    for i, j in zip(kept, kept[1:]):
        line = lines[i].rstrip()
        if line[-1] in BREAKS and (m := _BROKEN.search(line)) and (f := _FIRST.match(lines[j])) and _lower_start(m[1].rpartition("-")[2], f[1]):
            broken[i] = (m[1], f[1], m[2], j)
    return lines, gone, broken


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        rb = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return rb

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            words = _COMPOUND.findall(text.lower())
            counts.update(words)
            if "\n" in text:
                heads, inner = header_lines(text)
                for mark, found in ((_OF_HEADS, heads), (_INSIDE, inner)):
                    counts.update(mark + w for line in found for w in _edge_words(line) if w[1:])
            for w in words:
                if "-" in w:
                    counts.update(w.split("-"))
        if len(counts) > 400_000:
            yield flush()
    if counts:
        yield flush()


#: Marks of the counts of edge words, in repeated lines and in lines inside pages.
_OF_HEADS, _INSIDE = "\1", "\2"


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n) over all texts: runs of letters and hyphenated compounds, lower-cased. Halves of broken words are
    counted as they stand. The counts of edge words, under their marks, come with them."""
    rows = texts.select(column).mapInArrow(_count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def header_words(counts: DataFrame, share: float = 1e-4, least: int = 3) -> Words:
    """The weights of words that headers begin and end with: those that make up at least ``share`` of all headers' edge words, of which
    there can be no more than 1 / share, and are found in headers oftener than in other lines of that shape."""
    marked = counts.where(F.col("word").startswith(_OF_HEADS) | F.col("word").startswith(_INSIDE))
    kind, word = F.substring("word", 1, 1), F.expr("substring(word, 2)")
    both = marked.groupBy(word.alias("w")).agg(F.sum(F.when(kind == _OF_HEADS, F.col("n")).otherwise(0)).alias("h"), F.sum(F.when(kind == _INSIDE, F.col("n")).otherwise(0)).alias("b"))
    every = both.agg(F.sum("h"), F.sum("b")).first()
    h_all, b_all = every[0] or 0, every[1] or 0
    rows = both.where((F.col("h") >= max(least, share * h_all)) & (F.col("h") > F.col("b"))).collect()
    return {r["w"]: WEIGHTS["word"] if (r["h"] + 1) * (b_all + 2) > 8 * (r["b"] + 1) * (h_all + 2) or r["b"] == 0 else WEIGHTS["likely_word"] for r in rows}


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen = {word}
            for a, b in CONFUSIONS:
                if b.isalpha():
                    i = word.find(a)
                    while i >= 0:
                        v = word[:i] + b + word[i + len(a) :]
                        if v not in seen:
                            seen.add(v)
                            out.append((v, word, n))
                        i = word.find(a, i + 1)
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())], names=["word", "right", "m"])


def misread_words(counts: DataFrame, least: int = 10, ratio: int = 20) -> DataFrame:
    """(word, right): rare words that one confusion makes of a word at least ``ratio`` times as frequent."""
    frequent = counts.where((F.col("n") >= least) & (F.length("word") >= 4) & ~F.col("word").contains("-"))
    made = frequent.select("word", "n").mapInArrow(_variants, "word string, right string, m long")
    hit = made.join(counts.select("word", "n"), "word").where(F.col("m") >= ratio * F.col("n"))
    return hit.groupBy("word").agg(F.max_by("right", "m").alias("right"))


def bitmap(words: DataFrame) -> bytes:
    """A bitmap over the words: which may be among them. Its size follows their number up to 16 MB, beyond which more words are
    asked about than need be. Built in pages on the cluster."""
    bits = _LEAST_BITS
    n = words.count()
    while bits < min(_MOST_BITS, 16 * n):
        bits *= 2

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for w in b.column(0).to_pylist():
                s = xxhash.xxh32_intdigest(w) % bits
                mine[s >> 3] |= 1 << (s & 7)
        used = [p for p in range(bits // 32768) if mine[p * 4096 : (p + 1) * 4096].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([mine[p * 4096 : (p + 1) * 4096].tobytes() for p in used], pa.binary())], names=["page", "bits"])

    rows = words.select("word").mapInArrow(pages, "page int, bits binary").groupBy("page").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    whole = bytearray(bits // 8)
    for page, part in rows.collect():
        whole[page * 4096 : (page + 1) * 4096] = part
    return bytes(whole)


_FOUND = "place string, key string, line_no long, kind string, word string, other string"
_FOUND_PA = pa.schema([("place", pa.string()), ("key", pa.string()), ("line_no", pa.int64()), ("kind", pa.string()), ("word", pa.string()), ("other", pa.string())])


def _scan(may: bytes, header: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bool] = {}

        def maybe(w: str) -> bool:
            v = memo.get(w)
            if v is None:
                if len(memo) > 300_000:
                    memo.clear()
                s = xxhash.xxh32_intdigest(w) % (8 * len(may))
                v = memo[w] = bool(may[s >> 3] >> (s & 7) & 1)
            return v

        for batch in batches:
            out = []
            for place, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines, gone, broken = analyse(text, header)
                out += [(place, key, i, "drop", None, None) for i in gone]
                if not lines:
                    continue
                ends = {}
                for i, (a, b, mark, j) in broken.items():
                    joined = (a + b).lower()
                    out.append((place, key, i, "join", joined, None) if mark != "-" else (place, key, i, "join?", joined, f"{a}-{b}".lower()))
                    a = a.rpartition("-")[2].lower()
                    ends[i], ends[~j] = a, b.lower()
                    if maybe(a + b.lower()):
                        out.append((place, key, i, "misread?", a + b.lower(), f"{len(a)}:{j}"))
                low = text.lower()
                hits = [w for w in set(_WORD.findall(low)) if len(w) >= 4 and maybe(w)]
                odd = list(_TRIGGER.finditer(low))
                if not hits and not odd:
                    continue
                starts = [0, *(m.end() for m in _LINE.finditer(low))]
                if hits:
                    for m in re.finditer(r"(?<![^\W\d_])(?:" + "|".join(hits) + r")(?![^\W\d_])", low, re.I):
                        i, w = bisect_right(starts, m.start()) - 1, m[0].lower()
                        if i not in gone and w not in (ends.get(i), ends.get(~i)):
                            out.append((place, key, i, "misread?", w, None))
                for m in odd:
                    w = _around(low, m.start(), m.end())
                    if w:
                        i = bisect_right(starts, m.start()) - 1
                        if i not in gone:
                            out += [(place, key, i, "odd?", v, w) for v in _repaired(w)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(_FOUND_PA)], schema=_FOUND_PA)

    return run


def findings(texts: DataFrame, counts: DataFrame, misread: DataFrame) -> DataFrame:
    """(place, key, line_no, kind, word, right) of texts(place, key, text): drop, join and misread lines, with the word
    concerned and what it should be."""
    header = known_words(header_words(counts))
    raw = cut(texts.select("place", "key", "text").mapInArrow(_scan(bitmap(misread), header), _FOUND), "lines")
    sure = raw.where("kind in ('drop', 'join')").select("place", "key", "line_no", "kind", F.col("word"), F.lit(None).cast("string").alias("right"))
    known = counts.where("n >= 2")
    asked = raw.where("kind = 'join?'")
    whole = known.select(F.col("word"), F.col("n").alias("n_whole"))
    split = known.where(F.col("word").contains("-")).select(F.col("word").alias("other"), F.col("n").alias("n_split"))
    joins = (
        asked.join(whole, "word", "left").join(split, "other", "left")
        .where(F.coalesce("n_whole", F.lit(0)) >= F.coalesce("n_split", F.lit(0)))
        .select("place", "key", "line_no", F.lit("join").alias("kind"), "word", F.lit(None).cast("string").alias("right"))
    )
    rare = raw.where("kind = 'misread?'").join(misread, "word")
    # In a word broken over two lines the misread character is on the line it stands on.
    at = F.expr("aggregate(sequence(1, greatest(length(word), 1)), 0, (x, i) -> case when x = 0 and substring(word, i, 1) <> substring(right, i, 1) then i else x end)")
    rare = rare.withColumn("at", at).where(F.col("other").isNull() | (F.col("at") > 0))
    half, second = F.split("other", ":")[0].cast("int"), F.split("other", ":")[1].cast("long")
    misreads = rare.select("place", "key", F.when(F.col("at") > half, second).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("kind"), "word", "right")
    odd = raw.where("kind = 'odd?'").join(known.select("word", "n"), "word", "left").where(F.col("n").isNotNull() | F.col("other").rlike(r"^\p{L}+[0-9!]\p{L}+$"))
    odds = odd.select("place", "key", "line_no", F.lit("misread").alias("kind"), F.col("other").alias("word"), F.when(F.col("n").isNotNull(), F.col("word")).alias("right"))
    return sure.unionByName(joins).unionByName(misreads).unionByName(odds)


def paragraphs(text: str, drop: set[int], join: set[int], fix: dict[int, list[tuple[str, str]]]) -> str:
    """The text of the kept lines as paragraphs, one per line: broken words put back, misread words replaced."""
    out: list[str] = []
    glue = fresh = False
    for i, line in enumerate(_LINE.split(text)):
        if i in drop:
            continue
        if not line.strip():
            fresh = fresh or not glue
            continue
        t = line.strip()
        for wrong, right in fix.get(i, ()):
            t = re.sub(rf"(?<![^\W_]){re.escape(wrong)}(?![^\W_])", lambda m, r=right: r.upper() if m[0].isupper() else r.capitalize() if m[0][:1].isupper() else r, t, flags=re.I)
        if i in join:
            t = t.rstrip(BREAKS + " ")
        indent = line.startswith("   ") and t[:1].isupper()
        if out and glue:
            out[-1] += t
        elif out and not indent and not (fresh and (t[:1].isupper() or not t[:1].isalpha()) and out[-1][-1:] in ".!?…:;»”\")'’0123456789" or fresh and t[:1].isupper() and len(out[-1]) < 60):
            out[-1] += " " + t
        else:
            out.append(t)
        glue, fresh = i in join, False
    return "\n".join(out)
