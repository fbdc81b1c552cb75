"""Sentence units across languages and scripts.

Method. Boundary rules are compiled into one finite transducer over symbol classes (letter with case, caseless letter,
Thai letter, figure, space, hard break, terminators, quotes, brackets, other signs). Its states remember what a boundary
depends on: a terminator just seen, an open quotation and whether it opened the sentence, an open bracket. A lexical
pass first gives every code point its class and takes the stops of abbreviations, initials, numbers, ordinals and list
markers out of the terminators. Runs of one class act like one symbol, so they are compressed. Documents are lanes of a
vectorised run; a document longer than a chunk is cut, each further chunk becomes a function from state to state
(run from all states at once), the functions are composed by a parallel prefix scan, and with the entry states known
every chunk emits its boundaries.

A blank line or page break takes every state back to the start, so the function of what stands before it is constant: a document
of more than ``LONG`` bytes is cut there into pieces that are spread over the cluster, each with the line width its whole document
shows (measured per piece and combined). Which quotation mark opens and which closes is told by what stands beside it; whether a
quotation is open is a state and ends with its paragraph.

Defined results: null, empty and blank texts have no units; texts of any length are read whole; repeated rows repeat
their units; unknown or wrong language tags do not matter, since the script decides; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut

S, N, U, L, C, D, T, W, O, Q, P, OB, QB, H, K, OQ = range(16)
CLASSES = 16
CHUNK = 512

# Abbreviations whose stop never ends a sentence before a capital, by language.
_NEVER = frozenset(
    " ".join(
        (
            "Dept Dr Mr Mrs Ms Prof St e.g i.e vs cf approx resp Art art Fig fig Capt Sgt Gen Lt Col Maj Cpl Adm Cmdr Rev Hon Gov Sen Pres Supt Messrs",  # English
            "Abt Hr Fr Hn bzw ca Abb Kap Bd Hrsg vgl Vgl sog evtl ggf inkl zzgl Dipl Ing Std Mio Mrd Str",  # German
            "Mme Mlle MM Mgr Ste av avda Réf réf env",  # French
            "Dpto Sr Sra Dra Srta Ud Uds aprox Lic Arq Gral",  # Spanish
            "ул просп пер наб им гр тов напр акад проф доц инж",  # Russian
            "κ κα Δρ κος αριθ",  # Greek
            "डॉ श्री सं रु رقم د أ م كغ كجم",  # Hindi, Arabic
        )
    ).split()
)
# Abbreviations whose stop does not end a sentence before a figure, by language.
BEFORE_FIGURE = " ".join(
    (
        "No Fig fig p pp fol sec para art Art apt approx cf Tel tel vol ch n ext no vs Ref ref pt v",
        "Nr S Z Kap Abb bzw ca Bd Ziff Rn",
        "pág págs bât réf Réf éd",
        "П пп п д стр Стр с пом доб тел см См рис Рис разд гл ч кв корп каб прил ном № т вып",
        "δηλ αρ σελ рег",
        "aprox núm Núm",
        "सं रु",
        "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec янв февр апр авг сент окт нояб дек janv févr avr juil déc ene abr ago dic",
    )
).split()
# Names of months that begin with a capital, which an ordinal with a stop may stand before.
MONTHS = "Januar Jänner Februar Feber März April Mai Juni Juli August September Oktober November Dezember January February March May June July October December".split()
#: Words after which a single capital is no initial.
LETTERED = "plan Plan план План планом плану плана Variante variant вариант option opción option Punkt".split()

_FIGURE = frozenset(BEFORE_FIGURE)
_MONTH = re.compile("|".join(MONTHS))

_TERMINATORS = ".!?…‼⁇⁈⁉؟;"
_WIDE = "。！？｡।॥።፧"
_OPEN, _CLOSE = "«“„‚「『《〈‹", "»”」』》〉›"
_PAIR = re.compile(r"(?<![^\W\d_])(?:d\. ?\n?h|z\. ?\n?B|u\. ?\n?a|т\.\s?к|т\.\s?е|т\.\s?н|и\.\s?о)\.")
_CANDIDATE = re.compile(r"\.(?=([^\W_])|\s+([^\W_«“„(])|)")
#: Vowel signs of the scripts that write vowels as marks; they belong to the word before a stop.
_SIGNS = frozenset(map(chr, [*range(0x900, 0x904), *range(0x93A, 0x950), 0x962, 0x963]))
_MARKER = re.compile(r"[ \t]*(?:\d{1,4}[.)]|[-•*–—·‣◦▪]|\(?[a-zа-яα-ω\d]{1,2}\))[ \t]+(?=\S)")
#: A mark that opens or closes by its place: straight, or the German closing mark that opens in English. It closes behind a word or
#: sign and before white space, a sign or the end; behind a figure a straight mark is closing too, which does nothing where no quotation
#: is open (5" of pipe).
_CLOSING = re.compile(r"(?<=[^\s(\[{«„])[\"“](?=\s|[^\w\s]|$)")
#: Right behind a stop and before a word it closes a quotation that is open and else opens one: for the states to tell.
_EITHER = re.compile(r"(?<=[.!?…])[\"“](?=\w)")
_LINE_END = re.compile(r"[.!?…。！？।።؟:;»”」）)]\s*$")
_BRAND = re.compile(r"(?<![^\W_])[a-zа-я](?=[A-ZА-ЯЁ][a-zа-яё])")
_GREEK_Q = re.compile(r"(?<=[α-ωά-ώ])[;;](?=\s|$|[»)])")
#: A line below this many characters can be a heading; two thirds of the usual line. A line must have so many to tell that text was
#: wrapped at its width, since shorter ones stand in lists and addresses.
_HEADING, _WRAPPED = 80, 30
_HEADING_STOP = re.compile(r"(?<=\d)\.(?=\s)")
_KEEP = re.compile("[」』”](?:と|って|然后|，)")


@lru_cache(None)
def _table() -> np.ndarray:
    t = np.full(sys.maxunicode + 1, P, np.uint8)
    for n in range(0x30000):
        c = chr(n)
        k = unicodedata.category(c)
        if c in "\n\f\x0b\x1c\x1d\x1e\x85  " or c.isspace():
            t[n] = S
        elif 0xE01 <= n <= 0xE5B and k[0] in "LM":
            t[n] = H
        elif k in ("Lu", "Lt"):
            t[n] = U
        elif k == "Ll":
            t[n] = L
        elif k[0] in "LM":
            t[n] = C
        elif k[0] == "N":
            t[n] = D
        elif c in _TERMINATORS and c != ";":
            t[n] = T
        elif c in _WIDE:
            t[n] = W
        elif c in _OPEN:
            t[n] = O
        elif c in _CLOSE:
            t[n] = Q
        elif k == "Ps" and c not in _OPEN:
            t[n] = OB
        elif k == "Pe" and c not in _CLOSE:
            t[n] = QB
    for c in "¿¡":
        t[ord(c)] = U
    t[0x37E] = T
    return t


# States.
START, IN, TH, THS, T0, W0, T0S, QS, QM, QST, QMT, TQS, TQM, TQSS, TQMS, Q2S, Q2M, BS, BM, BST, BMT, TBM = range(22)
STATES = 22


@lru_cache(None)
def _rules() -> tuple[np.ndarray, np.ndarray]:
    """The transducer: next state and output (1: a unit begins here) for every class and state."""
    nxt = np.full((CLASSES, STATES), IN, np.uint8)
    out = np.zeros((CLASSES, STATES), np.uint8)

    def on(state: int, classes: tuple[int, ...] | int, to: int, emit: int = 0) -> None:
        for c in (classes,) if isinstance(classes, int) else classes:
            nxt[c, state], out[c, state] = to, emit

    every = tuple(range(CLASSES))
    letters = (U, L, C, D, H, K)
    for s in range(STATES):
        on(s, N, START)
    on(START, every, IN, 1)
    on(START, (S, N), START)
    on(START, H, TH, 1)
    on(START, O, QS, 1)
    on(START, OB, BS, 1)
    for s in (IN, TH, THS):
        on(s, (T,), T0)
        on(s, (W,), W0)
        on(s, O, QM)
        on(s, OB, BM)
        on(s, H, TH)
    on(TH, S, THS)
    on(THS, S, THS)
    on(THS, H, TH, 1)
    # After a terminator.
    on(T0, (T, Q, QB), T0)
    on(T0, W, W0)
    on(T0, S, T0S)
    on(T0, U, IN, 1)
    on(T0, O, QS, 1)
    on(T0, OB, BS, 1)
    on(T0, H, TH)
    on(W0, (T, W, Q, QB), W0)
    on(W0, S, T0S)
    on(W0, letters, IN, 1)
    on(W0, H, TH, 1)
    on(W0, O, QS, 1)
    on(W0, OB, BS, 1)
    on(T0S, (S, Q, QB), T0S)
    on(T0S, (U, D, C, K), IN, 1)
    on(T0S, H, TH, 1)
    on(T0S, O, QS, 1)
    on(T0S, OB, BS, 1)
    on(T0S, T, T0)
    on(T0S, W, W0)
    # Inside a quotation that opened the sentence (S) or stands within it (M).
    for q, qt, tq, q2 in ((QS, QST, TQS, Q2S), (QM, QMT, TQM, Q2M)):
        on(q, every, q)
        on(q, (T, W), qt)
        on(q, Q, IN)
        on(q, O, q2)
        on(qt, every, q)
        on(qt, (S, T, W), qt)
        on(qt, Q, tq)
        on(qt, O, q2)
        on(q2, every, q2)
        on(q2, Q, q)
        for s in (q, qt, q2):
            on(s, N, START)
    for s, t in ((TQS, TQSS), (TQM, TQMS)):
        on(s, S, t)
        on(s, Q, s)
        on(s, QB, s)
        on(s, T, T0)
        on(s, W, W0)
        on(s, U, IN, 1)
        on(s, O, QS, 1)
        on(s, OB, BS, 1)
        on(s, H, TH)
        on(t, (S, QB), t)
        on(t, Q, s)
        on(t, (U, D), IN, 1)
        on(t, O, QS, 1)
        on(t, OB, BS, 1)
        on(t, T, T0)
        on(t, W, W0)
        on(t, H, IN)
    on(TQM, (C, D), IN, 1)
    on(TQSS, C, IN, 1)
    # Brackets: one that is a sentence of its own ends it, one within a sentence does not.
    for b, bt in ((BS, BST), (BM, BMT)):
        on(b, every, b)
        on(b, (T, W), bt)
        on(b, QB, IN)
        on(bt, every, b)
        on(bt, (S, T, W, Q), bt)
        for s in (b, bt):
            on(s, N, START)
    on(BST, QB, W0)
    on(BMT, QB, TBM)
    on(TBM, S, TQMS)
    on(TBM, (T,), T0)
    on(TBM, W, W0)
    on(TBM, H, TH)
    for s in range(STATES):
        on(s, N, START)
    # A mark that may open or close does what the state asks for.
    quoted = np.isin(np.arange(STATES), (QS, QM, QST, QMT, Q2S, Q2M))
    for t in (nxt, out):
        t[OQ] = np.where(quoted, t[Q], t[O])
    return nxt, out


def _rows(text: str) -> tuple[list[int], list[int], list[str], list[str], list[bool], list]:
    """(starts, ends, lines, lines without white space at their ends, whether they end a sentence, list markers) of a text."""
    ends = [m.start() for m in re.finditer("[\n\f]", text)]
    starts = [0, *(e + 1 for e in ends)]
    ends.append(len(text))
    rows = [text[a:b] for a, b in zip(starts, ends)]
    bare = [r.strip() for r in rows]
    done = [bool(_LINE_END.search(b)) for b in bare]
    mark = [m if m and not (m[0].strip() in "-–—" and r[m.end() : m.end() + 1].islower()) else None for r in rows for m in [_MARKER.match(r)]]
    return starts, ends, rows, bare, done, mark


Widths = tuple[int, int, int]


def _widths(rows: list[str], bare: list[str], done: list[bool], mark: list) -> Widths:
    """(longest line that surely goes on in the next, how many lines of some length may go on, the longest of them)."""
    cased = [b[:1].isupper() or b[:1].islower() for b in bare]
    sure = [len(r.rstrip()) for r, b, b2, m2 in zip(rows, bare, bare[1:], mark[1:]) if b and b2 and b2[0].islower() and not m2]
    loose = [len(r.rstrip()) for r, b, d, b2, m2, m1, c in zip(rows, bare, done, bare[1:], mark[1:], mark, cased[1:]) if b and b2 and not d and not m2 and not m1 and not c]
    loose = [x for x in loose if x >= _WRAPPED]
    return max(sure, default=0), len(loose), max(loose, default=0)


def _width(sure: int, n: int, loose: int) -> int:
    """The width at which a document was wrapped, 0 if it was not."""
    return sure or (loose if n >= 2 else 0)


def widths_of(text: str) -> Widths:
    _, _, rows, bare, done, mark = _rows(text)
    return _widths(rows, bare, done, mark)


def _lines(text: str, k: np.ndarray, width: int | None = None) -> None:
    """Marks the line breaks that end a unit (class N), and takes the stops of list markers and headings out."""
    if "\n" not in text and "\f" not in text and "\r" not in text:
        m = _MARKER.match(text)
        if m:
            k[m.start() : m.end()][np.isin(k[m.start() : m.end()], (T, QB, OB))] = P
        return
    starts, ends, rows, bare, done, mark = _rows(text)
    if width is None:
        width = _width(*_widths(rows, bare, done, mark))
    # In wrapped text a figure with a stop may come to stand first in its line.
    for i in range(1, len(rows)):
        if mark[i] and mark[i][0].strip()[0].isdigit() and bare[i - 1] and not mark[i - 1] and text[starts[i] - 1] != "\f":
            last = re.search(r"([^\W\d_]+)\.$", bare[i - 1])
            full = width and len(rows[i - 1].rstrip()) + 1 + len(mark[i][0].strip()) > width
            if last and last[1] in _FIGURE and not re.search(r"т\.\s?[дп]\.$", bare[i - 1]) or full and not done[i - 1] or _MONTH.match(rows[i], mark[i].end()):
                mark[i] = None
    hard = []
    for i in range(len(rows) - 1):
        a, b = bare[i], bare[i + 1]
        if text[ends[i]] == "\f" or not a or not b:
            hard.append(not (text[ends[i]] != "\f" and not a and not any(bare[:i])))
        elif mark[i + 1]:
            hard.append(True)
        elif b[0].islower() or b[0] in "-–—" and b.lstrip("-–— ")[:1].islower():
            hard.append(False)
        else:
            word = b.split(None, 1)[0]
            hard.append(not width or len(rows[i].rstrip()) + 1 + len(word) <= width)
    for i, h in enumerate(hard):
        if h:
            k[ends[i]] = N
    for i, r in enumerate(rows):
        if mark[i] and (i == 0 or hard[i - 1]):
            part = k[starts[i] + mark[i].start() : starts[i] + mark[i].end()]
            part[np.isin(part, (T, QB, OB, H))] = P
        if bare[i] and not done[i] and len(bare[i]) <= _HEADING and (i == 0 or hard[i - 1]) and (i == len(rows) - 1 or hard[i]):
            for m in _HEADING_STOP.finditer(r):
                k[starts[i] + m.start()] = P


_PREVIOUS = re.compile(r"([^\W\d_]+)\s+$")


def classify(text: str, width: int | None = None) -> np.ndarray:
    """The symbol class of every code point; ``width`` is that of the whole document where the text is a piece of it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = _table()[codes]
    _lines(text, k, width)
    for m in _CANDIDATE.finditer(text):
        at = m.start()
        if k[at] != T:
            continue
        start = at
        while start and (text[start - 1].isalpha() or text[start - 1] in _SIGNS):
            start -= 1
        word, direct, after = text[start:at] or None, m[1], m[2]
        if word and word[-1] < "ɐ" and not word.isascii() and max(word) > "ɏ":
            # Latin letters right behind another script are a word of their own.
            start = at - len(re.search("[A-Za-zÀ-ɏ]+$", word)[0])
            word = text[start:at]
        if direct:
            if word is None:
                before = text[at - 1 : at]
                if before.isdigit() and direct.isdigit() or not direct.isupper() or before == ".":
                    if not (before in "»”)" or before == "." and direct.isupper()):
                        k[at] = P
            elif len(word) == 1 and word.isupper() and not _lettered(text, start):
                k[at] = P
            elif not direct.isupper():
                k[at] = P
            continue
        if word is None:
            if after and text[at - 1 : at].isdigit() and _MONTH.match(text, m.start(2)) and not text[max(0, at - 3) : at].strip()[:1] == ".":
                k[at] = P
            continue
        if after is None:
            continue
        if len(word) == 1:
            if word.isupper():
                if not _lettered(text, start):
                    k[at] = P
                continue
            if word == "г" and (after.isupper()) and not _figure_before(text, start):
                k[at] = P
                continue
        if word in _NEVER or after.isdigit() and word in _FIGURE and not (word in "дп" and _pair_before(text, start)):
            k[at] = P
    for m in _PAIR.finditer(text):
        k[m.end() - 1] = P
        k[m.start() + 1] = P
    if '"' in text or "“" in text:
        for i in [m.start() for m in re.finditer('"', text)]:
            k[i] = O
        for m in _CLOSING.finditer(text):
            k[m.start()] = Q
        for m in _EITHER.finditer(text):
            k[m.start()] = OQ
        for m in re.finditer(r'(?<=\w)"(?=\w)', text):
            k[m.start()] = P
    for m in _BRAND.finditer(text):
        k[m.start()] = U
    if ";" in text or ";" in text:
        for m in _GREEK_Q.finditer(text):
            if k[m.start()] == P:
                k[m.start()] = T
    if "」" in text or "』" in text or "”" in text:
        for m in _KEEP.finditer(text):
            if k[m.start() + 1] == C:
                k[m.start() + 1] = K
    return k


def _lettered(text: str, at: int) -> bool:
    m = _PREVIOUS.search(text, max(0, at - 16), at)
    return bool(m) and m[1] in LETTERED


def _figure_before(text: str, at: int) -> bool:
    return text[max(0, at - 3) : at].strip()[-1:].isdigit()


def _pair_before(text: str, at: int) -> bool:
    return text[max(0, at - 3) : at].strip()[-2:] == "т."


def _compress(k: np.ndarray) -> np.ndarray:
    """Positions at which the class changes; a run acts on the state like its first symbol. Terminators stay single."""
    return np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))


def _run(symbols: np.ndarray, entry: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs lanes (rows of symbols) from entry states; returns exit states and outputs. Lanes come longest first."""
    nxt, out = _rules()
    state = entry.copy()
    emit = np.zeros(symbols.shape, np.uint8)
    for t in range(symbols.shape[1]):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        if not n:
            break
        c = symbols[:n, t]
        s = state[:n]
        emit[:n, t] = out[c, s]
        state[:n] = nxt[c, s]
    return state, emit


def _functions(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The state-to-state function of every lane: all states at once."""
    nxt, _ = _rules()
    f = np.tile(np.arange(STATES, dtype=np.uint8), (len(symbols), 1))
    for t in range(symbols.shape[1]):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        if not n:
            break
        f[:n] = nxt[symbols[:n, t][:, None], f[:n]]
    return f


def _scan(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix composition of functions, restarted where first is set: log2(n) rounds."""
    f = f.copy()
    head = np.flatnonzero(first)
    start = head[np.searchsorted(head, np.arange(len(f)), side="right") - 1]
    d = 1
    while d < len(f):
        i = np.arange(d, len(f))
        i = i[i - d >= start[i]]
        if not len(i):
            break
        f[i] = np.take_along_axis(f[i], f[i - d], axis=1)  # first the earlier function, then the later
        d *= 2
    return f


def segment(texts: list[str | None], chunk: int = CHUNK, widths: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of the sentence units of every text, in code points."""
    pieces, owner, firsts, where = [], [], [], []
    kinds: list[np.ndarray | None] = []
    for d, text in enumerate(texts):
        if not text or not text.strip():
            kinds.append(None)
            continue
        k = classify(text, widths[d] if widths else None)
        kinds.append(k)
        at = _compress(k)
        for i in range(0, len(at), chunk):
            pieces.append(k[at[i : i + chunk]])
            where.append(at[i : i + chunk])
            owner.append(d)
            firsts.append(i == 0)
    if not pieces:
        return [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(texts)
    lengths = np.array([len(p) for p in pieces])
    order = np.argsort(-lengths, kind="stable")
    table = np.zeros((len(pieces), int(lengths.max())), np.uint8)
    for row, i in enumerate(order):
        table[row, : lengths[i]] = pieces[i]
    sorted_lengths = lengths[order]
    first = np.array(firsts)
    entry = np.zeros(len(pieces), np.uint8)
    if not first.all():
        # Only chunks that another follows need their function.
        last = np.append(first[1:], True)
        need = ~last[order]
        f = np.tile(np.arange(STATES, dtype=np.uint8), (len(pieces), 1))
        f[order[need]] = _functions(table[need], sorted_lengths[need])
        scanned = _scan(f, first)
        later = np.flatnonzero(~first)
        entry[later] = scanned[later - 1, START]
    _, emit = _run(table, entry[order], sorted_lengths)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    begins: list[list[np.ndarray]] = [[] for _ in texts]
    for i, d in enumerate(owner):
        begins[d].append(where[i][emit[back[i], : lengths[i]] == 1])
    out = []
    for d, text in enumerate(texts):
        k = kinds[d]
        if k is None or not begins[d]:
            out.append((np.empty(0, np.int64), np.empty(0, np.int64)))
            continue
        b = np.concatenate(begins[d])
        solid = np.where((k != S) & (k != N), np.arange(len(k)), -1)
        solid = np.maximum.accumulate(solid)
        e = solid[np.append(b[1:], len(k)) - 1] + 1
        out.append((b, e))
    return out


#: Bytes above which a document is cut into pieces for several tasks, and about how many characters a piece has.
LONG, PIECE = 4 << 20, 1 << 20
_BLANK = re.compile(r"\n[ \t]*\n|\f")


def pieces(text: str, size: int = PIECE) -> list[tuple[int, str]]:
    """(start, piece) of a text cut at blank lines or page breaks, each the first behind ``size`` characters."""
    out, at = [], 0
    while at < len(text):
        m = _BLANK.search(text, min(len(text), at + size))
        end = m.end() if m else len(text)
        out.append((at, text[at:end]))
        at = end
    return out


def units(documents: DataFrame, id_column: str = "doc_id", column: str = "text", long: int = LONG, piece: int = PIECE) -> DataFrame:
    """(id, sent_start, sent_end) of every sentence unit. Row-wise in Arrow batches and without a shuffle, but for documents of more
    than ``long`` bytes, whose pieces are shuffled once."""
    kind = documents.schema[id_column].dataType.simpleString()
    out = f"{id_column} {kind}, sent_start long, sent_end long"

    def emit(ids: pa.Array, texts: list[str | None], firsts: list[int], widths: list[int | None] | None) -> pa.RecordBatch:
        found = segment(texts, widths=widths)
        counts = np.array([len(b) for b, _ in found])
        begin = np.repeat(np.array(firsts, np.int64), counts)
        starts = np.concatenate([b for b, _ in found]) if len(found) else np.empty(0, np.int64)
        ends = np.concatenate([e for _, e in found]) if len(found) else np.empty(0, np.int64)
        own = ids.take(pa.array(np.repeat(np.arange(len(found)), counts)))
        return pa.RecordBatch.from_arrays([own, pa.array(starts.astype(np.int64) + begin), pa.array(ends.astype(np.int64) + begin)], names=[id_column, "sent_start", "sent_end"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield emit(part.column(0), part.column(1).to_pylist(), [0] * part.num_rows, None)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                for at, t in pieces(text, piece):
                    sure, n, loose = widths_of(t)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(2).slice(row, 1), *(pa.array([v], pa.int64()) for v in (at, sure, n, loose)), pa.array([t])], names=["id", "of", "at", "sure", "n", "loose", "piece"])

    def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure, n, loose = (batch.column(i).to_pylist() for i in (3, 4, 5))
            for row in range(batch.num_rows):
                yield emit(batch.column(0).slice(row, 1), [batch.column(2)[row].as_py()], [batch.column(1)[row].as_py()], [_width(sure[row], n[row], loose[row])])

    docs = documents.select(F.col(id_column), F.col(column))
    size = F.coalesce(F.octet_length(column), F.lit(0))
    short = docs.where(size <= long).mapInArrow(whole, out)
    cuts = docs.where(size > long).select(F.col(id_column).alias("id"), F.col(column), F.xxhash64(id_column, column).alias("of")).mapInArrow(cut_up, f"id {kind}, of long, at long, sure long, n long, loose long, piece string")
    if cuts.isEmpty():
        return short
    cuts = cut(cuts, "pieces")
    shape = cuts.groupBy("of").agg(F.max("sure").alias("sure"), F.sum("n").alias("n"), F.max("loose").alias("loose"))
    spread = cuts.select("id", "of", "at", "piece").repartition(2 * documents.sparkSession.sparkContext.defaultParallelism, "of", "at").join(shape, "of")
    return short.unionByName(spread.select("id", "at", "piece", "sure", "n", "loose").mapInArrow(in_pieces, out))
