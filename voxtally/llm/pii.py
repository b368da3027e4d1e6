"""Personal information in free text: found by a conditional random field over word shapes, replaced by placeholders.

The field is trained on the driver from a small labelled table (pii_table.LINES composed lines, the stated bound) and
the list of names, then broadcast with its weights. Texts are decoded by Viterbi in numpy batches, whole texts and
without a shuffle. Each decoded span then passes a check of its kind (an address needs an at sign and a dot in some
spelling, a phone number its digits and so on), which also settles its first character.

Defined results: null, empty and blank texts have no mention and stay as they are; repeated documents each give their
own mentions; a null doc_id is left out of the mentions; positions count Unicode code points from 1; invisible
characters inside a mention do not hide it. An empty list of names leaves context and shape only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import pii_table
from .crf import Crf

SLOTS = "EPIAN"
LABELS = ["O"] + [f"{b}{k}" for k in SLOTS for b in "BI"]
NAMES_BOUND = 100_000

_ONE = r"\p{Latin}+(?:['’]\p{Latin}+)*|\p{Nd}+|[\p{L}\p{M}]+|[^\s\p{Z}]"
_TOKEN, _PIECE = regex.compile(_ONE), regex.compile(rf"([\s\p{{Z}}]*)({_ONE})")
_HIDDEN = regex.compile(r"[\p{Cf}]")

#: Words of the classes that the features name.
NUMBER_WORDS = frozenset("zero oh one two three four five six seven eight nine double triple".split())
TEENS = frozenset("ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand".split())
STREET = frozenset("street st road rd lane avenue ave way row mews court crescent terrace drive close square place gardens hill rue calle avenida plaza boulevard via".split())
STREET_END = ("straße", "strasse", "gasse", "weg", "allee", "platz")
UNIT = frozenset("flat unit apt apartment suite room floor".split())
PARTICLE = frozenset("de van von del di da la le der den du dos".split())
TITLE = frozenset("mr ms mrs dr prof professor miss herr frau mme sir señor señora".split())
AM_WORD = frozenset("am zum zur".split())
AT_WORD, DOT_WORD = frozenset(["at"]), frozenset(["dot", "dash", "underscore", "hyphen"])


class Lists:
    """The given names and surnames, and the beginnings and endings that several of them share."""

    def __init__(self, given: list[str], surnames: list[str]) -> None:
        self.sets = {"G": frozenset(x.lower() for x in given), "S": frozenset(x.lower() for x in surnames)}
        self.starts, self.ends = {}, {}
        for k, names in self.sets.items():
            after: dict[str, set[str]] = {}
            before: dict[str, set[str]] = {}
            for n in names:
                for i in range(2, len(n) - 1):
                    after.setdefault(n[:i], set()).add(n[i])
                    before.setdefault(n[i:], set()).add(n[i - 1])
            # where several letters follow a beginning, or precede an ending, a part of a name is complete
            self.starts[k] = frozenset(x for x, c in after.items() if len(c) >= 3)
            self.ends[k] = frozenset(x for x, c in before.items() if len(c) >= 3)

    def core(self, low: str) -> str:
        for p in ("o'", "o’", "mac", "mc"):
            if low.startswith(p) and len(low) > len(p) + 3:
                return low[len(p) :]
        return low

    def like(self, low: str, k: str) -> bool:
        """Whether a shared beginning and a shared ending make up the whole word."""
        return any(low[:i] in self.starts[k] and low[i:] in self.ends[k] for i in range(2, len(low) - 1))

    def kind(self, low: str, hide: bool = False) -> str:
        core = self.core(low)
        g, s = low in self.sets["G"], core in self.sets["S"]
        if not hide and (g or s):
            return "B" if g and s else "G" if g else "S"
        g, s = self.like(low, "G"), self.like(core, "S")
        return "b" if g and s else "g" if g else "s" if s else ""


def shape(t: str) -> str:
    if t[0].isdigit():
        return f"d{min(len(t), 11)}"
    if not t[0].isalpha():
        return t
    s = "x" if t.islower() else "X" if t.isupper() else "Xx" if t[0].isupper() else "xX"
    return s + ("1" if len(t) == 1 else "2" if len(t) == 2 else "")


def class_of(t: str, lists: Lists, hide: bool = False) -> str:
    low = t.lower()
    if t[0].isdigit():
        return shape(t)
    if not t[0].isalpha():
        return t
    if low in NUMBER_WORDS:
        return "nw"
    if low == "plus":
        return "plus"
    for name, words in (("str", STREET), ("unit", UNIT), ("part", PARTICLE), ("title", TITLE), ("am", AM_WORD), ("at", AT_WORD), ("dot", DOT_WORD), ("teen", TEENS)):
        if low in words:
            return name
    if low.endswith(STREET_END) and len(low) > 6:
        return "strx"
    kind = lists.kind(low, hide)
    if kind:
        return "n" + kind
    if len(t) == 1 and t.isascii():
        return "ini" + t.islower() * "l"
    return "w" + shape(t) if t[0].isascii() or "LATIN" in _script(t[0]) else "other"


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    import unicodedata

    return unicodedata.name(c, "")


def word_features(t: str, cls: str) -> tuple[list[str], list[str], list[str]]:
    """Names of the features of a token for its own place, for the places beside it and for those two away."""
    low = t.lower()
    own = [f"w={low}", f"c={cls}", f"s={shape(t)}"]
    if t[0].isalpha():
        own += [f"p={low[:3]}", f"e={low[-3:]}", f"l={min(len(t), 9)}"]
    return own, [f"w={low}", f"c={cls}"], [f"w={low}", f"c={cls}"]


RUN_PARTS = frozenset("+()-./")
NUMERIC = frozenset([f"d{k}" for k in range(1, 12)] + ["nw", "plus"])


def runs(tokens: list[str], cls: list[str], gap: list[int], numeric: list[int] | None = None) -> tuple[dict[int, tuple[int, str]], list[tuple[list[str], int]]]:
    """For the places of tokens in a run of digits or number words the run and whether they begin it; and per run its
    features and its digits (14 at most). numeric: the places of digits and number words, if known."""
    out: dict[int, tuple[int, str]] = {}
    found: list[tuple[list[str], int]] = []
    numeric = [i for i, c in enumerate(cls) if c in NUMERIC] if numeric is None else numeric
    known = set(numeric)
    n, after = len(tokens), 0
    for i in numeric:
        if i < after:
            continue
        a = i
        while a > 0 and gap[a] == 0 and tokens[a - 1] in "+(":
            a -= 1
        if a > 0 and gap[a] <= 1 and cls[a - 1].startswith(("ini", "wX2", "wx2")) and (gap[a] == 0 or len(tokens[a - 1]) == 2):
            a -= 1
        b = i + 1
        while b < n:
            if b in known and gap[b] <= 1 or tokens[b] in RUN_PARTS and gap[b] == 0 or tokens[b] == "(" and gap[b] <= 1 and b + 1 in known:
                b += 1
            else:
                break
        while b > i + 1 and tokens[b - 1] in RUN_PARTS and not (b < n and gap[b] == 0 and cls[b].startswith("ini")):
            b -= 1
        if b < n and gap[b] <= 1 and cls[b].startswith("ini") and len(tokens[b]) == 1:
            b += 1
        digits, pattern, words = 0, "", False
        for k in range(a, b):
            c = cls[k]
            if c[0] == "d" and c[1:].isdigit():
                digits += len(tokens[k])
                pattern += ("_" if gap[k] and k > a else "") + f"d{len(tokens[k])}"
            elif c == "nw":
                words = True
                step = {"double": 2, "triple": 3}.get(tokens[k].lower(), 1)
                digits += step - 1 if step > 1 and k + 1 < b and cls[k + 1] == "nw" else 1
            else:
                pattern += ("_" if gap[k] and k > a else "") + (tokens[k] if not tokens[k].isalpha() else "A" * len(tokens[k]))
        size = min(digits, 14)
        before = tokens[a - 1].lower() if a else "^"
        behind = tokens[b].lower() if b < n else "$"
        feats = [f"rn={size}{'w' if words else ''}", f"rp={'w' if words else pattern[:24]}", f"rb={before}", f"ra={behind}", f"rf={tokens[a].lower() if words else tokens[a][:2]}{size}"]
        for k in range(a, b):
            out[k] = len(found), "B" if k == a else "I"
        found.append((feats, size))
        after = b
    return out, found


class _Gaps(dict):
    """What stands between two tokens: 0 nothing, 1 blank, 2 line break."""

    def __missing__(self, g: str) -> int:
        return 2 if "\n" in g else 1


_GAP = _Gaps({"": 0, " ": 1, "\n": 2})


def tokenize(text: str) -> tuple[list[str], list[str], list[int]]:
    """Tokens, the white space before each and its kind."""
    pieces = _PIECE.findall(text)
    between = [g for g, _ in pieces]
    return [t for _, t in pieces], between, [_GAP[g] for g in between]


def places(tokens: list[str], between: list[str]) -> list[int]:
    out, at = [], 0
    for g, t in zip(between, tokens):
        out.append(at + len(g))
        at += len(g) + len(t)
    return out


def _joint(p: str, c: str, q: str, r: str, g: int, h: int) -> list[str]:
    return [f"pc={p}|{c}", f"cq={c}|{q}", f"pcq={p}|{c}|{q}", f"cqr={c}|{q}|{r}", f"g={g}{h}|{c}", f"gq={h}|{c}|{q}", f"gp={g}|{p}|{c}"]


def joint_features(i: int, cls: list[str], gap: list[int]) -> list[str]:
    """Features of a token's class with those before and behind it and the space around it."""
    n = len(cls)
    at = lambda k: cls[k] if k < n else "$"
    return _joint(cls[i - 1] if i else "^", cls[i], at(i + 1), at(i + 2), gap[i], gap[i + 1] if i + 1 < n else 2)


class Tagger:
    """Decodes texts in batches. What a token contributes to itself and its neighbours is worked out once per distinct
    token, what a row of four classes contributes once per distinct row; the rest is gathering and adding in numpy."""

    TOKENS, JOINTS = 200_000, 200_000

    def __init__(self, crf: Crf, lists: Lists) -> None:
        self.crf, self.lists = crf, lists
        self._reset()

    def _reset(self) -> None:
        k = len(LABELS)
        self.row: dict[str, int] = {}
        self.classes: dict[str, int] = {"$": 0, "^": 1}
        self.names = ["$", "^"]
        self.class_row = np.zeros(1024, dtype=np.int64)
        self.gain = np.zeros((5, 1024, k), dtype=np.float32)  # row 0 is the space between texts
        self.used = 1
        self.joint: dict[int, np.ndarray] = {}
        self.run: dict[str, np.ndarray] = {}

    def _add(self, t: str) -> int:
        if self.used == len(self.class_row):
            self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)], axis=1)
            self.class_row = np.concatenate([self.class_row, np.zeros_like(self.class_row)])
        cls = class_of(t, self.lists)
        if cls not in self.classes:
            self.classes[cls] = len(self.names)
            self.names.append(cls)
        own, near, far = word_features(t, cls)
        sets = [own, *([d + f for f in near] for d in ("-1", "+1")), *([d + f for f in far] for d in ("-2", "+2"))]
        r = self.row[t] = self.used
        self.gain[:, r] = [self.crf.score(f) for f in sets]
        self.class_row[r] = self.classes[cls]
        self.used += 1
        return r

    def _joint(self, key: int) -> np.ndarray:
        v = self.joint.get(key)
        if v is None:
            h, g = key % 3, key // 3 % 3
            r, q, c, p = ((key // 9) >> (12 * i) & 4095 for i in range(4))
            n = self.names
            v = self.joint[key] = self.crf.score(_joint(n[p], n[c], n[q], n[r], g, h)).astype(np.float32)
        return v

    def _run(self, feature: str) -> np.ndarray:
        v = self.run.get(feature)
        if v is None:
            if len(self.run) > 100_000:
                self.run.clear()
            v = self.run[feature] = self.crf.score([feature])
        return v

    def emissions(self, docs: list[tuple[list[str], list[int]]]) -> tuple[np.ndarray, list[int]]:
        """The label scores of the tokens (tokens, gaps) of all texts, and where each text begins."""
        if self.used > self.TOKENS or len(self.names) > 4000 or len(self.joint) > self.JOINTS:
            self._reset()
        get, ids, gaps, at = self.row.get, [0, 0], [2, 2], []
        for tokens, gap in docs:
            at.append(len(ids))
            ids += [get(t) or self._add(t) for t in tokens]
            gaps += gap
            ids += (0, 0)
            gaps += (2, 2)
        i, g = np.array(ids), np.array(gaps, dtype=np.int64)
        c = self.class_row[i]
        left = c.copy()
        left[np.array(at) - 1] = 1
        of = lambda k, rows: self.gain[k].take(rows, axis=0, mode="clip")
        e = of(0, i)
        e[1:] += of(1, i[:-1])
        e[:-1] += of(2, i[1:])
        e[2:] += of(3, i[:-2])
        e[:-2] += of(4, i[2:])
        inner = slice(1, len(i) - 2)
        key = (((left[:-3] << 36) + (c[1:-2] << 24) + (c[2:-1] << 12) + c[3:]) * 9) + g[1:-2] * 3 + g[2:-1]
        kinds, back = np.unique(key, return_inverse=True)
        e[inner] += np.array([self._joint(x) for x in kinds.tolist()]).take(back, axis=0, mode="clip")
        numeric = np.flatnonzero(np.array([n in NUMERIC for n in self.names])[c])
        edges = np.searchsorted(numeric, [(a, a + len(t)) for a, (t, _) in zip(at, docs)]).reshape(-1, 2).tolist()
        for a, (tokens, gap), (lo, hi) in zip(at, docs, edges):
            if lo == hi:
                continue
            where, found = runs(tokens, [self.names[x] for x in c[a : a + len(tokens)].tolist()], gap, (numeric[lo:hi] - a).tolist())
            gains = []
            for feats, size in found:
                whole = sum(map(self._run, feats))
                gains.append({p: whole + self._run(f"rpos={p}{size}") for p in "BI"})
            e[[a + j for j in where]] += np.array([gains[r][p] for r, p in where.values()], dtype=np.float32)
        return e, at

    def labels(self, docs: list[tuple[list[str], list[int]]]) -> list[np.ndarray]:
        """The best labels of each text. A token whose score for O beats every other label by more than any change of
        transitions could make up is O on the best path, whatever stands beside it; only the stretches between such
        tokens are decoded, each with one of them on either side."""
        e, at = self.emissions(docs)
        sure = (e[:, :1] > e[:, 1:] + self.crf.sway()[1:]).all(axis=1)
        out, parts, where = [], [], []
        for k, (a, (tokens, _)) in enumerate(zip(at, docs)):
            n = len(tokens)
            out.append(np.zeros(n, dtype=np.int8))
            open_ = np.flatnonzero(~sure[a : a + n])
            if not len(open_):
                continue
            cut = np.flatnonzero(np.diff(open_) > 1)
            for lo, hi in zip(open_[np.append(0, cut + 1)].tolist(), open_[np.append(cut, len(open_) - 1)].tolist()):
                lo, hi = max(0, lo - 1), min(n, hi + 2)
                parts.append(e[a + lo : a + hi])
                where.append((k, lo, hi))
        for (k, lo, hi), lab in zip(where, self.crf.viterbi(parts, 1024)):
            out[k][lo:hi] = lab
        return out

    def mentions(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """kind, start and end (code points from 0) of the mentions of each text."""
        clean = [visible(t or "") for t in texts]
        cut = [tokenize(t) for t, _ in clean]
        labels = self.labels([(tokens, gap) for tokens, _, gap in cut])
        out = []
        for (text, back), (tokens, between, _), lab in zip(clean, cut, labels):
            marked = np.flatnonzero(lab).tolist()
            if not marked:
                out.append([])
                continue
            at, spans = places(tokens, between), []
            j = 0
            while j < len(marked):
                a = marked[j]
                k, b = (lab[a] - 1) // 2, a + 1
                while b < len(lab) and lab[b] == 2 * k + 2:
                    b += 1
                spans.append((SLOTS[k], at[a], at[b - 1] + len(tokens[b - 1])))
                while j < len(marked) and marked[j] < b:
                    j += 1
            found = settle(text, spans, self.lists)
            out.append([(k, a, b) if back is None else (k, int(back[a]), int(back[b - 1]) + 1) for k, a, b in found])
        return out


def visible(text: str) -> tuple[str, np.ndarray | None]:
    """The text without invisible characters, and the place of each of its characters in the text."""
    if text.isascii() or not _HIDDEN.search(text):
        return text, None
    keep = [i for i, c in enumerate(text) if not _HIDDEN.match(c)]
    return "".join(text[i] for i in keep), np.array(keep)


# -- checks of the decoded spans --------------------------------------------------------------------------------------

_WORD = r"[\p{Latin}\p{N}](?:[\p{Latin}\p{N}._+\-']*[\p{Latin}\p{N}_])?"
_SAID = r"(?:dot|underscore|dash|hyphen|plus)"
_LOCAL = rf"{_WORD}(?:\s+{_SAID}\s+{_WORD})*"
_AT = r"(?:\s?@\s?|\s?[\[({<]\s?at\s?[\])}>]\s?|\s+at\s+)"
_DOT = r"(?:\.(?=[\p{Latin}\p{N}])| \. (?=\p{Latin})|\s?[\[({<]\s?dot\s?[\])}>]\s?|\s+dot\s+)"
_LABEL = r"[\p{Latin}\p{N}](?:[\p{Latin}\p{N}\-]|\s+(?:dash|hyphen)\s+)*"
_EMAIL = regex.compile(rf"(?<![\p{{Latin}}\p{{N}}._+\-])(?!{_SAID}\s){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}\p{{Latin}}{{2,}}(?![\p{{Latin}}\p{{N}}])", regex.I)
_SPOKEN = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)"
_DIGITS = regex.compile(rf"\d|\b{_SPOKEN}\b", regex.I)
_NUMERIC_START = regex.compile(rf"[+(]|\d|\bplus\b|\b{_SPOKEN}\b", regex.I)


#: Figures that stand right before a number, without white space, belong to it.
_JOINED = regex.compile(r"(?:(?<![\p{L}\p{N}.\-])[+(]?\d[\d.()\-]*)?$")


def digit_count(text: str) -> int:
    """Digits in figures and words; double and triple count for what follows them."""
    words = [w.lower() for w in _DIGITS.findall(text)]
    n = 0
    for a, b in zip(words, [*words[1:], ""]):
        n += 0 if a in ("double", "triple") and b else 1
        n += (a == "double" and b != "") + 2 * (a == "triple" and b != "")
    return n


def around(text: str, a: int, b: int, n: int) -> tuple[int, int]:
    """The span and up to n characters on either side, cut at white space."""
    lo, hi = max(0, a - n), min(len(text), b + n)
    while 0 < lo < a and not text[lo - 1].isspace():
        lo += 1
    while b < hi < len(text) and not text[hi].isspace():
        hi -= 1
    return lo, hi


def person(text: str, a: int, b: int, lists: Lists) -> tuple[int, int] | None:
    """The part of a decoded name that is one: it begins with a name, an initial or a particle and has a name in it that
    is listed or shaped like the listed ones; beside an initial, behind a title or if there are two words that the
    patterns do not use otherwise, capitals do."""
    tokens = [(m.group(), a + m.start()) for m in _TOKEN.finditer(text[a:b]) if m.group()[0].isalpha()]
    known = lambda t: bool(lists.kind(t.lower()))
    while tokens and not (known(tokens[0][0]) or tokens[0][0][0].isupper() or len(tokens[0][0]) == 1 or tokens[0][0].lower() in PARTICLE):
        tokens.pop(0)
    if len(tokens) < 2:
        return None
    main = [t for t, _ in tokens if len(t) > 1 and t.lower() not in PARTICLE]
    initial = any(len(t) == 1 and t.isupper() for t, _ in tokens)
    titled = regex.search(r"(\p{L}+)\.?\s+$", text[max(0, a - 12) : tokens[0][1]])
    capitals = (initial or titled and titled[1].lower() in TITLE) and all(t[0].isupper() for t in main)
    titles = len(main) > 1 and all(t.istitle() for t in main)
    if not (any(map(known, main)) or main and capitals or titles):
        return None
    return tokens[0][1], b


def settle(text: str, spans: list[tuple[str, int, int]], lists: Lists) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []
    for k, a, b in spans:
        if k == "E":
            lo, hi = around(text, a, b, 80)
            for m in _EMAIL.finditer(text, lo, hi):
                s, e = m.start(), m.end()
                if s < b and e > a and not any(x < e and y > s for x, y in taken):
                    taken.append((s, e))
                    out.append(("email", s, e))
    for k, a, b in spans:
        if k == "E" or any(x < b and y > a for x, y in taken):
            continue
        piece = text[a:b]
        if k in "PI":
            if k == "P":
                m = _NUMERIC_START.search(piece)
                if not m:
                    continue
                a += m.start()
                a -= len(_JOINED.search(text, max(0, a - 40), a)[0])
                while a and text[a - 1] in "+(" and (a < 2 or not text[a - 2].isalnum()) and ")" in text[a:b]:
                    a -= 1
                if not 7 <= digit_count(text[a:b]) <= 15:
                    continue
                out.append(("phone", a, b))
            elif 6 <= digit_count(piece) <= 15 and not (text[a - 1 : a] == "_" or text[b : b + 1] == "_"):  # part of a file's or a record's name
                out.append(("identity", a, b))
        elif k == "A":
            low = [t.lower() for t in _TOKEN.findall(piece)]
            street = any(t in STREET or t.endswith(STREET_END) for t in low) or low[0] in AM_WORD or low[:2] == ["an", "der"]
            number = any(t[0].isdigit() or t in NUMBER_WORDS or t in TEENS for t in low)
            if street and number:
                out.append(("address", a, b))
        else:
            got = person(text, a, b, lists)
            if got:
                out.append(("name", *got))
    return sorted(out, key=lambda x: x[1])


# -- training ---------------------------------------------------------------------------------------------------------


def features(text: str, lists: Lists, hide: frozenset[int] = frozenset()) -> tuple[list[list[str]], list[int], list[str]]:
    """Feature names per token for training, token places and tokens; hidden tokens look as if in no list."""
    tokens, between, gap = tokenize(text)
    cls = [class_of(t, lists, i in hide) for i, t in enumerate(tokens)]
    base = [word_features(t, c) for t, c in zip(tokens, cls)]
    rows = []
    for i, (own, _, _) in enumerate(base):
        f = list(own)
        for d in (-2, -1, 1, 2):
            if 0 <= i + d < len(base):
                f += [f"{d:+d}{x}" for x in base[i + d][1 if abs(d) == 1 else 2]]
        rows.append(f + joint_features(i, cls, gap))
    where, found = runs(tokens, cls, gap)
    for i, (r, p) in where.items():
        rows[i] += [*found[r][0], f"rpos={p}{found[r][1]}"]
    return rows, places(tokens, between), tokens


def training_rows(given: list[str], surnames: list[str], lists: Lists) -> list[tuple[list[list[str]], list[int]]]:
    import random

    r = random.Random(9)
    rows = []
    for text, spans in pii_table.table(given, surnames):
        hide = frozenset(i for i in range(400) if r.random() < 0.35)
        feats, at, _ = features(text, lists, hide)
        lab = []
        for a in at:
            k = next(((s, a == x) for x, y, s in spans if x <= a < y), None)
            lab.append(0 if k is None else LABELS.index(("B" if k[1] else "I") + k[0]))
        if lab:
            rows.append((feats, lab))
    return rows


_MODELS: dict[tuple, tuple[Crf, Lists]] = {}


def model(given: list[str], surnames: list[str]) -> tuple[Crf, Lists]:
    """Train once per list of names and process."""
    key = (tuple(given), tuple(surnames))
    if key not in _MODELS:
        lists = Lists(given, surnames)
        crf = Crf(LABELS)
        crf.train(training_rows(given, surnames, lists))
        light = np.abs(crf.weight).max(axis=1) > 1e-3
        crf.index = {f: i for i, f in enumerate(f for f, k in crf.index.items() if light[k])}
        crf.weight = crf.weight[light]
        _MODELS.clear()
        _MODELS[key] = (crf, lists)
    return _MODELS[key]


def name_lists(names: DataFrame) -> tuple[list[str], list[str]]:
    """Given names and surnames; a list of more than NAMES_BOUND is refused, as it would be broadcast."""
    rows = names.select("person_name", "name_kind").where("person_name is not null and trim(person_name) <> ''").distinct().limit(NAMES_BOUND + 1).collect()
    if len(rows) > NAMES_BOUND:
        raise ValueError(f"more than {NAMES_BOUND} names")
    pick = lambda k: sorted(r[0].strip() for r in rows if (r[1] == "surname") == k)
    return pick(False), pick(True)


_TAGGERS: dict[int, Tagger] = {}


def tagged(spark: SparkSession, documents: DataFrame, names: DataFrame, schema: str, emit) -> DataFrame:
    """documents (doc_id, text) through the tagger; emit(batch, mentions) makes the rows."""
    shared = spark.sparkContext.broadcast(model(*name_lists(names)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = id(shared.value)
        if key not in _TAGGERS:
            _TAGGERS.clear()
            _TAGGERS[key] = Tagger(*shared.value)
        tagger = _TAGGERS[key]
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                yield emit(part, tagger.mentions(list(part.text)))

    return spread(documents.select("doc_id", "text"), "doc_id").mapInPandas(run, schema)


def _mention_rows(b: pd.DataFrame, found: list) -> pd.DataFrame:
    rows = [(d, k, a + 1) for d, ms in zip(b.doc_id, found) for k, a, _ in ms]
    return pd.DataFrame(rows, columns=["doc_id", "kind", "start_pos"]).astype({"doc_id": "int64", "start_pos": "int64"})


def mask(text: str, found: list[tuple[str, int, int]]) -> str:
    out, last = [], 0
    for k, a, b in found:
        if a >= last:
            out += [text[last:a], f"[{k.upper()}]"]
            last = b
    return "".join(out) + text[last:]


def _masked_rows(b: pd.DataFrame, found: list) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": b.doc_id.to_numpy(), "text": [t if t is None else mask(t, m) for t, m in zip(b.text, found)]})


def mentions(documents: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, kind, start_pos."""
    return tagged(documents.sparkSession, documents.where("doc_id is not null and text is not null"), names, "doc_id long, kind string, start_pos long", _mention_rows)


def masked(documents: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, text with a placeholder such as [EMAIL] in the place of each mention."""
    return tagged(documents.sparkSession, documents, names, "doc_id long, text string", _masked_rows)
