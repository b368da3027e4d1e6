"""Held-out passages inside training text.

Both sides are reduced to words (markup, speaker labels, invisible characters, case, punctuation and line breaks gone),
then to a template in which numbers, names and units are typed placeholders. Windows of three template words are keyed
by a digest; a window of placeholders alone says nothing but its values and is keyed by these. Documents are cut into
blocks of BLOCK words every STRIDE words, and the windows of a block are joined with those of the items by their key.
A block that holds at least MIN_HITS windows of an item is aligned with it, twice over:

* word by word: a passage of at least MIN_WORDS item words that begins and ends with an equal word and of which at most
  one in EDIT_SHARE is changed, left out or added is a leak (`leaked`);
* placeholder by placeholder: a passage whose template keeps to the same share while its slots are filled otherwise, each
  item value by one document value and each document value by one item value all through, is the item with other
  parameters (`reparameterised`); what is already a leak is left out there.

No leak is lost before the alignment. Let a passage of the least length have more than LONGEST words: cut behind its
first equal word at or after the fifteenth, and one of both parts, trimmed to equal words, keeps to the share, as the
score (1 a word, less EDIT_SHARE an edit) adds up; both parts have fifteen words unless edits fill L - 30 places, and as
there are at most L / 5 of these, L is 37 at most. Such a passage spans at most STRIDE document words, so one block holds
it, and with L words and e <= L / 5 edits at least L - 3 e - 2 >= MIN_HITS of its windows are untouched.

Plan: one pass over the documents. What is broadcast are two bitmaps of at most 2 ** TOP_BITS bits, built by aggregation:
of the names, and of the items' windows and parts of words. A bitmap says for certain what is in no item and may let
others through, which the join then drops; it may also take a word for a name, which the word alignment undoes. Items and
documents meet in a hash join with a salt on both sides; block and item texts are joined to the few candidates afterwards.

Defined results: null or empty texts and items of fewer than 15 words are never a case; repeated items and documents
each count under their own id; each pair is given once; a null id is left out; empty tables give an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

MIN_WORDS, EDIT_SHARE, WINDOW, LONGEST = 15, 5, 3, 37
MIN_HITS, STRIDE, BLOCK = 4, 44, 88
#: Bits of a bitmap at most; bits for each of its entries; salt of the joins.
TOP_BITS, BITS_EACH, SALT = 25, 32, 8
#: Words of a passage with other parameters that must be equal letter by letter.
MIN_EQUAL = 8

#: Words that a template treats as a number or a unit.
NUMBER_WORDS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen
sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million
first second third fourth fifth""".split())
UNITS = frozenset("db hz khz ms s min minute minutes hour hours day days week weeks km m cm mm kg g percent".split())
NUMBER, NAME, UNIT = 1, 2, 3
#: The kinds of placeholders in use.
KINDS = (NUMBER, NAME, UNIT)

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}ᅟᅠㅤ]")
_TAG = regex.compile(r"</?[A-Za-z!][^<>]{0,300}>")
_LINK = regex.compile(r"\]\([^()\s]{0,300}\)")
_WRAP = regex.compile(r"(?<=\p{L})[-‐‑]\s*\n[\s>*#|]*(?=\p{Ll})")
_LABEL = regex.compile(r"(?m)^[\s>*#|\-]*[\[(<]?\p{L}[\p{L}\p{N}_.\-]{0,24}(?:[ _-]\p{L}?\p{N}{1,4})?[\])>]?\s?:(?=\s)")
_MARKS = regex.compile(r"[^\p{L}\p{N}\s]+")


def words(text: str | None) -> list[str]:
    """The words of a text without what does not count as a difference; hyphens and apostrophes join."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "&" in text:
        text = _INVISIBLE.sub("", html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub("]", text)
    if ":" in text:
        text = _LABEL.sub(" ", text)
    text = _WRAP.sub("", text.replace("\\n", "\n")).replace("—", " ").replace("–", " ").replace("--", " ").replace("/", " ")
    return _MARKS.sub("", text).casefold().split()


# -- bitmaps ----------------------------------------------------------------------------------------------------------


class Bitmap:
    """A set of 64-bit digests: two bits each. What it denies is not in the set."""

    def __init__(self, bits: int, bytes_: np.ndarray) -> None:
        self.bits, self.bytes = bits, bytes_

    def has(self, digests: np.ndarray) -> np.ndarray:
        d = digests.view(np.uint64)
        out = np.ones(len(d), dtype=bool)
        for at in (d >> np.uint64(64 - self.bits), d & np.uint64((1 << self.bits) - 1)):
            out &= (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    def one(self, digest: int) -> bool:
        return all(self.bytes[at >> 3] >> (at & 7) & 1 for at in (digest >> (64 - self.bits), digest & ((1 << self.bits) - 1)))


def bitmap(digests: DataFrame) -> Bitmap:
    """The bitmap of the column d; its size follows the number of rows up to the bound."""
    n = digests.count()
    bits = min(TOP_BITS, max(16, (n * BITS_EACH).bit_length()))
    at = F.explode(F.array(F.shiftrightunsigned("d", 64 - bits), F.col("d").bitwiseAND(F.lit((1 << bits) - 1))))
    rows = digests.select(at.alias("at")).groupBy(F.expr("shiftright(at, 5)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 31 AS int)))").alias("v"))
    got = rows.toArrow()
    out = np.zeros(1 << (bits - 5), dtype="<u4")
    out[got["w"].to_numpy()] = got["v"].to_numpy().astype("<u4")
    return Bitmap(bits, out.view(np.uint8))


def digest(kind: str, word: str) -> int:
    return xxhash.xxh64_intdigest(kind + word)


def _signed(digests) -> list[int]:
    return np.fromiter(digests, dtype=np.uint64).view(np.int64).tolist()


# -- words, templates and windows -------------------------------------------------------------------------------------


class Lexicon(dict):
    """The row of each word in arrays of its digest, its template's digest and flags; filled once per distinct word."""

    SLOT, HEAD, TAIL, SIZE = 1, 2, 4, 400_000

    def __init__(self, names: Bitmap | None, parts: Bitmap | None = None, kinds: tuple[int, ...] = KINDS) -> None:
        super().__init__()
        self.names, self.parts, self.kinds = names, parts, kinds
        self.literal, self.template, self.flags = np.zeros(4096, np.uint64), np.zeros(4096, np.uint64), np.zeros(4096, np.uint8)

    def typed(self, w: str) -> int:
        """The placeholder of a word, 0 if it is none."""
        named = self.names is not None and self.names.one(digest("N", w))
        kind = NUMBER if w[0].isdigit() or w in NUMBER_WORDS else UNIT if w in UNITS else NAME if named else 0
        return kind if kind in self.kinds else 0

    def __missing__(self, w: str) -> int:
        n = len(self)
        if n == len(self.literal):
            self.literal, self.template, self.flags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.literal, self.template, self.flags))
        kind = self.typed(w)
        self.literal[n] = digest("W", w)
        self.template[n] = kind or self.literal[n]
        flag = self.SLOT if kind else 0
        if self.parts is not None:
            flag |= self.HEAD * self.parts.one(digest("H", w)) | self.TAIL * self.parts.one(digest("T", w))
        self.flags[n] = flag
        self[w] = n
        return n

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Keys of the windows of three words that begin at each row."""
        if len(rows) < WINDOW:
            return np.zeros(0, dtype=np.uint64)
        slot = (self.flags[rows] & self.SLOT).astype(bool)
        bare = slot[:-2] & slot[1:-1] & slot[2:]
        t, w = self.template[rows], self.literal[rows]
        a, b, c = (np.where(bare, w[i : len(rows) - 2 + i], t[i : len(rows) - 2 + i]) for i in range(3))
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + (c ^ (c >> np.uint64(31))) * np.uint64(0x165667B19E3779F9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def item_rows(items: DataFrame, names: Bitmap | None, kinds: tuple[int, ...] = KINDS) -> DataFrame:
    """item_id, body, windows (distinct keys), marks (what the bitmap holds of it) of every item that is long enough."""
    shared = items.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(shared.value, kinds=kinds)
        for b in batches:
            out = []
            for i, t in zip(b.item_id, b.text):
                ws = words(t)
                if len(ws) >= MIN_WORDS:
                    keys = np.unique(lexicon.windows(np.array([lexicon[w] for w in ws]))).view(np.int64).tolist()
                    # item words that a document may write apart, and what they may begin and end with there
                    long = {w for w in ws if len(w) >= 6}
                    parts = {digest("L", w) for w in long} | {digest("H", w[:k]) for w in long for k in range(1, len(w))} | {digest("T", w[k:]) for w in long for k in range(1, len(w))}
                    out.append((i, " ".join(ws), keys, keys + _signed(parts)))
            yield pd.DataFrame(out, columns=["item_id", "body", "windows", "marks"]).astype({"item_id": "int64"})

    return items.mapInPandas(run, "item_id long, body string, windows array<long>, marks array<long>")


def joined_apart(ws: list[str], at: list[int], parts: Bitmap) -> list[str] | None:
    """Neighbours that together spell one longer item word become that word; None if there are none. at: where to look."""
    found: dict[int, int] = {}
    after = 0
    for i in at:
        if i < after:
            continue
        for k in (3, 2):
            if i + k <= len(ws) and len(one := "".join(ws[i : i + k])) >= 6 and parts.one(digest("L", one)):
                found[i] = k
                after = i + k
                break
    if not found:
        return None
    out, last = [], 0
    for i, k in found.items():
        out += [*ws[last:i], "".join(ws[i : i + k])]
        last = i + k
    return out + ws[last:]


def block_rows(documents: DataFrame, names: Bitmap | None, marks: Bitmap, kinds: tuple[int, ...] = KINDS) -> DataFrame:
    """doc_id, block, body, hits (key and how often) of the blocks that hold MIN_HITS windows the bitmap lets through.

    A document with words written apart is cut once as it stands and once with them joined (block below zero).
    """
    shared = documents.sparkSession.sparkContext.broadcast((names, marks))

    def blocks(lexicon: Lexicon, docs: list[tuple[int, int, list[str]]], rows: np.ndarray) -> list[tuple]:
        size = np.array([len(ws) for _, _, ws in docs])
        first = np.append(0, np.cumsum(size))
        keys = lexicon.windows(rows)
        hit = lexicon.parts.has(keys) if len(keys) else np.zeros(0, dtype=bool)
        for edge in (first[1:-1] - 1, first[1:-1] - 2):  # windows over the end of a text
            hit[edge[(edge >= 0) & (edge < len(hit))]] = False
        total = np.append(0, np.cumsum(hit))
        count = np.maximum(1, -(-size // STRIDE) - 1)
        doc = np.repeat(np.arange(len(docs)), count)
        place = np.arange(count.sum()) - np.repeat(np.append(0, np.cumsum(count))[:-1], count)
        start = first[doc] + STRIDE * place
        stop = np.minimum(start + BLOCK, first[doc + 1])
        inside = np.minimum(np.maximum(stop - 2, start), len(hit))
        enough = np.flatnonzero(total[inside] - total[np.minimum(start, len(hit))] >= MIN_HITS)
        out = []
        for x in enough:
            i, variant, ws = docs[doc[x]]
            a, b = start[x], inside[x]
            got, n = np.unique(keys[a:b][hit[a:b]].view(np.int64), return_counts=True)
            k = int(place[x])
            o = STRIDE * k
            out.append((i, -1 - k if variant else k, " ".join(ws[o : o + BLOCK]), [{"key": x, "n": y} for x, y in zip(got.tolist(), n.tolist())]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(*shared.value, kinds)
        for b in batches:
            if len(lexicon) > Lexicon.SIZE:
                lexicon = Lexicon(*shared.value, kinds)
            docs = [(i, 0, ws) for i, ws in zip(b.doc_id, map(words, b.text)) if len(ws) >= MIN_WORDS - MIN_WORDS // EDIT_SHARE]
            rows = np.fromiter(map(lexicon.__getitem__, chain.from_iterable(ws for _, _, ws in docs)), dtype=np.int64)
            flags = np.append(lexicon.flags[rows], (0, 0)).astype(np.uint8)
            head, tail = flags & Lexicon.HEAD > 0, flags & Lexicon.TAIL > 0
            where = np.flatnonzero(head[:-2] & (tail[1:-1] | tail[2:]))
            first = np.append(0, np.cumsum([len(ws) for _, _, ws in docs]))
            edge = np.searchsorted(where, first)
            more = []
            for (i, _, ws), o, lo, hi in zip(docs, first, edge, edge[1:]):
                if lo < hi and (new := joined_apart(ws, (where[lo:hi] - o).tolist(), lexicon.parts)):
                    more.append((i, 1, new))
            rows = np.append(rows, np.fromiter(map(lexicon.__getitem__, chain.from_iterable(ws for _, _, ws in more)), dtype=np.int64))
            out = blocks(lexicon, docs + more, rows) if docs else []
            yield pd.DataFrame(out, columns=["doc_id", "block", "body", "hits"]).astype({"doc_id": "int64", "block": "int64"})

    return documents.mapInPandas(run, "doc_id long, block long, body string, hits array<struct<key: long, n: int>>")


# -- alignment --------------------------------------------------------------------------------------------------------

_LOW = -9000


def _planes(items: np.ndarray, docs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each item word: scores by layer and document word, the scores of passages that end here with an equal word and
    have MIN_WORDS words, and which words are equal.

    A passage scores 1 for each of its item words less EDIT_SHARE for each edit, so it keeps to the share if the score is
    not negative. Layer l is for passages of l item words, the last layer for all from MIN_WORDS on.
    """
    b, m = docs.shape
    top = MIN_WORDS
    cols = (EDIT_SHARE * np.arange(m)).astype(np.int16)
    f = np.full((b, top + 1, m), _LOW, dtype=np.int16)
    for w in items.T:
        eq = docs == w[:, None]
        step = np.where(eq, 1, 1 - EDIT_SHARE).astype(np.int16)
        end = np.full((b, m), _LOW, dtype=np.int16)
        np.maximum(f[:, top - 1, :-1], f[:, top, :-1], out=end[:, 1:])
        end = np.where(eq, end + 1, _LOW)
        moved = f + np.int16(1 - EDIT_SHARE)
        np.maximum(moved[:, :, 1:], f[:, :, :-1] + step[:, None, 1:], out=moved[:, :, 1:])
        f = np.full_like(f, _LOW)
        f[:, 2:] = moved[:, 1:-1]
        np.maximum(f[:, top], moved[:, top], out=f[:, top])
        f[:, 1] = np.where(eq, 1, _LOW)
        f += cols
        np.maximum.accumulate(f, axis=2, out=f)
        f -= cols
        np.maximum(f, _LOW, out=f)
        yield f, end, eq


def _stack(parts: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts))), fill, dtype=np.int64)
    for row, p in zip(out, parts):
        row[: len(p)] = p
    return out


def passages(items: list[np.ndarray], docs: list[np.ndarray], size: int = 64) -> np.ndarray:
    """Whether each document stretch holds a passage of its item; pairs of like length are aligned together."""
    found = np.zeros(len(items), dtype=bool)
    order = sorted(range(len(items)), key=lambda k: len(items[k]))
    for at in range(0, len(order), size):
        part = order[at : at + size]
        ok = np.zeros(len(part), dtype=bool)
        for _, end, _ in _planes(_stack([items[k] for k in part], -2), _stack([docs[k] for k in part], -1)):
            ok |= (end >= 0).any(axis=1)
            if ok.all():
                break
        found[part] = ok
    return found


def best_passage(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Item and document places of the equal words of the best-scoring passage; [] if none keeps to the share."""
    planes = [(f[0].copy(), end[0], eq[0]) for f, end, eq in _planes(item[None], doc[None])]
    score, i, j = max((int(end[j]), -i, -j) for i, (_, end, _) in enumerate(planes) for j in (int(end.argmax()),))
    if score < 0:
        return []
    i, j, top = -i, -j, MIN_WORDS
    layer, out = top, []
    now = score
    while True:
        f, _, eq = planes[i]
        if layer == 1 and eq[j] and now == 1:
            return [(i, j), *out]
        below = (top - 1, top) if layer == top else (layer - 1,)
        step = 1 if eq[j] else 1 - EDIT_SHARE
        before = planes[i - 1][0] if i else None
        came = [x for x in below if x > 0 and i and j and before[x, j - 1] + step == now]
        gone = [x for x in below if x > 0 and i and before[x, j] + 1 - EDIT_SHARE == now]
        if came:
            if eq[j]:
                out.insert(0, (i, j))
            i, j, layer = i - 1, j - 1, came[0]
        elif gone:
            i, layer = i - 1, gone[0]
        elif j:
            j -= 1
        else:
            return out
        now = int(planes[i][0][layer, j])


def _near(item: np.ndarray, doc: np.ndarray, mark: np.ndarray) -> bool:
    """Whether the pair can hold a passage at all: some MIN_WORDS or more item words in a row of which the stretch lacks
    no more than the share, and MIN_HITS windows within the drift that LONGEST words allow. mark: all False, by word."""
    mark[doc] = True
    score = np.append(0, np.cumsum(np.where(mark[item], 1, 1 - EDIT_SHARE)))
    mark[doc] = False
    if not (np.minimum.accumulate(score)[:-MIN_WORDS] <= score[MIN_WORDS:]).any():
        return False
    eq = item[:, None] == doc[None, :]
    i, j = np.nonzero(eq[:-2, :-2] & eq[1:-1, 1:-1] & eq[2:, 2:])
    per = np.append(0, np.cumsum(np.bincount(j - i + len(item), minlength=len(item) + len(doc) + LONGEST)))
    width = LONGEST // EDIT_SHARE + 1
    return bool((per[width:] - per[:-width] >= MIN_HITS).any())


def _other_values(item: list[str], doc: list[str], pairs: list[tuple[int, int]], slot) -> tuple[int, int] | None:
    """Slots and changed slots of a passage whose slots map one to one; None if they do not or too few words are equal."""
    to: dict[str, str] = {}
    back: dict[str, str] = {}
    slots = changed = equal = 0
    for i, j in pairs:
        a, b = item[i], doc[j]
        equal += a == b
        if slot(a):
            slots += 1
            changed += a != b
            if to.setdefault(a, b) != b or back.setdefault(b, a) != a:
                return None
    return (slots, changed) if changed and equal >= MIN_EQUAL else None


# -- the operator -----------------------------------------------------------------------------------------------------


def candidates(documents: DataFrame, items: DataFrame, names: DataFrame | None, kinds: tuple[int, ...] = KINDS) -> tuple[DataFrame, Bitmap | None]:
    """(doc_id, item_id, body, item_body of the blocks and items that share MIN_HITS windows, the bitmap of the names)."""
    people = None
    if names is not None:

        def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"d": _signed(digest("N", x) for x in b.person_name.str.strip().str.casefold())}, dtype="int64")

        people = bitmap(names.select("person_name").where("person_name is not null").mapInPandas(folded, "d long"))
    given = cut(item_rows(items.select("item_id", "text").where("item_id is not null and text is not null"), people, kinds))
    marks = bitmap(given.select(F.explode("marks").alias("d")).distinct())
    texts = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null"), "doc_id")
    blocks = cut(block_rows(texts, people, marks, kinds))

    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("salt")
    windows = salted(given.select("item_id", F.explode("windows").alias("key")))
    hits = blocks.select("doc_id", "block", salt, F.explode("hits").alias("h")).select("doc_id", "block", "salt", "h.key", "h.n")
    pairs = hits.join(windows, ["key", "salt"]).groupBy("doc_id", "block", "item_id").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_HITS)
    near = pairs.join(blocks.select("doc_id", "block", "body"), ["doc_id", "block"]).select("doc_id", "item_id", salt, "body")
    return near.join(salted(given.select("item_id", F.col("body").alias("item_body"))), ["item_id", "salt"]).select("doc_id", "item_id", "body", "item_body"), people


class _Coder(dict):
    """Numbers for words, for one batch of pairs."""

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self) + 8
        return n


def _coded(texts: pd.Series, code: _Coder) -> list[np.ndarray]:
    known: dict[str, np.ndarray] = {}
    out = []
    for t in texts:
        if t not in known:
            known[t] = np.fromiter((code[w] for w in t.split(" ")), dtype=np.int64)
        out.append(known[t])
    return out


def leaked(documents: DataFrame, items: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """doc_id, item_id of every document that holds a passage of the item."""
    near, _ = candidates(documents, items, names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            code = _Coder()
            its, docs = _coded(b.item_body, code), _coded(b.body, code)
            mark = np.zeros(len(code) + 8, dtype=bool)
            live = [k for k in range(len(b)) if _near(its[k], docs[k], mark)]
            ok = passages([its[k] for k in live], [docs[k] for k in live]) if live else np.zeros(0, dtype=bool)
            yield b.iloc[[k for k, x in zip(live, ok) if x]][["doc_id", "item_id"]].drop_duplicates()

    return near.mapInPandas(run, "doc_id long, item_id long").distinct()


def reparameterised(documents: DataFrame, items: DataFrame, names: DataFrame | None = None, kinds: tuple[int, ...] = KINDS) -> DataFrame:
    """doc_id, item_id, n_slots, n_changed of the documents that hold an item's passage with other numbers, names or
    units, the values mapped one to one, and are no leak of it; of several passages the one with most slots."""
    near, people = candidates(documents, items, names, kinds)
    shared = documents.sparkSession.sparkContext.broadcast(people)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(shared.value, kinds=kinds)
        slot: dict[str, int] = {}

        def kind(w: str) -> int:
            if w not in slot:
                if len(slot) > Lexicon.SIZE:
                    slot.clear()
                slot[w] = lexicon.typed(w)
            return slot[w]

        for b in batches:
            code = _Coder()
            out = []
            for d, i, body, item in zip(b.doc_id, b.item_id, b.body, b.item_body):
                ws, its = body.split(" "), item.split(" ")
                a, c = (np.fromiter((kind(w) or code[w] for w in x), dtype=np.int64) for x in (its, ws))
                lit = [np.fromiter((code[w] for w in x), dtype=np.int64) for x in (its, ws)]
                mark = np.zeros(len(code) + 8, dtype=bool)
                leak = _near(*lit, mark) and bool(passages([lit[0]], [lit[1]])[0])
                got = None if leak or not _near(a, c, mark) else _other_values(its, ws, best_passage(a, c), kind)
                if leak or got:
                    out.append((d, i, leak, *(got or (0, 0))))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "leak", "n_slots", "n_changed"]).astype({"doc_id": "int64", "item_id": "int64", "leak": bool})

    rows = near.mapInPandas(run, "doc_id long, item_id long, leak boolean, n_slots long, n_changed long")
    best = F.max(F.struct("n_slots", "n_changed")).alias("x")
    return rows.groupBy("doc_id", "item_id").agg(F.max("leak").alias("leak"), best).where("not leak").select("doc_id", "item_id", "x.n_slots", "x.n_changed")
