"""Edit-distance kernels in plain Python and numpy, for the metrics that column expressions cannot state.

They take word lists or texts, raise ValueError or ZeroDivisionError where a metric is undefined, and know nothing of
Spark; operators.metrics wraps them in Arrow batches.
"""

from __future__ import annotations

import string
from collections import Counter
from itertools import permutations, product

import numpy as np

_STRIP = str.maketrans("", "", string.punctuation)


def words_n1(text: str) -> list[str]:
    return "".join(c for c in text.lower() if c.isalnum() or c == "_" or c.isspace()).split()


def words_n2(text: str) -> list[str]:
    return "".join(c for c in text.lower() if c.isalnum() or c.isspace()).split()


def word_n3(word: str) -> str:
    return word.lower().translate(_STRIP)


def distance(ref: list[str], hyp: list[str], sub_cost: int = 1) -> int:
    """Weighted Levenshtein distance, a row at a time in numpy."""
    if not ref or not hyp:
        return len(ref) + len(hyp)
    ids: dict[str, int] = {}
    a = [ids.setdefault(w, len(ids)) for w in ref]
    b = np.array([ids.setdefault(w, len(ids)) for w in hyp])
    step = np.arange(len(b) + 1)
    row = step.copy()
    for i, w in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + np.where(b == w, 0, sub_cost), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - step) + step
    return int(row[-1])


def wer(ref: str, hyp: str, absolute: bool = False, sub_cost: int = 1) -> float:
    """Word error rate of two texts by n2; an empty reference raises ZeroDivisionError."""
    r, h = words_n2(ref), words_n2(hyp)
    d = distance(r, h, sub_cost)
    return d if absolute else d / len(r)


def align(ref: list[str], hyp: list[str], variant: int = 1) -> tuple[float, int, list[tuple[str, str | None, str | None]]]:
    """Rate, distance and steps (op, reference word, hypothesis word).

    Variant 1 compares words as they are, prefers substitutions to insertions to deletions, calls them match, sub, ins
    and del, and gives 1.0 for an empty reference with a hypothesis. Variant 2 ignores ASCII punctuation, walks back by
    match, sub, insert, delete and gives 0.0 for an empty reference.
    """
    names = {1: ("ins", "del"), 2: ("insert", "delete")}[variant]
    key = (lambda w: w) if variant == 1 else (lambda w: w.translate(_STRIP))
    r, h = [key(w) for w in ref], [key(w) for w in hyp]
    n, m = len(r), len(h)
    d = np.zeros((n + 1, m + 1), dtype=np.int64)
    d[:, 0], d[0, :] = np.arange(n + 1), np.arange(m + 1)
    cols = np.arange(m + 1)
    hyp_ids = {w: i for i, w in enumerate(dict.fromkeys(h))}
    b = np.array([hyp_ids[w] for w in h], dtype=np.int64)
    for i in range(1, n + 1):
        new = d[i].copy()
        new[1:] = np.minimum(d[i - 1, :-1] + (b != hyp_ids.get(r[i - 1], -1)), d[i - 1, 1:] + 1)
        d[i] = np.minimum.accumulate(new - cols) + cols
    steps, i, j = [], n, m
    while i or j:
        if i and j and r[i - 1] == h[j - 1] and d[i, j] == d[i - 1, j - 1]:
            steps.append(("match", ref[i - 1], hyp[j - 1]))
            i, j = i - 1, j - 1
        elif i and j and d[i, j] == d[i - 1, j - 1] + 1:
            steps.append(("sub", ref[i - 1], hyp[j - 1]))
            i, j = i - 1, j - 1
        elif j and d[i, j] == d[i, j - 1] + 1:
            steps.append((names[0], None, hyp[j - 1]))
            j -= 1
        else:
            steps.append((names[1], ref[i - 1], None))
            i -= 1
    rate = d[n, m] / n if n else (1.0 if variant == 1 and m else 0.0)
    return float(rate), int(d[n, m]), steps[::-1]


# -- speaker-attributed rates -----------------------------------------------------------------------------------------

Segment = tuple[str, str]
DUMMY = "dummy"


def by_speaker(segments: list[Segment]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for who, text in segments:
        out.setdefault(who, []).append(text)
    return out


def _best_match(cost: np.ndarray) -> tuple[float, list[int]]:
    """Least-cost assignment of rows to columns: all permutations up to six, above that shortest augmenting paths."""
    n = len(cost)
    if n <= 6:
        best = min(permutations(range(n)), key=lambda p: sum(cost[p[j], j] for j in range(n)))
        return float(sum(cost[best[j], j] for j in range(n))), list(best)
    inf = float("inf")
    u, v, owner, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        slack, used = np.full(n + 1, inf), np.zeros(n + 1, dtype=bool)
        while owner[at]:
            used[at] = True
            row = owner[at]
            free = ~used[1:]
            gain = cost[row - 1] - u[row] - v[1:]
            better = free & (gain < slack[1:])
            slack[1:][better], way[1:][better] = gain[better], at
            nxt = int(np.where(free, slack[1:], inf).argmin()) + 1
            delta = slack[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            slack[~used] -= delta
            at = nxt
        while at:
            owner[at], at = owner[way[at]], way[at]
    rows = [int(owner[j]) - 1 for j in range(1, n + 1)]
    return float(sum(cost[rows[j], j] for j in range(n))), rows


def cp_wer(ref: list[Segment], hyp: list[Segment], compat: bool = True) -> float:
    """Concatenated minimum-permutation rate. The distance is over n2 words; with compat the denominator and the cost
    of a stream without a partner are raw words split at white space, otherwise n2 words as well."""
    total, _, raw = _cp(ref, hyp, compat)
    return total / raw


def _cp(ref: list[Segment], hyp: list[Segment], compat: bool = True) -> tuple[float, list[tuple[str, str]], int]:
    size = (lambda t: len(t.split())) if compat else (lambda t: len(words_n2(t)))
    r = {k: " ".join(v) for k, v in by_speaker(ref).items()}
    h = {k: " ".join(v) for k, v in by_speaker(hyp).items()}
    n = max(len(r), len(h))
    rk, hk = list(r) + [DUMMY] * (n - len(r)), list(h) + [DUMMY] * (n - len(h))
    cost = np.zeros((n, n))
    for i, j in product(range(n), range(n)):
        if i >= len(r):
            cost[i, j] = size(h[hk[j]]) if j < len(h) else 0
        elif j >= len(h):
            cost[i, j] = size(r[rk[i]])
        else:
            cost[i, j] = distance(words_n2(r[rk[i]]), words_n2(h[hk[j]]))
    total, rows = _best_match(cost) if n else (0.0, [])
    return total, [(rk[rows[j]], hk[j]) for j in range(n)], sum(size(t) for t in r.values())


def _stream_cost(pairs: list[tuple[str, str]], r: dict, h: dict, sub_cost: int) -> int:
    total = 0
    for a, b in pairs:
        if a == DUMMY or b == DUMMY:
            total += len(h.get(b, [])) if a == DUMMY else len(r.get(a, []))
        else:
            total += distance(words_n2(" ".join(r.get(a, []))), words_n2(" ".join(h.get(b, []))), sub_cost)
    return total


def di_cp_wer(ref: list[Segment], hyp: list[Segment]) -> float:
    """Diarisation-invariant rate: from the best permutation, single hypothesis segments change their speaker, keeping
    their place in time, while the total falls, first with substitutions at 1, then at 2. The denominator counts
    reference segments, and so does the cost of a stream without a partner."""
    r, pairs = by_speaker(ref), _cp(ref, hyp)[1]
    who, texts = [s for s, _ in hyp], [t for _, t in hyp]
    speakers = list(dict.fromkeys(who))
    total = lambda labels, sub_cost: _stream_cost(pairs, r, by_speaker(list(zip(labels, texts))), sub_cost)
    for sub_cost in (1, 2):
        best, moved = total(who, sub_cost), True
        while moved:
            moved = False
            for i, s in product(range(len(who)), speakers):
                if s != who[i]:
                    trial = [*who[:i], s, *who[i + 1 :]]
                    cost = total(trial, sub_cost)
                    if cost < best:
                        best, who, moved = cost, trial, True
    return total(who, 1) / sum(len(v) for v in r.values())


#: Assignments tried one by one at most, and cells of the plane over all streams at most.
ASSIGNMENTS, CELLS = 20_000, 20_000_000


def orc_wer(ref: list[str], hyp: list[str], words=str.split) -> float:
    """Optimal reference combination: every reference text goes to one hypothesis stream, in order, so that the sum of
    the distances is least.

    Few assignments are tried one by one; a stream's words depend on the assignment only. Of more a plane over the
    places in all streams keeps the least cost after each reference text. ValueError if that has more than CELLS cells.
    """
    r, h = [words(t) for t in ref], [words(t) for t in hyp]
    total = sum(map(len, r))
    if not h:
        return total / total
    if len(h) ** len(r) > ASSIGNMENTS:
        return _orc_plane(r, h) / total
    best = None
    known: dict[tuple, int] = {}
    for to in product(range(len(h)), repeat=len(r)):
        cost = 0
        for s, stream in enumerate(h):
            key = (s, tuple(i for i, x in enumerate(to) if x == s))
            if key not in known:
                known[key] = distance([w for i in key[1] for w in r[i]], stream)
            cost += known[key]
        best = cost if best is None else min(best, cost)
    return best / total


def _orc_plane(r: list[list[str]], h: list[list[str]]) -> int:
    """d[p, q, ..] is the least cost of the reference texts so far with p, q, .. words of the streams used up."""
    shape = [len(s) + 1 for s in h]
    if np.prod(shape, dtype=np.float64) > CELLS:
        raise ValueError(f"{len(r)} reference speakers and {len(h)} streams are too many for an exact assignment")
    ids: dict[str, int] = {}
    codes = [np.array([ids.setdefault(w, len(ids)) for w in s], dtype=np.int64) for s in h]
    steps = [np.arange(n, dtype=np.int32).reshape([-1 if k == i else 1 for k in range(len(h))]) for i, n in enumerate(shape)]
    d = sum(steps, np.zeros(shape, dtype=np.int32))
    for text in r:
        best = None
        for k, code in enumerate(codes):
            e = d
            here = lambda a, k=k: tuple(a if i == k else slice(None) for i in range(len(h)))
            for w in text:
                new = e + 1
                met = e[here(slice(None, -1))] + (code != ids.get(w, -1)).astype(np.int32).reshape(steps[k][here(slice(1, None))].shape)
                np.minimum(new[here(slice(1, None))], met, out=new[here(slice(1, None))])
                e = np.minimum.accumulate(new - steps[k], axis=k) + steps[k]
            best = e if best is None else np.minimum(best, e)
        d = best
    return int(d[tuple(-1 for _ in h)])


# -- two-stream serialisation -----------------------------------------------------------------------------------------


def dss_distance(a: list[str], b: list[str], h: list[str]) -> int:
    """Least word distance of h to any order-preserving interleaving of a and b, exactly.

    D[i, j] after t hypothesis words is the cost of having used i words of a and j of b. A hypothesis word is inserted,
    or meets the next word of a or of b; then words of a and b may be left out, which is a running minimum along both
    axes. One plane is kept, so memory is |a| * |b| and time |a| * |b| * |h|.
    """
    ids: dict[str, int] = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in a], dtype=np.int64)
    y = np.array([ids.setdefault(w, len(ids)) for w in b], dtype=np.int64)
    skip = np.arange(len(a) + 1, dtype=np.int32)[:, None] + np.arange(len(b) + 1, dtype=np.int32)[None, :]
    d = skip.copy()
    for w in h:
        k = ids.get(w, -1)
        new = d + 1
        np.minimum(new[1:], d[:-1] + (x != k).astype(np.int32)[:, None], out=new[1:])
        np.minimum(new[:, 1:], d[:, :-1] + (y != k).astype(np.int32)[None, :], out=new[:, 1:])
        new -= skip
        np.minimum.accumulate(new, axis=0, out=new)
        np.minimum.accumulate(new, axis=1, out=new)
        d = new + skip
    return int(d[-1, -1])


#: Cells of all planes that an alignment keeps at once; longer pairs are halved at a hypothesis word first.
PLANES = 8_000_000
Step2 = tuple[str, str, str | None, str | None]


def _planes(a: list, b: list, h: list, keep: bool) -> list[np.ndarray]:
    """The plane after each hypothesis word (the last one only without keep), as in dss_distance."""
    skip = np.arange(len(a) + 1, dtype=np.int32)[:, None] + np.arange(len(b) + 1, dtype=np.int32)[None, :]
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(w, len(ids)) for w in c], dtype=np.int64) for c in (a, b))
    out = [skip.copy()]
    for w in h:
        k, d = ids.get(w, -1), out[-1]
        new = d + 1
        np.minimum(new[1:], d[:-1] + (x != k).astype(np.int32)[:, None], out=new[1:])
        np.minimum(new[:, 1:], d[:, :-1] + (y != k).astype(np.int32)[None, :], out=new[:, 1:])
        new = np.minimum.accumulate(np.minimum.accumulate(new - skip, axis=0), axis=1) + skip
        out = [*out, new] if keep else [new]
    return out


def dss_align(a: list[str], b: list[str], h: list[str]) -> list[Step2]:
    """Steps (op, chain, reference word, hypothesis word) of an exact two-stream alignment: match and sub of chain A or B,
    insert of chain H, delete of chain A or B; as many of them are no match as dss_distance says. Of equal ways a match
    comes before a substitution, an insertion and a deletion, and A before B, seen from the end."""
    if len(h) > 1 and (len(a) + 1) * (len(b) + 1) * (len(h) + 1) > PLANES:
        m = len(h) // 2
        total = _planes(a, b, h[:m], False)[-1] + _planes(a[::-1], b[::-1], h[m:][::-1], False)[-1][::-1, ::-1]
        i, j = np.unravel_index(int(total.argmin()), total.shape)
        return dss_align(a[:i], b[:j], h[:m]) + dss_align(a[i:], b[j:], h[m:])
    d = _planes(a, b, h, True)
    i, j, t, out = len(a), len(b), len(h), []
    while i or j or t:
        now = d[t][i, j]
        ways = []
        if t and i:
            same = a[i - 1] == h[t - 1]
            ways.append((0 if same else 1, d[t - 1][i - 1, j] + (not same), ("match" if same else "sub", "A", a[i - 1], h[t - 1]), (1, 0, 1)))
        if t and j:
            same = b[j - 1] == h[t - 1]
            ways.append((0 if same else 1, d[t - 1][i, j - 1] + (not same), ("match" if same else "sub", "B", b[j - 1], h[t - 1]), (0, 1, 1)))
        if t:
            ways.append((2, d[t - 1][i, j] + 1, ("insert", "H", None, h[t - 1]), (0, 0, 1)))
        if i:
            ways.append((3, d[t][i - 1, j] + 1, ("delete", "A", a[i - 1], None), (1, 0, 0)))
        if j:
            ways.append((3, d[t][i, j - 1] + 1, ("delete", "B", b[j - 1], None), (0, 1, 0)))
        _, _, step, back = min((w for w in ways if w[1] == now), key=lambda w: w[0])
        out.append(step)
        i, j, t = i - back[0], j - back[1], t - back[2]
    return out[::-1]


def dss_wer(a: list[str], b: list[str], h: list[str]) -> float:
    """dss_distance per reference word after n3; ZeroDivisionError without reference words."""
    a, b, h = ([word_n3(w) for w in x] for x in (a, b, h))
    return dss_distance(a, b, h) / (len(a) + len(b))


class Beam:
    """The two-stream search with a bounded frontier, for scores comparable with published beam results.

    A state (i, j, t) has used i and j words of the streams and t of the hypothesis. The successors of a frontier form
    the next one; a state keeps the least cost it was ever reached with. The frontier is ordered by cost plus weighted
    estimate, cost and depth, and thinned by taking turns over strips of i - j; it widens where many are near the best.
    """

    def __init__(self, width: int = 64, weight: float = 1.0, lookahead: int = 20, max_expansions: int = 250_000, adaptive: bool = True, margin: float = 1.0, stride: int = 1) -> None:
        if width < 1 or max_expansions < 1 or lookahead < 0 or weight < 0 or stride < 1:
            raise ValueError("beam parameters out of range")
        self.width, self.weight, self.lookahead, self.limit = width, weight, lookahead, max_expansions
        self.adaptive, self.margin, self.stride = adaptive, margin, stride

    def _estimate(self, a: list[str], b: list[str], h: list[str], s: tuple[int, int, int]) -> int:
        i, j, t = s
        k = self.lookahead
        rest = abs(len(a) - i + len(b) - j - (len(h) - t))
        bag = Counter(a[i : i + k])
        bag.update(b[j : j + k])
        bag.subtract(Counter(h[t : t + k]))
        return max(rest, -(-sum(map(abs, bag.values())) // 2))

    @staticmethod
    def _steps(a: list[str], b: list[str], h: list[str], s: tuple[int, int, int]):
        """The states one edit away with its cost: words that meet, a word too many, a word left out."""
        i, j, t = s
        if t < len(h):
            if i < len(a):
                yield (i + 1, j, t + 1), a[i] != h[t]
            if j < len(b):
                yield (i, j + 1, t + 1), b[j] != h[t]
            yield (i, j, t + 1), 1
        if i < len(a):
            yield (i + 1, j, t), 1
        if j < len(b):
            yield (i, j + 1, t), 1

    def _thin(self, ranked: list[tuple], width: int) -> list[tuple]:
        if len(ranked) <= width:
            return ranked
        strips: dict[int, list[tuple]] = {}
        for x in ranked:
            strips.setdefault((x[1][0] - x[1][1]) // self.stride, []).append(x)
        lanes = sorted(strips.values(), key=lambda v: v[0][0][0])
        out: list[tuple] = []
        depth = 0
        while len(out) < width:
            for lane in lanes:
                if depth < len(lane) and len(out) < width:
                    out.append(lane[depth])
            depth += 1
        return out

    def _pass(self, a: list[str], b: list[str], h: list[str], width: int) -> tuple[float, list[tuple[int, int, int]]]:
        """The cost of the best way found, and its states in order."""
        goal, most, far = (len(a), len(b), len(h)), 2 * width, float("inf")
        least, estimate, came = {(0, 0, 0): 0}, {}, {}
        frontier, spent = [(0, 0, 0)], 0
        while spent < self.limit and any(s != goal for s in frontier):
            reached: dict[tuple, None] = {}
            for s, so_far in [(s, least[s]) for s in frontier]:
                if s == goal:
                    reached[s] = None
                    continue
                for to, cost in self._steps(a, b, h, s):
                    reached[to] = None
                    if so_far + cost < least.get(to, far):
                        least[to], came[to] = so_far + cost, s
                spent += 1
                if spent >= self.limit:
                    break
            for s in reached:
                if s not in estimate:
                    estimate[s] = self._estimate(a, b, h, s)
            ranked = sorted((((least[s] + self.weight * estimate[s], least[s], -sum(s)), s) for s in reached), key=lambda x: x[0])
            near = sum(x[0][0] <= ranked[0][0][0] + self.margin for x in ranked[: 2 * most])
            wide = self.adaptive and near >= max(4, width // 2)
            frontier = [s for _, s in self._thin(ranked, most if wide else width)]
        way = [goal] if goal in least else []
        while way and way[-1] in came:
            way.append(came[way[-1]])
        return float(least.get(goal, far)), way[::-1]

    def align(self, a: list[str], b: list[str], h: list[str]) -> tuple[float, list[Step2]]:
        """Cost and steps (as of dss_align) of the better of a pass from the front and a narrower one over the reversed
        streams, of equal ones that from the front; words are compared after n3 and given as they are."""
        x, y, z = ([word_n3(w) for w in c] for c in (a, b, h))
        tail = max(8, self.width // 2) if self.adaptive else self.width
        cost, way = self._pass(x, y, z, self.width)
        back, other = self._pass(x[::-1], y[::-1], z[::-1], tail)
        if back < cost:
            cost, way = back, [(len(a) - i, len(b) - j, len(h) - t) for i, j, t in other[::-1]]
        steps: list[Step2] = []
        for (i, j, t), (k, m, n) in zip(way, way[1:]):
            chain, words, norm, at = ("A", a, x, i) if k > i else ("B", b, y, j) if m > j else ("H", None, None, 0)
            if words is None:
                steps.append(("insert", "H", None, h[t]))
            elif n > t:
                steps.append(("match" if norm[at] == z[t] else "sub", chain, words[at], h[t]))
            else:
                steps.append(("delete", chain, words[at], None))
        return cost, steps

    def distance(self, a: list[str], b: list[str], h: list[str]) -> float:
        return self.align(a, b, h)[0]


# -- waveforms --------------------------------------------------------------------------------------------------------


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.asarray(x, dtype=np.float64) ** 2) + 1e-12))


def mix_at_snr(speech: np.ndarray, noise: np.ndarray, snr_db: float) -> np.ndarray:
    """speech plus noise scaled so that their levels differ by snr_db."""
    gain = rms(speech) / (1e-12 + rms(noise) * 10 ** (snr_db / 20))
    return np.asarray(speech) + gain * np.asarray(noise)


def overlap_ratio(active: np.ndarray) -> float:
    """Share of active samples at which more than one speaker is active."""
    n = int((np.asarray(active) >= 1).sum())
    return float((np.asarray(active) > 1).sum() / n) if n else 0.0
