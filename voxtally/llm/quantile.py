"""Percentiles of very large numeric columns from dyadic Count-sketches.

A finite double is encoded as the first BITS bits of its order-preserving bit pattern. For each prefix length above
EXACT there is one Count-sketch (DEPTH rows of WIDTH signed counters) of the prefixes; the prefixes of length EXACT, of
which there are hardly more than a sketch has counters, are counted plainly, as the published form of the method does.
A sketch is linear: sketches of days, partitions or sources are merged by addition, and rows with a negative weight
delete earlier ones. A percentile is found by descending from the root, at each level going left or right by the
estimated counts of the children.

Estimates: on each level the prefixes that hold at least 1 / HEAVY of the rows are found on the way down and their
estimates subtracted from the level's counters, so that the rest of the level carries what is left only; whatever was
subtracted is added again for its own prefix. By linearity the counters then are a sketch of the difference between the
true counts and the subtracted ones, of squared norm F2, which the rows' own squares state.

Error: the value has a relative error of at most 2**-(BITS-12) (the cell it stands for); below 2**-1022 doubles have
fewer digits, and it is an absolute one of at most 2**-1034. The rank of its cell's edge is a sum of one estimate per
level, each half the difference of two children's; the variance of an estimate is at most F2 / WIDTH (a median of rows
varies no more than a row), the levels' hash functions are independent, so the variance of the rank is at most the sum
of F2 / (2 * WIDTH). rank_error states four times its root as a share of the count, and 1 / n at least: by Chebyshev's
inequality it holds for any one percentile with probability 15 / 16, in measurements always.
Two sketches can be merged only if built with the same constants.

Partial sketches are built per input split before anything is shuffled and travel in the smallest form: a list of codes
with weights while that is shorter, else the counters in the narrowest type. The form never changes a result, as a list
is added to the counters before anything is read from them.

Defined results: null, NaN and infinite values are left out; a null group is a group of its own; repeated rows count
as often as they stand; groups without a finite value give no row; -0.0 equals 0.0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, EXACT, WIDTH_BITS, DEPTH = 24, 12, 9, 5
WIDTH = 1 << WIDTH_BITS
LEVELS = list(range(EXACT + 1, BITS + 1))
CELLS = (1 << EXACT) + len(LEVELS) * DEPTH * WIDTH
#: A prefix with 1 / HEAVY of the rows is subtracted, in ROUNDS corrections; distinct codes that a task holds.
HEAVY, ROUNDS, ROWS = 512, 4, 1_000_000

_LEVEL = np.repeat(np.array(LEVELS, dtype=np.uint64), DEPTH)
_SHIFT = np.uint64(BITS) - _LEVEL
_SEED = (np.arange(1, len(_LEVEL) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
_BASE = (1 << EXACT) + np.arange(len(_LEVEL), dtype=np.int64) * WIDTH


def encode(values: np.ndarray) -> np.ndarray:
    """Codes of finite doubles, in their order."""
    bits = (np.asarray(values, dtype=np.float64) + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    ordered = np.where(bits & top, ~bits, bits | top)
    return ordered >> np.uint64(64 - BITS)


def decode(code: int) -> float:
    """The middle of a code's cell; the code of zero gives zero."""

    def edge(x: int) -> float:
        bits = x << (64 - BITS)
        bits = bits ^ (1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
        return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])

    low = edge(code)
    if low == 0.0:
        return 0.0
    high = edge(code + 1)
    return low if not np.isfinite(high) else low / 2 + high / 2  # the sum of two edges may be infinite


def _hash(prefix: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each prefix under each seed."""
    with np.errstate(over="ignore"):
        x = (prefix + seed) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(64 - WIDTH_BITS)).astype(np.int64), ((x >> np.uint64(20)) & np.uint64(1)).astype(np.int64) * 2 - 1


def add(sketch: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> None:
    """Add codes with integer weights to a sketch, in place."""
    codes, weights = codes.astype(np.uint64), weights.astype(np.float64)
    for at in range(0, len(codes), 8192):
        c, w = codes[at : at + 8192], weights[at : at + 8192]
        sketch[: 1 << EXACT] += np.bincount((c >> np.uint64(BITS - EXACT)).astype(np.int64), weights=w, minlength=1 << EXACT).astype(np.int64)
        bucket, sign = _hash(c[:, None] >> _SHIFT[None, :], _SEED[None, :])
        sketch += np.bincount((bucket + _BASE).ravel(), weights=(sign * w[:, None]).ravel(), minlength=CELLS).astype(np.int64)


def count(sketch: np.ndarray) -> int:
    return int(sketch[: 1 << EXACT].sum())


class Reader:
    """The levels of a sketch with their heavy prefixes subtracted."""

    def __init__(self, sketch: np.ndarray) -> None:
        self.plain = sketch[: 1 << EXACT]
        self.n = int(self.plain.sum())
        self.rows = sketch[1 << EXACT :].astype(np.float64).reshape(len(LEVELS), DEPTH, WIDTH)
        self.held: list[dict[int, float]] = []
        least, deep = max(1.0, self.n / HEAVY), np.arange(DEPTH)
        nodes = np.flatnonzero(self.plain >= least).astype(np.uint64)
        f2 = 0.0
        for level, rows in enumerate(self.rows):
            nodes = np.concatenate([2 * nodes, 2 * nodes + np.uint64(1)])
            bucket, sign = _hash(nodes[:, None], _SEED[level * DEPTH : (level + 1) * DEPTH])
            held = np.zeros(len(nodes))
            for _ in range(ROUNDS):
                found = np.rint(np.median(rows[deep, bucket] * sign, axis=1))
                found[(held == 0) & (found < least)] = 0
                np.subtract.at(rows, (deep[None, :], bucket), sign * found[:, None])
                held += found
            nodes = nodes[held >= least]
            self.held.append({int(x): h for x, h in zip(nodes, held[held >= least])})
            light = held != 0
            light[held >= least] = False
            if light.any():  # what fell below the bound goes back
                np.add.at(rows, (deep[None, :], bucket[light]), sign[light] * held[light][:, None])
            f2 += float(np.median((rows**2).sum(axis=1)))
        self.error = max(4 * np.sqrt(f2 / (2 * WIDTH)), 1.0) / max(1, self.n)

    def estimate(self, level: int, prefix: int) -> float:
        k = level - EXACT - 1
        bucket, sign = _hash(np.full(DEPTH, prefix, dtype=np.uint64), _SEED[k * DEPTH : (k + 1) * DEPTH])
        return self.held[k].get(prefix, 0.0) + float(np.median(self.rows[k, np.arange(DEPTH), bucket] * sign))

    def percentile(self, p: float) -> float:
        """The value at rank ceil(p * n) (at least 1)."""
        left = max(1.0, np.ceil(p * self.n - 1e-9))
        steps = np.cumsum(self.plain)
        node = int(np.searchsorted(steps, left))
        left -= float(steps[node - 1]) if node else 0.0
        here = float(self.plain[node])
        for level in LEVELS:
            lo = min(max(self.estimate(level, 2 * node), 0.0), here)
            hi = min(max(self.estimate(level, 2 * node + 1), 0.0), here)
            lo = (lo + here - hi) / 2
            if left <= lo + 1e-9 or lo >= here - 1e-9:
                node, here = 2 * node, max(lo, 1.0)
                left = min(left, here)
            else:
                node, here, left = 2 * node + 1, here - lo, left - lo
        return decode(node)


def rank_error(sketch: np.ndarray) -> float:
    """The stated bound of the rank error, as a share of the count."""
    return Reader(sketch).error


def percentile(sketch: np.ndarray, p: float) -> float:
    return Reader(sketch).percentile(p)


# -- partial sketches -------------------------------------------------------------------------------------------------


def _narrow(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(initial=0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def pack(codes: np.ndarray, weights: np.ndarray) -> bytes:
    """Distinct codes with their weights, as a list or as counters, whichever is shorter."""
    w = _narrow(weights.astype(np.int64))
    if len(codes) * (4 + w.itemsize) <= 2 * CELLS:
        return bytes([0, w.itemsize]) + codes.astype("<u4").tobytes() + w.tobytes()
    s = np.zeros(CELLS, dtype=np.int64)
    add(s, codes, weights)
    return pack_counters(s)


def pack_counters(sketch: np.ndarray) -> bytes:
    c = _narrow(sketch)
    return bytes([1, c.itemsize]) + c.tobytes()


def _of_size(size: int) -> np.dtype:
    return np.dtype(f"<i{size}")


class Sum:
    """The sum of partial sketches: a list of codes until that is longer than the counters."""

    LIST = CELLS // 2

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.pending, self.counters = 0, None

    def add(self, blob: bytes) -> None:
        kind, size = blob[0], blob[1]
        if kind:
            self.counters = np.frombuffer(blob, _of_size(size), offset=2).astype(np.int64) + (0 if self.counters is None else self.counters)
            return
        n = (len(blob) - 2) // (4 + size)
        self.codes.append(np.frombuffer(blob, "<u4", n, 2))
        self.weights.append(np.frombuffer(blob, _of_size(size), n, 2 + 4 * n).astype(np.int64))
        self.pending += n
        if self.pending > 4 * self.LIST:
            self._settle()

    def _settle(self, to_counters: bool = False) -> None:
        if self.codes:
            codes, weights = summed(np.concatenate(self.codes), np.concatenate(self.weights))
            self.codes, self.weights, self.pending = [codes], [weights], len(codes)
            if to_counters or len(codes) > self.LIST:
                self.counters = np.zeros(CELLS, dtype=np.int64) if self.counters is None else self.counters
                add(self.counters, codes, weights)
                self.codes, self.weights, self.pending = [], [], 0

    def blob(self) -> bytes:
        self._settle(self.counters is not None)
        if self.counters is not None:
            return pack_counters(self.counters)
        return pack(self.codes[0], self.weights[0]) if self.codes else pack(np.zeros(0, np.uint32), np.zeros(0, np.int64))


def summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sums of their weights; codes whose weights cancel are left out."""
    distinct, back = np.unique(codes, return_inverse=True)
    total = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(total, back, weights.astype(np.int64))
    return distinct[total != 0], total[total != 0]


def counters(blob: bytes) -> np.ndarray:
    """The counters of a partial sketch in any form."""
    s = Sum()
    s.add(blob)
    s._settle(True)
    return np.zeros(CELLS, dtype=np.int64) if s.counters is None else s.counters


def _schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def _runs(frame: pd.DataFrame) -> Iterator[tuple[tuple, slice]]:
    """The runs of equal keys of a frame that is sorted by them."""
    cols = [frame.iloc[:, i].astype(object).where(frame.iloc[:, i].notna(), None) for i in range(frame.shape[1])]
    codes = np.zeros(len(frame), dtype=bool)
    for c in cols:
        f = pd.factorize(c, use_na_sentinel=True)[0]
        codes[1:] |= f[1:] != f[:-1]
    edges = [0, *np.flatnonzero(codes), len(frame)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield tuple(c.iat[a] for c in cols), slice(a, b)


def _groups(frame: pd.DataFrame) -> tuple[np.ndarray, list[tuple]]:
    """The number of each row's key, and the keys (null as None)."""
    code = np.zeros(len(frame), dtype=np.int64)
    for i in range(frame.shape[1]):
        f, values = pd.factorize(frame.iloc[:, i], use_na_sentinel=True)
        code = np.unique(code * (len(values) + 1) + f + 1, return_inverse=True)[1]
    first = np.unique(code, return_index=True)[1]
    heads = [frame.iloc[first, i].astype(object) for i in range(frame.shape[1])]
    return code, list(zip(*[h.where(h.notna(), None) for h in heads])) if heads else [()]


def build(df: DataFrame, keys: list[str], value: str, weight: Column | None = None, salt: int = 16) -> DataFrame:
    """keys, sketch: one sketch per group.

    A task keeps the distinct codes of its split's groups and hands partial sketches on once it holds ROWS of them, so
    that a hot group costs one partial sketch per split and no raw row is shuffled; `salt` as in merge.
    """
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("__v"), (weight if weight is not None else F.lit(1)).cast("long").alias("__w"))
    rows = rows.where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") != float("inf")) & F.col("__w").isNotNull())
    k = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            g, c, w = (np.concatenate(x) for x in zip(*held))
            both, total = summed((g << BITS) | c, w)
            return both >> BITS, both & ((1 << BITS) - 1), total

        def out() -> Iterator[pd.DataFrame]:
            g, c, w = settled()
            names = list(number)
            edge = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else []
            rows = [(*names[g[a]], pack(c[a:b], w[a:b])) for a, b in zip(edge, [*edge[1:], len(g)])]
            for at in range(0, len(rows), 256):
                yield pd.DataFrame(rows[at : at + 256], columns=[*keys, "sketch"])

        for b in batches:
            if not len(b):
                continue
            code, names = _groups(b.iloc[:, :k])
            ids = np.array([number.setdefault(n, len(number)) for n in names], dtype=np.int64)
            held.append((ids[code], encode(b.iloc[:, k].to_numpy()).astype(np.int64), b.iloc[:, k + 1].to_numpy()))
            size += len(b)
            if size > 2 * ROWS:
                held = [settled()]
                size = len(held[0][0])
                if size > ROWS:
                    yield from out()
                    number, held, size = {}, [], 0
        if held:
            yield from out()

    return merge(rows.mapInPandas(run, _schema(df, keys) + ", sketch binary"), keys, salt)


def _added(rows: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """The sums of neighbouring rows of one key. A task holds one sum."""
    k = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for b in batches:
            out = []
            for key, part in _runs(b.iloc[:, :k]):
                if total is None or key != now:
                    if total is not None:
                        out.append((*now, total.blob()))
                    now, total = key, Sum()
                for blob in b.iloc[part, k]:
                    total.add(blob)
            if out:
                yield pd.DataFrame(out, columns=[*keys, "sketch"])
        if total is not None:
            yield pd.DataFrame([(*now, total.blob())], columns=[*keys, "sketch"])

    return rows.mapInPandas(run, schema)


def merge(sketches: DataFrame, keys: list[str], salt: int = 16) -> DataFrame:
    """keys, sketch: the sums of all sketches of a key, as a tree: first in `salt` parts by the partition that a sketch
    comes from, then these. salt should follow the square root of the number of splits."""
    schema = _schema(sketches, keys) + ", sketch binary"
    parts = sketches.select(*keys, "sketch", (F.spark_partition_id() % salt).alias("__salt"))
    parts = parts.repartition(*keys, "__salt").sortWithinPartitions(*keys, "__salt").select(*keys, "sketch")
    return _added(_added(parts, keys, schema).repartition(*keys).sortWithinPartitions(*keys), keys, schema)


def read(sketches: DataFrame, keys: list[str], ps: list[float]) -> DataFrame:
    """keys, p, n, value, rank_error of every sketch and percentile."""
    k = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                r = Reader(counters(row[k]))
                if r.n > 0:
                    out += [(*row[:k], p, r.n, r.percentile(p), r.error) for p in ps]
            yield pd.DataFrame(out, columns=[*keys, "p", "n", "value", "rank_error"])

    return sketches.select(*keys, "sketch").mapInPandas(run, _schema(sketches, keys) + ", p double, n long, value double, rank_error double")


def score_sketches(results: DataFrame, meta: DataFrame) -> DataFrame:
    """metric, part (model or noise type), day, sketch: the smallest pieces from which every percentile is merged."""
    return build(score_rows(results, meta), ["metric", "part", "day"], "v")


def score_rows(results: DataFrame, meta: DataFrame) -> DataFrame:
    """metric, part, day, v of every value."""
    rows = results.select(F.lit("wer").alias("metric"), F.col("model_name").alias("part"), F.to_date("scored_at").alias("day"), F.col("wer").alias("v"))
    for c in ("snr_db", "overlap_ratio_target"):
        rows = rows.unionByName(meta.select(F.lit(c).alias("metric"), F.col("noise_type").alias("part"), F.lit(None).cast("date").alias("day"), F.col(c).alias("v")))
    return rows


KEYS = ["metric", "group_kind", "group_key"]


def _targets(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows once for each group they belong to."""
    day = F.col("day").cast("string")
    targets = F.when(
        F.col("metric") == "wer",
        F.array(F.struct(F.lit("model").alias("k"), F.col("part").alias("g")), F.struct(F.lit("day").alias("k"), day.alias("g"))),
    ).otherwise(F.array(F.struct(F.lit("noise_type").alias("k"), F.col("part").alias("g"))))
    return rows.select("metric", F.explode(targets).alias("t"), *columns).select("metric", F.col("t.k").alias("group_kind"), F.col("t.g").alias("group_key"), *columns)


def score_percentiles(results: DataFrame, meta: DataFrame, ps: list[float]) -> DataFrame:
    """metric, group_kind, group_key, p, n, value, rank_error; the days add up to the groups that span them."""
    return read(merge(_targets(score_sketches(results, meta), "sketch"), KEYS), KEYS, ps)


def within_bound(results: DataFrame, meta: DataFrame, ps: list[float]) -> DataFrame:
    """metric, group_kind, group_key, p, n, within: whether the ranks that the value's cell really has come within
    rank_error of p. Counts every value, so it is a check, not a way to percentiles."""
    got = score_percentiles(results, meta, ps)
    wide = got.groupBy(*KEYS).agg(F.first("n").alias("n"), F.first("rank_error").alias("e"), *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"v{i}") for i, p in enumerate(ps)])
    v = F.col("v")
    rows = _targets(score_rows(results, meta).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), "v")
    on = F.col("a.metric") == F.col("b.metric")
    for k in KEYS[1:]:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    slack = lambda c: F.abs(c) * 2.0**-11
    counts = [F.count_if(F.col("v") < F.col(f"v{i}") - slack(F.col(f"v{i}"))).alias(f"under{i}") for i in range(len(ps))]
    counts += [F.count_if(F.col("v") <= F.col(f"v{i}") + slack(F.col(f"v{i}"))).alias(f"upto{i}") for i in range(len(ps))]
    by = rows.alias("a").join(wide.alias("b"), on).groupBy(*[F.col(f"b.{k}").alias(k) for k in KEYS], "n", "e").agg(F.count(F.lit(1)).alias("real"), *counts)
    ok = lambda i, p: (F.col("n") == F.col("real")) & (F.col(f"under{i}") / F.col("n") <= p + F.col("e")) & (F.col(f"upto{i}") / F.col("n") >= p - F.col("e"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), ok(i, p).alias("within")) for i, p in enumerate(ps)]))
    return by.select(*KEYS, "n", each.alias("x")).select(*KEYS, "x.p", "n", "x.within")
