"""Paired tests, resampling, outliers, effects and least squares.

Everything that touches rows is an aggregation or a window by clip; only tables of one row per model, pair or factor
level come to one task. P-values are evaluated in SQL from closed forms.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import ranking
from .ranking import average_rank


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of chi-square: a finite sum for even df, for odd df with the complementary error function."""
    half = x / 2
    if df % 2 == 0:
        out, term = F.lit(1.0), F.lit(1.0)
        for i in range(1, df // 2):
            term = term * half / i
            out = out + term
        return F.exp(-half) * out
    out = erfc(F.sqrt(half))
    term = F.sqrt(half) * 2 / math.sqrt(math.pi)
    total = F.lit(0.0)
    for i in range(1, (df + 1) // 2):
        total = total + term
        term = term * half / (i + 0.5)
    return out + F.exp(-half) * total


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0 by a continued fraction beyond 2 and the series below. Both are folded over
    a sequence, as written out they would be too long for generated code."""

    def value(z: Column) -> Column:
        cf = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda acc, k: (k / 2) / (z + acc))
        far = F.exp(-z * z) / math.sqrt(math.pi) / (z + cf)
        start = F.struct(z.alias("term"), z.alias("total"))

        def add(acc: Column, n: Column) -> Column:
            term = -acc["term"] * z * z / n
            return F.struct(term.alias("term"), (acc["total"] + term / (2 * n + 1)).alias("total"))

        series = F.aggregate(F.sequence(F.lit(1), F.lit(39)), start, add)["total"]
        return F.when(z > 2, far).otherwise(1 - 2 / math.sqrt(math.pi) * series)

    return F.get(F.transform(F.array(z), value), F.lit(0))


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2))


def friedman(pairs: DataFrame, block: str, treatments: list[str]) -> DataFrame:
    """n, k, chi2 (corrected for ties), p, kendall_w of complete blocks; one row, null statistics for fewer than two blocks."""
    k = len(treatments)
    long = pairs.dropna(subset=treatments).unpivot([block], treatments, "treatment", "v")
    r = long.withColumn("r", average_rank([block], "v"))
    ties = long.groupBy(block, "v").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    sums = r.groupBy("treatment").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))
    one = sums.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n")).withColumn("ties", ties.scalar())
    n = F.col("n")
    chi = (12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)) / (1 - F.col("ties") / (n * k * (k * k - 1)))
    one = one.withColumn("chi2", F.when(n >= 2, chi))
    return one.select(F.coalesce(n, F.lit(0)).alias("n"), F.lit(k).alias("k"), "chi2", chi2_sf(F.col("chi2"), k - 1).alias("p"), (F.col("chi2") / (n * (k - 1))).alias("kendall_w"))


def wilcoxon_pairs(pairs: DataFrame, block: str, treatments: list[str]) -> DataFrame:
    """Signed-rank test of every pair of columns: model_a, model_b, n, n_non_zero, statistic, p, mean_a, mean_b, mean_diff,
    median_diff, lower_mean.

    Zero differences are dropped, ties averaged. Up to SMALL differences without ties or zeros have their exact tail, all
    others the normal one with the tie correction; all differences zero give statistic 0 and p 1. Ranks come from counts
    of the distinct absolute differences, so no task holds the rows of a pair.
    """
    value = lambda a, b: F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(a).alias("a"), F.col(b).alias("b"), (F.col(a) - F.col(b)).alias("d"))
    long = pairs.dropna(subset=treatments).select(F.explode(F.array(*[value(a, b) for a, b in combinations(treatments, 2)])).alias("x")).select("x.*")
    keys = ["model_a", "model_b"]
    base = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("mean_diff"))
    base = ranking.with_percentiles(base, long, keys, {"median_diff": (F.col("d"), 0.5)})
    moved = long.where("d <> 0").select(*keys, F.abs("d").alias("a"), (F.col("d") > 0).alias("up"))
    ups = moved.groupBy(*keys, "a").agg(F.count_if("up").alias("up"))
    c = ranking.running_counts(moved, keys, "a").join(ups, [*keys, "a"])
    r = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    s = c.groupBy(*keys).agg(F.sum("n").alias("m"), F.sum(r * F.col("up")).alias("plus"), F.sum(r * (F.col("n") - F.col("up"))).alias("minus"), F.sum(F.col("n") ** 3 - F.col("n")).alias("ties"))
    out = base.join(s, keys, "left")
    m, stat = F.col("m"), F.least("plus", "minus")
    z = (stat - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    out = out.withColumn("statistic", stat).withColumn("z", z)
    small = (m <= SMALL) & (m == F.col("n")) & (F.col("ties") == 0)
    p = F.when(small, signed_rank_tail(F.when(small, m), F.when(small, F.col("statistic")))).otherwise(normal_two_sided(F.col("z")))
    lower = F.when(F.col("mean_diff") < 0, F.col("model_a")).when(F.col("mean_diff") > 0, F.col("model_b"))
    return out.select(
        *keys, "n", F.coalesce(m, F.lit(0)).alias("n_non_zero"), F.coalesce("statistic", F.lit(0.0)).alias("statistic"), F.coalesce(p, F.lit(1.0)).alias("p"),
        "mean_a", "mean_b", "mean_diff", "median_diff", lower.alias("lower_mean"),
    )


#: Differences up to which the signed-rank test is exact.
SMALL = 50


def signed_rank_ways(n: int) -> np.ndarray:
    """How many sign patterns of n ranks give each rank sum."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r].copy()
    return ways


@F.pandas_udf(DoubleType())
def signed_rank_tail(n: pd.Series, statistic: pd.Series) -> pd.Series:
    """Exact two-sided p of the smaller rank sum of n differences."""
    return pd.Series([None if pd.isna(k) else min(1.0, 2 * signed_rank_ways(int(k))[: int(s) + 1].sum() / 2.0 ** int(k)) for k, s in zip(n, statistic)], dtype="float64")


def wilcoxon_exact(d: list[float]) -> tuple[float, float]:
    """Statistic and exact two-sided p of a small sample without ties."""
    order = sorted((v for v in d if v), key=abs)
    if not order:
        return 0.0, 1.0
    n = len(order)
    plus = sum(i for i, v in enumerate(order, 1) if v > 0)
    low = min(plus, n * (n + 1) // 2 - plus)
    return float(low), float(min(1.0, 2 * signed_rank_ways(n)[: low + 1].sum() / 2**n))


#: Draws of the published analysis; rows in one numpy block; groups a task keeps before it hands its sums on.
DRAWS, BLOCK, GROUPS = 10_000, 64, 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: +1 or -1 of each of eight rows for every byte of sign bits.
_SIGNS = (np.arange(256) >> np.arange(8)[:, None] & 1) * 2.0 - 1


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _stream(seeds: np.ndarray, n: int) -> np.ndarray:
    """n 64-bit numbers for each seed (splitmix64), the same wherever the row is."""
    return _mix(seeds[:, None] + np.arange(1, n + 1, dtype=np.uint64) * _STEP)


def flip_block(seeds: np.ndarray, values: np.ndarray, draws: int) -> np.ndarray:
    """Sum of the values under random signs in each draw; eight rows are looked up at a time."""
    pad = -len(values) % 8
    seeds, values = np.pad(seeds, (0, pad)), np.pad(values, (0, pad))
    h = _stream(seeds, -(-draws // 64)).view(np.uint8)
    x = np.ascontiguousarray(h.reshape(-1, 8, h.shape[1]).transpose(0, 2, 1)).view(np.uint64)[:, :, 0]
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):  # 8 x 8 bits turned over
        t = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ t ^ (t << np.uint64(shift))
    out = np.zeros(draws)
    for s, b in zip(values.reshape(-1, 8) @ _SIGNS, x.view(np.uint8)[:, :draws]):
        out += s[b]
    return out


def _poisson_cuts() -> np.ndarray:
    """Thresholds of Poisson(1) in 64 bits."""
    cuts, step, total = [], math.exp(-1), 0.0
    while total + step < 1 - 2**-53:
        total += step
        cuts.append(int(total * 2**64))
        step /= len(cuts)
    return np.array(cuts, dtype=np.uint64)


_CUTS = _poisson_cuts()
_CUTS16 = (_CUTS >> np.uint64(48)).astype(np.uint16)


def poisson_weights(seeds: np.ndarray, draws: int) -> np.ndarray:
    """Poisson(1) weights of each row in each draw: 16 bits a draw, 48 more where a threshold has the same 16."""
    lanes = _stream(seeds, -(-draws // 4)).view(np.uint16)[:, :draws]
    w, tie, is_ = np.zeros(lanes.shape, np.uint8), np.zeros(lanes.shape, bool), np.empty(lanes.shape, bool)
    for c in np.unique(_CUTS16):
        w += np.greater(lanes, c, out=is_).view(np.uint8)
        tie |= np.equal(lanes, c, out=is_)
    i, j = np.divmod(np.flatnonzero(tie.ravel()), draws)
    more = _mix(_mix(seeds[i] ^ np.uint64(0xD1B54A32D192ED03)) + j.astype(np.uint64) * _STEP)
    w[i, j] = np.searchsorted(_CUTS, (lanes[i, j].astype(np.uint64) << np.uint64(48)) | (more >> np.uint64(16)), "right")
    return w


def poisson_block(seeds: np.ndarray, values: np.ndarray, draws: int) -> np.ndarray:
    """Weighted sum of the values in each draw, then the sum of the weights in each draw."""
    return (np.stack([values, np.ones(len(values))]) @ poisson_weights(seeds, draws).astype(np.float64)).ravel()


def drawn_sums(df: DataFrame, keys: list[str], item: str, value: str, draws: int, block: Callable, salt: str) -> DataFrame:
    """keys, n, total and the block function's sums over the rows of a group in a task; partial rows add up.

    No row is multiplied: a task holds one vector of draws per group. The draws of a row come from a digest of its item,
    so they are the same whatever the partitioning.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    rows = rows.select(*keys, F.unhex(F.substring(F.md5(F.concat_ws("|", F.lit(salt), F.col(item).cast("string"))), 1, 16)).alias("__s"), F.col(value).cast("double").alias("__v"))
    spark = df.sparkSession
    rows = rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "__s")
    schema = rows.select(*keys).schema.add("n", "long").add("total", "double").add("sums", ArrayType(DoubleType()))
    names = [*keys, "n", "total", "sums"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[tuple, list] = {}
        for b in batches:
            for key, g in b.groupby(keys, dropna=False, sort=False):
                got = at.setdefault(tuple(None if pd.isna(k) else k for k in key), [0, 0.0, 0.0])
                seeds, values = np.frombuffer(b"".join(map(bytes, g["__s"])), ">u8").astype(np.uint64), g["__v"].to_numpy()
                got[0] += len(values)
                got[1] += float(values.sum())
                for i in range(0, len(values), BLOCK):
                    got[2] = got[2] + block(seeds[i : i + BLOCK], values[i : i + BLOCK], draws)
            if len(at) > GROUPS:
                yield pd.DataFrame([(*k, *v) for k, v in at.items()], columns=names)
                at = {}
        yield pd.DataFrame([(*k, *v) for k, v in at.items()], columns=names)

    return rows.mapInPandas(run, schema)


def _reduced(sums: DataFrame, keys: list[str], columns: str, result: Callable) -> DataFrame:
    """keys and result(n, total, sums) of each group of partial rows."""
    schema = sums.select(*keys).schema
    for c in columns.split(", "):
        schema = schema.add(*c.split(" "))
    names = schema.names

    def run(part: pd.DataFrame) -> pd.DataFrame:
        got = result(int(part["n"].sum()), float(part["total"].sum()), np.sum(np.stack(list(part["sums"])), axis=0))
        return pd.DataFrame([(*(part[k].iloc[0] for k in keys), *got)], columns=names)

    return sums.groupBy(*keys).applyInPandas(run, schema)


def flip_sums(df: DataFrame, keys: list[str], item: str, diff: str, permutations: int = DRAWS, salt: str = "flip") -> DataFrame:
    return drawn_sums(df, keys, item, diff, permutations, flip_block, salt)


def flip_test(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, permutations, observed, p_two, p_less, p_greater from flip_sums."""

    def result(n: int, total: float, x: np.ndarray) -> tuple:
        m, seen, eps = x / n, total / n, 1e-12
        p = lambda c: (1 + int(c.sum())) / (len(m) + 1)
        return n, len(m), seen, p(np.abs(m) >= abs(seen) - eps), p(m <= seen + eps), p(m >= seen - eps)

    return _reduced(sums, keys, "n long, permutations long, observed double, p_two double, p_less double, p_greater double", result)


def bootstrap_sums(df: DataFrame, keys: list[str], item: str, value: str, draws: int = DRAWS, salt: str = "boot") -> DataFrame:
    return drawn_sums(df, keys, item, value, draws, poisson_block, salt)


def bootstrap_interval(sums: DataFrame, keys: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """keys, draws, ci_low, ci_high from bootstrap_sums; draws without a row are left out of the interval."""

    def result(n: int, total: float, x: np.ndarray) -> tuple:
        v, w = x.reshape(2, -1)
        m = v[w > 0] / w[w > 0]
        return (len(m), *(np.percentile(m, [100 * low, 100 * high]).tolist() if len(m) else (None, None)))

    return _reduced(sums, keys, "draws long, ci_low double, ci_high double", result)


def bootstrap(df: DataFrame, keys: list[str], item: str, value: str, draws: int = DRAWS, low: float = 0.025, high: float = 0.975, salt: str = "boot") -> DataFrame:
    """Percentile interval of the mean by a Poisson bootstrap: a row's weight in a draw is read off a digest of both."""
    return bootstrap_interval(bootstrap_sums(df, keys, item, value, draws, salt), keys, low, high)


def permutation_exact_order(diffs: np.ndarray, permutations: int, seed: int, alternative: str = "two-sided", chunk: int = 500) -> float:
    """The seeded permutation test over rows in a fixed order, for single groups that fit one task."""
    d = np.asarray(diffs, dtype=np.float64)
    d = d[np.isfinite(d)]
    if alternative not in ("two-sided", "less", "greater"):
        raise ValueError(alternative)
    if not len(d):
        return float("nan")
    rng, seen, extreme = np.random.default_rng(seed), d.mean(), 0
    for at in range(0, permutations, chunk):
        m = (rng.choice([-1.0, 1.0], size=(min(chunk, permutations - at), len(d))) * d).mean(axis=1)
        extreme += int({"less": m <= seen, "greater": m >= seen, "two-sided": np.abs(m) >= abs(seen)}[alternative].sum())
    return (1 + extreme) / (permutations + 1)


def iqr_outliers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of df with q1, q3, fence and is_outlier (above the upper fence)."""
    q = ranking.exact_percentiles(df, keys, value, [0.25, 0.75]).select(*keys, F.col("q0").alias("q1"), F.col("q1").alias("q3"))
    q = q.withColumn("fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return df.where(F.col(value).isNotNull()).join(q, keys).withColumn("is_outlier", F.col(value) > F.col("fence"))


def effects(df: DataFrame, value: str, factors: list[str]) -> DataFrame:
    """Sum of squares between the levels of each factor, residual and partial eta squared, from sums per level combination."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*factors).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("q"))
    total = cells.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).select("n", "s", (F.col("q") - F.col("s") ** 2 / F.col("n")).alias("ss_total"))
    out = None
    for f in factors:
        one = cells.groupBy(f).agg((F.sum("s") ** 2 / F.sum("n")).alias("b")).agg(F.sum("b").alias("b")).select(F.lit(f).alias("factor"), "b")
        out = one if out is None else out.unionByName(one)
    one = lambda c: total.select(c).scalar()
    out = out.withColumn("n", one("n")).withColumn("ss_total", one("ss_total")).withColumn("ss", F.col("b") - one(F.col("s") ** 2 / F.col("n")))
    rest = out.agg(F.max("ss_total") - F.sum("ss"))
    return out.withColumn("ss_residual", rest.scalar()).select("factor", "n", "ss", "ss_total", "ss_residual", (F.col("ss") / (F.col("ss") + F.col("ss_residual"))).alias("partial_eta2"))


def least_squares(df: DataFrame, x: dict[str, Column], y: str) -> tuple[list[str], np.ndarray, dict[str, float]]:
    """Names, coefficients and fit of y on the columns x with an intercept: sums in one aggregation, a small solve here."""
    names = ["intercept", *x]
    row = df.select(F.lit(1.0).alias("intercept"), *[c.cast("double").alias(n) for n, c in x.items()], F.col(y).cast("double").alias("__y")).dropna()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    aggs = [F.sum(F.col(a) * F.col(b)) for a, b in pairs] + [F.sum(F.col(a) * F.col("__y")) for a in names] + [F.sum(F.col("__y") ** 2), F.sum("__y"), F.count("__y")]
    got = [float(v or 0) for v in row.agg(*[a.alias(f"c{i}") for i, a in enumerate(aggs)]).first()]
    k = len(names)
    m = np.zeros((k, k))
    for v, (a, b) in zip(got, pairs):
        m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = v
    xy = np.array(got[len(pairs) : len(pairs) + k])
    yy, sy, n = got[-3:]
    beta = np.linalg.lstsq(m, xy, rcond=None)[0] if n else np.full(k, np.nan)
    rss, tss = yy - 2 * beta @ xy + beta @ m @ beta, yy - sy * sy / n if n else 0.0
    return names, beta, {"n": n, "r2": 1 - rss / tss if tss else float("nan"), "rmse": math.sqrt(max(0.0, rss) / n) if n else float("nan")}


def surface(df: DataFrame, ovr: str, z: Column, y: str, condition: list[str] | None = None) -> DataFrame:
    """term, estimate and the fit of y ~ 1 + ovr + z + ovr * z: n, r2, mae, rmse over the rows, and the same with the
    prefix condition_ of the same coefficients over the means per ovr, z and the condition columns (none of them null)."""
    condition = condition or []
    rows = df.select(*condition, F.col(ovr).cast("double").alias("ovr"), z.cast("double").alias("z"), F.col(y).cast("double").alias("y")).dropna(subset=["ovr", "z", "y"])
    names, beta, fit = least_squares(rows, {"ovr": F.col("ovr"), "z": F.col("z"), "ovr_z": F.col("ovr") * F.col("z")}, "y")
    e = F.col("y") - sum((F.lit(float(b)) * c for b, c in zip(beta[1:], (F.col("ovr"), F.col("z"), F.col("ovr") * F.col("z")))), F.lit(float(beta[0])))
    means = rows.dropna(subset=["ovr", "z", *condition]).groupBy("ovr", "z", *condition).agg(F.avg("y").alias("y"))
    mae = rows.agg(F.avg(F.abs(e))).first()[0]
    m = means.agg(F.count("y").alias("n"), (1 - F.try_divide(F.avg(e * e), F.var_pop("y"))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")).first()
    real = lambda v: float("nan") if v is None else float(v)
    fits = (int(fit["n"]), real(fit["r2"]), real(mae), real(fit["rmse"]), int(m.n), real(m.r2), real(m.mae), real(m.rmse))
    one = "{0}n long, {0}r2 double, {0}mae double, {0}rmse double"
    return df.sparkSession.createDataFrame([(n, float(b), *fits) for n, b in zip(names, beta)], f"term string, estimate double, {one.format('')}, {one.format('condition_')}")


def baseline_delta(df: DataFrame, keys: list[str], level: str, base: str | None, value: str) -> DataFrame:
    """Mean per keys and level, and its difference to the level `base` of the same keys (null level if base is None)."""
    m = df.where(F.col(value).isNotNull()).groupBy(*keys, level).agg(F.avg(value).alias("mean"))
    is_base = F.col(level).isNull() if base is None else F.col(level) == base
    return m.withColumn("delta", F.col("mean") - F.max(F.when(is_base, F.col("mean"))).over(Window.partitionBy(*keys)))
