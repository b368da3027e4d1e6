"""Repetition inside one document, found as robust outliers of its repetition statistics.

Two steps. First every text gets a vector of cheap statistics that stay in the JVM: the shares of its words, word pairs
and word triples that occurred before, each as the arcsine of the root. Per stratum (source and model, the project's
stand-ins for language and source) centre and scatter of these vectors come from the minimum covariance determinant:
texts are counted in the cells of a grid over the vectors (GRID ** 3 at most, with exact sums in each), the cells of a
stratum go to one task, and there concentration steps from several starts run to their end; the least determinant is
kept, corrected for consistency and reweighted. A text is an outlier beyond the chi-square quantile of its Mahalanobis
distance. Then the exact share of repeated words is counted for outliers only.

No case is lost to the first step. In a text with a share s of repeated words each repeated word has occurred before, and
so have at least 4/5 s of its pairs and 3/5 s of its triples, as windows of five words without overlap hold four pairs and
three triples. So the vector of a case reaches a known bound in each coordinate, and its squared distance is at least the
largest (bound - centre)**2 / variance of a coordinate; the cut of a stratum is that or the quantile, whichever is
smaller. It is below the quantile only where loops are so common that they make up the centre.

Defined results: null texts are empty; texts without words or with fewer than five have share 0; strata of one text
or of equal texts have the scatter's floor; a null model is a stratum of its own; repeated rows each count; payloads that
are no JSON have no texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.nested import payload_of, segment_text, segments_of
from ..session import cut, spread, staged

WINDOW, MIN_WORDS, MIN_SHARE = 5, 20, 0.4
#: 0.975 quantile of chi-square with three degrees of freedom; h / n; floor of a variance; cells on an axis.
CHI2, HALF, FLOOR, GRID = 9.3484, 0.75, 1e-3, 64
#: Starts, of which KEPT go on after two steps; steps at most; strata that are broadcast at most; salt of the join else.
STARTS, KEPT, STEPS, STRATA, SALT = 30, 5, 100, 20_000, 8
_LETTERS = regex.compile(r"\p{L}+")
STATS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("n_words", "n_repeated", "n_distinct", "most")])
U = ("u1", "u2", "u3")
#: The least value of each coordinate at a share of MIN_SHARE.
BOUNDS = [math.asin(math.sqrt(MIN_SHARE * k / 5)) for k in (5, 4, 3)]


def words(text: str | None) -> list[str]:
    """The longest runs of letters, in lower case."""
    return [w.lower() for w in _LETTERS.findall(text)] if text else []


def repetition(tokens: list[str], width: int = WINDOW) -> tuple[int, int, int, int]:
    """Words, repeated words, distinct words and the greatest count of one window. Linear in the text."""
    ids: dict[str, int] = {}
    seq = [ids.setdefault(w, len(ids)) for w in tokens]
    seen: dict[tuple, int] = {}
    repeated = most = covered = 0
    for i in range(len(seq) - width + 1):
        key = tuple(seq[i : i + width])
        n = seen[key] = seen.get(key, 0) + 1
        most = max(most, n)
        if n > 1:
            repeated += i + width - max(i, covered)
            covered = i + width
    return len(seq), repeated, len(ids), most


@F.pandas_udf(STATS)
def text_stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for t in texts:
        yield pd.DataFrame([repetition(words(x)) for x in t], columns=["n_words", "n_repeated", "n_distinct", "most"], dtype="int32")


def transcript_texts(transcription: DataFrame) -> DataFrame:
    """record_id, model, text: each model's segments in order, joined by a blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, payload in zip(b.record_id, b.payload):
                root, _ = payload_of(payload)
                models = root.get("transcript") if isinstance(root, dict) else None
                if isinstance(models, dict):
                    out += [(rid, m, " ".join(segment_text(x) for _, x in segments_of(v))) for m, v in models.items()]
            yield pd.DataFrame(out, columns=["record_id", "model", "text"]).astype({"record_id": "int64"})

    return transcription.select("record_id", "payload").where("record_id is not null and payload is not null").mapInPandas(run, "record_id long, model string, text string")


# -- cheap statistics -------------------------------------------------------------------------------------------------


def seen_before(text: Column) -> Column:
    """struct<n, u1, u2, u3>: words, and the arcsine roots of the shares of words, pairs and triples seen before.

    Words are digested once, and what a lambda uses several times is its variable, as other expressions in a lambda are
    evaluated anew for every element.
    """
    w = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{L}+)"), F.lit(1)), lambda x: F.xxhash64(F.lower(x)))
    follow = lambda a, w, k: F.zip_with(a, F.slice(w, k, F.greatest(F.size(w), F.lit(1))), lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.xxhash64(x, y)))

    def angle(grams: Column, n: Column) -> Column:
        distinct = F.size(F.array_distinct(F.filter(grams, lambda x: x.isNotNull())))
        return F.when(n > 0, F.asin(F.sqrt(F.greatest(F.lit(0.0), 1 - distinct / F.greatest(n, F.lit(1)))))).otherwise(0.0)

    def with_triples(p: Column) -> Column:
        n = F.size(p["w"])
        return F.struct(n.alias("n"), angle(p["w"], n).alias("u1"), angle(p["pairs"], n - 1).alias("u2"), angle(follow(p["pairs"], p["w"], 3), n - 2).alias("u3"))

    def with_pairs(w: Column) -> Column:
        return F.get(F.transform(F.array(F.struct(w.alias("w"), follow(w, w, 2).alias("pairs"))), with_triples), F.lit(0))

    return F.get(F.transform(F.array(w), with_pairs), F.lit(0))


# -- minimum covariance determinant -----------------------------------------------------------------------------------


def chi2_cdf(x: float, k: int) -> float:
    """Of chi-square with an odd number of degrees of freedom."""
    out = math.erf(math.sqrt(x / 2))
    for i in range(1, k, 2):
        out -= (x / 2) ** (i / 2) * math.exp(-x / 2) / math.gamma(i / 2 + 1)
    return out


def consistency(share: float, k: int = 3) -> float:
    """What the scatter of the nearest `share` of normal vectors has to be multiplied by."""
    lo, hi = 0.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < share else (lo, mid)
    return share / chi2_cdf(lo, k + 2)


class Cells:
    """Counts, sums and sums of products of the vectors in each cell."""

    def __init__(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        self.n, self.s, self.q = n.astype(np.float64), s, q
        self.x = s / self.n[:, None]

    def moments(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centre and floored scatter with a weight per cell."""
        total = float(w @ self.n)
        m = (w @ self.s) / total
        c = np.tensordot(w, self.q, 1) / total - np.outer(m, m)
        return m, (c + c.T) / 2 + FLOOR * np.eye(len(m))

    def distance(self, m: np.ndarray, c: np.ndarray) -> np.ndarray:
        y = np.linalg.solve(np.linalg.cholesky(c), (self.x - m).T)
        return (y * y).sum(axis=0)

    def step(self, m: np.ndarray, c: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
        """A concentration step: the moments of the h nearest vectors, of the last cell a part."""
        d = self.distance(m, c)
        order = np.argsort(d, kind="stable")
        room = h - np.append(0, np.cumsum(self.n[order]))[:-1]
        w = np.zeros(len(d))
        w[order] = np.clip(room / self.n[order], 0, 1)
        return self.moments(w)

    def mcd(self) -> tuple[np.ndarray, np.ndarray]:
        """Reweighted centre and scatter of the least determinant found."""
        rng, h = np.random.default_rng(7), max(1.0, math.ceil(HALF * self.n.sum()))
        det = lambda mc: np.linalg.slogdet(mc[1])[1]
        tried = [self.moments(np.ones(len(self.n)))]
        for _ in range(STARTS - 1):
            pick = np.bincount(rng.choice(len(self.n), 4, p=self.n / self.n.sum()), minlength=len(self.n)) / self.n
            tried.append(self.moments(pick))
        for _ in range(2):
            tried = [self.step(*mc, h) for mc in tried]
        best = sorted(tried, key=det)[:KEPT]
        for i, mc in enumerate(best):
            for _ in range(STEPS):
                new = self.step(*mc, h)
                done, mc = det(mc) - det(new) < 1e-12, new
                if done:
                    break
            best[i] = mc
        m, c = min(best, key=det)
        near = self.distance(m, c * consistency(HALF)) <= CHI2
        m, c = self.moments(near.astype(np.float64)) if near.any() else (m, c)
        return m, c * consistency(chi2_cdf(CHI2, 3))


PARAMS = ["m1", "m2", "m3", "l11", "l21", "l22", "l31", "l32", "l33", "cut"]
PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


def strata(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, centre, Cholesky factor and cut of each stratum: vectors are counted into cells before the shuffle, and one
    task gets a stratum's cells, GRID ** 3 at most."""
    bins = [F.least(F.floor(F.col(u) * (GRID / (math.pi / 2))), F.lit(GRID - 1)).cast("int").alias(f"b{u}") for u in U]
    sums = [F.sum(u).alias(f"s{u}") for u in U] + [F.sum(F.col(U[i]) * F.col(U[j])).alias(f"q{i}{j}") for i, j in PAIRS]
    cells = vectors.groupBy(*keys, *bins).agg(F.count(F.lit(1)).alias("n"), *sums)
    schema = vectors.select(*keys).schema
    for p in PARAMS:
        schema = schema.add(p, "double")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        q = np.zeros((len(part), 3, 3))
        for i, j in PAIRS:
            q[:, i, j] = q[:, j, i] = part[f"q{i}{j}"].to_numpy()
        m, c = Cells(part["n"].to_numpy(), part[[f"s{u}" for u in U]].to_numpy(), q).mcd()
        least = max(((b - m[i]) ** 2 / c[i, i] if m[i] < b else 0.0) for i, b in enumerate(BOUNDS))
        low = np.linalg.cholesky(c)
        row = [*(part[k].iloc[0] for k in keys), *m, low[0, 0], low[1, 0], low[1, 1], low[2, 0], low[2, 1], low[2, 2], min(CHI2, least * (1 - 1e-6))]
        return pd.DataFrame([row], columns=schema.names)

    return cells.groupBy(*keys).applyInPandas(run, schema)


def with_distance(df: DataFrame, params: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """df with d2 and cut of its stratum. Up to STRATA strata are broadcast, more are joined with a salt."""
    params = cut(params)
    if params.count() <= STRATA:
        a, b = df.withColumn("__salt", F.lit(0)), F.broadcast(params.withColumn("__salt", F.lit(0)))
    else:
        a = df.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(SALT)).cast("int"))
        b = params.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    on = F.col("a.__salt") == F.col("b.__salt")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    p = {c: F.col(f"b.{c}") for c in PARAMS}
    y1 = (F.col("a.u1") - p["m1"]) / p["l11"]
    y2 = (F.col("a.u2") - p["m2"] - p["l21"] * y1) / p["l22"]
    y3 = (F.col("a.u3") - p["m3"] - p["l31"] * y1 - p["l32"] * y2) / p["l33"]
    return a.alias("a").join(b.alias("b"), on).select(*[F.col(f"a.{c}") for c in df.columns], (y1 * y1 + y2 * y2 + y3 * y3).alias("d2"), p["cut"])


# -- the project's texts ----------------------------------------------------------------------------------------------

KEYS = ["text_source", "model"]


def _texts(worst: DataFrame, transcription: DataFrame) -> DataFrame:
    """text_source, row_id, model, text of all hypotheses and transcripts."""
    hyp = worst.select(F.lit("hypothesis").alias("text_source"), F.col("example_id").alias("row_id"), "model", F.col("hypothesis").alias("text"))
    tra = transcript_texts(transcription).select(F.lit("transcript").alias("text_source"), F.col("record_id").alias("row_id"), "model", "text")
    return hyp.unionByName(tra)


def measured(texts: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The texts of at least MIN_WORDS words with u1, u2, u3, d2 and cut. Written once: the statistics are read for the
    strata, the texts for what is beyond the cut."""
    s = spread(texts, id_col).withColumn("s", seen_before(F.col("text"))).select(*texts.columns, "s.*").where(F.col("n") >= MIN_WORDS)
    s = staged(s.where(F.col(id_col).isNotNull()))
    return with_distance(s, strata(s, keys), keys, id_col)


def outliers(worst: DataFrame, transcription: DataFrame) -> DataFrame:
    """text_source, row_id, model, d2 of the texts whose distance is beyond the chi-square quantile."""
    return measured(_texts(worst, transcription), KEYS, "row_id").where(F.col("d2") > CHI2).select("text_source", "row_id", "model", "d2")


def shares(worst: DataFrame, transcription: DataFrame) -> DataFrame:
    """text_source, row_id, model, n_words, n_repeated, share of every text, whatever its length."""
    t = spread(_texts(worst, transcription), "row_id").withColumn("s", text_stats("text")).select("text_source", "row_id", "model", "s.n_words", "s.n_repeated")
    return t.withColumn("share", F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(0.0))


def looping_texts(worst: DataFrame, transcription: DataFrame) -> DataFrame:
    """text_source, row_id, model of texts of at least 20 words of which at least two fifths are repeated."""
    far = measured(_texts(worst, transcription), KEYS, "row_id").where("d2 >= cut")
    # the argument refers to the distance, else the count would be moved before the join with the strata
    found = far.withColumn("s", text_stats(F.when(F.col("d2") >= F.col("cut"), F.col("text")))).where((F.col("s.n_words") >= MIN_WORDS) & (F.col("s.n_repeated") * 5 >= F.col("s.n_words") * 2))
    return found.select("text_source", "row_id", "model")
