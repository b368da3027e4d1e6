"""Ranks, top lists, empirical curves and corrections that need an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def top_overall(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of an order: a bounded heap per task, then one merge."""
    return df.orderBy(*order).limit(n)


def same_keys(a: str, b: str, keys: list[str]) -> Column:
    """Whether the keys of two aliased sides are equal, nulls included."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def running_counts(df: DataFrame, keys: list[str], value: str, buckets: int = 64) -> DataFrame:
    """keys, value, n, upto, total: per distinct value its count, the count of values up to it and of all.

    Equal values are counted before anything is ordered. A group's distinct values are split at approximate quantiles
    into `buckets` parts, each of which one task adds up; what lies in the parts before comes from one row per part. The
    split only spreads the work, the counts are exact.
    """
    # written once, as three steps read it
    c = cut(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    at = [i / buckets for i in range(1, buckets)]
    split = c.groupBy(*keys).agg(F.percentile_approx(value, at, 2000).alias("__q"))
    c = c.alias("a").join(split.alias("b"), same_keys("a", "b", keys)).select("a.*", F.size(F.filter("b.__q", lambda x: x < F.col(f"a.{value}"))).alias("__b"))
    part = c.groupBy(*keys, "__b").agg(F.sum("n").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*keys)).alias("total"))
    c = c.alias("a").join(part.alias("b"), same_keys("a", "b", [*keys, "__b"])).select("a.*", "b.__before", "b.total")
    up = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return c.select(*keys, value, "n", (F.col("__before") + F.sum("n").over(up)).alias("upto"), "total")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    """keys, q0, q1, ..: exact percentiles with linear interpolation, without a group's values in one task."""
    c = running_counts(df, keys, value)
    aggs = [F.max("total").alias("__t")]
    for i, p in enumerate(ps):
        at = (F.col("total") - 1) * F.lit(float(p))
        for name, k in (("l", F.floor(at)), ("h", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("upto") - F.col("n") <= k) & (k < F.col("upto")), F.col(value))).alias(f"__{name}{i}"))
    g = c.groupBy(*keys).agg(*aggs)
    part = lambda p: (F.col("__t") - 1) * F.lit(float(p)) - F.floor((F.col("__t") - 1) * F.lit(float(p)))
    return g.select(*keys, *[(F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * part(p)).alias(f"q{i}") for i, p in enumerate(ps)])


def with_percentiles(out: DataFrame, rows: DataFrame, keys: list[str], wants: dict[str, tuple[Column, float]]) -> DataFrame:
    """out (one row per keys) with a percentile of a column of rows under each name of wants."""
    columns: dict[str, Column] = {str(c): c for c, _ in wants.values()}
    ps = sorted({p for _, p in wants.values()})
    pairs = F.array(*[F.struct(F.lit(i).alias("__m"), c.cast("double").alias("__v")) for i, c in enumerate(columns.values())])
    long = rows.select(*keys, F.explode(pairs).alias("__x")).select(*keys, "__x.*")
    q = exact_percentiles(long, [*keys, "__m"], "__v", ps)
    pick = lambda c, p: F.max(F.when(F.col("__m") == list(columns).index(str(c)), F.col(f"q{ps.index(p)}")))
    wide = q.groupBy(*keys).agg(*[pick(c, p).alias(n) for n, (c, p) in wants.items()])
    return out.alias("a").join(wide.alias("b"), same_keys("a", "b", keys), "left").select("a.*", *[F.col(f"b.{n}") for n in wants])


def value_curve(df: DataFrame, keys: list[str], value: str, overall: str | None = None) -> DataFrame:
    """The empirical distribution: per distinct value its count and the share of values up to it; with `overall` also
    the curve of all rows, under that key."""
    if overall is not None:
        df = df.select(F.explode(F.array(F.col(keys[0]), F.lit(overall))).alias(keys[0]), *[F.lit(overall).alias(k) for k in keys[1:]], value)
    return running_counts(df, keys, value).select(*keys, value, "n", (F.col("upto") / F.col("total")).alias("ecdf"))


def exceedance(df: DataFrame, keys: list[str], value: str, low: float = 0.0, high: float = 1.0, steps: int = 51, overall: str | None = None) -> DataFrame:
    """Share of values above each of `steps` thresholds; with `overall` also of all rows, under that key.

    A value falls in one bin; the share above a threshold is a running sum over at most `steps` bins, so nothing is
    multiplied by the thresholds.
    """
    width = (high - low) / (steps - 1)
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    at = F.least(F.greatest(F.ceil((F.col("__v") - low) / width), F.lit(0)), F.lit(steps)).cast("int")
    # step k counts as exceeded by bin b if b > k; the bin is moved where rounding put a value on the wrong side
    edge = lambda k: F.lit(low) + k * F.lit(width)
    at = F.when((at > 0) & (F.col("__v") <= edge(at - 1)), at - 1).when((at < steps) & (F.col("__v") > edge(at)), at + 1).otherwise(at)
    bins = v.withColumn("__bin", at).groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    if overall is not None:
        bins = bins.select(F.explode(F.array(F.col(keys[0]), F.lit(overall))).alias(keys[0]), *[F.lit(overall).alias(k) for k in keys[1:]], "__bin", "__n")
        bins = bins.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__n"))
    grid = bins.groupBy(*keys).agg(F.sum("__n").alias("total"), F.collect_list(F.struct(F.col("__bin").alias("bin"), F.col("__n").alias("n"))).alias("__m"))
    above = F.aggregate("__m", F.lit(0).cast("long"), lambda acc, e: acc + F.when(e["bin"] > F.col("__k"), e["n"]).otherwise(0))
    grid = grid.select(*keys, "total", "__m", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("__k"))
    return grid.select(*keys, edge(F.col("__k")).alias("threshold"), "total", (above / F.col("total")).alias("share"))


def holm(df: DataFrame, p: str, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values within each family; null p stay null and do not count."""
    has = F.col(p).isNotNull()
    w = Window.partitionBy(*keys, has).orderBy(p)
    m = F.count(p).over(Window.partitionBy(*keys))
    rows = df.withColumn("__r", F.row_number().over(w)).withColumn("__m", m)
    rows = rows.withColumn("__a", F.least(F.lit(1.0), (F.col("__m") - F.col("__r") + 1) * F.col(p)))
    adj = F.when(has, F.max("__a").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("p_holm", adj).withColumn("reject", F.col("p_holm") <= alpha).drop("__r", "__m", "__a")


def average_rank(keys: list[str], value: str) -> Column:
    """The mean rank of ties."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def hashed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the order of a seeded digest of their key: the same rows on every run and cluster size."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), F.col(key)).limit(n)
