"""Aggregations: each is one pass with partial aggregation; overall rows come from grouping sets, not from a second scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clip import METRICS
from . import ranking


def describe(value: str) -> list[Column]:
    """n (non-null), mean, sd, min, max and per cent above 1 of a column."""
    c = F.col(value)
    return [
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"),
        F.min(c).alias("min"), F.max(c).alias("max"), (100 * F.avg(F.when(c.isNotNull(), (c > 1).cast("double")))).alias("pct_gt_1"),
    ]


def summarise(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """describe() and the exact median, which is found from counts in order and holds no group in one task."""
    out = df.groupBy(*keys).agg(*describe(value))
    return ranking.with_percentiles(out, df, keys, {"median": (F.col(value), 0.5)})


def grouped_sets(df: DataFrame, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    """Several groupings in one pass; `grouping` names the columns a row is grouped by, null keys stay groups."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.grouping_id().alias("__gid"), *aggs)
    name = F.lit(None).cast("string")
    for s in sets:
        gid = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in s)
        name = F.when(F.col("__gid") == gid, "+".join(s) or "all").otherwise(name)
    return out.withColumn("grouping", name).drop("__gid")


def model_totals(scores: DataFrame) -> DataFrame:
    """Per model: totals, and count, mean, median, sd (0 for one value), min and max of every metric; the plain rate is
    split into results with one segment and with several."""
    ok = F.col("status") == "success"

    def block(value: Column, name: str) -> list[Column]:
        return [
            F.count(value).alias(f"{name}_count"), F.avg(value).alias(f"{name}_mean"),
            F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias(f"{name}_std"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max"),
        ]

    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed")]
    several = F.coalesce("is_segmented", F.lit(False))
    values = {"wer": F.when(ok & ~several, F.col("wer")), "wer_segmented": F.when(ok & several, F.col("wer"))} | {m: F.when(ok, F.col(m)) for m in METRICS[1:]}
    for name, v in values.items():
        aggs += block(v, name)
    return ranking.with_percentiles(scores.groupBy("model").agg(*aggs), scores, ["model"], {f"{n}_median": (v, 0.5) for n, v in values.items()})


def coverage(scores: DataFrame, keys: list[str]) -> DataFrame:
    ok = F.count_if(F.col("status") == "success")
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), ok.alias("successful"), (ok / F.count(F.lit(1))).alias("success_rate"))


def grid(df: DataFrame, row: str, column: str, order: list[str], agg: Column, rows: list[str] | None = None) -> DataFrame:
    """Pivot to fixed columns and, with `rows`, to fixed rows; a cell without rows is null."""
    out = df.groupBy(row).pivot(column, order).agg(agg)
    if rows is None:
        return out
    levels = df.sparkSession.createDataFrame([(r,) for r in rows], f"`{row}` string")
    return levels.join(out, row, "left")


def compare_metrics(df: DataFrame, keys: list[str], a: str = "mrs_wer", b: str = "wer", eps: float = 1e-12) -> DataFrame:
    """Means, medians and tallies of a against b over rows that have both."""
    d = F.col(a) - F.col(b)
    share = lambda c: 100 * F.avg(c.cast("double"))
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("mean_diff"), F.avg(F.abs(d)).alias("mean_abs_diff"),
        share(d > eps).alias("pct_gt"), share(d < -eps).alias("pct_lt"), share(F.abs(d) <= eps).alias("pct_eq"),
    )
    return ranking.with_percentiles(out, rows, keys, {"median_a": (F.col(a), 0.5), "median_b": (F.col(b), 0.5), "median_diff": (d, 0.5)})


def proportions(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """Counts of key in each group and their share of the group."""
    n = df.groupBy(*group, key).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*group)) if group else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return n.withColumn("share", F.col("n") / whole)


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Standard deviation, interquartile range, standard error and half width of the 95 % interval."""
    c = F.col(value)
    out = df.where(c.isNotNull()).groupBy(*keys).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"),
        (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("sem"), (1.96 * F.stddev_samp(c) / F.sqrt(F.count(c))).alias("ci95"),
    )
    out = ranking.with_percentiles(out, df, keys, {"__q1": (c, 0.25), "__q3": (c, 0.75)})
    return out.withColumn("iqr", F.col("__q3") - F.col("__q1")).drop("__q1", "__q3")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys and surplus rows of the whole table, by two aggregations (no distinct count of all keys in one task)."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n_surplus"))


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many groups have how many rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each group, the smallest of equals."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("x")).select(*keys, "x.*")


def transfer(a: DataFrame, b: DataFrame, key: str, value: str, both_sides: bool = True) -> DataFrame:
    """Both sides' mean, median and sd per key, difference, ratio, ranks and shift. Keys of one side are left out or, with
    both_sides False, keep nulls for the other; ranks are over the rows that come out."""

    def one(df: DataFrame, n: str) -> DataFrame:
        rows = df.where(F.col(value).isNotNull())
        out = rows.groupBy(key).agg(F.avg(value).alias(f"{n}_mean"), F.stddev_samp(value).alias(f"{n}_sd"))
        return ranking.with_percentiles(out, rows, [key], {f"{n}_median": (F.col(value), 0.5)})

    both = one(a, "a").join(one(b, "b"), key, "inner" if both_sides else "outer")
    # one row per key: the ranks are over the few summary rows
    rank = lambda c: F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy(F.col(c).isNull()).orderBy(c)))
    both = both.withColumn("a_rank", rank("a_mean")).withColumn("b_rank", rank("b_mean"))
    return both.select("*", (F.col("b_mean") - F.col("a_mean")).alias("delta"), F.try_divide(F.col("b_mean"), F.col("a_mean")).alias("ratio"), (F.col("b_rank") - F.col("a_rank")).alias("rank_shift"))
