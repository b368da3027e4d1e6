"""Every registered query with SQL against DuckDB on the smallest tables; statistics on stated cases."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxtally.operators import frames, ranking, segment, stats, summary
from voxtally.plans import registry, reports


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(base):
    c = duckdb.connect()
    for f in os.listdir(base):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{base}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, base, duck, name):
    got, want = registry.QUERIES[name](spark, base).toPandas(), duck.execute(registry.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert a == b, [x for x in a if x not in b][:3]


def test_every_query_without_sql_gives_rows(spark, base):
    for name in set(registry.QUERIES) - set(registry.SQL):
        assert registry.QUERIES[name](spark, base).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_holm(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double").withColumn("k", F.lit("a"))
    assert {r.i: None if r.p_holm is None else round(r.p_holm, 9) for r in ranking.holm(df, "p", ["k"]).collect()} == {1: 0.03, 2: 0.06, 3: 0.06, 4: None}


def test_friedman_and_tails(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0), (2, 2.0, 2.0, 3.0, 5.0), (3, 1.0, 3.0, 2.0, 4.0), (4, None, 1.0, 1.0, 1.0)], "b int, w double, x double, y double, z double")
    r = stats.friedman(df, "b", ["w", "x", "y", "z"]).first()
    assert r.n == 3 and r.chi2 == pytest.approx(7.758621, abs=1e-6) and r.kendall_w == pytest.approx(0.862069, abs=1e-6)
    one = spark.range(1)
    p = lambda x, df: one.select(stats.chi2_sf(F.lit(float(x)), df)).first()[0]
    assert p(1068.270, 3) == pytest.approx(2.784e-231, rel=1e-2) and p(7.815, 3) == pytest.approx(0.05, abs=1e-4) and p(9.488, 4) == pytest.approx(0.05, abs=1e-4) and p(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    for z in (0.0, 0.3, 1.0, 1.9, 2.1, 3.5, 8.0):
        assert one.select(stats.erfc(F.lit(z))).first()[0] == pytest.approx(math.erfc(z), rel=1e-9)


def test_wilcoxon(spark):
    d = [1.5, -0.5, 2, 0, -1, 0.5]
    df = spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate(d)], "b int, x double, y double")
    r = stats.wilcoxon_pairs(df, "b", ["x", "y"]).first()
    assert (r.statistic, r.n, r.n_non_zero) == (4.5, 6, 5) and 0 < r.p < 1
    same = stats.wilcoxon_pairs(df.withColumn("y", F.col("x")), "b", ["x", "y"]).first()
    assert (same.statistic, same.p, same.n_non_zero) == (0.0, 1.0, 0)
    few = stats.wilcoxon_pairs(df.where("b in (0, 2, 4)").withColumn("x", F.col("x") + F.col("b") / 100), "b", ["x", "y"]).first()
    assert few.p == stats.wilcoxon_exact([1.5, 2.02, -0.96])[1] and few.lower_mean == "y" and few.mean_a == pytest.approx(2.56 / 3)
    assert stats.wilcoxon_exact([1, 2, 3, 4, 5]) == (0.0, 0.0625) and stats.wilcoxon_exact([0, 0]) == (0.0, 1.0)


def test_percentiles_without_a_group_in_one_task(spark):
    g = np.random.default_rng(8)
    data = {"a": np.round(g.normal(size=700), 1), None: g.random(311), "one": np.array([4.0]), "same": np.full(90, 2.5)}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [("a", None), ("none", None)], "k string, v double").repartition(5)
    for buckets in (2, 64):
        c = ranking.running_counts(df, ["k"], "v", buckets).collect()
        for k, x in data.items():
            got = {r.v: (r.n, r.upto, r.total) for r in c if r.k == k}
            assert got == {v: ((x == v).sum(), (x <= v).sum(), len(x)) for v in np.unique(x)}
    got = {r.k: (r.q0, r.q1, r.q2) for r in ranking.exact_percentiles(df, ["k"], "v", [0.25, 0.5, 0.9]).collect()}
    assert got.keys() == data.keys() and all(got[k] == pytest.approx(tuple(np.percentile(x, [25, 50, 90]))) for k, x in data.items())
    assert ranking.exact_percentiles(df.limit(0), ["k"], "v", [0.5]).count() == 0
    s = {r.k: r for r in summary.summarise(df, ["k"], "v").collect()}
    assert s["none"].median is None and s["none"].n == 0 and s["one"].median == 4.0


def test_windows_in_a_wanted_number(spark):
    df = spark.createDataFrame([("s", 0.0, 10.0), ("s", 10.0, 20.0)], "session string, a double, b double")
    assert segment.greedy_windows(df, "session", "a", "b", 5.0, n_clips=1).count() == 1
    with pytest.raises(Exception, match="only 2 clips"):
        segment.greedy_windows(df, "session", "a", "b", 5.0, n_clips=3).count()


def test_outlier_fence(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, 0.2, 0.2, 0.3, 0.9, None)], "v double").withColumn("k", F.lit(1))
    rows = stats.iqr_outliers(df, ["k"], "v").collect()
    assert rows[0].fence == pytest.approx(0.45) and [r.v for r in rows if r.is_outlier] == [0.9]


def test_resampling(spark):
    g = np.random.default_rng(1)
    rows = [("up", i, float(x)) for i, x in enumerate(g.normal(1, 1, 60))] + [("none", i, float(x)) for i, x in enumerate(g.normal(0, 1, 60))] + [("none", 999, None), ("nan", 1, float("nan"))]
    df = spark.createDataFrame(rows, "k string, i int, d double")
    f = {r.k: r for r in stats.flip_test(stats.flip_sums(df, ["k"], "i", "d", 200), ["k"]).collect()}
    assert set(f) == {"up", "none"} and f["up"].p_two < 0.02 and f["none"].p_two > 0.05 and f["up"].p_greater < 0.02 < f["up"].p_less
    b = {r.k: r for r in stats.bootstrap(df, ["k"], "i", "d", 200).collect()}
    assert b["up"].ci_low < f["up"].observed < b["up"].ci_high
    assert stats.permutation_exact_order(np.array([1.0] * 12), 999, 1) < 0.01 and math.isnan(stats.permutation_exact_order(np.array([]), 10, 1))
    with pytest.raises(ValueError):
        stats.permutation_exact_order(np.array([1.0]), 10, 1, "odd")


def test_surface(spark):
    rows = [(o, z, 0.02 + 1.01 * o + 0.28 * z - 0.33 * o * z) for o in (0.0, 0.14, 0.2, 0.4) for z in (0.0, 0.4, 1.0, 1.8)]
    df = spark.createDataFrame(rows, "o double, z double, y double")
    got = {r.term: r for r in stats.surface(df, "o", F.col("z"), "y").collect()}
    assert [round(got[t].estimate, 6) for t in ("intercept", "ovr", "z", "ovr_z")] == [0.02, 1.01, 0.28, -0.33] and got["z"].r2 == pytest.approx(1.0)


def test_exceedance_edges(spark):
    v = [0.0, 0.02, 0.04, 0.0399999999, 0.3, 1.0, 1.5, -1.0, None]
    df = spark.createDataFrame([(x,) for x in v], "v double").withColumn("k", F.lit("a"))
    vals = [x for x in v if x is not None]
    got = ranking.exceedance(df, ["k"], "v").collect()
    assert len(got) == 51
    for r in got:
        assert r.share == pytest.approx(sum(x > r.threshold for x in vals) / len(vals)), r.threshold


def test_crossings_and_windows(spark):
    u = [("s", 0.0, 10.0), ("s", 5.0, 15.0), ("s", 15.0, 20.0), ("s", 20.0, 50.0), ("s", 30.0, 40.0), ("t", 0.0, 1.0), ("t", 3.0, 3.0), (None, 0.0, 9.0)]
    df = spark.createDataFrame(u, "session string, a double, b double")
    got = {(r.session, r.at): r.n_crossing for r in segment.crossings(df, ["session"], "a", "b").collect()}
    ok = [x for x in u if x[2] > x[1]]
    assert got == {(s, e): sum(x[0] == s and x[1] < e < x[2] for x in ok) for s, _, e in ok}
    w = [(r.session, r.clip_no, r.w_start, r.w_end) for r in segment.greedy_windows(df, "session", "a", "b", 12.0).orderBy("session", "clip_no").collect()]
    assert w == [("s", 1, 0.0, 15.0), ("s", 2, 15.0, 50.0)]
    assert segment.greedy_windows(df.limit(0), "session", "a", "b", 1.0).count() == 0


def test_frames_on_empty_and_null(spark, base):
    res = spark.read.parquet(f"{base}/wer_results.parquet")
    assert frames.clip_scores(res.limit(0)).count() == 0
    assert summary.model_totals(frames.clip_scores(res.limit(0))).count() == 0
    assert summary.duplicates(frames.clip_scores(res.limit(0)), ["clip_id"]).first().n_rows == 0


def test_published_number_of_draws(spark, base):
    rows = reports._hypotheses(spark, base, tests=True).collect()
    res = frames.successful(reports.scores(spark, base)).where("mrs_wer is not null and wer is not null and overlap_ratio is not null and model is not null")
    d = res.select("overlap_ratio", "model", (F.col("mrs_wer") - F.col("wer")).alias("d")).toPandas().query("d == d")
    assert rows and min(r.p for r in rows) < 1 / 41  # the least p of 40 permutations
    for r in rows:
        x = d[((d.overlap_ratio.abs() <= 1e-8) == (r.scope == "non_overlap")) & ((d.model == r.model) | (r.model == "all_models"))].d.to_numpy()
        p = stats.permutation_exact_order(x, 10_000, 7, "less" if r.scope == "overlap" else "two-sided")
        assert abs(r.p - p) <= 6 * math.sqrt(2 * max(p, 1e-3) / 10_000)
        g = np.random.default_rng(3)
        m = np.concatenate([x[g.integers(0, len(x), (500, len(x)))].mean(axis=1) for _ in range(20)])
        sd = m.std()
        assert np.abs(np.percentile(m, [2.5, 97.5]) - [r.ci_low, r.ci_high]).max() < 0.2 * sd + 1e-9
    assert min(r.draws for r in reports.bootstrap_ci(spark, base).collect()) > 9_990  # a group of n rows has none of them in a share exp(-n) of draws
    assert {r.permutations for r in reports.sign_flip(spark, base).collect()} == {10_000}


def test_draws_do_not_depend_on_the_partitioning(spark):
    g = np.random.default_rng(5)
    w = stats.poisson_weights(g.integers(0, 2**63, 400).astype(np.uint64), 5_000)
    share = np.bincount(w.ravel(), minlength=8)[:7] / w.size
    assert np.abs(share - [math.exp(-1) / math.factorial(k) for k in range(7)]).max() < 2e-3
    rows = [(k, i, float(x)) for i, x in enumerate(g.normal(0.1, 1, 90)) for k in ("a", None)]
    df = spark.createDataFrame(rows, "k string, i int, d double")
    one, many = ([tuple(r) for r in stats.flip_test(stats.flip_sums(x, ["k"], "i", "d", 1_000), ["k"]).orderBy("k").collect()] for x in (df.coalesce(1), df.repartition(7)))
    assert len(one) == 2 and one[0][1:3] == (90, 1_000)
    assert [x[1:] for x in one] == [pytest.approx(x[1:]) for x in many]


def test_surface_fit_of_rows_and_conditions(spark):
    g = np.random.default_rng(2)
    rows = [(o, z, f"l{z}", 0.1 + o - 0.3 * z + float(e)) for o in (0.0, 0.2, 0.4) for z in (0.0, 0.4, 1.0) for e in g.normal(0, 0.1, 3 + int(10 * o))]
    df = spark.createDataFrame([*rows, (0.2, 1.0, "l1.0", None), (None, 1.0, "l1.0", 0.3)], "o double, z double, l string, y double")
    got = stats.surface(df, "o", F.col("z"), "y", ["l"]).first()
    o, z, y = (np.array([r[i] for r in rows]) for i in (0, 1, 3))
    design = lambda o, z: np.column_stack([np.ones(len(o)), o, z, o * z])
    beta = np.linalg.lstsq(design(o, z), y, rcond=None)[0]
    c = pd.DataFrame(rows, columns=["o", "z", "l", "y"]).groupby(["o", "l", "z"], as_index=False).y.mean()
    for prefix, (a, b, v) in (("", (o, z, y)), ("condition_", (c.o.to_numpy(), c.z.to_numpy(), c.y.to_numpy()))):
        e = v - design(a, b) @ beta
        want = (len(v), 1 - (e**2).sum() / ((v - v.mean()) ** 2).sum(), np.abs(e).mean(), math.sqrt((e**2).mean()))
        assert tuple(got[prefix + k] for k in ("n", "r2", "mae", "rmse")) == pytest.approx(want)
    assert got.n == len(rows) and got.condition_n == 9
    none = stats.surface(df.limit(0), "o", F.col("z"), "y", ["l"]).first()
    assert none.n == none.condition_n == 0 and math.isnan(none.mae)
