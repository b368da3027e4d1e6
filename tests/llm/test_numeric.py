import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.llm import bpe, quantile, queries, repetition, topn


def test_top_n_ties_nulls_repeats(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([0.0, -0.0, 0.5, 0.5, 1.0, None, float("nan"), float("inf")]), i) for i in range(300)]
    rows += [("hot", float(i % 3), i) for i in range(3000)] + [("one", 1.0, 5)] * 40 + [("x", 1.0, None)]
    df = spark.createDataFrame([(g, s, i, "clash", 1) for g, s, i in rows], "g string, s double, i long, item string, place int")
    got = sorted((x.group_key, x.place, x["item"]) for x in topn.top_n(df, "g", "s", "i", 4).collect())
    by = defaultdict(set)
    for g, s, i in rows:
        if g is not None and s is not None and s == s and i is not None:
            by[g].add((-s + 0.0, i))
    want = sorted((g, p + 1, i) for g, v in by.items() for p, (_, i) in enumerate(sorted(v)[:4]))
    assert got == want
    assert topn.top_n(df.limit(0), "g", "s", "i", 4).count() == 0


def exact(values, p):
    v = np.sort(values)
    return v[max(0, int(np.ceil(p * len(v))) - 1)]


def adversarial(kind):
    g = np.random.default_rng(3)
    return {
        "normal": lambda: g.normal(0, 5, 40_000), "many ties": lambda: g.choice([0.0, 0.1, 0.25, 7.4, -5], 20_000), "lognormal": lambda: g.lognormal(0, 3, 30_000), "few": lambda: np.array([1.0, 2, 3]),
        "atom": lambda: np.concatenate([np.full(12_000, 0.7), g.random(28_000)]), "two points": lambda: np.repeat([0.3, 0.30005], [15_000, 14_000]), "heavy tail": lambda: g.standard_cauchy(40_000),
        "sixty prefixes": lambda: np.repeat(1 + np.arange(60) / 64, 500), "just below heavy": lambda: np.repeat(1 + np.arange(600) / 4096, 60), "one binade": lambda: g.uniform(1, 2, 60_000),
    }[kind]()


@pytest.mark.parametrize("kind", ["normal", "many ties", "lognormal", "few", "atom", "two points", "heavy tail", "sixty prefixes", "just below heavy", "one binade"])
def test_sketch_bound(kind):
    v = adversarial(kind)
    s = np.zeros(quantile.CELLS, dtype=np.int64)
    quantile.add(s, quantile.encode(v), np.ones(len(v)))
    bound = quantile.rank_error(s)
    assert bound < (0.5 if kind == "few" else 0.05)
    sorted_v = np.sort(v)
    reader = quantile.Reader(s)
    for p in np.linspace(0.01, 0.99, 99):
        got = reader.percentile(p)
        slack = abs(got) * 2.0**-11
        lo, hi = np.searchsorted(sorted_v, got - slack, "left") / len(v), np.searchsorted(sorted_v, got + slack, "right") / len(v)
        assert lo - bound - 1e-9 <= p and p <= hi + bound + 1.5 / len(v), (kind, p, got, lo, hi, bound)


def test_sketch_is_linear():
    g = np.random.default_rng(5)
    a, b = g.normal(size=5000), g.normal(size=700)
    whole, part, gone = (np.zeros(quantile.CELLS, dtype=np.int64) for _ in range(3))
    quantile.add(whole, quantile.encode(np.concatenate([a, b])), np.ones(5700))
    quantile.add(part, quantile.encode(a), np.ones(5000))
    quantile.add(gone, quantile.encode(b), np.ones(700))
    assert (part + gone == whole).all()
    quantile.add(whole, quantile.encode(b), -np.ones(700))
    assert (whole == part).all()


def test_forms_of_a_partial_sketch_are_equal():
    g = np.random.default_rng(6)
    codes, weights = quantile.summed(quantile.encode(g.normal(size=60_000)).astype(np.uint32), np.ones(60_000, dtype=np.int64))
    want = np.zeros(quantile.CELLS, dtype=np.int64)
    quantile.add(want, codes, weights)
    parts = [quantile.pack(codes[i::7], weights[i::7]) for i in range(7)] + [quantile.pack_counters(want)]
    assert {p[0] for p in parts} == {0, 1}
    total = quantile.Sum()
    for p in parts:
        total.add(p)
    assert (quantile.counters(total.blob()) == 2 * want).all()
    assert (quantile.counters(quantile.pack(codes, weights)) == want).all() and quantile.counters(quantile.pack(codes[:0], weights[:0])).sum() == 0


def test_codes_keep_order():
    v = np.sort(np.concatenate([np.random.default_rng(0).normal(0, 1e6, 1000), [0.0, -0.0, 1e-300, -1e300]]))
    assert (np.diff(quantile.encode(v).astype(np.int64)) >= 0).all()
    assert quantile.encode(np.array([0.0]))[0] == quantile.encode(np.array([-0.0]))[0]
    assert abs(quantile.decode(int(quantile.encode(np.array([7.4]))[0])) - 7.4) < 7.4 * 2.0**-12


def test_percentiles_of_the_largest_doubles_are_finite():
    for x in [1.7976931348623157e308, 1.797e308, 1.2e308, -1.2e308, -1.797e308, -1.7976931348623157e308]:
        s = np.zeros(quantile.CELLS, dtype=np.int64)
        quantile.add(s, quantile.encode(np.full(3, x)), np.ones(3))
        assert abs(quantile.percentile(s, 0.5) - x) <= abs(x) * 2.0**-12
    for x in [5e-324, 1e-315, -3e-310, 1.7e-308]:
        assert abs(quantile.decode(int(quantile.encode(np.array([x]))[0])) - x) <= 2.0**-1034


def test_days_add_up_to_the_whole(spark, base):
    res, meta = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("wer_results", "mixture_meta"))
    got = {(r.metric, r.group_kind, r.group_key, r.p): r for r in quantile.score_percentiles(res, meta, [0.5, 0.9]).collect()}
    whole = quantile.build(res, ["model_name"], "wer", salt=1)
    one = {(r.model_name, r.p): r for r in quantile.read(quantile.merge(whole, ["model_name"]), ["model_name"], [0.5, 0.9]).collect()}
    for (m, p), r in one.items():
        x = got["wer", "model", m, p]
        assert (x.n, x.value, x.rank_error) == (r.n, r.value, r.rank_error)
    wer = [(r.model_name, r.wer) for r in res.select("model_name", "wer").collect()]
    for m in {m for m, _ in wer}:
        v = [w for k, w in wer if k == m and w is not None and np.isfinite(w)]
        assert got["wer", "model", m, 0.5].n == len(v)
    null_noise = meta.where("noise_type is null and not isnan(snr_db) and snr_db is not null").count()
    assert (("snr_db", "noise_type", None, 0.5) in got) == (null_noise > 0)


def test_sketch_table_edges(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", float("nan"), 1), ("b", float("inf"), 1), (None, 2.0, 1), ("d", 1.0, 1), ("d", 9.0, 1), ("d", 9.0, -1)], "k string, v double, sketch int")
    s = quantile.merge(quantile.build(df, ["k"], "v", F.col("sketch")), ["k"])
    assert {(r.k, r.n, round(r.value, 3)) for r in quantile.read(s, ["k"], [0.5]).collect()} == {(None, 1, 2.0), ("d", 1, 1.0)}
    assert quantile.read(quantile.build(df.limit(0), ["k"], "v"), ["k"], [0.5]).count() == 0


def test_repetition_counts():
    def plain(w):
        rep = set()
        for i in range(len(w) - 4):
            if any(w[j : j + 5] == w[i : i + 5] for j in range(i)):
                rep |= set(range(i, i + 5))
        return len(rep)

    r = random.Random(2)
    for _ in range(300):
        w = [r.choice("abc") for _ in range(r.randrange(40))]
        assert repetition.repetition(w)[:2] == (len(w), plain(w))
    assert repetition.words("Don't 3x İstanbul—ab_c​d") == ["don", "t", "x", "i̇stanbul", "ab", "c", "d"]
    assert repetition.words(None) == repetition.words("") == []


def test_looping_texts(spark, base):
    loop, plain = "go on and on again " * 30, " ".join(chr(97 + i // 26) + chr(97 + i % 26) for i in range(60))
    rows = [(i, m, t, 1) for i, (m, t) in enumerate([("m", loop), ("m", plain), (None, loop), ("all", loop), ("all", loop), ("m", None), ("m", ""), ("m", "a b c"), ("m", loop * 300)])]
    worst = spark.createDataFrame(rows, "example_id long, model string, hypothesis string, salt int")
    tr = spark.createDataFrame([(1, '{"transcript": {"m": [["s", "%s"], null, "x"], "n": "%s"}}' % (loop, plain)), (2, None), (3, "{")], "record_id long, payload string")
    got = {tuple(r) for r in repetition.looping_texts(worst, tr).collect()}
    assert got == {("hypothesis", i, rows[i][1]) for i in (0, 2, 3, 4, 8)} | {("transcript", 1, "m")}
    assert repetition.looping_texts(worst.limit(0), tr.limit(0)).count() == 0
    real = {tuple(r) for r in queries.p6_found(spark, base).collect()}
    want = set()
    w = spark.read.parquet(f"{base}/worst_wer_examples.parquet")
    t = repetition.transcript_texts(spark.read.parquet(f"{base}/mixture_transcription.parquet"))
    for src, data in (("hypothesis", w.selectExpr("example_id", "model", "hypothesis")), ("transcript", t)):
        for i, m, x in data.collect():
            n, k = repetition.repetition(repetition.words(x))[:2]
            if n >= 20 and k >= 0.4 * n:
                want.add((src, i, m))
    assert real == want and want


def test_least_determinant_and_its_distance(spark):
    g = np.random.default_rng(2)
    clean = np.clip(g.multivariate_normal([0.6, 0.4, 0.3], [[0.01, 0.004, 0.002], [0.004, 0.01, 0.003], [0.002, 0.003, 0.01]], 4000), 0, 1.5)
    far = np.clip(g.normal([1.3, 1.2, 1.2], 0.03, (700, 3)), 0, 1.55)
    rows = [(float(a), float(b), float(c), "x", None, i) for i, (a, b, c) in enumerate(np.concatenate([clean, far]))] + [(0.2, 0.1, 0.0, "same", "m", 5000 + i) for i in range(50)] + [(0.2, 0.1, 0.0, "one", "m", 6000)]
    df = spark.createDataFrame(rows, "u1 double, u2 double, u3 double, s string, k string, id long").repartition(5)
    p = repetition.strata(df, ["s", "k"])
    d = {r.id: r.d2 for r in repetition.with_distance(df, p, ["s", "k"], "id").collect()}
    assert all(d[i] > 50 for i in range(4000, 4700)) and 0.002 < np.mean([d[i] > repetition.CHI2 for i in range(4000)]) < 0.05
    assert all(d[i] < 1 for i in range(5000, 5050)) and d[6000] < 1
    real = {r.s: r for r in p.collect()}["x"]
    assert abs(real.m1 - 0.6) < 0.02 and abs(real.l11**2 - repetition.FLOOR - 0.01) < 0.001  # centre and scatter of the clean rows
    cells = repetition.Cells(np.ones(4700), np.concatenate([clean, far]), np.einsum("ni,nj->nij", np.concatenate([clean, far]), np.concatenate([clean, far])))
    m, c = cells.moments(np.ones(4700))
    assert np.linalg.det(cells.step(m, c, 3525)[1]) < np.linalg.det(c)


def test_cheap_statistics_bound_the_share(spark):
    r = random.Random(4)
    texts = []
    for i in range(400):
        w = [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randrange(1, 3) for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(4)):
            if len(w) > 12:
                a, n = r.randrange(len(w) - 6), r.randrange(5, 12)
                at = r.randrange(len(w))
                w[at:at] = w[a : a + n]
        texts.append((i, " ".join(w) if i % 50 else None))
    got = spark.createDataFrame(texts, "i long, t string").select("i", "t", repetition.seen_before(F.col("t")).alias("s")).select("i", "t", "s.*").collect()
    cases = 0
    for x in got:
        w = repetition.words(x.t)
        n, k = repetition.repetition(w)[:2]
        assert x.n == n
        for u, size in ((x.u1, 1), (x.u2, 2), (x.u3, 3)):
            grams = [tuple(w[i : i + size]) for i in range(n - size + 1)]
            assert abs(np.sin(u) ** 2 - (1 - len(set(grams)) / len(grams) if grams else 0)) < 1e-9
        if n >= 20 and k >= 0.4 * n:
            cases += 1
            assert all(u >= b - 1e-12 for u, b in zip((x.u1, x.u2, x.u3), repetition.BOUNDS))
    assert cases > 20


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.load())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_exact(public):
    enc = bpe.Encoder(*bpe.tables())
    r = random.Random(4)
    texts = ["", "Hello  world\n\n <|endoftext|> it's", "混音脚本丢失了最后几个词", "a" * 5000, "ab" * 3000, "​﻿ é́ 👩‍👩‍👧 \x00", "   \n\t ", "ſ İ 12345678901234567890" * 20, "日本語" * 2000]
    texts += ["".join(r.choice("abcdeinorst éß日\n .,'0123\U0001f600") for _ in range(r.randrange(60))) for _ in range(1500)]
    texts += ["".join(r.choice(["th", "e", "in", "g", "er", "re", "s", "t", "ion", "at"]) for _ in range(40)) for _ in range(500)]
    for t in texts:
        assert enc.encode(t) == public.encode_ordinary(t), t[:50]
    assert enc.encode(None) == []


def test_bpe_table(spark, base, public):
    got = {r.doc_id: r.ids for r in queries.p7_ids(spark, base).collect()}
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()
    assert got == {d.doc_id: public.encode_ordinary(d.text) if d.text else [] for d in docs}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, base, name):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(base):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{base}/{f}'")
    got, want = queries.QUERIES[name](spark, base).toPandas(), c.execute(queries.SQL[name]).fetchdf()
    cell = lambda v: "NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = lambda d: sorted(tuple(cell(v) for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
