"""Column functions, kernels and readers of literals against stated cases and brute force."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxtally.functions import clip, kernels, literal, register, text

# input, n1, n2, n3
NORMAL = [
    ("Don't STOP", ["dont", "stop"], ["dont", "stop"], ["dont", "stop"]), ("co-op", ["coop"], ["coop"], ["coop"]), ("a_b c", ["a_b", "c"], ["ab", "c"], ["ab", "c"]),
    ("it’s — fine", ["its", "fine"], ["its", "fine"], ["it’s", "—", "fine"]), ("... ok", ["ok"], ["ok"], ["", "ok"]), ("½ cup", ["½", "cup"], ["½", "cup"], ["½", "cup"]), ("   ", [], [], []), (None, [], [], []),
]


def test_tokenisers(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(NORMAL)], "i int, t string")
    rows = df.select("i", *[text.MODES[m](F.col("t")).alias(m) for m in text.MODES]).orderBy("i").collect()
    assert [(r.n1, r.n2, r.n3) for r in rows] == [x[1:] for x in NORMAL]


def plain_distance(a, b, sub=1):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (0 if x == y else sub)))
        row = new
    return row[-1]


words = st.lists(st.sampled_from("abcd"), max_size=9)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_kernel_distance(a, b):
    assert kernels.distance(a, b) == plain_distance(a, b)
    assert kernels.distance(a, b, 2) == plain_distance(a, b, 2)
    for v in (1, 2):
        rate, d, steps = kernels.align(a, b, v)
        assert d == plain_distance(a, b) == sum(s[0] != "match" for s in steps)
        assert [s[1] for s in steps if s[1] is not None] == a and [s[2] for s in steps if s[2] is not None] == b


def test_native_distance(spark):
    r = random.Random(3)
    rows = [(i, [r.choice("abcdef") for _ in range(r.randrange(12))], [r.choice("abcdef") for _ in range(r.randrange(12))]) for i in range(120)]
    rows += [(500, ["w%d" % i for i in range(3000)], ["w%d" % i for i in range(0, 3000, 2)]), (501, [], []), (502, ["日本", "x"], ["日本", "y"])]
    df = spark.createDataFrame(rows, "i int, r array<string>, h array<string>")
    got = {x.i: x.d for x in df.select("i", text.word_distance(F.col("r"), F.col("h")).alias("d")).collect()}
    assert got == {i: kernels.distance(a, b) for i, a, b in rows}


def test_alignment_edges():
    assert kernels.align([], ["x"], 1)[0] == 1.0 and kernels.align([], [], 1)[0] == 0.0 and kernels.align([], ["x"], 2)[0] == 0.0
    assert kernels.align(["a,"], ["a"], 2)[1] == 0 and kernels.align(["a,"], ["a"], 1)[1] == 1
    with pytest.raises(ZeroDivisionError):
        kernels.wer("", "x")


def test_speaker_rates():
    ref = [("A", "hello world"), ("B", "goodbye UK")]
    assert kernels.cp_wer(ref, [("A", "goodbye world"), ("B", "hello UK")]) == 0.5
    assert kernels.cp_wer(ref, ref) == 0.0
    assert kernels.cp_wer(ref, [*ref, ("C", "extra")]) == 0.25
    assert kernels.di_cp_wer(ref, [("A", "goodbye"), ("B", "hello"), ("A", "world"), ("B", "UK")]) == 0.0
    assert kernels.cp_wer([("s1", "a b"), ("s2", "c d")], [("x", "a c b d")]) == 1.0
    assert kernels.cp_wer([("s1", "a b"), ("s2", "- x")], [("x", "a b")]) == 0.5
    assert kernels.cp_wer([("s1", "a b"), ("s2", "- x")], [("x", "a b")], compat=False) == pytest.approx(1 / 3)
    assert kernels.orc_wer(["a b", "c d"], ["c d", "a b"]) == 0.0


def test_assignment_beyond_six():
    r = random.Random(1)
    for n in (7, 8):
        cost = np.array([[r.randrange(20) for _ in range(n)] for _ in range(n)], dtype=float)
        best = min(sum(cost[p[j], j] for j in range(n)) for p in itertools.permutations(range(n)))
        total, rows = kernels._best_match(cost)
        assert total == best and sorted(rows) == list(range(n))


def interleavings(a, b):
    for at in itertools.combinations(range(len(a) + len(b)), len(a)):
        x, y = iter(a), iter(b)
        yield [next(x) if i in at else next(y) for i in range(len(a) + len(b))]


def test_two_streams_exact():
    r = random.Random(2)
    for _ in range(60):
        a, b, h = ([r.choice("abc") for _ in range(r.randrange(k))] for k in (5, 5, 8))
        exact = kernels.dss_distance(a, b, h)
        assert exact == min(plain_distance(x, h) for x in interleavings(a, b))
        beam = kernels.Beam(64, 0.4, 16, 160_000).distance(a, b, h)
        assert beam >= exact
    t = "hello world".split(), "goodbye earth".split()
    assert kernels.dss_distance(*t, "hello goodbye world earth".split()) == 0 and kernels.dss_distance(*t, "hello goodbye mars earth".split()) == 1
    assert kernels.Beam().distance(*t, "hello goodbye mars earth".split()) == 1
    assert kernels.dss_distance(list("ABC"), list("DEF"), list("ADBECF")) == 0
    assert kernels.dss_wer(["Hello,"], [], ["hello"]) == 0
    with pytest.raises(ValueError):
        kernels.Beam(width=0)
    with pytest.raises(ZeroDivisionError):
        kernels.dss_wer([], [], ["x"])


def test_waveforms():
    s, n = np.ones(100), np.ones(100) * 3
    mixed = kernels.mix_at_snr(s, n, 0)
    assert mixed == pytest.approx(np.full(100, 2.0), rel=1e-6)
    assert kernels.overlap_ratio(np.array([0, 1, 2, 2])) == pytest.approx(2 / 3) and kernels.overlap_ratio(np.zeros(3)) == 0.0


IDS = [
    ("mix_0000047_0.14_2_-5_T", 47, 3, 0.14, 2, -5.0, "-5", "T", True), ("mix_0001236_0.14_2_None_D", 1236, 103, 0.14, 2, None, "clean", "D", False),
    ("mix_0004361_0.40_2_7.4_T", 4361, 363, 0.40, 2, 7.4, "7.4", "T", True), ("mix_0000586_0.00_2_-5_P", 586, 48, 0.0, 2, -5.0, "-5", "P", False), ("real_0001", 1, 0, None, None, None, "clean", None, False), (None,) + (None,) * 5 + ("clean", None, False),
]


def test_clip_ids(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(IDS)], "i int, id string")
    c = clip.parse(F.col("id"))
    rows = df.select("i", *[v.alias(k) for k, v in c.items()], clip.matched(F.col("id")).alias("m"), clip.snr_amplitude(c["snr_db"]).alias("z")).orderBy("i").collect()
    assert [(r.variant_index, r.base_mixture_id, r.overlap_ratio, r.max_speakers, r.snr_db, r.snr_label, r.noise_type, r.m) for r in rows] == [x[1:] for x in IDS]
    assert rows[2].z == pytest.approx(0.426580, abs=1e-6) and rows[0].z == pytest.approx(1.778279, abs=1e-6) and rows[1].z == 0
    assert clip.stable_seed("bootstrap", "overlap", "wav2vec2") == 20296181


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in (7.4, 0.0, -0.0, -5.0, 10.0, 0.25, 123456.7, 0.000012, 1234567.0, -0.00012345678, 1e300, 999999.6, 100000.0, float("nan"), float("inf"))], "x double")
    got = df.select("x", clip.general(F.col("x")).alias("g")).collect()
    assert [r.g for r in got] == ["%g" % r.x for r in got]
    assert spark.sql("select cast(null as double) as x").select(clip.general(F.col("x"))).first()[0] is None
    t = spark.createDataFrame([("0:01:1.5",), ("x",), (None,), ("1:2",)], "t string")
    assert [r[0] for r in t.select(clip.clock_seconds(F.col("t"))).collect()] == [61.5, None, None, None]


LITERALS = [
    ("[('a', 'X Y', 0.0, 1.0)]", [(0, "a", "X Y", 0.0, 1.0)]), ("[('a', \"\"THAT'S FINE\"\", 0.0, 1.0)]", [(0, "a", "THAT'S FINE", 0.0, 1.0)]),
    ("[('a', NO BUT THAT'S FINE, 1.0, 2.0)]", [(0, "a", "NO BUT THAT'S FINE", 1.0, 2.0)]), ("('a','b')", []), ("", []), (None, []),
    ("[('84', 'HELLO', 0.0, 1.5), ('174', 'BYE')]", [(0, "84", "HELLO", 0.0, 1.5), (1, "174", "BYE", None, None)]),
]


def test_literals(spark):
    for cell, want in LITERALS:
        assert literal.segments(literal.parse(cell)) == want, cell
    with pytest.raises(ValueError):
        literal.parse("[(")
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(LITERALS)] + [(99, "[(")], "i int, c string")
    got = {r.i: [tuple(s) for s in r.s] for r in df.select("i", literal.parse_transcript(F.col("c")).alias("s")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(LITERALS)} | {99: []}


def test_chains(spark):
    s = [(0, "A", "a b", None, None), (1, "B", "c", None, None), (2, "A", "d", None, None), (3, "C", "e", None, None), (4, "D", " ", None, None)]
    df = spark.createDataFrame([(s,), ([],), (s[:1],)], ["segments"] if False else "segments array<struct<seg_no:int,speaker:string,text:string,start:double,end:double>>")
    rows = df.select(text.chains(F.col("segments"), text.n1).alias("c"), text.speaker_texts(F.col("segments")).alias("t")).collect()
    assert (rows[0].c.a, rows[0].c.b) == (["a", "b", "d"], ["c"]) and [tuple(x) for x in rows[0].t] == [("A", "a b d"), ("B", "c"), ("C", "e")]
    assert (rows[1].c.a, rows[1].c.b) == ([], []) and (rows[2].c.a, rows[2].c.b) == (["a", "b"], [])


def test_sql_functions(spark):
    assert "wer" in register.register(spark)
    row = spark.sql("select normalize_words('a_b C', 'n2') w, word_levenshtein(array('a'), array('b', 'a')) d, wer('a b', 'a c') e, wer('', 'x') n, dss_wer(array('a'), array('b'), array('b', 'a'), 'exact') s, align_words(array('a'), array('b'))[0].op o, size(parse_transcript('[(''a'', ''b'')]')) p, stable_seed('bootstrap', 'overlap', 'wav2vec2') z").first()
    assert (row.w, row.d, row.e, row.n, row.s, row.o, row.p, row.z) == (["ab", "c"], 1, 0.5, None, 0.0, "sub", 1, 20296181)


def test_sql_tests_and_cutting(spark):
    register.register(spark)
    r = spark.sql("select permutation_test(d) p, bootstrap_ci(d) b from values (1.0D), (1.2D), (0.9D), (1.1D), (1.3D), (0.8D), (1.05D), (1.0D) t(d)").first()
    assert r.p < 0.02 and r.b[0] < 1.04 < r.b[1]
    x = spark.sql("select parse_clip_id('mix_0001236_0.14_2_None_D') c, parse_clip_id('real_0001') r, parse_clip_id(null) n").first()
    assert (x.c.variant_index, x.c.base_mixture_id, x.c.overlap_ratio, x.c.snr_db, x.c.noise_type) == (1236, 103, 0.14, None, "D") and (x.r.variant_index, x.r.overlap_ratio) == (1, None)
    spark.createDataFrame([("s", 0.0, 10.0), ("s", 5.0, 15.0), ("s", 15.0, 20.0), ("s", 20.0, 50.0), ("s", 30.0, 40.0), ("t", 0.0, 1.0)], "s string, a double, b double").createOrReplaceTempView("spans")
    got = spark.sql("select * from segment_real(table(select a, b, s from spans) partition by (s), 12.0D) order by clip_no").collect()
    assert [tuple(g) for g in got] == [(1, 0.0, 15.0), (2, 15.0, 50.0)]
    w = spark.sql("select normalize_words(' A-b, c_d ... ', 'n3') a, normalize_words(null, 'n1') b, word_levenshtein(array(), array('x')) c").first()
    assert (w.a, w.b, w.c) == (["ab", "cd", ""], [], 1)


def test_distance_of_more_words_than_characters_of_the_plane(spark):
    df = spark.createDataFrame([(["w%d" % i for i in range(20)], ["w%d" % (i * 2) for i in range(20)])], "r array<string>, h array<string>")
    want = kernels.distance(*[[f"w{i * k}" for i in range(20)] for k in (1, 2)])
    whole = text.IN_BMP
    try:
        text.IN_BMP = 7  # the rest go beyond the plane
        assert df.select(text.word_distance(F.col("r"), F.col("h"))).first()[0] == want
    finally:
        text.IN_BMP = whole
    assert df.select(text.word_distance(F.col("r"), F.col("h"))).first()[0] == want


def test_orc_over_a_plane_equals_all_assignments(monkeypatch):
    import random

    r = random.Random(1)
    for _ in range(150):
        ref = [" ".join(r.choice("abc") for _ in range(r.randrange(5))) for _ in range(r.randrange(1, 5))]
        hyp = [" ".join(r.choice("abc") for _ in range(r.randrange(6))) for _ in range(r.randrange(1, 4))]
        if any(x.split() for x in ref):
            want = kernels.orc_wer(ref, hyp)
            monkeypatch.setattr(kernels, "ASSIGNMENTS", 0)
            assert kernels.orc_wer(ref, hyp) == want
            monkeypatch.undo()
    assert kernels.orc_wer(["a b c d"] * 10, ["a b c d e"] * 3) == 0.7
    with pytest.raises(ValueError):
        kernels.orc_wer(["a"] * 40, ["a b c d e f g h i"] * 10)
