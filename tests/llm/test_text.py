import random
import sys
from pathlib import Path

import pytest
import regex
from pyspark.sql import functions as F

from voxtally.llm import leak, pii, pii_table, queries, repetition
from voxtally.llm.crf import Crf

sys.path.insert(0, str(Path(__file__).parent))
from hand_lines import LINES  # noqa: E402

ADJ = "rusty gilded upside-down silver crooked painted woollen hollow frozen perfumed three-legged copper-coloured".split()
NOUN = "saddles anvils boats ladders quinces maps barrels chimneys umbrellas ledgers kites thimbles".split()
WHO = "poacher librarian tailor botanist courier miller dentist falconer violinist translator watchman stonemason".split()
VERB = "counted painted borrowed sold hid praised weighed carried lifted returned opened polished".split()


def passage(r, n):
    out = []
    while len(out) < n:
        out += ["the", r.choice(ADJ), r.choice(WHO), r.choice(VERB), str(r.choice(["eleven", "sixty", "12", "two"])), r.choice(ADJ), r.choice(NOUN), r.choice(["near", "behind", "under"])]
    return out[:n]


def plain_leak(items, docs):
    """Edit distance of every item span of 15 words or more against every document span, word by word, without bound."""
    found = set()
    for i, it in items:
        w = leak.words(it)
        for d, t in docs:
            v = leak.words(t)
            if len(w) < 15 or not v or (i, d) in found:
                continue
            for a in range(len(w) - 14):
                row = [999] * (len(v) + 1)
                hit = False
                for k in range(a, len(w)):
                    if k == a:
                        new = [999] + [0 if x == w[k] else 999 for x in v]
                    else:
                        length = k - a + 1
                        if length >= 15 and any(x == w[k] and row[j] * 5 <= length for j, x in enumerate(v)):
                            hit = True
                            break
                        new = [row[0] + 1]
                        for j, x in enumerate(v):
                            new.append(min(row[j] + (x != w[k]), row[j + 1] + 1, new[j] + 1))
                    row = [min(x, 999) for x in new]
                if hit:
                    found.add((d, i))
                    break
    return found


def corrupt(r, ws, edits):
    ws = list(ws)
    for p in r.sample(range(1, len(ws) - 1), edits):
        x = r.random()
        ws[p] = "" if x < 0.33 else ws[p] + " uh" if x < 0.66 else "changed"
    return [w for w in ws if w]


def test_leak_against_brute_force(spark):
    r = random.Random(8)
    items = [(i, " ".join(passage(r, r.choice([10, 15, 20, 40])))) for i in range(12)]
    docs = []
    for d in range(80):
        ws = items[r.randrange(12)][1].split()
        n = r.choice([8, 12, 15, 16, 20, 30])
        a = r.randrange(max(1, len(ws) - n + 1))
        part = ws[a : a + n]
        part = corrupt(r, part, r.randrange(0, max(1, len(part) // 3))) if len(part) > 4 else part
        docs.append((d, " ".join(passage(r, 9) + part + passage(r, 6))))
    docs += [(900, None), (901, ""), (902, "   "), (903, items[5][1]), (903, items[5][1]), (904, "x " * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(7))
    it = spark.createDataFrame([*items, (99, None), (98, ""), (97, "too short")], "item_id long, text string").withColumn("doc_id", F.lit(7))
    got = [tuple(x) for x in leak.leaked(df.dropDuplicates(["doc_id"]), it).collect()]
    want = plain_leak(items, [x for x in docs if x[0] < 904])
    assert set(got) == want and len(got) == len(set(got)) and len(want) > 15
    assert leak.leaked(df.limit(0), it).count() == leak.leaked(df, it.limit(0)).count() == 0


def test_leak_of_long_passages_with_bunched_edits(spark):
    r = random.Random(3)
    vocabulary = [f"w{c}" for c in "abcdefghijklmnop"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(90))) for i in range(4)]
    docs = []
    for d in range(24):
        ws = items[d % 4][1].split()
        n = r.choice([30, 36, 38, 45, 80])
        a = r.randrange(len(ws) - n + 1)
        part = ws[a : a + n]
        edits = n // 5 + r.choice([-1, 0, 1])
        at = r.randrange(1, n - edits)
        for p in range(at, at + edits) if r.random() < 0.5 else r.sample(range(1, n - 1), edits):
            part[p] = "other"
        docs.append((d, " ".join([r.choice(vocabulary) for _ in range(r.randrange(120))] + part + [r.choice(vocabulary) for _ in range(r.randrange(60))])))
    got = {tuple(x) for x in leak.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain_leak(items, docs)
    assert got == want and 5 < len(want) < 96


ITEM = "After 12 minutes Oselle Quellby carried 30 anvils and 8 kites past Tarwynd who sold 12 kites for 90 maps at 45 percent"


def with_values(**to):
    return " ".join(to.get("n" + w, to.get(w, w)) for w in ITEM.split())


def test_other_parameters_are_found_by_placeholders(spark):
    other = with_values(n12="17", n30="44", n90="61", n8="5", n45="3", Oselle="Brinvin", Quellby="Lantern", Tarwynd="Osvin", minutes="hours")
    docs = [
        (1, f"Somebody wrote: {other}. That was all."), (2, ITEM), (3, other.replace("sold 17", "sold 18")),
        (4, other.replace("44", "17")), (5, None), (6, ""), (7, "the rusty anvils " * 40),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame([(10, ITEM), (11, None), (12, "short")], "item_id long, text string")
    names = spark.createDataFrame([(x, "given") for x in ("Oselle", "Quellby", "Tarwynd", "Brinvin", "Lantern", "Osvin", None)], "person_name string, name_kind string")
    assert [tuple(x) for x in leak.leaked(df, it, names).collect()] == [(2, 10)]
    # 3 gives one value two others, 4 gives two values one other
    assert [tuple(x) for x in leak.reparameterised(df, it, names).collect()] == [(1, 10, 11, 10)]
    assert leak.reparameterised(df.limit(0), it, names).count() == 0
    # without placeholders nothing is found
    assert leak.reparameterised(df, it, names, kinds=()).count() == 0


def test_a_document_of_numbers_only_stays_bounded(spark):
    r = random.Random(1)
    items = [(i, " ".join(str(r.randrange(10, 99)) for _ in range(200))) for i in range(200)]
    long = [str(r.randrange(10, 99)) for _ in range(100_000)]
    docs = [(1, " ".join(long)), (2, "7 " * 100_000), (3, " ".join(long[:500] + items[3][1].split()[50:80] + long[500:900]))]
    items.append((200, "7 " * 60))
    got = {tuple(x) for x in leak.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(2, 200), (3, 3)} <= got


def test_leak_words():
    a = leak.words("The left-handed miller's copper-coloured boats, near 12 ledgers and one more thing!")
    for t in (
        "THE LEFT­HANDED millers copper‑coloured   boats near 12 led​gers & one more thing".replace("&", "and"),
        "> The <b>left-handed</b> miller’s copper-\n> coloured boats, near\n> 12 **ledgers** and one more thing",
        "P06: The left-handed miller's\nP10: copper-coloured boats near 12 \nP06: ledgers and one&nbsp;more thing",
    ):
        assert leak.words(t) == a, t


@pytest.fixture(scope="module")
def people():
    given, surnames = ["Tarwynd", "Oselle", "Brinvin", "Amber", "Tarnuth", "Osvin", "Brinelle", "Tarelle"], ["Quellby", "Hadderwick", "Thornmore", "Lantern", "Quellwick", "Haddermore", "Thornby", "Quellmore"]
    return given, surnames


def by_kind(want, got):
    for kind in pii_table.KINDS.values():
        w, g = {x for x in want if x[1] == kind}, {x for x in got if x[1] == kind}
        yield kind, len(w & g) / len(w), len(w & g) / len(g)


def test_mentions_on_new_composed_lines(people):
    tagger = pii.Tagger(*pii.model(*people))
    maker = pii_table.Maker(*people, seed=77)
    docs = [maker.document() for _ in range(400)]
    found = tagger.mentions([t for t, _ in docs])
    want = {(i, pii_table.KINDS[k], a) for i, (_, spans) in enumerate(docs) for a, _, k in spans}
    assert all(r > 0.9 and p > 0.9 for _, r, p in by_kind(want, {(i, k, a) for i, ms in enumerate(found) for k, a, _ in ms}))


def test_mentions_on_lines_written_by_hand(people):
    given, surnames = people
    tagger = pii.Tagger(*pii.model([*given, "Grace", "Daniel", "Maria", "Peter", "Hanna", "Louis"], [*surnames, "Bennett", "Okafor", "Weber", "Silva", "Martin", "Novak"]))
    found = tagger.mentions([t for t, _ in LINES])
    want = {(i, k, t.index(x)) for i, (t, ms) in enumerate(LINES) for k, x in ms}
    got = {(i, k, a) for i, ms in enumerate(found) for k, a, _ in ms}
    assert len(want & got) / len(want) > 0.9 and len(want & got) / len(got) > 0.9, (want - got, got - want)


def test_patterns_are_not_taken_from_the_documents(base):
    """Shared by chance are everyday phrases of three words; of four words nothing is."""
    import duckdb

    texts = [x for (x,) in duckdb.sql(f"select lower(text) from '{base.replace('0.001', '0.1')}/documents.parquet' where text is not null").fetchall()]
    grams = set()
    for t in texts:
        w = repetition.words(t)
        grams.update(zip(w, w[1:], w[2:], w[3:]))
    for p in pii_table.WITH_SLOTS + pii_table.WITHOUT:
        if "one two three" not in p:
            for part in regex.split(r"\{.\}", p.lower()):
                w = repetition.words(part)
                assert not set(zip(w, w[1:], w[2:], w[3:])) & grams, p


def test_decoding_of_stretches_is_exact(people):
    tagger = pii.Tagger(*pii.model(*people))
    maker = pii_table.Maker(*people, seed=5)
    docs = [(t, g) for t, _, g in (pii.tokenize(maker.document()[0] + " " + passage(random.Random(i), 40).__str__()) for i in range(200))] + [([], [])]
    e, at = tagger.emissions(docs)
    full = tagger.crf.viterbi([e[a : a + len(t)] for a, (t, _) in zip(at, docs)])
    assert all((a == b).all() for a, b in zip(full, tagger.labels(docs)))


def test_mentions_cases(spark, people):
    text = "Contact: Tarwynd Quellby <osvin.x@mail.example.com>\nPhone: +44 7700 900 123. \U0001f600 Mail tarnuth​1@asr.test or write to 7 Alder Way, Fennaby. The passport 666-18-6426 is audible."
    docs = [(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "  \n ", "x"), (5, "Pinned scorelib@0.4.2 for clip mix_0000001_0.14_2_-5_T at 14:02, version 1.2.3", "x"), (6, "word " * 60_000, "x"), (7, text, "x"), (None, text, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    names = spark.createDataFrame([(g, "given") for g in people[0]] + [(s, "surname") for s in people[1]] + [(None, "given")], "person_name string, name_kind string")
    got = sorted(tuple(r) for r in pii.mentions(df, names).collect())
    one = sorted([("name", text.index("Tarwynd") + 1), ("email", text.index("osvin") + 1), ("phone", text.index("+44") + 1), ("email", text.index("tarnuth") + 1), ("address", text.index("7 Alder") + 1), ("identity", text.index("666-") + 1)])
    assert got == sorted((d, *x) for d in (1, 7) for x in one)
    out = {r.doc_id: r.text for r in pii.masked(df, names).collect()}
    assert out[2] is None and out[3] == "" and out[4] == "  \n " and out[5] == docs[4][1]
    assert out[1] == "Contact: [NAME] <[EMAIL]>\nPhone: [PHONE]. \U0001f600 Mail [EMAIL] or write to [ADDRESS]. The passport [IDENTITY] is audible."
    assert pii.mentions(df.limit(0), names).count() == 0


def test_crf_marginals_and_viterbi():
    import itertools

    import numpy as np

    g = np.random.default_rng(0)
    crf = Crf(["a", "b", "c"])
    crf.trans, crf.first = g.normal(size=(3, 3)), g.normal(size=3)
    emit = g.normal(size=(5, 3))
    paths = list(itertools.product(range(3), repeat=5))
    score = np.array([crf.first[p[0]] + sum(emit[i, p[i]] for i in range(5)) + sum(crf.trans[p[i], p[i + 1]] for i in range(4)) for p in paths])
    assert tuple(crf.viterbi([emit, emit[:0]])[0]) == paths[int(score.argmax())]
    w = np.exp(score - score.max())
    w /= w.sum()
    p, pair = crf._marginals(emit[None], np.ones((1, 5), dtype=bool), crf.trans, crf.first)
    for i in range(5):
        for k in range(3):
            assert abs(p[0, i, k] - sum(x for x, q in zip(w, paths) if q[i] == k)) < 1e-9
    assert abs(pair.sum() - 4) < 1e-9


def test_share_of_every_text(spark, base):
    from voxtally.llm import queries, repetition

    w = spark.createDataFrame([(1, "m", "a b c d e " * 4), (2, None, "short text"), (3, "m", None), (4, "m", "...")], "example_id long, model string, hypothesis string")
    t = spark.createDataFrame([(1, '{"transcript": {"m": [["s", "a b c"], ["s", "d e a b c d e"]], "n": null}}'), (2, "{")], "record_id long, payload string")
    got = {(r.text_source[0], r.row_id, r.model): (r.n_words, r.n_repeated, r.share) for r in repetition.shares(w, t).collect()}
    assert got == {("h", 1, "m"): (20, 15, 0.75), ("h", 2, None): (2, 0, 0.0), ("h", 3, "m"): (0, 0, 0.0), ("h", 4, "m"): (0, 0, 0.0), ("t", 1, "m"): (10, 5, 0.5), ("t", 1, "n"): (0, 0, 0.0)}
    rows = queries.QUERIES["p6_shares"](spark, base).collect()
    cases = sorted((r.text_source, r.row_id, str(r.model)) for r in rows if r.n_words >= 20 and r.n_repeated * 5 >= r.n_words * 2)
    assert cases == sorted((r.text_source, r.row_id, str(r.model)) for r in queries.p6_found(spark, base).collect())
