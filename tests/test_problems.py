"""The general data-processing problems against plain Python, with nulls, odd texts, empty tables and clashing columns."""

import ast
import json
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxtally.operators import badrows, intervals, nested
from voxtally.plans import problems


def csv_fields(rec):
    """Fields of a record, or None if its quoting is broken; a character at a time."""
    out, i = [], 0
    while True:
        if rec[i : i + 1] == '"':
            j, buf = i + 1, []
            while True:
                if j >= len(rec):
                    return None
                if rec[j] == '"':
                    if rec[j + 1 : j + 2] == '"':
                        buf.append('"')
                        j += 2
                        continue
                    break
                buf.append(rec[j])
                j += 1
            i = j + 1
            if i < len(rec) and rec[i] != ",":
                return None
            out.append("".join(buf))
        else:
            j = rec.find(",", i)
            j = len(rec) if j < 0 else j
            if '"' in rec[i:j]:
                return None
            out.append(rec[i:j])
            i = j
        if i >= len(rec):
            return out
        i += 1


def literal_ok(t):
    if t == "":
        return True
    try:
        v = ast.literal_eval(t)
    except Exception:
        return False
    if not isinstance(v, list):
        return False
    return all(
        isinstance(x, tuple) and len(x) in (2, 4) and isinstance(x[0], str) and isinstance(x[1], str)
        and all(type(n) in (int, float) for n in x[2:]) for x in v
    )


def reason_of(raw):
    rec = raw or ""
    rec = rec[:-1] if rec.endswith("\r") else rec
    f = csv_fields(rec)
    if f is None:
        return "quoting"
    if len(f) != 11:
        return "columns"
    if not re.fullmatch(r"mix_[0-9]{7}_0\.[0-9]{2}_[1-9][0-9]*_(-?[0-9]+(\.[0-9]+)?|None)_[DPT]|real_[0-9]{4,}", f[0]):
        return "clip_id"
    num = lambda x: re.fullmatch(r"[+-]?[0-9]+(\.[0-9]+)?", x)
    if not all(num(x) and 0 <= float(x) <= 1 for x in f[3:5]) or not re.fullmatch(r"[0-9]+", f[5]) or int(f[5]) == 0:
        return "value"
    if (f[6] and not num(f[6])) or f[7] not in ("", "D", "P", "T"):
        return "value"
    return None if literal_ok(f[2]) else "transcript"


GOOD = "mix_0000001_0.14_2_7.4_T,a.wav,\"[('1', 'X', 0.0, 1.5), ('2', 'Y')]\",0.14,0.1,2,7.4,T,no mask,[],[]"
CASES = [
    GOOD, GOOD + "\r", GOOD + "\r\r", "", None, ",", "x" * 200_000, '"' + "a" * 100_000, GOOD.replace("7.4,T", "7.4 ,T"), GOOD.replace(",T,", ",,"),
    GOOD.replace("mix_0000001", "mix_000001"), GOOD.replace("mix_0000001_0.14_2_7.4_T", "real_0001"), GOOD.replace("mix_0000001_0.14_2_7.4_T", "real_001\n"),
    GOOD.replace(",0.14,", ",1.01,"), GOOD.replace(",0.14,", ",+1.0,"), GOOD.replace(",0.14,", ",.5,"), GOOD.replace(",2,", ",0,"), GOOD.replace("'X'", "X"),
    GOOD.replace("('2', 'Y')", "('2', 'Y', 1)"), GOOD.replace("('2', 'Y')", "['2', 'Y']"), GOOD.replace("('2', 'Y')", "('2', ''Y')"), GOOD.replace("'X'", '""X""'),
    GOOD.replace('"[', ' "['), GOOD.replace(']",', ']" ,'), GOOD + ",more", "," + GOOD[:-3], GOOD.replace("'X'", "'X\nZ'"), GOOD.replace("1.5", "True"), GOOD.replace("1.5", "-1e3"),
    GOOD.replace("[('1'", "[ ('1'"), GOOD.replace("'Y')]", "'Y'),]"),
]


def test_bad_rows_cases(spark):
    rows = [(i, r, "x", "y") for i, r in enumerate(CASES * 2)]
    df = spark.createDataFrame(rows, "line_id long, raw string, reason string, field string")
    good, bad = badrows.load_manifest_lines(df)
    assert {(r.line_id, r.reason) for r in bad.collect()} == {(i, reason_of(r)) for i, r, *_ in rows if reason_of(r)}
    assert sorted(r.line_id for r in good.collect()) == [i for i, r, *_ in rows if not reason_of(r)]
    none = badrows.load_manifest_lines(df.limit(0))
    assert none[0].count() == none[1].count() == 0


def test_bad_rows_table(spark):
    base = "/root/testdata/sf0.01"
    got = {(r.line_id, r.reason) for r in problems.p2_found(spark, base).collect()}
    rows = spark.read.parquet(f"{base}/manifest_lines.parquet").select("line_id", "raw").collect()
    assert got == {(r.line_id, reason_of(r.raw)) for r in rows if reason_of(r.raw)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="[]()'\", 1.-aN\\\n", max_size=30))
def test_segment_list_never_laxer_than_the_literal(text):
    if text and badrows._PLAIN.fullmatch(text):
        assert literal_ok(text)


def periods_plain(rows):
    by = defaultdict(list)
    for key, s, e in rows:
        if s is not None and e is not None and e > s:
            by[key].append((s, e))
    out = set()
    for key, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(key, "period", s, e) for s, e in merged}
        out |= {(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("block", [7, 50, 10_000])
def test_intervals_random(spark, block):
    import random

    r = random.Random(block)
    rows = [(r.choice(["a", "b", None, "c"]), s, s + r.choice([0, 1, 2, 5, 9, 40, -3])) for s in (r.randrange(300) for _ in range(160))]
    rows += [("hot", i, i + 1) for i in range(0, 400, 3)] + [("nest", 0, 500), ("nest", 10, 20), ("nest", 500, 501), ("x", None, 3), ("x", 1, None)]
    df = spark.createDataFrame([(k, s, e, "clash", 1) for k, s, e in rows], "k string, s long, e long, kind string, block int")
    got = intervals.periods_and_gaps(df, ["k"], "s", "e", block)
    rows_out = [(x.k, x.kind, x.start_ms, x.end_ms) for x in got.collect()]
    assert len(rows_out) == len(set(rows_out)) and set(rows_out) == periods_plain(rows)
    assert intervals.periods_and_gaps(df.limit(0), ["k"], "s", "e", block).count() == 0


def test_clock(spark):
    texts = ["0:00:01.50", "1:2:3", "10:00:00.007", "0:0:1.2", "--:--:--", "", None, "0:00:01.5000", "0:000:01", " 0:00:01", "0:00:01\n", "99999999999999999999:0:0", "0:61:75.1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(intervals.clock_ms(F.col("t")).alias("m"))
    assert [r.m for r in df.collect()] == [1500, 3723000, 36000007, 1200, None, None, None, None, None, None, None, None, 3735100]


def test_times_beyond_timestamps(spark):
    rows = [("a", "9999999999:00:00", "9999999999:00:01"), ("a", "0:00:01", "99999999999999999:00:00"), ("a", "0:00:01", "0:00:02"), ("a", "0:00:00", "2000000000000:00:00"), ("a", "1999999999999:59:59", "2000000000001:00:00")]
    df = spark.createDataFrame([("s", k, a, b) for k, a, b in rows], "session_id string, speaker string, start_time string, end_time string")
    assert [tuple(r)[2:] for r in intervals.speaking(df).collect()] == [("period", 0, 2000000000001 * 3_600_000)]
    one = spark.createDataFrame([("s", *rows[0])], df.schema)
    assert [tuple(r)[2:] for r in intervals.speaking(one).collect()] == [("period", 9999999999 * 3_600_000, 9999999999 * 3_600_000 + 1000)]


def plain_links(transcriptions, files):
    out = Counter()
    for rid, p in transcriptions:
        try:
            models = json.loads(p)["transcript"].items()
        except Exception:
            continue
        for m, v in models:
            v = v.get("segments") if isinstance(v, dict) else [v] if isinstance(v, str) else v
            for i, x in enumerate(v if isinstance(v, list) else []):
                if x is not None:
                    out["segment", rid, m, str(i)] += 1
    for rid, p in files:
        try:
            results = json.loads(p)["results"]
        except Exception:
            continue
        for i, x in enumerate(results):
            x = x if isinstance(x, dict) else {}
            m, a = x.get("metrics"), x.get("alignment")
            for k, v in m.items() if isinstance(m, dict) else ():
                if v is not None:
                    out["metric", rid, str(i), k] += 1
            for j, _ in enumerate(a if isinstance(a, list) else []):
                out["op", rid, str(i), str(j)] += 1
    return out


def test_nested(spark):
    tr = [
        (1, '{"clip_id": "c", "transcript": {"m": [["s", "t"], null, {"text": "u"}], "n": "whole", "o": {"segments": [null, ["s", "v"]], "x": [1]}, "p": null, "q": [], "r": {"segments": "no"}, "": ""}}'),
        (2, None), (3, "{"), (4, "[]"), (5, '{"transcript": null}'), (6, '{"transcript": {"a.b/c": [1, [2, [3]]], "segments": ["x"]}}'), (7, '{"transcript": []}'), (7, '{"transcript": {"d": ["x"]}}'),
        (8, "[" * 5000 + "]" * 5000), (9, '{"transcript": {"m": ["' + "long " * 50_000 + '"]}}'),
    ]
    fi = [
        (1, '{"results": [null, {"metrics": {"wer": 0.1, "cpwer": null, "x": {"value": 1}, "s": "0.2"}, "alignment": [{"op": "match"}, null]}, {"metrics": null}, {"metrics": {}}, {"alignment": "no"}]}'),
        (2, '{"summary": {}}'), (3, ""), (4, None), (5, '{"results": {"a": 1}}'),
    ]
    a = spark.createDataFrame([(r, p, "k", 1) for r, p in tr], "record_id long, payload string, kind string, pre int")
    b = spark.createDataFrame(fi, "record_id long, payload string")
    got = Counter((r.kind, r.record_id, r.parent_key, r.child_key) for r in nested.links(a, b).collect())
    assert got == plain_links(tr, fi)
    assert nested.links(a.limit(0), b.limit(0)).count() == 0


def test_nested_table(spark, base):
    t = [tuple(r) for r in spark.read.parquet(f"{base}/mixture_transcription.parquet").select("record_id", "payload").collect()]
    f = [tuple(r) for r in spark.read.parquet(f"{base}/wer_result_files.parquet").select("record_id", "payload").collect()]
    got = Counter((r.kind, r.record_id, r.parent_key, r.child_key) for r in problems.p5_found(spark, base).collect())
    assert got == plain_links(t, f)


def test_labels_contain(spark):
    nodes = nested.walk({"a": [1, {"b": 2}], "c": None}, nested._trie([("a", ("a",)), ("i", ("a", nested.INDEX)), ("b", ("a", nested.INDEX, nested.KEY))]))
    by = {(n[0], n[5]): n for n in nodes}
    inside = lambda x, y: y[1] < x[1] and y[2] > x[2]
    assert inside(by["b", "b"], by["i", "1"]) and inside(by["i", "0"], by["a", "a"]) and not inside(by["b", "b"], by["i", "0"])


def scalars(x, key=""):
    """(key, text) of every scalar but null."""
    if isinstance(x, dict):
        for k, v in x.items():
            yield from scalars(v, k)
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from scalars(v, str(i))
    elif x is not None:
        yield key, x if isinstance(x, str) else json.dumps(x)


def test_node_tables_hold_every_scalar(spark):
    def read(name):
        return [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").select("record_id", "payload").collect()]

    segment = '{"speaker": "s", "text": "t u", "start": 0.5, "end": 1, "words": [{"word": "t", "at": [1, 2]}, "u"]}'
    tr = [*read("mixture_transcription"), (-1, f'{{"clip_id": "c", "transcript": {{"o": {{"segments": [{segment}, null], "lang": "en"}}, "l": [{segment}, ["s", "v", 1, 2]], "w": "whole", "n": null, "r": {{"segments": "no"}}}}, "host_info": {{"a": {{"b": true}}}}}}')]
    tr += [(-2, '["only", {"x": 1}]'), (-3, '"bare"'), (-4, '{"transcript": {"m": ["\\ud800"]}}')]
    fi = [*read("wer_result_files"), (-1, '{"model": "m", "summary": {"n": [1, {"k": false}]}, "timestamp": "z", "results": [null, "odd", {"clip_id": "c", "error": "e", "metrics": {"wer": 0.5, "cpwer": {"value": 1}}, "alignment": [{"op": "sub", "at": [1, 2]}, "ins"]}, {"metrics": [3], "alignment": "no"}]}')]
    a, b = (spark.createDataFrame(x, "record_id long, payload string") for x in (tr, fi))
    ours, files = {"record", *nested.TRANSCRIPTION_PARENTS}, {"file", *nested.RESULT_FILE_PARENTS}
    rows = nested.all_nodes(a, b).collect()
    for names, src in ((ours, tr), (files, fi)):
        got = Counter((r.record_id, r.node_key, r.value) for r in rows if r.node_type in names and r.value is not None and (r.node_type != "segment" or r.parent_kind != "string"))
        assert got == Counter((i, k, v.replace("\ud800", "\ufffd")) for i, p in src if p for k, v in scalars(json.loads(p)))
    # each child lies in the parent it names, and segments, metric values and steps are those of p5_found
    at = {(r.node_type, r.record_id, r.pre): r for r in rows}
    for r in rows:
        up = (nested.TRANSCRIPTION_PARENTS | nested.RESULT_FILE_PARENTS).get(r.node_type)
        p = at[up, r.record_id, r.parent_pre] if up else None
        assert (p is None and r.parent_key is None) or (p.pre <= r.pre and p.post >= r.post and p.node_key == r.parent_key)
    got = Counter((r.node_type, r.record_id, r.parent_key, r.node_key) for r in rows if r.node_type == "op" or (r.node_type in ("segment", "metric") and r.kind != "null"))
    assert got == plain_links(tr, fi)
    words = [(r.parent_key, r.node_key, r.value) for r in rows if r.node_type == "word" and r.record_id == -1]
    assert sorted(words, key=str) == [("0", "0", None), ("0", "0", None), ("0", "1", "u"), ("0", "1", "u")]
