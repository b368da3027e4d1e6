import json
import random

import pytest

from voxtally import session
from voxtally.operators import metrics, nested


def test_deep_reader_reads_as_the_standard_one():
    r = random.Random(1)

    def value(d=0):
        x = r.random()
        if d > 4 or x < 0.4:
            return r.choice([None, True, False, 1, -2.5, 1e30, 'a"b\\ é\ud800', "", 0])
        return [value(d + 1) for _ in range(r.randrange(4))] if x < 0.7 else {r.choice("abcd"): value(d + 1) for _ in range(r.randrange(4))}

    for _ in range(1500):
        v = value()
        t = json.dumps(v, indent=r.choice([None, 1]))
        assert nested.read_deep(t) == v
        i = r.randrange(len(t) + 1)
        u = t[:i] + r.choice('{}[],:"x1 ') + t[i + r.randrange(2) :]
        try:
            want = json.loads(u)
        except ValueError:
            with pytest.raises(ValueError):
                nested.read_deep(u)
        else:
            assert nested.read_deep(u) == want or want != want


DEEP = '{"transcript": {"m": [["s", "hello there"]]}, "other": ' + "[" * 60_000 + "]" * 60_000 + "}"


def test_deep_and_malformed_payloads_are_not_lost(spark):
    rows = [(1, "c1", DEEP), (2, "c2", '{"transcript": {"m": "x y"'), (3, "c3", None), (4, "c4", '{"transcript": {"m": "x y"}, "n": ' + "7" * 6000 + "}"), (5, "c5", "[]")]
    t = spark.createDataFrame(rows, "record_id long, clip_id string, payload string").selectExpr("*", "timestamp'2026-01-01' as received_at")
    f = spark.createDataFrame([(9, '{"results": [{"metrics": {"wer": null, "x": 1}, "alignment": [null, "a"]}]}'), (8, "nope")], "record_id long, payload string")
    got = {tuple(x) for x in nested.links(t, f).collect()}
    assert got == {("segment", 1, "m", "0"), ("segment", 4, "m", "0"), ("metric", 9, "0", "x"), ("op", 9, "0", "0"), ("op", 9, "0", "1")}
    assert {tuple(x) for x in nested.rejects(t, "record_id", "payload").collect()} == {(2, "json"), (3, "null")}
    assert {tuple(x) for x in nested.rejects(f, "record_id", "payload").collect()} == {(8, "json")}
    assert nested.rejects(t.limit(0), "record_id", "payload").count() == 0
    assert {x.clip_id for x in metrics.hypotheses(t).collect()} == {"c1", "c4"}
    assert nested.tables(t, f)["record_field"].where("record_id = 1 and kind = 'array'").count() == 60_000


def test_staged_tables_and_the_shared_folder(spark):
    df = spark.range(10).selectExpr("id", "string(id) as s")
    out = session.staged(df)
    assert sorted(map(tuple, out.collect())) == [(i, str(i)) for i in range(10)] and out.dtypes == df.dtypes


def test_a_cluster_without_a_shared_folder_is_refused():
    class Empty:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Empty()})()})()

        def getConf(self):
            return {}

    fake = type("Spark", (), {"sparkContext": Context(), "conf": {}})()
    with pytest.raises(ValueError):
        session.ensure_shared(fake)
