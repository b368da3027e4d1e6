import json
import random

from voxtally.functions import kernels
from voxtally.plans import reports


def replay(steps, a, b, h):
    """The steps use up both chains and the hypothesis in order."""
    assert [s[2] for s in steps if s[1] == "A"] == a and [s[2] for s in steps if s[1] == "B"] == b
    assert [s[3] for s in steps if s[3] is not None] == h
    assert all((s[2] == s[3]) == (s[0] == "match") for s in steps if s[0] in ("match", "sub"))
    return sum(s[0] != "match" for s in steps)


def test_two_stream_alignment_is_exact(monkeypatch):
    r = random.Random(3)
    for _ in range(200):
        a, b, h = ([r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(3))
        want = kernels.dss_distance(a, b, h)
        assert replay(kernels.dss_align(a, b, h), a, b, h) == want
        monkeypatch.setattr(kernels, "PLANES", 60)  # halved several times
        assert replay(kernels.dss_align(a, b, h), a, b, h) == want
        monkeypatch.undo()
        cost, steps = kernels.Beam(16).align(a, b, h)
        assert replay(steps, a, b, h) == cost >= want
    assert kernels.dss_align([], [], []) == [] and kernels.Beam().align([], [], ["x"]) == (1.0, [("insert", "H", None, "x")])


def test_summary_files(spark, base, tmp_path):
    assert len(reports.SUMMARY_FILES) == 4 and all(q in reports.QUERIES for names in reports.SUMMARY_FILES.values() for q in names)
    paths = reports.write_summaries(spark, base, str(tmp_path), ["wer_outlier_condition_summary", "worst_wer_examples"])
    outliers, worst = (json.loads(open(p).read()) for p in paths)
    assert list(outliers) == sorted(outliers) and outliers["iqr_outliers"][0]["n"] > 0 and worst["worst_examples"]
