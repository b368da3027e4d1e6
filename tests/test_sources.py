import json

import pytest
from pyspark.sql import functions as F

from voxtally.plans import files
from voxtally.sources import readers, sinks
from voxtally.streaming import ingest


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "clip_id,audio_path,transcript,overlap_ratio_target,overlap_ratio_actual,max_speakers,snr_db,noise_type,overlap_mask_path,source_files,noise_files\n"
        "mix_0000001_0.14_2_None_T,a.wav,\"[('1', 'SAY \"\"HI\"\"', 0.0, 1.0),\n ('2', 'BYE')]\",0.14,0.1,2,,T,no mask,[],[]\n"
        " c2 ,b.wav,,0.2,0.2,2,7.4,D,no mask,[],[]\n,c.wav,x,0,0,2,,D,no,[],[]\nc2,b.wav,\"[('9', 'late')]\",0.2,0.2,2,7.4,D,no mask,[],[]\n"
    )
    m = readers.manifest(spark, str(tmp_path / "m.csv"))
    assert m.count() == 4 and m.where("clip_id like 'mix%'").first().snr_db is None
    refs = {r.clip_id: [s.text for s in r.segments] for r in readers.references(m.withColumn("n", F.monotonically_increasing_id()), "n").collect()}
    assert refs == {"mix_0000001_0.14_2_None_T": ['SAY "HI"', "BYE"], "c2": ["late"]}
    assert {r.clip_id: r.text for r in readers.reference_texts(m.where("clip_id like 'mix%'")).collect()} == {"mix_0000001_0.14_2_None_T": 'SAY "HI" BYE'}
    cols = readers.manifest_columns(spark, str(tmp_path / "m.csv"), ["clip_id", "snr_db", "overlap_ratio_target", "nope"])
    assert cols.columns == ["clip_id", "snr_db", "overlap_ratio_target", "snr_label", "ovr_label"] and cols.first().snr_label == "clean"
    sinks.manifest_csv(m, str(tmp_path / "out"))
    assert readers.manifest(spark, str(tmp_path / "out")).exceptAll(m).count() == 0


def test_manifest_csv_keeps_empty_texts_and_odd_numbers(spark, tmp_path):
    rows = [("", "", "", 0.1, 0.2, 2, 7.4, "", "", "", ""), (None, None, None, None, None, None, None, None, None, None, None), ("a", '"', "\\", float("nan"), float("inf"), -1, float("-inf"), "\r\n", ' "" ', ",\0", "NaN")]
    spark.createDataFrame(rows, readers.MANIFEST).write.parquet(str(tmp_path / "mixture_meta.parquet"))
    assert sorted(map(str, (tuple(r) for r in files.manifest_csv(spark, str(tmp_path)).collect()))) == sorted(map(str, rows))
    (tmp_path / "m.csv").write_text(",".join(files.COLUMNS) + '\n"c","","","","",,"","D","",,"[]"\n')
    assert tuple(readers.manifest(spark, str(tmp_path / "m.csv")).first()) == ("c", "", "", None, None, None, None, "D", "", None, "[]")


def test_hypotheses_and_results(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"c1": {"clip_id": "c1", "transcript": {"m": [["d", "a b"], ["e", "c"]], "n": []}}, "c2": {"clip_id": "c2", "transcript": {"m": [["d", ""]]}}}))
    h = {(r.clip_id, r.model_name): [(s.seg_no, s.speaker, s.text) for s in r.segments] for r in readers.hypotheses(spark, str(tmp_path / "h.json")).collect()}
    assert h == {("c1", "m"): [(0, "d", "a b"), (1, "e", "c")], ("c1", "n"): [], ("c2", "m"): [(0, "d", "")]}
    assert readers.hypotheses(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{")
    assert readers.hypotheses(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "WER_results_z.json").write_text(json.dumps({"results": [{"clip_id": "c", "status": "success", "metrics": {"wer": 0.5}}, {"clip_id": "d", "status": "error", "error": "no"}]}))
    r = readers.results(spark, str(tmp_path / "WER_results_z.json")).orderBy("file_pos").collect()
    assert [(x.model, x.clip_id, x.wer, x.error) for x in r] == [("z", "c", 0.5, None), ("z", "d", None, "no")]
    (tmp_path / "real.json").write_text(json.dumps({"summary": {}, "by_clip": {"real_0001": {"whisperx": {"wer": 0.4, "orc_wer": 0.5}, "other": {"wer": 1}, "parakeet": {"metric": "wer", "score": 0.3}}}}))
    assert {(x.model, x.wer) for x in readers.real_evaluation(spark, str(tmp_path / "real.json")).collect()} == {("whisperx", 0.4), ("parakeet", 0.3)}


def test_timings_utterances_and_texts(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"sample_size": 2, "total_audio_duration_sec": 100.0, "results": [{"model": "m", "sample_count": 2, "duration_sec": 10.0}, {"sample_count": 1, "duration_sec": 1.0}, {"model": "z", "sample_count": 0, "duration_sec": 1.0}]}))
    (tmp_path / "old.json").write_text(json.dumps({"transcribe_wav2vec2_00001-00002-": 3.2, "other": 1.0}))
    got = sorted((r.model, r.sample_count, r.processing_sec, r.sec_per_audio, r.rtfx) for r in readers.timings(spark, str(tmp_path / "*.json")).collect())
    assert got == [("m", 2, 10.0, 5.0, 10.0), ("wav2vec2", 1, 3.2, 3.2, None)]
    (tmp_path / "u").mkdir()
    (tmp_path / "u/u.json").write_text(json.dumps([{"start_time": "0:00:01.50", "end_time": "0:00:03.00", "speaker": "P01", "words": "hi", "session_id": None}, {"start_time": "0:00:05", "end_time": "0:00:05", "speaker": "P01"}]))
    u = readers.utterances(spark, str(tmp_path / "u")).collect()
    assert [(x.session_id, x.start, x.end) for x in u] == [("S01", 1.5, 3.0)]
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt/p1_mic2.txt").write_text(" one two \n")
    assert [tuple(r) for r in readers.file_texts(spark, str(tmp_path / "txt")).collect()] == [("p1", "one two")]
    (tmp_path / "ids.trans").write_text("84-1 HELLO WORLD\n84-2\n\n")
    assert sorted(tuple(r) for r in readers.id_texts(spark, str(tmp_path / "ids.trans")).collect()) == [("84-1", "HELLO WORLD"), ("84-2", "")]


def test_audio_and_prune(spark, tmp_path):
    for f in ("84/a.wav", "84/b.flac", "traffic/n.wav", "84/x.txt"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_bytes(b"0")
    a = readers.audio_files(spark, str(tmp_path))
    assert sorted((r.key, r.file.rsplit("/", 1)[1]) for r in a.collect()) == [("84", "a.wav"), ("84", "b.flac"), ("traffic", "n.wav")]
    assert {r.key for r in readers.audio_files(spark, str(tmp_path), noise=True).collect()} == {"8", "T"}
    plan = {r.clip_id: r.action for r in sinks.prune_plan(a, spark.createDataFrame([("a",), ("z",)], "clip_id string")).collect()}
    assert plan == {"a": "keep", "b": "extra", "n": "extra", "z": "missing"}


def test_factor_grid(spark):
    g = readers.factor_grid(spark, [0.0, 0.14], [2], [None, 7.4], ["D", "T"], 3)
    assert g.count() == 24 and g.where("snr_db is null").count() == 12
    one = g.select(readers.clip_id(F.lit(47), F.lit(0.14), F.lit(2), F.lit(-5.0), F.lit("T"))).first()[0]
    assert one == "mix_0000047_0.14_2_-5_T"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c", "m", 0.5), ("d", "n", None)], "clip_id string, model_name string, wer double")
    sinks.results_by_model(df, str(tmp_path / "by"))
    assert spark.read.json(str(tmp_path / "by")).count() == 2
    sinks.batch(df, df.groupBy("model_name").count(), str(tmp_path / "batch"))
    assert "timestamp" in spark.read.json(str(tmp_path / "batch/summary")).columns
    sinks.summary_json({"t": spark.createDataFrame([("m", float("nan"))], "k string, v double")}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"t": [{"k": "m", "v": None}]}
    with pytest.raises(ValueError):
        sinks.summary_json({"t": spark.range(sinks.SUMMARY_ROWS + 1)}, str(tmp_path / "s2.json"))
    store = str(tmp_path / "cache")
    sinks.append_new(df, ["clip_id", "model_name"], store, lambda: None)
    sinks.append_new(df.unionByName(df.limit(0)), ["clip_id", "model_name"], store, lambda: spark.read.parquet(store))
    assert spark.read.parquet(store).count() == 2
    assert readers.pending(df, df.limit(1), ["clip_id"]).count() == 1
    steps = spark.createDataFrame([(1, [("match", "a", "a"), ("ins", None, "b")])], "id int, steps array<struct<op:string,ref:string,hyp:string>>")
    sinks.alignment_report(steps, str(tmp_path / "rep"))
    assert spark.read.text(str(tmp_path / "rep")).first()[0].startswith("1\tmatch=1\tsub=0\tins=1\tdel=0")


def test_upsert(spark):
    s = "clip_id string, audio_path string, reference_segments array<string>"
    old = spark.createDataFrame([("a", "1", ["x"]), ("b", "1", None), ("z", "1", ["q"])], s)
    new = spark.createDataFrame([("a", "2", ["y"]), ("b", "2", ["y"]), ("c", "2", ["y"])], s)
    got = sorted(tuple(r) for r in sinks.upsert_clips(old, new, new.select("clip_id")).collect())
    assert got == [("a", "2", ["x"]), ("b", "2", ["y"]), ("c", "2", ["y"])]


def test_ingest(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    (tmp_path / "src").mkdir()
    schema = "clip_id string, model_name string, wer double"
    (tmp_path / "src/1.json").write_text('{"clip_id": "a", "model_name": "m", "wer": 0.1}\n{"clip_id": "a", "model_name": "m", "wer": 0.1}\n')
    ingest.follow(spark, src, schema, out, cp).awaitTermination()
    (tmp_path / "src/2.json").write_text('{"clip_id": "a", "model_name": "m", "wer": 0.9}\n{"clip_id": "b", "model_name": "m", "wer": 0.2}\n')
    ingest.follow(spark, src, schema, out, cp).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("clip_id", "model_name", "wer").collect()) == [("a", "m", 0.1), ("b", "m", 0.2)]


def test_prune_actions(spark, tmp_path):
    for f in ("a.wav", "b.wav", "c.wav"):
        (tmp_path / f).write_bytes(b"x")
    files = spark.createDataFrame([(f"file:{tmp_path}/{f}",) for f in ("a.wav", "b.wav", "c.wav")], "file string")
    wanted = spark.createDataFrame([("a",), ("z",)], "clip_id string")
    assert {(r.clip_id, r.done) for r in sinks.prune(files, wanted).collect()} == {("b", False), ("c", False)} and (tmp_path / "b.wav").exists()
    only_b = files.where("file like '%b.wav'")
    assert [r.done for r in sinks.prune(only_b, wanted, "move", str(tmp_path / "out")).collect()] == [True] and (tmp_path / "out/b.wav").exists()
    assert [r.clip_id for r in sinks.prune(files, wanted, "delete").where("done").collect()] == ["c"] and (tmp_path / "a.wav").exists()
    for bad in (("erase", None), ("move", None), ("delete", "x")):
        with pytest.raises(ValueError):
            sinks.prune(files, wanted, *bad)


def test_unreadable_texts_are_listed(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"results": [{"clip_id": "a", "metrics": {"wer": "0.5", "orc_wer": true}, "ref_segments": "2"}]}\n{"results": [\n\n{"results": []}\n')
    assert [(r.file.rsplit("/", 1)[1], r.n_chars) for r in readers.unreadable(spark, str(tmp_path), lines=True).collect()] == [("x.json", 13)]
    r = readers.results(spark, str(tmp_path), lines=True).collect()
    assert [(x.clip_id, x.wer, x.orc_wer, x.ref_segments) for x in r] == [("a", 0.5, None, 2)]
