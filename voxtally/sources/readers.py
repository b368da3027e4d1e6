"""Readers for manifests, hypotheses, score files, timings, utterances and audio listings.

Schemas are fixed; files are read by Spark's own formats. JSON whose keys are data (clips, models) is read with map
types, so nothing is inferred. Unreadable JSON gives no rows but is listed by unreadable(); missing files give none where
the reader is lenient.
"""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions import clip, literal
from ..operators import badrows

MANIFEST = "clip_id string, audio_path string, transcript string, overlap_ratio_target double, overlap_ratio_actual double, max_speakers int, snr_db double, noise_type string, overlap_mask_path string, source_files string, noise_files string"
#: Numbers are read as text and cast, so that one in quotes counts and one of another kind is null without its neighbours.
METRICS = "struct<wer: string, mrs_wer: string, cpwer: string, orc_wer: string>"
RESULT = f"struct<clip_id: string, model_name: string, status: string, ref_segments: string, hyp_segments: string, is_segmented: string, metrics: {METRICS}, wer_method: string, metric_type: string, error: string>"
TIMING = "struct<model: string, sample_count: long, duration_sec: double, total_processing_time_sec: double, sec_per_audio: double, rtfx: double>"


def _texts(spark: SparkSession, path: str, lenient: bool = False, lines: bool = False) -> DataFrame:
    """value, file: whole files, one task a file, or with `lines` the lines of files that hold one JSON text on each,
    which is the form for large data."""
    try:
        return spark.read.text(path, wholetext=not lines).select("value", F.col("_metadata.file_path").alias("file"))
    except AnalysisException:
        if lenient:
            return spark.createDataFrame([], "value string, file string")
        raise


def unreadable(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, n_chars of the JSON texts that cannot be read and so give no rows elsewhere."""
    return _texts(spark, path, lines=lines).where((F.trim("value") != "") & F.try_parse_json("value").isNull()).select("file", F.length("value").alias("n_chars"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV with header; quoted fields may hold line breaks and doubled quotes. An empty field is null, a quoted
    empty one an empty text (null in a column of numbers)."""
    null = uuid.uuid4().hex  # what the parser puts for an empty field; with "" it could not tell the two apart
    # the last escape is NUL by default, which would drop that character from quoted fields
    return spark.read.csv(path, schema=MANIFEST, header=True, multiLine=True, quote='"', escape='"', charToEscapeQuoteEscaping='"', nullValue=null, mode="PERMISSIVE")


def manifest_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The wanted columns of a manifest that it has, with labels of overlap and noise level where their columns are."""
    m = manifest(spark, path)
    have = [c for c in columns if c in m.columns]
    out = m.select(*have)
    if "snr_db" in have:
        out = out.withColumn("snr_label", F.when(F.col("snr_db").isNull(), "clean").otherwise(clip.general(F.col("snr_db"))))
    if "overlap_ratio_target" in have:
        out = out.withColumn("ovr_label", F.when(F.col("overlap_ratio_target").isNull(), "unknown").otherwise(F.format_string("%.2f", "overlap_ratio_target")))
    return out


def references(rows: DataFrame, order: str | None = None, strict: bool = False) -> DataFrame:
    """clip_id, segments of manifest rows: ids trimmed, blank ids dropped, of repeated clips the last by `order` wins.
    Unreadable transcripts give no segments or, if strict, fail."""
    r = rows.withColumn("clip_id", F.trim("clip_id")).where("clip_id <> ''")
    cols = r.groupBy("clip_id").agg(F.max_by("transcript", order).alias("transcript")) if order else r.dropDuplicates(["clip_id"]).select("clip_id", "transcript")
    return cols.select("clip_id", literal.parse_transcript(F.col("transcript"), strict).alias("segments"))


def reference_texts(rows: DataFrame) -> DataFrame:
    """clip_id, text: the segments' texts joined; clips without text are left out."""
    t = F.filter(F.transform("segments", lambda s: s["text"]), lambda x: F.trim(x) != "")
    return references(rows).select("clip_id", F.array_join(t, " ").alias("text")).where("text <> ''")


def manifest_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows with reason) of a headerless manifest without line breaks inside fields."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("raw"))
    return badrows.load_manifest_lines(lines)


def segment_list(value: Column) -> Column:
    """array<segment> from an array of (speaker, text[, start, end]) arrays of strings."""
    return F.transform(
        value,
        lambda x, i: F.struct(
            i.cast("int").alias("seg_no"), F.get(x, F.lit(0)).alias("speaker"), F.coalesce(F.get(x, F.lit(1)), F.lit("")).alias("text"),
            F.get(x, F.lit(2)).try_cast("double").alias("start"), F.get(x, F.lit(3)).try_cast("double").alias("end"),
        ),
    )


def hypotheses(spark: SparkSession, path: str, lenient: bool = True, lines: bool = False) -> DataFrame:
    """clip_id, model_name, segments from one JSON object keyed by clip, or from one on each line."""
    schema = "map<string, struct<clip_id: string, transcript: map<string, array<array<string>>>>>"
    rows = _texts(spark, path, lenient, lines).select(F.explode(F.from_json("value", schema)).alias("clip", "v"))
    rows = rows.select(F.coalesce("v.clip_id", "clip").alias("clip_id"), F.explode("v.transcript").alias("model_name", "s"))
    return rows.where("s is not null").select("clip_id", "model_name", segment_list(F.col("s")).alias("segments"))


def results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Flat score rows of result files, or of lines that hold a file's content each; the model is the row's, else the file's, else part of the file name."""
    schema = f"struct<model: string, results: array<{RESULT}>, timestamp: string>"
    f = _texts(spark, path, lines=lines).select("file", F.from_json("value", schema).alias("j"))
    stem = F.regexp_extract("file", r"([^/]+?)(?:_wer_results)?\.json$", 1)
    stem = F.regexp_replace(stem, r"^WER_results_", "")
    rows = f.select("file", "j.model", F.posexplode("j.results").alias("file_pos", "r"))
    cast = lambda c, t: F.col(f"r.{c}").try_cast(t).alias(c.split(".")[-1])
    return rows.select(
        "file", "file_pos", F.coalesce("r.model_name", "model", stem).alias("model"), "r.clip_id", "r.status", cast("ref_segments", "int"), cast("hyp_segments", "int"), cast("is_segmented", "boolean"),
        "r.wer_method", "r.metric_type", "r.error", *[cast(f"metrics.{m}", "double") for m in clip.METRICS],
    )


def real_evaluation(spark: SparkSession, path: str, models: list[str] = clip.MODELS[:4]) -> DataFrame:
    """clip_id, model, wer, orc_wer and counts from a by-clip evaluation; other models are left out."""
    schema = "struct<by_clip: map<string, map<string, struct<wer: double, orc_wer: double, score: double, hyp_segment_count: int, ref_segment_count: int, is_segmented_hypothesis: boolean>>>>"
    rows = _texts(spark, path).select(F.explode(F.from_json("value", schema)["by_clip"]).alias("clip_id", "m")).select("clip_id", F.explode("m").alias("model", "x"))
    return rows.where(F.col("model").isin(*models)).select("clip_id", "model", F.coalesce("x.wer", "x.score").alias("wer"), "x.orc_wer", "x.hyp_segment_count", "x.ref_segment_count", "x.is_segmented_hypothesis")


def timings(spark: SparkSession, path: str) -> DataFrame:
    """model, sample_count, processing_sec, sec_per_audio, rtfx; missing figures follow from the others. Rows without
    model, time or samples are left out. The legacy flat map transcribe_<model>_<ids> -> seconds counts the ids, which
    are joined by `_-` in its keys, and has no audio length."""
    schema = f"struct<sample_size: long, total_audio_duration_sec: double, results: array<{TIMING}>>"
    t = _texts(spark, path)
    new = t.select(F.from_json("value", schema).alias("j")).select("j.total_audio_duration_sec", F.explode("j.results").alias("r"))
    sec = F.coalesce("r.total_processing_time_sec", "r.duration_sec")
    new = new.select(
        F.col("r.model").alias("model"), F.col("r.sample_count").alias("sample_count"), sec.alias("processing_sec"),
        F.coalesce("r.sec_per_audio", F.try_divide(sec, F.col("r.sample_count"))).alias("sec_per_audio"), F.coalesce("r.rtfx", F.try_divide(F.col("total_audio_duration_sec"), sec)).alias("rtfx"),
    )
    old = t.where(F.get_json_object("value", "$.results").isNull()).select(F.explode(F.from_json("value", "map<string, double>")).alias("k", "s")).where(F.col("k").startswith("transcribe_"))
    name, ids = F.regexp_extract("k", r"^transcribe_([^_]+)_", 1), F.regexp_replace("k", r"^transcribe_[^_]+_", "")
    count = F.size(F.filter(F.split(ids, "_-"), lambda x: x != "")).cast("long")
    old = old.select(name.alias("model"), count.alias("sample_count"), F.col("s").alias("processing_sec"), F.try_divide("s", count).alias("sec_per_audio"), F.lit(None).cast("double").alias("rtfx"))
    return new.unionByName(old).where("model <> '' and sample_count > 0 and processing_sec is not null")


def utterances(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """session_id, speaker, words, start, end (seconds) of utterance rows whose end is after the start."""
    schema = "start_time string, end_time string, speaker string, words string, session_id string, ref string, location string"
    u = spark.read.schema(schema).json(path, multiLine=not lines)
    u = u.withColumn("start", clip.clock_seconds(F.col("start_time"))).withColumn("end", clip.clock_seconds(F.col("end_time")))
    return u.where("end > start").select(F.coalesce("session_id", F.lit("S01")).alias("session_id"), "speaker", "words", "ref", "location", "start", "end")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def audio_files(spark: SparkSession, path: str, noise: bool = False) -> DataFrame:
    """key, file: audio files below a folder; the key is the parent folder or, for noise, its first letter in upper case."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{wav,flac}").load(path).select(F.col("path").alias("file"))
    parent = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    return f.select((F.upper(F.substring(parent, 1, 1)) if noise else parent).alias("key"), "file")


def id_texts(spark: SparkSession, path: str) -> DataFrame:
    """id, text of lines `id text`."""
    p = F.split("value", r"\s+", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(p, F.lit(0)).alias("id"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("text"))


def file_texts(spark: SparkSession, path: str) -> DataFrame:
    """id (file stem without a microphone suffix), text of files that hold one utterance each."""
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1), r"_mic[123]$", "")
    return _texts(spark, path).select(stem.alias("id"), F.regexp_replace("value", r"\A\s+|\s+\z", "").alias("text"))


def config(path: str) -> dict:
    """The factor grid of a YAML file, read on the driver; yaml is an optional dependency."""
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def factor_grid(spark: SparkSession, overlaps: list[float], speakers: list[int], snrs: list[float | None], noises: list[str], per_cell: int = 1) -> DataFrame:
    """One row per cell and repetition; the levels are a few values each, exploded from one row."""
    arr = lambda v, t: F.array(*[F.lit(x).cast(t) for x in v])
    g = spark.range(1).select(F.explode(arr(overlaps, "double")).alias("overlap_ratio"))
    g = g.select("*", F.explode(arr(speakers, "int")).alias("max_speakers")).select("*", F.explode(arr(snrs, "double")).alias("snr_db"))
    return g.select("*", F.explode(arr(noises, "string")).alias("noise_type")).select("*", F.explode(F.sequence(F.lit(1), F.lit(per_cell))).alias("repetition"))


def clip_id(variant: Column, overlap: Column, speakers: Column, snr: Column, noise: Column) -> Column:
    return F.format_string("mix_%07d_%.2f_%d_%s_%s", variant, overlap, speakers, F.coalesce(clip.general(snr), F.lit("None")), noise)


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


SEGMENTS: T.DataType = literal.SEGMENTS
