"""Scoring of hypotheses against references: one row per (clip, model) with status and metrics.

References and hypotheses meet in two left joins off the grid of clips and models, so that what is missing becomes an
error row. The plain rate stays in the JVM; the speaker-attributed rates and the exact two-stream distance run in
Arrow batches of a Python worker, after a repartition by clip so that few input files still use all cores.

Defined results: a missing hypothesis is reported before a missing reference; a hypothesis without a word scores 1.0
on every chosen metric; a reference without a word gives an error row; a kernel that fails gives an error row with its
message and no metrics; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, text
from ..functions.clip import METRICS
from ..session import spread

#: Names under which a metric may be asked for.
ALIASES = {"mrs": "mrs_wer", "mrswer": "mrs_wer", "dss_wer": "mrs_wer", "orc": "orc_wer", "orcwer": "orc_wer", "cp": "cpwer", "cp_wer": "cpwer"}


def choose_metrics(names: str | None) -> list[str]:
    """The metrics of a comma-separated list; all for none, `all` and `*`; ValueError for others."""
    if not names or not names.strip():
        return list(METRICS)
    out = []
    for n in (x.strip().lower() for x in names.split(",") if x.strip()):
        if n in ("all", "*"):
            return list(METRICS)
        m = ALIASES.get(n, n)
        if m not in METRICS:
            raise ValueError(f"unknown metric {n}")
        out.append(m)
    return [m for m in METRICS if m in out]


def method_label(metrics: list[str]) -> str:
    wer, mrs = "wer" in metrics, "mrs_wer" in metrics
    return "both" if wer and mrs else "wer_only" if wer else "mrs_wer_only" if mrs else "n/a"


def score_pair(ref: list[tuple], hyp: list[tuple], metrics: list[str], mode: str = "exact") -> dict[str, float]:
    """The chosen metrics but the plain rate of one pair of (speaker, text) lists."""
    out: dict[str, float] = {}
    words = kernels.words_n1
    streams = lambda segs: {k: " ".join(w for t in v for w in words(t)) for k, v in kernels.by_speaker(segs).items()}
    r = {k: v for k, v in streams(ref).items() if v.strip()}
    h = {k: v for k, v in streams(hyp).items() if v.strip()}
    if "mrs_wer" in metrics:
        chain = [v.split() for v in streams(ref).values()][:2]
        chain += [[]] * (2 - len(chain))
        flat = [w for _, t in hyp for w in words(t)]
        if mode == "beam":
            out["mrs_wer"] = kernels.Beam(64, 0.4, 16, 160_000).distance(*chain, flat) / (len(chain[0]) + len(chain[1]))
        else:
            out["mrs_wer"] = kernels.dss_wer(*chain, flat)
    if "cpwer" in metrics:
        out["cpwer"] = kernels.cp_wer([*r.items()], [*h.items()])
    if "orc_wer" in metrics:
        out["orc_wer"] = kernels.orc_wer([*r.values()], [*h.values()])
    return out


def evaluate(refs: DataFrame, hyps: DataFrame, models: list[str], metrics: list[str] | None = None, mode: str = "exact", partitions: int | None = None) -> DataFrame:
    """clip_id, model_name, status, error, ref_segments, hyp_segments, is_segmented, the metrics, wer_method, metric_type.

    refs: clip_id, segments; hyps: clip_id, model_name, segments (array of struct with speaker and text), each unique;
    models: their names, a short list that every clip is set against. The clips are those of the hypotheses and the references together.
    """
    metrics = metrics or list(METRICS)
    clips = refs.select("clip_id").unionByName(hyps.select("clip_id")).where("clip_id is not null").distinct()
    grid = clips.select("clip_id", F.explode(F.array(*map(F.lit, dict.fromkeys(models)))).alias("model_name"))
    rows = grid.join(hyps.select("clip_id", "model_name", F.col("segments").alias("hyp")), ["clip_id", "model_name"], "left")
    rows = rows.join(refs.select("clip_id", F.col("segments").alias("ref")), "clip_id", "left")
    rows = rows.repartition(partitions, "clip_id", "model_name") if partitions else rows.repartition("clip_id", "model_name")
    flat = lambda c: F.flatten(F.transform(c, lambda s: text.n1(s["text"])))
    rows = rows.withColumn("rw", flat(F.col("ref"))).withColumn("hw", flat(F.col("hyp")))
    missing = F.when(F.col("hyp").isNull(), "Hypothesis not found").when(F.col("ref").isNull(), "Reference not found")
    rows = rows.withColumn("missing", missing).withColumn("empty", F.size("hw") == 0)
    if "wer" in metrics:
        rows = rows.withColumn("plain", text.error_rate(F.col("rw"), F.col("hw")))
    else:
        rows = rows.withColumn("plain", F.lit(None).cast("double"))
    python = [m for m in metrics if m != "wer"]

    schema = ", ".join([*(f"{m} double" for m in METRICS if m != "wer"), "failure string"])

    @F.pandas_udf(schema)
    def slow(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ref, hyp in pairs:
            out = []
            for r, h in zip(ref, hyp):
                one: dict = {}
                if r is not None and h is not None:
                    as_pairs = lambda segs: [(str(s["speaker"]), s["text"] or "") for s in segs]
                    try:
                        one = score_pair(as_pairs(r), as_pairs(h), python, mode)
                    except (ArithmeticError, ValueError, KeyError) as e:
                        one = {"failure": f"{type(e).__name__}: {e}"}
                out.append(one)
            frame = pd.DataFrame(out, columns=[*(m for m in METRICS if m != "wer"), "failure"], index=range(len(out)))
            yield frame.astype({m: "float64" for m in METRICS if m != "wer"} | {"failure": object})

    live = F.col("missing").isNull() & ~F.col("empty")
    if python:
        pair = lambda c: F.when(live, F.transform(c, lambda s: F.struct(s["speaker"].alias("speaker"), s["text"].alias("text"))))
        rows = rows.withColumn("slow", slow(pair(F.col("ref")), pair(F.col("hyp"))))
    else:
        rows = rows.withColumn("slow", F.struct(*[F.lit(None).cast("double").alias(m) for m in METRICS if m != "wer"], F.lit(None).cast("string").alias("failure")))
    no_words = F.when(live & (F.size("rw") == 0), "Reference has no words")
    error = F.coalesce("missing", no_words, F.when(live, F.col("slow.failure")))

    def metric(m: str) -> Column:
        if m not in metrics:
            return F.lit(None).cast("double").alias(m)
        value = F.col("plain") if m == "wer" else F.col(f"slow.{m}")
        return F.when(error.isNull(), F.when(F.col("empty"), 1.0).otherwise(value)).alias(m)

    n = lambda c: F.when(F.col("missing").isNull(), F.size(c))
    seg = F.col("missing").isNull() & (F.size("hyp") > 1)
    return rows.select(
        "clip_id", "model_name", F.when(error.isNull(), "success").otherwise("error").alias("status"), error.alias("error"),
        n("ref").alias("ref_segments"), n("hyp").alias("hyp_segments"), F.when(F.col("missing").isNull(), seg).alias("is_segmented"),
        *[metric(m) for m in METRICS], F.lit(method_label(metrics)).alias("wer_method"),
        F.when(F.col("missing").isNull(), F.when(seg, "segmented").otherwise("not segmented")).alias("metric_type"),
    )


ALIGNMENT = "rate double, distance int, steps array<struct<op: string, ref: string, hyp: string>>"


def alignment(ref: Column, hyp: Column, variant: int = 1) -> Column:
    """struct<rate, distance, steps> of two word arrays."""

    @F.pandas_udf(ALIGNMENT)
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for r, h in pairs:
            out = []
            for a, b in zip(r, h):
                rate, dist, steps = kernels.align([] if a is None else list(a), [] if b is None else list(b), variant)
                out.append((rate, dist, [{"op": o, "ref": x, "hyp": y} for o, x, y in steps]))
            yield pd.DataFrame(out, columns=["rate", "distance", "steps"])

    return run(ref, hyp)


TWO_STREAMS = "distance int, steps array<struct<op: string, chain: string, ref: string, hyp: string>>"


def two_stream_alignment(a: Column, b: Column, hyp: Column, mode: str = "exact") -> Column:
    """struct<distance, steps> of the words of two chains and of a hypothesis; the distance is null where a bounded search
    did not arrive."""

    @F.pandas_udf(TWO_STREAMS)
    def run(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        beam = kernels.Beam(64, 0.4, 16, 160_000)
        for part in rows:
            out = []
            for words in zip(*part):
                x, y, h = ([] if w is None else list(w) for w in words)
                if mode == "beam":
                    cost, steps = beam.align(x, y, h)
                else:
                    steps = kernels.dss_align(x, y, h)
                    cost = sum(s[0] != "match" for s in steps)
                out.append((None if cost == float("inf") else int(cost), [dict(zip(("op", "chain", "ref", "hyp"), s)) for s in steps]))
            yield pd.DataFrame(out, columns=["distance", "steps"]).astype({"distance": "Int32"})

    return run(a, b, hyp)


HYPOTHESES = "record_id long, clip_id string, model_name string, segments array<struct<speaker: string, text: string>>"


def hypotheses(transcription: DataFrame) -> DataFrame:
    """clip_id, model_name, segments of the payloads; of a clip delivered several times the latest record counts per
    model, of equal times the larger record_id. Records without a clip are left out."""
    from .nested import payload_of, segment_text, segments_of

    def speaker(x: object) -> str | None:
        x = x.get("speaker") if isinstance(x, dict) else x[0] if isinstance(x, list) and x else None
        return None if x is None else str(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, cid, payload, at in b.itertuples(index=False):
                root, _ = payload_of(payload)
                models = root.get("transcript") if isinstance(root, dict) else None
                if not isinstance(models, dict):
                    continue
                out += [(rid, cid, m, [{"speaker": speaker(x), "text": segment_text(x)} for _, x in segments_of(v)], at) for m, v in models.items()]
            yield pd.DataFrame(out, columns=["record_id", "clip_id", "model_name", "segments", "received_at"]).astype({"record_id": "int64", "received_at": "datetime64[us]"})

    src = spread(transcription.select("record_id", "clip_id", "payload", "received_at"), "record_id").where("clip_id is not null and payload is not null and record_id is not null")
    rows = src.mapInPandas(run, HYPOTHESES + ", received_at timestamp")
    return rows.groupBy("clip_id", "model_name").agg(F.max_by("segments", F.struct("received_at", "record_id")).alias("segments"))


def real_scores(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """clip_id, model_name, wer, orc_wer, counts and is_segmented over raw words; the combination rate only where the
    hypothesis has several segments and null where kernels.orc_wer refuses the pair. Segments without text are left out, pairs without reference words too."""
    clean = lambda c: F.filter(c, lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    rows = refs.select("clip_id", clean("segments").alias("ref")).join(hyps.select("clip_id", "model_name", clean("segments").alias("hyp")), "clip_id")
    raw = lambda c: F.filter(F.flatten(F.transform(c, lambda s: F.split(s["text"], r"\s+"))), lambda w: w != "")
    rows = rows.withColumn("rw", raw("ref")).withColumn("hw", raw("hyp")).where(F.size("rw") > 0)

    @F.pandas_udf("double")
    def orc(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ref, hyp in pairs:
            out = []
            for r, h in zip(ref, hyp):
                if h is None:
                    out.append(None)
                    continue
                join = lambda segs: [" ".join(v) for v in kernels.by_speaker([(str(s["speaker"]), s["text"]) for s in segs]).values()]
                try:
                    out.append(kernels.orc_wer(join(r), join(h)))
                except ValueError:
                    out.append(None)
            yield pd.Series(out, dtype="float64")

    several = F.size("hyp") > 1
    pair = lambda c: F.when(several, F.transform(c, lambda s: F.struct(s["speaker"].alias("speaker"), s["text"].alias("text"))))
    return rows.select(
        "clip_id", "model_name", text.error_rate(F.col("rw"), F.col("hw")).alias("wer"), orc(pair(F.col("ref")), pair(F.col("hyp"))).alias("orc_wer"),
        F.size("hyp").alias("hyp_segment_count"), F.size("ref").alias("ref_segment_count"), several.alias("is_segmented_hypothesis"),
    )


def timing_rollup(timings: DataFrame) -> DataFrame:
    """Per model: runs, samples, seconds, seconds per sample and mean real-time factor."""
    return timings.groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("sample_count").alias("samples"), F.sum("processing_sec").alias("seconds"),
        F.try_divide(F.sum("processing_sec"), F.sum("sample_count")).alias("sec_per_sample"), F.avg("rtfx").alias("mean_rtfx"),
    )


def accuracy_and_speed(scores: DataFrame, timings: DataFrame, value: str = "wer") -> DataFrame:
    """Mean score beside the timing of each model that has both."""
    return scores.where(F.col(value).isNotNull()).groupBy("model").agg(F.avg(value).alias("mean_score")).join(timing_rollup(timings), "model")
