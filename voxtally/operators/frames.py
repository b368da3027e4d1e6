"""The analysis frames that the reports read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip
from ..functions.clip import METRICS


def finite(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def clip_scores(results: DataFrame) -> DataFrame:
    """One row per result: repeated deliveries (equal but for loaded_at) once, NaN as null, the parts of the id.

    Deduplication is by all columns kept; the shuffle key is the result's id, which no hot clip can skew.
    """
    once = results.select(
        "result_id", "clip_id", F.col("model_name").alias("model"), "status", finite(F.col("wer")).alias("wer"),
        finite(F.col("metrics.mrs_wer")).alias("mrs_wer"), finite(F.col("metrics.cpwer")).alias("cpwer"), finite(F.col("metrics.orc_wer")).alias("orc_wer"),
        "ref_segments", "hyp_segments", "is_segmented", "wer_method", "metric_type", "error", "scored_at",
    ).dropDuplicates(["result_id"])
    return once.withColumns(clip.parse(F.col("clip_id"))).withColumn("matched", clip.matched(F.col("clip_id")))


def successful(scores: DataFrame) -> DataFrame:
    return scores.where("status = 'success'")


def error_frame(scores: DataFrame, include_failed: bool = True) -> DataFrame:
    """The score by priority orc, cp, plain with the name of the metric it came from, `unknown` where none is there."""
    rows = scores if include_failed else successful(scores)
    name = F.when(F.col("orc_wer").isNotNull(), "orc_wer").when(F.col("cpwer").isNotNull(), "cpwer").when(F.col("wer").isNotNull(), "wer").otherwise("unknown")
    return rows.withColumn("error_value", F.coalesce("orc_wer", "cpwer", "wer")).withColumn("error_metric", name)


def paired(scores: DataFrame, value: str, models: list[str]) -> DataFrame:
    """clip_id and one column per model: the mean of repeated results, to nine places so that
    equal means tie whatever the order of summation; clips that lack a model are left out."""
    rows = scores.where(F.col(value).isNotNull() & F.col("clip_id").isNotNull()).where(F.col("model").isin(*models))
    return rows.groupBy("clip_id").pivot("model", models).agg(F.round(F.avg(value), 9)).dropna(subset=models)


def dedup_clean(scores: DataFrame) -> DataFrame:
    """Clean rows once per (model, base mixture, overlap, speakers): the first by base, overlap, noise, clip and
    result; noisy rows unchanged. noise_type becomes `clean` there, noise_type_raw keeps the value."""
    from pyspark.sql import Window

    keys = ["model", "base_mixture_id", "overlap_ratio", "max_speakers"]
    w = Window.partitionBy(*keys).orderBy("noise_type", "clip_id", "result_id")
    raw = scores.withColumn("noise_type_raw", F.col("noise_type"))
    clean = raw.where("snr_db is null").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    clean = clean.withColumn("noise_type", F.lit("clean")).withColumn("is_clean_effective_sample", F.lit(True))
    return clean.unionByName(raw.where("snr_db is not null").withColumn("is_clean_effective_sample", F.lit(False)))


def unpivot(scores: DataFrame, keys: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """keys, metric, value."""
    return scores.select(*keys, *metrics).unpivot(keys, metrics, "metric", "value")
