"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.problems import SEGMENTS
from ..session import table
from . import bpe, leak, pii, quantile, repetition, topn

PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return topn.worst_results(table(spark, base, "wer_results"))


def p3_percentiles(spark: SparkSession, base: str) -> DataFrame:
    return quantile.score_percentiles(table(spark, base, "wer_results"), table(spark, base, "mixture_meta"), PERCENTILES)


def p3_within(spark: SparkSession, base: str) -> DataFrame:
    return quantile.within_bound(table(spark, base, "wer_results"), table(spark, base, "mixture_meta"), PERCENTILES)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return repetition.looping_texts(table(spark, base, "worst_wer_examples"), table(spark, base, "mixture_transcription"))


def p6_outliers(spark: SparkSession, base: str) -> DataFrame:
    return repetition.outliers(table(spark, base, "worst_wer_examples"), table(spark, base, "mixture_transcription"))


def p6_shares(spark: SparkSession, base: str) -> DataFrame:
    return repetition.shares(table(spark, base, "worst_wer_examples"), table(spark, base, "mixture_transcription"))


def p7_ids(spark: SparkSession, base: str) -> DataFrame:
    return bpe.encode_documents(table(spark, base, "documents"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return leak.leaked(table(spark, base, "documents"), table(spark, base, "eval_items"), table(spark, base, "name_list"))


def p8_reparameterised(spark: SparkSession, base: str) -> DataFrame:
    return leak.reparameterised(table(spark, base, "documents"), table(spark, base, "eval_items"), table(spark, base, "name_list"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return pii.mentions(table(spark, base, "documents"), table(spark, base, "name_list"))


def p9_masked(spark: SparkSession, base: str) -> DataFrame:
    return pii.masked(table(spark, base, "documents"), table(spark, base, "name_list"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p3_percentiles": p3_percentiles, "p3_within": p3_within, "p6_found": p6_found, "p6_outliers": p6_outliers, "p6_shares": p6_shares, "p7_ids": p7_ids,
    "p8_found": p8_found, "p8_reparameterised": p8_reparameterised, "p9_found": p9_found, "p9_masked": p9_masked,
}

#: Words and repeated words of every text: window by window, the first of equal ones left out.
_SHARES = SEGMENTS + r""", h AS (SELECT 'hypothesis' AS text_source, example_id AS row_id, model, coalesce(hypothesis, '') AS text FROM worst_wer_examples
  UNION ALL SELECT 'transcript', l.record_id, l.model, coalesce(g.text, '') FROM l LEFT JOIN (SELECT record_id, model, string_agg(CASE json_type(x) WHEN 'VARCHAR' THEN x ->> '$' WHEN 'ARRAY' THEN CASE WHEN json_type(x, '$[1]') = 'VARCHAR' THEN x ->> '$[1]' ELSE '' END WHEN 'OBJECT' THEN CASE WHEN json_type(x, '$.text') = 'VARCHAR' THEN x ->> '$.text' ELSE '' END ELSE '' END, ' ' ORDER BY i) AS text FROM seg GROUP BY ALL) g USING (record_id, model)),
p AS (SELECT row_number() OVER () AS id, * FROM h), w AS (SELECT *, list_transform(regexp_extract_all(text, '\p{L}+'), lambda x: lower(x)) AS w FROM p),
n AS (SELECT id, i, hash(w[i:i + 4]) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
b AS (SELECT id, i FROM (SELECT id, i, min(i) OVER (PARTITION BY id, g) AS first FROM n) WHERE i > first),
c AS (SELECT id, count(DISTINCT i + k) AS r FROM b, (SELECT unnest(range(0, 5)) AS k) GROUP BY id)
SELECT text_source, row_id, model, len(w)::INTEGER AS n_words, coalesce(r, 0)::INTEGER AS n_repeated, CASE WHEN len(w) > 0 THEN coalesce(r, 0) / len(w) ELSE 0.0 END AS share FROM w LEFT JOIN c USING (id)
"""

SQL: dict[str, str] = {
    "p6_shares": _SHARES,
    "p6_found": f"SELECT text_source, row_id, model FROM ({_SHARES}) WHERE n_words >= 20 AND n_repeated * 5 >= n_words * 2",
    "p3_within": f"""
WITH v AS (
  SELECT 'wer' AS metric, 'model' AS group_kind, model_name AS group_key, wer AS v FROM wer_results
  UNION ALL SELECT 'wer', 'day', scored_at::DATE::VARCHAR, wer FROM wer_results
  UNION ALL SELECT 'snr_db', 'noise_type', noise_type, snr_db FROM mixture_meta
  UNION ALL SELECT 'overlap_ratio_target', 'noise_type', noise_type, overlap_ratio_target FROM mixture_meta
), n AS (SELECT metric, group_kind, group_key, count(*) AS n FROM v WHERE isfinite(v) GROUP BY ALL)
SELECT metric, group_kind, group_key, p, n, true AS within FROM n, (SELECT unnest({PERCENTILES}::DOUBLE[]) AS p)
""",
    "p1_found": """
WITH c AS (
  SELECT DISTINCT result_id, clip_id, model_name, wer + 0.0 AS wer FROM wer_results
  WHERE status = 'success' AND wer IS NOT NULL AND NOT isnan(wer)
), r AS (
  SELECT 'clip' AS group_kind, clip_id AS group_key, result_id, 3 AS keep,
    row_number() OVER (PARTITION BY clip_id ORDER BY wer DESC, result_id) AS place FROM c WHERE clip_id IS NOT NULL
  UNION ALL
  SELECT 'model', model_name, result_id, 10,
    row_number() OVER (PARTITION BY model_name ORDER BY wer DESC, result_id) FROM c WHERE model_name IS NOT NULL
)
SELECT group_kind, group_key, place, result_id FROM r WHERE place <= keep
""",
}
