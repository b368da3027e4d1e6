"""Registered reports over scores, clips, texts and utterances, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clip, text
from ..operators import frames, ranking, segment, stats, summary
from ..session import cut, spread, table
from ..sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def nudged(sql: str) -> str:
    """The SQL with `round(x, 6)` as r6 does it."""
    out, i = "", 0
    while (at := sql.find("round(", i)) >= 0:
        depth, j, comma = 1, at + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            comma = j if depth == 1 and sql[j] == "," else comma
            j += 1
        inner, places = sql[at + 6 : comma], sql[comma + 1 : j - 1].strip()
        out += sql[i:at] + (f"round(({nudged(inner)}) + 1e-9, 6)" if places == "6" else f"round({nudged(inner)}, {places})")
        i = j
    return out + sql[i:]


def query(sql: str | None = None):
    """Register a function under its name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = nudged(sql)
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six places; the summand moves exact halves, which engines round differently, off the edge."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, for comparison across engines."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scores(spark: SparkSession, base: str) -> DataFrame:
    return frames.clip_scores(table(spark, base, "wer_results"))


#: The analysis frame in SQL.
S = r"""
WITH d AS (
  SELECT DISTINCT result_id, clip_id, model_name AS model, status, CASE WHEN isnan(wer) THEN NULL ELSE wer END AS wer,
    CASE WHEN isnan(metrics.mrs_wer) THEN NULL ELSE metrics.mrs_wer END AS mrs_wer, CASE WHEN isnan(metrics.cpwer) THEN NULL ELSE metrics.cpwer END AS cpwer,
    CASE WHEN isnan(metrics.orc_wer) THEN NULL ELSE metrics.orc_wer END AS orc_wer, ref_segments, hyp_segments, is_segmented, wer_method, metric_type, error, scored_at,
    string_split(clip_id, '_') AS p
  FROM wer_results
), e AS (
  SELECT *, CASE WHEN len(p) >= 6 THEN try_cast(p[3] AS DOUBLE) END AS overlap_ratio, CASE WHEN len(p) >= 6 THEN try_cast(p[4] AS INTEGER) END AS max_speakers,
    CASE WHEN len(p) >= 6 AND p[5] NOT IN ('', 'None') THEN try_cast(p[5] AS DOUBLE) END AS snr_db, CASE WHEN len(p) >= 6 AND p[6] NOT IN ('', 'None') THEN p[6] END AS noise_type,
    CASE WHEN regexp_full_match(p[2], '[0-9]+') THEN try_cast(p[2] AS BIGINT) END AS variant_index
  FROM d
), s AS (
  SELECT * EXCLUDE (p), variant_index // 12 AS base_mixture_id, CASE WHEN snr_db IS NULL THEN 'clean' ELSE format('{:g}', snr_db) END AS snr_label,
    CASE WHEN overlap_ratio IS NULL THEN 'unknown' ELSE format('{:.2f}', overlap_ratio) END AS ovr_label,
    coalesce(regexp_full_match(clip_id, '(mix_[0-9]+_0\.(00|14|20|40)_2_7\.4_T)|(mix_[0-9]+_0\.14_2_(None|7\.4|0|-5)_T)'), false) AS matched
  FROM e
), ok AS (SELECT * FROM s WHERE status = 'success')
"""
DESCRIBE = """count({0}) AS n, round(avg({0}), 6) AS mean, round(median({0}), 6) AS median, round(stddev_samp({0}), 6) AS sd,
  round(min({0}), 6) AS min, round(max({0}), 6) AS max, round(100 * avg(CASE WHEN {0} IS NOT NULL THEN CASE WHEN {0} > 1 THEN 1.0 ELSE 0.0 END END), 6) AS pct_gt_1"""


# -- frames and identifiers -------------------------------------------------------------------------------------------


@query(S + "SELECT result_id, clip_id, variant_index, base_mixture_id, overlap_ratio, max_speakers, snr_db, snr_label, ovr_label, noise_type, matched FROM s")
def clip_id_parts(spark, base):
    return scores(spark, base).select("result_id", "clip_id", "variant_index", "base_mixture_id", "overlap_ratio", "max_speakers", "snr_db", "snr_label", "ovr_label", "noise_type", "matched")


@query(S + "SELECT result_id, coalesce(orc_wer, cpwer, wer) AS error_value, CASE WHEN orc_wer IS NOT NULL THEN 'orc_wer' WHEN cpwer IS NOT NULL THEN 'cpwer' WHEN wer IS NOT NULL THEN 'wer' ELSE 'unknown' END AS error_metric FROM s")
def error_priority(spark, base):
    return frames.error_frame(scores(spark, base)).select("result_id", "error_value", "error_metric")


@query(S + "SELECT model, count(*) AS n_clips FROM (SELECT DISTINCT model, clip_id FROM ok WHERE matched) GROUP BY model")
def matched_clips(spark, base):
    return frames.successful(scores(spark, base)).where("matched").select("model", "clip_id").distinct().groupBy("model").agg(F.count(F.lit(1)).alias("n_clips"))


@query("SELECT clip_id, string_split(clip_id, '_')[3] AS overlap_text, len(source_files) AS n_chars, snr_db IS NULL AS is_clean, CASE WHEN snr_db IS NULL THEN 'No noise' ELSE format('{:g}', snr_db) || ' dB' END AS snr_text FROM mixture_meta")
def manifest_labels(spark, base):
    m = table(spark, base, "mixture_meta")
    return m.select("clip_id", F.get(clip.parts(F.col("clip_id")), F.lit(2)).alias("overlap_text"), F.length("source_files").alias("n_chars"), F.col("snr_db").isNull().alias("is_clean"), F.when(F.col("snr_db").isNull(), "No noise").otherwise(F.concat(clip.general(F.col("snr_db")), F.lit(" dB"))).alias("snr_text"))


@query("""SELECT clip_id, max_by(audio_path, loaded_at) AS audio_path, count(*) AS deliveries FROM mixture_meta GROUP BY clip_id""")
def manifest_last_wins(spark, base):
    return table(spark, base, "mixture_meta").groupBy("clip_id").agg(F.max_by("audio_path", "loaded_at").alias("audio_path"), F.count(F.lit(1)).alias("deliveries"))


@query(S + "SELECT result_id, round(CASE WHEN snr_db IS NULL THEN 0 ELSE pow(10, -snr_db / 20) END, 6) AS z FROM s")
def snr_amplitude(spark, base):
    return scores(spark, base).select("result_id", r6(clip.snr_amplitude(F.col("snr_db"))).alias("z"))


# -- texts ------------------------------------------------------------------------------------------------------------


def _tokens(mode: str, sql: str):
    def run(spark, base):
        d = table(spark, base, "documents")
        w = text.normalize_words(F.col("text"), mode)
        return d.select("doc_id", F.size(w).alias("n_words"), F.md5(F.array_join(w, "|")).alias("digest"))

    run.__name__ = f"tok_{mode}"
    QUERIES[run.__name__] = run
    SQL[run.__name__] = sql


_T = "SELECT doc_id, len(w)::INTEGER AS n_words, md5(array_to_string(w, '|')) AS digest FROM (SELECT doc_id, list_filter({}, lambda x: x <> '') AS w FROM documents)"
_tokens("n1", _T.format(rf"regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_\s\x0b\x85\p{{Z}}]', '', 'g'), '[\s\x0b\x85\p{{Z}}]+')"))
_tokens("n2", _T.format(rf"regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\s\x0b\x85\p{{Z}}]', '', 'g'), '[\s\x0b\x85\p{{Z}}]+')"))


@query(r"SELECT doc_id, len(w)::INTEGER AS n_words, md5(array_to_string(w, '|')) AS digest FROM (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0b\x85\p{Z}]+'), lambda x: x <> ''), lambda x: translate(lower(x), '" + text.PUNCTUATION.replace("'", "''") + r"', '')) AS w FROM documents)")
def tok_n3(spark, base):
    w = text.n3(F.col("text"))
    return table(spark, base, "documents").select("doc_id", F.size(w).alias("n_words"), F.md5(F.array_join(w, "|")).alias("digest"))


_N1 = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda x: x <> '')"
PAIRS = f"""
WITH t AS (
  SELECT example_id, model, clip_id, wer, {_N1.format('reference')} AS r, {_N1.format("coalesce(hypothesis, '')")} AS h FROM worst_wer_examples WHERE reference IS NOT NULL
), u AS (SELECT * FROM t WHERE len(r) > 0),
x AS (
  SELECT example_id, model, len(r)::INTEGER AS n_ref, len(h)::INTEGER AS n_hyp, CASE WHEN len(h) = 0 THEN len(r) ELSE
    list_reduce(list_prepend(range(0, len(h) + 1), list_transform(range(1, len(r) + 1), lambda i: [i])),
      lambda prev, cur: list_reduce(list_prepend([cur[1]], list_transform(range(1, len(h) + 1), lambda j: [j])),
        lambda acc, jj: list_append(acc, least(acc[len(acc)] + 1, prev[jj[1] + 1] + 1, prev[jj[1]] + CASE WHEN r[cur[1]] = h[jj[1]] THEN 0 ELSE 1 END))))[-1] END AS dist
  FROM u
)
"""


def pair_errors(spark, base) -> DataFrame:
    w = spread(table(spark, base, "worst_wer_examples").where("reference is not null"), "example_id")
    w = w.select("example_id", "model", text.n1(F.col("reference")).alias("r"), text.n1(F.col("hypothesis")).alias("h")).where(F.size("r") > 0)
    return w.select("example_id", "model", F.size("r").alias("n_ref"), F.size("h").alias("n_hyp"), text.word_distance(F.col("r"), F.col("h")).cast("long").alias("dist"))


@query(PAIRS + "SELECT example_id, model, n_ref, n_hyp, dist::BIGINT AS dist, round(dist / n_ref, 6) AS wer FROM x")
def wer_pairs(spark, base):
    return pair_errors(spark, base).select("*", r6(F.col("dist") / F.col("n_ref")).alias("wer"))


@query(PAIRS + "SELECT model, count(*) AS n, sum(dist)::BIGINT AS errors, sum(n_ref)::BIGINT AS words, round(sum(dist) / sum(n_ref), 6) AS corpus_wer, round(avg(dist / n_ref), 6) AS mean_wer, round(median(dist / n_ref), 6) AS median_wer FROM x GROUP BY model")
def wer_by_model(spark, base):
    x = pair_errors(spark, base).withColumn("wer", F.col("dist") / F.col("n_ref"))
    return x.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("errors"), F.sum("n_ref").alias("words"), r6(F.sum("dist") / F.sum("n_ref")).alias("corpus_wer"), r6(F.avg("wer")).alias("mean_wer"), r6(F.median("wer")).alias("median_wer"))  # the flagship: its table is small beside the texts it scores


@query(r"SELECT example_id, trim(regexp_replace(hypothesis, '\s+', ' ', 'g')) AS hypothesis, length(hypothesis) AS n_chars FROM worst_wer_examples")
def squeezed_text(spark, base):
    return table(spark, base, "worst_wer_examples").select("example_id", text.squeeze(F.col("hypothesis")).alias("hypothesis"), F.length("hypothesis").cast("long").alias("n_chars"))


@query(r"""WITH t AS (SELECT model, len(string_split_regex(trim(reference), '\s+')) AS r, CASE WHEN trim(coalesce(hypothesis, '')) = '' THEN 0 ELSE len(string_split_regex(trim(hypothesis), '\s+')) END AS h FROM worst_wer_examples WHERE trim(reference) <> '')
SELECT model, count(*) AS n, sum(r)::BIGINT AS ref_tokens, sum(h)::BIGINT AS hyp_tokens, sum(r + h)::BIGINT AS compared_tokens, round(avg(r), 6) AS mean_ref, round(avg(h), 6) AS mean_hyp FROM t GROUP BY model""")
def token_totals(spark, base):
    n = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))
    t = table(spark, base, "worst_wer_examples").where(F.trim("reference") != "").select("model", n("reference").alias("r"), n("hypothesis").alias("h"))
    return rounded(t.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("ref_tokens"), F.sum("h").alias("hyp_tokens"), F.sum(F.col("r") + F.col("h")).alias("compared_tokens"), F.avg("r").alias("mean_ref"), F.avg("h").alias("mean_hyp")))


# -- summaries --------------------------------------------------------------------------------------------------------

_B = """count({0}) AS {1}_count, round(avg({0}), 6) AS {1}_mean, round(median({0}), 6) AS {1}_median,
  CASE WHEN count({0}) > 0 THEN round(coalesce(stddev_samp({0}), 0), 6) END AS {1}_std, round(min({0}), 6) AS {1}_min, round(max({0}), 6) AS {1}_max"""


@query(
    S + "SELECT model, count(*) AS total, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (NOT coalesce(status = 'success', false)) AS failed, "
    + ", ".join([_B.format("CASE WHEN status = 'success' AND NOT coalesce(is_segmented, false) THEN wer END", "wer"), _B.format("CASE WHEN status = 'success' AND coalesce(is_segmented, false) THEN wer END", "wer_segmented")] + [_B.format(f"CASE WHEN status = 'success' THEN {m} END", m) for m in clip.METRICS[1:]])
    + " FROM s GROUP BY model"
)
def model_totals(spark, base):
    return rounded(summary.model_totals(scores(spark, base)))


@query(S + f"SELECT model, {DESCRIBE.format('wer')} FROM ok GROUP BY model")
def wer_summary(spark, base):
    return rounded(summary.summarise(frames.successful(scores(spark, base)), ["model"], "wer"))


@query(S + f", m AS (SELECT model, unnest([{', '.join(repr(x) for x in clip.METRICS)}]) AS metric, unnest([wer, mrs_wer, cpwer, orc_wer]) AS value FROM ok) SELECT model, metric, {DESCRIBE.format('value')} FROM m GROUP BY model, metric")
def metric_summary(spark, base):
    return rounded(summary.summarise(frames.unpivot(frames.successful(scores(spark, base)), ["model"]), ["model", "metric"], "value"))


@query(
    S + """SELECT CASE grouping_id(model, ovr_label, snr_label) WHEN 7 THEN 'all' WHEN 3 THEN 'model' WHEN 1 THEN 'model+ovr_label' WHEN 2 THEN 'model+snr_label' ELSE 'model+ovr_label+snr_label' END AS grouping,
  model, ovr_label, snr_label, count(*) AS n_rows, count(wer) AS n, round(avg(wer), 6) AS mean, round(stddev_samp(wer), 6) AS sd, round(max(wer), 6) AS max
FROM ok GROUP BY GROUPING SETS ((model, ovr_label, snr_label), (model, ovr_label), (model, snr_label), (model), ())"""
)
def condition_sets(spark, base):
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count("wer").alias("n"), r6(F.avg("wer")).alias("mean"), r6(F.stddev_samp("wer")).alias("sd"), r6(F.max("wer")).alias("max")]
    return summary.grouped_sets(frames.successful(scores(spark, base)), [["model", "ovr_label", "snr_label"], ["model", "ovr_label"], ["model", "snr_label"], ["model"], []], aggs)


@query(S + f"SELECT snr_db, overlap_ratio, count(*) AS total, count(*) FILTER (status = 'success') AS successful, round(count(*) FILTER (status = 'success') / count(*), 6) AS success_rate FROM s GROUP BY ALL")
def coverage(spark, base):
    return rounded(summary.coverage(scores(spark, base), ["snr_db", "overlap_ratio"]))


@query(S + f"SELECT snr_label, {DESCRIBE.format('wer')} FROM ok GROUP BY snr_label")
def by_snr(spark, base):
    return rounded(summary.summarise(frames.successful(scores(spark, base)), ["snr_label"], "wer"))


@query(S + f"SELECT ovr_label, {DESCRIBE.format('wer')} FROM ok GROUP BY ovr_label")
def by_overlap(spark, base):
    return rounded(summary.summarise(frames.successful(scores(spark, base)), ["ovr_label"], "wer"))


@query(S + "SELECT snr_label, " + ", ".join(f"round(avg(wer) FILTER (ovr_label = '{o}'), 6) AS \"ovr_{o}\"" for o in clip.OVR_ORDER) + " FROM ok RIGHT JOIN (SELECT unnest(['clean', '7.4', '0', '-5']) AS snr_label) USING (snr_label) GROUP BY snr_label")
def cross_mean(spark, base):
    g = summary.grid(frames.successful(scores(spark, base)), "snr_label", "ovr_label", clip.OVR_ORDER, F.avg("wer"), clip.SNR_ORDER)
    return g.select("snr_label", *[r6(F.col(f"`{o}`")).alias(f"ovr_{o}") for o in clip.OVR_ORDER])


@query(S + "SELECT snr_label, " + ", ".join(f"nullif(count(*) FILTER (ovr_label = '{o}'), 0) AS \"ovr_{o}\"" for o in clip.OVR_ORDER) + " FROM ok RIGHT JOIN (SELECT unnest(['clean', '7.4', '0', '-5']) AS snr_label) USING (snr_label) GROUP BY snr_label")
def cross_count(spark, base):
    g = summary.grid(frames.successful(scores(spark, base)), "snr_label", "ovr_label", clip.OVR_ORDER, F.count(F.lit(1)), clip.SNR_ORDER)
    return g.select("snr_label", *[F.col(f"`{o}`").alias(f"ovr_{o}") for o in clip.OVR_ORDER])


@query(S + "SELECT snr_label, " + ", ".join(f"nullif(count(DISTINCT clip_id) FILTER (ovr_label = '{o}'), 0) AS \"ovr_{o}\"" for o in clip.OVR_ORDER) + " FROM ok RIGHT JOIN (SELECT unnest(['clean', '7.4', '0', '-5']) AS snr_label) USING (snr_label) GROUP BY snr_label")
def cross_clips(spark, base):
    d = frames.successful(scores(spark, base)).where("clip_id is not null").select("snr_label", "ovr_label", "clip_id").distinct()
    g = summary.grid(d, "snr_label", "ovr_label", clip.OVR_ORDER, F.count(F.lit(1)), clip.SNR_ORDER)
    return g.select("snr_label", *[F.col(f"`{o}`").alias(f"ovr_{o}") for o in clip.OVR_ORDER])


@query(
    S + """SELECT model, CASE WHEN overlap_ratio IS NULL THEN 'unknown' WHEN abs(overlap_ratio) <= 1e-8 THEN 'non_overlap' ELSE 'overlap' END AS scope, count(*) AS n, round(avg(mrs_wer), 6) AS mean_a, round(avg(wer), 6) AS mean_b,
  round(median(mrs_wer), 6) AS median_a, round(median(wer), 6) AS median_b, round(avg(mrs_wer - wer), 6) AS mean_diff, round(median(mrs_wer - wer), 6) AS median_diff, round(avg(abs(mrs_wer - wer)), 6) AS mean_abs_diff,
  round(100 * avg(CASE WHEN mrs_wer - wer > 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS pct_gt, round(100 * avg(CASE WHEN mrs_wer - wer < -1e-12 THEN 1.0 ELSE 0.0 END), 6) AS pct_lt, round(100 * avg(CASE WHEN abs(mrs_wer - wer) <= 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS pct_eq
FROM ok WHERE mrs_wer IS NOT NULL AND wer IS NOT NULL GROUP BY ALL"""
)
def dss_against_wer(spark, base):
    scope = F.when(F.col("overlap_ratio").isNull(), "unknown").when(F.abs("overlap_ratio") <= 1e-8, "non_overlap").otherwise("overlap")
    return rounded(summary.compare_metrics(frames.successful(scores(spark, base)).withColumn("scope", scope), ["model", "scope"]))


@query(S + "SELECT model, comparison, count(*) AS n FROM (SELECT model, CASE WHEN mrs_wer - wer > 1e-12 THEN 'dss_above' WHEN mrs_wer - wer < -1e-12 THEN 'dss_below' ELSE 'equal' END AS comparison FROM ok WHERE mrs_wer IS NOT NULL AND wer IS NOT NULL) GROUP BY ALL")
def comparison_counts(spark, base):
    d = F.col("mrs_wer") - F.col("wer")
    rows = frames.successful(scores(spark, base)).where("mrs_wer is not null and wer is not null")
    return rows.select("model", F.when(d > 1e-12, "dss_above").when(d < -1e-12, "dss_below").otherwise("equal").alias("comparison")).groupBy("model", "comparison").agg(F.count(F.lit(1)).alias("n"))


@query(S + """SELECT 'snr 7.4, T' AS slice, model, ovr_label AS level, count(wer) AS n, round(avg(wer), 6) AS mean FROM ok WHERE snr_db = 7.4 AND noise_type = 'T' GROUP BY ALL
UNION ALL SELECT 'overlap 0.14, T', model, snr_label, count(wer), round(avg(wer), 6) FROM ok WHERE abs(overlap_ratio - 0.14) <= 1e-8 + 1e-5 * 0.14 AND noise_type = 'T' GROUP BY ALL""")
def slices(spark, base):
    """Means along the overlaps at 7.4 dB and along the noise levels at overlap 0.14, both with noise T."""
    ok = frames.successful(scores(spark, base)).where("noise_type = 'T'")
    one = lambda rows, name, level: rows.groupBy("model", F.col(level).alias("level")).agg(F.count("wer").alias("n"), r6(F.avg("wer")).alias("mean")).withColumn("slice", F.lit(name))
    near = F.abs(F.col("overlap_ratio") - 0.14) <= 1e-8 + 1e-5 * 0.14
    return one(ok.where("snr_db = 7.4D"), "snr 7.4, T", "ovr_label").unionByName(one(ok.where(near), "overlap 0.14, T", "snr_label"))


@query(S + "SELECT status, wer_method, metric_type, count(*) AS n FROM s GROUP BY ALL")
def status_counts(spark, base):
    return scores(spark, base).groupBy("status", "wer_method", "metric_type").agg(F.count(F.lit(1)).alias("n"))


@query(S + "SELECT noise_type, count(wer) AS n, round(avg(wer), 6) AS mean, round(stddev_samp(wer), 6) AS sd, round(quantile_cont(wer, 0.75) - quantile_cont(wer, 0.25), 6) AS iqr, round(stddev_samp(wer) / sqrt(count(wer)), 6) AS sem, round(1.96 * stddev_samp(wer) / sqrt(count(wer)), 6) AS ci95 FROM ok WHERE wer IS NOT NULL GROUP BY noise_type")
def spread_by_noise(spark, base):
    return rounded(summary.spread(frames.successful(scores(spark, base)), ["noise_type"], "wer"))


@query(S + "SELECT count(*) AS n_rows, count(DISTINCT (coalesce(clip_id, ''), coalesce(model, ''))) AS n_keys, count(*) - count(DISTINCT (coalesce(clip_id, ''), coalesce(model, ''))) AS n_surplus FROM ok")
def duplicate_pairs(spark, base):
    return summary.duplicates(frames.successful(scores(spark, base)), ["clip_id", "model"])


@query(S + "SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM ok GROUP BY clip_id, model) GROUP BY size")
def group_sizes(spark, base):
    return summary.group_sizes(frames.successful(scores(spark, base)), ["clip_id", "model"])


@query(S + "SELECT model, snr_label, n FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, snr_label) AS r FROM (SELECT model, snr_label, count(*) AS n FROM ok GROUP BY model, snr_label)) WHERE r = 1")
def commonest_snr(spark, base):
    return summary.mode(frames.successful(scores(spark, base)), ["model"], "snr_label")


@query(S + "SELECT model, round(avg(CASE WHEN wer IS NOT NULL THEN least(wer, 1) END), 6) AS clipped_mean, round(100 * avg(CASE WHEN wer > 1 THEN 1.0 ELSE 0.0 END), 6) AS pct_over FROM ok GROUP BY model")
def clipped_mean(spark, base):
    return rounded(frames.successful(scores(spark, base)).groupBy("model").agg(F.avg(F.when(F.col("wer").isNotNull(), F.least("wer", F.lit(1.0)))).alias("clipped_mean"), (100 * F.avg(F.when(F.col("wer") > 1, 1.0).otherwise(0.0))).alias("pct_over")))


# -- joins ------------------------------------------------------------------------------------------------------------


@query(S + ", m AS (SELECT clip_id, max(overlap_ratio_target) AS o FROM mixture_meta GROUP BY clip_id) SELECT result_id, s.clip_id, round(coalesce(m.o, s.overlap_ratio), 6) AS overlap FROM s LEFT JOIN m USING (clip_id)")
def overlap_from_manifest(spark, base):
    m = table(spark, base, "mixture_meta").groupBy("clip_id").agg(F.max("overlap_ratio_target").alias("o"))
    return scores(spark, base).join(m, "clip_id", "left").select("result_id", "clip_id", r6(F.coalesce("o", "overlap_ratio")).alias("overlap"))


@query(S + """, p AS (SELECT DISTINCT clip_id, model FROM s WHERE clip_id IS NOT NULL AND model IS NOT NULL), g AS (SELECT c.clip_id, m.model FROM (SELECT DISTINCT clip_id FROM mixture_meta) c CROSS JOIN (SELECT DISTINCT model FROM s WHERE model IS NOT NULL) m)
SELECT model, count(*) AS n_missing FROM g ANTI JOIN p USING (clip_id, model) GROUP BY model""")
def missing_results(spark, base):
    """Clips of the manifest without a result, per model: the number of clips less those that have one."""
    s = scores(spark, base).where("model is not null and clip_id is not null").select("model", "clip_id").distinct()
    clips = table(spark, base, "mixture_meta").select("clip_id").where("clip_id is not null").distinct()
    have = s.join(clips.withColumn("wanted", F.lit(1)), "clip_id", "left").groupBy("model").agg(F.count("wanted").alias("n"))
    return have.select("model", (clips.agg(F.count("clip_id")).scalar() - F.col("n")).alias("n_missing")).where("n_missing > 0")


@query("SELECT clip_id FROM (SELECT DISTINCT clip_id FROM mixture_meta) ANTI JOIN (SELECT DISTINCT clip_id FROM mixture_transcription WHERE clip_id IS NOT NULL) USING (clip_id)")
def untranscribed(spark, base):
    return readers.pending(table(spark, base, "mixture_meta").select("clip_id").distinct(), table(spark, base, "mixture_transcription").where("clip_id is not null"), ["clip_id"])


@query("""SELECT side, count(*) AS n FROM (
  SELECT 'manifest_only' AS side, clip_id FROM (SELECT DISTINCT clip_id FROM mixture_meta) ANTI JOIN (SELECT DISTINCT clip_id FROM mixture_transcription) USING (clip_id)
  UNION ALL SELECT 'transcribed_only', clip_id FROM (SELECT DISTINCT clip_id FROM mixture_transcription WHERE clip_id IS NOT NULL) ANTI JOIN (SELECT DISTINCT clip_id FROM mixture_meta) USING (clip_id)
  UNION ALL SELECT 'both', clip_id FROM (SELECT DISTINCT clip_id FROM mixture_meta) SEMI JOIN (SELECT DISTINCT clip_id FROM mixture_transcription) USING (clip_id)) GROUP BY side""")
def extra_and_missing(spark, base):
    a = table(spark, base, "mixture_meta").select("clip_id").distinct().withColumn("a", F.lit(1))
    b = table(spark, base, "mixture_transcription").select("clip_id").where("clip_id is not null").distinct().withColumn("b", F.lit(1))
    side = F.when(F.col("b").isNull(), "manifest_only").when(F.col("a").isNull(), "transcribed_only").otherwise("both")
    return a.join(b, "clip_id", "outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query(S + """, a AS (SELECT model, avg(wer) AS a_mean, median(wer) AS a_median, stddev_samp(wer) AS a_sd FROM ok WHERE wer IS NOT NULL GROUP BY model),
b AS (SELECT model, avg(wer) AS b_mean, median(wer) AS b_median, stddev_samp(wer) AS b_sd FROM worst_wer_examples WHERE wer IS NOT NULL GROUP BY model),
k AS (SELECT *, rank() OVER (ORDER BY a_mean) AS a_rank, rank() OVER (ORDER BY b_mean) AS b_rank FROM a JOIN b USING (model) WHERE model IS NOT NULL)
SELECT model, round(a_mean, 6) AS a_mean, round(a_median, 6) AS a_median, round(a_sd, 6) AS a_sd, round(b_mean, 6) AS b_mean, round(b_median, 6) AS b_median, round(b_sd, 6) AS b_sd, a_rank::INTEGER AS a_rank, b_rank::INTEGER AS b_rank,
  round(b_mean - a_mean, 6) AS delta, round(b_mean / a_mean, 6) AS ratio, (b_rank - a_rank)::INTEGER AS rank_shift FROM k""")
def transfer(spark, base):
    a = frames.successful(scores(spark, base)).where("model is not null").select("model", "wer")
    b = table(spark, base, "worst_wer_examples").where("model is not null").select("model", "wer")
    return rounded(summary.transfer(a, b, "model", "wer"))


@query(S + "SELECT a.model AS model_a, b.model AS model_b, round(a.m - b.m, 6) AS diff FROM (SELECT model, avg(wer) AS m FROM ok WHERE model IS NOT NULL GROUP BY model) a JOIN (SELECT model, avg(wer) AS m FROM ok WHERE model IS NOT NULL GROUP BY model) b ON a.model < b.model")
def model_pairs(spark, base):
    m = frames.successful(scores(spark, base)).where("model is not null").groupBy("model").agg(F.avg("wer").alias("m"))
    # one row per model on either side; the comparison is the join condition
    return m.alias("a").join(m.alias("b"), F.col("a.model") < F.col("b.model")).select(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), r6(F.col("a.m") - F.col("b.m")).alias("diff"))


@query("SELECT DISTINCT o.o AS overlap, s.s AS snr, n.n AS noise, format('mix_{:07d}_{:.2f}_2_{}_{}', 12 * 3, o.o, coalesce(format('{:g}', s.s), 'None'), n.n) AS clip_id FROM (SELECT unnest([0.0, 0.14, 0.2, 0.4]::DOUBLE[]) AS o) o, (SELECT unnest([NULL, 7.4, 0, -5]::DOUBLE[]) AS s) s, (SELECT unnest(['D', 'P', 'T']) AS n) n")
def factor_grid(spark, base):
    g = readers.factor_grid(spark, [0.0, 0.14, 0.2, 0.4], [2], [None, 7.4, 0.0, -5.0], clip.NOISE_ORDER)
    made = readers.clip_id(F.lit(36), F.col("overlap_ratio"), F.col("max_speakers"), F.col("snr_db"), F.col("noise_type"))
    return g.select(F.col("overlap_ratio").alias("overlap"), F.col("snr_db").alias("snr"), F.col("noise_type").alias("noise"), made.alias("clip_id"))


# -- ranks and curves -------------------------------------------------------------------------------------------------


@query("SELECT model, example_id, place FROM (SELECT model, example_id, row_number() OVER (PARTITION BY model ORDER BY wer DESC, example_id) AS place FROM worst_wer_examples WHERE wer IS NOT NULL AND model IS NOT NULL) WHERE place <= 3")
def worst_examples(spark, base):
    w = Window.partitionBy("model").orderBy(F.desc("wer"), "example_id")
    rows = table(spark, base, "worst_wer_examples").where("wer is not null and model is not null")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("model", "example_id", "place")


@query(S + "SELECT result_id, round(wer - mrs_wer, 6) AS diff FROM ok WHERE wer - mrs_wer > 0 ORDER BY wer - mrs_wer DESC, result_id LIMIT 10")
def largest_gaps(spark, base):
    rows = frames.successful(scores(spark, base)).withColumn("d", F.col("wer") - F.col("mrs_wer")).where("d > 0")
    return ranking.top_overall(rows, [F.desc("d"), F.col("result_id")], 10).select("result_id", r6("d").alias("diff"))


@query(S + "SELECT model, round(m, 6) AS mean, rank() OVER (ORDER BY m) AS place FROM (SELECT model, avg(wer) AS m FROM ok WHERE model IS NOT NULL GROUP BY model)")
def model_ranks(spark, base):
    m = frames.successful(scores(spark, base)).where("model is not null").groupBy("model").agg(F.avg("wer").alias("m"))
    return m.select("model", r6("m").alias("mean"), F.rank().over(Window.orderBy("m")).cast("long").alias("place"))


_EACH = "(SELECT snr_label, wer FROM ok UNION ALL SELECT 'Overall', wer FROM ok)"


@query(S + f"SELECT snr_label, wer, n, round(sum(n) OVER (PARTITION BY snr_label ORDER BY wer) / sum(n) OVER (PARTITION BY snr_label), 6) AS ecdf FROM (SELECT snr_label, wer, count(*) AS n FROM {_EACH} WHERE wer IS NOT NULL GROUP BY ALL)")
def ecdf(spark, base):
    c = ranking.value_curve(frames.successful(scores(spark, base)), ["snr_label"], "wer", overall="Overall")
    return c.withColumn("ecdf", r6("ecdf"))


@query(S + f"SELECT snr_label, round(t.k * 0.02, 6) AS threshold, count(*) AS total, round(avg(CASE WHEN wer > t.k * 0.02 THEN 1.0 ELSE 0.0 END), 6) AS share FROM {_EACH}, (SELECT unnest(range(0, 51))::DOUBLE AS k) t WHERE wer IS NOT NULL GROUP BY snr_label, t.k")
def exceedance(spark, base):
    return rounded(ranking.exceedance(frames.successful(scores(spark, base)), ["snr_label"], "wer", overall="Overall"))


@query(
    S + """, c AS (SELECT *, row_number() OVER (PARTITION BY model, base_mixture_id, overlap_ratio, max_speakers ORDER BY noise_type NULLS FIRST, clip_id NULLS FIRST, result_id) AS rn FROM s WHERE snr_db IS NULL)
SELECT result_id, 'clean' AS noise_type, noise_type AS noise_type_raw, true AS is_clean_effective_sample FROM c WHERE rn = 1 UNION ALL SELECT result_id, noise_type, noise_type, false FROM s WHERE snr_db IS NOT NULL"""
)
def clean_dedup(spark, base):
    return frames.dedup_clean(scores(spark, base)).select("result_id", "noise_type", "noise_type_raw", "is_clean_effective_sample")


@query("SELECT doc_id FROM documents ORDER BY md5(concat_ws('|', doc_id::VARCHAR, '1234')), doc_id LIMIT 100")
def seeded_sample(spark, base):
    return ranking.hashed_sample(table(spark, base, "documents").select("doc_id"), "doc_id", 100, 1234)


@query(S + "SELECT result_id, metric, value FROM (SELECT result_id, unnest(['wer', 'mrs_wer', 'cpwer', 'orc_wer']) AS metric, unnest([wer, mrs_wer, cpwer, orc_wer]) AS value FROM s)")
def metrics_long(spark, base):
    return frames.unpivot(scores(spark, base), ["result_id"])


# -- statistics -------------------------------------------------------------------------------------------------------


def _erfc(z: str) -> str:
    """The complementary error function of a column in SQL: a continued fraction beyond 2 and the series below."""
    fraction = f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(60, 0, -1), lambda k: k / 2.0)), lambda acc, k: k / ({z} + acc))"
    series = f"list_sum(list_transform(range(0, 40), lambda n: (CASE WHEN n % 2 = 0 THEN 1.0 ELSE -1.0 END) * pow({z}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))"
    return f"CASE WHEN {z} > 2 THEN exp(-{z} * {z}) / sqrt(pi()) / ({z} + {fraction}) ELSE 1 - 2 / sqrt(pi()) * {series} END"


FOUR = ["faster-whisper", "whisperx", "wav2vec2", "parakeet"]


def pairs(spark, base) -> DataFrame:
    """One row per clip that all four models have; written once, as the tests read it several times."""
    return cut(frames.paired(frames.successful(scores(spark, base)), "wer", FOUR))


_PV = ", p AS (SELECT clip_id, " + ", ".join(f"round(avg(wer) FILTER (model = '{m}'), 9) AS m{i}" for i, m in enumerate(FOUR)) + " FROM ok WHERE wer IS NOT NULL AND clip_id IS NOT NULL GROUP BY clip_id), q AS (SELECT * FROM p WHERE " + " AND ".join(f"m{i} IS NOT NULL" for i in range(4)) + ")"


@query(
    S + _PV + """, l AS (SELECT clip_id, unnest([0, 1, 2, 3]) AS t, unnest([m0, m1, m2, m3]) AS v FROM q),
r AS (SELECT clip_id, t, v, rank() OVER (PARTITION BY clip_id ORDER BY v) + (count(*) OVER (PARTITION BY clip_id, v) - 1) / 2.0 AS r FROM l),
a AS (SELECT sum(x.s * x.s) AS ss, max(x.n) AS n FROM (SELECT t, sum(r) AS s, count(*) AS n FROM r GROUP BY t) x),
z AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM l GROUP BY clip_id, v)),
f AS (SELECT n, (12 / (n * 4 * 5.0) * ss - 3 * n * 5) / (1 - ties / (n * 4 * 15.0)) AS chi2 FROM a, z), g AS (SELECT *, sqrt(chi2 / 2) AS w FROM f)
SELECT n, 4 AS k, round(chi2, 6) AS chi2, round(""" + _erfc("w") + """ + exp(-w * w) * w * 2 / sqrt(pi()), 6) AS p, round(chi2 / (n * 3), 6) AS kendall_w FROM g"""
)
def friedman(spark, base):
    return rounded(stats.friedman(pairs(spark, base), "clip_id", FOUR))


_WILCOXON = S + _PV + """, l AS (SELECT unnest([{{'a': '{0}', 'b': '{1}', 'x': m0, 'y': m1}}, {{'a': '{0}', 'b': '{2}', 'x': m0, 'y': m2}}, {{'a': '{0}', 'b': '{3}', 'x': m0, 'y': m3}}, {{'a': '{1}', 'b': '{2}', 'x': m1, 'y': m2}}, {{'a': '{1}', 'b': '{3}', 'x': m1, 'y': m3}}, {{'a': '{2}', 'b': '{3}', 'x': m2, 'y': m3}}]) AS x FROM q),
v AS (SELECT x.a AS model_a, x.b AS model_b, x.x AS x, x.y AS y, x.x - x.y AS d FROM l),
b AS (SELECT model_a, model_b, count(*) AS n, count(*) FILTER (d <> 0) AS n_non_zero, avg(x) AS mean_a, avg(y) AS mean_b, avg(d) AS mean_diff, median(d) AS median_diff FROM v GROUP BY ALL),
r AS (SELECT model_a, model_b, d, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY model_a, model_b, abs(d)) AS t FROM v WHERE d <> 0),
w AS (SELECT model_a, model_b, count(*) AS m, sum(t * t - 1) AS ties, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS statistic FROM r GROUP BY ALL),
z AS (SELECT *, abs(statistic - m * (m + 1) / 4.0) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0 - ties / 48.0) / sqrt(2) AS z FROM b JOIN w USING (model_a, model_b)),
t AS (SELECT *, """.format(*FOUR) + _erfc("z") + """ AS p, CASE WHEN mean_diff < 0 THEN model_a WHEN mean_diff > 0 THEN model_b END AS lower_mean FROM z)
"""


@query(_WILCOXON + "SELECT model_a, model_b, n, n_non_zero, round(statistic, 6) AS statistic, round(p, 6) AS p, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_diff, 6) AS mean_diff, round(median_diff, 6) AS median_diff, lower_mean FROM t")
def wilcoxon(spark, base):
    return rounded(stats.wilcoxon_pairs(pairs(spark, base), "clip_id", FOUR))


@query(_WILCOXON + """, h AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, model_a, model_b) + 1) * p) AS a FROM t)
SELECT model_a, model_b, round(p, 6) AS p, round(max(a) OVER (ORDER BY p, model_a, model_b ROWS UNBOUNDED PRECEDING), 6) AS p_holm, max(a) OVER (ORDER BY p, model_a, model_b ROWS UNBOUNDED PRECEDING) <= 0.05 AS reject FROM h""")
def holm(spark, base):
    """The pairwise signed-rank tests with adjusted p and the decision at 0.05."""
    p = stats.wilcoxon_pairs(pairs(spark, base), "clip_id", FOUR)
    # one row per pair of models
    return rounded(ranking.holm(p.select("model_a", "model_b", "p").withColumn("family", F.lit(1)), "p", ["family"]).select("model_a", "model_b", "p", "p_holm", "reject"))


#: Row i of a group has sign + in draw d if bit d % 64 of its number d // 64 is set; the numbers are splitmix64 from a digest.
_FLIP = """, dd AS (SELECT model, mrs_wer - wer AS d, ('0x' || substr(md5('flip|' || result_id::VARCHAR), 1, 16))::UBIGINT::UHUGEINT AS seed FROM ok WHERE mrs_wer IS NOT NULL AND wer IS NOT NULL),
m0 AS (SELECT model, d, k - 1 AS word, (seed + k::UHUGEINT * 11400714819323198485) % 18446744073709551616 AS z FROM dd, (SELECT unnest(range(1, 158)) AS k)),
m1 AS (SELECT model, d, word, (xor(z::UBIGINT, z::UBIGINT >> 30)::UHUGEINT * 13787848793156543929) % 18446744073709551616 AS z FROM m0),
m2 AS (SELECT model, d, word, (xor(z::UBIGINT, z::UBIGINT >> 27)::UHUGEINT * 10723151780598845931) % 18446744073709551616 AS z FROM m1),
m3 AS (SELECT model, d, word, xor(z::UBIGINT, z::UBIGINT >> 31) AS z FROM m2),
m4 AS (SELECT model, word, b, sum(CASE WHEN (z >> b) & 1 = 1 THEN d ELSE -d END) AS s FROM m3, (SELECT unnest(range(0, 64))::UBIGINT AS b) GROUP BY ALL),
o AS (SELECT model, count(*) AS n, avg(d) AS observed FROM dd GROUP BY model)
"""


@query(
    S + _FLIP + """SELECT o.model, n, 10000::BIGINT AS permutations, round(observed, 6) AS observed, round((1 + count(*) FILTER (abs(s / n) >= abs(observed) - 1e-12)) / 10001, 6) AS p_two,
  round((1 + count(*) FILTER (s / n <= observed + 1e-12)) / 10001, 6) AS p_less, round((1 + count(*) FILTER (s / n >= observed - 1e-12)) / 10001, 6) AS p_greater
FROM o JOIN m4 ON o.model IS NOT DISTINCT FROM m4.model WHERE word * 64 + b < 10000 GROUP BY o.model, n, observed"""
)
def sign_flip(spark, base):
    """The paired permutation test with the published number of permutations."""
    rows = frames.successful(scores(spark, base)).withColumn("d", F.col("mrs_wer") - F.col("wer"))
    return rounded(stats.flip_test(stats.flip_sums(rows, ["model"], "result_id", "d"), ["model"]))


@query()
def bootstrap_ci(spark, base):
    return rounded(stats.bootstrap(frames.successful(scores(spark, base)), ["model"], "result_id", "wer"))


@query(
    S + """, q AS (SELECT model, quantile_cont(wer, 0.25) AS q1, quantile_cont(wer, 0.75) AS q3 FROM ok WHERE wer IS NOT NULL AND model IS NOT NULL GROUP BY model)
SELECT model, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 + 1.5 * (q3 - q1), 6) AS fence, count(*) AS n, count(*) FILTER (wer > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM ok JOIN q USING (model) WHERE wer IS NOT NULL GROUP BY ALL"""
)
def iqr_outliers(spark, base):
    o = stats.iqr_outliers(frames.successful(scores(spark, base)).where("model is not null"), ["model"], "wer")
    return rounded(o.groupBy("model", "q1", "q3", "fence").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("n_outliers")))


@query(
    S + """, q AS (SELECT model, quantile_cont(wer, 0.25) AS q1, quantile_cont(wer, 0.75) AS q3 FROM ok WHERE wer IS NOT NULL AND model IS NOT NULL GROUP BY model),
o AS (SELECT model, snr_label, count(*) AS n FROM ok JOIN q USING (model) WHERE wer > q3 + 1.5 * (q3 - q1) GROUP BY ALL)
SELECT model, snr_label, n, round(n / sum(n) OVER (PARTITION BY model), 6) AS share FROM o"""
)
def outlier_shares(spark, base):
    o = stats.iqr_outliers(frames.successful(scores(spark, base)).where("model is not null"), ["model"], "wer").where("is_outlier")
    return rounded(summary.proportions(o, ["model"], "snr_label"))


@query(
    S + """, c AS (SELECT snr_label, ovr_label, count(*) AS n, sum(wer) AS s, sum(wer * wer) AS q FROM ok WHERE wer IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) - sum(s) * sum(s) / sum(n) AS ss_total FROM c),
b AS (SELECT 'snr_label' AS factor, sum(x) AS b FROM (SELECT sum(s) * sum(s) / sum(n) AS x FROM c GROUP BY snr_label) UNION ALL SELECT 'ovr_label', sum(x) FROM (SELECT sum(s) * sum(s) / sum(n) AS x FROM c GROUP BY ovr_label)),
w AS (SELECT factor, n, b - s * s / n AS ss, ss_total FROM b, t), r AS (SELECT max(ss_total) - sum(ss) AS ss_residual FROM w)
SELECT factor, n::BIGINT AS n, round(ss, 6) AS ss, round(ss_total, 6) AS ss_total, round(ss_residual, 6) AS ss_residual, round(ss / (ss + ss_residual), 6) AS partial_eta2 FROM w, r"""
)
def partial_eta(spark, base):
    return rounded(stats.effects(frames.successful(scores(spark, base)), "wer", ["snr_label", "ovr_label"]))


@query(
    S + """, x AS (SELECT wer AS y, overlap_ratio AS o, CASE WHEN snr_db IS NULL THEN 0 ELSE pow(10, -snr_db / 20) END AS z, snr_label FROM ok WHERE wer IS NOT NULL AND overlap_ratio IS NOT NULL),
a AS (SELECT *, o * z AS oz, avg(y) OVER () AS my, avg(o) OVER () AS mo, avg(z) OVER () AS mz, avg(o * z) OVER () AS moz FROM x),
b AS (SELECT *, o - mo AS r1 FROM a), b1 AS (SELECT sum(z * r1) / sum(r1 * r1) AS b21, sum(oz * r1) / sum(r1 * r1) AS b31 FROM b),
c AS (SELECT *, z - mz - b21 * r1 AS r2 FROM b, b1), c1 AS (SELECT sum(oz * r2) / sum(r2 * r2) AS b32 FROM c),
d3 AS (SELECT *, oz - moz - b31 * r1 - b32 * r2 AS r3 FROM c, c1),
g AS (SELECT sum(y * r3) / sum(r3 * r3) AS t3, sum(y * r2) / sum(r2 * r2) AS g2, sum(y * r1) / sum(r1 * r1) AS g1, any_value(b21) AS b21, any_value(b31) AS b31, any_value(b32) AS b32, any_value(my) AS my, any_value(mo) AS mo, any_value(mz) AS mz, any_value(moz) AS moz FROM d3),
t AS (SELECT t3, g2 - t3 * b32 AS t2, g1 - (g2 - t3 * b32) * b21 - t3 * b31 AS t1, my, mo, mz, moz FROM g), u AS (SELECT t3, t2, t1, my - t1 * mo - t2 * mz - t3 * moz AS t0 FROM t),
e3 AS (SELECT y, y - t0 - t1 * o - t2 * z - t3 * o * z AS e FROM x, u), f AS (SELECT count(*) AS n, 1 - avg(e * e) / var_pop(y) AS r2, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM e3),
m AS (SELECT o, z, snr_label, avg(y) AS y FROM x WHERE snr_label IS NOT NULL GROUP BY ALL), me AS (SELECT y, y - t0 - t1 * o - t2 * z - t3 * o * z AS e FROM m, u),
mf AS (SELECT count(*) AS condition_n, 1 - avg(e * e) / var_pop(y) AS condition_r2, avg(abs(e)) AS condition_mae, sqrt(avg(e * e)) AS condition_rmse FROM me)
SELECT unnest(['intercept', 'ovr', 'z', 'ovr_z']) AS term, round(unnest([t0, t1, t2, t3]), 6) AS estimate, n, round(r2, 6) AS r2, round(mae, 6) AS mae, round(rmse, 6) AS rmse,
  condition_n, round(condition_r2, 6) AS condition_r2, round(condition_mae, 6) AS condition_mae, round(condition_rmse, 6) AS condition_rmse FROM u, f, mf"""
)
def wer_surface(spark, base):
    rows = frames.successful(scores(spark, base)).where("overlap_ratio is not null")
    return rounded(stats.surface(rows, "overlap_ratio", clip.snr_amplitude(F.col("snr_db")), "wer", ["snr_label"]))


@query(S + "SELECT round(regr_slope(wer, overlap_ratio), 6) AS slope, round(regr_intercept(wer, overlap_ratio), 6) AS intercept, round(regr_r2(wer, overlap_ratio), 6) AS r2, regr_count(wer, overlap_ratio)::BIGINT AS n FROM ok")
def wer_slope(spark, base):
    r = frames.successful(scores(spark, base)).where("wer is not null and overlap_ratio is not null")
    return rounded(r.agg(F.regr_slope("wer", "overlap_ratio").alias("slope"), F.regr_intercept("wer", "overlap_ratio").alias("intercept"), F.regr_r2("wer", "overlap_ratio").alias("r2"), F.count(F.lit(1)).alias("n")))


@query(S + ", m AS (SELECT ovr_label, snr_label, avg(wer) AS mean FROM ok WHERE wer IS NOT NULL GROUP BY ALL) SELECT ovr_label, snr_label, round(mean, 6) AS mean, round(mean - max(CASE WHEN snr_label = 'clean' THEN mean END) OVER (PARTITION BY ovr_label), 6) AS delta FROM m")
def delta_to_clean(spark, base):
    return rounded(stats.baseline_delta(frames.successful(scores(spark, base)), ["ovr_label"], "snr_label", "clean", "wer"))


@query(S + "SELECT model, result_id, round(abs(wer - mrs_wer), 6) AS gap FROM ok WHERE abs(overlap_ratio) <= 1e-8 AND abs(wer - mrs_wer) > 1e-10")
def zero_overlap_gaps(spark, base):
    """Results without overlap whose two rates differ."""
    gap = F.abs(F.col("wer") - F.col("mrs_wer"))
    return frames.successful(scores(spark, base)).where((F.abs("overlap_ratio") <= 1e-8) & (gap > 1e-10)).select("model", "result_id", r6(gap).alias("gap"))


@query(
    S + """, a AS (SELECT model, ovr_label, avg(wer) AS m FROM ok WHERE wer IS NOT NULL AND model IS NOT NULL GROUP BY ALL), b AS (SELECT model, avg(wer) AS m FROM worst_wer_examples WHERE wer IS NOT NULL GROUP BY model)
SELECT a.model, a.ovr_label, round(a.m, 6) AS mean, round(b.m, 6) AS real_mean, round(a.m - b.m, 6) AS gap FROM a LEFT JOIN b USING (model)"""
)
def gap_by_overlap(spark, base):
    """Mean per model and overlap beside the mean of another corpus (here the listed examples)."""
    a = frames.successful(scores(spark, base)).where("wer is not null and model is not null").groupBy("model", "ovr_label").agg(F.avg("wer").alias("mean"))
    b = table(spark, base, "worst_wer_examples").where("wer is not null").groupBy("model").agg(F.avg("wer").alias("real_mean"))
    return rounded(a.join(b, "model", "left").select("model", "ovr_label", "mean", "real_mean", (F.col("mean") - F.col("real_mean")).alias("gap")))


@query(S + ", b AS (SELECT model, avg(wer) AS m FROM worst_wer_examples WHERE wer IS NOT NULL GROUP BY model) SELECT model, " + ", ".join(f"round(avg(wer) FILTER (ovr_label = '{o}') - any_value(b.m), 6) AS \"gap_{o}\"" for o in clip.OVR_ORDER) + " FROM ok LEFT JOIN b USING (model) WHERE wer IS NOT NULL AND model IS NOT NULL GROUP BY model")
def gap_grid(spark, base):
    """gap_by_overlap with a column per overlap."""
    a = summary.grid(frames.successful(scores(spark, base)).where("wer is not null and model is not null"), "model", "ovr_label", clip.OVR_ORDER, F.avg("wer"))
    b = table(spark, base, "worst_wer_examples").where("wer is not null").groupBy("model").agg(F.avg("wer").alias("m"))
    return a.join(b, "model", "left").select("model", *[r6(F.col(f"`{o}`") - F.col("m")).alias(f"gap_{o}") for o in clip.OVR_ORDER])


@query(
    S + """, a AS (SELECT model, avg(wer) FILTER (snr_label = 'clean') AS c, avg(wer) FILTER (snr_label <> 'clean') AS n FROM ok WHERE wer IS NOT NULL AND model IS NOT NULL GROUP BY model)
SELECT count(*) AS n_models, round(avg(100 * (n - c) / c), 6) AS mean_degradation_pct FROM a WHERE c > 0 AND n IS NOT NULL"""
)
def degradation(spark, base):
    """Mean over models of the relative loss from clean to noisy results, in per cent."""
    a = frames.successful(scores(spark, base)).where("wer is not null and model is not null").groupBy("model").agg(F.avg(F.when(F.col("snr_label") == "clean", F.col("wer"))).alias("c"), F.avg(F.when(F.col("snr_label") != "clean", F.col("wer"))).alias("n"))
    return rounded(a.where("c > 0 and n is not null").agg(F.count(F.lit(1)).alias("n_models"), F.avg(100 * (F.col("n") - F.col("c")) / F.col("c")).alias("mean_degradation_pct")))


@query(
    S + """, h AS (SELECT CASE WHEN abs(overlap_ratio) <= 1e-8 THEN 'non_overlap' ELSE 'overlap' END AS scope, model, wer, mrs_wer, mrs_wer - wer AS d FROM ok WHERE mrs_wer IS NOT NULL AND wer IS NOT NULL AND overlap_ratio IS NOT NULL AND model IS NOT NULL),
g AS (SELECT scope, model, wer, mrs_wer, d FROM h UNION ALL SELECT scope, 'all_models', wer, mrs_wer, d FROM h)
SELECT scope, CASE scope WHEN 'overlap' THEN 'Overlap' ELSE 'Non-overlap' END AS scope_label, model, CASE model WHEN 'all_models' THEN 'All models' WHEN 'faster-whisper' THEN 'Faster-Whisper' WHEN 'whisperx' THEN 'WhisperX' WHEN 'parakeet' THEN 'Parakeet' ELSE model END AS model_label,
  count(*) AS n, round(avg(wer), 6) AS wer_mean, round(median(wer), 6) AS wer_median, round(stddev_samp(wer), 6) AS wer_sd, round(avg(mrs_wer), 6) AS dss_wer_mean, round(median(mrs_wer), 6) AS dss_wer_median, round(stddev_samp(mrs_wer), 6) AS dss_wer_sd,
  round(avg(d), 6) AS mean_diff, round(median(d), 6) AS median_diff, round(stddev_samp(d), 6) AS diff_sd, count(*) FILTER (abs(d) <= 1e-12) AS equal_n, count(*) FILTER (d < -1e-12) AS below_n, count(*) FILTER (d > 1e-12) AS above_n,
  round(100 * avg(CASE WHEN abs(d) <= 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS equal_pct, round(100 * avg(CASE WHEN d < -1e-12 THEN 1.0 ELSE 0.0 END), 6) AS below_pct, round(100 * avg(CASE WHEN d > 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS above_pct,
  CASE WHEN avg(d) < -1e-3 THEN 'lower' WHEN avg(d) > 1e-3 THEN 'higher' ELSE 'same' END AS direction FROM g GROUP BY scope, model"""
)
def hypothesis_table(spark, base):
    """Two-stream rate against the plain rate per scope and model and over all models, with the direction."""
    return rounded(_hypotheses(spark, base, tests=False))


def _hypotheses(spark, base, tests: bool) -> DataFrame:
    rows = frames.successful(scores(spark, base)).where("mrs_wer is not null and wer is not null and overlap_ratio is not null and model is not null")
    rows = rows.select("result_id", F.when(F.abs("overlap_ratio") <= 1e-8, "non_overlap").otherwise("overlap").alias("scope"), "model", "wer", "mrs_wer", (F.col("mrs_wer") - F.col("wer")).alias("d"))
    keys, d = ["scope", "model"], F.col("d")
    both = lambda df: df.withColumn("model", F.explode(F.array("model", F.lit("all_models"))))
    tallies = {"equal": F.abs(d) <= 1e-12, "below": d < -1e-12, "above": d > 1e-12}
    out = both(rows).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("wer").alias("wer_mean"), F.stddev_samp("wer").alias("wer_sd"), F.avg("mrs_wer").alias("dss_wer_mean"), F.stddev_samp("mrs_wer").alias("dss_wer_sd"),
        F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("diff_sd"), *[F.count_if(c).alias(f"{k}_n") for k, c in tallies.items()], *[(100 * F.avg(c.cast("double"))).alias(f"{k}_pct") for k, c in tallies.items()],
    )
    out = ranking.with_percentiles(out, both(rows), keys, {"wer_median": (F.col("wer"), 0.5), "dss_wer_median": (F.col("mrs_wer"), 0.5), "median_diff": (d, 0.5)})
    out = out.withColumn("scope_label", F.when(F.col("scope") == "overlap", "Overlap").otherwise("Non-overlap")).withColumn("model_label", clip.label(F.col("model"), clip.MODEL_LABELS | {"all_models": "All models"}))
    out = out.withColumn("direction", F.when(F.col("mean_diff") < -1e-3, "lower").when(F.col("mean_diff") > 1e-3, "higher").otherwise("same"))
    if not tests:
        return out
    less = F.col("scope") == "overlap"
    p = stats.flip_test(both(stats.flip_sums(rows, keys, "result_id", "d")), keys).select(*keys, F.when(less, F.col("p_less")).otherwise(F.col("p_two")).alias("p"), F.when(less, "less").otherwise("two-sided").alias("alternative"), "permutations")
    ci = stats.bootstrap_interval(both(stats.bootstrap_sums(rows, keys, "result_id", "d")), keys).select(*keys, "ci_low", "ci_high")
    out = out.join(p, keys).join(ci, keys)
    return out.withColumn("decision", F.when((F.col("p") < 0.05) & (F.col("direction") != "same"), "different").otherwise("not shown"))


@query()
def hypothesis_tests(spark, base):
    """hypothesis_table with permutation p (one-sided under overlap), bootstrap interval and decision."""
    return rounded(_hypotheses(spark, base, tests=True))


@query(
    S + """, q AS (SELECT model, quantile_cont(wer, 0.25) AS q1, quantile_cont(wer, 0.75) AS q3 FROM ok WHERE wer IS NOT NULL AND model IS NOT NULL GROUP BY model),
o AS (SELECT model, noise_type, wer > q3 + 1.5 * (q3 - q1) AS x FROM ok JOIN q USING (model) WHERE wer IS NOT NULL AND noise_type IS NOT NULL),
c AS (SELECT model, noise_type, count(*) FILTER (x) AS k, count(*) AS n FROM o GROUP BY ALL),
p AS (SELECT model, noise_type, k, k / nullif(sum(k) OVER (PARTITION BY model), 0) - n / sum(n) OVER (PARTITION BY model) AS d FROM c)
SELECT model, noise_type, k AS n_outliers, round(d, 6) AS excess, CASE WHEN d IS NULL THEN 'none' WHEN d > 0.1 THEN 'high' WHEN d < -0.1 THEN 'low' ELSE 'mixed' END AS side FROM p"""
)
def outlier_profile(spark, base):
    """Share of a model's outliers by noise against its share of all results, labelled beyond a tolerance of 0.1."""
    o = stats.iqr_outliers(frames.successful(scores(spark, base)).where("model is not null"), ["model"], "wer").where("noise_type is not null")
    c = o.groupBy("model", "noise_type").agg(F.count_if("is_outlier").alias("k"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("model")
    d = F.try_divide(F.col("k"), F.sum("k").over(w)) - F.col("n") / F.sum("n").over(w)
    c = c.withColumn("d", d)
    side = F.when(F.col("d").isNull(), "none").when(F.col("d") > 0.1, "high").when(F.col("d") < -0.1, "low").otherwise("mixed")
    return c.select("model", "noise_type", F.col("k").alias("n_outliers"), r6("d").alias("excess"), side.alias("side"))


@query("SELECT example_id, model FROM worst_wer_examples WHERE hypothesis IS NULL OR trim(hypothesis) = '' OR starts_with(clip_id, 'real_')")
def odd_examples(spark, base):
    return table(spark, base, "worst_wer_examples").where(F.col("hypothesis").isNull() | (F.trim("hypothesis") == "") | F.col("clip_id").startswith("real_")).select("example_id", "model")


# -- the report of one model over its full scope ------------------------------------------------------------------------

#: Section: whether it takes raw, effective, clean or noisy rows, and its keys.
SECTIONS = {
    "overall_raw": ("raw", []), "overall_effective": ("all", []), "clean_effective": ("clean", []), "noisy_effective": ("noisy", []), "by_snr": ("all", ["snr_label"]), "by_overlap": ("all", ["ovr_label"]),
    "by_snr_and_overlap": ("all", ["snr_label", "ovr_label"]), "by_noise_type_noisy_only": ("noisy", ["noise_type"]), "by_noise_type_including_clean": ("all", ["noise_type"]), "condition_means": ("all", ["snr_label", "ovr_label", "noise_type"]),
}
_SCOPE = S + """, raw AS (SELECT * FROM ok WHERE model = 'wav2vec2'), k AS (SELECT *, row_number() OVER (PARTITION BY model, base_mixture_id, overlap_ratio, max_speakers ORDER BY noise_type NULLS FIRST, clip_id NULLS FIRST, result_id) AS rn FROM raw WHERE snr_db IS NULL),
al AS (SELECT snr_label, ovr_label, 'clean' AS noise_type, wer, mrs_wer, cpwer, orc_wer FROM k WHERE rn = 1 UNION ALL SELECT snr_label, ovr_label, noise_type, wer, mrs_wer, cpwer, orc_wer FROM raw WHERE snr_db IS NOT NULL),
"""
_FROM = {"raw": "raw", "all": "al", "clean": "al WHERE snr_label = 'clean'", "noisy": "al WHERE snr_label <> 'clean'"}
_KEYS3 = ["snr_label", "ovr_label", "noise_type"]


@query(
    _SCOPE + "x AS (" + " UNION ALL ".join(f"SELECT '{name}' AS section, " + ", ".join(k if k in keys else f"NULL AS {k}" for k in _KEYS3) + f", wer, mrs_wer, cpwer, orc_wer FROM {_FROM[rows]}" for name, (rows, keys) in SECTIONS.items()) + f"""),
y AS (SELECT section, snr_label, ovr_label, noise_type, unnest([{', '.join(repr(x) for x in clip.METRICS)}]) AS metric, unnest([wer, mrs_wer, cpwer, orc_wer]) AS value FROM x)
SELECT section, snr_label, ovr_label, noise_type, metric, count(*) AS n_rows, {DESCRIBE.format('value')} FROM y GROUP BY ALL"""
)
def full_scope(spark, base):
    """Every summary of one model's results, raw and with clean rows taken once, in one pass over its rows."""
    raw = frames.successful(scores(spark, base)).where("model = 'wav2vec2'")
    rows = frames.dedup_clean(raw).withColumn("of", F.when(F.col("snr_label") == "clean", F.array(F.lit("all"), F.lit("clean"))).otherwise(F.array(F.lit("all"), F.lit("noisy"))))
    rows = rows.unionByName(raw.withColumn("of", F.array(F.lit("raw"))), allowMissingColumns=True)
    parts = F.array(*[F.struct(F.lit(n).alias("section"), F.lit(of).alias("of"), *[(F.col(k) if k in keys else F.lit(None).cast("string")).alias(k) for k in _KEYS3]) for n, (of, keys) in SECTIONS.items()])
    rows = rows.select(*clip.METRICS, F.explode(F.filter(parts, lambda p: F.array_contains("of", p["of"]))).alias("p")).select("p.section", *[F.col(f"p.{k}").alias(k) for k in _KEYS3], *clip.METRICS)
    keys = ["section", *_KEYS3]
    long = frames.unpivot(rows, keys)
    out = long.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n_rows"), *summary.describe("value"))
    return rounded(ranking.with_percentiles(out, long, [*keys, "metric"], {"median": (F.col("value"), 0.5)}))


#: The four published summary files and the queries whose tables they hold.
SUMMARY_FILES = {
    "statistical_analysis_summary": ["model_totals", "metric_summary", "condition_sets", "friedman", "wilcoxon", "holm", "hypothesis_tests", "transfer", "gap_by_overlap"],
    "full_scope_summary": ["full_scope", "partial_eta", "wer_surface", "delta_to_clean"],
    "wer_outlier_condition_summary": ["iqr_outliers", "outlier_shares", "outlier_profile"],
    "worst_wer_examples": ["worst_examples"],
}


def write_summaries(spark, base, folder: str, files: list[str] | None = None) -> list[str]:
    """The files (all four, or those named), their members sorted; small report tables only, as sinks.summary_json refuses
    others."""
    paths = []
    for name in files or SUMMARY_FILES:
        paths.append(f"{folder}/{name}.json")
        sinks.summary_json({q: QUERIES[q](spark, base) for q in SUMMARY_FILES[name]}, paths[-1])
    return paths


# -- utterances -------------------------------------------------------------------------------------------------------

_U = r"""WITH u AS (SELECT DISTINCT utt_id, session_id, (x[1]::BIGINT * 3600 + x[2]::BIGINT * 60)::DOUBLE + x[3]::DOUBLE AS s, (y[1]::BIGINT * 3600 + y[2]::BIGINT * 60)::DOUBLE + y[3]::DOUBLE AS e
  FROM (SELECT utt_id, session_id, string_split(start_time, ':') AS x, string_split(end_time, ':') AS y FROM utterances
    WHERE regexp_full_match(start_time, '[0-9]+:[0-9]{1,2}:[0-9]{1,2}([.][0-9]{1,3})?') AND regexp_full_match(end_time, '[0-9]+:[0-9]{1,2}:[0-9]{1,2}([.][0-9]{1,3})?'))),
v AS (SELECT * FROM u WHERE e > s)
"""


def spans(spark, base) -> DataFrame:
    """Readable utterances, each once, with start and end in seconds."""
    ok = r"^[0-9]+:[0-9]{1,2}:[0-9]{1,2}([.][0-9]{1,3})?$"
    u = table(spark, base, "utterances").where(F.col("start_time").rlike(ok) & F.col("end_time").rlike(ok))
    u = u.select("utt_id", F.coalesce("session_id", F.lit("S01")).alias("session_id"), "speaker", "words", clip.clock_seconds(F.col("start_time")).alias("s"), clip.clock_seconds(F.col("end_time")).alias("e"))
    return u.dropDuplicates(["utt_id"]).where("e > s")


@query(_U + "SELECT session_id, count(*) AS n, round(min(s), 6) AS first_start, round(max(e), 6) AS last_end, round(sum(e - s), 6) AS seconds FROM v GROUP BY session_id")
def session_totals(spark, base):
    return rounded(spans(spark, base).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first_start"), F.max("e").alias("last_end"), F.sum(F.col("e") - F.col("s")).alias("seconds")))


@query(_U + ", c AS (SELECT DISTINCT session_id, e AS at FROM v) SELECT c.session_id, round(c.at, 6) AS at, (SELECT count(*) FROM v WHERE v.session_id = c.session_id AND v.s < c.at AND v.e > c.at) AS n_crossing FROM c")
def interval_stab(spark, base):
    return rounded(segment.crossings(spans(spark, base), ["session_id"], "s", "e"))


@query(_U + ", w AS (SELECT DISTINCT session_id, floor(s / 60) * 60 AS a, floor(s / 60) * 60 + 60 AS b FROM v) SELECT w.session_id, round(w.a, 6) AS w_start, count(*) AS n FROM w JOIN v ON v.session_id = w.session_id AND v.s >= w.a AND v.e <= w.b GROUP BY ALL")
def interval_contain(spark, base):
    u = spans(spark, base)
    w = u.select("session_id", (F.floor(F.col("s") / 60) * 60).cast("double").alias("w_start")).distinct().withColumn("w_end", F.col("w_start") + 60)
    return rounded(segment.contained(u, w, ["session_id"], "s", "e").groupBy("session_id", "w_start").agg(F.count(F.lit(1)).alias("n")))


@query(_U.replace("WITH u", "WITH RECURSIVE u") + """, f AS (SELECT DISTINCT session_id, e AS t FROM v WHERE NOT EXISTS (SELECT 1 FROM v x WHERE x.session_id = v.session_id AND x.s < v.e AND x.e > v.e)),
d AS (SELECT DISTINCT session_id, s AS a FROM v), nb AS (SELECT d.session_id, a, min(f.t) AS b FROM d JOIN f ON f.session_id = d.session_id AND f.t > a AND f.t - a >= 30.0 GROUP BY ALL),
nx AS (SELECT nb.session_id, nb.a, b, min(d.a) AS a2 FROM nb LEFT JOIN d ON d.session_id = nb.session_id AND d.a >= b GROUP BY ALL),
g AS (SELECT nx.session_id, 1 AS clip_no, nx.a, nx.b, a2 FROM nx JOIN (SELECT session_id, min(a) AS a FROM d GROUP BY session_id) m ON m.session_id = nx.session_id AND m.a = nx.a
  UNION ALL SELECT nx.session_id, clip_no + 1, nx.a, nx.b, nx.a2 FROM g JOIN nx ON nx.session_id = g.session_id AND nx.a = g.a2)
SELECT session_id, clip_no, round(a, 6) AS w_start, round(b, 6) AS w_end FROM g""")
def segment_greedy(spark, base):
    return rounded(segment.greedy_windows(spans(spark, base), "session_id", "s", "e", 30.0))


# -- wider factor tables ----------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc,
  CASE WHEN grouping(l_linestatus) = 1 THEN CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE 'l_returnflag' END ELSE 'l_returnflag+l_linestatus' END AS grouping
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def lineitem_sets(spark, base):
    li = table(spark, base, "lineitem")
    aggs = [F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r6(F.avg("l_discount")).alias("avg_disc")]
    return summary.grouped_sets(li, [["l_returnflag", "l_linestatus"], ["l_returnflag"], []], aggs)


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, count(*) AS n FROM events GROUP BY event_type")
def event_quartiles(spark, base):
    e = table(spark, base, "events").where("value is not null")
    return rounded(e.groupBy("event_type").agg(F.percentile("value", 0.25).alias("q1"), F.median("value").alias("median"), F.percentile("value", 0.75).alias("q3"), F.count(F.lit(1)).alias("n")))
