"""Registered queries that score the hypotheses of the transcription records against the manifest. The kernels have no
SQL form; they are tested against brute force and published triples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clip, text
from ..operators import metrics, ranking
from ..session import spread, table
from ..sources import readers
from .problems import SEGMENTS
from .reports import nudged, rounded


def references(spark: SparkSession, base: str) -> DataFrame:
    return readers.references(table(spark, base, "mixture_meta"), order="loaded_at")


def hypotheses(spark: SparkSession, base: str) -> DataFrame:
    return metrics.hypotheses(table(spark, base, "mixture_transcription"))


def eval_scores(spark: SparkSession, base: str) -> DataFrame:
    """All metrics of every clip and model, exact two-stream distance."""
    return rounded(metrics.evaluate(references(spark, base), hypotheses(spark, base), clip.MODELS))


def eval_summary(spark: SparkSession, base: str) -> DataFrame:
    e = eval_scores(spark, base)
    return e.groupBy("model_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("successful"), *[F.round(F.avg(m), 6).alias(f"{m}_mean") for m in clip.METRICS])


def eval_wer_only(spark: SparkSession, base: str) -> DataFrame:
    """The plain rate alone: no Python kernel in the plan beyond the literal reader."""
    return rounded(metrics.evaluate(references(spark, base), hypotheses(spark, base), clip.MODELS, ["wer"]))


def real_eval(spark: SparkSession, base: str) -> DataFrame:
    return rounded(metrics.real_scores(references(spark, base), hypotheses(spark, base)))


def real_summary(spark: SparkSession, base: str) -> DataFrame:
    """Rates over raw words per model: count, mean, median, least, greatest, deviation (0 for one)."""
    e = metrics.real_scores(references(spark, base), hypotheses(spark, base)).select("model_name", "wer")
    out = e.groupBy("model_name").agg(F.count("wer").alias("n"), F.avg("wer").alias("mean"), F.min("wer").alias("min"), F.max("wer").alias("max"), F.coalesce(F.stddev_samp("wer"), F.lit(0.0)).alias("sd"))
    return rounded(ranking.with_percentiles(out, e, ["model_name"], {"median": (F.col("wer"), 0.5)}))


def speaker_chains(spark: SparkSession, base: str) -> DataFrame:
    """The two chains of the first two speakers of every clip."""
    c = text.chains(F.col("segments"), text.n1)
    return references(spark, base).select("clip_id", c.alias("c"), F.size(text.speaker_texts(F.col("segments"))).alias("n_speakers")).select("clip_id", "n_speakers", F.size("c.a").alias("n_a"), F.size("c.b").alias("n_b"), F.md5(F.array_join(F.concat("c.a", "c.b"), "|")).alias("digest"))


def align_ops(spark: SparkSession, base: str) -> DataFrame:
    """Counts of alignment steps per model over the listed examples."""
    w = table(spark, base, "worst_wer_examples").where("reference is not null")
    a = metrics.alignment(text.n1(F.col("reference")), text.n1(F.col("hypothesis")))
    steps = spread(w, "example_id").select("model", F.explode(a["steps"]).alias("s"))
    return steps.groupBy("model", F.col("s.op").alias("op")).agg(F.count(F.lit(1)).alias("n"))


def chain_ops(spark: SparkSession, base: str) -> DataFrame:
    """Steps of the exact two-stream alignments per model and chain, over all clips with a hypothesis."""
    c = text.chains(F.col("segments"), text.n1)
    refs = references(spark, base).select("clip_id", c.alias("c"))
    hyps = hypotheses(spark, base).select("clip_id", "model_name", F.flatten(F.transform("segments", lambda s: text.n1(s["text"]))).alias("h"))
    pairs = refs.join(hyps, "clip_id").repartition("clip_id", "model_name")
    steps = pairs.withColumn("x", metrics.two_stream_alignment(F.col("c.a"), F.col("c.b"), F.col("h"))).select("model_name", F.explode("x.steps").alias("s"))
    return steps.groupBy("model_name", F.col("s.chain").alias("chain"), F.col("s.op").alias("op")).agg(F.count(F.lit(1)).alias("n"))


_STR = r"(?:'(?:[^'\\]|\\.)*'|" + r'"(?:[^"\\]|\\.)*")'
_PAIR = rf"[(] *({_STR}) *, *({_STR})".replace("'", "''")
_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda w: w <> '')"
_QUOTE = r"replace(x[2:-2], '\''', '''')"
_REFS = f"""ref AS (SELECT trim(clip_id) AS clip_id, max_by(transcript, loaded_at) AS t FROM mixture_meta WHERE trim(clip_id) <> '' GROUP BY 1),
s AS (SELECT clip_id, list_transform(regexp_extract_all(coalesce(t, ''), '{_PAIR}', 1, 's'), lambda x: x[2:-2]) AS who, list_transform(regexp_extract_all(coalesce(t, ''), '{_PAIR}', 2, 's'), lambda x: {_QUOTE}) AS txt FROM ref)"""
_TEXT = "CASE json_type(x) WHEN 'VARCHAR' THEN x ->> '$' WHEN 'ARRAY' THEN CASE WHEN json_type(x, '$[1]') = 'VARCHAR' THEN x ->> '$[1]' ELSE '' END WHEN 'OBJECT' THEN CASE WHEN json_type(x, '$.text') = 'VARCHAR' THEN x ->> '$.text' ELSE '' END ELSE '' END"
#: The words of references and hypotheses, then the rate by the classical table.
PLAIN = SEGMENTS.replace("s AS (SELECT record_id, model, generate", "sg AS (SELECT record_id, model, generate").replace("FROM s WHERE json_type(x)", "FROM sg WHERE json_type(x)") + f""", {_REFS},
hs AS (SELECT l.record_id, l.model, coalesce(any_value(g.txt), []) AS txt FROM l LEFT JOIN (SELECT record_id, model, list({_TEXT} ORDER BY i) AS txt FROM seg GROUP BY ALL) g USING (record_id, model) GROUP BY ALL),
hyp AS (SELECT clip_id, model, max_by(txt, (received_at, record_id)) AS htxt FROM hs JOIN mixture_transcription USING (record_id) WHERE clip_id IS NOT NULL AND payload IS NOT NULL GROUP BY ALL),
c AS (SELECT DISTINCT clip_id FROM (SELECT clip_id FROM s UNION ALL SELECT clip_id FROM hyp)), g AS (SELECT clip_id, unnest({clip.MODELS}) AS model FROM c),
w AS (SELECT g.clip_id, g.model, htxt, s.txt AS rtxt, flatten(list_transform(s.txt, lambda z: {_WORDS.format('z')})) AS r, flatten(list_transform(htxt, lambda z: {_WORDS.format('z')})) AS h FROM g LEFT JOIN hyp ON hyp.clip_id = g.clip_id AND hyp.model = g.model LEFT JOIN s ON s.clip_id = g.clip_id),
k AS (SELECT *, CASE WHEN htxt IS NULL THEN 'Hypothesis not found' WHEN rtxt IS NULL THEN 'Reference not found' WHEN len(r) = 0 AND len(h) > 0 THEN 'Reference has no words' END AS error FROM w),
x AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN len(h) = 0 THEN 1.0 ELSE
    list_reduce(list_prepend(range(0, len(h) + 1), list_transform(range(1, len(r) + 1), lambda i: [i])),
      lambda prev, cur: list_reduce(list_prepend([cur[1]], list_transform(range(1, len(h) + 1), lambda j: [j])),
        lambda acc, jj: list_append(acc, least(acc[len(acc)] + 1, prev[jj[1] + 1] + 1, prev[jj[1]] + CASE WHEN r[cur[1]] = h[jj[1]] THEN 0 ELSE 1 END))))[-1] / len(r) END AS wer FROM k)
"""
_RAW = r"flatten(list_transform(list_filter({0}, lambda z: trim(z) <> ''), lambda z: list_filter(regexp_split_to_array(z, '\s+'), lambda w: w <> '')))"
SQL: dict[str, str] = {
    "real_summary": nudged(PLAIN[: PLAIN.index("c AS (SELECT DISTINCT clip_id")] + f"""p AS (SELECT model, {_RAW.format('s.txt')} AS r, {_RAW.format('htxt')} AS h FROM hyp JOIN s USING (clip_id)),
y AS (SELECT model, CASE WHEN len(h) = 0 THEN 1.0 ELSE list_reduce(list_prepend(range(0, len(h) + 1), list_transform(range(1, len(r) + 1), lambda i: [i])),
      lambda prev, cur: list_reduce(list_prepend([cur[1]], list_transform(range(1, len(h) + 1), lambda j: [j])),
        lambda acc, jj: list_append(acc, least(acc[len(acc)] + 1, prev[jj[1] + 1] + 1, prev[jj[1]] + CASE WHEN r[cur[1]] = h[jj[1]] THEN 0 ELSE 1 END))))[-1] / len(r) END AS wer FROM p WHERE len(r) > 0)
SELECT model AS model_name, count(wer) AS n, round(avg(wer), 6) AS mean, round(median(wer), 6) AS median, round(min(wer), 6) AS min, round(max(wer), 6) AS max, round(coalesce(stddev_samp(wer), 0), 6) AS sd FROM y GROUP BY model"""),
    "eval_wer_only": nudged(PLAIN + """SELECT clip_id, model AS model_name, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error, CASE WHEN htxt IS NOT NULL AND rtxt IS NOT NULL THEN len(rtxt)::INTEGER END AS ref_segments,
  CASE WHEN htxt IS NOT NULL AND rtxt IS NOT NULL THEN len(htxt)::INTEGER END AS hyp_segments, CASE WHEN htxt IS NOT NULL AND rtxt IS NOT NULL THEN len(htxt) > 1 END AS is_segmented, round(wer, 6) AS wer,
  NULL::DOUBLE AS mrs_wer, NULL::DOUBLE AS cpwer, NULL::DOUBLE AS orc_wer, 'wer_only' AS wer_method, CASE WHEN htxt IS NOT NULL AND rtxt IS NOT NULL THEN CASE WHEN len(htxt) > 1 THEN 'segmented' ELSE 'not segmented' END END AS metric_type FROM x"""),
    "speaker_chains": f"""WITH {_REFS},
u AS (SELECT clip_id, unnest(who) AS who, unnest(txt) AS txt, generate_subscripts(who, 1) AS i FROM s),
f AS (SELECT clip_id, who, row_number() OVER (PARTITION BY clip_id ORDER BY min(i)) AS place, flatten(list({_WORDS.format('txt')} ORDER BY i)) AS w, bool_or(trim(txt) <> '') AS spoken FROM u GROUP BY clip_id, who)
SELECT s.clip_id, (count(*) FILTER (spoken))::INTEGER AS n_speakers, coalesce(max(len(w)) FILTER (place = 1), 0)::INTEGER AS n_a, coalesce(max(len(w)) FILTER (place = 2), 0)::INTEGER AS n_b,
  md5(array_to_string(list_concat(coalesce(any_value(w) FILTER (place = 1), []), coalesce(any_value(w) FILTER (place = 2), [])), '|')) AS digest FROM s LEFT JOIN f USING (clip_id) GROUP BY s.clip_id""",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (eval_scores, eval_summary, eval_wer_only, real_eval, real_summary, speaker_chains, align_ops, chain_ops)
}
