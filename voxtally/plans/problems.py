"""Registered queries of the general data-processing problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import badrows, intervals, nested
from ..session import table


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return badrows.load_manifest_lines(table(spark, base, "manifest_lines"))[1]


def p2_manifest(spark: SparkSession, base: str) -> DataFrame:
    return badrows.load_manifest_lines(table(spark, base, "manifest_lines"))[0]


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return intervals.speaking(table(spark, base, "utterances"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return nested.links(table(spark, base, "mixture_transcription"), table(spark, base, "wer_result_files"))


def p5_nodes(spark: SparkSession, base: str) -> DataFrame:
    """All node tables one below the other, each row with the label of its parent."""
    nodes = nested.all_nodes(table(spark, base, "mixture_transcription"), table(spark, base, "wer_result_files"))
    return nodes.select("node_type", *[c for c in nodes.columns if c != "node_type"])


def p5_rejects(spark: SparkSession, base: str) -> DataFrame:
    """The records of both tables whose payload cannot be read."""
    t, r = (nested.rejects(table(spark, base, n), "record_id", "payload").withColumn("source", F.lit(n)) for n in ("mixture_transcription", "wer_result_files"))
    return t.unionByName(r)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found, "p2_manifest": p2_manifest, "p4_found": p4_found, "p5_found": p5_found, "p5_nodes": p5_nodes, "p5_rejects": p5_rejects,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FIELD = r'''(?:"[^"]*(?:""[^"]*)*"|[^",]*)'''
_STR = r'''(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")'''
_NUM = r"[-+]?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?"
_TUPLE = rf"\(\s*{_STR}\s*,\s*{_STR}\s*(?:,\s*{_NUM}\s*,\s*{_NUM}\s*)?,?\s*\)"
_LIST = rf"\s*\[\s*(?:{_TUPLE}(?:\s*,\s*{_TUPLE})*\s*,?\s*)?\]\s*"
_NUMBER = r"'[+-]?[0-9]+(\.[0-9]+)?'"
#: Fields and reason of every record; the transcript by the grammar of the literals that occur.
_LINES = rf"""WITH r AS (SELECT line_id, regexp_replace(coalesce(raw, ''), '\r$', '') AS rec FROM manifest_lines),
f AS (SELECT line_id, CASE WHEN regexp_full_match(rec, {_quoted(_FIELD + '(?:,' + _FIELD + ')*')}, 's') THEN list_transform(regexp_extract_all(',' || rec, {_quoted(',(' + _FIELD + ')')}, 1, 's'), lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) END AS f FROM r),
w AS (SELECT line_id, f, CASE WHEN f IS NULL THEN 'quoting' WHEN len(f) <> 11 THEN 'columns'
  WHEN NOT regexp_full_match(f[1], 'mix_[0-9]{{7}}_0\.[0-9]{{2}}_[1-9][0-9]*_(-?[0-9]+(\.[0-9]+)?|None)_[DPT]|real_[0-9]{{4,}}') THEN 'clip_id'
  WHEN NOT (regexp_full_match(f[4], {_NUMBER}) AND try_cast(f[4] AS DOUBLE) BETWEEN 0 AND 1 AND regexp_full_match(f[5], {_NUMBER}) AND try_cast(f[5] AS DOUBLE) BETWEEN 0 AND 1 AND regexp_full_match(f[6], '[0-9]*[1-9][0-9]*')
    AND (f[7] = '' OR regexp_full_match(f[7], {_NUMBER})) AND f[8] IN ('', 'D', 'P', 'T')) THEN 'value'
  WHEN f[3] <> '' AND NOT regexp_full_match(f[3], {_quoted(_LIST)}, 's') THEN 'transcript' END AS reason FROM f)
"""

#: Every segment of the transcription payloads: l has a row per model, seg one per element that is not null.
SEGMENTS = """WITH t AS (SELECT record_id, json_extract(CASE WHEN json_valid(payload) THEN payload ELSE '{}' END, '$.transcript') AS t FROM mixture_transcription),
m AS (SELECT record_id, unnest(json_keys(t)) AS model, t FROM t WHERE json_type(t) = 'OBJECT'),
v AS (SELECT record_id, model, json_extract(t, '$.' || json_quote(model)::VARCHAR) AS v FROM m),
l AS (SELECT record_id, model, CASE json_type(v) WHEN 'OBJECT' THEN json_extract(v, '$.segments') ELSE v END AS v, json_type(v) AS kind FROM v),
s AS (SELECT record_id, model, generate_subscripts(json_extract(v, '$[*]'), 1) - 1 AS i, unnest(json_extract(v, '$[*]')) AS x FROM l WHERE json_type(v) = 'ARRAY'),
seg AS (SELECT record_id, model, i, x FROM s WHERE json_type(x) <> 'NULL' UNION ALL SELECT record_id, model, 0, v FROM l WHERE kind = 'VARCHAR')
"""

SQL: dict[str, str] = {
    "p2_found": _LINES + "SELECT line_id, reason FROM w WHERE reason IS NOT NULL",
    "p2_manifest": _LINES + """SELECT line_id, f[1] AS clip_id, f[2] AS audio_path, f[3] AS transcript, f[4]::DOUBLE AS overlap_ratio_target, f[5]::DOUBLE AS overlap_ratio_actual, try_cast(f[6] AS INTEGER) AS max_speakers,
  nullif(f[7], '')::DOUBLE AS snr_db, nullif(f[8], '') AS noise_type, f[9] AS overlap_mask_path, f[10] AS source_files, f[11] AS noise_files FROM w WHERE reason IS NULL""",
    "p5_found": SEGMENTS + """,
r AS (SELECT record_id, json_extract(CASE WHEN json_valid(payload) THEN payload ELSE '{}' END, '$.results[*]') AS r FROM wer_result_files),
e AS (SELECT record_id, generate_subscripts(r, 1) - 1 AS i, unnest(r) AS x FROM r),
k AS (SELECT record_id, i, unnest(json_keys(json_extract(x, '$.metrics'))) AS k, json_extract(x, '$.metrics') AS m FROM e WHERE json_type(json_extract(x, '$.metrics')) = 'OBJECT'),
o AS (SELECT record_id, i, generate_subscripts(json_extract(x, '$.alignment[*]'), 1) - 1 AS j FROM e WHERE json_type(json_extract(x, '$.alignment')) = 'ARRAY')
SELECT 'segment' AS kind, record_id, model AS parent_key, i::VARCHAR AS child_key FROM seg
UNION ALL SELECT 'metric', record_id, i::VARCHAR, k FROM k WHERE json_type(json_extract(m, '$.' || json_quote(k)::VARCHAR)) <> 'NULL'
UNION ALL SELECT 'op', record_id, i::VARCHAR, j::VARCHAR FROM o
""",
    "p5_rejects": """
SELECT source, record_id, CASE WHEN payload IS NULL THEN 'null' ELSE 'json' END AS reason FROM (
  SELECT 'mixture_transcription' AS source, record_id, payload FROM mixture_transcription UNION ALL SELECT 'wer_result_files', record_id, payload FROM wer_result_files)
WHERE payload IS NULL OR NOT json_valid(payload)
""",
    "p4_found": r"""
WITH t AS (
  SELECT session_id, upper(regexp_replace(speaker, '^\s+|\s+$', '', 'g')) AS speaker,
    regexp_extract_all(start_time, '[0-9]+') AS a, regexp_extract_all(end_time, '[0-9]+') AS b
  FROM utterances
  WHERE speaker IS NOT NULL AND regexp_full_match(start_time, '[0-9]+:[0-9]{1,2}:[0-9]{1,2}([.][0-9]{1,3})?')
    AND regexp_full_match(end_time, '[0-9]+:[0-9]{1,2}:[0-9]{1,2}([.][0-9]{1,3})?')
), u AS (
  SELECT session_id, speaker,
    (a[1]::BIGINT * 3600 + a[2]::BIGINT * 60 + a[3]::BIGINT) * 1000 + rpad(coalesce(a[4], ''), 3, '0')::BIGINT AS s,
    (b[1]::BIGINT * 3600 + b[2]::BIGINT * 60 + b[3]::BIGINT) * 1000 + rpad(coalesce(b[4], ''), 3, '0')::BIGINT AS e
  FROM t
), v AS (
  SELECT *, max(e) OVER (PARTITION BY session_id, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM u WHERE e > s
), w AS (
  SELECT *, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM v
), p AS (
  SELECT session_id, speaker, min(s) AS s, max(e) AS e FROM w GROUP BY session_id, speaker, n
), q AS (
  SELECT *, lead(s) OVER (PARTITION BY session_id, speaker ORDER BY s) AS nxt FROM p
)
SELECT session_id, speaker, 'period' AS kind, s AS start_ms, e AS end_ms FROM q
UNION ALL SELECT session_id, speaker, 'gap', e, nxt FROM q WHERE nxt IS NOT NULL
""",
}
