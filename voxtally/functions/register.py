"""The functions under their SQL names.

What has a column expression is registered as an SQL function and stays in the JVM; kernels are Python functions, the
tests aggregates over Arrow batches, and the cutting of recordings a table function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import segment, stats
from . import clip, kernels, literal
from .text import IN_BMP, PUNCTUATION

_STEP = "struct<op: string, ref: string, hyp: string>"
_SPLIT = r"filter(split({0}, '(?U)\\s+'), w -> w <> '')"
_DROP = r"regexp_replace(lower(coalesce(t, '')), '(?U)[^\\p{{L}}\\p{{N}}{0}\\s]', '')"
_CODE = f"CASE WHEN array_position(p.voc, w) <= {IN_BMP} THEN array_position(p.voc, w) + {0x4E00 - 1} ELSE (shiftright(array_position(p.voc, w) - {IN_BMP + 1}, 10) + {0xD800}) * 65536 + ((array_position(p.voc, w) - {IN_BMP + 1}) & 1023) + {0xDC00} END"
_LETTERS = f"array_join(transform({{0}}, w -> decode(unhex(hex({_CODE})), 'UTF-16BE')), '')"
#: Name, parameters, type and body.
SQL_FUNCTIONS = [
    ("normalize_words", "t STRING, mode STRING", "ARRAY<STRING>",
     f"CASE mode WHEN 'n1' THEN {_SPLIT.format(_DROP.format('_'))} WHEN 'n2' THEN {_SPLIT.format(_DROP.format(''))} WHEN 'n3' THEN transform({_SPLIT.format("coalesce(t, '')")}, w -> translate(lower(w), {{punctuation}}, '')) END"),
    ("word_levenshtein", "r ARRAY<STRING>, h ARRAY<STRING>", "INT",
     f"get(transform(array(named_struct('voc', array_distinct(concat(r, h)), 'r', r, 'h', h)), p -> levenshtein({_LETTERS.format('p.r')}, {_LETTERS.format('p.h')})), 0)"),
    ("wer", "r STRING, h STRING", "DOUBLE", "try_divide(word_levenshtein(normalize_words(r, 'n2'), normalize_words(h, 'n2')), size(normalize_words(r, 'n2')))"),
    ("parse_clip_id", "id STRING", "STRUCT<variant_index: BIGINT, base_mixture_id: BIGINT, overlap_ratio: DOUBLE, max_speakers: INT, snr_db: DOUBLE, noise_type: STRING>",
     "get(transform(array(split(id, '_', -1)), p -> named_struct('variant_index', CASE WHEN get(p, 1) RLIKE '^[0-9]+$' THEN try_cast(get(p, 1) AS BIGINT) END, 'base_mixture_id', CASE WHEN get(p, 1) RLIKE '^[0-9]+$' THEN floor(try_cast(get(p, 1) AS BIGINT) / 12) END, "
     "'overlap_ratio', CASE WHEN size(p) >= 6 THEN try_cast(get(p, 2) AS DOUBLE) END, 'max_speakers', CASE WHEN size(p) >= 6 THEN try_cast(get(p, 3) AS INT) END, 'snr_db', CASE WHEN size(p) >= 6 AND get(p, 4) NOT IN ('', 'None') THEN try_cast(get(p, 4) AS DOUBLE) END, 'noise_type', CASE WHEN size(p) >= 6 AND get(p, 5) NOT IN ('', 'None') THEN get(p, 5) END)), 0)"),
]


class SegmentReal:
    """segment_real(TABLE(..) PARTITION BY session, min_length => 60): the windows of one recording from the first two
    columns, start and end in seconds."""

    def __init__(self) -> None:
        self.spans: list[tuple[float, float]] = []
        self.least = 60.0

    def eval(self, row: T.Row, min_length: float = 60.0):
        self.least = float(min_length)
        if row[0] is not None and row[1] is not None and row[1] > row[0]:
            self.spans.append((float(row[0]), float(row[1])))

    def terminate(self):
        starts, ends = sorted(s for s, _ in self.spans), sorted(e for _, e in self.spans)
        a = np.searchsorted(starts, ends, "left") - np.searchsorted(ends, ends, "right")  # begun before and not yet over
        free = sorted({e for e, n in zip(ends, a) if n == 0})
        for i, (s, e) in enumerate(segment.greedy(sorted(set(starts)), free, self.least), 1):
            yield i, s, e


def register(spark: SparkSession) -> list[str]:
    """Make the library's functions callable from SQL; their names."""
    for name, parameters, kind, body in SQL_FUNCTIONS:
        quoted = "'" + PUNCTUATION.replace("\\", "\\\\").replace("'", "\\'") + "'"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body.replace('{punctuation}', quoted)}")

    def parse(cell: str | None) -> list:
        try:
            return [dict(zip(literal.SEGMENT.names, s)) for s in literal.segments(literal.parse(cell))]
        except ValueError:
            return []

    pairs = lambda x: [(s["speaker"], s["text"] or "") for s in x or []]
    table = {
        "parse_transcript": (parse, T.ArrayType(literal.SEGMENT)),
        "cp_wer": (lambda r, h: kernels.cp_wer(pairs(r), pairs(h)), "double"),
        "di_cp_wer": (lambda r, h: kernels.di_cp_wer(pairs(r), pairs(h)), "double"),
        "orc_wer": (lambda r, h: kernels.orc_wer(r, h), "double"),
        "dss_wer": (lambda a, b, h, mode="exact": kernels.dss_wer(a, b, h) if mode == "exact" else kernels.Beam(64, 0.4, 16, 160_000).distance(a, b, h) / (len(a) + len(b)), "double"),
        "align_words": (lambda r, h: [{"op": o, "ref": a, "hyp": b} for o, a, b in kernels.align(r or [], h or [])[2]], f"array<{_STEP}>"),
        "stable_seed": (clip.stable_seed, "long"),
    }
    for name, (f, kind) in table.items():
        spark.udf.register(name, f, kind)

    def permutation_test(d: pd.Series) -> float:
        return stats.permutation_exact_order(d.to_numpy(dtype=np.float64), stats.DRAWS, 20260425)

    def bootstrap_ci(d: pd.Series) -> list[float]:
        x = d.to_numpy(dtype=np.float64)
        x = x[np.isfinite(x)]
        if not len(x):
            return [float("nan")] * 2
        sums = stats.poisson_block(np.arange(len(x), dtype=np.uint64), x, stats.DRAWS).reshape(2, -1)
        means = sums[0][sums[1] > 0] / sums[1][sums[1] > 0]
        return np.percentile(means, [2.5, 97.5]).tolist()

    permutation_test.__annotations__ = {"d": pd.Series, "return": float}
    bootstrap_ci.__annotations__ = {"d": pd.Series, "return": list}
    aggregates = {"permutation_test": (permutation_test, "double"), "bootstrap_ci": (bootstrap_ci, "array<double>")}
    for name, (f, kind) in aggregates.items():
        spark.udf.register(name, F.pandas_udf(f, kind, F.PandasUDFType.GROUPED_AGG))
    spark.udtf.register("segment_real", F.udtf(SegmentReal, returnType="clip_no: int, w_start: double, w_end: double"))
    return [x[0] for x in SQL_FUNCTIONS] + list(table) + list(aggregates) + ["segment_real"]
