"""The tolerant reader of transcript literals.

A transcript cell is a list literal of tuples (speaker, text[, start, end]). Cells whose quotes were doubled by a CSV
writer, or whose text lost its quotes, are repaired before they are given up.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = T.StructType([
    T.StructField("seg_no", T.IntegerType()), T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()),
])
SEGMENTS = T.ArrayType(SEGMENT)

_PAIR = re.compile(r'""(.*?)""', re.S)
_TUPLE4 = re.compile(r"\(\s*('[^']*'|\"[^\"]*\")\s*,\s*(?!['\"])(.*?)\s*,\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*\)", re.S)
_TUPLE2 = re.compile(r"\(\s*('[^']*'|\"[^\"]*\")\s*,\s*(?!['\"])([^(),]*?)\s*\)", re.S)


def _repaired(text: str) -> str:
    text = _TUPLE4.sub(lambda m: f"({m[1]}, {m[2]!r}, {m[3]}, {m[4]})", text)
    return _TUPLE2.sub(lambda m: f"({m[1]}, {m[2]!r})", text)


def parse(cell: str | None) -> list:
    """The list in a cell; [] for blank cells and other literals; ValueError if no repair helps."""
    if cell is None or not cell.strip():
        return []
    tries = [cell]
    if '""' in cell:
        tries += [_PAIR.sub(r'"\1"', cell), cell.replace('""', '"')]
    tries += [_repaired(t) for t in list(tries)]
    error: Exception | None = None
    for t in tries:
        try:
            got = ast.literal_eval(t)
            return got if isinstance(got, list) else []
        except (SyntaxError, ValueError, MemoryError, RecursionError, TypeError) as e:
            error = e
    raise ValueError(f"not a transcript literal: {error}")


def _number(x: object) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def segments(got: list) -> list[tuple]:
    """(seg_no, speaker, text, start, end) of the entries that have at least a speaker and a text."""
    out = []
    for i, x in enumerate(got):
        if isinstance(x, (list, tuple)) and len(x) >= 2:
            s, t = x[0], x[1]
            out.append((i, None if s is None else str(s), t if isinstance(t, str) else None if t is None else str(t), _number(x[2]) if len(x) > 3 else None, _number(x[3]) if len(x) > 3 else None))
    return out


def parse_transcript(cell: Column, strict: bool = False) -> Column:
    """array<segment> of a literal column; an unreadable cell gives [] or, if strict, fails the query."""

    @F.pandas_udf(SEGMENTS)
    def run(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in cells:
            out = []
            for x in c:
                try:
                    out.append([dict(zip(SEGMENT.names, s)) for s in segments(parse(x))])
                except ValueError:
                    if strict:
                        raise
                    out.append([])
            yield pd.Series(out, dtype=object)

    return run(cell)
