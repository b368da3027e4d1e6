"""Loading of delimited records with a reason for each record that does not load.

A record is checked for its structure (quoting, number of fields) where it stands. The values of the checked columns
are then reduced to their distinct values, each of which is cast once; values that cannot be cast form a dictionary
(field, digest of the value, reason) that is joined back to the records.

Defined results: a null record counts as the empty record (one field); an empty table gives empty tables; repeated
records are judged one by one under their own id; extra columns of the input are ignored. Values are compared by
their SHA-256 digest in the join, so long texts cross the network once for the dictionary and never for the join.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged

#: One field of a record: quoted (quotes inside are doubled) or free of quotes. Possessive, so that it needs no stack.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
BARE = r'[^",]*+'
RECORD = rf"\A(?:{QUOTED}|{BARE})(?:,(?:{QUOTED}|{BARE}))*+\z"
FIELD = rf",({QUOTED}|{BARE})"
NUMBER = r"\A[+-]?[0-9]+(?:\.[0-9]+)?\z"


def record_text(raw: Column) -> Column:
    """The record without one carriage return at its very end; null counts as empty."""
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r"\r\z", "")


def split_record(record: Column) -> Column:
    """The fields of a record that passed RECORD, unquoted."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD), F.lit(1))
    return F.transform(
        fields,
        lambda x: F.when(
            x.startswith('"'), F.regexp_replace(x.substr(F.lit(2), F.length(x) - 2), '""', '"')
        ).otherwise(x),
    )


@dataclass(frozen=True)
class Check:
    """valid gives for a column of values whether each of them can be read."""

    fields: tuple[str, ...]
    reason: str
    valid: object = field(compare=False)


def structural(df: DataFrame, id_col: str, raw_col: str, names: list[str]) -> DataFrame:
    """id, reason (quoting, columns or null) and one string column per field name."""
    rec = record_text(F.col(raw_col))
    out = df.select(F.col(id_col).alias("__id"), rec.alias("__record")).withColumn("__quoted", F.col("__record").rlike(RECORD))
    out = out.withColumn("__fields", F.when(F.col("__quoted"), split_record(F.col("__record"))))
    reason = F.when(~F.col("__quoted"), "quoting").when(F.size("__fields") != len(names), "columns")
    return out.select(
        F.col("__id").alias(id_col),
        reason.alias("reason"),
        *[F.when(F.size("__fields") == len(names), F.col("__fields")[i]).alias(n) for i, n in enumerate(names)],
    )


def invalid_dictionary(cells: DataFrame, checks: list[Check]) -> DataFrame:
    """field, digest, place of the reason: one row per distinct value that cannot be read.

    The condition refers to the count of the value, else the optimizer would move the casts below the aggregation
    and so back to every record.
    """
    values = cells.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(checks))):
        mine = F.col("field").isin(*c.fields)
        ok = F.coalesce(c.valid(F.when(mine, F.col("value")), F.col("field")), F.lit(False))
        place = F.when(mine & ~ok, F.lit(i)).otherwise(place)
    place = F.when(F.col("n") > 0, place)
    return values.withColumn("place", place).where("place is not null").select("field", F.sha2("value", 256).alias("digest"), "place")


def split_valid(df: DataFrame, id_col: str, raw_col: str, names: list[str], checks: list[Check], salt: int = 8) -> tuple[DataFrame, DataFrame]:
    """(records that load, as strings; id and reason of those that do not).

    The join of cells with the dictionary is salted by the record's id: a value that a third of all records share,
    valid or not, is spread over `salt` keys.
    """
    rows = staged(structural(df, id_col, raw_col, names))  # records are cut into fields once; later steps read the columns they need
    sound = rows.where(F.col("reason").isNull())
    checked = [f for c in checks for f in c.fields]
    pairs = ", ".join(f"'{f}', `{f}`" for f in checked)
    cells = sound.select(F.col(id_col), F.expr(f"stack({len(checked)}, {pairs}) as (field, value)"))
    bad = invalid_dictionary(cells, checks).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    keyed = cells.select(id_col, "field", F.sha2("value", 256).alias("digest"), F.pmod(F.xxhash64(id_col), F.lit(salt)).cast("int").alias("salt"))
    hit = keyed.join(bad, ["field", "digest", "salt"]).groupBy(id_col).agg(F.min("place").alias("place"))
    reasons = F.array(*[F.lit(c.reason) for c in checks])
    rejected = rows.where(F.col("reason").isNotNull()).select(id_col, "reason").unionByName(hit.select(id_col, F.element_at(reasons, F.col("place") + 1).alias("reason")))
    return sound.drop("reason").join(hit.select(id_col), id_col, "left_anti"), rejected


# -- the mixture manifest ---------------------------------------------------------------------------------------------

MANIFEST = ["clip_id", "audio_path", "transcript", "overlap_ratio_target", "overlap_ratio_actual", "max_speakers", "snr_db", "noise_type", "overlap_mask_path", "source_files", "noise_files"]
CLIP_ID = r"\A(?:mix_[0-9]{7}_0\.[0-9]{2}_[1-9][0-9]*_(?:-?[0-9]+(?:\.[0-9]+)?|None)_[DPT]|real_[0-9]{4,})\z"

_STR = r"(?:'(?:[^'\\\n\r]|\\[^\n\rNuUx0-7])*'|\"(?:[^\"\\\n\r]|\\[^\n\rNuUx0-7])*\")"
_NUM = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?"
_TUPLE = rf"\( ?{_STR}, ?{_STR}(?:, ?{_NUM}, ?{_NUM})? ?\)"
#: The plain spelling; whatever it does not cover goes to the parser.
_PLAIN = re.compile(rf"\[(?:{_TUPLE}(?:, ?{_TUPLE})*)?\]")


def _is_number(node: ast.expr) -> bool:
    while isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
        node = node.operand
    return isinstance(node, ast.Constant) and type(node.value) in (int, float)


def is_segment_list(text: str) -> bool:
    """Whether text is a list literal of tuples of two strings, or of two strings and two numbers."""
    if _PLAIN.fullmatch(text) and "\0" not in text:
        return True
    try:
        body = ast.parse(text, mode="eval").body
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False
    return isinstance(body, ast.List) and all(
        isinstance(x, ast.Tuple)
        and len(x.elts) in (2, 4)
        and all(isinstance(e, ast.Constant) and isinstance(e.value, str) for e in x.elts[:2])
        and all(_is_number(e) for e in x.elts[2:])
        for x in body.elts
    )


@F.pandas_udf(T.BooleanType())
def _segment_lists(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in values:
        yield v.map(lambda x: x is not None and (x == "" or is_segment_list(x))).astype(bool)


def _value_ok(v: Column, f: Column) -> Column:
    number = v.rlike(NUMBER)
    return (
        F.when(f.isin("overlap_ratio_target", "overlap_ratio_actual"), number & v.try_cast("double").between(0, 1))
        .when(f == "max_speakers", v.rlike(r"\A[0-9]*[1-9][0-9]*\z"))
        .when(f == "snr_db", (v == "") | number)
        .otherwise(v.isin("", "D", "P", "T"))
    )


MANIFEST_CHECKS = [
    Check(("clip_id",), "clip_id", lambda v, f: v.rlike(CLIP_ID)),
    Check(("overlap_ratio_target", "overlap_ratio_actual", "max_speakers", "snr_db", "noise_type"), "value", _value_ok),
    Check(("transcript",), "transcript", lambda v, f: _segment_lists(v)),
]


def load_manifest_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed manifest rows with their line_id, line_id and reason of the records that do not load).

    A max_speakers beyond the int range loads as null; empty snr_db and noise_type load as null.
    """
    ok, bad = split_valid(lines, "line_id", "raw", MANIFEST, MANIFEST_CHECKS)
    typed = ok.select(
        "line_id", "clip_id", "audio_path", "transcript",
        F.col("overlap_ratio_target").try_cast("double").alias("overlap_ratio_target"),
        F.col("overlap_ratio_actual").try_cast("double").alias("overlap_ratio_actual"),
        F.col("max_speakers").try_cast("int").alias("max_speakers"),
        F.nullif(F.col("snr_db"), F.lit("")).try_cast("double").alias("snr_db"),
        F.nullif(F.col("noise_type"), F.lit("")).alias("noise_type"),
        "overlap_mask_path", "source_files", "noise_files",
    )
    return typed, bad
