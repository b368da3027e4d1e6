"""Cutting long recordings into clips at moments that no utterance spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def crossings(utterances: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, at, n_crossing: at each end of an utterance, how many others of the session are strictly inside it.

    An event sweep instead of a range join: starts and ends become +1 and -1 and a running sum counts. Events of one
    moment are added up first, so the window holds distinct moments.
    """
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    rows = utterances.where(e > s)
    ev = rows.select(*keys, F.explode(F.array(F.struct(s.alias("at"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(e.alias("at"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select(*keys, "x.*")
    ev = ev.groupBy(*keys, "at").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    before = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # open before the moment, less those that end at it
    n = F.coalesce(F.sum(F.col("up") - F.col("down")).over(before), F.lit(0)) - F.col("down")
    return ev.withColumn("n_crossing", n).where("down > 0").select(*keys, "at", "n_crossing")


def contained(utterances: DataFrame, windows: DataFrame, keys: list[str], start: str, end: str, width: float = 60.0) -> DataFrame:
    """Utterances inside a window (w_start, w_end) of their session: joined by a bucket of the start, then compared."""
    u = utterances.withColumn("__b", F.floor(F.col(start) / width))
    w = windows.withColumn("__b", F.explode(F.sequence(F.floor(F.col("w_start") / width), F.floor(F.col("w_end") / width))))
    return u.join(w, [*keys, "__b"]).where((F.col(start) >= F.col("w_start")) & (F.col(end) <= F.col("w_end"))).drop("__b")


def greedy(begins: list[float], ends: list[float], min_length: float) -> list[tuple[float, float]]:
    """Windows from sorted starts and sorted ends: from the first start on, the earliest end that makes the window long
    enough; the next window begins at the next start that is not before that end."""
    out, last, i, j = [], float("-inf"), 0, 0
    while True:
        while i < len(begins) and begins[i] < last:
            i += 1
        if i == len(begins):
            return out
        while j < len(ends) and (ends[j] <= begins[i] or ends[j] - begins[i] < min_length):
            j += 1
        if j == len(ends):
            return out
        out.append((begins[i], ends[j]))
        last, i = ends[j], i + 1


def greedy_windows(utterances: DataFrame, session: str, start: str, end: str, min_length: float, n_clips: int | None = None) -> DataFrame:
    """session, clip_no, w_start, w_end: windows between boundaries that no utterance crosses, see greedy(). With n_clips
    the first n of each session; a session that has fewer fails the query.

    Sequential, so by session; its boundaries and starts are distinct moments, found by the sweep first."""
    free = crossings(utterances, [session], start, end).where("n_crossing = 0").select(session, F.col("at"), F.lit(True).alias("is_end"))
    starts = utterances.where(F.col(end) > F.col(start)).select(session, F.col(start).cast("double").alias("at"), F.lit(False).alias("is_end")).distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = greedy(sorted(pdf.loc[~pdf.is_end, "at"]), sorted(pdf.loc[pdf.is_end, "at"]), min_length)
        if n_clips is not None and len(out) < n_clips:
            raise ValueError(f"only {len(out)} clips of {min_length} s in session {pdf[session].iat[0]}, {n_clips} are wanted")
        return pd.DataFrame([(pdf[session].iat[0], i, a, b) for i, (a, b) in enumerate(out[:n_clips], 1)], columns=[session, "clip_no", "w_start", "w_end"])

    kind = dict(utterances.dtypes)[session]
    return free.unionByName(starts).where(F.col(session).isNotNull()).groupBy(session).applyInPandas(run, f"`{session}` {kind}, clip_no int, w_start double, w_end double")
