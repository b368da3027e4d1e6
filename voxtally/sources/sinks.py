"""Writers. Large tables are partitioned folders; only summaries of one row per model go through the driver."""

from __future__ import annotations

import json
import math
import shutil
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a summary file may have.
SUMMARY_ROWS = 10_000


def results_by_model(df: DataFrame, path: str) -> None:
    """JSON lines in a folder per model, null members kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("model_name").json(path)


def batch(results: DataFrame, summary: DataFrame, path: str) -> None:
    """results and summary side by side, with the time of writing."""
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/results")
    summary.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("overwrite").json(f"{path}/summary")


def plain(x: object) -> object:
    """NaN and infinities as null, for strict JSON."""
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def summary_json(parts: dict[str, DataFrame], path: str) -> None:
    """Small report tables as one JSON file with sorted keys; a table beyond SUMMARY_ROWS is refused."""
    out = {}
    for name, df in parts.items():
        rows = [r.asDict(recursive=True) for r in df.limit(SUMMARY_ROWS + 1).collect()]
        if len(rows) > SUMMARY_ROWS:
            raise ValueError(f"{name} is no summary: more than {SUMMARY_ROWS} rows")
        out[name] = plain(rows)
    Path(path).write_text(json.dumps(out, indent=2, sort_keys=True, default=str))


def json_row(*columns: str) -> Column:
    """A strict JSON text of columns; NaN becomes null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def manifest_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def append_new(df: DataFrame, keys: list[str], path: str, existing: Callable[[], DataFrame | None]) -> None:
    """Append the rows whose keys a parquet checkpoint does not hold yet."""
    old = existing()
    new = df if old is None else df.join(old.select(*keys).distinct(), keys, "left_anti")
    new.dropDuplicates(keys).write.mode("append").parquet(path)


def alignment_report(steps: DataFrame, path: str) -> None:
    """One text line per pair: its counts and its steps. steps: id, steps (array of op, ref, hyp)."""
    n = lambda op: F.size(F.filter("steps", lambda s: F.startswith(s["op"], F.lit(op)))).cast("string")
    line = F.concat_ws(
        "\t", F.col("id").cast("string"), F.concat(F.lit("match="), n("match")), F.concat(F.lit("sub="), n("sub")), F.concat(F.lit("ins="), n("ins")), F.concat(F.lit("del="), n("del")),
        F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["op"], F.coalesce(s["ref"], F.lit("-")), F.coalesce(s["hyp"], F.lit("-")))), " "),
    )
    steps.select(line.alias("value")).write.mode("overwrite").text(path)


def prune_plan(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """file, action: `extra` for audio of no clip, `missing` for clips without audio, `keep` for the rest. Nothing is
    deleted here."""
    f = files.select("file", F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1).alias("clip_id"))
    both = f.join(manifest.select("clip_id").where("clip_id is not null").distinct().withColumn("wanted", F.lit(True)), "clip_id", "outer")
    return both.select("clip_id", "file", F.when(F.col("wanted").isNull(), "extra").when(F.col("file").isNull(), "missing").otherwise("keep").alias("action"))


def prune(files: DataFrame, manifest: DataFrame, action: str = "dry-run", target: str | None = None) -> DataFrame:
    """clip_id, file, done of the audio files of no clip: `dry-run` leaves them, `delete` removes them, `move` takes them to
    the folder target. Files are local or on a mount that all executors share; a file that is gone already is not done."""
    if action not in ("dry-run", "delete", "move") or (action == "move") != (target is not None):
        raise ValueError("action must be dry-run, delete, or move with a target folder")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = []
            for f in b.file:
                at = Path(f.removeprefix("file://").removeprefix("file:"))
                there = action != "dry-run" and at.exists()
                if there and action == "delete":
                    at.unlink()
                elif there:
                    Path(target).mkdir(parents=True, exist_ok=True)
                    shutil.move(at, Path(target) / at.name)
                done.append(there)
            yield b.assign(done=done)

    return prune_plan(files, manifest).where("action = 'extra'").select("clip_id", "file").mapInPandas(run, "clip_id string, file string, done boolean")


def upsert_clips(old: DataFrame, new: DataFrame, wanted: DataFrame) -> DataFrame:
    """clip_id, audio_path, reference_segments: an old entry stays, is replaced where it lacks segments, and always takes
    the new audio path; only the wanted clips come out."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, "clip_id", "outer").select("clip_id", F.coalesce("b.audio_path", "a.audio_path").alias("audio_path"), F.coalesce("a.reference_segments", "b.reference_segments").alias("reference_segments"))
    return both.join(wanted.select("clip_id").distinct(), "clip_id", "left_semi")
