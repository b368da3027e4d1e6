"""The N highest-scoring items of every group, with one fixed tie rule.

Two stages: every group is hashed into subgroups, each of which keeps its N best; the survivors of a group (at most
N per subgroup) are then ranked together. The hash is of the item's id, so repeated deliveries of an item meet in one
subgroup, share its dense rank and are reduced to one row there. The first stage is a rank with a bound, which Spark
also applies before the shuffle (WindowGroupLimit), so a hot group sends N rows per input partition and subgroup.

Defined results: rows with a null group, a null or NaN score or a null id are left out; equal scores go by the
smaller id; -0.0 equals 0.0; infinite scores take part; a group with fewer items gives what it has; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: str, score: str, item: str, n: int, salt: int = 8) -> DataFrame:
    """group_key, place, item, score of the n highest scores of each group."""
    rows = df.select(
        F.col(group).cast("string").alias("group_key"), F.col(item).alias("item"), (F.col(score).cast("double") + F.lit(0.0)).alias("score")
    ).where(F.col("group_key").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    order = [F.col("score").desc(), F.col("item").asc()]
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("item"), F.lit(salt)))
    first = Window.partitionBy("group_key", "sub").orderBy(*order)
    kept = rows.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= n).select("group_key", "item", "score").distinct()
    final = Window.partitionBy("group_key").orderBy(*order)
    return kept.withColumn("place", F.row_number().over(final)).where(F.col("place") <= n).select("group_key", F.col("place").cast("long").alias("place"), "item", "score")


def worst_results(results: DataFrame, per_clip: int = 3, per_model: int = 10) -> DataFrame:
    """group_kind, group_key, place, result_id of the worst successful results per clip and per model."""
    good = results.where("status = 'success'")
    parts = [
        top_n(good, col, "wer", "result_id", n, salt).select(F.lit(kind).alias("group_kind"), "group_key", "place", F.col("item").alias("result_id"))
        for kind, col, n, salt in (("clip", "clip_id", per_clip, 4), ("model", "model_name", per_model, 16))
    ]
    return parts[0].unionByName(parts[1])
