"""Incremental loading of result files: each file once, each (clip, model) once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ["clip_id", "model_name"]
#: Folders that the target's rows are spread over by a digest of their keys; a batch reads those of its own keys.
BUCKETS, BUCKET = 256, "key_bucket"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def append_unseen(batch: DataFrame, target: str, keys: list[str] = KEYS) -> None:
    """Append the rows whose keys the target does not hold, null keys included, of equal keys one. Only the target's
    folders that these keys fall in are read; their names are BUCKETS values at most."""
    new = batch.dropDuplicates(keys).withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    if exists(batch.sparkSession, target):
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]
        old = batch.sparkSession.read.schema(new.schema).parquet(target).where(F.col(BUCKET).isin(touched)).select(*keys)
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        new = new.alias("a").join(old.alias("b"), on, "left_anti")
    new.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(target)


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str] = KEYS) -> StreamingQuery:
    """Read new JSON-lines files of a folder and append the rows whose keys the target does not hold.

    A batch that is repeated after a failure finds its rows in the target and adds nothing.
    """
    stream = spark.readStream.schema(schema).json(source)
    add = lambda batch, number: append_unseen(batch, target, keys)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
