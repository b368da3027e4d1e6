"""Session helpers: a local builder and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHARED_KEY = "spark.checkpoint.dir"


def build(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller's session is used."""
    spark = (
        SparkSession.builder.master(master)
        .appName("voxtally")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers the package, once per application: they need not find it where the driver does."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="voxtally-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def ensure_shared(spark: SparkSession) -> None:
    """Leave the cluster's checkpoint folder as it is. Where none is set a local master gets a temporary one (tests); on
    any other master that would not be shared, so it is refused."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    given = sc.getConf().get(SHARED_KEY) or spark.conf.get(SHARED_KEY, None)
    if not given and not sc.master.startswith("local") or sc.master.startswith("local-cluster") and not given:
        raise ValueError(f"{SHARED_KEY} must name a folder that all executors share")
    sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="voxtally-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it from there, so that a lost executor costs no recomputation."""
    ensure_shared(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """As cut, but as a compressed table of which later steps read only the columns they use; for rows with texts. The
    table is removed when the driver ends."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    ensure_shared(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may have ended first
        pass


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that costs far more than a shuffle. An input of
    enough files or splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= cores else df.repartition(2 * cores, key)
