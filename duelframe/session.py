"""Session settings, the shared folder, and written tables that cut lineage."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Lookups keep one row per key on the small side, so splitting the big side of a hot key is exact.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Loops build many small plans; the Python call sites of every expression are not worth a round trip each.
    "spark.python.sql.dataFrameQueryContext.enabled": "false",
}

# A side is broadcast by hint only after it was counted and found at or below this.
BROADCAST_ROWS = 2_000_000
# A key with more rows than this is handled in pieces, never as one group in one task.
HOT_ROWS = 5_000_000
# Spark removes the shuffle files of a statement that ran under this setting; else they stay until the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Names of bucketed tables in the session's catalog; their files lie in the shared folder.
BUCKETED = "duelframe_bucketed_"


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees; a local one is made only for local sessions without a setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="duelframe-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody uses yet; all paths of one application lie under one folder, which may go when it is done."""
    return f"{shared_folder(spark)}/duelframe-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def leaving_no_shuffles(spark: SparkSession):
    """For statements that run once, as a write does: what they shuffled goes when they end. The session's setting stays."""
    old = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if old is None else spark.conf.set(SHUFFLE_CLEANUP, old)


def discard(*tables) -> None:
    """Delete written tables that nothing reads any more; frames that were not written by this module stay as they are."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path is None:
            continue
        if getattr(df, "_bucketed_as", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._bucketed_as}")
        _delete(df.sparkSession, path)


def _delete(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bucketed(df: DataFrame, by: str, label: str, buckets: int | None = None) -> DataFrame:
    """Write `df` to the shared folder in buckets of `by`, each sorted and one file, and read it back.

    Joins and aggregates of such tables whose keys contain `by` move no rows, given the same number of buckets: the
    session's shuffle partitions if none is named. For keys with few rows each, as all rows of a key are in one bucket.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"{BUCKETED}{label}_{uuid.uuid4().hex[:12]}", new_path(spark, label)
    with leaving_no_shuffles(spark):
        writer = df.repartition(buckets, by).write.mode("errorifexists").format("parquet").option("path", path)
        writer.bucketBy(buckets, by).sortBy(by).saveAsTable(name)
    out = spark.table(name)
    out._written_at, out._bucketed_as = path, name
    return out


def release(spark: SparkSession) -> None:
    """Delete every table this application wrote to the shared folder; frames that read them are of no use after it."""
    for found in spark.catalog.listTables(pattern=f"{BUCKETED}*"):
        spark.sql(f"DROP TABLE IF EXISTS {found.name}")
    _delete(spark, f"{shared_folder(spark)}/duelframe-{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, label: str, partition_by=()) -> DataFrame:
    """Write `df` to the shared folder and read it back: the result survives the loss of any executor. What the write shuffled
    goes at once; `discard` deletes the table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with leaving_no_shuffles(spark):
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out
