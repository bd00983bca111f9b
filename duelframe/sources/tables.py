"""Reading and writing tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.aggs import dedupe_by_key
from ..session import materialize, new_path


def read_table(spark: SparkSession, path, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def write_replace(df: DataFrame, path) -> None:
    df.write.mode("overwrite").parquet(path)


def _fs(spark, path):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def table_exists(spark: SparkSession, path) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def _old_of(spark, path):
    return spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "__old")


def recover(spark: SparkSession, path) -> None:
    """Finish or undo a swap that a lost driver left half done: the old table comes back if the new one is not there."""
    fs, target = _fs(spark, path)
    old = _old_of(spark, path)
    if not fs.exists(old):
        return
    if not fs.exists(target):
        if not fs.rename(old, target):
            raise OSError(f"could not move {old} back to {path}")
    else:
        fs.delete(old, True)


def _swap(spark, staged, path) -> None:
    """Put a finished table in the place of `path`; the old one is kept until the new one is there."""
    recover(spark, path)
    fs, target = _fs(spark, path)
    old = _old_of(spark, path)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"could not move {path} to {old}")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), target):
        recover(spark, path)
        raise OSError(f"could not move {staged} to {path}")
    fs.delete(old, True)


def merge_rows(old: DataFrame, new: DataFrame, keys, order_by=(), late="arrival") -> DataFrame:
    """One row per key. `late="arrival"`: a new row beats an old one, `order_by` (ascending) ranks the new ones;
    `late="order"`: the greatest `order_by` wins wherever it comes from, and a new row only among equals."""
    if late not in ("arrival", "order"):
        raise ValueError(f"unknown policy {late!r}")
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    ranks = [F.desc(c) for c in order_by]
    newest_first = [F.desc("_src"), *ranks] if late == "arrival" else [*ranks, F.desc("_src")]
    return dedupe_by_key(both, list(keys), newest_first).drop("_src")


def upsert(df_new: DataFrame, path, keys, order_by=(), partition_by=None, late="arrival") -> None:
    """Merge rows by key, newest wins (`late` as in `merge_rows`); creates the table if absent. One writer at a time.

    With `partition_by` (columns out of the key) only the partitions that new rows touch are read and rewritten.
    """
    spark = df_new.sparkSession
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    if not set(parts) <= set(keys):
        raise ValueError("partition columns must be part of the key")
    recover(spark, path)
    if not table_exists(spark, path):
        fresh = dedupe_by_key(df_new, list(keys), [F.desc(c) for c in order_by])
        (fresh.write.partitionBy(*parts) if parts else fresh.write).parquet(path)
        return
    old = spark.read.parquet(path)
    if not parts:
        staged = f"{path.rstrip('/')}__staged-{uuid.uuid4().hex[:12]}"
        merge_rows(old, df_new, keys, order_by, late).write.parquet(staged)
        _swap(spark, staged, path)
        return
    fresh = materialize(df_new, "upsert")
    touched = old.join(fresh.select(*parts).distinct(), parts, "left_semi")
    merged = materialize(merge_rows(touched, fresh, keys, order_by, late), "upsert")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def insert_ignore(df_new: DataFrame, path, keys) -> None:
    """Append only rows whose key is new."""
    spark = df_new.sparkSession
    fresh = dedupe_by_key(df_new, list(keys), [])
    recover(spark, path)
    if table_exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
        fresh = materialize(fresh, "insert")  # the target is read and written
    fresh.write.mode("append").parquet(path)


def insert_or_replace(df_new: DataFrame, path, keys) -> None:
    upsert(df_new, path, keys)


def append_stamped(df: DataFrame, path, ts_col="ts") -> None:
    df.withColumn(ts_col, F.current_timestamp()).write.mode("append").parquet(path)


def read_csv_typed(spark: SparkSession, path, schema) -> DataFrame:
    """Declared schema, so dates are parsed while reading and the file is read once."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def partitioned_by_initial(df: DataFrame, path, col, start=1) -> None:
    """Batches by one character of a key. Rows spread over tasks first, so a common initial is not one task."""
    tagged = df.withColumn("initial", F.upper(F.substring(col, start, 1)))
    tagged.write.mode("overwrite").partitionBy("initial").parquet(path)


def scratch_table(spark: SparkSession, label) -> str:
    return new_path(spark, label)
