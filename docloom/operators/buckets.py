"""Tables in hash buckets, so that an update reads and rewrites the buckets it touches and leaves the files of all others.

A table is a folder with one partition a bucket of its key; what changes names its keys, and the few buckets that these
fall into are read, changed and put in place of the old ones by a dynamic partition overwrite. The new buckets are written
aside first and named: an update that is cut short is finished by calling it again with the same name, and one that
has ended does nothing the second time. One writer at a time.

Rows with a null key share a bucket. Keys should spread (ids do); a key of very many rows makes one large bucket. The
column ``_bucket`` is the table's own. A bucket that an update empties goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import is_whole, remove

#: Buckets of a table; their numbers are all that the driver sees of an update.
BUCKETS = 256


def bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(n)).cast("int")


def write_bucketed(rows: DataFrame, path: str, key: str, n: int = BUCKETS) -> None:
    """All rows; ``path`` must be new. One shuffle by bucket."""
    placed = rows.withColumn("_bucket", bucket(F.col(key), n))
    placed.repartition("_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(path)
    rows.sparkSession.createDataFrame([(key, n)], "key string, n int").coalesce(1).write.json(f"{path}/_layout")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")


def update(spark: SparkSession, path: str, changes: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], name: str) -> list[int]:
    """Puts ``step(old, changes)`` in place of ``old``, the rows of the buckets that the changes' keys fall into. -> those buckets.

    changes: has the table's key. step must treat rows by their key, as those of ``operators.lifecycle`` do, and give the
    table's columns; rows it adds must have keys of the changes, rows it leaves out go.
    """
    layout = spark.read.schema("key string, n int").json(f"{path}/_layout").first()
    aside, ended = f"{path}/_aside/{name}", f"{path}/_ended/{name}"
    touched_at = f"{path}/_touched/{name}"
    if is_whole(spark, ended):
        return []
    if not is_whole(spark, touched_at):
        changes.select(bucket(F.col(layout["key"]), layout["n"]).alias("b")).distinct().write.mode("overwrite").parquet(touched_at)
    touched = sorted(r["b"] for r in spark.read.parquet(touched_at).collect())  # no more than there are buckets
    if touched and not is_whole(spark, aside):
        table = spark.read.parquet(path)
        old = table.filter(F.col("_bucket").isin(touched)).drop("_bucket")
        new = step(old, changes).select(*old.columns).withColumn("_bucket", bucket(F.col(layout["key"]), layout["n"]))
        new.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").option("compression", "zstd").parquet(aside)
    if touched:
        kept = _replace(spark, aside, path)
        for b in set(touched) - kept:
            remove(spark, f"{path}/_bucket={b}")
    spark.range(0).coalesce(1).write.mode("overwrite").parquet(ended)
    remove(spark, aside)
    return touched


def _replace(spark: SparkSession, aside: str, path: str) -> set[int]:
    """The buckets that lie aside, put in place; which those are."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    there = {int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(aside)) if "=" in f.getPath().getName()}
    if there:
        new = spark.read.parquet(aside)
        new.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("_bucket").parquet(path)
    return there
