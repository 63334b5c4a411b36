"""Shared pieces: the word pattern, checkpoint folder, lineage cuts, table reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows a table may have at most to be broadcast (each row being a few numbers and one short key).
BROADCAST_ROWS = 10_000

#: Rows of a few longs that a table may have at most to be broadcast. The driver builds the hash table and its copy in blocks:
#: 900,000 rows under a key of two columns that may be null took some 200 MB there.
BROADCAST_KEYS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the cluster's checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; a temporary one is set only where that is unset and the one
    machine is all there is.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark, "checkpoints"))
    return df.checkpoint()


def folder(spark: SparkSession, what: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if top is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        top = tempfile.mkdtemp(prefix="docloom-")
    return f"{top}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """As cut(), but as a Parquet table: smaller for wide rows and repeated values."""
    df.write.parquet(path := folder(df.sparkSession, what))
    return df.sparkSession.read.parquet(path)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that isn't broadcast, whatever Catalyst takes it for: what explode() gives is sized as what went into it, and columns that repeat are small in files and shuffles."""
    return side.hint("merge")


def if_few(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A table of a few longs, already computed: broadcast if it has few rows, else merged, as few bytes of a shuffle may be very many rows in the driver."""
    return F.broadcast(keys) if keys.count() <= most else merged(keys)
