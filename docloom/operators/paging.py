"""Pages by key: newest first, each page going on after the last row of the one before, whatever its number.

``write_clustered`` lays a table out in files of bounded size, sorted by tenant and key, with a manifest beside it: for each file and tenant
the least and largest key and the number of rows. ``page_after`` asks the manifest for the few files that hold the next
rows and reads those alone, so page 10,000 costs what page 1 does. Keys (a time and an id) are unique and not null; rows of
which one is null are in no page. What is written is not changed in place: write anew, to another folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, MOST = 100_000, 500


def write_clustered(rows: DataFrame, path: str, tenant: str, newest: str, key: str, rows_per_file: int = ROWS, tasks: int | None = None) -> None:
    """Rows to ``path``/rows, the manifest to ``path``/manifest."""
    spark = rows.sparkSession
    order = [F.col(tenant), F.col(newest).desc(), F.col(key).desc()]
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = rows.filter(F.col(tenant).isNotNull() & F.col(newest).isNotNull() & F.col(key).isNotNull())
    whole.repartitionByRange(n, *order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    at = F.struct(F.col(newest).alias("newest"), F.col(key).alias("key"))
    written = spark.read.parquet(f"{path}/rows").withColumn("file", F.col("_metadata.file_path"))
    sides = written.groupBy("file", F.col(tenant).alias("tenant")).agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n"))
    sides.repartitionByRange(max(1, n // 8), "tenant", F.col("high").desc()).sortWithinPartitions("tenant", F.col("high").desc()).write.parquet(f"{path}/manifest")


def page_after(spark: SparkSession, path: str, tenant: str, value, newest: str, key: str, after: tuple | None = None, limit: int = 50) -> DataFrame:
    """The next ``limit`` rows (``MOST`` at most) of a tenant below ``after``, the (newest, key) of the last row seen; the first ones without it."""
    limit = max(0, min(limit, MOST))
    files = spark.read.parquet(f"{path}/manifest").filter(F.col("tenant") == value)
    table = spark.read.parquet(f"{path}/rows")
    if after is not None:
        kinds = [table.schema[c].dataType for c in (newest, key)]
        last = F.struct(F.lit(after[0]).cast(kinds[0]).alias("newest"), F.lit(after[1]).cast(kinds[1]).alias("key"))
        files = files.filter(F.col("low") < last).withColumn("whole", F.col("high") < last)
    else:
        files = files.withColumn("whole", F.lit(True))
    wanted, sure = [], 0
    for f in files.orderBy(F.desc("high"), F.desc("low")).limit(limit + 2).collect():  # a file has a row at least
        if sure >= limit:
            break
        wanted.append(f["file"])
        sure += f["n"] if f["whole"] else 0
    if not wanted:
        return table.limit(0)
    found = spark.read.schema(table.schema).parquet(*wanted).filter(F.col(tenant) == value)
    if after is not None:  # the first alone reaches the scan
        found = found.filter(F.col(newest) <= F.lit(after[0]).cast(kinds[0])).filter(F.struct(F.col(newest).alias("newest"), F.col(key).alias("key")) < last)
    return found.orderBy(F.desc(newest), F.desc(key)).limit(limit)
