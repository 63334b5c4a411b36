"""Uploaded files: load, type, validation with a quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import content_type

TYPES = ["application/pdf", "image/png", "image/webp", "image/jpeg"]
DOC_TYPES = ["prescription", "invoice"]
MOST_BYTES = 25 * 1024 * 1024


def load(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name (without folders), content_type, bytes, content. Spark's reader leaves out files without a byte."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select(name.alias("name"), content_type(name).alias("content_type"), F.col("length").alias("bytes"), "content")


def validate(uploads: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(content_type, bytes, doc_type) -> accepted, and refused with a reason; every row is in one of them."""
    reason = (
        F.when(~F.coalesce(F.col("content_type").isin(TYPES), F.lit(False)), "content type")
        .when(F.coalesce("bytes", F.lit(0)) <= 0, "empty")
        .when(F.col("bytes") > most_bytes, "too large")
        .when(~F.coalesce(F.col("doc_type").isin(DOC_TYPES), F.lit(False)), "document type")
    )
    r = uploads.withColumn("reason", reason)
    return r.filter("reason IS NULL").drop("reason"), r.filter("reason IS NOT NULL")
