"""Chunks of long documents: which are digital, units of pages, and the merge of their results in page order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_PAGES, IMAGE_PAGES, CHARS_A_PAGE = 6, 2, 200


def is_digital(pages: DataFrame) -> DataFrame:
    """(document_id, text) a row a page -> document_id, pages, chars, digital: trimmed text of (200 * pages) // 2 characters or more."""
    n = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.sum(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))).alias("chars"))
    return n.withColumn("digital", F.col("chars") >= F.floor(F.col("pages") * CHARS_A_PAGE / 2))


def units(pages: DataFrame, digital: Column) -> DataFrame:
    """(document_id, page) -> plus unit: runs of six text pages or two image pages."""
    return pages.withColumn("unit", F.floor(F.col("page") / F.when(digital, TEXT_PAGES).otherwise(IMAGE_PAGES)).cast("int"))


def merge(chunks: DataFrame, list_field: str, headers: dict[str, list[str]]) -> DataFrame:
    """(document_id, chunk, fields, failed) -> lists joined in chunk order; each header leaf the first with a value, else the last one.

    One aggregate a document: min_by and max_by over the chunk number keep one leaf each, so only the lists are collected.
    """
    aggs = []
    for group, names in headers.items():
        for n in names:
            leaf = F.col(f"fields.{group}.{n}")
            filled = F.coalesce(leaf["value"], F.lit("")) != ""
            aggs.append(F.coalesce(F.min_by(F.when(filled, leaf), F.when(filled, F.col("chunk"))), F.max_by(leaf, "chunk")).alias(f"{group}.{n}"))
    rows = F.sort_array(F.collect_list(F.struct("chunk", F.coalesce(F.col(f"fields.{list_field}"), F.array()).alias("rows"))))
    flat = F.flatten(F.transform(rows, lambda x: x["rows"]))
    out = chunks.groupBy("document_id").agg(flat.alias(list_field), F.sum(F.coalesce("failed", F.lit(0))).alias("pages_failed"), *aggs)
    nested = [F.struct(*[F.col(f"`{g}.{n}`").alias(n) for n in names]).alias(g) for g, names in headers.items()]
    return out.select("document_id", *nested, list_field, F.size(list_field).alias("item_count"), "pages_failed")
