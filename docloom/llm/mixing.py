"""Mixing sources to target weights by nested hash thresholds.

Every document has a uniform 60-bit hash of its id. A source whose target is ``k`` times its size plus a rest takes
all documents ``k`` times and those under a hash threshold once more, so a document taken at a smaller target is
also taken at any larger one. The threshold comes from a histogram of words by source and hash bucket: buckets
that end below the rest are in, and only the bucket where the running sum passes the rest is split again, four
times 15 bits. No documents are sorted, and no row of the histogram is larger than a few numbers.

Edge cases: a null text has size 0; a null source is a source of its own, after the others; a null id hashes as
the empty string; rows with the same id share one hash and are taken together; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, n_words, table

BITS, LEVELS = 15, 4


def doc_hash(doc_id):
    """The first 60 bits of the MD5 of the id's text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> plus target: ``share`` of all words, dealt by weight, none above ``most`` times its size.

    Dealing the excess again and again ends at one price per weight below which a source is full; the sources are
    put in the order in which they fill up, and running sums give that price. One row a source.
    """
    n = len(weights)
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % n + 1).cast("int"))
    by_fill = W.orderBy((F.col("cap") / F.col("w")), "rank")
    every = W.partitionBy(F.lit(1))
    t = totals.withColumn("rank", rank).withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    t = t.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
    t = t.withColumn("cap_before", F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
    t = t.withColumn("w_left", F.sum("w").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
    t = t.withColumn("full", F.col("cap") * F.col("w_left") <= (F.col("budget") - F.col("cap_before")) * F.col("w"))
    t = t.withColumn("used", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every))
    t = t.withColumn("w_open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every))
    target = F.when(F.col("full"), F.col("cap")).otherwise((F.col("budget") - F.col("used")) * F.col("w") / F.col("w_open"))
    return t.select("source", "source_size", target.alias("target"))


def _joiner(few: bool):
    """Joins rows with a table by source: broadcast if that is known to be small, else Catalyst's choice."""

    def with_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "its_source")
        return left.join(F.broadcast(right) if few else right, left["source"].eqNullSafe(right["its_source"])).drop("its_source")

    return with_source


def plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_id, source, text) -> the documents' sizes and hashes; source, source_size, target, whole, last_in; are sources few?"""
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("h")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = cut(targets.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("base", F.lit(0).cast("long")))
    few = targets.count() <= BROADCAST_ROWS
    with_source = _joiner(few)

    rows, state = sized, targets.select("source", "rest", "base")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        rows = rows.withColumn("bucket", F.shiftright("h", shift))
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        sums = with_source(sums, state.select("source", "rest", "base"))
        to_here = F.sum("words").over(W.partitionBy("source").orderBy("bucket")) + F.col("base")
        split = sums.withColumn("end", to_here).filter(F.col("end") > F.col("rest"))
        split = split.groupBy("source").agg(F.min(F.struct("bucket", "end", "words", "rest")).alias("b"))
        state = cut(split.select("source", F.col("b.rest").alias("rest"), (F.col("b.end") - F.col("b.words")).alias("base"), F.col("b.bucket").alias("at"), F.col("b.words").alias("words")))
        if level < LEVELS - 1:
            edge = state.select("source", F.col("at"))
            rows = cut(with_source(rows, edge).filter(F.col("bucket") == F.col("at")).select("source", "size", "h"))
    # The last bucket is one hash: it is in if that ends nearer to the rest.
    last = state.select("source", F.when(F.col("base") + F.col("words") / 2.0 <= F.col("rest"), F.col("at")).otherwise(F.col("at") - 1).alias("last_in"))
    last = last.withColumnRenamed("source", "its_source")
    out = targets.join(last, targets["source"].eqNullSafe(last["its_source"]), "left")
    return sized, cut(out.select("source", "source_size", "target", "whole", F.coalesce("last_in", F.lit(-1)).alias("last_in"))), few


def _copies(most: float):
    """Rows without words share a full source's turns, but none comes more than ``most`` times."""
    return F.least(F.col("whole") + F.when(F.col("h") <= F.col("last_in"), 1).otherwise(0), F.lit(math.ceil(most)).cast("long"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, text) -> doc_id, source, size, source_size, target, copies, taken."""
    sized, targets, few = plan(docs, weights, share, most)
    out = _joiner(few)(sized, targets)
    return out.select("doc_id", "source", "size", "source_size", "target", _copies(most).alias("copies"), (_copies(most) * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it, with their columns; a filter over the documents."""
    _, targets, few = plan(docs, weights, share, most)
    packed = docs.select(F.col("source"), doc_hash(F.col("doc_id")).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = _joiner(few)(packed, targets).select("row", F.explode(F.array_repeat(F.lit(0), _copies(most).cast("int"))))
    return taken.select("row.*")


def op1_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap,
             (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM r),
f AS (SELECT *, sum(cap) OVER (ORDER BY cap / w, rank ROWS UNBOUNDED PRECEDING) - cap AS cap_before,
             sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
g AS (SELECT *, cap * w_left <= (budget - cap_before) * w AS is_full FROM f),
u AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0.0::DOUBLE END) OVER () AS used, sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE w END) OVER () AS w_open FROM g),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE (budget - used) * w / w_open END AS target FROM u),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0.0::DOUBLE END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, k.source_size, k.target, k.whole, k.target - k.whole * k.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto - own / 2.0 <= rest AND size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
