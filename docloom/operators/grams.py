"""An index for substrings of short texts such as names: lists of the rows that have three letters in a row.

A text is in the list of each of its different trigrams, with the text itself and the columns a search gives, so a search
reads one list, that of its rarest trigram, and keeps what contains the whole query. Lists lie sorted by trigram, tenant
and key in files of small pages, whose least and largest values let a scan skip the rest; a trigram that very many
texts have spans many files. ``counts`` has the length of each list.

Texts of n letters take up n lists, so this is for names, not for pages. Null texts match nothing, as with ``contains``;
queries are as the texts are (normalise both the same way). Queries under three letters scan the rows; in a batch
they meet the rows' letters and pairs of letters by an equi-join. The empty query matches all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N = 3
#: Rows of a page, the least that a scan of a list reads.
PAGE_ROWS = 1_000


def grams(text: Column, n: int = N) -> Column:
    """The different substrings of n letters; none if the text is shorter."""
    last = F.char_length(text) - n + 1
    each = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(last >= 1, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def build(rows: DataFrame, path: str, text: str, tenant: str, key: str) -> None:
    """rows -> ``path``/rows, /lists and /counts. All columns of ``rows`` are carried, so select those that a search gives."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.parquet(f"{path}/rows")
    kept = spark.read.parquet(f"{path}/rows").filter(F.col(text).isNotNull())
    listed = kept.withColumn("_gram", F.explode(grams(F.col(text))))
    order = ["_gram", tenant, key]
    listed.repartitionByRange(n, *order).sortWithinPartitions(*order).write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/lists")
    counts = spark.read.parquet(f"{path}/lists").groupBy("_gram", F.col(tenant).alias("tenant")).agg(F.count("*").alias("n"))
    counts.repartitionByRange(max(1, n // 8), "_gram").sortWithinPartitions("_gram").write.parquet(f"{path}/counts")


def search(spark: SparkSession, path: str, text: str, q: str, tenant: str | None = None, value=None) -> DataFrame:
    """The rows whose text contains ``q``, of one tenant if one is named."""
    of = (lambda df, c: df.filter(F.col(c) == F.lit(value))) if tenant is not None else (lambda df, c: df)
    if len(q) < N:
        return of(spark.read.parquet(f"{path}/rows"), tenant).filter(F.contains(text, F.lit(q)))
    wanted = sorted({q[i : i + N] for i in range(len(q) - N + 1)})
    counts = of(spark.read.parquet(f"{path}/counts"), "tenant").filter(F.col("_gram").isin(wanted)).groupBy("_gram").agg(F.sum("n").alias("n"))
    known = {r["_gram"]: r["n"] for r in counts.collect()}  # a row for each three letters of the query at most
    lists = spark.read.parquet(f"{path}/lists")
    if len(known) < len(wanted):
        return lists.limit(0).drop("_gram")
    rarest = min(wanted, key=lambda g: (known[g], g))
    return of(lists.filter(F.col("_gram") == rarest), tenant).filter(F.contains(text, F.lit(q))).drop("_gram")


def search_all(spark: SparkSession, path: str, text: str, queries: DataFrame, q: str = "q") -> DataFrame:
    """A table of queries against all rows: the queries' columns and the rows', a row for each hit. Repeated queries are searched once.

    Each different query is joined to the list of its rarest trigram; shorter ones to letters, pairs of letters or, if empty,
    to all rows. Queries that are null have no hits.
    """
    asked = queries.filter(F.col(q).isNotNull()).select(F.col(q).alias("_q")).distinct()
    totals = spark.read.parquet(f"{path}/counts").groupBy("_gram").agg(F.sum("n").alias("n"))
    each = asked.filter(F.char_length("_q") >= N).select("_q", F.explode(grams(F.col("_q"))).alias("_gram")).join(totals, "_gram", "left")
    rarest = each.groupBy("_q").agg(F.min_by("_gram", F.struct(F.coalesce("n", F.lit(0)), "_gram")).alias("_gram"))
    found = rarest.join(spark.read.parquet(f"{path}/lists"), "_gram").filter(F.contains(text, F.col("_q"))).drop("_gram")
    rows = spark.read.parquet(f"{path}/rows").filter(F.col(text).isNotNull())
    shorter = F.concat(F.array(F.lit("")), *[grams(F.col(text), n) for n in range(1, N)])
    few = rows.withColumn("_q", F.explode(shorter)).join(asked.filter(F.char_length("_q") < N), "_q")
    hits = found.unionByName(few.select(*found.columns))
    return queries.join(hits, F.col(q) == F.col("_q")).drop("_q")
