"""Matching names to a shop's catalog, and substitutes of the same molecule.

Catalogs repeat names and queries repeat too, so pairs are scored once per distinct pair of normalised names and
joined back. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import base_molecule, molecule_of, normalize
from ..functions.scores import SCORERS
from ..shared import cut
from .fuzzy import best_names


def match_names(queries: DataFrame, catalog: DataFrame, limit: int = 3, min_score: float = 40.0, scorer: str = "token_set") -> DataFrame:
    """queries (query_id, shop_id, name), catalog (id, shop_id, normalized_name, ...) -> query_id, rank, id, raw_score, score.

    Jaccard hits share a token: names meet on the rarest tokens that a hit can't do without. Other fuzzy hits need not
    share one: they are found by bounds (``fuzzy``). Of each query at most ``limit`` names can hold its best ids, those
    of the best scores and of equal ones the smallest first ids, so names are ranked first and expanded to ids after.
    """
    q = queries.select("query_id", "shop_id", normalize(F.col("name")).alias("q")).filter("q <> ''")
    names = catalog.groupBy("shop_id", F.col("normalized_name").alias("n")).agg(F.min("id").alias("first_id"))
    names = cut(names)  # read twice, and the catalog once
    asked = q.select("shop_id", "q").distinct()
    if scorer == "token_set":
        scored = best_names(asked, names, limit, min_score)
    else:
        pairs = _sharing(asked, names.drop("first_id"), min_score) if min_score > 0 else _all_pairs(asked, names.drop("first_id"))
        scored = pairs.withColumn("raw_score", SCORERS[scorer](F.col("q"), F.col("n"))).filter(F.col("raw_score") >= min_score)
    first = F.row_number().over(W.partitionBy("shop_id", "q").orderBy(F.desc("raw_score"), "first_id"))
    near = scored.join(names, ["shop_id", "n"]).withColumn("r", first).filter(F.col("r") <= limit).drop("r", "first_id")
    if limit == 1:
        items = names.withColumnRenamed("first_id", "id")
    else:
        items = catalog.select("shop_id", F.col("normalized_name").alias("n"), "id")
        items = items.withColumn("k", F.row_number().over(W.partitionBy("shop_id", "n").orderBy("id"))).filter(F.col("k") <= limit).drop("k")
    best = near.join(items, ["shop_id", "n"])
    by = W.partitionBy("shop_id", "q").orderBy(F.desc("raw_score"), "id")
    best = best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)
    return q.join(best, ["shop_id", "q"]).select("query_id", "rank", "id", "raw_score", F.bround("raw_score", 1).alias("score"))


#: Parts of a shop's catalog that meet each query in tasks of their own.
PARTS = 32


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Dealt to as many tasks as the session shuffles to, however small: a few rows here make very many pairs."""
    return df.repartition(max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def _all_pairs(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(shop_id, q), (shop_id, n) -> their pairs by shop; a shop's catalog is dealt to ``PARTS`` tasks."""
    dealt = _spread(asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), "shop_id", "part")
    return dealt.join(names.withColumn("part", F.pmod(F.hash("n"), F.lit(PARTS))), ["shop_id", "part"]).drop("part")


def _sharing(asked: DataFrame, names: DataFrame, min_score: float) -> DataFrame:
    """The pairs that can have that Jaccard score: of two sets one of which has m tokens they share ceil(score * m), so
    one of the first m - ceil(score * m) + 1 in any order common to all; rare tokens come first."""
    tokens = names.select(F.explode(F.array_distinct(F.split("n", " "))).alias("token")).groupBy("token").agg(F.count("*").alias("uses"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        each = df.select("shop_id", name, F.explode(F.array_distinct(F.split(name, " "))).alias("token")).join(tokens, "token", "left")
        ranked = each.groupBy("shop_id", name).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token"))).alias("t"))
        needed = F.ceil(F.size("t") * F.lit(min_score / 100) - 1e-9)
        return ranked.select("shop_id", name, F.explode(F.slice(F.col("t.token"), F.lit(1), (F.size("t") - needed + 1).cast("int"))).alias("token"))

    return _spread(prefix(asked, "q"), "shop_id", "token").join(prefix(names, "n"), ["shop_id", "token"]).select("shop_id", "q", "n").distinct()


def _asked(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items (shop_id, name, ...) -> plus ``_asked``, the normal form; and each normal form of a shop once, as queries."""
    items = items.withColumn("_asked", normalize(F.col("name")))
    each = items.select("shop_id", F.col("_asked").alias("name")).distinct()
    return items, each.select(F.struct("shop_id", F.col("name").alias("_asked")).alias("query_id"), "shop_id", "name")


def match_items(items: DataFrame, catalog: DataFrame, scorer: str = "token_set") -> tuple[DataFrame, DataFrame]:
    """items (document_id, item_no, shop_id, name) -> a row an item (best_score, candidates), a row a document (matched, total).

    Candidates are gathered once a name; items, which repeat names, meet them in one join.
    """
    items, asked = _asked(items)
    found = match_names(asked, catalog, scorer=scorer).join(catalog.select("id", "sku", F.col("name").alias("item_name"), "strength", "mrp", "composition", "stock_qty"), "id")
    lists = found.groupBy("query_id").agg(F.max("score").alias("best"), F.sort_array(F.collect_list(F.struct("rank", "id", "item_name", "sku", "strength", "mrp", "composition", "stock_qty", "score"))).alias("candidates"))
    each = items.join(lists.select("query_id.*", "best", "candidates"), ["shop_id", "_asked"], "left").select("document_id", "item_no", "name", F.coalesce("best", F.lit(0.0)).alias("best_score"), "candidates")
    return each, each.groupBy("document_id").agg(F.count_if(F.col("best_score") >= 70).alias("matched"), F.count("*").alias("total"))


def link_items(items: DataFrame, catalog: DataFrame, min_score: float = 70.0, scorer: str = "token_set") -> DataFrame:
    """Each item with its inventory_match (id, sku, name, score), or null where nothing reaches the score. Names are matched once."""
    items, asked = _asked(items.drop("inventory_match"))
    best = match_names(asked, catalog, 1, min_score, scorer).join(catalog.select("id", "sku", F.col("name").alias("item_name")), "id")
    best = best.select("query_id.*", F.struct("id", "sku", F.col("item_name").alias("name"), "score").alias("inventory_match"))
    return items.join(best, ["shop_id", "_asked"], "left").select(*[c for c in items.columns if c != "_asked"], "inventory_match")


def alternatives(queries: DataFrame, catalog: DataFrame, limit: int = 5, min_score: float = 75.0, scorer: str = "token_set") -> DataFrame:
    """queries (query_id, shop_id, name, composition) -> query_id, rank, id, score: items that share the molecule.

    The first token of the query's molecule must be one of the item's: an equi-join on exploded tokens. As asked for,
    the item itself and items out of stock are included.

    Rows repeat names, so molecules are worked out once a name and composition; of equal ones only the ``limit`` items
    that are in stock most can be among the best.
    """
    base = F.when(F.coalesce(F.col("composition"), F.lit("")) != "", normalize(F.col("composition"))).otherwise(base_molecule(F.col("name")))
    said = ["shop_id", "name", "composition"]
    q = cut(queries.select(*said).distinct().withColumn("q", base).filter("q <> ''").withColumn("token", F.get(F.split("q", " "), 0)))
    items = catalog.select(*said, "id", F.coalesce("stock_qty", F.lit(0.0)).alias("stock"))
    items = cut(_first(items, limit, said).select("shop_id", "id", "stock", molecule_of(F.col("composition"), F.col("name")).alias("n")))
    names = items.select("shop_id", "n").distinct().select("shop_id", "n", F.explode(F.array_distinct(F.split("n", " "))).alias("token"))
    pairs = _spread(q.select("shop_id", "q", "token").distinct(), "shop_id", "token").join(names, ["shop_id", "token"])
    scored = pairs.withColumn("raw_score", SCORERS[scorer](F.col("q"), F.col("n"))).filter(F.col("raw_score") >= min_score).withColumn("score", F.bround("raw_score", 1))
    by = W.partitionBy("shop_id", "q").orderBy(F.desc("score"), F.desc("stock"), "id")
    best = scored.join(_first(items, limit, ["shop_id", "n"]), ["shop_id", "n"]).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)
    lists = best.groupBy("shop_id", "q").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))
    return _each(queries, q.join(lists, ["shop_id", "q"]).select(*said, "found"), said).select("query_id", F.inline("found"))


def _first(items: DataFrame, limit: int, key: list[str]) -> DataFrame:
    """Of each key the ``limit`` rows that are in stock most, of equal ones the smaller ids; tasks drop others before the shuffle."""
    by = W.partitionBy(*key).orderBy(F.desc("stock"), "id")
    return items.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= limit).drop("k")


#: Names with what was found for them that are broadcast at most; more are shuffled, and so are the rows that ask.
NAMES = 50_000


def _each(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """The rows that have something found for their key, with it; nulls are equal but in shop_id."""
    found = cut(found.toDF(*[f"_{c}" if c in key else c for c in found.columns]))
    on = [rows[c] == found[f"_{c}"] if c == "shop_id" else rows[c].eqNullSafe(found[f"_{c}"]) for c in key]
    # The side is named, as a file of few bytes may have very many rows.
    return rows.join(F.broadcast(found) if found.count() <= NAMES else found.hint("merge"), on).drop(*[f"_{c}" for c in key])


def alternatives_for(queries: DataFrame, catalog: DataFrame, limit: int = 5, scorer: str = "token_set") -> DataFrame:
    """As alternatives, with the composition of the item that the name matches best, at 55 or more; all of it once a name of a shop."""
    said = ["shop_id", "name"]
    asked = cut(queries.select(*said).distinct()).select(F.struct(*said).alias("query_id"), *said)
    best = _each(catalog.select("id", "composition"), match_names(asked, catalog, 1, 55.0, scorer).groupBy("id").agg(F.collect_list("query_id").alias("names")), ["id"])
    best = best.select(F.explode("names").alias("query_id"), "composition")
    found = alternatives(asked.join(best, "query_id", "left"), catalog, limit, scorer=scorer)
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))
    return _each(queries.select("query_id", *said), lists.select("query_id.*", "found"), said).select("query_id", F.inline("found"))
