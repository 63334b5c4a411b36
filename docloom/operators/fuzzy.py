"""The names of a shop that are the most alike by token_set, found by upper bounds instead of scoring all pairs.

A catalog's names lie in blocks of about ``BLOCK``, by shop and length. A query visits the block with which it shares
most (by the lengths of the tokens they share), which gives its kth score, and then those other blocks that can hold a
score as good:

* two names without own tokens' letters in common beyond their lengths can't exceed ``200 min(a, b) / (a + b)``;
* shared tokens of length s alone give ``200 s / (s + min(a, b))``, which needs blocks that have the query's tokens.

Within a block, what shared tokens give is exact for all names at once; what the rest may give is bounded by the letters
that both have, as one matrix; only names whose bound reaches the kth score are compared letter by letter.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import token_set
from ..shared import cut

#: Names of a block and queries that visit it in one task, about; letters are told apart by this remainder; a band's lengths grow by this factor.
BLOCK, QUERIES, LETTERS, BAND = 2_048, 512, 64, 1.25


def _set_length(name: Column) -> Column:
    return F.length(F.array_join(F.array_distinct(F.filter(F.split(name, " "), lambda t: t != "")), " "))


def _tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda t: t != ""))


def _letters(tokens: list[str]) -> np.ndarray:
    text = np.frombuffer(" ".join(tokens).encode("utf-32-le"), "<u4")
    return np.bincount(text % LETTERS, minlength=LETTERS).astype("int16")


class Block:
    """Names of a catalog, in the order of their first ids."""

    def __init__(self, names: list[str]) -> None:
        self.names, sets = names, [sorted(set(n.split())) for n in names]
        self.lengths = np.array([len(" ".join(t)) for t in sets])
        self.sizes = np.array([len(t) for t in sets])
        self.letters = np.array([_letters(t) for t in sets]).reshape(len(names), LETTERS)
        having = defaultdict(list)
        for k, t in enumerate(sets):
            for token in t:
                having[token].append(k)
        self.having = {t: np.array(k) for t, k in having.items()}
        self.compared = 0

    def best(self, query: str, limit: int, floor: float) -> list[tuple[int, float]]:
        """(name, score) of the ``limit`` best that reach ``floor``; of equal scores the first ids'."""
        tokens = sorted(set(query.split()))
        if not tokens or not len(self.names):
            return []
        own = len(" ".join(tokens))
        shared, many = np.zeros(len(self.names), "int64"), np.zeros(len(self.names), "int64")
        for t in tokens:
            if (k := self.having.get(t)) is not None:
                shared[k] += len(t) + 1
                many[k] += 1
        shared -= many > 0
        score = np.where(many > 0, 200.0 * shared / np.maximum(shared + np.minimum(self.lengths, own), 1), 0.0)
        score[(many > 0) & ((many == self.sizes) | (many == len(tokens)))] = 100.0
        bound = 200.0 * np.minimum(self.letters, _letters(tokens)).sum(axis=1, dtype="int64") / np.maximum(self.lengths + own, 1) + 1e-9
        bound[self.sizes == 0] = 0
        kth = self._kth(score, limit, floor)
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < kth:
                break
            if bound[k] > score[k]:
                self.compared += 1
                score[k] = max(score[k], token_set(query, self.names[k]))
                if score[k] > kth:
                    kth = self._kth(score, limit, floor)
        good = np.flatnonzero(score >= kth)
        return [(int(k), float(score[k])) for k in good[np.lexsort((good, -score[good]))][:limit]]

    @staticmethod
    def _kth(score: np.ndarray, limit: int, floor: float) -> float:
        return max(floor, float(np.partition(score, -limit)[-limit])) if len(score) >= limit else floor


def _visit(visits: DataFrame, blocks: DataFrame, limit: int) -> DataFrame:
    """(shop_id, band, part, q, floor) -> shop_id, q, n, raw_score: the best of each visit."""
    key = ["shop_id", "band", "part"]
    # Queries of a block go to as many tasks as they fill; each has the block's names.
    groups = visits.groupBy(*key).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    left = visits.join(groups, key).withColumn("grp", F.pmod(F.hash("q"), F.col("groups"))).select(*key, "grp", "q", "floor").toDF(*key, "grp", "q", "floor")
    right = blocks.join(groups, key).withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select(*key, "grp", "n", "first_id").toDF(*key, "grp", "n", "first_id")

    def run(asked: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(names):
            names = names.sort_values("first_id", kind="stable")
            block = Block(names["n"].tolist())
            shop = names["shop_id"].iloc[0]
            out = [(shop, q, block.names[k], s) for q, floor in zip(asked["q"], asked["floor"], strict=True) for k, s in block.best(q, limit, floor)]
        return pd.DataFrame(out, columns=["shop_id", "q", "n", "raw_score"])

    shop = blocks.schema["shop_id"].dataType.simpleString()
    # Few rows make much work here: dealt to as many tasks as the session shuffles to, however small.
    n = max(32, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left, right = left.repartition(n, *key, "grp"), right.repartition(n, *key, "grp")
    return left.groupBy(*key, "grp").cogroup(right.groupBy(*key, "grp")).applyInPandas(run, f"shop_id {shop}, q string, n string, raw_score double")


def best_names(asked: DataFrame, names: DataFrame, limit: int, min_score: float) -> DataFrame:
    """(shop_id, q) and (shop_id, n, first_id), each once -> shop_id, q, n, raw_score: at least each q's ``limit`` best.

    A query or a name without tokens has no hits.
    """
    key, min_score = ["shop_id", "band", "part"], float(min_score)
    sized = names.withColumn("length", _set_length(F.col("n"))).withColumn("band", F.floor(F.log(F.greatest("length", F.lit(1))) / float(np.log(BAND))).cast("int"))
    parts = sized.groupBy("shop_id", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    blocks = sized.join(parts, ["shop_id", "band"]).withColumn("part", F.pmod(F.hash("n"), F.col("parts")))
    q = asked.withColumn("own", _set_length(F.col("q"))).filter("own > 0")

    blocks, q = cut(blocks.drop("parts")), cut(q)

    def word(df: DataFrame, name: str) -> DataFrame:
        return df.select("*", F.explode(_tokens(F.col(name))).alias("token"))

    sides = blocks.groupBy(*key).agg(F.min("length").alias("low"), F.max("length").alias("high"))
    in_blocks = word(blocks, "n").select(*key, "token").distinct()
    weights = word(q, "q").join(in_blocks, ["shop_id", "token"]).groupBy("shop_id", "q", "own", "band", "part").agg((F.sum(F.length("token") + 1) - 1).alias("shared"))
    most = F.row_number().over(W.partitionBy("shop_id", "q").orderBy(F.desc("shared"), F.abs(F.col("band") - F.floor(F.log("own") / float(np.log(BAND)))), "band", "part"))
    home = weights.withColumn("r", most).filter("r = 1").select(*key, "q")
    first = cut(_visit(home.withColumn("floor", F.lit(min_score)), blocks, limit))
    kth = first.groupBy("shop_id", "q").agg(F.when(F.count("*") >= limit, F.min("raw_score")).alias("kth"))
    known = q.join(kth, ["shop_id", "q"], "left").withColumn("floor", F.greatest(F.coalesce("kth", F.lit(min_score)), F.lit(min_score))).select("shop_id", "q", "own", "floor")
    near = F.greatest("low", F.least("own", "high"))
    by_length = known.join(sides, "shop_id").filter(200.0 * F.least("own", near) / (F.col("own") + near) + 1e-6 >= F.col("floor"))
    enough = F.col("shared") * (200 - F.col("floor")) + 1e-6 >= F.col("floor") * F.least("own", "low")
    by_tokens = known.join(weights.drop("own"), ["shop_id", "q"]).join(sides, key).filter(enough | (F.col("floor") <= 0))
    rest = by_length.select(*key, "q", "floor").union(by_tokens.select(*key, "q", "floor")).distinct().join(home, [*key, "q"], "left_anti")
    return first.union(_visit(rest, blocks, limit))
