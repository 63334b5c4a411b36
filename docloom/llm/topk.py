"""Exact top-k inner products by a dual-tree search over cover trees.

Queries and data are indexed together: pivots picked farthest-first from a bounded sample are the top nodes of one
tree, every vector belongs to its nearest pivot, and the covering radius and largest norm of each node are measured
over all of its vectors. A node's data is split into blocks and its queries into groups, as many as its size asks for.

Each group first searches one block of its own node, which gives every query a kth score to beat. A (group, block) pair
is then dropped if ``<q, d> + r_q |d| + r_d |q| + r_q r_d`` (or the product of the largest norms) is below the worst
of the group's kth scores. The pairs left are searched, a task a block and batch of groups: it builds one cover tree over
the block and one over each group, and a best-first walk over node pairs prunes by the same bound, down to leaves that
are multiplied as matrices. Queries are a stated set and meet the data in blocks; what is broadcast is one row a pivot.

The trees keep the invariants of a simplified cover tree: a node's point is one of its vectors and a child has it too
(nesting), all vectors of a node of level i lie within BASE**i of its point (covering), and the points of a node's children,
of level j, are more than BASE**j apart (separation). Levels at which a node would have itself as its only child are
skipped. A node that more than CHILDREN balls of the next level would be needed for has no structure to prune by: it stays
a leaf, which is multiplied whole, in slices.

Components become floor(256 x) exactly. Products of floats are exact while the largest sum stays under 2**53; beyond
that leaves are multiplied as Python integers, and scores outside 64 bits are clipped to them.

Edge cases: null vectors and those with null or non-finite components take no part; shorter vectors count as padded
with zeros; a null id takes no part; rows that share an id with the query are its own; ties go to the smaller id; an
empty table gives an empty one. Every row is a candidate: one that is repeated takes a rank each time, and a query's
rows, if it has several, are compared with each candidate each, as a join would.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

K, EVERY, SCALE = 5, 50, 256
PIVOTS, SAMPLE, BLOCK, GROUP, LEAF = 32, 5_000, 20_000, 1_000, 128
#: Queries that meet a block in one task, about; the ratio of a level's radius to the next; children of a node; rows of a slice.
BATCH, BASE, CHILDREN, SLICE = 16_000, 1.3, 64, 2_048
LOWEST = -(2**63)


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding) -> vec_id, v: array of longs as doubles' exact floors."""
    e = F.col("embedding")
    fine = e.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(fine).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    width = max((len(x) for x in column), default=0)
    out = np.zeros((len(column), width))
    for k, x in enumerate(column):
        out[k, : len(x)] = x
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(a.shape[1], b.shape[1])
    pad = lambda m: m if m.shape[1] == n else np.pad(m, ((0, 0), (0, n - m.shape[1])))
    return pad(a), pad(b)


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of x, each the farthest from those before."""
    if not len(x):
        return x
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


class Node:
    __slots__ = ("point", "level", "rows", "centre", "radius", "top", "children")

    def __init__(self, x: np.ndarray, norms: np.ndarray, point: int, rows: np.ndarray, dist: np.ndarray, level: int | None) -> None:
        """rows: the vectors of the node, dist: how far they are from its point. Without a level, the least that covers them."""
        self.point, self.rows, self.centre, self.children = point, rows, x[point], []
        self.radius, self.top = float(dist.max()), float(norms[rows].max())
        self.level = _level(self.radius) if level is None else level


def _level(radius: float) -> int:
    """The least level that covers a radius."""
    if not 0 < radius < np.inf:
        return 0
    n = int(np.ceil(np.log(radius) / np.log(BASE)))
    while BASE**n < radius:
        n += 1
    while BASE ** (n - 1) >= radius:
        n -= 1
    return n


def cover_tree(x: np.ndarray, leaf: int = LEAF, most: int = CHILDREN) -> Node:
    """The tree over all rows of x, from the top: a node's vectors go to the nearest point of a net of the next level, picked farthest first."""
    norms, rows = np.linalg.norm(x, axis=1), np.arange(len(x))
    root = Node(x, norms, 0, rows, np.linalg.norm(x - x[0], axis=1), None)
    open_nodes = [(root, np.linalg.norm(x - x[0], axis=1))]
    while open_nodes:
        node, far = open_nodes.pop()
        if len(node.rows) <= leaf or not 0 < node.radius < np.inf:
            continue
        level = _level(node.radius) - 1  # the first at which its own point doesn't cover it
        part, owner, points = x[node.rows], np.zeros(len(node.rows), "int64"), [node.point]
        while far.max() > BASE**level and len(points) <= most:
            at = int(far.argmax())
            d = np.linalg.norm(part - part[at], axis=1)
            closer = d < far
            owner[closer], far = len(points), np.where(closer, d, far)
            points.append(int(node.rows[at]))
        if len(points) > most:
            continue
        for n, point in enumerate(points):
            mine = owner == n
            child = Node(x, norms, point, node.rows[mine], far[mine], level)
            node.children.append(child)
            open_nodes.append((child, far[mine]))
    return root


def _bound(q: Node, d: Node) -> float:
    b = q.centre @ d.centre + q.radius * np.linalg.norm(d.centre) + d.radius * np.linalg.norm(q.centre) + q.radius * d.radius
    return min(b, q.top * d.top) * (1 + 1e-9) + abs(b) * 2e-9 + 1e-6


class Search:
    """The k best of a block for a group of queries. tree: the block's, if its rows are in the order of their ids and as wide as the queries."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int, tree: Node | None = None) -> None:
        by_id = np.argsort(d_ids, kind="stable")
        (self.q, self.d), self.q_ids, self.d_ids, self.k = _same_width(q, d[by_id]), q_ids, d_ids[by_id], k
        most = (abs(self.q).max() if self.q.size else 0) * (abs(self.d).max() if self.d.size else 0) * max(self.q.shape[1], 1)
        self.exact = most < 2**53
        self.score = np.full((len(q), k), -np.inf) if self.exact else np.full((len(q), k), None, object)
        self.ids = np.full((len(q), k), np.iinfo("int64").max)
        self.kth = np.full(len(q), -np.inf)
        self.pairs, self.tree = 0, tree

    def run(self, floor: np.ndarray) -> None:
        """floor: for each query a score that k others are known to reach."""
        self.kth = floor.astype(float).copy()
        if not len(self.q) or not len(self.d):
            return
        top = (cover_tree(self.q), self.tree or cover_tree(self.d))
        heap, n = [(-_bound(*top), 0, *top)], 1
        while heap:
            b, _, q, d = heapq.heappop(heap)
            if -b < self.kth[q.rows].min():
                continue
            if not q.children and not d.children:
                for at in range(0, len(d.rows), SLICE):
                    self.leaf(q.rows, d.rows[at : at + SLICE])
                continue
            split_q = q.children and (not d.children or q.radius > d.radius)
            for pair in [(c, d) for c in q.children] if split_q else [(q, c) for c in d.children]:
                if (b := _bound(*pair)) >= self.kth[pair[0].rows].min():
                    heapq.heappush(heap, (-b, n, *pair))
                    n += 1

    def leaf(self, qs: np.ndarray, ds: np.ndarray) -> None:
        self.pairs += len(qs) * len(ds)
        if self.exact:
            s = self.q[qs] @ self.d[ds].T
            s[self.q_ids[qs][:, None] == self.d_ids[ds][None, :]] = -np.inf
            live = s.max(axis=1) >= self.kth[qs]
            qs, s = qs[live], s[live]
            if not len(qs):
                return
            best = np.argsort(-s, axis=1, kind="stable")[:, : self.k]
            score = np.concatenate([self.score[qs], np.take_along_axis(s, best, 1)], axis=1)
            ids = np.concatenate([self.ids[qs], self.d_ids[ds][best]], axis=1)
            ids = np.where(np.isneginf(score), np.iinfo("int64").max, ids)
            keep = np.lexsort((ids, -score), axis=1)[:, : self.k]
            self.score[qs], self.ids[qs] = np.take_along_axis(score, keep, 1), np.take_along_axis(ids, keep, 1)
            self.kth[qs] = np.maximum(self.kth[qs], self.score[qs][:, -1])
            return
        for r in qs:
            row = [int(x) for x in self.q[r]]
            found = [(s, i) for s, i in zip(self.score[r], self.ids[r], strict=True) if s is not None]
            found += [(max(LOWEST, min(2**63 - 1, sum(a * int(b) for a, b in zip(row, self.d[j], strict=True)))), self.d_ids[j]) for j in ds if self.d_ids[j] != self.q_ids[r]]
            found = sorted(found, key=lambda x: (-x[0], x[1]))[: self.k]
            for c, (s, i) in enumerate(found):
                self.score[r, c], self.ids[r, c] = s, i
            if len(found) == self.k:
                self.kth[r] = max(self.kth[r], float(found[-1][0]) * (1 - 1e-12 * np.sign(found[-1][0])) - 1)

    def result(self) -> pd.DataFrame:
        rows = [(int(self.q_ids[r]), int(self.ids[r, c]), int(self.score[r, c])) for r in range(len(self.q)) for c in range(self.k) if self.score[r, c] is not None and self.ids[r, c] != np.iinfo("int64").max]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def _assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Plus node (the nearest pivot), its distance, the norm, and a number that spreads rows, equal ones too."""

    @F.pandas_udf("node int, dist double, norm double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        x, p = _same_width(_matrix(v), pivots)
        d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)[None]))
        node = d.argmin(1)
        real = np.linalg.norm(x - p[node], axis=1)
        return pd.DataFrame({"node": node.astype("int32"), "dist": real, "norm": np.linalg.norm(x, axis=1)})

    spread = F.xxhash64("vec_id", F.monotonically_increasing_id())
    return vectors.withColumn("_n", nearest("v")).select(*vectors.columns, "_n.node", "_n.dist", "_n.norm", spread.alias("spread"))


def _search(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int, batches: int) -> DataFrame:
    """pairs: (q_node, q_salt, d_node, d_salt). -> query_id, vec_id, score: the best of each block for each query.

    A task has a block and those groups of a batch that are left for it.
    """
    block = F.concat_ws(":", "d_node", "d_salt").alias("block")
    met = pairs.select("*", block, F.pmod(F.xxhash64("q_node", "q_salt"), F.lit(batches)).cast("int").alias("batch"))
    asked = queries.select(F.col("node").alias("q_node"), F.col("salt").alias("q_salt"), "vec_id", "v", "floor")
    left = met.join(asked, ["q_node", "q_salt"]).select("block", "batch", F.concat_ws(":", "q_node", "q_salt").alias("grp"), "vec_id", "v", "floor")
    held = data.select(F.col("node").alias("d_node"), F.col("salt").alias("d_salt"), "vec_id", "v")
    right = met.select("d_node", "d_salt", "block", "batch").distinct().join(held, ["d_node", "d_salt"])
    right = right.select(*[F.col(c).alias(c) for c in ("block", "batch", "vec_id", "v")])  # names of its own beside the left side's

    def best(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")]
        if len(qs) and len(ds):
            ds = ds.sort_values("vec_id", kind="stable")
            q, d = _same_width(_matrix(qs["v"]), _matrix(ds["v"]))
            ids, tree, q_ids, floor = ds["vec_id"].to_numpy("int64"), cover_tree(d), qs["vec_id"].to_numpy("int64"), qs["floor"].to_numpy("float64")
            for rows in qs.groupby("grp").indices.values():
                s = Search(q[rows], q_ids[rows], d, ids, k, tree)
                s.run(floor[rows])
                out.append(s.result())
        return pd.concat(out)

    return left.groupBy("block", "batch").cogroup(right.groupBy("block", "batch")).applyInPandas(best, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score for queries with vec_id divisible by ``every``."""
    spark, vectors = rows.sparkSession, integer_vectors(rows)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = farthest_first(_matrix(sample["v"]), PIVOTS)
    data = cut(_assign(vectors, pivots))
    sizes = data.groupBy("node").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()  # a row a pivot
    n_blocks = _of_node({r["node"]: -(-r["n"] // BLOCK) for r in sizes})
    n_groups = _of_node({r["node"]: max(1, -(-r["q"] // GROUP)) for r in sizes})
    batches = max(1, -(-sum(r["q"] for r in sizes) // BATCH))
    queries = data.filter(F.col("vec_id") % every == 0).withColumn("salt", F.pmod("spread", n_groups(F.col("node"))).cast("int"))
    data = data.withColumn("salt", F.pmod("spread", n_blocks(F.col("node"))).cast("int"))
    sides = lambda df, p: df.groupBy(F.col("node").alias(f"{p}_node"), F.col("salt").alias(f"{p}_salt")).agg(F.max("dist").alias(f"{p}_radius"), F.max("norm").alias(f"{p}_top"))
    g, b = cut(sides(queries, "q")), cut(sides(data, "d"))
    own = (F.col("d_node") == F.col("q_node")) & (F.col("d_salt") == F.pmod("q_salt", n_blocks(F.col("q_node"))))
    one = g.select("q_node", "q_salt", F.col("q_node").alias("d_node"), F.pmod("q_salt", n_blocks(F.col("q_node"))).cast("int").alias("d_salt"))
    first = cut(_search(one, queries.withColumn("floor", F.lit(float("-inf"))), data, k, batches))
    kth = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    queries = cut(queries.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
    worst = queries.groupBy(F.col("node").alias("q_node"), F.col("salt").alias("q_salt")).agg(F.min("floor").alias("worst"))
    dots, norms = pivots @ pivots.T, np.linalg.norm(pivots, axis=1)
    nodes = [(q, d, float(dots[q, d]), float(norms[q]), float(norms[d])) for q in range(len(pivots)) for d in range(len(pivots))]
    ties = spark.createDataFrame(nodes, "q_node int, d_node int, dot double, q_norm double, d_norm double")
    bound = F.least(F.col("dot") + F.col("q_radius") * F.col("d_norm") + F.col("d_radius") * F.col("q_norm") + F.col("q_radius") * F.col("d_radius"), F.col("q_top") * F.col("d_top"))
    slack = F.abs(F.col("dot")) * 1e-8 + F.col("q_top") * F.col("d_top") * 1e-8 + 1e-6
    rest = g.join(worst, ["q_node", "q_salt"]).join(F.broadcast(ties), "q_node").join(b, "d_node").filter(~own & (bound + slack >= F.col("worst"))).select("q_node", "q_salt", "d_node", "d_salt")
    found = first.union(_search(rest, queries, data, k, batches))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _of_node(numbers: dict[int, int]):
    """A number a pivot, as an expression over the node."""
    pairs = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    return lambda node: pairs[node]


def op7_topk(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
