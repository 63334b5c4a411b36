"""Queries that take all rows of their tables."""

from collections import Counter

from pyspark.sql import functions as F

from docloom.functions.names import normalize
from docloom.functions.scores import token_set
from docloom.plans import analogues as A
from docloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_push_plan_has_all_orders(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    plan = QUERIES["push_plan"](spark, SF).collect()
    assert len(plan) == 2 * orders and len({r["document_id"] for r in plan}) == orders
    new = sum(r["action"] == "insert" for r in plan)
    assert QUERIES["push_upsert"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count() + new


def test_matching_takes_all_names_and_items(spark):
    catalog = A.catalog(spark, SF).collect()
    names = {}
    for r in catalog:
        names.setdefault(r["shop_id"], []).append((r["id"], r["normalized_name"]))
    best = {}

    def ranked(shop, name):
        if (shop, name) not in best:
            best[shop, name] = sorted((-token_set(name, n), i) for i, n in names[shop])
        return best[shop, name]

    got = {(r["query_id"], r["rank"]): r["id"] for r in QUERIES["token_set_topk"](spark, SF).collect()}
    want = {(r["id"], k + 1): i for r in catalog for k, (s, i) in enumerate(ranked(r["shop_id"], r["normalized_name"])[:3]) if -s >= 40}
    assert got == want and {q for q, _ in got} == {r["id"] for r in catalog}
    assert len({r["query_id"] for r in QUERIES["alternatives_for_names"](spark, SF).select("query_id").collect()}) > len(catalog) / 2

    part = {f"part {r['p_partkey']}": f"{r['p_name']} {r['p_size']}mg" for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    known = {r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()}
    normal = {r["name"]: r["n"] for r in spark.createDataFrame([(n,) for n in set(part.values())], "name string").select("name", normalize(F.col("name")).alias("n")).collect()}
    want = Counter()
    for r in lines:
        name = part.get(f"part {r['l_partkey']}")
        if r["l_orderkey"] in known and name is not None:
            s, i = ranked(r["l_orderkey"] % 7, normal[name])[0]
            want[r["l_orderkey"], name, i if -s >= 70 else None] += 1
    got = QUERIES["link_items"](spark, SF).collect()
    assert Counter((r["document_id"], r["name"], r["match_id"]) for r in got) == want
    totals = {r["document_id"]: r["total"] for r in QUERIES["match_documents"](spark, SF).collect()}
    assert totals == Counter(r["document_id"] for r in got)
