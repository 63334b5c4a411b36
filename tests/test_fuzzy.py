import random

import pytest

from docloom.functions.scores import token_set
from docloom.operators import fuzzy
from docloom.operators.fuzzy import Block
from docloom.operators.matching import match_names


def brute(queries, catalog, limit, floor):
    out = []
    for query_id, shop, name in queries:
        hits = [(-token_set(name, n), i) for i, s, n in catalog if s == shop and n and token_set(name, n) >= floor]
        out += [(query_id, r, i, -s) for r, (s, i) in enumerate(sorted(hits)[:limit], 1)]
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    words = ["para", "cetamol", "amoxi", "cillin", "500", "500mg", "250", "para500", "ring", "gnir", "a", "b", "ab", "ba", "zinc", "oxide", "hydroxychloroquine"]
    return [" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 2, 3, 4, 7]))) for _ in range(n)]


@pytest.mark.parametrize(("limit", "floor"), [(1, 70.0), (3, 40.0), (5, 95.0), (3, 0.5), (50, 60.0)])
@pytest.mark.parametrize("size", [7, 2_048])
def test_equal_to_scoring_all_pairs(spark, monkeypatch, limit, floor, size):
    monkeypatch.setattr(fuzzy, "BLOCK", size)
    monkeypatch.setattr(fuzzy, "QUERIES", size)
    catalog = [(k, k % 2, n) for k, n in enumerate(made(1, 160))] + [(900, 0, ""), (901, 3, "alone")]
    queries = [(k, k % 3, n) for k, n in enumerate(made(2, 60))] + [(500, 0, "nothing like it"), (501, 0, "xyzq"), (502, 0, catalog[0][2])]
    q = spark.createDataFrame(queries, "query_id long, shop_id int, name string")
    c = spark.createDataFrame(catalog, "id long, shop_id int, normalized_name string")
    got = match_names(q, c, limit, floor).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], r["raw_score"]) for r in got) == brute(queries, catalog, limit, floor)


def test_empty_sides(spark):
    q = spark.createDataFrame([(1, 1, "para"), (2, 1, "  "), (3, 1, None)], "query_id long, shop_id int, name string")
    c = spark.createDataFrame([], "id long, shop_id int, normalized_name string")
    assert match_names(q, c).collect() == [] == match_names(q.limit(0), c).collect()


def test_few_names_are_compared_letter_by_letter():
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) + " " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(2_000)})
    block = Block(names)
    for n in names[:50]:
        assert block.best(n + "x", 1, 40.0) == [(names.index(n), token_set(n + "x", n))]
    assert block.compared < 0.05 * 50 * len(names)
