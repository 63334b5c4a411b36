import random

import pytest

from docloom.operators import grams


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 2), "".join(rng.choice("abc é") for _ in range(rng.randint(0, 12)))) for i in range(400)]
    rows += [(1000, 0, None), (1001, 1, "aaaaaa"), (1002, 1, "a%_b\\c"), (1003, None, "zebra"), (1003, None, "zebra")]
    path = str(tmp_path_factory.mktemp("grams") / "x")
    grams.build(spark.createDataFrame(rows, "id long, shop int, name string"), path, "name", "shop", "id")
    return rows, path


QUERIES = ["", "a", "é", "ab", "a ", "abc", "aaa", "aaaa", "c é", "abcab", "zebra", "%_b", "\\c", "zzz", "abz", "x"]


def test_one_query(spark, index):
    rows, path = index
    for q in QUERIES:
        assert sorted(r["id"] for r in grams.search(spark, path, "name", q).collect()) == sorted(i for i, _, n in rows if n is not None and q in n), q
    for q in ("", "ab", "abc"):
        assert sorted(r["id"] for r in grams.search(spark, path, "name", q, "shop", 1).collect()) == sorted(i for i, s, n in rows if s == 1 and n is not None and q in n), q


def test_all_queries(spark, index):
    rows, path = index
    asked = spark.createDataFrame([(k, q) for k, q in enumerate([*QUERIES, None, "abc"])], "k int, q string")
    got = sorted((r["k"], r["id"]) for r in grams.search_all(spark, path, "name", asked).collect())
    assert got == sorted((k, i) for k, q in enumerate([*QUERIES, None, "abc"]) for i, _, n in rows if q is not None and n is not None and q in n)


def test_a_search_reads_a_list_and_not_the_table(spark, tmp_path):
    path, n = str(tmp_path / "x"), 20_000
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(3_000)]
    rows = [(i, 0, f"{rng.choice(words)} {rng.choice(words)}") for i in range(n)]
    grams.build(spark.createDataFrame(rows, "id long, shop int, name string"), path, "name", "shop", "id")
    found = grams.search(spark, path, "name", words[0])
    assert sorted(r["id"] for r in found.collect()) == sorted(i for i, _, s in rows if words[0] in s)
    plan = found._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    read = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert leaves.size() == 1 and read < n / 10
    assert "EqualTo(_gram" in plan.toString() and "StringContains(name" in plan.toString()
