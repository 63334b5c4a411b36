import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import whitening
from docloom.llm.whitening import Moments, symmetric_qr, whiten

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors: list[list[float]], components: int = 8):
    """All in one place: integers, covariance by numpy, eigenvectors by LAPACK."""
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    off = x * n - s
    centred = (off / n).astype(float)
    v = centred.T @ centred / n
    values, basis = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    return n, [int(sum(c * c for c in row)) for row in off], centred @ basis[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)


def check(got, ids, vectors):
    n, deviation, white, share = brute(vectors)
    rows = {(r["vec_id"], r["component"]): r for r in got}
    assert len(rows) == len(got) == len(ids) * white.shape[1]
    signs = [np.sign(rows[ids[0], k + 1]["whitened"] * white[0, k]) for k in range(white.shape[1])]
    for i, d, w in zip(ids, deviation, white, strict=True):
        for k in range(white.shape[1]):
            r = rows[i, k + 1]
            assert (r["n"], r["deviation"]) == (n, d)
            assert r["whitened"] == pytest.approx(signs[k] * w[k], abs=1e-7)
            assert r["explained"] == pytest.approx(share[k], rel=1e-9)
            assert r["identity_error"] < 1e-8


def test_eigenvectors():
    rng = np.random.default_rng(1)
    for a in (rng.normal(size=(40, 40)), np.diag([3.0, 3.0, 1.0]), np.zeros((4, 4)), np.ones((5, 5)), np.array([[2.0]]), np.array([[0.0, 1.0], [1.0, 0.0]])):
        a = a @ a.T
        values, q = symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-9 * max(1, abs(a).max()))
        assert np.allclose(q.T @ q, np.eye(len(a)), atol=1e-12)
        assert np.allclose(q * values @ q.T, a, atol=1e-10 * max(1, abs(a).max()))


def test_moments_merge_as_if_added():
    x = np.random.default_rng(2).integers(99_000, 101_000, (300, 5))
    one, parts = Moments(5), [Moments(5) for _ in range(4)]
    one.add(x)
    for m, part in zip(parts, np.split(x, [10, 10, 200]), strict=True):
        m.add(part)
    both = Moments(5)
    for m in parts:
        both.merge(m)
    assert both.n == one.n and both.sums == one.sums == [int(s) for s in x.sum(axis=0)]
    assert np.allclose(both.covariance(), np.cov(x.T, bias=True), rtol=1e-12)
    assert np.allclose(one.covariance(), np.cov(x.T, bias=True), rtol=1e-12)


def test_against_brute_force_with_rows_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) + 5).astype("float32").tolist()
    ids = list(range(len(vectors)))
    bad = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] + [1.0] * 11), (903, [float("inf")] * 12)]
    df = spark.createDataFrame([*zip(ids, vectors, strict=True), *bad], SCHEMA).withColumn("n", F.lit("x")).withColumn("component", F.lit("y")).repartition(7)
    check(whiten(df).collect(), ids, vectors)


def test_states_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    vectors = np.random.default_rng(4).normal(size=(60, 9)).astype("float32").tolist()
    check(whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(11)).collect(), list(range(60)), vectors)


def test_repeated_and_null_ids(spark):
    vectors = np.random.default_rng(5).normal(size=(20, 8)).astype("float32").tolist()
    df = spark.createDataFrame([(None, v) for v in vectors] + [(7, vectors[0])] * 3, SCHEMA)
    got = whiten(df).collect()
    assert len(got) == 23 * 8 and {r["n"] for r in got} == {23} and sum(r["vec_id"] is None for r in got) == 160
    assert len({(r["component"], r["whitened"]) for r in got if r["vec_id"] == 7}) == 8


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_fit(spark, rows):
    got = whiten(spark.createDataFrame(rows, SCHEMA))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_too_few_or_equal_rows(spark):
    got = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in got if r["vec_id"] == 1] == [(1, None, None, None, 0), (2, None, None, None, 0)]
    got = whiten(spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [3.0, 7.0]), (3, [3.0, 7.0])], SCHEMA)).collect()
    assert [r["whitened"] is None for r in sorted(got, key=lambda r: r["component"]) if r["vec_id"] == 2] == [False, True, True]


def test_entries_too_large_for_longs(spark):
    got = whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])], SCHEMA)).collect()
    assert {r["deviation"] for r in got if r["vec_id"] == 1} == {None} and all(r["identity_error"] < 1e-4 for r in got)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = whitening.op12_whitening(spark, sf).collect()
    check(got, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])
