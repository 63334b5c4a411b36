"""Top-k over rows that share ids."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import compare

from docloom.llm import topk


@pytest.mark.parametrize("block", [30, 20_000])
def test_repeated_rows_against_sql(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).astype("float32").tolist()) for i in range(120)]
    best = (np.array(rows[0][1]) * 9).astype("float32").tolist()
    rows += [(200 + n, best) for n in (1, 2) for _ in range(4 - n)]  # three and two times
    rows += [rows[50], (100, rows[7][1])]  # a query again, and one with another vector
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert compare(spark, topk.op7_topk, topk.ORACLE, str(tmp_path)) == 15


def nodes(tree):
    yield tree
    for c in tree.children:
        yield from nodes(c)


@pytest.mark.parametrize("kind", ["clusters", "line", "equal", "spread", "one"])
def test_a_cover_trees_invariants(kind):
    r = np.random.default_rng(8)
    x = {
        "clusters": np.concatenate([r.normal(size=(150, 5)) * 0.1 + r.normal(size=5) * 20 for _ in range(6)]),
        "line": np.exp2(np.arange(300) % 60)[:, None] * np.ones(3),
        "equal": np.ones((500, 4)),
        "spread": r.normal(size=(400, 64)),
        "one": np.ones((1, 2)),
    }[kind]
    tree = topk.cover_tree(x, leaf=10)
    for n in nodes(tree):
        d = np.linalg.norm(x[n.rows] - x[n.point], axis=1)
        assert n.point in n.rows and d.max() == pytest.approx(n.radius) and d.max() <= topk.BASE**n.level * (1 + 1e-12)
        if n.children:
            points = [c.point for c in n.children]
            assert n.point in points and {c.level for c in n.children} == {n.children[0].level} and n.children[0].level < n.level
            assert sorted(i for c in n.children for i in c.rows) == sorted(n.rows)
            apart = np.linalg.norm(x[points][:, None] - x[points][None], axis=2) + np.eye(len(points)) * 1e300
            assert apart.min() > topk.BASE ** n.children[0].level
    if kind != "spread":  # may or may not need more than CHILDREN balls
        assert bool(tree.children) == (kind in ("clusters", "line"))


def test_many_blocks_groups_and_batches_against_sql(spark, tmp_path, monkeypatch):
    """A third of all rows is one vector; nodes of several blocks, batches of few groups."""
    for name, value in {"BLOCK": 60, "GROUP": 3, "BATCH": 5, "PIVOTS": 4, "LEAF": 8, "SLICE": 16}.items():
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(9)
    centres = r.normal(size=(8, 12)) * 2
    rows = [(i, (centres[i % 8] + r.normal(size=12) * 0.05).astype("float32").tolist()) for i in range(600)]
    rows += [(1_000 + i, rows[3][1]) for i in range(300)] + [(2_000, rows[5][1][:4])] * 30
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {tuple(x) for x in topk.top_k(spark.read.parquet(str(tmp_path / "embeddings.parquet")).filter("vec_id <> 2000")).collect()}
    exact = {i: [int(np.floor(256 * np.float64(np.float32(c)))) for c in v] for i, v in rows if i != 2_000}
    want = set()
    for q in exact:
        if q % topk.EVERY == 0:
            best = sorted((-sum(a * b for a, b in zip(exact[q], exact[i], strict=True)), i) for i in exact if i != q)[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
