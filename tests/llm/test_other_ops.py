"""Archives, search and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docloom.llm import topk, warc


def test_warc_round_trip(spark, tmp_path):
    big, small = "é" * 60, "x" * 99
    rows = [
        (5, "http://www.Example.com:80/a?b#c", big, 1), (3, "https://m.example.com", big, 1), (9, None, big, 1), (4, "http://a.b/\r\nx: y", small, 1), (6, "u", small, 1), (1, "", None, 1), (2, "?", "", 1),
        (None, "z", big, 1), (7, "q", "WARC/1.1\r\n\r\nfake\r\n\r\n" * 9, 1), (8, "q", "long " * 200_000, 1), (8, "q", "long " * 200_000, 1),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    path = str(tmp_path / "w")
    warc.write_warc(pages.repartition(3), path, per_file=2)
    index = warc.merge_index(warc.read_index(spark, path)).collect()
    first = {}
    for i, _, h, _ in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, 1 << 60))
    want = Counter()
    for i, _, h, _ in rows:
        b = (h or "").encode()
        again = h in first and first[h] != i
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in index) == want
    keys = [(r["url_key"], r["date"]) for r in index]
    assert keys == sorted(keys) and len({r["run"] for r in index}) > 2
    assert warc.url_key("http://www.Example.com:80/a?b#c") == "com,example)/a?b" and warc.url_key("https://x.y") == "y,x)/"


def test_warc_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    assert warc.merge_index(warc.read_index(spark, str(tmp_path / "w"))).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(r.randint(0, 50) for _ in range(r.randint(0, 30))) for _ in range(k)]
    assert list(warc.LoserTree([iter(x) for x in runs], lambda x: x)) == sorted(sum(runs, []))


def brute(rows, k=5, every=50):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


def test_topk_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 150)
    monkeypatch.setattr(topk, "GROUP", 4)
    r = np.random.default_rng(1)
    centres = r.normal(size=(6, 16)) * 3
    rows = [(i, (centres[i % 6] + r.normal(size=16) * 0.2).astype("float32").tolist()) for i in range(900)]
    rows[10], rows[11], rows[12], rows[13], rows[14] = (10, None), (11, [float("nan")] * 16), (12, [None] * 16), (13, []), (14, rows[14][1][:3])
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(None, rows[0][1])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, score int")
    assert {tuple(x) for x in topk.top_k(df).collect()} == brute(rows)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert {tuple(x) for x in topk.top_k(few).collect()} == brute(rows[:3])
    assert topk.top_k(few.limit(0)).count() == 0


def test_topk_beyond_exact_doubles():
    q, d = np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 3.0], [2.0**40, 2.0], [2.0**30, 0.0]])
    s = topk.Search(q, np.array([0]), d, np.array([1, 2, 3]), 2)
    s.run(np.full(1, -np.inf))
    assert not s.exact and s.result().to_numpy().tolist() == [[0, 1, 2**63 - 1], [0, 2, 2**63 - 1]]


def test_pruning_skips_pairs():
    r = np.random.default_rng(2)
    d = np.concatenate([r.normal(size=(2000, 8)) + 40, r.normal(size=(2000, 8)) - 40])
    s = topk.Search(d[:50].round(), np.arange(50), d.round(), np.arange(4000), 5)
    s.run(np.full(50, -np.inf))
    assert s.pairs < 0.7 * 50 * 4000


def test_pipeline(spark):
    import corpus_pipeline as P

    assert 4 <= len(P.STAGES) <= 5
    prose = lambda k: " ".join(f"w{(k * 7919 + i * i) % 5000}" for i in range(80)) + "."
    texts = {i: prose(i) for i in range(1, 30)}
    texts[30], texts[31] = texts[1], texts[2].replace(texts[2].split()[40], "changed", 1)
    texts[32] = "a | b | c | d | e | f | g | h | i | j | k | l | m"
    texts[33] = prose(33) + " write to someone.else@mail7.example.com"
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()] + [(34, None, None, None, None), (35, "", "en", "s1", 0), (5, texts[5], "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, "").cache()
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r["n_chars"] == len(r["text"]) for r in kept[name])
    ids = {n: Counter(r["doc_id"] for r in x) for n, x in kept.items()}
    assert set(ids["quality rules"]) == set(range(1, 32)) | {33}
    assert ids["near-duplicates"] == Counter([*range(1, 30), 33])
    assert not any("someone" in r["text"] for r in kept["personal data"])
    words = {r["doc_id"]: len(r["text"].split()) for r in kept["personal data"]}
    assert sum(words[d] * n for d, n in ids["source mix"].items()) == pytest.approx(1.5 * sum(words.values()), rel=0.15)
    assert {r["doc_id"] for r in kept["packing"]} == set(ids["source mix"])
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, "").cache()
        assert empty.count() == 0
