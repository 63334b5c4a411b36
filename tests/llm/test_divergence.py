import random
import re
from collections import Counter, defaultdict

import pytest
from oracle import compare
from pyspark.sql import functions as F

from docloom.llm import divergence
from docloom.llm.divergence import Leaves, RadixTrie, audit, count_terms

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, min_docs=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source, terms = lang or "", source or "", terms_of(text)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=lambda t: t.encode())
        of_lang = sum((counts[lang, s] for s in sources), Counter())

        def p(c, v=len(kept), kept=kept):
            total = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept]

        f = lambda a, b: (a - b) ** 2 // (a + b)
        ps, q = {s: p(counts[lang, s]) for s in sources}, p(of_lang)
        for s in sources:
            pairs = [(sum(map(f, ps[s], ps[o])), o) for o in sources if o != s]
            best = [(f(a, b), t) for t, a, b in zip(kept, ps[s], q, strict=True) if counts[lang, s][t] and a > b]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", best, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def made(seed: int, n: int, langs=("en", "", None, "zz"), sources=("a", "b", "B", None, "", "ß")):
    rng = random.Random(seed)
    words = ["The", "the", "THE", "straße", "ÀÉ", "日本", "z", "zz", "zzz", "a-b", "x1y", "\U0001f600", "é", "é", "end"]
    return [(i, rng.choice([None, "", " 1 2 _ ", *[" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(9)]]), rng.choice(langs), rng.choice(sources)) for i in range(n)]


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_radix_trie_keeps_byte_order():
    rng = random.Random(1)
    terms = {"".join(rng.choices("abé日\U0001f600", k=rng.randint(1, 6))).encode() for _ in range(500)} | {b""}
    trie, order = RadixTrie(), list(terms)
    numbers = {t: trie.leaf(t) for t in order}
    assert {t: trie.leaf(t) for t in order} == numbers and sorted(numbers.values()) == list(range(len(terms))) and trie.size == len(terms)
    assert list(trie.walk()) == [(t, numbers[t]) for t in sorted(terms)]
    assert [t.decode() for t, _ in trie.walk()] == sorted(t.decode() for t in terms)  # as code points


def test_terms_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    for text in ("", "a", "abcdefghijklmnopqrstuvwxyz", "ab cd ef gh ij kl mn", "1234567", "abcdefg hij", "日本語日本語 日本 x", "aaaaaa aaaaaaa aaaaaaaa " * 3):
        assert count_terms(text.encode()) == Counter(t.encode() for t in terms_of(text))


@pytest.mark.parametrize(("kw", "most"), [({}, 10**6), ({"block": 2, "terms": 3}, 10**6), ({"min_docs": 3, "top": 2, "block": 1}, 4)])
def test_against_brute_force(spark, monkeypatch, kw, most):
    monkeypatch.setattr(divergence.tries, "__defaults__", (most,))
    monkeypatch.setattr(divergence.merge, "__defaults__", (10, most))
    monkeypatch.setattr(Leaves, "PENDING", 20)
    rows = made(2, 400)
    df = spark.createDataFrame(rows + rows[:50], SCHEMA).repartition(5).withColumn("term", F.lit("x")).withColumn("key", F.lit(1)).withColumn("rank", F.lit(1))
    assert got(audit(df, **kw)) == brute(rows + rows[:50], kw.get("min_docs", 10), kw.get("top", 10))


def test_small_tables(spark):
    assert got(audit(spark.createDataFrame([], SCHEMA))) == set()
    one = [(1, None, None, None)]
    assert got(audit(spark.createDataFrame(one, SCHEMA))) == brute(one) == set()
    two = [(1, "a", "en", "x"), (2, "", "en", "y")]  # no kept terms
    assert got(audit(spark.createDataFrame(two, SCHEMA))) == brute(two) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
    alike = [(i, "b a", "en", s) for i in range(6) for s in "xyz"]  # ties
    assert got(audit(spark.createDataFrame(alike, SCHEMA))) == brute(alike)


def test_very_long_text(spark):
    rows = [(1, "Long " * 300_000 + "x" * 2_000_000, "en", "a"), *[(i, "long x short", "en", "b") for i in range(12)]]
    assert got(audit(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_large_counts_stay_exact():
    import numpy as np

    counts = np.array([0, 3, 10**13])
    assert divergence.frequencies(counts, 10**13 + 3, 3).tolist() == [1 + 10**9 * (n + 2) // (10**13 + 9) for n in counts.tolist()]


def test_query_against_sql(spark):
    assert compare(spark, divergence.op13_divergence, divergence.ORACLE, "/root/testdata/sf0.001")
