"""Ids of 64 bits beside nulls, columns with clashing names, surrogates of full classes and over planted entities."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from docloom.llm import chat, packing, pii, quality, warc

BIG = (1 << 60) + 1


def test_large_ids_in_packing(spark):
    docs = spark.createDataFrame([(BIG, "a b c"), (BIG - 1, "d"), (None, "e"), (-BIG, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in packing.pack(docs).collect()} == {BIG, BIG - 1, None, -BIG}


def test_large_ids_in_chat(spark):
    turns = [(c, t, "user", f"{c} {t}") for c in (1 << 53, (1 << 53) + 1, None) for t in range(3)]
    events = chat.as_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_conversations(events)).collect()}
    assert got == {1 << 53: 3, (1 << 53) + 1: 3, None: 3}


def test_turns_through_drafts_edits_and_regenerations(spark):
    turns = [(1, None, "user", "first"), (1, 2, "assistant", "b" * 7), (1, 2, "assistant", "b" * 7), (1, 2, "assistant", None), (1, 3, "user", chat.INJECTION), (1, 4, "assistant", "é"), (1, 5, None, "")]
    events = chat.as_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {r["kind"] for r in events.collect()} == {"start", "delta", "edit", "regenerate", "commit"}
    rows = chat.format_conversations(events).orderBy("position").collect()
    said = [(a, b) for r in rows for a, b, _ in chat.parse(r["formatted"])]
    assert said == [("user", "first"), ("assistant", ""), ("assistant", "b" * 7), ("assistant", "b" * 7), ("user", chat.INJECTION), ("assistant", "é"), ("", "")]


def test_large_ids_in_archives(spark, tmp_path):
    page = "same page " * 30
    pages = spark.createDataFrame([(BIG, "u", page), (BIG + 1, "v", page), (None, "w", page), (BIG + 5, "x", "other")], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.merge_index(warc.read_index(spark, str(tmp_path / "w"))).collect())
    assert got == Counter({(BIG, "response", None): 1, (BIG + 1, "revisit", BIG): 1, (None, "revisit", BIG): 1, (BIG + 5, "response", None): 1})


CLASHES = ["row", "q", "words", "lines", "grams", "pairs", "at", "cleaned", "kept", "n_words", "base_failed", "_w", "_q0", "_special", "special", "new", "_new", "n_entities", "k1", "k2", "_row", "node", "key", "component", "bucket", "h", "fp"]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_clashing_columns(spark, name):
    prose = "Plain words stand here, and Mr. John Smith mails j.s@mail9.example.com on most days of any week."
    docs = spark.createDataFrame([(k, f"{prose} {'x' * k} {k}", "en", f"s{k % 2}", 9) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in CLASHES])
    got = dict(P.STAGES)[name](spark, docs, "")
    rows = got.collect()
    assert rows
    if name != "packing":
        assert got.columns == docs.columns
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHES)


def test_notices_and_losses(spark):
    footer = "Read our privacy policy.\n"
    texts = {
        1: footer * 300 + "hello world", 2: "word " * 3000 + "under creative commons " + "word2 " * 500, 3: "All rights reserved.\n" * 400 + "three more words",
        4: " ".join(f"w{k}" for k in range(60)) + "\n" + footer, 5: "x" * 30 + "!! a\r?? b !! c" + " word" * 3,
    }
    df = spark.createDataFrame([(k, re.sub("word ", lambda m, n=iter(range(10**6)): f"w{next(n)} ", v)) for k, v in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["left_chars"]) for r in quality.assess(df).collect()}
    assert got[2][0] and got[4][0] and not got[1][0] and not got[3][0]
    assert got[5][1] == 0  # three shouts, whatever breaks lines elsewhere


@pytest.mark.parametrize("shape", ["dd", "l", "ud", "d-d", "xx"])
def test_full_classes_map_onto_themselves(shape):
    every = [""]
    for c in shape:
        every = [a + b for a in every for b in pii._CLASSES.get(c, "-")]
    got = [pii.permute(b"k", "t", x, shape) for x in every]
    assert sorted(got) == sorted(every) and not any(a == b for a, b in zip(got, every, strict=True))


def test_corpus_with_every_private_address(spark):
    found = spark.range(65536).select(F.lit("ip").alias("kind"), F.concat_ws(".", F.lit("192.168"), F.shiftright("id", 8), F.col("id").bitwiseAND(255)).alias("entity"))
    assert pii.attempts(found, b"k").count() == 0


def test_planted_entities(spark):
    """Plain Python plants known entities and reads the surrogates back from the fixed text around them."""
    r = random.Random(4)
    mails = [f"u{k}.x{r.randrange(99)}@mail{k % 7}.example.{r.choice(['com', 'org'])}" for k in range(60)]
    phones = [f"+1-{r.randrange(200, 999)}-555-{r.randrange(1000, 9999)}" for _ in range(60)]
    ips = [f"8.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}" for _ in range(60)]
    names = ["".join(r.choice("abdefgiklmnoprstuvz") for _ in range(6)).title() for _ in range(200)]
    facts = [(i, r.choice(mails), r.choice(phones), r.choice(ips), r.choice(names), r.choice(names)) for i in range(400)]
    docs = spark.createDataFrame([(i, f"[{m}] call [{p}] at [{a}]: Mr. {g} {s}!") for i, m, p, a, g, s in facts], "doc_id long, text string")
    maps = [{}, {}, {}, {}, {}]
    for row in pii.replace(docs, b"some key").collect():
        found = re.fullmatch(r"\[(.+)\] call \[(.+)\] at \[(.+)\]: Mr\. (\w+) (\w+)!", row["text"]).groups()
        assert row["n_entities"] == 5
        for m, old, new in zip(maps, facts[row["doc_id"]][1:], found, strict=True):
            assert m.setdefault(old, new) == new != old
            assert [c.isalpha() for c in new if not c.isdigit()] == [c.isalpha() for c in old if not c.isdigit()] or m in maps[3:]
    for m in maps:
        assert len(set(m.values())) == len(m)
    assert all(a.rpartition(".")[2] == b.rpartition(".")[2] for a, b in maps[0].items()) and all(b.startswith("+1-") for b in maps[1].values())
    assert not {x.lower() for x in names} & {x.lower() for m in maps[3:] for x in m.values()}
