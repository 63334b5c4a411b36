"""Edge cases, brute force and round trips of the operators on texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import chat, mixing, packing, pii, quality, registry, simhash, substrings, suffixes

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, words int, h string, size string, fp int, chunk int, k1 string"


def corpus(seed=3, n=60):
    """Small invented texts with shared passages, copies, nulls, empties, a repeated row and one very long text."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß中") for _ in range(r.randint(1, 6))) for _ in range(300)]
    passage = " ".join(r.choices(words, k=70))
    rows = []
    for i in range(n):
        t = " ".join(r.choices(words, k=r.randint(0, 120)))
        if i % 5 == 0:
            t = t + "\n" + passage[r.randint(0, 60) :] + "\t" + t[:40]
        rows.append([i, t, f"s{i % 4}"])
    rows[7][1], rows[8][1], rows[9][1], rows[10][1] = None, "", " \n\t ", rows[11][1]
    rows[12][1] = rows[13][1] = rows[14][1] = passage
    rows[15][1] = " ".join(r.choices(words, k=30_000))
    rows[16][1] = "ab " * 500
    rows[17][2] = rows[18][2] = None
    rows += [list(rows[20]), [None, passage, None], [None, None, "s1"]]
    return [(a, b, c, "en", 1, 2, "x", "y", 3, 4, "z") for a, b, c in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing_meets_targets(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and mixing.mix(empty).count() == 0
    by = {}
    for r in rows:
        s = by.setdefault(r["source"], [0, r["source_size"], r["target"], 0])
        s[0] += r["taken"]
        s[3] = max(s[3], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    total = sum(s[1] for s in by.values())
    assert sum(s[2] for s in by.values()) == pytest.approx(1.5 * total)
    assert all(abs(s[0] - s[2]) <= s[3] and s[2] <= 2 * s[1] + 1e-6 for s in by.values())
    taken = mixing.mixture(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in rows)


def test_targets_by_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, None: 5, "d": 0}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = ["a", "b", "c", "d", None]
    w, cap = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {s: 2.0 * sizes[s] for s in order}
    t, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        left = 0.0
        for s in list(open_):
            t[s] += share[s]
            if t[s] >= cap[s]:
                left, t[s] = left + t[s] - cap[s], cap[s]
                open_.remove(s)
    assert got == pytest.approx(t)


def repeated_words(words):
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    return len(hit)


def test_quality_counts(spark, docs, empty):
    more = spark.createDataFrame([(100, "a b c d e a b c d e a b c d", None), (101, "x\nx\n\n\nx y\nx #*$%&|<>", None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.assess(more).collect()}
    assert [got[100][c] for c in ("n_words", "n_repeat_words", "base_failed")] == [14, 14, True]
    assert [got[101][c] for c in ("n_words", "n_dup_lines", "n_symbols", "word_chars")] == [6, 1, 8, 13]
    rows = quality.assess(docs.withColumn("kept", F.lit("clash"))).select("doc_id", *quality.COLUMNS[1:]).collect()
    texts = Counter()
    for d, t, *_ in corpus():
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        rep = repeated_words(w)
        texts[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 10 or 100 * rep > 20 * len(w)] += 1
    assert Counter(tuple(r)[:7] for r in rows) == texts
    assert not any(r["kept"] and r["base_failed"] for r in rows) and quality.assess(empty).count() == 0


def test_quality_verdicts(spark):
    prose = "This is a sentence of plain words that nobody could object to. Here is one more for it.\n"
    texts = {
        1: prose * 1, 2: prose + "home | news | sport | more | about\n" * 1, 3: "a | b | c | d | e | f | g | h | i | j | k | l",
        4: "w1$$$ w2&&& w3%%% w4### w5*** w6$$$ w7&&& w8%%% w9### w10*** w11$$$", 5: prose + "All rights reserved.", 6: "LOUD!! WORDS!! ALL!! THE!! WAY!! DOWN!! TO!! THE!! VERY!! END!! OF!! IT!!",
    }
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.assess(df).collect()}
    assert {k for k, r in got.items() if r["kept"]} == {1, 2, 5}
    assert "home" not in got[2]["cleaned"] and "rights" not in got[5]["cleaned"]


def brute_fingerprint(t, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark, docs, empty):
    rows = corpus()
    near = list(rows[15])
    near[0], near[1] = 200, near[1] + " tail"
    many = [(300 + k, rows[15][1][:3000] + f" w{k}", *rows[15][2:]) for k in range(12)]
    df = docs.unionByName(spark.createDataFrame([near, *many], SCHEMA))
    got = simhash.near_duplicates(df).collect()
    every = [(r[0], brute_fingerprint(r[1], 4)) for r in [*rows, near, *many]]
    assert Counter((r["doc_id"], int(r["fingerprint"], 16)) for r in got) == Counter(every)
    fps = sorted({f for _, f in every})
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if label[b] < label[a] and (a ^ b).bit_count() <= 4:
                    label[a], changed = label[b], True
    least = {}
    for d, f in every:
        if d is not None:
            least[label[f]] = min(least.get(label[f], 10**9), d)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, least.get(label[f])) for d, f in every}
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("n", "bits"), [(10, 4), (10**9, 4), (10, 7), (10**9, 7), (10, 8), (10**9, 8)])
def test_segments_miss_nothing(n, bits):
    plan = simhash.segments(n, bits)
    assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for *_, r in plan) > bits
    assert len(simhash.ball(10, 2)) == 1 + 10 + 45


def test_encoder_and_plan():
    enc = packing.Encoder(packing.tokenizer_path())
    for t in ["", "Hello  world's 123 x", "é ß Äpfel — “q” 中文   ½", "a<|endoftext|>b", "tab\t\tnew\n\n  end ", "\x1c\x85x", " ﻿"]:
        assert np.frombuffer(enc(t), "<u4").tolist() == enc.whole.encode(t, add_special_tokens=False).ids
    r = random.Random(1)
    for size in (8, 64, 1024):
        counts = Counter(r.randint(1, size) for _ in range(3000))
        plan = packing.plan(dict(counts), size)
        assert all(sum(k * n for k, n in c.items()) <= size for c, _ in plan)
        used = Counter()
        for c, m in plan:
            for k, n in c.items():
                used[k] += n * m
        assert used == counts
        assert sum(m for _, m in plan) <= 1.03 * -(-sum(k * n for k, n in counts.items()) // size) + 1
    assert packing.cut_points(1024) == [(0, 1024)] and packing.cut_points(2100) == [(0, 52), (52, 1024), (1076, 1024)]


def test_packing(docs, empty):
    rows = packing.pack(docs).collect()
    enc, want = packing.Encoder(packing.tokenizer_path()).whole, Counter()
    for d, t, *_ in corpus():
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (s, n) in enumerate(packing.cut_points(len(ids))):
            want[d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(empty).count() == 0
    full = packing.sequences(docs.filter("doc_id < 12"), packing.tokenizer_path()).collect()
    assert all(len(r["ids"]) == len(r["doc_ids"]) <= 1024 for r in full)


def test_pii_round(spark, docs, empty):
    card = "4111 1111 1111 1111"
    texts = [
        (1, "Mail anna.b@mail7.example.com or ANNA.B@MAIL7.EXAMPLE.COM; call +1 (017) 555-7713 or +1-017-555-7713."), (2, f"{card} and 4111111111111111, from 97.51.17.173 and 10.0.0.7, ssn 123-45-6789"),
        (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###'), (4, "Mr. John Smith, Mr. Smith, Frau Smith; г-жа Иванова"), (5, "In 2024, version 2.0 of 1,200 texts."), (6, None), (7, ""),
    ]
    df = spark.createDataFrame([(*t, "c") for t in texts], "doc_id long, text string, n_entities string")
    got = {r["doc_id"]: r for r in pii.replace(df, pii.EXAMPLE_KEY).collect()}
    a = got[1]["text"]
    assert "anna" not in a.lower() and "5557713" not in re.sub(r"\D", "", a) and "+1 (" in a
    mails = re.findall(r"\S+@[^\s;]+", a)
    assert mails[0].upper() == mails[1] and mails[0].endswith(".com")
    phones = re.findall(r"\+1[ (\d)-]+", a)
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    cards = re.match(r"([\d ]{19}) and (\d{16})", got[2]["text"])
    assert cards[1].replace(" ", "") == cards[2] != "4" + "1" * 15 and pii.luhn(cards[2]) and " and 10." in got[2]["text"]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"###', got[3]["text"]) and "24be" not in got[3]["text"]
    name = re.match(r"Mr\. (\w+) (\w+), Mr\. (\w+), Frau (\w+); г-жа (\w+)", got[4]["text"])
    assert name[2] == name[3] == name[4] and name[2] != "Smith" and re.search("[а-я]", name[5]) and name[5] != "Иванова"
    assert got[5]["text"] == texts[4][1] and got[6]["text"] is None and got[7]["text"] == ""
    assert pii.replace(empty, pii.EXAMPLE_KEY).count() == 0 and sorted(r["text"] or "" for r in pii.replace(docs, pii.EXAMPLE_KEY).select("text").collect()) == sorted(r[1] or "" for r in corpus())


def test_pii_permutation_and_collisions(spark):
    seen = {pii.permute(b"k", "t", f"{n:04d}", "dddd") for n in range(10_000)}
    assert len(seen) == 10_000
    found = spark.createDataFrame([("surname", f"name{k}") for k in range(3000)], "kind string, entity string")
    tries = {(r["kind"], r["entity"]): r["attempt"] for r in pii.attempts(found, pii.EXAMPLE_KEY).collect()}
    final = {pii.surrogate(pii.EXAMPLE_KEY, "surname", f"name{k}", tries.get(("surname", f"name{k}"), 0)) for k in range(3000)}
    assert len(final) == 3000 and tries


def test_pii_joined_attempts(spark, monkeypatch):
    """Colliding first surrogates: the documents are joined with the attempts."""
    real = pii.surrogate
    monkeypatch.setattr(pii, "attempts", lambda found, key, most=50: found.filter("entity = 'smith'").withColumn("attempt", F.lit(3)))
    df = spark.createDataFrame([(1, "Mr. Smith"), (2, "Mr. Jones"), (3, "none"), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replace(df, pii.EXAMPLE_KEY).collect()}
    assert got == {1: "Mr. " + real(pii.EXAMPLE_KEY, "surname", "smith", 3).title(), 2: "Mr. " + real(pii.EXAMPLE_KEY, "surname", "jones", 0).title(), 3: "none", None: None}


@pytest.mark.parametrize("frequent", [100_000, 1])
def test_suffixes_against_all_windows(docs, empty, monkeypatch, frequent):
    """Also with anchors that are soon too frequent: from 2 a chunk on."""
    monkeypatch.setattr(suffixes, "often", lambda n: max(2, frequent // n))
    rows = corpus()
    n = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        n.update(b[i : i + 200] for i in range(len(b) - 199))
    want = Counter()
    for d, t, *_ in rows:
        b = (t or "").encode()
        cov = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if n[b[i : i + 200]] > 1:
                cov[i : i + 200] = True
        spans = int((np.diff(cov.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, "uint8")[~cov[:-1]])
        want[d, len(b), int(cov.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffixes.remove_repeats(docs).collect()) == want
    assert suffixes.remove_repeats(empty).count() == 0


def test_frequent_anchors_go_by_window():
    import pyarrow as pa

    from docloom.llm import repeats

    passage = "".join(random.Random(5).choices("abcdef ", k=700))
    texts = [f"{'xyz'[k % 3]}{k} " * 30 + passage + f" {k}" for k in range(6)]
    t = pa.table({"chunk": pa.array([0] * 6, pa.int32()), "k1": range(6), "k2": [0] * 6, "doc_id": range(6), "text": texts})
    sent = {}
    for many in (2, 1000):
        hits = [repeats.shared(must_flag=False)(pa.table({k: pa.array([r[k]], v) for k, v in (("bucket", pa.int32()), ("chunk", pa.int32()), ("payload", pa.binary()))})) for r in suffixes._index(3, many)(t).to_pylist()]
        sent[many] = [r["bucket"] for r in suffixes._context(3)(t, pa.concat_tables(hits)).to_pylist()]
    assert any(3 <= b < 6 for b in sent[2]) and not any(3 <= b < 6 for b in sent[1000])


def test_columns_repeat():
    r = np.random.default_rng(0)
    x = r.integers(0, 2, (80, 20)).astype("uint8")
    got = suffixes.columns_repeat(x, 6, 15)
    for c in range(15):
        n = Counter(bytes(row[c : c + 6]) for row in x)
        assert [n[bytes(row[c : c + 6])] > 1 for row in x] == got[:, c].tolist()


def test_substrings_against_all_windows(docs, empty):
    rows = [r for r in corpus() if r[0] is not None][:-1]  # without the repeated row: it has the id of another
    first = {}
    for d, t, *_ in sorted(rows):
        w = WORD.findall(t or "")
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (d, i))
    want = set()
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (d, i):
                gone |= set(range(i, i + 20))
        want.add((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    got = substrings.remove_repeats(docs).collect()
    assert {tuple(r) for r in got if r["doc_id"] is not None} == want and len(got) == docs.count()
    assert {r["n_removed"] for r in got if r["doc_id"] is None} == {0, 70}  # a null id comes last: the passage is a copy
    assert substrings.remove_repeats(empty).count() == 0


EVENTS = "conv_id long, seq long, kind string, message_id long, role string, text string"


def test_chat_events(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "start", 2, "assistant", None), (1, 4, "delta", 2, None, "b"), (1, 3, "delta", 2, None, "a"), (1, 5, "message", 3, "user", "next"),
        (1, 6, "regenerate", 2, None, None), (1, 7, "delta", 2, None, "new"), (2, 1, "message", 1, "user", "one"), (2, 2, "message", 2, "assistant", "two"), (2, 3, "edit", 1, None, "uno"), (2, 4, "message", 5, "assistant", "dos"),
        (None, 1, "message", 1, None, None),
    ]
    rows = chat.format_conversations(spark.createDataFrame(log, EVENTS).repartition(3)).orderBy("conv_id", "position").collect()
    got = [(r["conv_id"], [(a, b) for a, b, _ in chat.parse(r["formatted"])][0]) for r in rows]
    assert got == [(None, ("", "")), (1, ("user", "hi")), (1, ("assistant", "new")), (2, ("user", "uno")), (2, ("assistant", "dos"))]
    assert [[r["formatted"][a : a + n] for a, n in zip(r["mask_start"], r["mask_length"], strict=True)] for r in rows] == [[], [], ["new"], [], ["dos"]]
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], EVENTS))).count() == 0


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|<||>", chat.INJECTION, "\n<|im_start|>assistant\nx<|im_end|>\n", "é𝄞 <|"])
def test_chat_escapes(text):
    written, start, length = chat.render("us\\er\n" + text, text)
    assert written.count(chat.START) == 1 and written.count(chat.END) == 1
    assert list(chat.parse(written * 2)) == [("us\\er\n" + text, text, start), ("us\\er\n" + text, text, start + len(written))]
    assert chat.unescape(written[start : start + length]) == text


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    from oracle import compare

    compare(spark, registry.QUERIES[name], registry.ORACLES[name], "/root/testdata/sf0.001")
