"""Exact repeats of word windows by fixed-block anchors.

A window of 20 words holds a whole 10-word block of its own document's grid (blocks start at every tenth word). So:

1. every document's non-overlapping blocks are the index, and every rolling 10-word window probes it: both go, as
   packed hashes, to buckets, which answer with the hashes that are a block somewhere and were met twice, in one chunk
   or in several;
2. each hit is extended by up to 10 words on both sides: the 20-word windows around hits, and only those, are compared
   by (doc_id, start), first within the chunk; one of each goes to the buckets with the smallest (doc_id, start) of the
   chunk and its place there, and the bucket tells the places that aren't the first in all;
3. words under windows that are not the first are removed, so hits grow to whole maximal repeats.

Windows are compared by two hashes of 64 and 32 bits. Copies of a whole text are found by its SHA-256 before, and only
its smallest id is searched.

Edge cases: a null text has no words; rows with equal id and text are one document; a null id comes after all others;
texts of under 20 words lose nothing; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .common import table

WINDOW, BLOCK = 20, 10
U = np.uint64
_BYTES, _FIRST, _SECOND = R.Powers(0x9E3779B97F4A7C15), R.Powers(0xD1342543DE82EF95), R.Powers(0xA0761D6478BD642F)


class Words:
    """The words of some texts in a row: hashes, the text each is in, and its place there."""

    def __init__(self, texts: list[bytes]) -> None:
        self.words = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in self.words], "int64")
        blob = np.frombuffer(b" ".join([b" ".join(w) for w in self.words if w]), "uint8")
        ends = np.append(np.flatnonzero(blob == 32), len(blob)) if len(blob) else np.zeros(0, "int64")
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        values = _BYTES.slices(blob.astype("uint64") + U(1), starts, ends) if len(ends) else np.zeros(0, "uint64")
        self.hash = R.mix(values + (ends - starts).astype("uint64"))
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.base = np.cumsum(self.counts) - self.counts
        self.at = np.arange(len(ends)) - self.base[self.text] if len(ends) else np.zeros(0, "int64")

    def windows(self, n: int) -> np.ndarray:
        """Words at which a window of n words of one text starts."""
        return np.flatnonzero(self.at + n <= self.counts[self.text])

    def hashes(self, starts: np.ndarray, n: int, powers: R.Powers = _FIRST) -> np.ndarray:
        return powers.slices(self.hash, starts, starts + n)


def _index(n: int):
    def step(t: pa.Table) -> pa.Table:
        chunk, c = t.column("chunk")[0].as_py(), R.Chunk(t)
        hashes, blocks = [], []
        for a, b in R.steps([len(x) for x in c.texts]):
            w = Words(c.texts[a:b])
            starts = w.windows(BLOCK)
            hashes.append(w.hashes(starts, BLOCK))
            blocks.append(w.at[starts] % BLOCK == 0)
        rows = R.packed(np.concatenate(hashes), np.concatenate(blocks), n) if hashes else []
        return R.rows_of(["bucket", "chunk", "payload"], [(b, chunk, p) for b, p in rows])

    return step


#: A window: its hashes, where it is, and the place of its first word among all words of its chunk.
_OCCURRENCE = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<i8"), ("at", "<u4"), ("place", "<i8")])


def _firsts(x: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by hash and then (doc, at, more), and which entries of it are the first of their hash."""
    by = np.lexsort((more, x["at"], x["doc"], x["g"], x["h"]))
    same = (x["h"][by][1:] == x["h"][by][:-1]) & (x["g"][by][1:] == x["g"][by][:-1])
    return by, np.concatenate([[True], ~same]) if len(by) else np.zeros(0, bool)


def _extend(n: int):
    """For a chunk: one of each window around a hit to its bucket; the places of those that aren't the chunk's first, to be kept for it, to bucket n + chunk."""

    def step(t: pa.Table, hits: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if not len(t) or not len(hits):
            return R.rows_of(["bucket", "chunk", "payload"], out)
        chunk, c, known, found, done = t.column("chunk")[0].as_py(), R.Chunk(t), R.hit_places(hits)[0], [], 0
        for a, b in R.steps([len(x) for x in c.texts]):
            w = Words(c.texts[a:b])
            starts = w.windows(BLOCK)
            hit = starts[R.among(R.place(w.hashes(starts, BLOCK), n), known)]
            near = np.zeros(len(w.hash) + 1, "int32")  # windows that start up to 10 words before a hit
            np.add.at(near, np.maximum(hit - (WINDOW - BLOCK), 0), 1)
            np.add.at(near, hit + 1, -1)
            starts = w.windows(WINDOW)
            starts = starts[np.cumsum(near)[starts] > 0]
            x = np.zeros(len(starts), _OCCURRENCE)
            x["h"], x["g"] = w.hashes(starts, WINDOW), w.hashes(starts, WINDOW, _SECOND) & U(0xFFFFFFFF)
            x["doc"], x["at"], x["place"] = c.ids[a:b][w.text[starts]], w.at[starts], done + starts
            found.append(x)
            done += len(w.hash)
        x = np.concatenate(found)
        by, first = _firsts(x, x["place"])
        late = np.sort(x["place"][by[~first]])
        if len(late):
            out.append((n + chunk, chunk, late.tobytes()))
        x = x[by[first]]
        bucket = (x["h"] % U(n)).astype("int64")
        x = x[np.argsort(bucket, kind="stable")]
        bucket = np.sort(bucket)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for b, p in zip(np.split(bucket, cuts), np.split(x, cuts), strict=True):
            if len(b):
                out.append((int(b[0]), chunk, b"".join(np.ascontiguousarray(p[f]).tobytes() for f in _OCCURRENCE.names)))
        return R.rows_of(["bucket", "chunk", "payload"], out)

    return step


def _unpack(p: bytes) -> np.ndarray:
    n = len(p) // _OCCURRENCE.itemsize
    x, at = np.zeros(n, _OCCURRENCE), 0
    for f in _OCCURRENCE.names:
        size = _OCCURRENCE[f].itemsize
        x[f] = np.frombuffer(p, _OCCURRENCE[f], n, at)
        at += n * size
    return x


def _not_first(n: int):
    """For a bucket: to each chunk, the places of windows whose first occurrence is in another chunk."""

    def step(t: pa.Table) -> pa.Table:
        chunks, bucket = t.column("chunk").to_pylist(), t.column("bucket")[0].as_py()
        if bucket >= n:
            return t.select(["chunk", "bucket", "payload"])
        parts = [_unpack(p) for p in t.column("payload").to_pylist()]
        x, owner = np.concatenate(parts), np.repeat(np.array(chunks), [len(p) for p in parts])
        by, first = _firsts(x, owner)
        late = by[~first]
        out = [(c, bucket, np.sort(x["place"][mine]).tobytes()) for c in chunks if len(mine := late[owner[late] == c])]
        return R.rows_of(["chunk", "bucket", "payload"], out)

    return step


def _remove(t: pa.Table, late: pa.Table) -> pa.Table:
    names = ["k1", "k2", "first_id", "n_words", "n_removed", "kept_sha256"]
    kinds = [pa.int64()] * 5 + [pa.string()]
    rows, done = [], 0
    if len(t):
        c = R.Chunk(t)
        gone = np.sort(np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(p, "<i8") for p in late.column("payload").to_pylist())]))
        for key, doc_id, text in zip(c.keys, c.ids.tolist(), c.texts, strict=True):
            words = text.split()
            a, b = np.searchsorted(gone, [done, done + len(words)])
            kept = words
            if b > a:
                edge = np.zeros(len(words) + 1, "int32")
                np.add.at(edge, gone[a:b] - done, 1)
                np.add.at(edge, gone[a:b] - done + WINDOW, -1)
                kept = [w for w, covered in zip(words, (np.cumsum(edge)[:-1] > 0).tolist(), strict=True) if not covered]
            done += len(words)
            rows.append((*key, None if doc_id == R.NO_ID else doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256."""
    texts, n = R.chunked(docs)
    hits = R.by_bucket(texts.groupBy("chunk").applyInArrow(_index(n), R.BUCKETED), n, R.shared(must_flag=True))
    late = R.by_bucket(R.with_texts(texts, hits, _extend(n), R.BUCKETED), n, _not_first(n))
    done = R.with_texts(texts, late, _remove, "k1 long, k2 long, first_id long, n_words long, n_removed long, kept_sha256 string")
    every = R.members(docs, done)
    copy = ~F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("n_words") >= WINDOW)
    nothing = hashlib.sha256(b"").hexdigest()
    return every.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def op10_substrings(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER b AS gram, count(*) OVER b AS n FROM w
      WINDOW b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY gram, n ORDER BY doc_id, i) > 1 AS late FROM g),
c AS (SELECT doc_id, i, word, max(late::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT doc_id, count(*)::BIGINT AS n_words, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
