"""Exact repeats of 200 bytes by column-wise suffix sorting of many aligned strings.

Sorting all suffixes of a corpus by inserting one symbol of every document a round takes as many rounds as the longest
document has bytes, each over everything built so far. Here the strings are first lined up, so that rounds are few:

1. Each 200-byte window names an anchor: the place in it where the hash of 32 bytes is lowest, leftmost on ties. Equal
   windows name the same place, so only anchors whose hash was met twice in the corpus matter. Hashes go to buckets
   packed, and the buckets answer with those.
2. For each such anchor the 168 bytes before it and the 200 from it on, a string of 368 bytes, go to the bucket of its
   hash; a string equal to an earlier one of its chunk is settled there and stays.
3. A bucket takes its strings as one collection and builds the order of their suffixes column by column, from the last
   to the first: each round inserts one symbol for each string. A stable sort of that column's symbols (the column of
   the Burrows-Wheeler transform) gives the new order from the last, and the common prefix of neighbours with equal
   symbols is one more than the least between them before. A window in column c repeats where a neighbour's common
   prefix is 200 or more. The state of a round is the order and the prefix lengths only, and columns are read in
   sequence, so they may as well be files.
4. Spans of repeating windows go back to the chunks, which cut the bytes out.

An anchor that a chunk has very often (at the edge of a passage that a large share of all documents have) would bring
too many different strings to one bucket. The buckets of step 1 name such anchors to all chunks, and their windows are
compared one by one instead: 128-bit hashes, each once a chunk, spread over all buckets. So a bucket's memory stays
bounded, and the result is the same.

Equal windows have the same place in the string about their anchors, so comparing suffixes of one column is enough; as
every place of a text is in a column of one anchor once, no window is compared with itself. Copies of a whole text are
found by its key before and are searched once.

Edge cases: a null text is empty; texts of under 200 bytes lose nothing; equal rows are copies of each other and are
removed if long enough; an empty table gives an empty one; ids may be null or repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .common import table

LENGTH, GRAM = 200, 32
BEFORE = LENGTH - GRAM  # bytes before an anchor that a window with it may have
WIDTH = BEFORE + LENGTH
NOTHING = 0xFF  # never a byte of UTF-8
U = np.uint64
_ROLL = R.Powers(0x9E3779B97F4A7C15)
_STRINGS = R.Powers(0xD1342543DE82EF95)
_STRINGS_TOO = R.Powers(0xA0761D6478BD642F)
_LOW = (1 << 24) - 1
#: Strings of one anchor that a bucket takes about, before its windows go one by one.
PER_ANCHOR = 100_000


def often(n: int) -> int:
    """How many times a chunk of n has an anchor that counts as very frequent."""
    return max(8, PER_ANCHOR // n)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts end to end: their bytes; each anchor's place, hash, and the start and end of its text."""
    sizes = np.array([len(t) for t in texts], "int64")
    blob = np.frombuffer(b"".join(texts), "uint8")
    end = np.cumsum(sizes)
    if len(blob) < LENGTH:
        none = np.zeros(0, "int64")
        return blob, none, np.zeros(0, "uint64"), none, none
    at = np.arange(len(blob) - GRAM + 1)
    hashes = _ROLL.slices(blob.astype("uint64") + U(1), at, at + GRAM)
    places, start = [], 0
    while start + LENGTH <= len(blob):  # parts in which a place has 24 bits; only a text longer than that has several
        part = hashes[start : start + _LOW]
        low = part & ~U(_LOW) | np.arange(len(part), dtype="uint64")
        n = 1
        while 2 * n <= BEFORE + 1:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        rest = BEFORE + 1 - n
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        window = np.arange(len(low)) + start
        owner = np.searchsorted(end, window, "right")
        place = (low & U(_LOW)).astype("int64")[window + LENGTH <= end[owner]] + start
        places.append(place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place)
        start += max(len(low), 1)
    place = np.unique(np.concatenate(places))
    owner = np.searchsorted(end, place, "right")
    return blob, place, hashes[place], (end - sizes)[owner], end[owner]


def _index(n: int, many: int):
    def step(t: pa.Table) -> pa.Table:
        chunk, c = t.column("chunk")[0].as_py(), R.Chunk(t)
        found = [anchors(c.texts[a:b])[2] for a, b in R.steps([len(x) for x in c.texts])]
        h = np.concatenate(found) if found else np.zeros(0, "uint64")
        return R.rows_of(["bucket", "chunk", "payload"], [(b, chunk, p) for b, p in R.packed(h, np.zeros(len(h), bool), n, many)])

    return step


#: A string's place in its chunk, and how many of its columns before the anchor and from it on are of its text.
_HEAD = np.dtype([("at", "<i8"), ("before", "<u2"), ("after", "<u2")])


def _context(n: int):
    def step(t: pa.Table, hits: pa.Table) -> pa.Table:
        names, out = ["bucket", "chunk", "payload"], []
        if not len(t) or not len(hits):
            return R.rows_of(names, out)
        chunk, c, (known, frequent) = t.column("chunk")[0].as_py(), R.Chunk(t), R.hit_places(hits)
        heads, strings, buckets, keys, single, done = [], [], [], [], [], 0
        for a, b in R.steps([len(x) for x in c.texts]):
            blob, place, h, first, last = anchors(c.texts[a:b])
            mine = np.flatnonzero(R.among(R.place(h, n), known))
            apart = frequent[np.searchsorted(known, R.place(h[mine], n))]
            if apart.any():
                single.append(_windows(blob, place[mine[apart]], first[mine[apart]], last[mine[apart]], done))
            mine = mine[~apart]
            if len(mine):
                place, h, first, last = place[mine], h[mine], first[mine], last[mine]
                padded = np.concatenate([np.full(BEFORE, NOTHING, "uint8"), blob, np.full(LENGTH, NOTHING, "uint8")])
                x = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[place].copy()
                head = np.zeros(len(place), _HEAD)
                head["at"], head["before"], head["after"] = done + place, np.minimum(place - first, BEFORE), np.minimum(last - place, LENGTH)
                column = np.arange(WIDTH)[None]
                x[(column < BEFORE - head["before"].astype("int64")[:, None]) | (column >= BEFORE + head["after"].astype("int64")[:, None])] = NOTHING
                starts = np.arange(len(x)) * WIDTH
                flat = x.reshape(-1).astype("uint64") + U(1)
                keys.append((_STRINGS.slices(flat, starts, starts + WIDTH), _STRINGS_TOO.slices(flat, starts, starts + WIDTH)))
                heads.append(head)
                strings.append(x)
                buckets.append((h % U(n)).astype("int64"))
            done += len(blob)
        del c
        if single:
            out += _send_windows(np.concatenate(single), n, chunk)
        if not heads:
            return R.rows_of(names, out)
        head, x, bucket = np.concatenate(heads), np.concatenate(strings), np.concatenate(buckets)
        strings.clear()
        k1, k2 = (np.concatenate([k[i] for k in keys]) for i in range(2))
        by = np.lexsort((k2, k1))
        new = np.concatenate([[True], (k1[by][1:] != k1[by][:-1]) | (k2[by][1:] != k2[by][:-1])])
        many = np.diff(np.append(np.flatnonzero(new), len(by))) > 1
        again = np.zeros(len(by), bool)
        again[by] = many[np.cumsum(new) - 1]
        # All windows of strings that the chunk has twice repeat: their spans pass through a bucket of their own.
        from_, to = head["at"] - head["before"], head["at"] + head["after"]
        whole = again & (to - from_ >= LENGTH)
        if whole.any():
            out.append((2 * n + chunk, chunk, np.stack([from_[whole], to[whole]], 1).astype("<i8").tobytes()))
        one = np.sort(by[new])
        one = one[np.argsort(bucket[one], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[one])) + 1
        for p in np.split(one, cuts):
            out.append((int(bucket[p[0]]), chunk, head[p].tobytes() + x[p].tobytes()))
        del x
        return R.rows_of(names, out)

    return step


_WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("at", "<i8")])


def _windows(blob: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, done: int) -> np.ndarray:
    """All windows of one text around these anchors, by two hashes."""
    start = place[:, None] - np.arange(BEFORE + 1)[None]
    start = np.unique(start[(start >= first[:, None]) & (start + LENGTH <= last[:, None])])
    x = np.zeros(len(start), _WINDOW)
    values = blob.astype("uint64") + U(1)
    x["h"], x["g"], x["at"] = _STRINGS.slices(values, start, start + LENGTH), _STRINGS_TOO.slices(values, start, start + LENGTH), start + done
    return x


def _send_windows(x: np.ndarray, n: int, chunk: int) -> list[tuple]:
    """Windows that the chunk has twice are settled; one of each goes to the bucket of its hash, from n on."""
    x = x[np.lexsort((x["g"], x["h"]))]
    first = np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["g"][1:] != x["g"][:-1])]) if len(x) else np.zeros(0, bool)
    twice = ~first | np.append(~first[1:], False) if len(x) else first
    at = np.sort(x["at"][twice])
    out = [(2 * n + chunk, chunk, np.stack([at, at + LENGTH], 1).astype("<i8").tobytes())] if len(at) else []
    x = x[first]
    bucket = (x["h"] % U(n)).astype("int64")
    by = np.argsort(bucket, kind="stable")
    for p in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
        if len(p):
            out.append((n + int(bucket[p[0]]), chunk, x[p].tobytes()))
    return out


def _settle_windows(chunks: list[int], bucket: int, payload: list[bytes]) -> list[tuple]:
    x = np.concatenate([np.frombuffer(p, _WINDOW) for p in payload])
    owner = np.repeat(np.array(chunks), [len(p) // _WINDOW.itemsize for p in payload])
    by = np.lexsort((x["g"], x["h"]))
    same = (x["h"][by][1:] == x["h"][by][:-1]) & (x["g"][by][1:] == x["g"][by][:-1])
    hit = np.zeros(len(x), bool)
    hit[by] = np.append(same, False) | np.concatenate([[False], same])
    out = []
    for c in dict.fromkeys(chunks):
        at = np.sort(x["at"][hit & (owner == c)])
        if len(at):
            out.append((c, bucket, np.stack([at, at + LENGTH], 1).astype("<i8").tobytes()))
    return out


def columns_repeat(x: np.ndarray, length: int, last: int) -> np.ndarray:
    """For equally long strings x: whether the ``length`` symbols from each of the first ``last`` columns also start there in another string."""
    m, width = x.shape
    order, common = np.arange(m), np.zeros(m, "int64")
    found = np.zeros((m, last), bool)
    columns = np.ascontiguousarray(x.T)
    for c in range(width - 1, -1, -1):
        symbol = columns[c][order]
        by = np.argsort(symbol, kind="stable")
        sorted_symbol = symbol[by]
        new = np.zeros(m, "int64")
        cuts = np.concatenate([[0], np.flatnonzero(sorted_symbol[1:] != sorted_symbol[:-1]) + 1, [m]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                starts = by[a:b] + 1
                if starts[-1] == m:
                    new[a + 1 : b] = np.minimum.reduceat(common, starts[:-1]) + 1
                else:
                    new[a + 1 : b] = np.minimum.reduceat(common, starts)[:-1] + 1
        order, common = order[by], new
        if c < last:
            hit = common >= length
            hit[:-1] |= common[1:] >= length
            found[order[hit], c] = True
    return found


def _settle(chunks: list[int], bucket: int, payload: list[bytes]) -> list[tuple]:
    size = _HEAD.itemsize + WIDTH
    counts = [len(p) // size for p in payload]
    head = np.concatenate([np.frombuffer(p, _HEAD, k) for p, k in zip(payload, counts, strict=True)])
    x = np.concatenate([np.frombuffer(p, "uint8", k * WIDTH, k * _HEAD.itemsize).reshape(k, WIDTH) for p, k in zip(payload, counts, strict=True)])
    found = columns_repeat(x, LENGTH, BEFORE + 1)
    column = np.arange(BEFORE + 1)[None]
    found &= (column >= BEFORE - head["before"].astype("int64")[:, None]) & (column + LENGTH <= BEFORE + head["after"].astype("int64")[:, None])
    out, row = [], 0
    for c, k in zip(chunks, counts, strict=True):
        f = np.pad(found[row : row + k], ((0, 0), (1, 1))).astype("int8")
        step = np.diff(f, axis=1)
        r, start = np.nonzero(step == 1)
        _, stop = np.nonzero(step == -1)
        at = head["at"][row : row + k][r] - BEFORE
        if len(r):
            out.append((c, bucket, np.stack([at + start, at + stop - 1 + LENGTH], 1).astype("<i8").tobytes()))
        row += k
    return out


def _bucket(n: int):
    """For a bucket: to each chunk, the spans (start, end) of its bytes that repeat."""

    def step(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        if bucket >= 2 * n:
            return t.select(["chunk", "bucket", "payload"])
        settle = _settle if bucket < n else _settle_windows
        return R.rows_of(["chunk", "bucket", "payload"], settle(t.column("chunk").to_pylist(), bucket, t.column("payload").to_pylist()))

    return step


def _remove(t: pa.Table, spans: pa.Table) -> pa.Table:
    names, kinds = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 5 + [pa.string()]
    rows = []
    if len(t):
        c = R.Chunk(t)
        parts = [np.frombuffer(p, "<i8").reshape(-1, 2) for p in spans.column("payload").to_pylist()]
        s = np.concatenate(parts) if parts else np.zeros((0, 2), "int64")
        s = s[np.argsort(s[:, 0], kind="stable")]
        done = 0
        for key, text in zip(c.keys, c.texts, strict=True):
            a, b = np.searchsorted(s[:, 0], [done, done + len(text)])
            own = s[a:b] - done
            done += len(text)
            if not len(own):
                rows.append((*key, len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                continue
            reach = np.maximum.accumulate(own[:, 1])
            first = np.flatnonzero(np.concatenate([[True], own[1:, 0] > reach[:-1]]))
            starts, ends = own[first, 0].tolist(), reach[np.append(first[1:] - 1, len(own) - 1)].tolist()
            digest, last = hashlib.sha256(), 0
            for x, y in zip(starts, ends, strict=True):
                digest.update(text[last:x])
                last = y
            digest.update(text[last:])
            rows.append((*key, len(text), sum(ends) - sum(starts), len(starts), digest.hexdigest()))
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts, n = R.chunked(docs)
    hits = R.by_bucket(texts.groupBy("chunk").applyInArrow(_index(n, often(n)), R.BUCKETED), n, R.shared(must_flag=False))
    spans = R.by_bucket(R.with_texts(texts, hits, _context(n), R.BUCKETED), n, _bucket(n))
    done = R.with_texts(texts, spans, _remove, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    every = R.members(docs, done)
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    nothing = hashlib.sha256(b"").hexdigest()
    return every.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(copy, nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def op8_suffixes(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
