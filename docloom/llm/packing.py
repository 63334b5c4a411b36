"""Best-fit packing with exact complements.

Texts are tokenised once; a document longer than a sequence is cut so that its first piece is the short one and all
others fill a sequence. Only how many pieces there are of each length matters for the plan, so it is made on the
driver from a histogram of at most ``size`` rows, whatever the corpus is:

1. pieces that fill a sequence stand alone;
2. an index by sum holds the single lengths and pairs of lengths in stock, and triples as a length and an indexed pair;
   the gap that a length leaves is looked up there, and as many such exact combinations are consumed as the counts
   allow: singles for all lengths first, then pairs, then triples;
3. the rest is packed best-fit decreasing, by counts of equal gaps;
4. short pieces spent on exact combinations can be missed by the rest, so this is done for a few orders (how many
   lengths a combination may have, from the longest length or the shortest), and the plan of the fewest sequences is taken.

The plan is a list of slots (length, rank from, per sequence, sequences, first sequence, offset) whose number depends
on ``size`` only. Each piece gets a rank among those of its length by (bucket, doc_id, piece, checksum) from counts
by (length, bucket); no length needs its pieces in one task. Rank and plan give sequence and offset.

Edge cases: a null text counts as empty and has the end token only; rows with equal ids are separate documents; an
empty table gives an empty one. Pieces that tie in everything are alike, so which is first doesn't matter.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, table

SIZE, END_ID = 1024, 2
#: Pieces that a bucket has about.
PER_BUCKET = 100_000

# ------------------------------------------------------------------ tokens


#: Texts of these characters, without control strings, split alike with plain classes; all others go to the tokenizer whole.
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7eÀ-ÖØ-öø-ÿ]*")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, by a byte-level BPE file of the tokenizers library.

    The pieces of a plain text are looked up in a table of pieces met before, filled from the same tokenizer. A full table
    becomes the older one, from which pieces that are met again come back; the rest goes when the next is full.
    """

    def __init__(self, path: str, keep: int = 250_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.keep, self.seen, self.older = keep, {}, {}

    def _learn(self, pieces: list[str]) -> None:
        if len(self.seen) >= self.keep:
            self.seen, self.older = {}, self.seen
        missing = {p for p in pieces if p not in self.seen}
        self.seen |= {p: self.older[p] for p in missing if p in self.older}
        new = [p for p in missing if p not in self.seen]
        for piece, found in zip(new, self.whole.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.seen[piece] = np.array(found.ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = _PIECES.findall(text)
        try:
            return b"".join([self.seen[p] for p in pieces])
        except KeyError:
            self._learn(pieces)
            return b"".join([self.seen[p] for p in pieces])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker process, so that its table outlives a task."""
    return Encoder(path)


def cut_points(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: the first may be shorter."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def tokenize(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked)."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc, k, start, length, zlib.crc32(part))
                    out.append((*row, np.frombuffer(part, "<u4").astype("int32")) if with_ids else row)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, schema)


# ------------------------------------------------------------------ plan


class Sums:
    """Lengths in stock by their sums: one, two or three that fill a gap exactly. Counts only fall, so used-up entries just go."""

    def __init__(self, counts: dict[int, int], size: int) -> None:
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.n)
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, a in enumerate(self.lengths):  # the pairs of a sum come from its largest to its smallest difference, read from the end
            for b in self.lengths[: k + 1]:
                if a + b >= size:
                    break
                self.pairs[a + b].append((a, b))
        for found in self.pairs.values():
            found.reverse()

    def has(self, lengths: tuple[int, ...], beside: int) -> bool:
        need = Counter((*lengths, beside))
        return all(self.n.get(x, 0) >= k for x, k in need.items())

    def pair(self, gap: int, beside: tuple[int, ...], most: int) -> tuple[int, int] | None:
        found = self.pairs.get(gap)
        while found and not (self.n.get(found[-1][0]) and self.n.get(found[-1][1])):
            found.pop()
        for a, b in reversed(found or ()):
            if a <= most and self.has((a, b, *beside[1:]), beside[0]):
                return a, b
        return None

    def find(self, gap: int, beside: int, many: int) -> tuple[int, ...] | None:
        """``many`` lengths of this sum, in stock beside one of ``beside``."""
        if many == 1:
            return (gap,) if self.has((gap,), beside) else None
        if many == 2:
            return self.pair(gap, (beside,), gap)
        for a in reversed(self.lengths):
            if 3 * a < gap:
                break
            if a < gap and self.n.get(a) and (found := self.pair(gap - a, (beside, a), a)):
                return (a, *found)
        return None

    def consume(self, lengths: tuple[int, ...]) -> int:
        """Takes as many of these together as there are."""
        need = Counter(lengths)
        many = min(self.n[x] // k for x, k in need.items())
        for x, k in need.items():
            self.n[x] -= k * many
            if not self.n[x]:
                del self.n[x]
        return many


#: Most lengths of a combination; whether the shortest lengths' gaps are filled first.
ORDERS = ((3, False), (3, True), (2, True), (1, False))


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: pieces in a sequence}, number of sequences) that use up all counts; of equal plans the first."""
    return min((_plan(counts, size, *order) for order in ORDERS), key=lambda p: sum(n for _, n in p))


def _plan(counts: dict[int, int], size: int, most: int, up: bool) -> list[tuple[dict[int, int], int]]:
    stock, patterns = Sums(counts, size), []
    if stock.n.get(size):
        patterns.append(({size: 1}, stock.consume((size,))))
    for many in range(1, most + 1):
        for length in stock.lengths if up else reversed(stock.lengths):
            while stock.n.get(length) and (found := stock.find(size - length, length, many)):
                patterns.append((dict(Counter((length, *found))), stock.consume((length, *found))))
    return patterns + best_fit(stock.n, size)


def best_fit(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing: open sequences with equal contents are one entry of their gap."""
    patterns: list[tuple[dict[int, int], int]] = []
    opened: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(content: dict[int, int], many: int, gap: int) -> None:
        if gap == 0:
            patterns.append((content, many))
            return
        if not opened[gap]:
            bisect.insort(gaps, gap)
        opened[gap].append((content, many))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                content, many = opened[gap].pop()
                if not opened[gap]:
                    gaps.pop(k)
                n = min(left, many)
                if many > n:
                    put(content, many - n, gap)
                put({**content, length: content.get(length, 0) + 1}, n, gap - length)
                left -= n
                continue
            fit = size // length
            if left >= fit:
                put({length: fit}, left // fit, size - fit * length)
                left %= fit
            else:
                put({length: left}, 1, size - left * length)
                left = 0
    return patterns + [x for gap in gaps for x in opened[gap]]


def slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, pieces, first sequence, offset), sorted by length and rank."""
    rank, sequence, out = defaultdict(int), 0, []
    for content, many in patterns:
        offset = 0
        for length in sorted(content, reverse=True):
            k = content[length]
            out.append((length, rank[length], k, k * many, sequence, offset))
            rank[length] += k * many
            offset += k * length
        sequence += many
    return np.array(sorted(out), "int64").reshape(-1, 6)


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, length, ids_crc32, ...) -> plus sequence_id and offset."""
    pieces = cut(pieces)
    spark = pieces.sparkSession
    n = pieces.count()
    buckets = max(shuffle_partitions(spark), n // PER_BUCKET)
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    pieces = pieces.withColumn("bucket", key)
    counts = cut(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    plan_rows = slots(plan(by_length, size))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).select("length", "bucket", "before")
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within")).drop("bucket", "before", "within")
    ahead = plan_rows[:, 0] * (1 << 44) + plan_rows[:, 1] if len(plan_rows) else np.zeros(0, "int64")

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy("int64"), rank.to_numpy("int64")
        at = plan_rows[np.searchsorted(ahead, length * (1 << 44) + rank, "right") - 1]
        k = rank - at[:, 1]
        return pd.DataFrame({"sequence_id": at[:, 4] + k // at[:, 2], "offset": at[:, 5] + (k % at[:, 2]) * length})

    return ranked.withColumn("place", look_up("length", "rank")).select(*[c for c in ranked.columns if c != "rank"], "place.sequence_id", "place.offset")


def sequences(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The packed corpus: sequence_id, ids and the ids' document numbers, one row a sequence."""
    placed = place(tokenize(docs, path, size, end_id, with_ids=True), size)
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.flatten(F.transform("p", lambda x: F.array_repeat(x["doc_id"], F.size(x["ids"])))).alias("doc_ids"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) -> a row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; other columns are not looked at."""
    placed = place(tokenize(docs, path or tokenizer_path()))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
