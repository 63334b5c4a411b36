"""What finding repeated text needs: texts in chunks, rolling hashes, and a packed exchange by hash.

Texts are dealt out once, by a hash of the text, to as many chunks as the session has shuffle partitions, or more if a
chunk would be larger than 64 MB of the input's files, so that copies meet in one chunk; a map task sends each distinct text once, so a text with very many copies costs a task no
more than one a task. All later steps are grouped by chunk on that same exchange. A chunk's texts are sorted by
their keys, hence positions in it are the same each time it is computed, after a lost executor too.

Hashes of a chunk go to buckets as sorted arrays without repeats, four bytes a hash, so a frequent hash costs a
bucket no more than one entry a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

U = np.uint64
#: Bytes that are hashed at a time.
STEP = 1 << 18
#: Sorts after every id; the place of a null id.
NO_ID = np.iinfo("int64").max


def text_keys(text: Column) -> tuple[Column, Column]:
    """The first 120 bits of a text's SHA-256, as two longs."""
    digest = F.sha2(text, 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.conv(F.substring(digest, 16, 15), 16, 10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, k1, k2 (120 bits that stand for the text), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k1, k2 = text_keys(text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))


#: Bytes of input files for a chunk; texts take about twice that in memory.
PER_CHUNK = 64 << 20


def chunk_count(docs: DataFrame) -> int:
    """From the session's shuffle partitions and Catalyst's estimate of the input, where it has one (huge numbers stand for none)."""
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_partitions(docs.sparkSession), -(-estimate // PER_CHUNK) if estimate < 1 << 55 else 1)


def chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """(chunk, k1, k2, doc_id, text): each text once for each task that met it; more rows without text where a smaller id came later."""
    n = chunk_count(docs)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple, int] = {}
        for b in batches:
            k1, k2, ids = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(0).to_pylist()
            keep, bare = [], []
            for i, (a, c, d) in enumerate(zip(k1, k2, ids, strict=True)):
                d = NO_ID if d is None else d
                had = least.get((a, c))
                if had is None or d < had:
                    least[a, c] = d
                    keep.append(i)
                    bare.append(had is not None)
            part = b.take(pa.array(keep, pa.int64()))
            text = pc.if_else(pa.array(bare, pa.bool_()), pa.scalar(None, part.column(3).type), part.column(3)) if any(bare) else part.column(3)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), text], ["doc_id", "k1", "k2", "text"])

    rows = keyed(docs).mapInArrow(once, "doc_id long, k1 long, k2 long, text string")
    return rows.select(F.pmod("k1", F.lit(n)).cast("int").alias("chunk"), "k1", "k2", "doc_id", "text").repartition(n, "chunk"), n


class Chunk:
    """A chunk's distinct texts in key order: keys, smallest ids, texts as bytes."""

    def __init__(self, t: pa.Table) -> None:
        found: dict[tuple, list] = {}
        keys = zip(*(t.column(c).to_pylist() for c in ("k1", "k2", "doc_id")), strict=True)
        texts = t.column("text").cast(pa.binary())
        for i, (k1, k2, d) in enumerate(keys):
            have = found.setdefault((k1, k2), [NO_ID, b""])
            have[0] = min(have[0], NO_ID if d is None else d)
            if not have[1]:
                have[1] = texts[i].as_py() or b""
        self.keys = sorted(found)
        self.ids = np.array([found[k][0] for k in self.keys], "int64")
        self.texts = [found[k][1] for k in self.keys]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Hashes of slices of a sequence from running sums of value * base**place, all modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, "uint64")

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, "uint64")
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype="uint64"))

    def slices(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, "uint64")
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts])


def steps(sizes: list[int], most: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text is a range of its own."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


BUCKETED = "bucket int, chunk int, payload binary"
TO_CHUNK = "chunk int, bucket int, payload binary"


def rows_of(names: list[str], rows: list[tuple]) -> pa.Table:
    kinds = {"payload": pa.binary()}
    return pa.table({n: pa.array([r[k] for r in rows], kinds.get(n, pa.int32())) for k, n in enumerate(names)})


def packed(hashes: np.ndarray, flags: np.ndarray, buckets: int, many: int | None = None) -> list[tuple[int, bytes]]:
    """(bucket, sorted 30-bit rests of its hashes, each once, with two flag bits): bit 0: met twice or more; bit 1: flags, or met ``many`` times."""
    places = place(hashes, buckets)
    by = np.argsort(places, kind="stable")
    places, flags = places[by], flags[by]
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])) if len(places) else np.zeros(0, "int64")
    twice = np.diff(np.append(first, len(places))) > 1
    flagged = np.maximum.reduceat(flags.astype("uint8"), first) if len(first) else np.zeros(0, "uint8")
    if many is not None:
        flagged = flagged | (np.diff(np.append(first, len(places))) >= many)
    places = places[first]
    value = ((places & U((1 << 30) - 1)) << U(2) | flagged.astype("uint64") << U(1) | twice.astype("uint64")).astype("<u4")
    bucket = (places >> U(30)).astype("int64")
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return [(int(b[0]), v.tobytes()) for b, v in zip(np.split(bucket, cuts), np.split(value, cuts), strict=True) if len(b)]


def place(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and rest of a hash in one number."""
    return hashes % U(buckets) << U(30) | (hashes // U(buckets)) & U((1 << 30) - 1)


def shared(must_flag: bool):
    """For a bucket: to each chunk, those of its hashes that were met twice or more in all (and are flagged somewhere), with the flag."""

    def step(t: pa.Table) -> pa.Table:
        chunks, bucket = t.column("chunk").to_pylist(), t.column("bucket")[0].as_py()
        parts = [np.frombuffer(p, "<u4") for p in t.column("payload").to_pylist()]
        every = np.sort(np.concatenate(parts))
        value = every >> np.uint32(2)
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        seen = np.add.reduceat((1 + (every & np.uint32(1))).astype("int64"), first)
        flagged = np.maximum.reduceat((every >> np.uint32(1) & np.uint32(1)).astype("uint8"), first)
        hit = (seen > 1) & (flagged > 0) if must_flag else seen > 1
        hits, flags, out = value[first][hit], flagged[hit], []
        for c, p in zip(chunks, parts, strict=True):
            own = p >> np.uint32(2)
            known = among(own, hits)
            if known.any():
                own = own[known]
                out.append((c, bucket, (own << np.uint32(1) | flags[np.searchsorted(hits, own)]).astype("<u4").tobytes()))
        return rows_of(["chunk", "bucket", "payload"], out)

    return step


def hit_places(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All hits of a chunk, as place() gives them, sorted; which of them are flagged."""
    places, flags = [np.zeros(0, "uint64")], [np.zeros(0, bool)]
    for b, p in zip(t.column("bucket").to_pylist(), t.column("payload").to_pylist(), strict=True):
        v = np.frombuffer(p, "<u4")
        places.append(U(b) << U(30) | (v >> np.uint32(1)).astype("uint64"))
        flags.append((v & np.uint32(1)) > 0)
    places, flags = np.concatenate(places), np.concatenate(flags)
    by = np.argsort(places)
    return places[by], flags[by]


def among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def by_bucket(df: DataFrame, n: int, verdict: Callable) -> DataFrame:
    """Rows for buckets -> rows for chunks."""
    return df.repartition(n, "bucket").groupBy("bucket").applyInArrow(verdict, TO_CHUNK).repartition(n, "chunk")


def with_texts(texts: DataFrame, more: DataFrame, step: Callable, schema: str) -> DataFrame:
    return texts.groupBy("chunk").cogroup(more.groupBy("chunk")).applyInArrow(step, schema)


def members(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Each document beside its text's row: doc_id, copies (rows with that text), and the columns of ``texts``."""
    who = keyed(docs).drop("text")
    copies = who.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    texts = texts.join(copies, ["k1", "k2"])
    return who.join(texts, ["k1", "k2"])
