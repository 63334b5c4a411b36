"""SimHash near-duplicates by multi-index hashing.

A text (A-Z lowered) gives the XXH64 (seed 42) of each of its word shingles, repeats counted; a bit of the
fingerprint is set if over half of the hashes have it. Texts of fewer words are one shingle; no words give 0.

Links (at most 4 differing bits) are found between distinct fingerprints only, so copies cost nothing more. The 64
bits are split into segments, each with a radius such that the sum of (radius + 1) is over 4: two fingerprints
within 4 bits must then agree within its radius in some segment. Every fingerprint is in a table under its segments'
values; it is looked up under all values in the small Hamming ball around its own, and the whole distance of each
match is verified. With more fingerprints, segments get fewer and longer so that tables stay sparse: all plans find
every link.

Dense groups of near copies have a square of links, but their components don't need them: fingerprints are first
linked to a few pivots of each table entry (the most copied, the lowest and so on, if within 4 bits), and the look-up
then only returns pairs whose components still differ.

Edge cases: a null text has no words; rows with a null id get fingerprints and components, and never name one
unless all of it are null; equal rows are linked; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, if_few, merged, table
from .components import components

SEED, BITS, SHINGLE, MAX_BITS = 42, 64, 4, 4
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        first, ends = first[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        first, ends = first[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(first.tolist(), ends.tolist(), strict=True)], "<u8")


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes, repeats included."""
    count = np.zeros(BITS, "int64")
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)].view("uint8").reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return bits_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> doc_id, fp (64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segments(n: int, max_bits: int = MAX_BITS) -> list[tuple[int, int, int]]:
    """(shift, width, radius) by how many fingerprints there are; the radii + 1 add up to more than max_bits in each plan."""
    if max_bits <= 4:
        return [(0, 23, 1), (23, 23, 1), (46, 18, 0)] if n < 30_000_000 else [(0, 36, 2), (36, 28, 1)]
    if max_bits <= 7:
        return [(0, 16, 1), (16, 16, 1), (32, 16, 1), (48, 16, 1)] if n < 5_000_000 else [(0, 22, 2), (22, 22, 2), (44, 20, 1)]
    if max_bits <= 8:
        return [(0, 19, 2), (19, 15, 1), (34, 15, 1), (49, 15, 1)] if n < 5_000_000 else [(0, 22, 2), (22, 21, 2), (43, 21, 2)]
    raise ValueError("max_bits is 8 at most")


def ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _values(fp, plan):
    return [F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width, _ in plan]


def _around(value, k: int, width: int, radius: int):
    """Keys of segment k for all values in the ball around this one."""
    return F.transform(F.array(*[F.lit(m) for m in ball(width, radius)]), lambda m: value.bitwiseXOR(m) + F.lit(k << 56))


def _near(a, b, max_bits: int):
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def _tables(fps: DataFrame, values: list) -> tuple[DataFrame, DataFrame]:
    """(fp, copies) -> key, fp of the tables; key, pivots: a few fingerprints of each table entry."""
    keys = F.array(*[v + F.lit(k << 56) for k, v in enumerate(values)])
    entries = fps.select("fp", "copies", F.explode(keys).alias("key"))
    mixed = F.xxhash64("fp")
    pivots = entries.groupBy("key").agg(F.count("*").alias("n"), F.array(F.max_by("fp", "copies"), F.min("fp"), F.max("fp"), F.min_by("fp", mixed), F.max_by("fp", mixed)).alias("pivots"))
    return entries, pivots


def _probes(values: list, plan: list[tuple[int, int, int]]):
    return F.explode(F.concat(*[_around(v, k, width, radius) for k, (v, (_, width, radius)) in enumerate(zip(values, plan, strict=True))]))


def _pairs(found: DataFrame, max_bits: int) -> DataFrame:
    """(fp, pivots) -> a, b: those within max_bits."""
    close = F.filter(F.array_distinct("pivots"), lambda p: (p != F.col("fp")) & _near(F.col("fp"), p, max_bits))
    found = found.select(F.col("fp").alias("a"), F.explode(close).alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def pivot_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, copies), distinct -> (a, b) within max_bits: each fingerprint with the pivots of the table entries in its balls.

    A few links a fingerprint however dense a group is; not all, as a table entry stands for its pivots only.
    """
    plan = segments(fps.count(), max_bits)
    values = _values(F.col("fp"), plan)
    _, pivots = _tables(fps, values)
    return _pairs(fps.select("fp", _probes(values, plan).alias("key")).join(merged(pivots), "key"), max_bits)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, copies), distinct -> (node, low): components of fingerprints within max_bits of each other, as components() gives them."""
    plan = segments(fps.count(), max_bits)
    values = _values(F.col("fp"), plan)
    entries, pivots = _tables(fps, values)
    stars = _pairs(entries.join(merged(pivots.filter("n > 1")), "key"), max_bits)
    rough = cut(components(stars.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    known = cut(fps.join(if_few(rough), fps["fp"] == rough["node"], "left").select("fp", F.coalesce("low", "fp").alias("c")))
    keys = F.array(*[v + F.lit(k << 56) for k, v in enumerate(values)])
    left = known.select(F.col("fp").alias("a"), F.col("c").alias("ca"), _probes(values, plan).alias("key"))
    right = known.select(F.col("fp").alias("b"), F.col("c").alias("cb"), F.explode(keys).alias("key"))
    found = left.join(merged(right), (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _near(F.col("a"), F.col("b"), max_bits))
    across = found.select(F.col("ca").alias("u"), F.col("cb").alias("v")).distinct()
    return components(rough.select(F.col("node").alias("u"), F.col("low").alias("v")).union(across))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text) -> doc_id, fingerprint, component_id."""
    found = cut(fingerprints(docs, shingle))
    fps = cut(found.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")))
    linked = links(fps.select("fp", "copies"), max_bits)
    low = fps.join(if_few(linked), fps["fp"] == linked["node"], "left").select("fp", "first_id", F.coalesce("low", "fp").alias("low"))
    named = low.join(merged(low.groupBy("low").agg(F.min("first_id").alias("component_id"))), "low").select("fp", "component_id")
    return found.join(merged(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
