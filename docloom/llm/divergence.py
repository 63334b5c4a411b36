"""How the sources of a language differ: exact divergences of term frequencies, from mergeable radix tries.

1. A task counts the terms of its documents in one byte trie a language; a leaf has the documents with the term and a
   counter for each source. The root's leaf has every source that occurs, with or without terms. A trie that is full
   leaves as rows in byte order, so memory is bounded.
2. The rows are dealt by ranges of (language, term), which are ranges of prefixes: each range's partial tries come
   together in sorted order, are merged into one trie of bounded size at a time, and walked in UTF-8 order. Terms in
   too few documents go.
3. The walk's rows meet the totals of sources. Sources are dealt to blocks of about ``BLOCK`` by hash, and a task takes
   the sources of a pair of blocks and a share of the terms, in UTF-8 order: it adds up each pair's divergence, and keeps
   for each source the terms of the largest values, of equal ones the first. Shares are added up, and ranks given.

A group's frequency of a term is p = 1 + floor(1e9 (n + 2) / (N + 2 V)), n the term's occurrences there, N those of all
V kept terms; the divergence of p and q is floor((p - q)^2 / (p + q)). All of it is in integers.

Edge cases: null texts, languages and sources count as empty strings, which are values like others; repeated rows are
documents each; a language without kept terms gives pairs of value 0; one with a single source gives no pairs; very long
texts are split at ends of terms while counting; an empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, if_few, shuffle_partitions, table, written

#: Documents a kept term is in at least; terms listed a source; parts of one in the frequencies.
MIN_DOCS, TOP, WHOLE = 10, 10, 10**9
#: Leaves of a trie, bytes counted at once, sources of a block, terms of a task (about).
LEAVES, SLICE, BLOCK, TERMS = 300_000, 1 << 20, 128, 10_000
#: Terms are runs of ASCII letters, which become small, and of bytes of other code points.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class RadixTrie:
    """Byte strings, each with a leaf's number from 0; edges have one or more bytes, those of the root ``ROOT`` where terms have so many."""

    ROOT = 3

    class Node:
        __slots__ = ("children", "leaf", "edge")

        def __init__(self, edge: bytes, children: dict | None = None, leaf: int = -1) -> None:
            self.edge, self.children, self.leaf = edge, children, leaf

    def __init__(self) -> None:
        self.root, self.size = self.Node(b"", {}), 0

    def leaf(self, term: bytes) -> int:
        """The number of a term's leaf, made if it isn't there."""
        top, n = term[: self.ROOT], len(term)
        node, at = self.root.children.get(top), len(top)
        if node is None:
            node = self.root.children[top] = self.Node(top)
        while at < n:
            first = term[at]
            children = node.children
            if children is None:
                children = node.children = {}
            child = children.get(first)
            if child is None:
                children[first] = self.Node(term[at:], None, self.size)
                self.size += 1
                return self.size - 1
            edge = child.edge
            if len(edge) > 1 and not term.startswith(edge, at):
                same = 1
                while same < n - at and term[at + same] == edge[same]:  # they differ before the edge ends
                    same += 1
                child.edge = edge[same:]
                child = children[first] = self.Node(edge[:same], {edge[same]: child})
                edge = child.edge
            node, at = child, at + len(edge)
        if node.leaf < 0:
            node.leaf = self.size
            self.size += 1
        return node.leaf

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """All terms with their leaves in byte order, which is UTF-8's order of code points."""
        stack = [(b"", self.root)]
        while stack:
            before, node = stack.pop()
            term = before + node.edge
            if node.leaf >= 0:
                yield term, node.leaf
            children = node.children or ()
            if len(children) > 1:
                stack.extend([(term, children[b]) for b in sorted(children, reverse=True)])
            elif children:
                stack.append((term, *children.values()))


class Leaves(dict):
    """A language's terms: a trie, and for its leaves the documents and the occurrences by source, as columns."""

    PENDING = 1 << 20

    def __init__(self) -> None:
        super().__init__()
        self.trie = RadixTrie()
        self.docs, self.keys, self.counts = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int64")  # keys: leaf and source
        self.new: list[list[np.ndarray]] = [[], [], [], []]
        self.pending = 0
        self.found, self.times, self.rows_of = array("q"), array("q"), []  # of documents that aren't added yet
        self[b""]

    def count(self, counts: Counter, source: int) -> None:
        """A document's terms."""
        self.found.extend(map(self.__getitem__, counts))
        self.times.extend(counts.values())
        self.rows_of.append((source, len(counts)))
        if len(self.found) >= self.PENDING:
            self.settle()

    def __missing__(self, term: bytes) -> int:
        leaf = self[term] = self.trie.leaf(term)
        return leaf

    def add(self, leaves: np.ndarray, docs: np.ndarray, entries: np.ndarray, sources: np.ndarray, counts: np.ndarray) -> None:
        """Leaves with their documents; leaves, as ``entries``, with a source's occurrences."""
        for column, values in zip(self.new, (leaves, docs, entries << 32 | sources, counts), strict=True):
            column.append(values)
        self.pending += len(entries)
        if self.pending >= self.PENDING:
            self.settle()

    def settle(self) -> None:
        if self.rows_of:
            sources, sizes = np.array(self.rows_of, "int64").T
            here, leaves, times = np.unique(sources), np.array(self.found, "int64"), np.array(self.times, "int64")
            self.found, self.times, self.rows_of = array("q"), array("q"), []
            ones, root = np.ones(len(leaves), "int64"), np.zeros(len(here), "int64")
            self.pending = -len(leaves) - len(here)  # not again from add()
            self.add(leaves, ones, np.append(leaves, root), np.append(np.repeat(sources, sizes), here), np.append(times, root))
        leaves, docs, keys, counts = (np.concatenate(c) if c else np.zeros(0, "int64") for c in self.new)
        self.docs = np.pad(self.docs, (0, self.trie.size - len(self.docs)))
        np.add.at(self.docs, leaves, docs)
        self.keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        total = np.zeros(len(self.keys), "int64")
        np.add.at(total, at, np.concatenate([self.counts, counts]))
        self.counts, self.new, self.pending = total, [[], [], [], []], 0

    def rows(self, lang: str, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The walk; names: of the sources."""
        self.settle()
        walk = list(self.trie.walk())
        starts = np.searchsorted(self.keys, np.arange(self.trie.size + 1) << 32)
        sizes, names = np.diff(starts), pa.array(names, pa.string())
        for k in range(0, len(walk), 10_000):
            terms, leaves = zip(*walk[k : k + 10_000], strict=True)
            leaves = np.array(leaves)
            offsets = np.cumsum([0, *sizes[leaves]]).astype("int32")
            at = np.arange(offsets[-1]) + np.repeat(starts[leaves] - offsets[:-1], sizes[leaves])
            sources = names.take(pa.array(self.keys[at] & 0xFFFFFFFF))
            arrays = [pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(self.docs[leaves]), pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, pa.array(self.counts[at]))]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "term", "docs", "sources", "counts"])


def count_terms(text: bytes) -> Counter:
    found, at = Counter(), 0
    while at < len(text):
        end = at + SLICE
        part = text[at:end].translate(_TO_TERMS)
        while end < len(text) and not part.endswith(b" "):  # up to the end of a term, however long it is
            more = text[end : end + SLICE].translate(_TO_TERMS)
            k = more.find(b" ")
            part, end = (part + more, end + len(more)) if k < 0 else (part + more[: k + 1], end + k + 1)
        found.update(part.split())
        at = end
    return found


_LEAVES = "lang string, term string, docs long, sources array<string>, counts array<long>"


def tries(docs: DataFrame, most: int = LEAVES) -> DataFrame:
    """(text, lang, source) -> the leaves of each task's tries; the empty term's leaf has all sources."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        found: dict[str, Leaves] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in sorted(found):
                yield from found[lang].rows(lang, list(names))
            found.clear()
            names.clear()

        for b in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if lang not in found:
                    found[lang] = Leaves()
                found[lang].count(count_terms(text), names.setdefault(source, len(names)))
                if sum(x.trie.size for x in found.values()) >= most:
                    yield from flush()
        yield from flush()

    return docs.select(plain("text").cast("binary").alias("text"), plain("lang").alias("lang"), plain("source").alias("source")).mapInArrow(run, _LEAVES)


def _whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, a term's in one batch: what may go on is held back."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        lang, term = b["lang"], b["term"]
        same = pc.and_(pc.equal(lang, lang[-1]), pc.equal(term, term[-1]))
        cut = b.num_rows - pc.sum(same).as_py()
        if held and (cut or held[-1]["term"][-1] != term[-1] or held[-1]["lang"][-1] != lang[-1]):
            yield pa.concat_batches([*held, b.slice(0, cut)])
            held = []
        elif cut:
            yield b.slice(0, cut)
        held.append(b.slice(cut))
    if held:
        yield pa.concat_batches(held)


def merge(partial: DataFrame, min_docs: int = MIN_DOCS, most: int = LEAVES) -> DataFrame:
    """Leaves of many tries -> those of one a language, without terms in fewer documents; the empty term stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        now, found = None, None
        for t in _whole_terms(batches):
            new = np.append(True, pc.or_(pc.not_equal(t["term"][1:], t["term"][:-1]), pc.not_equal(t["lang"][1:], t["lang"][:-1])).to_numpy(zero_copy_only=False))
            starts, docs = np.flatnonzero(new), t["docs"].to_numpy()
            enough = (np.add.reduceat(docs, starts) >= min_docs) | (pc.binary_length(t["term"]).to_numpy()[starts] == 0)
            t = t.filter(pa.array(enough[np.cumsum(new) - 1]))
            coded = t["sources"].flatten().dictionary_encode()
            sources = np.array([names.setdefault(s, len(names)) for s in coded.dictionary.to_pylist()], "int64")[coded.indices.to_numpy()]
            counts, docs, sizes = t["counts"].flatten().to_numpy(), t["docs"].to_numpy(), pc.list_value_length(t["sources"]).to_numpy()
            first, leaves, at = np.cumsum(np.append(0, sizes)), np.zeros(t.num_rows, "int64"), 0

            def add(at: int, end: int) -> None:
                part = slice(first[at], first[end])
                found.add(leaves[at:end], docs[at:end], np.repeat(leaves[at:end], sizes[at:end]), sources[part], counts[part])  # noqa: B023

            last = None
            for k, (lang, term) in enumerate(zip(t["lang"].to_pylist(), t["term"].to_pylist(), strict=True)):
                if lang != now or term != last and found.trie.size >= most:
                    if found is not None:
                        add(at, k)
                        yield from found.rows(now, list(names))
                    found, now, at, last = Leaves(), lang, k, None
                if term != last:
                    last, leaf = term, found.trie.leaf(term.encode())
                leaves[k] = leaf
            if found is not None:
                add(at, t.num_rows)
        if found is not None:
            yield from found.rows(now, list(names))

    dealt = partial.repartitionByRange(shuffle_partitions(partial.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, _LEAVES)


def frequencies(counts: np.ndarray, total: int | np.ndarray, v: int) -> np.ndarray:
    """1 + floor(1e9 (n + 2) / (N + 2 V)); total is one number or one a count."""
    if counts.max(initial=0) >= 2**63 // WHOLE - 2:
        counts = counts.astype(object)
    return (1 + WHOLE * (counts + 2) // np.maximum(total + 2 * v, 1)).astype("int64")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Share:
    """Of two blocks of sources (or one with itself), what a share of the terms gives."""

    def __init__(self, first: bool, v: int, total: int, same: bool, blocks: list[list[tuple[str, int]]], top: int) -> None:
        self.v, self.total, self.top, self.same = v, total, top, same
        self.names = [s for block in blocks for s, _ in block]
        self.totals = np.array([n for block in blocks for _, n in block], "int64")
        self.at = {s: k for k, s in enumerate(self.names)}
        self.left = len(blocks[0])
        self.none = frequencies(np.zeros(len(self.names), "int64"), self.totals, v)
        self.base = self._all_pairs(self.none[None])[0]
        self.sums = self.base * (v if first else 0)
        self.best: list[list[tuple[int, int, str]]] = [[] for _ in self.names]
        self.seen = 0
        self.terms: list[str] = []
        self.parts: list[tuple[int, int, int]] = []  # term, source, occurrences
        self.wholes: list[int] = []
        self.chunk = max(1, (1 << 19) // max(1, self.base.size))

    def _all_pairs(self, p: np.ndarray) -> np.ndarray:
        left, right = (p, p) if self.same else (p[:, : self.left], p[:, self.left :])
        return divergence(left[:, :, None], right[:, None, :])

    def add(self, term: str, whole: int, sources: list[str], counts: list[int]) -> None:
        """In the terms' order; the two blocks' leaves of a term one after another."""
        if not self.terms or self.terms[-1] != term:
            if len(self.terms) >= self.chunk:
                self.flush()
            self.terms.append(term)
            self.wholes.append(whole)
        k = len(self.terms) - 1
        self.parts.extend((k, self.at[s], n) for s, n in zip(sources, counts, strict=True))

    def flush(self) -> None:
        if not self.terms:
            return
        k, s, n = np.array(self.parts, "int64").T
        p = np.tile(self.none, (len(self.terms), 1))
        p[k, s] = frequencies(n, self.totals[s], self.v)
        self.sums += (self._all_pairs(p) - self.base).sum(axis=0)
        if self.same:
            q = frequencies(np.array(self.wholes, "int64"), self.total, self.v)[k]
            f = np.where((n > 0) & (p[k, s] > q), divergence(p[k, s], q), -1)
            floor = np.array([b[0][0] if len(b) == self.top else -1 for b in self.best])
            for j in np.flatnonzero(f > floor[s]):
                one, best = (int(f[j]), -self.seen - int(k[j]), self.terms[k[j]]), self.best[s[j]]
                (heapq.heappush if len(best) < self.top else heapq.heappushpop)(best, one)
        self.seen += len(self.terms)
        self.terms, self.parts, self.wholes = [], [], []

    def rows(self) -> Iterator[tuple[str, str, str, int]]:
        """(source, part, item, value): pairs' sums, both ways, and the best terms."""
        self.flush()
        right = 0 if self.same else self.left
        for a, row in enumerate(self.sums.tolist()):
            for b, value in enumerate(row, right):
                if a != b:
                    yield self.names[a], "pair", self.names[b], value
                    if not self.same:
                        yield self.names[b], "pair", self.names[a], value
        for name, best in zip(self.names, self.best, strict=True):
            for value, _, term in best:
                yield name, "term", term, value


def _score(dealt: DataFrame, top: int) -> DataFrame:
    """Rows by key (lang, two blocks, share), blocks of sources first, then terms in order -> lang, source, part, item, value."""
    names = ["lang", "source", "part", "item", "value"]

    def out(lang: str, share: Share) -> Iterator[pa.RecordBatch]:
        rows = list(share.rows())
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), *(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lang, share, blocks, head = None, None, None, [], None
        for b in batches:
            col = {f: b.column(k) for k, f in enumerate(b.schema.names)}
            ends = pc.run_end_encode(col["key"])
            sources, counts = col["sources"].flatten().to_pylist(), col["counts"].flatten().to_pylist()
            starts = (col["sources"].offsets.to_numpy() - col["sources"].offsets[0].as_py()).tolist()
            terms, wholes = col["term"].to_pylist(), col["whole"].to_pylist()
            at = 0
            for end, k in zip(ends.run_ends.to_pylist(), ends.values.to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        yield from out(lang, share or Share(*head, blocks, top))
                    key, lang, share, blocks = k, col["lang"][at].as_py(), None, []
                    head = (col["share"][at].as_py() == 0, col["v"][at].as_py(), col["total"][at].as_py(), col["same"][at].as_py())
                for r in range(at, end):
                    one = sources[starts[r] : starts[r + 1]], counts[starts[r] : starts[r + 1]]
                    if terms[r] is None:
                        blocks.append(list(zip(*one, strict=True)))
                        continue
                    share = share or Share(*head, blocks, top)
                    share.add(terms[r], wholes[r], *one)
                at = end
        if key is not None:
            yield from out(lang, share or Share(*head, blocks, top))

    return dealt.mapInArrow(run, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, terms: int = TERMS) -> DataFrame:
    """(text, lang, source) -> lang, source, part, item, value, rank."""
    leaves = written(merge(written(tries(docs), "tries"), min_docs), "leaves")
    each = leaves.select("lang", "term", F.inline(F.arrays_zip("sources", "counts"))).toDF("lang", "term", "source", "n")
    groups = cut(each.groupBy("lang", "source").agg(F.sum("n").alias("n")))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("total"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    langs = langs.join(leaves.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v")), "lang")
    tiles = F.col("blocks") * (F.col("blocks") + 1) / 2
    langs = if_few(cut(langs.withColumn("shares", F.ceil((1 + F.floor(F.col("v") / terms)) / tiles).cast("int"))), BROADCAST_ROWS)

    def of(source):
        return F.pmod(F.xxhash64(source), F.col("blocks")).cast("int")

    filled = if_few(cut(groups.join(langs, "lang").groupBy("lang").agg(F.collect_set(of(F.col("source"))).alias("filled"))), BROADCAST_ROWS)

    def keyed(rows: DataFrame) -> DataFrame:
        """Rows of a block to all tiles that it is in."""
        tiled = rows.join(filled, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        other = F.array_contains("filled", F.col("other"))  # with a block that has no sources there is nothing to compare
        key = F.concat_ws(":", F.least("block", "other"), F.greatest("block", "other"), "share", "lang")
        return tiled.filter(other).select(key.alias("key"), "lang", (F.col("block") == F.col("other")).alias("same"), "share", "v", "total", "block", "term", "whole", "sources", "counts")

    both = F.col("g.source").alias("sources"), F.col("g.n").alias("counts")
    heads = groups.join(langs, "lang").withColumn("block", of(F.col("source")))
    heads = heads.groupBy("lang", "block", "blocks", "shares", "v", "total").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"))
    heads = heads.select("*", *both, F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("whole"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    of_terms = leaves.filter("term <> ''").join(langs, "lang").withColumn("whole", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    of_terms = of_terms.withColumn("share", F.pmod(F.xxhash64("term"), F.col("shares")).cast("int")).withColumn("pairs", F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n")))
    whole = F.array(F.struct(F.lit(0).alias("block"), F.col("pairs").alias("g")))
    split = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("block"), F.filter("pairs", lambda x: of(x["source"]) == k).alias("g")))
    in_blocks = of_terms.drop("sources", "counts").select("*", F.inline(F.when(F.col("blocks") == 1, whole).otherwise(F.filter(split, lambda x: F.size(x["g"]) > 0)))).select("*", *both)
    dealt = keyed(heads).union(keyed(in_blocks))
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key", F.asc_nulls_first("term"), "block")
    found = _score(dealt, top).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank.cast("int")).filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
e AS (SELECT g.lang, g.source, k.term, k.n AS of_lang, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT e.lang, source, term, e.n,
    1 + (1000000000::HUGEINT * (e.n + 2)) // (sum(e.n) OVER (PARTITION BY e.lang, source) + 2 * v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (of_lang + 2)) // (l.n + 2 * v)::HUGEINT AS q
  FROM e JOIN l USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM l)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
found AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
