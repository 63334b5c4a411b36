"""Toxicity of whole texts by a convolutional classifier trained in numpy.

Words are embedded by hashing: a word's vector is the sum of table rows for the word and for a few of its beginnings, so
that words with a common stem are alike. Filters of several widths pass over the words, each filter's largest value in
the text is kept (max pooling), and a linear layer gives the log odds. Training is on a bounded sample of labelled rows
(``FitOn``), by Adam on minibatches; the sample's classes are drawn apart and weighted back to their shares. Part of the
sample is held back from the training to choose the state of the best epoch and thresholds: one for all, and one for each language
with enough rows. The threshold for all is what a score of 0.5 means; those by language only give ``flagged``, so no
score depends on a language.

A text's largest values are found a slice of words at a time, slices overlapping by a filter's width less one, so a
text of any length takes bounded memory; no word is left out.

Edge cases: null and empty texts have no words, and every step learns that such a text isn't toxic; equal texts score alike;
rows of a null id have no label and aren't held out; a label that is neither 0 nor 1 is none, of several labels of an id
the largest counts; without labels of both classes all scores are 0; an empty table gives an empty one. Other columns
are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Rows of the embedding table, its width, filters of each width, lengths of beginnings in bytes.
BUCKETS, DIM, FILTERS, WIDTHS, BEGINNINGS = 1 << 17, 16, 16, (1, 2, 3), (4, 6, 8)
#: Words that are convolved at once; words whose vectors a task keeps.
SLICE, KNOWN = 16_384, 50_000
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 or b == 39 else 32 for b in range(256))


@dataclass(frozen=True)
class FitOn:
    """The sample's bounds: rows of each class, bytes of a text; then training: steps at most, steps without a better epoch until it ends, rows of a step, step size, rows held back (one in so many), texts that a table row must occur in to be trained, least rows of a class for a threshold."""

    rows: int = 2_000
    longest: int = 200_000
    steps: int = 1_000
    patience: int = 300
    batch: int = 32
    rate: float = 0.006
    back: int = 6
    seen: int = 3
    least: int = 8


def words_of(text: bytes, at: int = 0, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lists of a text's words in order, a slice of bytes at a time, cut between words."""
    left = b""
    while at < len(text):
        part = left + text[at : at + size].translate(_WORDS)
        at += size
        cut = len(part) if at >= len(text) else part.rfind(b" ") + 1
        left = part[cut:]
        yield part[:cut].split()


def buckets_of(word: bytes) -> tuple[int, ...]:
    """Table rows of a word and its beginnings; a beginning that is the whole word is another row than the word."""
    return tuple(zlib.crc32(p) % BUCKETS for p in (word + b" ", *(word[:n] for n in BEGINNINGS)))


class Network:
    """Embedding, filters and the linear layer; parameters by name in ``p``. Table rows of words that the sample hardly has are zero, as the last one is."""

    def __init__(self, seed: int = 7) -> None:
        rng, n = np.random.default_rng(seed), FILTERS * len(WIDTHS)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype("float32")
        self.p = {"table": draw(0.02, BUCKETS + 1, DIM), "out": draw(0.1, n), "bias": np.zeros(1, "float32")}
        for w in WIDTHS:
            self.p[f"filter{w}"], self.p[f"shift{w}"] = draw((w * DIM) ** -0.5, w * DIM, FILTERS), np.zeros(FILTERS, "float32")

    def embed(self, buckets: np.ndarray) -> np.ndarray:
        return self.p["table"][buckets].sum(axis=1)

    def pooled(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Vectors of words -> for each [start, end) the largest value of each filter that begins there, and, if asked, where.

        Between an end and the next start is what such filters reach into: zero vectors after a text, or more of it.
        """
        values, places, bounds = [], [], np.stack([starts, ends], axis=1).ravel()
        for w in WIDTHS:
            wide = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, w - 1), (0, 0))), w, axis=0).transpose(0, 2, 1).reshape(len(x), w * DIM)
            c = wide @ self.p[f"filter{w}"] + self.p[f"shift{w}"]
            if where:
                places.append(np.array([s + c[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)]))
                values.append(c[places[-1], np.arange(FILTERS)])
            else:
                values.append(np.maximum.reduceat(c, bounds, axis=0)[::2])
        return np.concatenate(values, axis=1), np.concatenate(places, axis=1) if where else None

    def odds(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.p["out"] + self.p["bias"]


GAP = max(WIDTHS) - 1


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as rows of word numbers -> one row with gaps (-1), and where texts start and end; a filter may begin in the gap."""
    gap = np.full(2 * GAP, -1, "int64")
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + len(gap)) - sizes - len(gap)
    return np.concatenate([x for t in texts for x in (t, gap)]), starts, starts + sizes + GAP


class Trainer:
    """Adam; of the table only the rows that a step touches move."""

    def __init__(self, net: Network, rate: float) -> None:
        self.net, self.rate, self.step = net, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))

    def move(self, name: str, grad: np.ndarray, at: np.ndarray | slice = slice(None)) -> None:
        m, v = self.m[name], self.v[name]
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.999 * v[at] + 0.001 * grad**2
        self.net.p[name][at] -= self.rate * (m[at] / (1 - 0.9**self.step)) / (np.sqrt(v[at] / (1 - 0.999**self.step)) + 1e-8)

    def learn(self, texts: list[np.ndarray], buckets: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        net, n = self.net, len(texts)
        self.step += 1
        ids, starts, ends = _laid_out(texts)
        x = net.embed(buckets[ids])
        x[ids < 0] = 0
        pooled, at = net.pooled(x, starts, ends, where=True)
        off = (1 / (1 + np.exp(-net.odds(pooled))) - y) * weight / weight.sum()
        live = np.maximum(pooled, 0)
        down = (off[:, None] * net.p["out"][None]) * (pooled > 0)
        to_words = np.zeros_like(x)
        moves = [("out", off @ live), ("bias", off.sum(keepdims=True))]
        for k, w in enumerate(WIDTHS):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            d, where, filters = down[:, cols], at[:, cols], net.p[f"filter{w}"].reshape(w, DIM, FILTERS)
            grad = np.zeros_like(filters)
            for j in range(w):
                here = where + j
                grad[j] = np.einsum("nfd,nf->df", x[here], d)
                np.add.at(to_words, here.ravel(), (d[:, :, None] * filters[j].T[None]).reshape(n * FILTERS, DIM))
            moves += [(f"filter{w}", grad.reshape(w * DIM, FILTERS)), (f"shift{w}", d.sum(axis=0))]
        touched = np.flatnonzero(np.abs(to_words).sum(axis=1) * (ids >= 0))
        rows, inverse = np.unique(buckets[ids[touched]], return_inverse=True)
        of_table = np.zeros((len(rows), DIM), "float32")
        np.add.at(of_table, inverse.ravel(), np.repeat(to_words[touched], buckets.shape[1], axis=0))
        of_table[rows == BUCKETS] = 0
        for name, grad in moves:
            self.move(name, grad.astype("float32"))
        if len(rows):
            self.move("table", of_table, rows)


def best_threshold(odds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Where the weighted errors are fewest: of equal ones the middle of the widest gap."""
    order = np.argsort(odds, kind="stable")
    o, up = odds[order], np.where(y[order] > 0, weight[order], -weight[order])
    errors = np.concatenate([[0], np.cumsum(up)])  # of calling all from k on toxic, but for a constant
    edges = np.concatenate([[o[0] - 1], (o[1:] + o[:-1]) / 2, [o[-1] + 1]])
    gaps = np.concatenate([[0], np.diff(o), [0]])
    k = min(range(len(errors)), key=lambda k: (round(float(errors[k]), 6), -gaps[k]))
    return float(edges[k])


@dataclass
class Model:
    """A trained network; ``threshold`` and ``by_lang`` are log odds."""

    net: Network | None
    threshold: float = 0.0
    by_lang: dict[str, float] | None = None

    def scores(self, odds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(odds - self.threshold, -500, 500)))


def fit(texts: list[list[bytes]], y: np.ndarray, weight: np.ndarray, langs: list[str], how: FitOn) -> Model:
    """Words of texts, 0 or 1, rows each stands for, languages -> a model."""
    if len(set(y.tolist())) < 2:
        return Model(None)
    number: dict[bytes, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in t], "int64") for t in texts]
    buckets = np.array([buckets_of(w) for w in [*number, b""]])
    texts_with = np.zeros(BUCKETS, "int64")
    for r in rows:
        texts_with[np.unique(buckets[r])] += 1
    buckets[texts_with[buckets] < how.seen] = BUCKETS
    rng = np.random.default_rng(11)
    back = np.zeros(len(y), bool)
    for c in (0, 1):
        of = np.flatnonzero(y == c)
        back[rng.permutation(of)[: len(of) // how.back]] = True
    train = np.flatnonzero(~back)
    net = Network()
    net.p["table"][:-1][texts_with < how.seen] = 0
    net.p["table"][-1] = 0
    trainer = Trainer(net, how.rate)

    def odds_of(some: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(some))
        for k in range(0, len(some), 4 * how.batch):
            ids, *bounds = _laid_out(some[k : k + 4 * how.batch])
            x = net.embed(buckets[ids])
            x[ids < 0] = 0
            out[k : k + 4 * how.batch] = net.odds(net.pooled(x, *bounds)[0])
        return out

    judged = np.flatnonzero(back) if len(set(y[back])) == 2 else np.arange(len(y))
    none = rows[0][:0]  # a text without words isn't toxic
    yj, wj = np.append(y[judged], 0), np.append(weight[judged], weight[judged].mean())
    best, since, kept, found = np.inf, 0, None, None
    while trainer.step < how.steps and since < how.patience:
        order = rng.permutation(train)
        for k in range(0, len(order), how.batch):
            part = order[k : k + how.batch]
            w = np.sqrt(weight[part])
            trainer.learn([*(rows[i] for i in part), none], buckets, np.append(y[part], 0), np.append(w, w.mean()))
            since += 1
        odds = odds_of([*(rows[i] for i in judged), none])
        loss = float((np.logaddexp(0, np.where(yj > 0, -odds, odds)) * np.sqrt(wj)).mean())
        if loss < best:
            best, since, kept, found = loss, 0, {k: v.copy() for k, v in net.p.items()}, odds
    net.p = kept

    def threshold_of(some: np.ndarray, otherwise: float | None) -> float | None:
        return best_threshold(found[some], yj[some], wj[some]) if min((yj[some] == c).sum() for c in (0, 1)) >= how.least else otherwise

    lang_of = np.array([*(langs[i] for i in judged), None], object)
    own = {x: threshold_of(lang_of == x, None) for x in sorted(set(langs))}
    return Model(net, threshold_of(np.full(len(yj), True), 0.0), {x: t for x, t in own.items() if t is not None})


class Scorer:
    """Log odds of texts; a word's vector is kept for the next time."""

    class Known(dict):
        def __init__(self, net: Network) -> None:
            super().__init__()
            self.net, self.new, self.vectors = net, [buckets_of(b"")], np.zeros((0, DIM), "float32")

        def __missing__(self, word: bytes) -> int:
            self[word] = at = len(self) + 1
            self.new.append(buckets_of(word))
            return at

        def matrix(self) -> np.ndarray:
            """Row 0 is the gap."""
            if self.new:
                more = self.net.embed(np.array(self.new))
                if not len(self.vectors):
                    more[0] = 0
                self.vectors, self.new = np.concatenate([self.vectors, more]), []
            return self.vectors

    def __init__(self, net: Network) -> None:
        self.net, self.known = net, self.Known(net)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        best = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, "float32")
        pieces: list[tuple[int, np.ndarray, int]] = []  # text, words with those that filters reach into, words where filters begin
        waiting = 0

        def flush() -> None:
            nonlocal waiting
            if pieces:
                starts = np.cumsum([0, *(len(w) for _, w, _ in pieces)])[:-1]
                x = self.known.matrix()[np.concatenate([w for _, w, _ in pieces])]
                found, _ = self.net.pooled(x, starts, starts + [n for _, _, n in pieces])
                np.maximum.at(best, [t for t, _, _ in pieces], found)
            pieces.clear()
            waiting = 0

        for t, text in enumerate(texts):
            if waiting == 0 and len(self.known) > KNOWN:
                self.known = self.Known(self.net)
            words = np.array([*(i for part in words_of(text) for i in map(self.known.__getitem__, part)), *[0] * 2 * GAP], "int64")
            for at in range(0, len(words) - GAP, SLICE):
                part = words[at : at + SLICE + GAP]
                pieces.append((t, part, len(part) - GAP))
                waiting += len(part)
                if waiting >= SLICE:
                    flush()
        flush()
        return self.net.odds(best).astype("float64")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, how: FitOn) -> tuple[list[bytes], np.ndarray, np.ndarray, list[str]]:
    """Texts, labels, how many labelled ids each stands for, and languages: at most ``rows`` ids of a class, of bounded texts, none held out."""
    toxic = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    toxic = toxic.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = [toxic.filter(F.col("toxic") == c).orderBy(*order).limit(how.rows) for c in (0, 1)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    rows = rows.join(F.broadcast(few[0].union(few[1])), "doc_id").filter(F.octet_length("text") <= how.longest)  # at most 2 x ``rows`` ids
    found = rows.orderBy(*order, F.xxhash64("text"), "text", "lang").limit(2 * how.rows).collect()
    total = {r["toxic"]: r["n"] for r in toxic.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    y = np.array([r["toxic"] for r in found], "int64")
    weight = np.array([total[c] / (y == c).sum() for c in y.tolist()])
    return [r["text"].encode() for r in found], y, weight, [r["lang"] for r in found]


def classify(docs: DataFrame, labels: DataFrame, how: FitOn | None = None) -> DataFrame:
    """(doc_id, text, lang) and (doc_id, toxic) -> doc_id, held_out, score, predicted, flagged: a row a document."""
    how = how or FitOn()
    texts, y, weight, langs = sample(docs, labels, how)
    model = fit([[w for part in words_of(t) for w in part] for t in texts], y, weight, langs, how)
    del texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model.net) if model.net else None
        for b in batches:
            odds = score(b.column(2).to_pylist()) if score else np.full(b.num_rows, -np.inf)
            own = np.array([model.by_lang.get(x, model.threshold) if score else 0 for x in b.column(1).to_pylist()])
            arrays = [b.column(0), pa.array(model.scores(odds) if score else np.zeros(b.num_rows)), pa.array(odds >= own)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "flagged"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text")).mapInArrow(run, "doc_id long, score double, flagged boolean")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")


def op11_toxicity(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
