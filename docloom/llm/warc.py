r"""WARC archives with revisit records, and a capture index merged from sorted runs.

Writing: each page is one record, made by column expressions, and Spark's text writer puts ``\r\n\r\n`` after each,
which is WARC's record end; its commit protocol makes the archives whole even if executors are lost. Of pages with
equal payloads of at least 100 bytes the one with the smallest id is a ``response``, the others are ``revisit``
records without payload that refer to it. Files hold a bounded number of records and are gzip streams.

Reading: each archive is parsed by its lengths and yields one run of index entries sorted by (URL key, date, id).
Runs are dealt out by ranges of that order, a range holds its slice of every run, and a loser tree merges the slices:
k runs cost log2(k) comparisons an entry and the ranges, one after the other, are the whole sorted index. A URL with
very many captures spans several ranges, as the date and id are part of the order.

Edge cases: a null html is an empty payload; a null url gives a record without target and the empty key, a null id
is written as ``null`` and never referred to; rows with equal ids are separate records; a smallest id that several
rows of a group share makes each of them a response; an empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, folder, shuffle_partitions, table

MIN_SHARED = 100
PER_FILE, FILE_BYTES = 5_000, 64 << 20
#: Tasks that the pages of one payload are dealt to; index entries that a merging task holds about.
SALTS, PER_RANGE = 32, 100_000
EPOCH = 946_684_800  # a page's date is this plus its id, in seconds, if no date column is given
URN = "urn:docloom:page:"


def records(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """(page_id, url, html) -> page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    shared = p.filter(F.col("payload_bytes") >= min_shared).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).filter("n > 1 AND first_id IS NOT NULL").drop("n")
    # A payload that a third of all pages have is dealt to as many tasks as there are salts.
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    p = p.join(shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["payload_digest", "salt"], "left")
    again = F.coalesce(~F.col("first_id").eqNullSafe(F.col("page_id")) & F.col("first_id").isNotNull(), F.lit(False))
    return p.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, per_file: int | None = None) -> None:
    """Archives of ``per_file`` records, by default as many as have about 64 MB of payload, 5,000 at most."""
    if per_file is None:
        mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
        per_file = int(max(1, min(PER_FILE, FILE_BYTES / (mean + 500))))
    r = records(pages)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    again = F.col("record_type") == "revisit"
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    url = F.regexp_replace(F.regexp_replace("url", "%(?![0-9A-Fa-f]{2})", "%25"), r"[\x00-\x20\x7f]+", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{URN}"), name(F.col("page_id")), F.lit(">"))),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)).otherwise(""),
        line("WARC-Date", F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.pmod(F.col("page_id"), F.lit(2_000_000_000)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit(f"<{URN}"), name(F.col("refers_to")), F.lit(">"))))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    r.withColumn("block", block).select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_warc(archive: BinaryIO) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of every record, one after the other: no more than one is held."""
    at = 0
    while version := archive.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        head, headers = len(version), {}
        while (line := archive.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"no end of the header at {at}")
            head += len(line)
            name, value = line.decode("utf-8").removesuffix("\r\n").split(": ", 1)
            headers[name] = value
        size = int(headers["Content-Length"])
        block = archive.read(size)
        if len(block) < size or archive.read(4) != b"\r\n\r\n":
            raise ValueError(f"no record end after {at}")
        yield at, head + 2 + size, headers, block
        at += head + 2 + size + 4


def url_key(url: str) -> str:
    """Host labels reversed, without a leading www, then port, path and query: ``com,example)/a?b``."""
    rest = url.split("#", 1)[0].split("://", 1)[-1]
    cut_at = min((k for k in (rest.find("/"), rest.find("?")) if k >= 0), default=len(rest))
    host, tail = rest[:cut_at].rpartition("@")[2].lower(), rest[cut_at:] or "/"
    host, _, port = host.partition(":")
    labels = host.split(".")
    if len(labels) > 2 and labels[0] == "www":
        labels = labels[1:]
    return ",".join(reversed(labels)) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + tail.lower()


ENTRY = "run string, url_key string, date string, page_id long, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
NAMES = [x.split(" ")[0] for x in ENTRY.split(", ")]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index entry for each record of the archives under the path; each archive's are sorted."""
    number = lambda s: None if (x := s.strip("<>").removeprefix(URN)) == "null" else int(x)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                run = []
                for offset, length, h, block in parse_warc(gzip.open(io.BytesIO(content.as_py()))):
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = int(dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:])["Content-Length"])
                    if h["WARC-Type"] == "response" and size != len(body):
                        raise ValueError(f"{name}: payload cut off at {offset}")
                    if h["WARC-Type"] == "response" and h["WARC-Payload-Digest"] != "sha256:" + hashlib.sha256(body).hexdigest():
                        raise ValueError(f"{name}: payload damaged at {offset}")
                    refers = number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                    run.append((name, url_key(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else "", h["WARC-Date"], number(h["WARC-Record-ID"]), offset, length, size, h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"], refers))
                run.sort(key=order)
                yield batch_of(run)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content").mapInArrow(read, ENTRY)


def order(entry: tuple) -> tuple:
    return entry[1], entry[2], entry[3] is not None, entry[3] or 0, entry[0], entry[4]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[x.split(" ")[1]]) for k, x in enumerate(ENTRY.split(", "))], NAMES)


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of their match, so each step replays one path to the root."""

    def __init__(self, runs: list[Iterator], key: Callable) -> None:
        self.runs, self.key, self.k = runs, key, len(runs)
        self.head: list = [next(r, None) for r in runs]
        self.keys: list = [None if x is None else key(x) for x in self.head]
        self.loser = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """An empty run loses to all; ties go to the earlier run."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.loser[node]
            if other < 0:  # the other side has not come yet
                self.loser[node] = winner
                return
            if self._beats(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.head[w := self.loser[0]] is not None:
            yield self.head[w]
            self.head[w] = next(self.runs[w], None)
            self.keys[w] = None if self.head[w] is None else self.key(self.head[w])
            self._play(w)


def merge_index(index: DataFrame) -> DataFrame:
    """The entries in global order: partition by partition, and within each. A partition has about ``PER_RANGE`` entries."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                runs.setdefault(row[0], []).append(row)
        out = []
        for row in LoserTree([iter(r) for r in runs.values()], order):
            out.append(row)
            if len(out) == 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    by = ["url_key", "date", "page_id", "run", "offset"]
    index = cut(index)  # ranges are found by a first look at the entries
    ranges = max(shuffle_partitions(index.sparkSession), -(-index.count() // PER_RANGE))
    return index.repartitionByRange(ranges, *by).sortWithinPartitions("run", *by[:3], "offset").mapInArrow(merge, ENTRY)


def op9_warc(spark, sf_dir):
    path = folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return merge_index(read_index(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id OR (first_id IS NOT NULL AND page_id IS NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id OR page_id IS NULL THEN first_id END AS refers_to FROM g
"""
