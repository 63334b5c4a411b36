"""Uploads as a stream: pages are held until a document is whole, then extracted; documents that never get whole fail by a timer.

Pages (document_id, doc_type, page, pages, text, at) come in files in any order, over any number of batches. State is
the pages of documents that aren't whole; a document that is whole leaves in one batch and keeps a mark until its timer
ends, so pages that are sent again do nothing. Timers go by event time (``at`` and the watermark), so a replay after a
crash decides alike. Results go to a folder a batch, which a replay of the batch replaces.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import sinks

_PAGES = "document_id string, doc_type string, page int, pages int, text string, error string"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of ``_PAGES``, a column at a time."""
    document_id, doc_type, page, pages, text, error = (list(c) for c in zip(*rows, strict=True))
    numbers = {"page": pd.array(page, "Int32"), "pages": pd.array(pages, "Int32")}
    return pd.DataFrame({"document_id": document_id, "doc_type": doc_type, **numbers, "text": text, "error": error}, copy=False)


def assemble(pages: DataFrame, wait_ms: int, late: str = "10 minutes") -> DataFrame:
    """A stream of pages -> those of whole documents; one row with an error for a document that isn't whole ``wait_ms`` after its last page.

    Of a page that comes twice the first text counts (in a batch the smallest), of differing numbers of pages the largest.
    Rows without a document or a page number beyond 0..pages-1 are left out.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got, total, kind, whole, last = state.get if state.exists else ([], 0, None, False, 0)
        if state.hasTimedOut:
            state.remove()
            if not whole:
                yield _frame([(key[0], kind, None, total, None, f"{len(got)} of {total} pages came")])
            return
        texts, kinds = dict(got), {kind}
        for f in frames:
            # A call is a document: each column of pandas, and its sort and maximum, cost more than all the rest here.
            rows = [json.loads(x) for x in f["said"].tolist()]
            total, last = max(total, *(r["pages"] for r in rows)), max(last, *(r["at_ms"] for r in rows))
            kinds.update(r.get("doc_type") for r in rows)
            for n, text in sorted((r["page"], r["text"]) for r in rows):
                texts.setdefault(n, text)
        kind = min((k for k in kinds if k), default=None)
        now_whole = not whole and len(texts) == total
        if now_whole:
            yield _frame([(key[0], kind, p, total, texts[p], None) for p in sorted(texts)])
        whole = whole or now_whole
        state.update(([] if whole else sorted(texts.items()), total, kind, whole, last))
        state.setTimeoutTimestamp(max(last + wait_ms, state.getCurrentWatermarkMs() + 1))

    good = pages.filter("document_id IS NOT NULL AND page >= 0 AND page < pages AND at IS NOT NULL").withWatermark("at", late)
    rows = good.select(F.col("document_id").cast("string").alias("document_id"), F.col("doc_type").cast("string").alias("doc_type"), F.col("page").cast("int").alias("page"), F.col("pages").cast("int").alias("pages"), F.coalesce("text", F.lit("")).alias("text"), F.unix_millis("at").alias("at_ms"), "at")
    rows = rows.select("document_id", F.to_json(F.struct("doc_type", "page", "pages", "text", "at_ms")).alias("said"), "at")
    return rows.groupBy("document_id").applyInPandasWithState(step, _PAGES, "pages array<struct<page:int,text:string>>, total int, kind string, whole boolean, last long", "append", GroupStateTimeout.EventTimeTimeout)


def take_in(pages: DataFrame, provider: Callable[[str, str], dict], doc_type: str, out: str, checkpoint: str, wait_ms: int, late: str = "10 minutes"):
    """Starts the stream over the pages there are: whole documents go to the provider and on to review, others fail.

    A document all of whose pages the provider failed on fails too. Each batch writes ``out``/batch=<number>.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            of = batch.filter("error IS NULL").groupBy("document_id").agg(F.max("pages").alias("pages"))
            done = sinks.ingest(batch.filter("error IS NULL").select("document_id", "doc_type", "page", "text"), provider, doc_type).join(of, "document_id")
            none = F.col("pages_failed") >= F.col("pages")
            done = done.withColumn("status", F.when(none, "failed").otherwise("needs_review")).withColumn("error", F.when(none, F.lit("no page could be read")))
            stuck = batch.filter("error IS NOT NULL").select("document_id", "pages", F.lit("failed").alias("status"), "error")
            done.unionByName(stuck, allowMissingColumns=True).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            batch.unpersist()

    return sinks.run_batches(assemble(pages, wait_ms, late), step, checkpoint)


def results(spark: SparkSession, out: str) -> DataFrame:
    """A row a document; one that failed and was sent again whole later counts as it ended best."""
    rows = spark.read.parquet(out)
    first = F.struct(F.col("status") == "failed", "batch")
    return rows.groupBy("document_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("document_id", "batch")]), first).alias("r")).select("document_id", "r.*")
