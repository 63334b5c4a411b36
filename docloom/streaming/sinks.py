"""Delivery sinks for foreachBatch: webhook, agent files, audit; and the ingest job for uploads."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import sign
from ..operators import chunks, export, lifecycle, nested

RESULT = "document_id string, status string, response_code int, response_body string, attempts int"


def post_webhook(
    payloads: DataFrame, url: str, secret: str | None, post: Callable[[str, str, dict], tuple[int, str]], attempts: int = 3, backoff: float = 0.5,
    sleep: Callable = time.sleep, signature_header: str = "X-Signature", version_header: str = "X-Payload-Version",
) -> DataFrame:
    """(document_id, body) -> what came of each: signed if there is a secret, tried again on any answer but 2xx, waiting twice as long each time; answers cut at 2000.

    Sending is a side effect: each action on the result sends anew, as does a task that is tried again, so take it through
    ``deliver_once``. An ``idempotency_key`` goes along as a header, by which a receiver knows a repeat, and stays in the result.
    """
    keyed = "idempotency_key" in payloads.columns
    carried = ["idempotency_key"] if keyed else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, body, key in zip(frame["document_id"], frame["body"], frame["idempotency_key" if keyed else "document_id"], strict=True):
                headers = {"Content-Type": "application/json", version_header: str(json.loads(body).get("payload_version", "1.0"))}
                if keyed:
                    headers["Idempotency-Key"] = str(key)
                if secret:
                    headers[signature_header] = sign(secret, body)
                code, said, n = None, "" if url else "no url configured", 0
                for n in range(1, attempts + 1) if url else ():
                    try:
                        code, said = post(url, body, headers)
                    except OSError as e:
                        said = str(e)
                    else:
                        if 200 <= code < 300:
                            break
                    if n < attempts:
                        sleep(backoff * 2 ** (n - 1))
                ok = code is not None and 200 <= code < 300
                out.append((*([key] if keyed else []), doc, "success" if ok else "failed", code, said[:2000], n))
            yield pd.DataFrame(out, columns=[*carried, "document_id", "status", "response_code", "response_body", "attempts"]).astype({"response_code": "Int32", "attempts": "int32"})

    return payloads.select("document_id", "body", *carried).mapInPandas(run, ("idempotency_key string, " if keyed else "") + RESULT)


def deliver_once(payloads: DataFrame, send: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """What ``send`` makes of the payloads, written to ``path`` by one action and read from there: later actions don't send.

    A path that is written as a whole is only read, so a batch that is tried again after a crash sends what it had not
    finished alone; the key in the header covers the rest.
    """
    spark = payloads.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        send(payloads).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def dispatch(payloads: DataFrame, senders: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """payloads (document_id, body, idempotency_key, connector_type) -> results of the sender registered for each type; a type without one fails."""
    columns = ["idempotency_key", "document_id", "status", "response_code", "response_body", "attempts"]
    kind = F.coalesce("connector_type", F.lit(""))
    none = payloads.filter(~kind.isin(*senders)) if senders else payloads
    out = none.select(
        "idempotency_key", "document_id", F.lit("failed").alias("status"), F.lit(None).cast("int").alias("response_code"), F.concat(F.lit("no connector of type "), kind).alias("response_body"), F.lit(0).alias("attempts")
    )
    for name, send in senders.items():
        out = out.unionByName(send(payloads.filter(kind == name)).select(*columns))
    return out


def enqueue_for_agent(payloads: DataFrame) -> DataFrame:
    """Nothing is sent; the agent asks later."""
    carried = ["idempotency_key"] if "idempotency_key" in payloads.columns else []
    return payloads.select(*carried, "document_id", F.lit("pending").alias("status"), F.lit(None).cast("int").alias("response_code"), F.lit("").alias("response_body"), F.lit(0).alias("attempts"))


def agent_files(docs: DataFrame, doc_type: str) -> DataFrame:
    """(document_id, data, payload) -> an agent's artifacts: JSON of the payload always, CSV if there are items. The same name again replaces."""
    rows = nested.flatten_rows(docs, doc_type, agent=True)
    fields = [c for c in rows.columns if c != "item_no"]
    table = export.render_csv(rows, {f: f for f in fields})
    return docs.select("document_id", F.lit("json").alias("extension"), F.to_json("payload").alias("content")).unionByName(table)


def poll_agent(deliveries: DataFrame, docs: DataFrame, connector_id, doc_type: str, path: str, limit: int = 50) -> DataFrame:
    """One poll of a connector's agent: docs (document_id, data, payload) of its oldest pending deliveries are written as files, then acknowledged.

    Gives all deliveries after it. Files come first: a poll that fails in between is repeated and replaces them. Deliveries
    whose document is missing stay pending.
    """
    due = lifecycle.pending_for(deliveries, connector_id, limit)
    mine = docs.join(due.select("document_id"), "document_id", "left_semi")
    export.write_named_files(agent_files(mine, doc_type), path)
    return lifecycle.acknowledge(deliveries, due.join(mine.select("document_id"), "document_id", "left_semi"))


def audit(rows: DataFrame, action: str, path: str, target: str = "document_id") -> None:
    """Appends what was done; actor and shop may be null."""
    have = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    rows.select(F.current_timestamp().alias("at"), F.lit(action).alias("action"), have("shop_id").alias("shop_id"), have("actor_id").alias("actor_id"), have(target).alias("target")).write.mode("append").parquet(path)


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None):
    """Starts a stream: every so many seconds, or once over what there is. A batch is tried again after a crash, so steps must be safe to repeat."""
    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def extract(units: DataFrame, provider: Callable[[str, str], dict]) -> DataFrame:
    """(document_id, chunk, doc_type, text) -> document_id, chunk, fields (JSON), error: a provider called once a unit; a failure is kept, never made up for.

    A number of pages ``n`` is carried along where there is one.
    """
    counted = ["n"] if "n" in units.columns else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, chunk, kind, text in zip(frame["document_id"], frame["chunk"], frame["doc_type"], frame["text"], strict=True):
                try:
                    out.append((doc, chunk, json.dumps(provider(kind, text)), None))
                except Exception as e:  # noqa: BLE001 - any failure of a provider is the unit's result
                    out.append((doc, chunk, None, str(e)))
            yield pd.DataFrame(out, columns=["document_id", "chunk", "fields", "error"]).assign(**{c: frame[c] for c in counted})

    return units.select("document_id", "chunk", "doc_type", "text", *counted).mapInPandas(run, "document_id string, chunk int, fields string, error string" + ", n int" * len(counted))


def ingest(pages: DataFrame, provider: Callable[[str, str], dict], doc_type: str) -> DataFrame:
    """(document_id, doc_type, page, text) a row a page -> a row a document: its merged fields, item_count, pages_failed.

    Documents with enough text go to the provider six pages at a time, others two; units come together in page order
    whatever order they end in. All pages of a unit that fails count as failed. One shuffle by document a step; a document's
    state is its chunks' fields.
    """
    digital = chunks.is_digital(pages).select("document_id", "digital")
    placed = chunks.units(pages.join(digital, "document_id"), F.col("digital"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    units = placed.groupBy("document_id", F.col("unit").alias("chunk")).agg(F.first("doc_type").alias("doc_type"), text.alias("text"), F.count("*").cast("int").alias("n"))
    told = extract(units, provider)
    schema = nested.SCHEMAS["invoice" if doc_type == "invoice" else "prescription"]
    items = nested.LISTS["invoice" if doc_type == "invoice" else "prescription"]
    heads = {f.name: f.dataType.names for f in schema if f.name != items}
    each = told.select("document_id", "chunk", F.from_json("fields", schema).alias("fields"), F.when(F.col("fields").isNull(), F.col("n")).otherwise(0).alias("failed"))
    return chunks.merge(each, items, heads)
