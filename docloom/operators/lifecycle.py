"""Documents' states, deliveries and recovery, as set operations that give the new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import idempotency_key
from . import nested

#: From which state a document may go to which.
ALLOWED = {
    "queued": ["processing", "failed"],
    "processing": ["needs_review", "failed"],
    "needs_review": ["needs_review", "approved", "failed"],
    "approved": ["pushed", "needs_review"],
    "pushed": ["pushed", "needs_review"],
    "failed": ["queued"],
}
#: A retry by hand may also reopen a document under review.
RETRY_FROM = ["failed", "needs_review"]
#: Fixed value: what a document says that a restart cut short.
INTERRUPTED = "Processing was interrupted (server restart). Please retry."


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in ALLOWED.items() for b in to], "current string, target string")


def split_transitions(moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """moves (current, target, ...) -> the allowed, the forbidden. The table of twelve pairs is broadcast."""
    table = F.broadcast(transitions(moves.sparkSession))
    return moves.join(table, ["current", "target"], "left_semi"), moves.join(table, ["current", "target"], "left_anti")


def check_history(log: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """Each row of a history with the state before it and whether that move is allowed; a first state always is."""
    before = F.lag(status).over(W.partitionBy(key).orderBy(*order))
    pairs = F.lit(None).cast("boolean")
    for a, to in ALLOWED.items():
        pairs = F.when(F.col("current") == a, F.col(status).isin(to)).otherwise(pairs)
    return log.withColumn("current", before).withColumn("allowed", F.when(F.col("current").isNull(), True).otherwise(F.coalesce(pairs, F.lit(False))))


def recover_stuck(docs: DataFrame, message: str = INTERRUPTED) -> DataFrame:
    """Queued and processing documents fail, lose their progress, and keep an error they have."""
    stuck = F.col("status").isin("queued", "processing")
    new = {
        "status": F.when(stuck, "failed").otherwise(F.col("status")),
        "progress": F.when(~stuck, F.col("progress")),
        "error": F.when(stuck, F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit(message))).otherwise(F.col("error")),
    }
    return docs.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def retry(docs: DataFrame, wanted: Column) -> DataFrame:
    go = wanted & F.col("status").isin(RETRY_FROM)
    return docs.withColumns({"status": F.when(go, "queued").otherwise(F.col("status")), "error": F.when(~go, F.col("error"))})


def latest_delivery(deliveries: DataFrame) -> DataFrame:
    """Of each idempotency key the latest, ties to the larger id; one aggregate, no sort."""
    row = F.struct(*deliveries.columns)
    last = deliveries.groupBy("idempotency_key").agg(F.max_by(row, F.struct("created_at", "id")).alias("r"))
    return last.select("r.*")


def push_plan(documents: DataFrame, connectors: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(document_id, shop_id) x a shop's enabled connectors, one left join to the latest deliveries -> action skip, retry or insert."""
    targets = documents.join(connectors.filter("enabled").select("shop_id", "connector_id"), "shop_id").withColumn("idempotency_key", idempotency_key(F.col("document_id"), F.col("connector_id")))
    last = latest_delivery(deliveries).select("idempotency_key", F.col("id").alias("delivery_id"), F.col("status").alias("last_status"), F.col("attempts").alias("last_attempts"))
    action = F.when(F.col("last_status") == "success", "skip").when(F.col("delivery_id").isNotNull(), "retry").otherwise("insert")
    return targets.join(last, "idempotency_key", "left").withColumn("action", action)


def apply_push(plan: DataFrame, results: DataFrame, deliveries: DataFrame) -> DataFrame:
    """All deliveries after a push. results: (idempotency_key, status, response_code, response_body, attempts); retries add attempts."""
    done = plan.join(results, "idempotency_key").filter("action <> 'skip'")
    changed = done.filter("action = 'retry'").select(F.col("delivery_id").alias("id"), F.col("status").alias("new_status"), F.col("response_code").alias("new_code"), F.col("response_body").alias("new_body"), F.col("attempts").alias("more"))
    pick = lambda new, old: F.when(F.col("more").isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
    kept = deliveries.join(changed, "id", "left").select("id", "document_id", "connector_id", "idempotency_key", pick("new_status", "status"), pick("new_code", "response_code"), pick("new_body", "response_body"), (F.col("attempts") + F.coalesce("more", F.lit(0))).alias("attempts"), "created_at")
    new = done.filter("action = 'insert'").select(F.sha1("idempotency_key").alias("id"), "document_id", "connector_id", "idempotency_key", "status", "response_code", "response_body", "attempts", F.current_timestamp().alias("created_at"))
    return kept.unionByName(new)


def all_ok(deliveries: DataFrame) -> DataFrame:
    """A document is pushed if it has deliveries and each succeeded or is pending."""
    ok = F.bool_and(F.col("status").isin("success", "pending"))
    return deliveries.groupBy("document_id").agg(F.coalesce(ok, F.lit(False)).alias("all_ok"))


def push_status(docs: DataFrame, deliveries: DataFrame) -> DataFrame:
    ok = all_ok(deliveries).filter("all_ok").select(F.col("document_id").alias("id"), "all_ok")
    return docs.join(ok, "id", "left").withColumn("status", F.when(F.col("all_ok") & F.col("status").isin("approved", "pushed"), "pushed").otherwise(F.col("status"))).drop("all_ok")


def acknowledge(deliveries: DataFrame, acks: DataFrame) -> DataFrame:
    """Deliveries (id) that an agent has acknowledged succeed; twice is as once."""
    seen = acks.select("id").distinct().withColumn("acked", F.lit(True))
    return deliveries.join(seen, "id", "left").withColumn("status", F.when(F.col("acked"), "success").otherwise(F.col("status"))).drop("acked")


def pending_for(deliveries: DataFrame, connector_id, limit: int = 50) -> DataFrame:
    """A connector's oldest pending deliveries: a top-k, no full sort."""
    return deliveries.filter((F.col("connector_id") == connector_id) & (F.col("status") == "pending")).orderBy("created_at", "id").limit(limit)


#: States in which a document's data may be corrected, and in which it may be pushed.
CORRECTABLE, PUSHABLE = ["needs_review", "approved", "pushed"], ["approved", "pushed"]


def _asked(docs: DataFrame, asked: DataFrame, allowed: Column) -> tuple[DataFrame, DataFrame]:
    """docs with ``hit`` (asked for and allowed), and the refused: id, reason ``not found`` or the state it is in."""
    ids = asked.select("id").filter("id IS NOT NULL").distinct()
    states = docs.select("id", "status", F.coalesce(allowed, F.lit(False)).alias("allowed"))
    told = ids.join(states, "id", "left").filter(~F.coalesce("allowed", F.lit(False)))
    reason = F.when(F.col("allowed").isNull(), "not found").otherwise(F.concat(F.lit("state "), F.coalesce("status", F.lit("unknown"))))
    hits = docs.join(ids.withColumn("hit", F.lit(True)), "id", "left").withColumn("hit", F.coalesce(F.col("hit") & allowed, F.lit(False)))
    return hits, told.select("id", reason.alias("reason"))


def correct(docs: DataFrame, corrections: DataFrame, doc_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """corrections (id, data) -> all documents after them, and the refused (id, reason).

    Documents under review, approved or pushed take the new data and go back to review; confidence and meta stay. Other
    states, unknown ids and corrections without data (what doesn't fit the schema reads as null) are refused. Of several
    corrections of a document one is taken. With a doc_type, all data get their typed companions.
    """
    valid, new = corrections.filter("data IS NOT NULL"), "new_data"
    given = valid.groupBy("id").agg(F.max_by("data", F.to_json("data") if isinstance(valid.schema["data"].dataType, T.StructType) else F.col("data")).alias(new))
    hits, refused = _asked(docs, given, F.col("status").isin(CORRECTABLE))
    out = hits.join(given, "id", "left")
    data = F.when(F.col("hit"), F.col(new)).otherwise(F.col("data"))
    out = out.withColumns({"data": nested.postprocess(data, doc_type) if doc_type else data, "status": F.when(F.col("hit"), "needs_review").otherwise(F.col("status"))}).drop(new, "hit")
    empty = corrections.filter("data IS NULL AND id IS NOT NULL").select("id").distinct().join(given.select("id"), "id", "left_anti")
    return out, refused.unionByName(empty.select("id", F.lit("no valid data").alias("reason")))


def approve(docs: DataFrame, asked: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """asked (id) -> all documents after approval, and the refused (id, reason): only documents under review may be approved.

    links: what ``matching.link_items`` says of the documents' items. Documents that are approved by this get
    ``inventory_linked``, the number of their items with a match, where that is above 0.
    """
    hits, refused = _asked(docs, asked, F.col("status") == "needs_review")
    linked = F.lit(None).cast("long")
    if links is not None:
        n = links.groupBy(F.col("document_id").alias("id")).agg(F.nullif(F.count("inventory_match"), F.lit(0)).alias("n_linked"))
        hits, linked = hits.join(n, "id", "left"), F.when(F.col("hit"), F.col("n_linked"))
    out = hits.withColumns({"status": F.when(F.col("hit"), "approved").otherwise(F.col("status")), "inventory_linked": linked})
    return out.drop("hit", "n_linked"), refused


def pushable(docs: DataFrame, connectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (id, shop_id, status) -> those that may be pushed, and the refused (id, reason): not approved, or a shop without an enabled connector."""
    shops = connectors.filter("enabled").select("shop_id").distinct()
    approved = F.coalesce(F.col("status").isin(PUSHABLE), F.lit(False))
    lacking = docs.filter(approved).join(shops, "shop_id", "left_anti").select("id", F.lit("no connector").alias("reason"))
    refused = docs.filter(~approved).select("id", F.concat(F.lit("state "), F.coalesce("status", F.lit("unknown"))).alias("reason"))
    return docs.filter(approved).join(shops, "shop_id", "left_semi"), refused.unionByName(lacking)
