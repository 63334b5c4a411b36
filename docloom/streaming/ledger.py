"""Effects of a stream's batches, each once, however often a batch is run.

``path`` holds, a batch: what was ``due``, what ``sent`` answered (the ledger), the ``audit`` and an ``ended`` mark. Each
is written as a whole or not at all, after the one before; a batch that is run again reads what is whole and goes on from there.

* Keys that an earlier batch sent with success, or that an agent still has, are not due again; of several payloads of one
  key in a batch the one with the largest document id and body is.
* The audit is the ledger's rows, so sending and audit can't differ.
* The acknowledgement comes last and may be called twice, if the crash is between it and the mark; it sees the same rows.
* A crash while sending sends again what the batch had not written down, with the same idempotency keys in the header. Once the
  ledger is whole, nothing is sent again.

Rows without a key are sent, one a document; empty batches leave no trace but the mark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import is_whole
from .sinks import run_batches

#: Answers after which a key is done with.
SETTLED = ["success", "pending"]
LEDGER = "idempotency_key string, document_id string, status string, response_code int, response_body string, attempts int"


def _step(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made if it isn't whole."""
    if not is_whole(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def settled(spark: SparkSession, path: str, before: int, back: int | None = None) -> DataFrame:
    """Keys that batches before this one (the last ``back`` of them, if given) are done with."""
    sent = sent_rows(spark, path).filter((F.col("batch") < before) & F.col("status").isin(SETTLED))
    return (sent.filter(F.col("batch") >= before - back) if back else sent).select("idempotency_key")


def sent_rows(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: an answer a key and batch, of batches that were written down."""
    return _all(spark, f"{path}/sent", LEDGER)


def audit_rows(spark: SparkSession, path: str) -> DataFrame:
    return _all(spark, f"{path}/audit", "at timestamp, action string, target string, idempotency_key string")


def _all(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All whole batches of a kind. A batch in the making has its files under ``_temporary``, which no read sees."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def effects(payloads: DataFrame, batch: int, send: Callable[[DataFrame], DataFrame], path: str, acknowledge: Callable[[DataFrame], None], back: int | None = None) -> None:
    """One batch: payloads (document_id, body, idempotency_key) are sent, audited and acknowledged."""
    spark = payloads.sparkSession
    at = lambda what: f"{path}/{what}/batch={batch}"
    if is_whole(spark, at("ended")):
        return

    def due() -> DataFrame:
        key = F.coalesce("idempotency_key", F.concat(F.lit("document "), F.coalesce(F.col("document_id").cast("string"), F.lit(""))))
        once = payloads.withColumn("idempotency_key", key).groupBy("idempotency_key").agg(F.max(F.struct(F.col("document_id").cast("string").alias("document_id"), "body")).alias("p"))
        return once.select("idempotency_key", "p.*").join(settled(spark, path, batch, back), "idempotency_key", "left_anti")

    def sent() -> DataFrame:
        return send(todo).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in LEDGER.split(", ")])

    todo = _step(spark, at("due"), due)
    ledger = _step(spark, at("sent"), sent)
    told = [F.current_timestamp().alias("at"), F.concat(F.lit("deliver "), "status").alias("action"), F.col("document_id").alias("target"), F.col("idempotency_key")]
    _step(spark, at("audit"), lambda: ledger.select(*told))
    acknowledge(ledger)
    _step(spark, at("ended"), lambda: ledger.agg(F.count("*").alias("n")))


def deliver(stream: DataFrame, send: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, acknowledge: Callable[[DataFrame], None] = lambda rows: None, seconds: int | None = None, back: int | None = None):
    """Starts a stream of payloads whose batches have their effects once."""
    return run_batches(stream, lambda df, n: effects(df, n, send, path, acknowledge, back), checkpoint, seconds)
