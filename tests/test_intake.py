import itertools
import random

from pyspark.sql import functions as F

from docloom.streaming import intake, sinks

SCHEMA = "document_id string, doc_type string, page int, pages int, text string, at timestamp"


def test_equal_to_the_batch_in_any_order_with_restarts(spark, tmp_path):
    def provider(kind, text):
        if "bad" in text:
            raise ValueError("unreadable")
        return {"supplier": {"name": {"value": text.split()[0] if text.split() else "", "confidence": 0.9}}, "line_items": [{"description": {"value": w, "confidence": 0.5}} for w in text.split()]}

    whole = [(d, "invoice", p, n, f"{d}{p} w{p}" if (d, p) != ("c", 1) else None) for d, n in (("a", 1), ("b", 7), ("c", 3)) for p in range(n)] + [("f", "invoice", p, 2, "bad") for p in range(2)]
    lost = [("x", "invoice", p, 3, "t") for p in (0, 2)]
    odd = [(None, "invoice", 0, 1, "t"), ("y", "invoice", 5, 2, "t"), ("y", "invoice", None, 2, "t"), ("b", "invoice", 0, 7, "zzz sent again")]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    random.Random(1).shuffle(pages := whole + lost)
    put = lambda rows, at: spark.createDataFrame([(*r, None) for r in rows], SCHEMA).withColumn("at", F.lit(at).cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    stream = None
    for rows in itertools.batched(pages, 5):
        put(rows, "2024-01-01 00:00:00")
        stream = stream or spark.readStream.schema(SCHEMA).parquet(src)
        intake.take_in(stream, provider, "invoice", out, state, 60_000).awaitTermination()
    put(odd, "2024-01-01 00:00:30")
    put([("later", "invoice", 0, 2, "t")], "2024-01-01 01:00:00")
    intake.take_in(stream, provider, "invoice", out, state, 60_000).awaitTermination()
    got = {r["document_id"]: r.asDict(recursive=True) for r in intake.results(spark, out).collect()}
    assert set(got) == {"a", "b", "c", "f", "x"}
    want = sinks.ingest(spark.createDataFrame([(*r[:3], r[4]) for r in whole], "document_id string, doc_type string, page int, text string"), provider, "invoice")
    for r in want.collect():
        one = r.asDict(recursive=True)
        assert {k: got[one["document_id"]][k] for k in one} == one
    assert {d: (r["status"], r["error"]) for d, r in got.items()} == {"a": ("needs_review", None), "b": ("needs_review", None), "c": ("needs_review", None), "f": ("failed", "no page could be read"), "x": ("failed", "2 of 3 pages came")}
    assert spark.read.parquet(out).groupBy("document_id").count().filter("count > 1").isEmpty()


def test_few_columns_reach_the_step_and_texts_come_through(spark, tmp_path):
    odd = ['"quoted" \\ {"a": 1}', "two\nlines\ttab\r\x01\x00", "é \U0001f600  ", "", None]
    rows = [("odd", None if k else "invoice", k, len(odd), t) for k, t in enumerate(odd)]
    pages = spark.createDataFrame(rows, "document_id string, doc_type string, page int, pages int, text string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    pages.write.parquet(path := f"{tmp_path}/pages")
    whole = intake.assemble(spark.readStream.schema(pages.schema).parquet(path), 1_000)
    assert whole._jdf.queryExecution().analyzed().children().head().output().size() <= 3
    q = whole.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("page").collect()
    assert [(r["page"], r["text"], r["doc_type"], r["error"]) for r in got] == [(k, t or "", "invoice", None) for k, t in enumerate(odd)]
