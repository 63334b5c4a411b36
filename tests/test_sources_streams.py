import json

import pytest
from pyspark.sql import functions as F

from docloom.sources import catalog, rest, uploads
from docloom.streaming import queue, sinks


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Item Name,Code,MRP,Stock,Qty\nCalpol 500 Tab,7,"1,250.50",3,8\n  ,8,1,1,1\nDolo,,x,,\n', encoding="utf-8")
    got = [tuple(r) for r in catalog.read_csv(spark, str(tmp_path / "a.csv"), "s").select("shop_id", "name", "normalized_name", "sku", "mrp", "stock_qty").orderBy("name").collect()]
    assert got == [("s", "Calpol 500 Tab", "calpol 500", "7", 1250.5, 8.0), ("s", "Dolo", "dolo", None, None, 0.0)]
    (tmp_path / "b.csv").write_text("Code,MRP\n1,2\n")
    with pytest.raises(ValueError):
        catalog.read_csv(spark, str(tmp_path / "b.csv"), "s")


def test_json_records(spark):
    body = json.dumps({"data": {"items": [{"NAME": "", "Item_Name": "Calpol", "salt": "P", "quantity": 4, "x": None}, 5, {"t": "Own", "item": "Other", "price": "2"}]}})
    df = spark.createDataFrame([(body,)], "body string")
    got = [r.asDict() for r in catalog.parse_items(df, "data.items", {"name": "t"}).collect()]
    assert [g["name"] for g in got] == ["Calpol", "Own"] and got[0]["composition"] == "P" and got[0]["stock_qty"] == "4" and got[1]["mrp"] is None
    with pytest.raises(Exception, match="list of items"):
        catalog.parse_items(df, "data").collect()


def test_source_settings(spark):
    df = spark.createDataFrame([('{"url": "u", "items_path": "a.b", "mapping": {"name": "t"}, "auth_header": "k"}',), ("{}",), (None,)], "s string")
    got = [r[0].asDict() for r in df.select(catalog.source_settings(F.col("s"))).collect()]
    assert got[0] == {"url": "u", "items_path": "a.b", "mapping": {"name": "t"}, "has_secret": True} and got[1]["has_secret"] is got[2]["has_secret"] is False


def test_rest_source(spark):
    class Fake(rest.RestSource):
        @classmethod
        def name(cls):
            return "docloom_rest_fake"

        @staticmethod
        def get(url, headers, timeout):
            import json

            return json.dumps([{"product": url, "code": headers.get("Authorization")}])

    got = rest.pull(spark, "http://a http://b", source=Fake, auth_header="k").orderBy("name").collect()
    assert [(r["name"], r["sku"]) for r in got] == [("http://a", "k"), ("http://b", "k")]


def test_uploads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    (tmp_path / "in" / "b.txt").write_bytes(b"y")
    f = uploads.load(spark, str(tmp_path / "in"), "*.pdf").drop("content").withColumn("doc_type", F.lit("invoice"))
    more = [("b.png", "image/png", 0, "invoice"), ("c", "text/plain", 1, "invoice"), ("d", "image/png", 1 << 30, "invoice"), ("e", "image/png", 1, None), ("f", None, None, None)]
    good, bad = uploads.validate(f.unionByName(spark.createDataFrame(more, "name string, content_type string, bytes long, doc_type string")))
    assert [r["name"] for r in good.collect()] == ["a.pdf"]
    assert {r["name"]: r["reason"] for r in bad.collect()} == {"b.png": "empty", "c": "content type", "d": "too large", "e": "document type", "f": "content type"}


ITEMS = "device int, id int, status string, attempts int, created_ms long"


def test_queue_tables(spark):
    day = queue.TTL_MS
    df = spark.createDataFrame([(1, 1, "done", 0, 0), (1, 2, "error", 5, 1), (1, 3, "error", 4, 2), (1, 4, "queued", 0, 3), (2, 5, "uploading", 0, 0), (3, 6, "done", 0, 1)], ITEMS)
    assert sorted((r["device"], r["id"]) for r in queue.next_pending(df).collect()) == [(1, 3), (2, 5)]
    assert {r[0]: r[1] for r in queue.pending_count(df).collect()} == {1: 3, 2: 1, 3: 0}
    assert sorted(r["id"] for r in queue.prune(df, day).collect()) == [2, 3, 4, 5, 6]


def test_queue_stream(spark, tmp_path):
    src, out = tmp_path / "events", str(tmp_path / "out")
    src.mkdir()
    schema = "device long, id long, action string, at_ms long"
    stream = queue.fold(spark.readStream.schema(schema).json(str(src)))

    def drain():
        w = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").json(out))
        w.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    put = lambda name, rows: (src / name).write_text("\n".join(json.dumps(dict(zip(["device", "id", "action", "at_ms"], r, strict=True))) for r in rows))
    put("a.json", [(1, 1, "enqueue", 1), (1, 2, "enqueue", 2), (1, 1, "error", 3), (2, 9, "enqueue", 1)])
    drain()
    first = {r["device"]: (r["pending"], r["next_id"]) for r in spark.read.json(out).collect()}
    assert first == {1: (2, 1), 2: (1, 9)}
    put("b.json", [(1, 1, "done", 4), (1, 3, "enqueue", queue.TTL_MS + 5)])
    drain()
    assert {(r["pending"], r["next_id"], r["dropped"]) for r in spark.read.json(out).filter("device = 1").collect()} == {(2, 1, 0), (2, 2, 1)}


def test_webhook(spark):
    def post(url, body, headers):
        assert headers["X-Signature"].startswith("sha256=") and headers["X-Payload-Version"] == "1.0"
        if "down" in body:
            raise OSError("no route")
        return (200, "x" * 3000) if "fine" in body else (400, "no")

    df = spark.createDataFrame([("a", '{"x": "fine"}'), ("b", '{"x": "bad"}'), ("c", '{"x": "down"}')], "document_id string, body string")
    got = {r["document_id"]: r for r in sinks.post_webhook(df, "u", "k", post, sleep=lambda s: None).collect()}
    assert (got["a"]["status"], got["a"]["attempts"], len(got["a"]["response_body"])) == ("success", 1, 2000)
    assert (got["b"]["status"], got["b"]["attempts"], got["b"]["response_code"]) == ("failed", 3, 400)
    assert got["c"]["response_code"] is None and got["c"]["response_body"] == "no route"
    assert {r["status"] for r in sinks.post_webhook(df, "", "k", post).collect()} == {"failed"}


def test_provider_failures_are_kept(spark):
    def provider(kind, text):
        if not text:
            raise ValueError("no text")
        return {"doc_type": kind, "n": len(text)}

    df = spark.createDataFrame([("a", 0, "invoice", "xy"), ("a", 1, "invoice", "")], "document_id string, chunk int, doc_type string, text string")
    got = sinks.extract(df, provider).orderBy("chunk").collect()
    assert json.loads(got[0]["fields"]) == {"doc_type": "invoice", "n": 2} and got[1]["error"] == "no text" and got[1]["fields"] is None


def test_audit_and_agent(spark, tmp_path):
    path = str(tmp_path / "audit")
    df = spark.createDataFrame([("d1", "s")], "document_id string, shop_id string")
    sinks.audit(df, "document.submit", path)
    sinks.audit(df, "document.push", path)
    assert sorted(r["action"] for r in spark.read.parquet(path).collect()) == ["document.push", "document.submit"]
    assert sinks.enqueue_for_agent(df).first()["status"] == "pending"


def test_webhook_sends_once(spark, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()
    folder = str(sent)

    def post(url, body, headers):
        import uuid

        with open(f"{folder}/{uuid.uuid4()}", "w") as f:
            f.write(headers["Idempotency-Key"])
        return 200, "ok"

    df = spark.createDataFrame([("a", "{}", "a:1", "webhook"), ("b", "{}", "b:1", "webhook"), ("c", "{}", "c:2", "desktop_agent"), ("d", "{}", "d:3", "fax"), ("e", "{}", "e:4", None)], "document_id string, body string, idempotency_key string, connector_type string")
    send = lambda x: sinks.dispatch(x, {"webhook": lambda w: sinks.post_webhook(w, "u", None, post), "desktop_agent": sinks.enqueue_for_agent})
    for _ in range(2):
        got = sinks.deliver_once(df, send, str(tmp_path / "results"))
        assert {(r["idempotency_key"], r["status"]) for r in got.collect()} == {("a:1", "success"), ("b:1", "success"), ("c:2", "pending"), ("d:3", "failed"), ("e:4", "failed")} and got.count() == 5
    assert sorted(f.read_text() for f in sent.iterdir()) == ["a:1", "b:1"]


def test_agent_polls_writes_and_acknowledges(spark, tmp_path):
    from test_operators import invoice

    docs = invoice(spark).withColumn("payload", F.struct("document_id"))
    d = spark.createDataFrame([(1, "d1", "k", "pending", 1), (2, "d2", "k", "pending", 2), (3, "gone", "k", "pending", 3), (4, "d1", "other", "pending", 0), (5, "d1", "k", "failed", 0)], "id int, document_id string, connector_id string, status string, created_at int")
    out = str(tmp_path / "files")
    state = lambda x: {r["id"]: r["status"] for r in x.collect()}
    first = sinks.poll_agent(d, docs, "k", "invoice", out, limit=1)
    assert state(first) == {1: "success", 2: "pending", 3: "pending", 4: "pending", 5: "failed"}
    for _ in range(2):
        assert state(sinks.poll_agent(first, docs, "k", "invoice", out)) == {1: "success", 2: "success", 3: "pending", 4: "pending", 5: "failed"}
    assert sorted(p.name for p in (tmp_path / "files").iterdir()) == ["d1.csv", "d1.json", "d2.json"]


def test_ingest_keeps_page_order_and_counts_failed_pages(spark):
    def provider(kind, text):
        if "bad" in text:
            raise ValueError("unreadable")
        return {"supplier": {"name": {"value": text.split()[0], "confidence": 0.9}}, "line_items": [{"description": {"value": w, "confidence": 0.5}} for w in text.split()]}

    pages = [("x", "invoice", p, f"p{p}") for p in range(5)] + [("y", "invoice", p, "bad" if p == 2 else f"q{p}") for p in (3, 2, 1, 0)] + [("z", "invoice", p, f"r{p}" + " " * 9 + "w" * 300) for p in range(7)] + [("n", "invoice", 0, None)]
    df = spark.createDataFrame(pages, "document_id string, doc_type string, page int, text string").repartition(3)
    got = {r["document_id"]: r for r in sinks.ingest(df, provider, "invoice").collect()}
    said = lambda d: [i["description"]["value"][:2] for i in got[d]["line_items"]]
    assert said("x") == ["p0", "p1", "p2", "p3", "p4"] and got["x"]["pages_failed"] == 0 and got["x"]["supplier"]["name"]["value"] == "p0"
    assert said("y") == ["q0", "q1"] and got["y"]["pages_failed"] == 2
    assert [w for w in said("z") if w[0] == "r"] == [f"r{p}" for p in range(7)] and got["n"]["pages_failed"] == 1 and got["n"]["item_count"] == 0


def test_retry_all(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "error", 5, 1), (1, 2, "done", 0, 2)], ITEMS)
    assert sorted((r["id"], r["status"], r["attempts"]) for r in queue.retry_all(df).collect()) == [(1, "queued", 5), (2, "done", 0)]
    src, out = tmp_path / "events", str(tmp_path / "out")
    src.mkdir()
    rows = [(1, 1, "enqueue", 1), (1, 2, "enqueue", 2), *[(1, 1, "error", t) for t in range(3, 8)], (1, 0, "retry_all", 9)]
    (src / "a.json").write_text("\n".join(json.dumps(dict(zip(["device", "id", "action", "at_ms"], r, strict=True))) for r in rows))
    stream = queue.fold(spark.readStream.schema("device long, id long, action string, at_ms long").json(str(src)))
    stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").json(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [(r["pending"], r["next_id"]) for r in spark.read.json(out).collect()] == [(2, 1)]


def test_run_batches(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.json").write_text('{"document_id": "a", "body": "{}"}')
    stream = spark.readStream.schema("document_id string, body string").json(str(src))
    step = lambda b, n: sinks.deliver_once(b, sinks.enqueue_for_agent, f"{out}/batch={n}")
    for _ in range(2):
        sinks.run_batches(stream, step, str(tmp_path / "state")).awaitTermination()
    assert [(r["document_id"], r["status"]) for r in spark.read.parquet(out).collect()] == [("a", "pending")]
