import os

import pytest
from pyspark.sql import functions as F

from docloom.streaming import ledger

STEPS = ["due", "sent", "audit", "ended"]


def payloads(spark, rows):
    return spark.createDataFrame(rows, "document_id string, body string, idempotency_key string")


@pytest.mark.parametrize("cut", [*STEPS, "acknowledge"])
@pytest.mark.parametrize("after", [False, True])
def test_a_crash_between_any_two_steps(spark, tmp_path, monkeypatch, cut, after):
    path, log, acked = str(tmp_path / "x"), tmp_path / "log", []
    log.mkdir()

    def send(todo):
        def run(frames):
            for f in frames:
                for k in f["idempotency_key"]:
                    name = log / k.replace("/", "_")
                    name.write_text(str(int(name.read_text()) + 1 if name.exists() else 1))
                yield f[["idempotency_key", "document_id"]].assign(status=["failed" if k == "d3/c" else "success" for k in f["idempotency_key"]])

        out = todo.coalesce(1).mapInPandas(run, "idempotency_key string, document_id string, status string")
        return out.select("*", F.lit(200).alias("response_code"), F.lit("ok").alias("response_body"), F.lit(1).alias("attempts"))

    was, crashed = ledger._step, []

    def step(s, at, make):
        hit = f"/{cut}/" in at and "batch=1" in at and not crashed
        if hit and not after:
            crashed.append(1)
            raise OSError("lost")
        out = was(s, at, make)
        if hit:
            crashed.append(1)
            raise OSError("lost")
        return out

    def acknowledge(rows):
        now = cut == "acknowledge" and len(acked) == 1 and not crashed
        if now and not after:
            crashed.append(1)
            raise OSError("lost")
        acked.append(sorted(r["idempotency_key"] for r in rows.collect()))
        if now:
            crashed.append(1)
            raise OSError("lost")

    monkeypatch.setattr(ledger, "_step", step)
    first = payloads(spark, [("d1", "{}", "d1/c"), ("d2", "{}", "d2/c"), ("d3", "{}", "d3/c"), ("d1", "{}", "d1/c")])
    second = payloads(spark, [("d1", "{}", "d1/c"), ("d3", "{}", "d3/c"), ("d4", "{}", "d4/c"), ("d5", "{}", None), (None, None, None)])
    ledger.effects(first, 0, send, path, acknowledge)
    for _ in range(3):
        try:
            ledger.effects(second, 1, send, path, acknowledge)
        except OSError:
            pass
    assert len(crashed) == 1
    # the failed one is due again, the others are sent once
    assert {f: int((log / f).read_text()) for f in os.listdir(log)} == {"d1_c": 1, "d2_c": 1, "d3_c": 2, "d4_c": 1, "document d5": 1, "document ": 1}
    assert sorted((r["batch"], r["idempotency_key"]) for r in ledger.audit_rows(spark, path).collect()) == sorted((r["batch"], r["idempotency_key"]) for r in ledger.sent_rows(spark, path).collect())
    assert ledger.audit_rows(spark, path).count() == 7
    want = ["d3/c", "d4/c", "document ", "document d5"]
    # an acknowledgement may come twice, with the same rows
    assert acked[0] == ["d1/c", "d2/c", "d3/c"] and all(a == want for a in acked[1:]) and 1 <= len(acked) - 1 <= 2


def test_no_rows_and_a_window(spark, tmp_path):
    path = str(tmp_path / "x")
    send = lambda t: t.select("idempotency_key", "document_id", F.lit("success").alias("status"), F.lit(None).cast("int").alias("response_code"), F.lit("").alias("response_body"), F.lit(0).alias("attempts"))
    one = payloads(spark, [("a", "x", "k")])
    for n, rows in enumerate([one, one.limit(0), one, one]):
        ledger.effects(rows, n, send, path, lambda r: None, back=2)
    assert [r["batch"] for r in ledger.sent_rows(spark, path).orderBy("batch").collect()] == [0, 3]  # two batches back no more
