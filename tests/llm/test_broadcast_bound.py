import corpus_pipeline
from docloom.llm import common, jaccard, simhash


def test_more_keys_than_the_bound_are_not_broadcast(spark):
    """However few bytes Catalyst takes them for."""
    keys, rows = (common.cut(spark.range(n)) for n in (20, 1_000))
    plan = lambda most: rows.join(common.if_few(keys, most), "id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(20) and "Broadcast" not in plan(19)


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(6)]
    rows = [(k, texts[k % 6] + (" more" if k >= 12 else ""), "s") for k in range(18)] + [(None, texts[0], "s"), (3, texts[4], "s"), (40, None, "s"), (41, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    monkeypatch.setattr(common.if_few, "__defaults__", (0,))
    assert sorted(corpus_pipeline.near_dedup(spark, docs, "").collect(), key=str) == sorted(kept, key=str)
    assert sorted(r["doc_id"] for r in kept) == [0, 1, 2, 3, 3, 5, 40]


def test_near_duplicates_broadcast_counted_tables_only(spark, monkeypatch):
    """Joins took the 49 look-ups of each fingerprint for as many bytes as the fingerprints, and broadcast them."""
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    docs = spark.createDataFrame([(k, texts[k % 6] + " more" * (k // 12), "s") for k in range(30)], "doc_id long, text string, source string")
    monkeypatch.setattr(common.if_few, "__defaults__", (-1,))  # empty tables neither
    monkeypatch.setattr(jaccard, "PAIRS", -1)
    runs = spark._jsparkSession.sharedState().statusStore()
    before = runs.executionsCount()
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 6
    plans = [runs.executionsList().apply(k).physicalPlanDescription() for k in range(before, runs.executionsCount())]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_fingerprints_broadcast_counted_tables_only(spark):
    fps = common.cut(spark.range(500).selectExpr("xxhash64(id) AS fp", "1L AS copies"))
    near = simhash.pivot_links(fps)
    near.collect()
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
