from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_dedup_with_maps_and_variants(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (3, "other words here", "en", "a", 1), (3, "other words here", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("v", F.parse_json(F.lit('{"a": 1}')))
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted((r["doc_id"], r["m"]["k"]) for r in got.collect()) == [(1, 1), (3, 3)] and got.columns == docs.columns


def test_no_row_comes_more_often_than_allowed(spark):
    rows = [(k, None if k % 3 else "", "en", "a", 0) for k in range(60)] + [(100 + k, "one two three", "en", "b" if k else "a", 1) for k in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    copies = mixing.mixture(docs).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in copies) <= 2
    assert mixing.mix(docs).filter("copies > 2").isEmpty()
