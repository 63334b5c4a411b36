import os

import pytest
from pyspark.sql import functions as F

from docloom.operators import buckets, lifecycle


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if "_bucket=" in d and "_aside" not in d and f.endswith(".parquet")}


def table(spark, path, n=200):
    rows = spark.range(n).select("id", F.lit("pending").alias("status"), F.lit("x").alias("name")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 'pending', 'none'"))
    buckets.write_bucketed(rows, path, "id", 16)
    return rows


def test_other_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = table(spark, path)
    before = files(path)
    acks = spark.createDataFrame([(3,), (77,), (9_999,)], "id long")
    touched = buckets.update(spark, path, acks, lifecycle.acknowledge, "one")
    after = files(path)
    of = {r["b"] for r in acks.filter("id < 200").select(buckets.bucket(F.col("id"), 16).alias("b")).collect()}
    assert of <= set(touched) and len(touched) <= 3
    kept = {f for f in before if not any(f"/_bucket={b}/" in f for b in touched)}
    assert kept and all(after[f] == before[f] for f in kept) and not (set(before) - kept) & set(after)
    got = sorted(map(tuple, buckets.read_bucketed(spark, path).collect()), key=str)
    assert got == sorted(map(tuple, lifecycle.acknowledge(rows, acks).select(*rows.columns).collect()), key=str)
    assert buckets.update(spark, path, acks, lambda old, _: old.limit(0), "one") == [] and files(path) == after


@pytest.mark.parametrize("at", ["_replace", "remove"])
def test_an_update_cut_short_is_finished_by_the_next_call(spark, tmp_path, monkeypatch, at):
    path = str(tmp_path / "t")
    table(spark, path)
    acks = spark.createDataFrame([(5,), (6,), (7,)], "id long")
    was = getattr(buckets, at)

    def broken(s, a, *b):
        if at == "_replace":  # half of the old buckets are gone
            for n in (0, 1, *[r["b"] for r in acks.select(buckets.bucket(F.col("id"), 16).alias("b")).collect()][:2]):
                if os.path.isdir(f"{a}/_bucket={n}"):
                    buckets.remove(s, f"{path}/_bucket={n}")
        raise OSError("lost")

    monkeypatch.setattr(buckets, at, broken)
    with pytest.raises(OSError, match="lost"):
        buckets.update(spark, path, acks, lifecycle.acknowledge, "u")
    monkeypatch.setattr(buckets, at, was)
    buckets.update(spark, path, acks, lifecycle.acknowledge, "u")
    got = buckets.read_bucketed(spark, path)
    assert got.count() == 201 and {r["id"] for r in got.filter("status = 'success'").collect()} == {5, 6, 7}


def test_rows_come_and_go(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path, 3)
    new = spark.createDataFrame([(50,), (None,)], "id long")
    buckets.update(spark, path, new, lambda old, c: old.unionByName(c.filter("id IS NOT NULL").select("id", F.lit("new").alias("status"), F.lit("y").alias("name"))), "in")
    assert sorted(str(r["id"]) for r in buckets.read_bucketed(spark, path).collect()) == ["0", "1", "2", "50", "None"]
    gone = spark.createDataFrame([(50,), (1,), (None,)], "id long")
    buckets.update(spark, path, gone, lambda old, c: old.join(c, old["id"].eqNullSafe(c["id"]), "left_anti"), "out")
    assert sorted(r["id"] for r in buckets.read_bucketed(spark, path).collect()) == [0, 2]
    assert buckets.update(spark, path, gone.limit(0), lambda old, c: old, "none") == []
