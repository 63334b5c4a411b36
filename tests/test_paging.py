import datetime
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators.paging import page_after, write_clustered

DAY = datetime.datetime(2024, 1, 1)


def made(n):
    rng = random.Random(4)
    return [(k, rng.randint(0, 2), DAY + datetime.timedelta(hours=rng.randint(0, n // 4)), f"v{k}") for k in range(n)] + [(9_000, None, DAY, "x"), (9_001, 1, None, "x"), (None, 1, DAY, "x")]


@pytest.mark.parametrize(("per_file", "limit"), [(7, 5), (7, 40), (1_000, 13)])
def test_walk_over_all_pages(spark, tmp_path, per_file, limit):
    rows, path = made(300), str(tmp_path / "t")
    write_clustered(spark.createDataFrame(rows, "id long, shop int, created timestamp, newest string").withColumn("tenant", F.lit("clash")), path, "shop", "created", "id", per_file, 4)
    for shop in (0, 1, 7):
        want = [(c, k) for c, k in sorted(((c, k) for k, s, c, _ in rows if s == shop and c and k is not None), reverse=True)]
        got, after, reads = [], None, set()
        while True:
            page = page_after(spark, path, "shop", shop, "created", "id", after, limit)
            part = [(r["created"], r["id"]) for r in page.collect()]
            if not part:
                break
            reads.add(len(page.inputFiles()))
            got, after = got + part, part[-1]
        assert got == want
        assert not reads or max(reads) <= -(-limit // 1) + 1


def test_a_late_page_reads_as_little_as_the_first(spark, tmp_path):
    path = str(tmp_path / "t")
    d = spark.range(20_000).select("id", F.lit(1).alias("shop"), (F.lit(DAY) + F.make_dt_interval(secs=F.col("id"))).alias("created"))
    write_clustered(d, path, "shop", "created", "id", 100, 4)

    def read(after):
        page = page_after(spark, path, "shop", 1, "created", "id", after, 50)
        return [r["id"] for r in page.collect()], len(page.inputFiles())

    first, files = read(None)
    late, late_files = read((DAY + datetime.timedelta(seconds=1_000), 1_000))
    assert first == list(range(19_999, 19_949, -1)) and late == list(range(999, 949, -1))
    assert files <= 2 and late_files <= 2
