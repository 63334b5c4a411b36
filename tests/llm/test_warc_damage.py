"""Archives that were damaged in writing."""

import gzip

import pytest

from docloom.llm import warc


def test_damaged_payload_is_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/c", "payload " * 40)], "page_id long, url string, html string")
    path = tmp_path / "w"
    warc.write_warc(pages, str(path))
    assert warc.read_index(spark, str(path)).count() == 1
    hit = 0
    for n, file in enumerate(sorted(path.glob("*.gz"))):
        data = gzip.decompress(file.read_bytes())
        hit += b"payload payload" in data
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / f"{n}.txt.gz").write_bytes(gzip.compress(data.replace(b"payload payload", b"payload pay1oad", 1)))
    assert hit == 1
    with pytest.raises(Exception, match="payload damaged"):
        warc.read_index(spark, str(tmp_path / "d")).collect()
