"""A feed of numbered pages as a stream: ``spark.readStream.format("docloom_feed")`` with url, auth_header and timeout.

``<url>/latest.json`` says how many pages there are ({"pages": n}); ``<url>/<k>.json`` is the array of page k, from 0, and
never changes. The offset is the number of pages read, so a stream that starts again reads on where its checkpoint says;
a page is a task. What Spark has processed is acknowledged to ``<url>/acknowledged.json`` as the offset it is. Spark tells so when the
next batch begins; ``poll`` also does after its last one, from what is written.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .named_files import open_store
from .rest import http_get


def http_put(url: str, body: str, headers: dict[str, str], timeout: float) -> None:
    with urlopen(Request(url, body.encode(), {**headers, "Content-Type": "application/json"}, method="PUT"), timeout=timeout):
        pass


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], get: Callable, put: Callable) -> None:
        self.url, self.timeout = options["url"].rstrip("/"), float(options.get("timeout", 20))
        self.headers = {"Authorization": options["auth_header"]} if options.get("auth_header") else {}
        self._get, self._put = get, put

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": int(json.loads(self._get(f"{self.url}/latest.json", self.headers, self.timeout))["pages"])}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [InputPartition(k) for k in range(start["pages"], end["pages"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for item in json.loads(self._get(f"{self.url}/{partition.value}.json", self.headers, self.timeout)):
            yield partition.value, json.dumps(item)

    def commit(self, end: dict) -> None:
        self._put(f"{self.url}/acknowledged.json", json.dumps(end), self.headers, self.timeout)


class FeedSource(DataSource):
    get, put = staticmethod(http_get), staticmethod(http_put)

    @classmethod
    def name(cls) -> str:
        return "docloom_feed"

    def schema(self) -> str:
        return "page long, item string"

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options, type(self).get, type(self).put)


def _read(url: str, headers: dict[str, str], timeout: float) -> str:
    store, path = open_store(url)
    with store.open_input_stream(path) as f:
        return f.read().decode()


def _write(url: str, body: str, headers: dict[str, str], timeout: float) -> None:
    store, path = open_store(url)
    with store.open_output_stream(path) as f:
        f.write(body.encode())


class FolderFeed(FeedSource):
    """A feed that lies in a folder which all executors share."""

    get, put = staticmethod(_read), staticmethod(_write)

    @classmethod
    def name(cls) -> str:
        return "docloom_folder_feed"


def poll(spark: SparkSession, url: str, out: str, checkpoint: str, source: type[FeedSource] = FeedSource, **options: str) -> DataFrame:
    """Takes in what is new since the last poll, writes it to ``out``/batch=<number>, acknowledges it; gives all that was taken in.

    A poll that is cut short between any two steps is made good by the next: a batch that is done again replaces itself, and
    what is acknowledged is what is written.
    """
    spark.dataSource.register(source)
    stream = spark.readStream.format(source.name()).options(url=url, **options).load()
    w = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    w.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    taken = spark.read.schema("page long, item string, batch long").parquet(out)
    last = taken.agg(F.max("page")).first()[0]
    if last is not None:
        source({"url": url, **options}).streamReader(None).commit({"pages": last + 1})
    return taken
