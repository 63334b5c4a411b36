"""A REST source for Spark: ``spark.read.format("docloom_rest")`` with url, auth_header and timeout; one row a response body."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .catalog import parse_items


def http_get(url: str, headers: dict[str, str], timeout: float) -> str:
    with urlopen(Request(url, headers=headers), timeout=timeout) as r:
        return r.read().decode("utf-8")


class RestReader(DataSourceReader):
    def __init__(self, options: dict[str, str], get: Callable) -> None:
        self.urls, self.get = options["url"].split(" "), get
        self.headers = {"Authorization": options["auth_header"]} if options.get("auth_header") else {}
        self.timeout = float(options.get("timeout", 20))

    def partitions(self) -> list[InputPartition]:
        """A task a page: several urls are separated by spaces."""
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield partition.value, self.get(partition.value, self.headers, self.timeout)


class RestSource(DataSource):
    get = staticmethod(http_get)

    @classmethod
    def name(cls) -> str:
        return "docloom_rest"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return RestReader(self.options, type(self).get)


def pull(spark: SparkSession, url: str, items_path: str | None = None, mapping: dict[str, str] | None = None, source: type[DataSource] = RestSource, **options: str) -> DataFrame:
    """Catalog fields of the items that the source returns; give a subclass with another ``get`` for tests."""
    spark.dataSource.register(source)
    return parse_items(spark.read.format(source.name()).options(url=url, **options).load(), items_path, mapping)
