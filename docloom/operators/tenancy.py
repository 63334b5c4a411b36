"""Reads of a tenant's rows: the tenant predicate always applies and reaches the scan; then optional filters, order, page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize


@dataclass(frozen=True)
class TenantScope:
    """All reads through a scope see its shop only. Tables partitioned by the column are pruned."""

    shop_id: object
    column: str = "shop_id"

    def of(self, table: DataFrame) -> DataFrame:
        return table.filter(F.col(self.column) == F.lit(self.shop_id))

    def page(self, table: DataFrame, limit: int = 50, offset: int = 0, newest: str = "created_at", key: str = "id", **equal) -> DataFrame:
        """Newest first, ties by key; equal: columns that must have a value, where one is given."""
        df = self.of(table)
        for name, value in equal.items():
            if value is not None:
                df = df.filter(F.col(name) == value)
        return df.orderBy(F.desc(newest), key).offset(max(offset, 0)).limit(min(max(limit, 1), 200))

    def one(self, table: DataFrame, key: str, value) -> DataFrame:
        return self.of(table).filter(F.col(key) == value).limit(1)

    def search_catalog(self, catalog: DataFrame, q: str = "", limit: int = 100) -> DataFrame:
        return search_catalog(self.of(catalog), q, limit)

    def count(self, catalog: DataFrame) -> DataFrame:
        return self.of(catalog).agg(F.count("*").alias("count")).withColumn("connected", F.col("count") > 0)


def search_catalog(catalog: DataFrame, q: str = "", limit: int = 100) -> DataFrame:
    """Items whose normal name contains the query's (an empty one matches all), by name and id."""
    wanted = normalize(F.lit(q))
    return catalog.filter(F.contains("normalized_name", wanted)).orderBy("name", "id").limit(min(max(limit, 1), 500))


def mentions(q: str, *columns: str) -> Column:
    """Any of the columns, lower case, contains the query."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c).cast("string")), F.lit(q.lower()))
    return hit


def unpaired(connectors: DataFrame, code: str) -> DataFrame:
    """Connectors with this pairing code, whatever its case, that are not paired yet; config is JSON text."""
    has = F.upper(F.get_json_object("config", "$.pairing_code")) == code.strip().upper()
    return connectors.filter(has & ~F.coalesce(F.get_json_object("config", "$.paired") == "true", F.lit(False)))
