"""Catalogs from CSV files and JSON sources, with forgiving column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalize
from ..functions.values import to_float

FIELDS = ["name", "composition", "sku", "strength", "pack", "mrp", "stock_qty"]
#: CSV headers taken for each field.
CSV_ALIASES = {
    "name": ["name", "item", "item name", "itemname", "product", "medicine", "description", "stock item"],
    "composition": ["composition", "salt", "generic", "generic name", "molecule", "content", "contents"],
    "sku": ["sku", "code", "item code", "itemcode", "barcode"],
    "strength": ["strength", "dose", "dosage"],
    "pack": ["pack", "pack size", "packsize", "packing"],
    "mrp": ["mrp", "price", "rate", "mrp rs"],
    "stock_qty": ["stock", "qty", "quantity", "stock qty", "closing stock", "balance"],
}
#: JSON keys tried for each field, in order, whatever their case.
JSON_ALIASES = {
    "name": ["name", "item", "item_name", "itemName", "product", "medicine", "description", "stock_item"],
    "composition": ["composition", "salt", "generic", "generic_name", "molecule", "content", "contents"],
    "sku": ["sku", "code", "item_code", "itemCode", "barcode", "id"],
    "strength": ["strength", "dose", "dosage"],
    "pack": ["pack", "pack_size", "packSize", "packing"],
    "mrp": ["mrp", "price", "rate", "MRP"],
    "stock_qty": ["stock", "qty", "quantity", "stock_qty", "closing_stock", "balance", "onHand"],
}


def resolve_headers(columns: list[str]) -> dict[str, str]:
    """Column -> field, for the columns whose name is known."""
    field = {a: f for f, names in CSV_ALIASES.items() for a in names}
    return {c: field[k] for c in columns if (k := c.lstrip("﻿").strip().lower()) in field}


def as_catalog(records: DataFrame, shop_id) -> DataFrame:
    """Records with some of FIELDS as text -> catalog rows; blank names go, empty texts are null, stock without a number is 0."""
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in records.columns else F.lit(None).cast("string")
    name = F.trim(F.coalesce(text("name"), F.lit("")))
    rows = records.select(
        (shop_id if isinstance(shop_id, Column) else F.lit(shop_id)).alias("shop_id"), name.alias("name"), normalize(name).alias("normalized_name"),
        *[text(c).alias(c) for c in ("composition", "sku", "strength", "pack")], to_float(text("mrp")).alias("mrp"), F.coalesce(to_float(text("stock_qty")), F.lit(0.0)).alias("stock_qty"),
    )
    return rows.filter("name <> ''")


def read_csv(spark: SparkSession, path: str, shop_id) -> DataFrame:
    """A catalog from CSV; if two columns mean one field the last wins. Raises ValueError without a name column."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    last = {field: column for column, field in resolve_headers(df.columns).items()}
    if "name" not in last:
        raise ValueError("CSV needs a name column")
    return as_catalog(df.select(*[F.col(f"`{c}`").alias(f) for f, c in last.items()]), shop_id)


def dig(body: Column, path: str | None) -> Column:
    """The JSON text under a dotted path of objects."""
    return F.get_json_object(body, "$" + "".join(f"['{p}']" for p in path.split("."))) if path else body


def map_records(records: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """records (raw: map<string,string>) -> FIELDS. The mapping (field -> exact key) holds if it gives a name; else aliases fill in over it."""
    raw = F.col("raw")
    lower = F.map_from_entries(F.transform(F.map_entries(raw), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    r = records.withColumn("lower", lower)
    given = {f: F.element_at("raw", k) for f, k in (mapping or {}).items()}
    named = F.coalesce(given["name"], F.lit("")) != "" if "name" in given else F.lit(False)
    out = []
    for f in FIELDS:
        alias = F.coalesce(*[F.nullif(F.element_at("lower", k.lower()), F.lit("")) for k in JSON_ALIASES[f]])
        mine = given.get(f, F.lit(None).cast("string"))
        out.append(F.when(named, mine).otherwise(F.coalesce(alias, mine)).alias(f))
    return r.select(*out)


def parse_items(bodies: DataFrame, items_path: str | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """bodies (body: JSON text) -> FIELDS of each item object. Raises at run time if what is at the path is no list."""
    found = dig(F.col("body"), items_path)
    checked = F.when(F.trim(found).startswith("["), found).otherwise(F.raise_error(F.lit("source did not return a list of items")).cast("string"))
    items = bodies.select(F.explode(F.from_json(checked, "array<string>")).alias("item")).filter(F.trim("item").startswith("{"))
    raw = F.from_json("item", "map<string,string>")
    return map_records(items.select(F.map_from_entries(F.map_entries(raw)).alias("raw")), mapping)


def source_settings(settings: Column) -> Column:
    """A shop's saved source (JSON text with url, items_path, mapping, auth_header) as it may be shown: whether there is a secret, not which."""
    secret = F.get_json_object(settings, "$.auth_header")
    return F.struct(
        F.get_json_object(settings, "$.url").alias("url"), F.get_json_object(settings, "$.items_path").alias("items_path"),
        F.from_json(F.get_json_object(settings, "$.mapping"), "map<string,string>").alias("mapping"), F.coalesce(secret != "", F.lit(False)).alias("has_secret"),
    )
