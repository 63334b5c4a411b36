"""The driver's tables seen as this engine's entities: catalogs from part, invoices from orders and lineitem, deliveries from events.

Each comes twice: as a DataFrame, and as the SQL that says the same to another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", F.concat(F.col("p_size").cast("string"), F.lit("mg Tab")))
    return p.select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7).alias("shop_id"), F.col("p_brand").alias("sku"), name.alias("name"), normalize(name).alias("normalized_name"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", F.lower("p_name"), F.lower("p_type"))).alias("composition"), F.col("p_size").cast("string").alias("strength"),
        F.col("p_retailprice").alias("mrp"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("double")).alias("stock_qty"),
    )


#: Fixed values of the form words, as SQL.
_FORMS = "['tab','tabs','tablet','tablets','cap','caps','capsule','capsules','syrup','syp','susp','suspension','inj','injection','drop','drops','cream','ointment','gel','lotion','solution','sachet','strip','mg','mcg','ml','gm','g','iu','%']"


def sql_normalize(x: str) -> str:
    t = f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"
    kept = f"list_filter({t}, lambda t: NOT list_contains({_FORMS}, t))"
    return f"array_to_string(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {t} END, ' ')"


def sql_molecule(x: str) -> str:
    return f"array_to_string(list_filter(string_split({sql_normalize(x)}, ' '), lambda t: NOT regexp_matches(t, '[0-9]')), ' ')"


CATALOG = f"""
catalog AS (
  SELECT *, {sql_normalize("name")} AS normalized_name FROM (
    SELECT p_partkey AS id, p_partkey % 7 AS shop_id, p_brand AS sku, p_name || ' ' || p_size || 'mg Tab' AS name,
           CASE WHEN p_partkey % 3 = 0 THEN lower(p_name) || ' ' || lower(p_type) END AS composition, p_size::VARCHAR AS strength, p_retailprice AS mrp,
           CASE WHEN p_partkey % 5 <> 0 THEN p_size::DOUBLE END AS stock_qty
    FROM part))"""


def leaf(value, confidence) -> object:
    c = confidence if hasattr(confidence, "alias") else F.lit(confidence).cast("double")
    return F.struct(value.cast("string").alias("value"), c.alias("confidence"))


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, shop_id, data: an order with its items nested in order. One shuffle of lineitem on its order, as the rows it is read as."""
    money = lambda x: x.cast("decimal(14,2)")

    def item(x):
        low = x["l_discount"] * 10
        return F.struct(
            leaf(F.concat(F.lit("part "), x["l_partkey"].cast("string")), low).alias("description"),
            leaf(F.when(x["l_returnflag"] != "N", F.concat(x["l_returnflag"], x["l_linestatus"])), x["l_tax"] * 10).alias("batch_no"),
            leaf(F.date_format(x["l_shipdate"], "MM/yyyy"), 0.9).alias("expiry"),
            leaf(x["l_quantity"].cast("int"), low).alias("quantity"),
            leaf(money(x["l_extendedprice"]), None).alias("mrp"),
            leaf(F.lit(None), None).alias("rate"),
            leaf(money(x["l_extendedprice"]), 0.95).alias("amount"),
            leaf(x["l_suppkey"], 1.0).alias("hsn"),
            leaf(F.round(x["l_tax"] * 100).cast("int"), 0.5).alias("gst_percent"),
        )

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *_ORDER).repartition("l_orderkey")
    rows = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*_ORDER))).alias("r"))
    rows = rows.select("l_orderkey", F.transform("r", item).alias("line_items"))
    o = table(spark, sf_dir, "orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    supplier = F.struct(leaf(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")), 0.7).alias("name"), leaf(F.lit(None), None).alias("gstin"), leaf(F.lit(None), None).alias("address"))
    head = F.struct(leaf(F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")), 0.99).alias("invoice_no"), leaf(F.date_format("o_orderdate", "dd/MM/yyyy"), 0.8).alias("invoice_date"), leaf(money(F.col("o_totalprice")), 0.55).alias("total_amount"))
    return o.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("shop_id"), F.struct(supplier.alias("supplier"), head.alias("invoice"), "line_items").alias("data"))


INVOICES = """
heads AS (
  SELECT o_orderkey AS document_id, o_custkey AS shop_id, 'Customer ' || o_custkey AS supplier, 'INV-' || o_orderkey AS invoice_no,
         strftime(o_orderdate, '%d/%m/%Y') AS invoice_date, o_totalprice::DECIMAL(14,2)::VARCHAR AS total_amount FROM orders),
items AS (
  SELECT l_orderkey AS document_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1)::INT AS item_no,
         'part ' || l_partkey AS description, l_discount * 10 AS low, CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_linestatus END AS batch_no, l_tax * 10 AS batch_low,
         strftime(l_shipdate, '%m/%Y') AS expiry, l_quantity::INT::VARCHAR AS quantity, l_extendedprice::DECIMAL(14,2)::VARCHAR AS amount, l_suppkey::VARCHAR AS hsn,
         round(l_tax * 100)::INT::VARCHAR AS gst_percent
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"""

#: Every leaf of an invoice: a, i, j (its place), path, value, confidence.
LEAVES = """
leaves AS (
  SELECT document_id, 0 AS a, 0 AS i, 0 AS j, 'supplier.name' AS path, supplier AS value, 0.7::DOUBLE AS confidence FROM heads
  UNION ALL SELECT document_id, 0, 0, 1, 'supplier.gstin', NULL, NULL FROM heads UNION ALL SELECT document_id, 0, 0, 2, 'supplier.address', NULL, NULL FROM heads
  UNION ALL SELECT document_id, 1, 0, 0, 'invoice.invoice_no', invoice_no, 0.99 FROM heads UNION ALL SELECT document_id, 1, 0, 1, 'invoice.invoice_date', invoice_date, 0.8 FROM heads
  UNION ALL SELECT document_id, 1, 0, 2, 'invoice.total_amount', total_amount, 0.55 FROM heads
  UNION ALL SELECT document_id, 2, item_no, 0, 'line_items[' || item_no || '].description', description, low FROM items
  UNION ALL SELECT document_id, 2, item_no, 1, 'line_items[' || item_no || '].batch_no', batch_no, batch_low FROM items
  UNION ALL SELECT document_id, 2, item_no, 2, 'line_items[' || item_no || '].expiry', expiry, 0.9 FROM items
  UNION ALL SELECT document_id, 2, item_no, 3, 'line_items[' || item_no || '].quantity', quantity, low FROM items
  UNION ALL SELECT document_id, 2, item_no, 4, 'line_items[' || item_no || '].mrp', amount, NULL FROM items
  UNION ALL SELECT document_id, 2, item_no, 5, 'line_items[' || item_no || '].rate', NULL, NULL FROM items
  UNION ALL SELECT document_id, 2, item_no, 6, 'line_items[' || item_no || '].amount', amount, 0.95 FROM items
  UNION ALL SELECT document_id, 2, item_no, 7, 'line_items[' || item_no || '].hsn', hsn, 1.0 FROM items
  UNION ALL SELECT document_id, 2, item_no, 8, 'line_items[' || item_no || '].gst_percent', gst_percent, 0.5 FROM items)"""


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a delivery attempt of a user's document by the connector of its type."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") < 5, "pending").when(F.col("value") < 60, "success").otherwise("failed")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("connector_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("idempotency_key"), status.alias("status"), F.lit(1).alias("attempts"), F.col("ts").alias("created_at"))


DELIVERIES = """
deliveries AS (
  SELECT event_id AS id, user_id AS document_id, event_type AS connector_id, user_id || ':' || event_type AS idempotency_key,
         CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 5 THEN 'pending' WHEN value < 60 THEN 'success' ELSE 'failed' END AS status, 1 AS attempts, ts AS created_at FROM events)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents with a state."""
    o = table(spark, sf_dir, "orders")
    status = F.element_at(F.array(*map(F.lit, ["queued", "processing", "needs_review", "approved", "pushed", "failed"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("shop_id"), F.when(F.col("o_orderstatus") == "O", "prescription").otherwise("invoice").alias("doc_type"), status.alias("status"),
        F.when(F.col("o_orderkey") % 4 == 0, "1/3").alias("progress"), F.when(F.col("o_orderkey") % 9 == 0, "lost page").when(F.col("o_orderkey") % 9 == 1, "").alias("error"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


DOCUMENTS = """
docs AS (
  SELECT o_orderkey AS id, o_custkey % 50 AS shop_id, CASE WHEN o_orderstatus = 'O' THEN 'prescription' ELSE 'invoice' END AS doc_type,
         ['queued', 'processing', 'needs_review', 'approved', 'pushed', 'failed'][o_orderkey % 6 + 1] AS status, CASE WHEN o_orderkey % 4 = 0 THEN '1/3' END AS progress,
         CASE WHEN o_orderkey % 9 = 0 THEN 'lost page' WHEN o_orderkey % 9 = 1 THEN '' END AS error, o_orderdate::TIMESTAMP AS created_at FROM orders)"""
