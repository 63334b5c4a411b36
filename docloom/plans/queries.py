"""The registered queries of the engine, each with the SQL that checks it where there is one."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import values as V
from ..operators import buckets, chunks, export, grams, lifecycle, matching, nested, paging, tables, trees
from ..operators.tenancy import TenantScope, mentions, search_catalog, unpaired
from ..shared import folder
from ..sources import catalog as catalogs
from ..sources import feed, uploads
from ..sources.named_files import read_named, write_named
from ..streaming import intake, ledger, queue, sinks
from . import analogues as A

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- names, values


@query(f"WITH {A.CATALOG} SELECT id, normalized_name, {A.sql_molecule('name')} AS base_molecule, CASE WHEN coalesce(composition, '') <> '' THEN {A.sql_normalize('composition')} ELSE {A.sql_molecule('name')} END AS molecule FROM catalog")
def catalog_normalize(spark, sf_dir):
    c = A.catalog(spark, sf_dir)
    return c.select("id", "normalized_name", N.base_molecule(F.col("name")).alias("base_molecule"), N.molecule_of(F.col("composition"), F.col("name")).alias("molecule"))


@query(f"WITH {A.CATALOG} SELECT id, name, normalized_name, mrp FROM catalog WHERE contains(normalized_name, 'ring') ORDER BY name, id LIMIT 100")
def catalog_search(spark, sf_dir):
    return search_catalog(A.catalog(spark, sf_dir), "Ring Tab").select("id", "name", "normalized_name", "mrp")


_SAID = "CASE l_linenumber % 4 WHEN 0 THEN 'qty: ' || l_quantity::INT || ' nos' WHEN 1 THEN l_extendedprice::DECIMAL(14,2) || ' Rs' WHEN 2 THEN l_quantity::INT || ' mg tab' ELSE 'none' END"


@query(f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_SAID} AS said FROM lineitem),
t AS (SELECT *, replace(said, '.', ',') AS comma FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, TRY_CAST(nullif(regexp_extract(said, '[-+]?\\d*\\.?\\d+'), '') AS DOUBLE) AS quantity,
       TRY_CAST(nullif(regexp_extract(said, '(?i)(\\d*\\.?\\d+)\\s*(mg|mcg|g|ml|iu|%)', 1), '') AS DOUBLE) AS amount, nullif(lower(regexp_extract(said, '(?i)(\\d*\\.?\\d+)\\s*(mg|mcg|g|ml|iu|%)', 2)), '') AS unit,
       replace(nullif(regexp_extract(comma, '-?[\\d,]*\\.?\\d+'), ''), ',', '') AS plain FROM t""")
def value_parse(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    k = F.col("l_linenumber") % 4
    said = F.when(k == 0, F.concat(F.lit("qty: "), q, F.lit(" nos"))).when(k == 1, F.concat(F.col("l_extendedprice").cast("decimal(14,2)").cast("string"), F.lit(" Rs"))).when(k == 2, F.concat(q, F.lit(" mg tab"))).otherwise("none")
    r = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", said.alias("said"))
    s = V.strength(F.col("said"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.quantity(F.col("said")).alias("quantity"), s["amount"].alias("amount"), s["unit"].alias("unit"), V.plain_number(F.replace("said", F.lit("."), F.lit(","))).alias("plain"))


#: Forms of a date and how strftime writes them; those from month_name on have no day.
_FORMS = {
    "day_first": ("dd/MM/yyyy", "%d/%m/%Y"), "iso": ("yyyy-MM-dd", "%Y-%m-%d"), "dashes": ("d-M-yyyy", "%-d-%-m-%Y"), "dots": ("dd.MM.yyyy", "%d.%m.%Y"),
    "short_year": ("dd/MM/yy", "%d/%m/%y"), "short_dashes": ("dd-MM-yy", "%d-%m-%y"), "named": ("d MMM yyyy", "%-d %b %Y"), "named_dashes": ("dd-MMM-yyyy", "%d-%b-%Y"),
    "month_name": ("MMM yyyy", "%b %Y"), "month_short": ("MMM-yy", "%b-%y"), "month_year": ("MM/yyyy", "%m/%Y"), "month_dashes": ("MM-yyyy", "%m-%Y"), "month_slash": ("MM/yy", "%m/%y"),
}
_WITH_DAY = list(_FORMS)[: list(_FORMS).index("month_name")]
# A year of two digits is of this century.
_YEAR = "o_orderdate + CASE WHEN year(o_orderdate) < 2000 THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END"


def _sql_date(name: str) -> str:
    day = f"({_YEAR if 'yyyy' not in _FORMS[name][0] else 'o_orderdate'})"
    return f"{day}::DATE::VARCHAR" if name in _WITH_DAY else f"date_trunc('month', {day})::DATE::VARCHAR"


@query(f"SELECT o_orderkey, {', '.join(f'{_sql_date(n)} AS {n}' for n in _FORMS)}, NULL::VARCHAR AS nothing FROM orders")
def date_parse(spark, sf_dir):
    texts = F.array(*[F.concat(F.lit("dt. "), F.date_format("o_orderdate", form)) for form, _ in _FORMS.values()], F.lit("soon"))
    found = A.table(spark, sf_dir, "orders").select("o_orderkey", F.transform(texts, lambda x: V.date(x).cast("string")).alias("said"))
    return found.select("o_orderkey", *[F.col("said")[k].alias(n) for k, n in enumerate([*_FORMS, "nothing"])])


#: Dates in words, by remainder of the key; the last has no day.
_WORDED = ["'Dated' EEEE, d MMMM yyyy", "MMMM d, yyyy 'at' h:mm a", "'due on' d'th of' MMM, yyyy 'please'", "HH:mm:ss 'on' MMMM d'th' yyyy", "yyyy MMMM d", "'Expiry' MMMM yyyy"]


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % {len(_WORDED)} = {len(_WORDED) - 1} THEN date_trunc('month', o_orderdate) ELSE o_orderdate END::DATE::VARCHAR AS said FROM orders")
def date_words(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=F.col("o_orderkey").cast("int") % 1440)
    said = F.lit("")
    for k, form in enumerate(_WORDED):
        said = F.when(F.col("o_orderkey") % len(_WORDED) == k, F.date_format(at, form)).otherwise(said)
    return A.table(spark, sf_dir, "orders").select("o_orderkey", V.date(said).cast("string").alias("said"))


@query("""SELECT o_orderkey, CASE WHEN contains(upper(substr(repeat(' ', (o_orderkey % 70)::INT) || 'Tax Invoice ' || o_orderkey, 1, 64)), 'INVOICE') THEN 'invoice' ELSE 'prescription' END AS doc_type FROM orders""")
def classified(spark, sf_dir):
    content = F.concat(F.repeat(F.lit(" "), (F.col("o_orderkey") % 70).cast("int")), F.lit("Tax Invoice "), F.col("o_orderkey").cast("string"))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", V.doc_type_of(F.encode(content, "utf-8")).alias("doc_type"))


_FAILURE = "[429, 404, NULL, 503, 200][event_id % 5 + 1]", "['Rate Limit hit', 'not there', NULL, 'DEADLINE passed', 'wrong key', 'error 500'][event_id % 6 + 1]"


@query(f"""WITH e AS (SELECT event_id, {_FAILURE[0]} AS code, lower({_FAILURE[1]}) AS said FROM events)
SELECT event_id, coalesce(code IN (429, 503), false) OR coalesce(said IN ('rate limit hit', 'deadline passed', 'error 500'), false) AS transient FROM e""")
def transient_errors(spark, sf_dir):
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    said = pick(6, "Rate Limit hit", "not there", None, "DEADLINE passed", "wrong key", "error 500")
    return A.table(spark, sf_dir, "events").select("event_id", V.is_transient(pick(5, 429, 404, None, 503, 200), said).alias("transient"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'R' THEN l_discount * 10 END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(floor(c * 100 + 0.5), -1)::BIGINT AS percent,
       CASE WHEN c IS NULL THEN 'none' WHEN c < 0.6 THEN 'low' WHEN c < 0.85 THEN 'medium' ELSE 'high' END AS bucket_at_least,
       CASE WHEN c IS NULL THEN 'none' WHEN c > 0.85 THEN 'high' WHEN c > 0.6 THEN 'medium' ELSE 'low' END AS bucket_above,
       CASE WHEN c * 100 >= 85 THEN 'strong' WHEN c * 100 >= 70 THEN 'likely' ELSE 'weak' END AS badge FROM c""")
def confidence_buckets(spark, sf_dir):
    c = F.when(F.col("l_returnflag") != "R", F.col("l_discount") * 10)
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(V.confidence_percent(c), F.lit(-1)).cast("long").alias("percent"), V.bucket_at_least(c).alias("bucket_at_least"), V.bucket_above(c).alias("bucket_above"), V.match_badge(c * 100).alias("badge"))


def _sql_hmac(body: str, secret: str) -> str:
    """HMAC-SHA256 of an SQL text, from the two keyed hashes that define it."""
    inner, outer = (bytes(b ^ pad for b in secret.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"'sha256=' || sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({body}))))"


_BODY = """'{"id":' || id || ',"status":"' || status || '"}'"""


@query(f"WITH {A.DOCUMENTS} SELECT id, {_sql_hmac(_BODY, 'secret')} AS signature FROM docs")
def payload_signatures(spark, sf_dir):
    d = A.documents(spark, sf_dir)
    return d.select("id", V.signature(F.to_json(F.struct("id", "status")), "secret").alias("signature"))


# ---- tenant reads


@query(f"WITH {A.DOCUMENTS} SELECT id, doc_type, status, created_at FROM docs WHERE shop_id = 7 AND status = 'needs_review' ORDER BY created_at DESC, id LIMIT 20 OFFSET 5")
def documents_page(spark, sf_dir):
    return TenantScope(7).page(A.documents(spark, sf_dir), limit=20, offset=5, status="needs_review", doc_type=None).select("id", "doc_type", "status", "created_at")


@query(f"WITH {A.CATALOG} SELECT count(*)::BIGINT AS count, count(*) > 0 AS connected FROM catalog WHERE shop_id = 3")
def catalog_count(spark, sf_dir):
    return TenantScope(3).count(A.catalog(spark, sf_dir))


@query(f"WITH {A.DOCUMENTS} SELECT id, doc_type, status FROM docs WHERE contains(id::VARCHAR, '77') OR contains(doc_type, '77') OR contains(status, '77')")
def client_search(spark, sf_dir):
    return A.documents(spark, sf_dir).filter(mentions("77", "id", "doc_type", "status")).select("id", "doc_type", "status")


@query(f"WITH {A.DOCUMENTS} SELECT id, doc_type AS owner, status FROM docs WHERE id = 77")
def owned_document(spark, sf_dir):
    """Two owners ask for one row: who has it gets it, the other nothing."""
    d = A.documents(spark, sf_dir)
    ask = lambda owner: TenantScope(owner, "doc_type").one(d, "id", 77).select("id", F.col("doc_type").alias("owner"), "status")
    return ask("invoice").unionByName(ask("prescription"))


@query(f"WITH {A.INVOICES} SELECT document_id, item_no, description FROM items WHERE contains(lower(description), 'rt 17')")
def item_search(spark, sf_dir):
    return nested.flatten_rows(A.invoices(spark, sf_dir), "invoice").filter(mentions("RT 17", "description")).select("document_id", "item_no", "description")


@query("""SELECT event_id AS id, true AS has_secret FROM events WHERE event_id % 3 = 0 AND 'K' || (event_id % 10) = 'K6' AND event_id % 4 <> 1""")
def pairing(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.to_json(F.struct(F.concat(F.lit("k"), (F.col("event_id") % 10).cast("string")).alias("pairing_code"), (F.col("event_id") % 4 == 1).alias("paired"))).alias("config"), F.when(F.col("event_id") % 3 == 0, "s").alias("secret_ref"))
    return nested.mask_secret(unpaired(e, " K6 ")).filter("has_secret").select("id", "has_secret")


# ---- nested records

_FLAT = f"WITH {A.INVOICES}, flat AS (SELECT document_id, item_no, supplier, invoice_no, invoice_date, description, coalesce(batch_no, '') AS batch_no, expiry, quantity, amount AS mrp, '' AS rate, amount, hsn, gst_percent FROM heads JOIN items USING (document_id))"


@query(_FLAT + " SELECT * FROM flat")
def flatten_rows(spark, sf_dir):
    return nested.flatten_rows(A.invoices(spark, sf_dir), "invoice")


@query(_FLAT + " SELECT * EXCLUDE (invoice_no, invoice_date) FROM flat")
def flatten_rows_agent(spark, sf_dir):
    return nested.flatten_rows(A.invoices(spark, sf_dir), "invoice", agent=True)


@query(_FLAT + """ SELECT document_id, item_no, description AS "ItemName", batch_no AS "Batch", expiry AS "Exp", quantity AS "Qty", mrp AS "MRP", rate AS "PRate", amount AS "Amount", hsn AS "HSN", gst_percent AS "GST" FROM flat""")
def export_profile(spark, sf_dir):
    return nested.project(nested.flatten_rows(A.invoices(spark, sf_dir), "invoice"), nested.profile_columns("invoice", "marg"), ("document_id", "item_no"))


@query(f"WITH {A.INVOICES}, {A.LEAVES} SELECT document_id, a AS top, i AS item, j AS place, path, value, confidence FROM leaves")
def field_walk(spark, sf_dir):
    w = nested.walk(A.invoices(spark, sf_dir).select("document_id", "data"), nested.INVOICE)
    return w.select("document_id", F.col("position.a").alias("top"), F.col("position.i").alias("item"), F.col("position.j").alias("place"), "path", "value", "confidence")


# JSON without a schema: the fields of events, and records as text that must give what the typed walk gives.
@query("""SELECT event_id, substr(fullkey, 3) AS path, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE lower(type) END AS kind, atom ->> '$' AS value
FROM events, json_tree(props) WHERE type NOT IN ('OBJECT', 'ARRAY')""")
def json_leaves(spark, sf_dir):
    found = trees.leaves(A.table(spark, sf_dir, "events").select("event_id", "props"), "props", ["event_id"])
    return found.select("event_id", "path", "kind", "value")


@query(f"WITH {A.INVOICES}, {A.LEAVES} SELECT document_id, path, value, confidence FROM leaves WHERE value IS NOT NULL AND confidence IS NOT NULL")
def json_field_walk(spark, sf_dir):
    records = A.invoices(spark, sf_dir).select("document_id", F.to_json("data").alias("record"))
    return trees.scored_objects(records, "record", ["document_id"])


@query(f"WITH {A.INVOICES}, {A.LEAVES} SELECT document_id, string_agg(path, ',' ORDER BY a, i, j) AS paths FROM leaves WHERE value <> '' AND confidence < 0.6 GROUP BY document_id")
def low_confidence(spark, sf_dir):
    w = nested.walk(A.invoices(spark, sf_dir).select("document_id", "data"), nested.INVOICE)
    return nested.low_confidence(w).select("document_id", F.array_join("low_confidence", ",").alias("paths"))


@query(f"WITH {A.INVOICES}, {A.LEAVES} SELECT document_id, round_even(avg(confidence::DECIMAL(10,6)) FILTER (coalesce(value, '') <> ''), 2) AS overall_confidence FROM leaves GROUP BY document_id")
def overall_confidence(spark, sf_dir):
    # Two places for the check alone: engines divide decimals alike to that.
    return nested.overall_confidence(nested.walk(A.invoices(spark, sf_dir).select("document_id", "data"), nested.INVOICE), places=2)


@query(f"""WITH {A.INVOICES}, n AS (SELECT document_id, (low < 0.6 OR coalesce(batch_low < 0.6 AND batch_no <> '', false) OR 100 - hsn::INT % 60 < 70) AS flag FROM items)
SELECT document_id, count(*) FILTER (flag)::BIGINT AS needs_attention, count(*)::BIGINT AS items FROM n GROUP BY document_id""")
def needs_attention_count(spark, sf_dir):
    item = F.col("item")
    flag = nested.needs_attention(nested.item_fields(item, "invoice"), F.lit(100.0) - item["hsn"]["value"].cast("int") % 60, F.lit(True))
    s = A.invoices(spark, sf_dir).select("document_id", F.explode("data.line_items").alias("item"))
    return s.groupBy("document_id").agg(F.count_if(flag).alias("needs_attention"), F.count("*").alias("items"))


@query(f"""WITH {A.INVOICES} SELECT document_id, (item_no + 3)::INT AS section, 'lineItems #' || (item_no + 1) AS title,
  array_to_string(list_filter(['Batch: ' || batch_no, 'Expiry: ' || expiry, 'Qty: ' || quantity, 'MRP: ' || amount], lambda x: x IS NOT NULL)[1:3], '  ·  ') AS summary FROM items""")
def item_summaries(spark, sf_dir):
    s = nested.sections(A.invoices(spark, sf_dir), "invoice").filter("item_no IS NOT NULL")
    return s.select("document_id", "section", "title", nested.item_summary(F.col("fields")).alias("summary"))


@query(f"WITH {A.INVOICES} SELECT document_id, 'corrected' AS supplier, 0.7::DOUBLE AS confidence, CASE WHEN document_id IN (SELECT document_id FROM items) THEN '9' END AS first_quantity FROM heads")
def corrected_fields(spark, sf_dir):
    d = A.invoices(spark, sf_dir)
    data = nested.set_path(nested.set_path(F.col("data"), "supplier.name", F.lit("corrected")), "line_items[0].quantity", F.lit("9"))
    d = d.withColumn("data", data)
    leaf = nested.get_path(F.col("data"), "supplier.name")
    return d.select("document_id", leaf["value"].alias("supplier"), leaf["confidence"].alias("confidence"), nested.get_path(F.col("data"), "line_items[0].quantity")["value"].alias("first_quantity"))


@query(f"""WITH {A.INVOICES} SELECT document_id, item_no, strptime(invoice_date, '%d/%m/%Y')::DATE::VARCHAR AS invoice_date, strptime('01/' || expiry, '%d/%m/%Y')::DATE::VARCHAR AS expiry, quantity::DOUBLE AS quantity FROM heads JOIN items USING (document_id)""")
def postprocess(spark, sf_dir):
    d = A.invoices(spark, sf_dir).withColumn("data", nested.postprocess(F.col("data"), "invoice"))
    r = d.select("document_id", F.col("data.invoice.invoice_date.norm_date").cast("string").alias("invoice_date"), F.posexplode("data.line_items").alias("item_no", "item"))
    return r.select("document_id", "item_no", "invoice_date", F.col("item.expiry.norm_date").cast("string").alias("expiry"), F.col("item.quantity.norm_num").alias("quantity"))


@query(f"WITH {A.DOCUMENTS} SELECT id AS document_id, '1.0' AS payload_version, 'document.approved' AS event, shop_id, doc_type FROM docs WHERE status = 'approved'")
def push_payload(spark, sf_dir):
    d = A.documents(spark, sf_dir).filter("status = 'approved'").withColumns({"overall_confidence": F.lit(0.9), "schema_version": F.lit("1"), "data": F.struct("id"), "meta": F.struct("progress")})
    return nested.push_payload(d).select("document_id", "payload.payload_version", "payload.event", "payload.shop_id", "payload.doc_type")


# ---- deliveries, states


@query(f"WITH {A.DELIVERIES} SELECT id, document_id, idempotency_key, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at DESC, id DESC) AS k FROM deliveries) WHERE k = 1")
def latest_delivery(spark, sf_dir):
    return lifecycle.latest_delivery(A.deliveries(spark, sf_dir)).select("id", "document_id", "idempotency_key", "status", "created_at")


@query(f"WITH {A.DELIVERIES} SELECT id, document_id, created_at FROM deliveries WHERE connector_id = 'click' AND status = 'pending' ORDER BY created_at, id LIMIT 50")
def pending_deliveries_oldest(spark, sf_dir):
    return lifecycle.pending_for(A.deliveries(spark, sf_dir), "click").select("id", "document_id", "created_at")


@query(f"WITH {A.DELIVERIES} SELECT id, document_id, status, created_at FROM deliveries WHERE connector_id = 'view' ORDER BY created_at DESC, id LIMIT 100")
def deliveries_latest(spark, sf_dir):
    return TenantScope("view", "connector_id").page(A.deliveries(spark, sf_dir), limit=100).select("id", "document_id", "status", "created_at")


_PLAN = f"""WITH {A.DELIVERIES}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at DESC, id DESC) AS k FROM deliveries) WHERE k = 1),
plan AS (SELECT o_orderkey AS document_id, c.connector_id, o_orderkey || ':' || c.connector_id AS idempotency_key, last.id AS delivery_id,
  CASE WHEN last.status = 'success' THEN 'skip' WHEN last.id IS NOT NULL THEN 'retry' ELSE 'insert' END AS action
  FROM orders CROSS JOIN (VALUES ('click'), ('view')) c(connector_id) LEFT JOIN last ON last.idempotency_key = o_orderkey || ':' || c.connector_id)"""


def _plan(spark, sf_dir):
    docs = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("shop_id"))
    connectors = spark.createDataFrame([(1, "click", True), (1, "view", True), (1, "error", False)], "shop_id int, connector_id string, enabled boolean")
    return lifecycle.push_plan(docs, connectors, A.deliveries(spark, sf_dir))


_PLANNED = " SELECT document_id, connector_id, idempotency_key, coalesce(delivery_id, -1)::BIGINT AS delivery_id, action FROM plan"


def _planned(plan):
    return plan.select("document_id", "connector_id", "idempotency_key", F.coalesce("delivery_id", F.lit(-1)).cast("long").alias("delivery_id"), "action")


@query(_PLAN + _PLANNED)
def push_plan(spark, sf_dir):
    return _planned(_plan(spark, sf_dir))


_UPSERTED = """ SELECT idempotency_key, status, attempts::INT AS attempts FROM (
  SELECT d.idempotency_key, CASE WHEN p.action = 'retry' THEN 'success' ELSE d.status END AS status, d.attempts + CASE WHEN p.action = 'retry' THEN 2 ELSE 0 END AS attempts FROM deliveries d LEFT JOIN plan p ON p.delivery_id = d.id
  UNION ALL SELECT idempotency_key, 'success', 2 FROM plan WHERE action = 'insert')"""


def _upserted(spark, sf_dir, plan):
    d = A.deliveries(spark, sf_dir).withColumns({"id": F.col("id").cast("string"), "document_id": F.col("document_id"), "response_code": F.lit(None).cast("int"), "response_body": F.lit(None).cast("string")})
    plan = plan.withColumn("delivery_id", F.col("delivery_id").cast("string"))
    results = plan.select("idempotency_key", F.lit("success").alias("status"), F.lit(200).alias("response_code"), F.lit("ok").alias("response_body"), F.lit(2).alias("attempts"))
    return lifecycle.apply_push(plan, results, d).select("idempotency_key", "status", "attempts")


@query(_PLAN + _UPSERTED)
def push_upsert(spark, sf_dir):
    return _upserted(spark, sf_dir, _plan(spark, sf_dir))


@query(f"WITH {A.DELIVERIES} SELECT document_id, bool_and(status IN ('success', 'pending')) AS all_ok FROM deliveries WHERE connector_id <> 'error' GROUP BY document_id")
def all_ok_per_document(spark, sf_dir):
    return lifecycle.all_ok(A.deliveries(spark, sf_dir).filter("connector_id <> 'error'"))


@query(f"WITH {A.DELIVERIES}, {A.DOCUMENTS}, ok AS (SELECT document_id FROM deliveries WHERE connector_id = 'click' GROUP BY 1 HAVING bool_and(status IN ('success', 'pending'))) SELECT id, CASE WHEN status IN ('approved', 'pushed') AND id IN (SELECT document_id FROM ok) THEN 'pushed' ELSE status END AS status FROM docs")
def push_status(spark, sf_dir):
    return lifecycle.push_status(A.documents(spark, sf_dir), A.deliveries(spark, sf_dir).filter("connector_id = 'click'")).select("id", "status")


@query(f"WITH {A.DELIVERIES} SELECT id, CASE WHEN id % 3 = 0 THEN 'success' ELSE status END AS status FROM deliveries")
def acknowledged(spark, sf_dir):
    d = A.deliveries(spark, sf_dir)
    return lifecycle.acknowledge(d, d.filter("id % 3 = 0").union(d.filter("id % 6 = 0"))).select("id", "status")


@query(f"""WITH {A.DOCUMENTS} SELECT id, CASE WHEN status IN ('queued', 'processing') THEN 'failed' ELSE status END AS status, CASE WHEN status NOT IN ('queued', 'processing') THEN progress END AS progress,
CASE WHEN status IN ('queued', 'processing') THEN coalesce(nullif(error, ''), '{lifecycle.INTERRUPTED}') ELSE error END AS error FROM docs""")
def recover_stuck(spark, sf_dir):
    return lifecycle.recover_stuck(A.documents(spark, sf_dir)).select("id", "status", "progress", "error")


@query(f"WITH {A.DOCUMENTS} SELECT id, CASE WHEN id % 2 = 0 AND status IN ('failed', 'needs_review') THEN 'queued' ELSE status END AS status, CASE WHEN NOT (id % 2 = 0 AND status IN ('failed', 'needs_review')) THEN error END AS error FROM docs")
def retried(spark, sf_dir):
    return lifecycle.retry(A.documents(spark, sf_dir), F.col("id") % 2 == 0).select("id", "status", "error")


_CORRECTED = f"WITH {A.DOCUMENTS}, hits AS (SELECT *, id % 3 = 0 AND status IN ('needs_review', 'approved', 'pushed') AS hit FROM docs)"


def _correct(spark, sf_dir):
    """Every third document is corrected, every ninth without data, and one that isn't there."""
    d = A.documents(spark, sf_dir).withColumn("data", F.lit("read"))
    new = d.filter("id % 3 = 0").select("id", F.lit("corrected").alias("data"))
    new = new.unionByName(d.filter("id % 9 = 1").select("id", F.lit(None).cast("string").alias("data"))).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("x").alias("data")))
    return lifecycle.correct(d, new)


@query(_CORRECTED + " SELECT id, CASE WHEN hit THEN 'needs_review' ELSE status END AS status, CASE WHEN hit THEN 'corrected' ELSE 'read' END AS data FROM hits")
def corrected_documents(spark, sf_dir):
    return _correct(spark, sf_dir)[0].select("id", "status", "data")


@query(_CORRECTED + " SELECT id, 'state ' || status AS reason FROM hits WHERE id % 3 = 0 AND NOT hit UNION ALL SELECT id, 'no valid data' FROM docs WHERE id % 9 = 1 UNION ALL SELECT -1, 'not found'")
def refused_corrections(spark, sf_dir):
    return _correct(spark, sf_dir)[1]


_CONNECTED = "shop_id % 3 <> 0 AND shop_id % 5 <> 0"


@query(f"""WITH {A.DOCUMENTS} SELECT id, CASE WHEN status NOT IN ('approved', 'pushed') THEN 'state ' || status WHEN NOT ({_CONNECTED}) THEN 'no connector' END AS reason FROM docs""")
def push_refusals(spark, sf_dir):
    shops = spark.range(50).select(F.col("id").alias("shop_id"), (F.col("id") % 5 != 0).alias("enabled")).filter("shop_id % 3 <> 0")
    ready, refused = lifecycle.pushable(A.documents(spark, sf_dir), shops)
    return refused.unionByName(ready.select("id", F.lit(None).cast("string").alias("reason")))


_STATES = "['queued', 'processing', 'needs_review', 'approved', 'pushed', 'failed']"
_MOVES = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, to in lifecycle.ALLOWED.items() for b in to) + ") t(a, b)"


@query(f"""WITH h AS (SELECT event_id, user_id, {_STATES}[(event_id * 7 + user_id) % 6 + 1] AS status, lag({_STATES}[(event_id * 7 + user_id) % 6 + 1]) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS current FROM events)
SELECT event_id, user_id, current, status, current IS NULL OR (current, status) IN (SELECT (a, b) FROM {_MOVES}) AS allowed FROM h""")
def transition_audit(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, lifecycle.ALLOWED)), ((F.col("event_id") * 7 + F.col("user_id")) % 6 + 1).cast("int"))
    log = A.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", state.alias("status"))
    return lifecycle.check_history(log, "user_id", ["ts", "event_id"]).select("event_id", "user_id", "current", "status", "allowed")


@query(f"""WITH m AS (SELECT event_id, {_STATES}[event_id % 6 + 1] AS a, {_STATES}[user_id % 6 + 1] AS b FROM events) SELECT event_id, a AS current, b AS target FROM m WHERE (a, b) NOT IN (SELECT (a, b) FROM {_MOVES})""")
def forbidden_transitions(spark, sf_dir):
    pick = lambda c: F.element_at(F.array(*map(F.lit, lifecycle.ALLOWED)), (F.col(c) % 6 + 1).cast("int"))
    moves = A.table(spark, sf_dir, "events").select("event_id", pick("event_id").alias("current"), pick("user_id").alias("target"))
    return lifecycle.split_transitions(moves)[1].select("event_id", "current", "target")


# ---- chunks, pages


@query("""
WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text ELSE '' END AS value, len(string_split(coalesce(text, ''), ' ')) AS n FROM conversations)
SELECT conv_id AS document_id, coalesce(arg_min(value, turn) FILTER (value <> ''), arg_max(value, turn)) AS name, string_agg(turn || ':' || n, ',' ORDER BY turn) AS items, count(*)::INT AS item_count, count(*) FILTER (n > 50)::BIGINT AS pages_failed FROM c GROUP BY conv_id""")
def chunk_merge(spark, sf_dir):
    n = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    leaf = F.struct(F.when(F.col("role") == "assistant", F.col("text")).otherwise("").alias("value"), F.lit(0.9).alias("confidence"))
    fields = F.struct(F.struct(leaf.alias("name")).alias("supplier"), F.array(F.concat_ws(":", F.col("turn").cast("string"), n.cast("string"))).alias("line_items"))
    c = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk"), fields.alias("fields"), (n > 50).cast("int").alias("failed"))
    m = chunks.merge(c, "line_items", {"supplier": ["name"]})
    return m.select("document_id", F.col("supplier.name.value").alias("name"), F.array_join("line_items", ",").alias("items"), "item_count", "pages_failed")


@query("""
WITH n AS (SELECT conv_id AS document_id, count(*)::BIGINT AS pages, sum(length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')))::BIGINT AS chars FROM conversations GROUP BY conv_id)
SELECT *, chars >= floor(pages * 200 / 2) AS digital FROM n""")
def digital_text_flag(spark, sf_dir):
    return chunks.is_digital(A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), "text"))


@query("SELECT conv_id AS document_id, turn AS page, floor(turn / CASE WHEN conv_id % 2 = 0 THEN 6 ELSE 2 END)::INT AS unit FROM conversations")
def page_units(spark, sf_dir):
    p = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"))
    return chunks.units(p, F.col("document_id") % 2 == 0)


# ---- line-item tables


@query(f"""WITH {A.INVOICES} SELECT document_id, item_no, description, nullif(batch_no, '') AS batch_no, hsn, quantity, replace(amount, ',', '') AS amount, CASE gst_percent::INT WHEN 0 THEN '0.0' ELSE (2 * gst_percent::INT) || '.0' END AS gst_percent FROM items""")
def table_items(spark, sf_dir):
    said = lambda x, n: F.coalesce(x[n]["value"], F.lit(""))
    share = lambda x: F.concat(said(x, "gst_percent"), F.lit("%"))
    cells = lambda x, i: F.array(i.cast("string"), said(x, "hsn"), said(x, "description"), said(x, "batch_no"), F.concat(said(x, "quantity"), F.lit(" nos")), said(x, "amount"), share(x), share(x))
    rows = A.invoices(spark, sf_dir).select("document_id", F.transform("data.line_items", cells).alias("r")).filter("r IS NOT NULL")
    header = F.array(*[F.array(*map(F.lit, x)) for x in (["", "", "Tax Invoice"], ["Sr.", "HSN Code", "Product\nName", "Batch No.", "Qty", "Net Amount", "CGST %", "SGST %"])])
    total = F.array(F.array(F.lit(""), F.lit(""), F.lit("GRAND TOTAL"), F.lit("x"), F.lit("9")))
    t = rows.select("document_id", F.lit(1).alias("page"), F.lit(1).alias("table"), F.concat(header, "r", total).alias("rows"))
    return tables.line_items(t).select("document_id", "item_no", "description", "batch_no", "hsn", "quantity", "amount", "gst_percent")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_name || ' Pvt Ltd' END AS supplier, '27ABCDE' || lpad(s_suppkey::VARCHAR, 8, '0') AS gstin, 'S/' || s_suppkey AS invoice_no, '01.02.2024' AS invoice_date FROM supplier""")
def page_header(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    top = F.when(F.col("s_suppkey") % 3 != 0, F.concat("s_name", F.lit(" Pvt Ltd - TAX INVOICE"))).otherwise(F.col("s_name"))
    text = F.concat(F.lit("Page 1\n"), top, F.lit("\r\nInvoice No: S/"), key, F.lit(" dt. 01.02.2024\nGSTIN : 27ABCDE"), F.lpad(key, 8, "0"))
    return s.select("s_suppkey", tables.header_text(text).alias("h")).select("s_suppkey", "h.*")


#: Ways in which suppliers write the same header, by remainder of the key.
_HEADERS = [
    "{name} pharma agencies  ORIGINAL\nINVOICE     NO: S/{key}    dt01.02.2024\ngstin 27abcde{key8}",
    "Bill\n{name} Enterprises|Tax   Invoice\nInvoice No{key} Dt. - 01-02-2024\nGSTIN:27ABCDE{key8}",
    "invoiceno. -{key}/A of {name}, dt : 1/2/2024\n  {name} HEALTHCARE - credit note 7\nOur GSTIN-27ABCDE{key8}X",
    "Invoice\nNo\t:\tS-{key}\n{name} LTD\nDt. 01.02.2024",
    "Delivery to {name} Co\nInvoice Notice\nGSTIN: none, GSTIN: 27ABCDE{key8}",
]


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_name || ' pharma agencies' WHEN 1 THEN s_name || ' Enterprises' WHEN 2 THEN s_name || ' HEALTHCARE' WHEN 3 THEN s_name || ' LTD' END AS supplier,
CASE s_suppkey % 5 WHEN 0 THEN '27abcde' WHEN 3 THEN NULL ELSE '27ABCDE' END || lpad(s_suppkey::VARCHAR, 8, '0') AS gstin,
CASE s_suppkey % 5 WHEN 0 THEN 'S/' || s_suppkey WHEN 1 THEN s_suppkey::VARCHAR WHEN 2 THEN s_suppkey || '/A' WHEN 3 THEN 'S-' || s_suppkey ELSE 'tice' END AS invoice_no,
CASE s_suppkey % 5 WHEN 0 THEN '01.02.2024' WHEN 1 THEN '01-02-2024' WHEN 2 THEN '1/2/2024' END AS invoice_date FROM supplier""")
def page_header_forms(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    key, form = F.col("s_suppkey").cast("string"), F.element_at(F.array(*map(F.lit, _HEADERS)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    text = F.replace(F.replace(F.replace(form, F.lit("{name}"), F.col("s_name")), F.lit("{key8}"), F.lpad(key, 8, "0")), F.lit("{key}"), key)
    return s.select("s_suppkey", tables.header_text(text).alias("h")).select("s_suppkey", "h.*")


# ---- catalog sources, uploads


@query("""SELECT p_name || ' x' AS name, lower(p_name) || ' x' AS normalized_name, p_type AS composition, p_partkey::VARCHAR AS sku, p_retailprice AS mrp, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE ELSE 0.0 END AS stock_qty FROM part""")
def catalog_from_json(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    item = F.struct(F.concat("p_name", F.lit(" x")).alias("Item_Name"), F.col("p_type").alias("salt"), F.col("p_partkey").alias("code"), F.format_number("p_retailprice", 1).alias("Price"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("n/a").alias("onHand"))
    bodies = p.select(F.concat(F.lit('{"data": {"items": ['), F.to_json(item), F.lit(', 5, "text"]}}')).alias("body"))
    return catalogs.as_catalog(catalogs.parse_items(bodies, "data.items"), 1).select("name", "normalized_name", "composition", "sku", "mrp", "stock_qty")


@query("""WITH u AS (SELECT page_id, ['a.PDF', 'b.png', 'c.webp', 'd.jpg'][page_id % 4 + 1] AS name, CASE WHEN page_id % 11 = 0 THEN 0 ELSE octet_length(encode(html)) END AS bytes, CASE WHEN page_id % 5 = 0 THEN 'letter' ELSE 'invoice' END AS doc_type FROM pages)
SELECT page_id, CASE name WHEN 'a.PDF' THEN 'application/pdf' WHEN 'b.png' THEN 'image/png' WHEN 'c.webp' THEN 'image/webp' ELSE 'image/jpeg' END AS content_type, CASE WHEN bytes = 0 THEN 'empty' WHEN bytes > 5000 THEN 'too large' WHEN doc_type = 'letter' THEN 'document type' END AS reason FROM u""")
def upload_validation(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages")
    name = F.element_at(F.array(*map(F.lit, ["a.PDF", "b.png", "c.webp", "d.jpg"])), (F.col("page_id") % 4 + 1).cast("int"))
    u = p.select("page_id", V.content_type(name).alias("content_type"), F.when(F.col("page_id") % 11 == 0, 0).otherwise(F.octet_length("html")).alias("bytes"), F.when(F.col("page_id") % 5 == 0, "letter").otherwise("invoice").alias("doc_type"))
    good, bad = uploads.validate(u, 5000)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select("page_id", "content_type", "reason")


# ---- matching

_JACCARD = """CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE 100.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END"""


def _queries(spark, sf_dir):
    c = A.catalog(spark, sf_dir)
    return c.select(F.col("id").alias("query_id"), "shop_id", F.concat_ws(" ", "name", F.lit("strip")).alias("name"))


_TOPK = f"""WITH {A.CATALOG}, q AS (SELECT id AS query_id, shop_id, list_distinct(string_split(normalized_name, ' ')) AS x FROM catalog),
s AS (SELECT query_id, c.id, {_JACCARD} AS score FROM q JOIN (SELECT id, shop_id, list_distinct(string_split(normalized_name, ' ')) AS y FROM catalog) c USING (shop_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s WHERE score >= 40)
SELECT query_id, rank, id, round_even(score, 1) AS score FROM r WHERE rank <= 3"""


@query(_TOPK)
def jaccard_topk(spark, sf_dir):
    return matching.match_names(_queries(spark, sf_dir), A.catalog(spark, sf_dir), scorer="jaccard").select("query_id", "rank", "id", "score")


@query()
def token_set_topk(spark, sf_dir):
    return matching.match_names(_queries(spark, sf_dir), A.catalog(spark, sf_dir)).select("query_id", "rank", "id", "score")


_ALTERNATIVES = f"""WITH {A.CATALOG}, m AS (SELECT *, CASE WHEN coalesce(composition, '') <> '' THEN {A.sql_normalize('composition')} ELSE {A.sql_molecule('name')} END AS mol FROM catalog),
q AS (SELECT id AS query_id, shop_id, mol, list_distinct(string_split(mol, ' ')) AS x FROM m WHERE mol <> ''),
s AS (SELECT query_id, c.id, c.stock, {_JACCARD} AS raw FROM q JOIN (SELECT id, shop_id, coalesce(stock_qty, 0) AS stock, list_distinct(string_split(mol, ' ')) AS y FROM m) c ON q.shop_id = c.shop_id AND list_contains(c.y, string_split(q.mol, ' ')[1])),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round_even(raw, 1) DESC, stock DESC, id)::INT AS rank FROM s WHERE raw >= 75)
SELECT query_id, rank, id, round_even(raw, 1) AS score FROM r WHERE rank <= 5"""


@query(_ALTERNATIVES)
def alternatives(spark, sf_dir):
    c = A.catalog(spark, sf_dir)
    return matching.alternatives(c.select(F.col("id").alias("query_id"), "shop_id", "name", "composition"), c, scorer="jaccard")


@query()
def alternatives_for_names(spark, sf_dir):
    return matching.alternatives_for(_queries(spark, sf_dir), A.catalog(spark, sf_dir))


def _items(spark, sf_dir):
    flat = nested.flatten_rows(A.invoices(spark, sf_dir), "invoice")
    part = A.table(spark, sf_dir, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("description"), F.concat_ws(" ", "p_name", F.concat(F.col("p_size").cast("string"), F.lit("mg"))).alias("name"))
    return flat.join(part, "description").select("document_id", "item_no", (F.col("document_id") % 7).alias("shop_id"), "name")


_MATCHED = f"""WITH {A.INVOICES}, {A.CATALOG}, i AS (SELECT document_id, item_no, document_id % 7 AS shop_id, {A.sql_normalize("p_name || ' ' || p_size || 'mg'")} AS name FROM items JOIN part ON description = 'part ' || p_partkey),
q AS (SELECT DISTINCT shop_id, name, list_distinct(string_split(name, ' ')) AS x FROM i),
s AS (SELECT q.shop_id, name, max({_JACCARD}) AS best FROM q JOIN (SELECT shop_id, list_distinct(string_split(normalized_name, ' ')) AS y FROM catalog) c USING (shop_id) GROUP BY 1, 2)
SELECT document_id, count(*) FILTER (round_even(best, 1) >= 70)::BIGINT AS matched, count(*)::BIGINT AS total FROM i JOIN s USING (shop_id, name) GROUP BY 1"""


@query(_MATCHED)
def match_documents(spark, sf_dir):
    return matching.match_items(_items(spark, sf_dir), A.catalog(spark, sf_dir), "jaccard")[1]


@query()
def link_items(spark, sf_dir):
    return matching.link_items(_items(spark, sf_dir), A.catalog(spark, sf_dir)).select("document_id", "item_no", "name", F.col("inventory_match.id").alias("match_id"), F.col("inventory_match.score").alias("score"))


_APPROVED = f"""WITH {A.DOCUMENTS}, {A.INVOICES}, {A.CATALOG}, i AS (SELECT document_id, document_id % 7 AS shop_id, {A.sql_normalize("p_name || ' ' || p_size || 'mg'")} AS name FROM items JOIN part ON description = 'part ' || p_partkey),
q AS (SELECT DISTINCT shop_id, name, list_distinct(string_split(name, ' ')) AS x FROM i),
s AS (SELECT q.shop_id, name, max({_JACCARD}) AS best FROM q JOIN (SELECT shop_id, list_distinct(string_split(normalized_name, ' ')) AS y FROM catalog) c USING (shop_id) GROUP BY 1, 2),
n AS (SELECT document_id, count(*) FILTER (best >= 70)::BIGINT AS linked FROM i JOIN s USING (shop_id, name) GROUP BY 1)
SELECT id, CASE status WHEN 'needs_review' THEN 'approved' ELSE status END AS status, CASE WHEN status = 'needs_review' THEN nullif(linked, 0) END AS inventory_linked FROM docs LEFT JOIN n ON id = document_id"""


@query(_APPROVED)
def approved_documents(spark, sf_dir):
    """All documents are to be approved; those under review are, and their items are linked to the catalog."""
    d = A.documents(spark, sf_dir)
    review = d.filter("status = 'needs_review'").select(F.col("id").alias("document_id"))
    links = matching.link_items(_items(spark, sf_dir).join(review, "document_id", "left_semi"), A.catalog(spark, sf_dir), scorer="jaccard")
    return lifecycle.approve(d, d.select("id"), links)[0].select("id", "status", "inventory_linked")


@query(f"WITH {A.DOCUMENTS} SELECT id, 'state ' || status AS reason FROM docs WHERE status <> 'needs_review'")
def refused_approvals(spark, sf_dir):
    d = A.documents(spark, sf_dir)
    return lifecycle.approve(d, d.select("id"))[1]


# ---- exports


@query(_FLAT + """ SELECT document_id, 'csv' AS extension, 'Stock Item;Batch;Expiry;Quantity;Rate;Amount' || chr(13) || chr(10) || string_agg(description || ';' || batch_no || ';' || expiry || ';' || quantity || ';' || rate || ';' || amount || chr(13) || chr(10), '' ORDER BY item_no) AS content FROM flat GROUP BY document_id
UNION ALL SELECT document_id, 'csv', 'Stock Item;Batch;Expiry;Quantity;Rate;Amount' || chr(13) || chr(10) FROM heads WHERE document_id NOT IN (SELECT document_id FROM items)""")
def export_csv(spark, sf_dir):
    return export.render(A.invoices(spark, sf_dir), "invoice", {"format": "csv", "profile": "tally", "delimiter": ";"})


def _sql_json_fields() -> str:
    return ", ".join(f"""'  "{h}" : "' || {f} || '"'""" for h, f in nested.PROFILES["generic"]["invoice"].items())


@query(_FLAT + f""" SELECT document_id, 'json' AS extension, '[ {{' || chr(10) || string_agg(concat_ws(',' || chr(10), {_sql_json_fields()}), chr(10) || '}}, {{' || chr(10) ORDER BY item_no) || chr(10) || '}} ]' AS content FROM flat GROUP BY document_id
UNION ALL SELECT document_id, 'json', '[]' FROM heads WHERE document_id NOT IN (SELECT document_id FROM items)""")
def export_json(spark, sf_dir):
    return export.render(A.invoices(spark, sf_dir), "invoice", {"format": "json"})


_BOTH = _FLAT + f""", files AS (SELECT document_id || '.csv' AS name, {{csv}} AS content FROM flat GROUP BY document_id UNION ALL SELECT document_id || '.json', {{json}} FROM flat GROUP BY document_id
UNION ALL SELECT document_id || '.csv', {{top}} FROM heads WHERE document_id NOT IN (SELECT document_id FROM items) UNION ALL SELECT document_id || '.json', '[]' FROM heads WHERE document_id NOT IN (SELECT document_id FROM items))
SELECT name, octet_length(encode(content))::BIGINT AS bytes, sha256(content) AS sha256 FROM files"""


def _sql_both() -> str:
    heads = {"Stock Item": "description", "Batch": "batch_no", "Expiry": "expiry", "Quantity": "quantity", "Rate": "rate", "Amount": "amount"}
    top = f"'{';'.join(heads)}' || chr(13) || chr(10)"
    csv = f"{top} || string_agg({' || chr(59) || '.join(heads.values())} || chr(13) || chr(10), '' ORDER BY item_no)"
    fields = ", ".join(f"""'  "{h}" : "' || {f} || '"'""" for h, f in heads.items())
    json = f"""'[ {{' || chr(10) || string_agg(concat_ws(',' || chr(10), {fields}), chr(10) || '}}, {{' || chr(10) ORDER BY item_no) || chr(10) || '}} ]'"""
    return _BOTH.format(top=top, csv=csv, json=json)


@query(_sql_both())
def exported_files(spark, sf_dir):
    """Files by document, both formats, written twice and read back."""
    rendered, path = export.render(A.invoices(spark, sf_dir), "invoice", {"format": "both", "profile": "tally", "delimiter": ";"}), folder(spark, "exports")
    for _ in range(2):
        export.write_named_files(rendered, path)
    return read_named(spark, path).select("name", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: The voucher as its readers want it; @LF@ is a line feed.
_VOUCHER = "@LF@".join([
    "<ENVELOPE>", "  <HEADER><TALLYREQUEST>Import Data</TALLYREQUEST></HEADER>", "  <BODY><IMPORTDATA>", "    <REQUESTDESC><REPORTNAME>Vouchers</REPORTNAME></REQUESTDESC>", "    <REQUESTDATA>",
    "      <TALLYMESSAGE>", '        <VOUCHER VCHTYPE="Purchase" ACTION="Create">', "          <PARTYLEDGERNAME>@PARTY@</PARTYLEDGERNAME>", "          <VOUCHERTYPENAME>Purchase</VOUCHERTYPENAME>",
    "          <REFERENCE>@NO@</REFERENCE>", "          <PURCHASELEDGER>Purchase</PURCHASELEDGER>", "@ENTRIES@", "        </VOUCHER>", "      </TALLYMESSAGE>", "    </REQUESTDATA>", "  </IMPORTDATA></BODY>", "</ENVELOPE>",
])
_SQL_ENTRY = "'      <ALLINVENTORYENTRIES.LIST>' || " + " || ".join(f"chr(10) || '        <{t}>' || {v} || '</{t}>'" for t, v in {"STOCKITEMNAME": "description", "ACTUALQTY": "quantity", "BILLEDQTY": "quantity", "RATE": "'0'", "AMOUNT": "amount"}.items()) + " || chr(10) || '      </ALLINVENTORYENTRIES.LIST>'"


@query(f"""WITH {A.INVOICES}, lists AS (SELECT document_id, string_agg({_SQL_ENTRY}, chr(10) ORDER BY item_no) AS entries FROM items GROUP BY document_id)
SELECT document_id, 'xml' AS extension, replace(replace(replace(replace('@TEXT@', '@LF@', chr(10)), '@PARTY@', supplier), '@NO@', invoice_no), '@ENTRIES@', coalesce(entries, '')) AS content FROM heads LEFT JOIN lists USING (document_id)""".replace("@TEXT@", _VOUCHER))
def export_xml(spark, sf_dir):
    return export.render(A.invoices(spark, sf_dir), "invoice", {"format": "tally_xml"})


# ---- streams


@query("""SELECT user_id AS device, count(*)::BIGINT AS events, max(ts) AS latest FROM events GROUP BY user_id""")
def stream_counts(spark, sf_dir):
    """The stream over the whole events table, once, gives what a batch gives."""
    schema = A.table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    counts = s.groupBy(F.col("user_id").alias("device")).agg(F.count("*").alias("events"), F.max("ts").alias("latest"))
    return _drained(spark, counts, "complete")


@query("""SELECT user_id AS device, count(*) FILTER (event_type <> 'purchase')::BIGINT AS pending FROM events GROUP BY user_id""")
def queue_pending(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("queued")
    return queue.pending_count(A.table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), status.alias("status")))


# An item is what its last event after its first enqueueing made of it; its attempts are the errors since its last retry.
@query(f"""WITH e AS (SELECT user_id AS device, event_id % 50 AS id, event_type AS said, epoch_ms(ts) AS at_ms FROM events),
clock AS (SELECT device, max(at_ms) AS now FROM e GROUP BY device),
born AS (SELECT device, id, min(at_ms) AS created FROM e WHERE said IN ('signup', 'view') GROUP BY ALL),
later AS (SELECT device, id, created, said, at_ms, max(at_ms) FILTER (said = 'click') OVER (PARTITION BY device, id) AS retried FROM e JOIN born USING (device, id) WHERE at_ms >= created AND said NOT IN ('signup', 'view')),
fate AS (SELECT device, id, arg_max(said, at_ms) AS last, count(*) FILTER (said = 'error' AND at_ms > coalesce(retried, 0)) AS attempts FROM later GROUP BY ALL),
items AS (SELECT device, id, created, coalesce(last, 'click') AS last, coalesce(attempts, 0) AS attempts, coalesce(last, 'click') <> 'purchase' OR now - created < {queue.TTL_MS} AS kept FROM born LEFT JOIN fate USING (device, id) JOIN clock USING (device))
SELECT device, count(id) FILTER (kept AND last <> 'purchase')::BIGINT AS pending, arg_min(id, created * 64 + id) FILTER (kept AND (last = 'click' OR last = 'error' AND attempts < {queue.MAX_ATTEMPTS})) AS next_id,
  count(id) FILTER (NOT kept)::BIGINT AS dropped FROM clock LEFT JOIN items USING (device) GROUP BY device""")
def stream_queue(spark, sf_dir):
    schema = A.table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    action = F.create_map(*[F.lit(x) for pair in {"signup": "enqueue", "view": "enqueue", "click": "retry", "error": "error", "purchase": "done"}.items() for x in pair])[F.col("event_type")]
    e = s.select(F.col("user_id").alias("device"), (F.col("event_id") % 50).alias("id"), action.alias("action"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return _drained(spark, queue.fold(e), "update")


def _drained(spark, stream, mode: str):
    """What a stream over the files there are leaves in a table in the shared folder."""
    path = folder(spark, "stream")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _lines(kind: str, text: str) -> dict:
    """A provider for the query below: an item a line."""
    return {"line_items": [{"description": {"value": line, "confidence": 1.0}} for line in text.split("\n")]}


@query("""WITH p AS (SELECT conv_id, count(*)::INT + (conv_id % 10 = 3)::INT AS pages, count(*) AS came, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id)
SELECT conv_id::VARCHAR AS document_id, CASE WHEN pages = came THEN 'needs_review' ELSE 'failed' END AS status, CASE WHEN pages <> came THEN came || ' of ' || pages || ' pages came' END AS error,
CASE WHEN pages = came THEN len(string_split(text, chr(10))) END::INT AS item_count, CASE WHEN pages = came THEN md5(text) END AS items FROM p""")
def stream_ingest(spark, sf_dir):
    """Turns as pages in eight files, three a batch; one document of ten lacks a page. The stream stops, and ends the timers when it goes on."""
    c = A.table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    n = c.groupBy("conv_id").agg((F.count("*") + (F.col("conv_id") % 10 == 3).cast("int")).cast("int").alias("pages"), F.min("turn").alias("first"))
    day = F.lit("2024-01-01 00:00:00").cast("timestamp")
    page = c.join(n, "conv_id").select(F.col("conv_id").cast("string").alias("document_id"), F.lit("invoice").alias("doc_type"), (F.col("turn") - F.col("first")).cast("int").alias("page"), "pages", "text", day.alias("at"))
    path, out, state = (folder(spark, x) for x in ("uploads", "taken-in", "state"))
    page.repartition(8, "page", "document_id").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 3).parquet(path)
    intake.take_in(stream, _lines, "invoice", out, state, 60_000).awaitTermination()
    later = spark.createDataFrame([("", "invoice", 0, 2, "", "2024-01-02 00:00:00")], "document_id string, doc_type string, page int, pages int, text string, at string")
    later.withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(path)
    intake.take_in(stream, _lines, "invoice", out, state, 60_000).awaitTermination()
    items = F.when(F.col("status") == "needs_review", F.md5(F.array_join(F.transform("line_items", lambda x: F.coalesce(x["description"]["value"], F.lit(""))), "\n")))
    return intake.results(spark, out).filter("document_id <> ''").select("document_id", "status", "error", "item_count", items.alias("items"))


@query("""SELECT event_id AS id, user_id || ':' || event_type AS idempotency_key, 1::BIGINT AS times, TRUE AS acknowledged FROM events
WHERE event_type <> 'error' AND value < 5""")
def stream_feed(spark, sf_dir):
    """Pending deliveries as a feed of pages of about 500; two polls, the second after the feed has grown."""
    due = A.deliveries(spark, sf_dir).filter("status = 'pending'").select("id", "idempotency_key")
    pages = max(2, due.count() // 500)
    page = due.groupBy(F.pmod(F.xxhash64("id"), F.lit(pages)).alias("k")).agg(F.to_json(F.collect_list(F.struct("id", "idempotency_key"))).alias("content"))
    every = spark.range(pages).withColumnRenamed("id", "k").join(page, "k", "left").select(F.concat(F.col("k").cast("string"), F.lit(".json")).alias("name"), F.coalesce("content", F.lit("[]")).alias("content"))
    url, out, state = (folder(spark, x) for x in ("feed", "taken-in", "state"))
    write_named(every, url)
    for n in (pages // 2, pages):
        write_named(spark.createDataFrame([("latest.json", f'{{"pages": {n}}}')], "name string, content string"), url)
        taken = feed.poll(spark, url, out, state, feed.FolderFeed)
    told = spark.read.schema("pages long").json(f"{url}/acknowledged.json").first()["pages"]
    each = taken.select("page", F.from_json("item", "id long, idempotency_key string").alias("d")).groupBy("d.id", "d.idempotency_key").agg(F.count("*").alias("times"), F.max("page").alias("page"))
    return each.select("id", "idempotency_key", "times", (F.col("page") < told).alias("acknowledged"))


@query(f"""WITH {A.DOCUMENTS}, mid AS (SELECT created_at, id FROM docs WHERE shop_id = 7 ORDER BY created_at DESC, id DESC LIMIT 1 OFFSET (SELECT count(*) // 2 FROM docs WHERE shop_id = 7))
SELECT id, status, created_at::DATE::VARCHAR AS created FROM docs WHERE shop_id = 7 AND (created_at, id) < (SELECT (created_at, id) FROM mid) ORDER BY docs.created_at DESC, id DESC LIMIT 50""")
def documents_page_by_key(spark, sf_dir):
    """The page after the row in the middle of a shop's documents."""
    d, path = A.documents(spark, sf_dir), folder(spark, "paged")
    paging.write_clustered(d, path, "shop_id", "created_at", "id", 5_000)
    mine = d.filter("shop_id = 7")
    last = mine.select("created_at", "id").orderBy(F.desc("created_at"), F.desc("id")).offset(mine.count() // 2).limit(1).first()
    after = (last["created_at"], last["id"]) if last else None
    return paging.page_after(spark, path, "shop_id", 7, "created_at", "id", after, 50).select("id", "status", F.col("created_at").cast("date").cast("string").alias("created"))


# ---- updates in place, substrings by an index, effects once


@query(f"WITH {A.DELIVERIES} SELECT id, CASE WHEN id % 997 = 0 THEN 'success' ELSE status END AS status FROM deliveries")
def acknowledged_in_buckets(spark, sf_dir):
    """Few acknowledgements rewrite the few buckets that they touch."""
    d, path = A.deliveries(spark, sf_dir), folder(spark, "deliveries")
    buckets.write_bucketed(d, path, "id")
    for name in ("first", "first", "again"):
        buckets.update(spark, path, d.filter("id % 997 = 0").select("id"), lifecycle.acknowledge, name)
    return buckets.read_bucketed(spark, path).select("id", "status")


@query(f"""WITH {A.DOCUMENTS}, c AS (SELECT id, error, CASE WHEN hit THEN 'needs_review' ELSE status END AS status, CASE WHEN hit THEN 'corrected' ELSE 'read' END AS data
  FROM (SELECT *, id % 401 = 0 AND status IN ('needs_review', 'approved', 'pushed') AS hit FROM docs)),
a AS (SELECT id, error, data, CASE WHEN id % 403 = 0 AND status = 'needs_review' THEN 'approved' ELSE status END AS status FROM c)
SELECT id, data, CASE WHEN id % 409 = 0 AND status IN ('failed', 'needs_review') THEN 'queued' ELSE status END AS status, CASE WHEN NOT (id % 409 = 0 AND status IN ('failed', 'needs_review')) THEN error END AS error FROM a""")
def documents_in_buckets(spark, sf_dir):
    """Corrections, approvals and retries of few documents, one after the other."""
    d, path = A.documents(spark, sf_dir).withColumn("data", F.lit("read")), folder(spark, "documents")
    buckets.write_bucketed(d, path, "id")
    some = lambda n, *more: d.filter(F.col("id") % n == 0).select("id", *more)
    buckets.update(spark, path, some(401, F.lit("corrected").alias("data")), lambda old, new: lifecycle.correct(old, new)[0], "corrections")
    buckets.update(spark, path, some(403), lambda old, asked: lifecycle.approve(old, asked)[0], "approvals")
    buckets.update(spark, path, some(409), lambda old, _: lifecycle.retry(old, F.col("id") % 409 == 0), "retries")
    return buckets.read_bucketed(spark, path).select("id", "status", "data", "error")


def _indexed(spark, sf_dir) -> str:
    path = folder(spark, "names")
    grams.build(A.catalog(spark, sf_dir).select("id", "shop_id", "name", "normalized_name", "mrp"), path, "normalized_name", "shop_id", "id")
    return path


@query(ORACLES["catalog_search"])
def catalog_search_indexed(spark, sf_dir):
    q = spark.range(1).select(N.normalize(F.lit("Ring Tab"))).first()[0]
    hits = grams.search(spark, _indexed(spark, sf_dir), "normalized_name", q)
    return hits.select("id", "name", "normalized_name", "mrp").orderBy("name", "id").limit(100)


@query(f"""WITH {A.CATALOG}, w AS (SELECT DISTINCT unnest(string_split(normalized_name, ' ')) AS w FROM catalog), a AS (SELECT DISTINCT unnest([w, left(w, 1), right(w, 2), substr(w, 2, 4), w || w]) AS q FROM w)
SELECT q, shop_id, count(*)::BIGINT AS hits, min(id) AS first_id FROM a JOIN catalog ON contains(normalized_name, q) GROUP BY q, shop_id""")
def catalog_search_all(spark, sf_dir):
    """Words of names, parts of them and what is in no name, all against all names."""
    w = A.catalog(spark, sf_dir).select(F.explode(F.split("normalized_name", " ")).alias("w")).distinct()
    asked = w.select(F.explode(F.array("w", F.left("w", F.lit(1)), F.right("w", F.lit(2)), F.substring("w", 2, 4), F.concat("w", "w"))).alias("q")).distinct()
    hits = grams.search_all(spark, _indexed(spark, sf_dir), "normalized_name", asked)
    return hits.groupBy("q", "shop_id").agg(F.count("*").alias("hits"), F.min("id").alias("first_id"))


@query("""SELECT user_id || ':' || event_type AS idempotency_key, user_id::VARCHAR AS document_id, 1::BIGINT AS sent, 1::BIGINT AS audited FROM events WHERE event_type <> 'error' AND value < 5 GROUP BY user_id, event_type""")
def stream_effects(spark, sf_dir):
    """Pending deliveries in six files, two a batch, keys in several of them; the stream breaks before an acknowledgement and goes on."""
    due = A.deliveries(spark, sf_dir).filter("status = 'pending'").select(F.col("document_id").cast("string").alias("document_id"), F.lit("{}").alias("body"), "idempotency_key", "id")
    came, path, state = (folder(spark, x) for x in ("payloads", "effects", "state"))
    due.repartition(6, "id").write.parquet(came)
    broken = []

    def acknowledge(rows) -> None:
        if not broken:
            broken.append(True)
            raise ConnectionError("cut off")

    for _ in range(2):
        stream = spark.readStream.schema(due.schema).option("maxFilesPerTrigger", 2).parquet(came)
        q = ledger.deliver(stream, sinks.enqueue_for_agent, path, state, acknowledge)
        try:
            q.awaitTermination()
        except StreamingQueryException as e:
            if "cut off" not in str(e):
                raise
    n = ledger.audit_rows(spark, path).groupBy("idempotency_key").agg(F.count("*").alias("audited"))
    return ledger.sent_rows(spark, path).groupBy("idempotency_key", "document_id").agg(F.count("*").alias("sent")).join(n, "idempotency_key")
