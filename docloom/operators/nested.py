"""Nested extraction records: schemas, flat rows, column profiles, the field walk, flags and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V

LEAF = T.StructType([T.StructField("value", T.StringType()), T.StructField("confidence", T.DoubleType())])


def _leaves(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, LEAF) for n in names])


PRESCRIPTION = T.StructType([
    T.StructField("patient", _leaves("name", "age", "gender")),
    T.StructField("prescriber", _leaves("name", "registration_no")),
    T.StructField("medications", T.ArrayType(_leaves("name", "strength", "form", "frequency", "duration", "instructions"))),
])
INVOICE = T.StructType([
    T.StructField("supplier", _leaves("name", "gstin", "address")),
    T.StructField("invoice", _leaves("invoice_no", "invoice_date", "total_amount")),
    T.StructField("line_items", T.ArrayType(_leaves("description", "batch_no", "expiry", "quantity", "mrp", "rate", "amount", "hsn", "gst_percent"))),
])
SCHEMAS = {"prescription": PRESCRIPTION, "invoice": INVOICE}
LISTS = {"prescription": "medications", "invoice": "line_items"}


def _said(leaf: Column) -> Column:
    return F.coalesce(leaf["value"], F.lit(""))


#: What of the header is repeated on each flat row, and under which name.
_HEADERS = {
    "invoice": [("supplier", "supplier", "name"), ("invoice_no", "invoice", "invoice_no"), ("invoice_date", "invoice", "invoice_date")],
    "prescription": [("patient", "patient", "name"), ("prescriber", "prescriber", "name")],
}
_ITEMS = {
    "invoice": [(n, n) for n in ("description", "batch_no", "expiry", "quantity", "mrp", "rate", "amount", "hsn", "gst_percent")],
    "prescription": [("medication", "name"), *((n, n) for n in ("strength", "form", "frequency", "duration", "instructions"))],
}
#: The shorter rows that polling agents write.
_AGENT_LEAVES_OUT = {"invoice": {"invoice_no", "invoice_date"}, "prescription": {"prescriber", "form", "instructions"}}


def flatten_rows(docs: DataFrame, doc_type: str, agent: bool = False) -> DataFrame:
    """(document_id, data) -> a row an item, header values repeated, nulls as empty strings; item_no is its place. No items, no rows."""
    kind = "invoice" if doc_type == "invoice" else "prescription"
    drop = _AGENT_LEAVES_OUT[kind] if agent else set()
    one = docs.select("document_id", "data", F.posexplode(F.col(f"data.{LISTS[kind]}")).alias("item_no", "item"))
    head = [_said(F.col(f"data.{a}.{b}")).alias(n) for n, a, b in _HEADERS[kind] if n not in drop]
    rest = [_said(F.col(f"item.{f}")).alias(n) for n, f in _ITEMS[kind] if n not in drop]
    return one.select("document_id", "item_no", *head, *rest)


def item_rows(doc_type: str) -> Column:
    """The items of ``data`` as an array; none is an empty one."""
    return F.coalesce(F.col(f"data.{LISTS['invoice' if doc_type == 'invoice' else 'prescription']}"), F.array())


def flat_row(item: Column, doc_type: str) -> dict[str, Column]:
    """An item's fields as ``flatten_rows`` gives them, by name, within the document's row."""
    kind = "invoice" if doc_type == "invoice" else "prescription"
    return {n: _said(F.col(f"data.{a}.{b}")) for n, a, b in _HEADERS[kind]} | {n: _said(item[f]) for n, f in _ITEMS[kind]}


#: Headers that import screens of common programs expect, by field.
PROFILES = {
    "generic": {
        "invoice": {"Supplier": "supplier", "Invoice No": "invoice_no", "Item": "description", "Batch": "batch_no", "Expiry": "expiry", "Qty": "quantity", "MRP": "mrp", "Rate": "rate", "Amount": "amount", "HSN": "hsn", "GST%": "gst_percent"},
        "prescription": {"Patient": "patient", "Doctor": "prescriber", "Medicine": "medication", "Strength": "strength", "Frequency": "frequency", "Duration": "duration"},
    },
    "marg": {"invoice": {"ItemName": "description", "Batch": "batch_no", "Exp": "expiry", "Qty": "quantity", "MRP": "mrp", "PRate": "rate", "Amount": "amount", "HSN": "hsn", "GST": "gst_percent"}},
    "vyapar": {"invoice": {"Item Name": "description", "Batch Number": "batch_no", "Expiry Date": "expiry", "Quantity": "quantity", "MRP": "mrp", "Purchase Price": "rate", "Amount": "amount", "HSN": "hsn", "GST %": "gst_percent"}},
    "tally": {"invoice": {"Stock Item": "description", "Batch": "batch_no", "Expiry": "expiry", "Quantity": "quantity", "Rate": "rate", "Amount": "amount"}},
}


def profile_columns(doc_type: str, profile: str | None = None, columns: dict[str, str] | None = None) -> dict[str, str]:
    """Header -> field: the given columns, else the profile's, else the generic ones."""
    generic = PROFILES["generic"]
    named = PROFILES.get((profile or "generic").lower(), generic)
    return columns or named.get(doc_type) or generic.get(doc_type, {})


def project(rows: DataFrame, columns: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat rows under a profile's headers; a field that the rows lack is empty."""
    have = set(rows.columns)
    return rows.select(*keep, *[(F.col(f) if f in have else F.lit("")).alias(h) for h, f in columns.items()])


def walk(docs: DataFrame, schema: T.StructType) -> DataFrame:
    """(document_id, data) -> document_id, position, path, value, confidence: every leaf, in order of the schema; lists give ``a[i].b``."""
    parts = []  # arrays of leaves, so that a document is read once

    def leaf(k, i, j, path, node):
        order = F.struct(F.lit(k).alias("a"), i.alias("i"), F.lit(j).alias("j"))
        return F.struct(order.alias("position"), path.alias("path"), node["value"].alias("value"), node["confidence"].alias("confidence"))

    def items(k, top, names):
        path = lambda i, n: F.concat(F.lit(f"{top}["), i.cast("string"), F.lit(f"].{n}"))
        return lambda x, i: F.array(*[leaf(k, i, j, path(i, n), x[n]) for j, n in enumerate(names)])

    for k, top in enumerate(schema.fields):
        base = F.col(f"data.{top.name}")
        if isinstance(top.dataType, T.ArrayType):
            names = [f.name for f in top.dataType.elementType.fields]
            parts.append(F.flatten(F.transform(F.coalesce(base, F.array()), items(k, top.name, names))))
        else:
            parts.append(F.array(*[leaf(k, F.lit(0), j, F.lit(f"{top.name}.{f.name}"), base[f.name]) for j, f in enumerate(top.dataType.fields)]))
    return docs.select("document_id", F.inline(F.concat(*parts)))


def is_low(value: Column, confidence: Column, threshold: float = 0.6) -> Column:
    return F.coalesce((value != "") & (confidence < threshold), F.lit(False))


def low_confidence(fields: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Walked fields -> document_id, low_confidence: the paths under the threshold, in order."""
    low = fields.filter(is_low(F.col("value"), F.col("confidence"), threshold))
    return low.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("position", "path"))).alias("p")).select("document_id", F.col("p.path").alias("low_confidence"))


def overall_confidence(fields: DataFrame, places: int = 3) -> DataFrame:
    """Mean confidence of filled leaves, half-even; null if none is filled. Exact decimals, so the order of leaves doesn't matter."""
    filled = F.when((F.coalesce(F.col("value"), F.lit("")) != ""), F.col("confidence").cast("decimal(10,6)"))
    return fields.groupBy("document_id").agg(F.bround(F.avg(filled).cast("double"), places).alias("overall_confidence"))


def needs_attention(fields: Column, best_score: Column, connected: Column, threshold: float = 0.6) -> Column:
    """An item: any of its leaves (an array) is low, or a catalog is connected and the best match is under 70."""
    return F.exists(fields, lambda x: is_low(x["value"], x["confidence"], threshold)) | (connected & (F.coalesce(best_score, F.lit(0.0)) < 70))


_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def get_path(data: Column, path: str) -> Column:
    """``a.b[0].c``; out of range or missing is null."""
    for name, index in _STEP.findall(path):
        data = data[name] if name else F.get(data, int(index))
    return data


def set_path(data: Column, path: str, value: Column) -> Column:
    """A copy with the leaf's value replaced and its confidence kept; an index out of range changes nothing."""

    def put(node: Column, steps: list[tuple[str, str]]) -> Column:
        if not steps:
            return F.struct(value.alias("value"), node["confidence"].alias("confidence"))
        (name, index), rest = steps[0], steps[1:]
        if name:
            return node.withField(name, put(node[name], rest))
        return F.transform(node, lambda x, i: F.when(i == int(index), put(x, rest)).otherwise(x))

    return put(data, _STEP.findall(path))


def postprocess(data: Column, doc_type: str) -> Column:
    """Adds typed companions to leaves: norm_strength, norm_num, norm_date."""

    def plus(row: Column, field: str, name: str, f) -> Column:
        return row.withField(field, F.when(row[field].isNotNull(), row[field].withField(name, f(row[field]["value"]))))

    if doc_type == "prescription":
        rows = F.transform(data["medications"], lambda m: plus(plus(m, "strength", "norm_strength", V.strength), "duration", "norm_num", V.quantity))
        return data.withField("medications", rows)
    rows = F.transform(data["line_items"], lambda m: plus(plus(m, "expiry", "norm_date", V.date), "quantity", "norm_num", V.quantity))
    return data.withField("invoice", plus(data["invoice"], "invoice_date", "norm_date", V.date)).withField("line_items", rows)


def push_payload(docs: DataFrame) -> DataFrame:
    """(id, shop_id, doc_type, overall_confidence, schema_version, data, meta) -> document_id, payload (the delivered envelope)."""
    return docs.select(F.col("id").alias("document_id"), F.struct(F.lit("1.0").alias("payload_version"), F.lit("document.approved").alias("event"), F.col("id").alias("document_id"), "shop_id", "doc_type", "overall_confidence", "schema_version", "data", "meta").alias("payload"))


#: What review screens show, section by section, with its labels; then each list element's six fields.
HEAD_SECTIONS = {
    "invoice": {"supplier": ("supplier", {"name": "Supplier", "gstin": "GSTIN"}), "invoiceDetails": ("invoice", {"invoice_no": "Invoice no", "invoice_date": "Date", "total_amount": "Total"})},
    "prescription": {"patient": ("patient", {"name": "Name", "age": "Age", "gender": "Gender"}), "prescriber": ("prescriber", {"name": "Doctor", "registration_no": "Reg. no"})},
}
ITEM_SECTIONS = {
    "invoice": ("lineItems", {"description": "Item", "batch_no": "Batch", "expiry": "Expiry", "quantity": "Qty", "mrp": "MRP", "rate": "Rate"}),
    "prescription": ("medications", {"name": "Medicine", "strength": "Strength", "form": "Form", "frequency": "Frequency", "duration": "Duration", "instructions": "Instructions"}),
}


def _shown(node: Column, labels: dict[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(label).alias("label"), node[n]["value"].alias("value"), node[n]["confidence"].alias("confidence")) for n, label in labels.items()])


def sections(docs: DataFrame, doc_type: str) -> DataFrame:
    """(document_id, data) -> document_id, section (from 1, in order), title, fields (label, value, confidence), item_no for list elements."""
    kind = "invoice" if doc_type == "invoice" else "prescription"
    none = F.lit(None).cast("int")
    heads = [F.struct(F.lit(title).alias("title"), none.alias("item_no"), _shown(F.col(f"data.{group}"), labels).alias("fields")) for title, (group, labels) in HEAD_SECTIONS[kind].items()]
    title, labels = ITEM_SECTIONS[kind]
    items = F.transform(F.coalesce(F.col(f"data.{LISTS[kind]}"), F.array()), lambda x, i: F.struct(F.concat(F.lit(f"{title} #"), (i + 1).cast("string")).alias("title"), i.alias("item_no"), _shown(x, labels).alias("fields")))
    return docs.select("document_id", F.posexplode(F.concat(F.array(*heads), items)).alias("i", "s")).select("document_id", (F.col("i") + 1).alias("section"), "s.title", "s.item_no", "s.fields")


def item_fields(item: Column, doc_type: str) -> Column:
    """The shown leaves (label, value, confidence) of one list element."""
    return _shown(item, ITEM_SECTIONS["invoice" if doc_type == "invoice" else "prescription"][1])


def item_summary(fields: Column, sep: str = "  ·  ") -> Column:
    """The first three filled values after the first field, with their labels, joined."""
    filled = F.filter(F.slice(fields, 2, 100), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    return F.array_join(F.transform(F.slice(filled, 1, 3), lambda x: F.concat(x["label"], F.lit(": "), x["value"])), sep)


def mask_secret(connectors: DataFrame) -> DataFrame:
    """``secret_ref`` gives way to whether there is one."""
    return connectors.withColumn("has_secret", F.coalesce(F.col("secret_ref") != "", F.lit(False))).drop("secret_ref")
