import csv
import io
import json
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from docloom.operators import chunks, export, lifecycle, matching, nested, tables
from docloom.operators.tenancy import TenantScope, search_catalog


def leaf(v, c=0.9):
    return (v, c)


def invoice(spark):
    item = lambda d, b=None, q="2", c=0.9: (leaf(d, c), leaf(b), leaf("12/2027"), leaf(q), leaf("1"), leaf(None, None), leaf("9"), leaf(None), leaf("12"))
    data = ((leaf("A & B <Co>"), leaf(None), leaf(None)), (leaf("INV-1"), leaf("27/07/2026"), leaf("18", 0.5)), [item("Calpol, \"500\"", "B1"), item("Crocin", c=0.4)])
    none = ((leaf(None), leaf(None), leaf(None)), (leaf(None), leaf(None), leaf(None)), [])
    return spark.createDataFrame([("d1", data), ("d2", none)], nested_schema())


def nested_schema():
    from pyspark.sql import types as T

    return T.StructType([T.StructField("document_id", T.StringType()), T.StructField("data", nested.INVOICE)])


def test_csv_reads_back(spark):
    got = {r["document_id"]: r["content"] for r in export.render(invoice(spark), "invoice", {"profile": "vyapar"}).collect()}
    rows = list(csv.reader(io.StringIO(got["d1"])))
    assert rows[0][:2] == ["Item Name", "Batch Number"] and rows[1][0] == 'Calpol, "500"' and len(rows) == 3
    assert len(list(csv.reader(io.StringIO(got["d2"])))) == 1


def test_csv_without_header_and_unknown_format(spark):
    got = export.render(invoice(spark), "invoice", {"format": "pdf", "delimiter": "|", "include_header": False, "columns": {"X": "description", "Y": "nowhere"}})
    assert {r["document_id"]: r["content"] for r in got.collect()} == {"d1": '"Calpol, ""500"""|\r\nCrocin|\r\n', "d2": ""}


def test_json_and_both(spark):
    got = {(r["document_id"], r["extension"]): r["content"] for r in export.render(invoice(spark), "invoice", {"format": "both"}).collect()}
    assert len(got) == 4 and json.loads(got["d2", "json"]) == []
    assert [r["Item"] for r in json.loads(got["d1", "json"])] == ['Calpol, "500"', "Crocin"]


def test_xml_reads_back(spark):
    got = {r["document_id"]: r["content"] for r in export.render(invoice(spark), "invoice", {"format": "tally_xml", "tally": {"purchase_ledger": "Own"}}).collect()}
    x = ET.fromstring(got["d1"])
    assert x.find(".//PARTYLEDGERNAME").text == "A & B <Co>" and x.find(".//PURCHASELEDGER").text == "Own"
    assert [e.text for e in x.iter("RATE")] == ["0", "0"] and ET.fromstring(got["d2"]).find(".//PARTYLEDGERNAME").text == "Sundry Creditor"


def test_files(spark, tmp_path):
    out = tmp_path / "out"
    d = invoice(spark)
    export.write_files(export.render(d.filter("document_id = 'd1'"), "invoice", {"format": "json"}), str(out))
    export.write_files(export.render(d.filter("document_id = 'd2'"), "invoice", {"format": "json"}), str(out))
    for _ in range(2):
        f = list((out / "document_id=d1" / "extension=json").glob("part-*"))
        assert len(f) == 1 and len(json.loads(f[0].read_text())) == 2 and (out / "document_id=d2").exists()
        export.write_files(export.render(d.filter("document_id = 'd1'"), "invoice", {"format": "json"}), str(out))


def test_walk_flags_and_paths(spark):
    d = invoice(spark)
    w = nested.walk(d, nested.INVOICE)
    assert w.filter("document_id = 'd1'").count() == 6 + 18
    assert [tuple(r) for r in nested.low_confidence(w).collect()] == [("d1", ["invoice.total_amount", "line_items[1].description"])]
    assert {r[0]: r[1] for r in nested.overall_confidence(w).collect()}["d2"] is None
    new = d.withColumn("data", nested.set_path(F.col("data"), "line_items[1].description", F.lit("Dolo")))
    assert [tuple(r) for r in new.select(nested.get_path(F.col("data"), "line_items[1].description.value"), nested.get_path(F.col("data"), "line_items[9].description.value")).collect()] == [("Dolo", None), (None, None)]
    s = nested.sections(d.filter("document_id = 'd1'"), "invoice").select("section", "title", "item_no", nested.item_summary(F.col("fields"))).collect()
    assert [tuple(r) for r in s] == [(1, "supplier", None, ""), (2, "invoiceDetails", None, "Date: 27/07/2026  ·  Total: 18"), (3, "lineItems #1", 0, "Batch: B1  ·  Expiry: 12/2027  ·  Qty: 2"), (4, "lineItems #2", 1, "Expiry: 12/2027  ·  Qty: 2  ·  MRP: 1")]


def test_prescriptions(spark):
    from pyspark.sql import types as T

    med = (leaf("Dolo"), leaf("650 mg"), leaf(None), leaf("1-0-1"), leaf("5 days"), leaf("after food", 0.5))
    data = ((leaf("Asha"), leaf(None), leaf(None)), (leaf("Dr X"), leaf("77", 0.4)), [med])
    d = spark.createDataFrame([("p", data)], T.StructType([T.StructField("document_id", T.StringType()), T.StructField("data", nested.PRESCRIPTION)]))
    assert nested.flatten_rows(d, "other").first()["prescriber"] == "Dr X"
    assert "prescriber" not in nested.flatten_rows(d, "prescription", agent=True).columns
    m = d.select(nested.postprocess(F.col("data"), "prescription").alias("x")).first()["x"]["medications"][0]
    assert m["strength"]["norm_strength"] == (650.0, "mg") and m["duration"]["norm_num"] == 5.0
    assert nested.low_confidence(nested.walk(d, nested.PRESCRIPTION)).first()[1] == ["prescriber.registration_no", "medications[0].instructions"]
    assert nested.profile_columns("prescription", "marg") == nested.PROFILES["generic"]["prescription"]


HEADER = ["Sr", "HSN Code", "Product Name", "Mfg", "Batch No.", "Exp. Date", "Free Qty", "Qty.", "MRP", "P.Rate", "Disc %", "Taxable Amt", "CGST %", "SGST %", "CGST Amt", "SGST Amt", "Net Amount"]


def test_tables(spark):
    rows = [["", "Tax Invoice"], HEADER, ["1", "3004", "Calpol  500\nTab", "GSK", "B1", "12/27", "1", "10 nos", "1,020.50", "15", "2", "150", "6", "6.0", "9", "9", "168"], ["", "", "GRAND TOTAL", "", "x", "", "", "10"], ["2", "3004", "X", "", "B", "", "", "1"], ["3", "3004", "No numbers"], []]
    t = spark.createDataFrame([("d", 1, 1, rows), ("d", 1, 2, [["a", None], ["b", "c"]]), ("d", 1, 3, [])], "document_id string, page int, table int, rows array<array<string>>")
    got = tables.line_items(t).collect()
    assert len(got) == 1
    assert got[0].asDict() | {"document_id": 0} == {"document_id": 0, "page": 1, "table": 1, "item_no": 0, "description": "Calpol 500 Tab", "batch_no": "B1", "expiry": "12/27", "hsn": "3004", "quantity": "10", "mrp": "1020.50", "rate": "15", "amount": "150", "gst_percent": "12.0"}


def test_header_text(spark):
    df = spark.createDataFrame([("x\nGood PHARMA Ltd - TAX INVOICE\nInvoice No: A/1 Dt. 01.02.2024\nGSTIN: 27ABCDE1234F1Z5",), (None,)], "t string")
    a, b = [r[0] for r in df.select(tables.header_text(F.col("t"))).collect()]
    assert tuple(a) == ("Good PHARMA Ltd", "27ABCDE1234F1Z5", "A/1", "01.02.2024") and set(b) == {None}


def test_header_text_in_other_forms(spark):
    texts = ["Invoice No5", "INVOICE     NO: 77", "gstin 27abcde1234f1z5", "Invoice No X9 dt01.02.2024", "Invoice No: -A1\nDt. 01.02.2024", "GSTIN 27ABCDE, GSTIN:- 27ABCDE1234F1Z5 GSTIN 27ABCDE1234F1Z6", "a\x0bMy Agencies\x0cb"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tables.header_text(F.col("t"))).collect()]
    assert got == [
        (None, None, "5", None), (None, None, "77", None), (None, "27abcde1234f1z5", None, None), (None, None, "X9", "01.02.2024"),
        (None, None, "-A1", None), (None, "27ABCDE1234F1Z6", None, None), ("My Agencies", None, None, None),
    ]


def test_signature_is_the_hmac(spark):
    from docloom.functions import values as V

    df = spark.createDataFrame([("",), ("body é",), (None,)], "b string")
    for secret in ("", "s", "k" * 64, "k" * 65 + "é"):
        got = [r[0] for r in df.select(V.signature(F.col("b"), secret)).collect()]
        assert got == [V.sign(secret, ""), V.sign(secret, "body é"), None]


CATALOG = "id string, shop_id string, sku string, name string, normalized_name string, composition string, strength string, mrp double, stock_qty double"


def catalog(spark):
    from docloom.functions.names import normalize

    rows = [("c1", "s", "1", "Calpol 500", "Paracetamol", 5.0), ("c2", "s", "2", "Crocin 500 Tab", "Paracetamol", 9.0), ("c3", "s", "3", "Azithral 250", "Azithromycin", None), ("c4", "t", "4", "Calpol 500", None, 1.0)]
    return spark.createDataFrame([(i, s, k, n, "", c, None, 1.0, q) for i, s, k, n, c, q in rows], CATALOG).withColumn("normalized_name", normalize(F.col("name")))


def test_matching(spark):
    c = catalog(spark)
    q = spark.createDataFrame([(1, "s", "CALPOL 500mg"), (2, "s", ""), (3, "u", "Calpol"), (4, "s", None)], "query_id int, shop_id string, name string")
    got = [tuple(r) for r in matching.match_names(q, c).orderBy("query_id", "rank").collect()]
    assert got[0][:3] == (1, 1, "c1") and got[0][3] >= 80 and {g[0] for g in got} == {1}
    alt = matching.alternatives_for(q, c).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in alt] == [(1, "c2"), (1, "c1")]
    assert matching.match_names(q, c.limit(0)).count() == 0
    items = spark.createDataFrame([("d", 0, "s", "Calpol 500"), ("d", 1, "s", "Zzz")], "document_id string, item_no int, shop_id string, name string")
    assert [r["inventory_match"] and r["inventory_match"]["id"] for r in matching.link_items(items, c).orderBy("item_no").collect()] == ["c1", None]
    each, total = matching.match_items(items, c)
    assert tuple(total.first()) == ("d", 1, 2) and each.filter("best_score = 0").count() == 1


def test_tenants(spark):
    c = catalog(spark)
    assert [r["id"] for r in TenantScope("s").search_catalog(c, "").collect()] == ["c3", "c1", "c2"]
    assert [r["id"] for r in search_catalog(c, "CROCIN").collect()] == ["c2"]
    assert tuple(TenantScope("zz").count(c).first()) == (0, False) and TenantScope("t").one(c, "id", "c1").count() == 0


def test_transitions(spark):
    m = spark.createDataFrame([("queued", "processing"), ("queued", "pushed"), ("failed", "queued"), ("pushed", "pushed"), ("nowhere", "queued"), (None, "queued")], "current string, target string")
    good, bad = lifecycle.split_transitions(m)
    assert good.count() == 3 and bad.count() == 3
    d = spark.createDataFrame([(1, "needs_review", "x"), (2, "pushed", "y")], "id int, status string, error string")
    assert [tuple(r) for r in lifecycle.retry(d, F.lit(True)).orderBy("id").collect()] == [(1, "queued", None), (2, "pushed", "y")]


def test_all_ok_of_nothing(spark):
    d = spark.createDataFrame([(1, "success"), (1, "pending"), (2, "failed"), (3, None)], "document_id int, status string")
    assert {r[0]: r[1] for r in lifecycle.all_ok(d).collect()} == {1: True, 2: False, 3: False}


def test_corrections_and_approval(spark):
    d = spark.createDataFrame([(1, "approved", "a"), (2, "needs_review", "b"), (3, "queued", "c"), (4, None, "d"), (None, "approved", "e")], "id int, status string, data string")
    new, refused = lifecycle.correct(d, spark.createDataFrame([(1, "c"), (1, "b"), (2, None), (3, "x"), (4, "x"), (9, "x"), (None, "x")], "id int, data string"))
    assert {tuple(r) for r in new.select("id", "status", "data").collect()} == {(1, "needs_review", "c"), (2, "needs_review", "b"), (3, "queued", "c"), (4, None, "d"), (None, "approved", "e")}
    assert dict(map(tuple, refused.collect())) == {2: "no valid data", 3: "state queued", 4: "state unknown", 9: "not found"}
    links = spark.createDataFrame([(1, ("c1",)), (1, ("c2",)), (1, None), (2, None), (3, ("c1",))], "document_id int, inventory_match struct<id:string>")
    ok, refused = lifecycle.approve(new, spark.createDataFrame([(1,), (1,), (2,), (3,), (9,)], "id int"), links)
    assert {tuple(r) for r in ok.select("id", "status", "inventory_linked").collect()} == {(1, "approved", 2), (2, "approved", None), (3, "queued", None), (4, None, None), (None, "approved", None)}
    assert dict(map(tuple, refused.collect())) == {3: "state queued", 9: "not found"}
    assert lifecycle.approve(new, new.select("id"))[0].filter("status = 'approved'").count() == 3


def test_corrected_data_gets_its_companions(spark):
    d = invoice(spark).withColumnRenamed("document_id", "id").withColumn("status", F.lit("pushed"))
    new = d.filter("id = 'd1'").withColumn("data", nested.set_path(F.col("data"), "line_items[0].quantity", F.lit("7 nos"))).select("id", "data")
    out, refused = lifecycle.correct(d, new, "invoice")
    got = {r["id"]: r for r in out.collect()}
    assert got["d1"]["data"]["line_items"][0]["quantity"]["norm_num"] == 7.0 and got["d1"]["status"] == "needs_review" and got["d2"]["status"] == "pushed" and refused.count() == 0


def test_push_needs_approval_and_a_connector(spark):
    d = spark.createDataFrame([(1, "s", "approved"), (2, "t", "pushed"), (3, "u", "approved"), (4, "s", "queued"), (5, None, "approved"), (6, "s", None)], "id int, shop_id string, status string")
    c = spark.createDataFrame([("s", True), ("s", True), ("t", False)], "shop_id string, enabled boolean")
    ready, refused = lifecycle.pushable(d, c)
    assert [r["id"] for r in ready.collect()] == [1]
    assert dict(map(tuple, refused.collect())) == {2: "no connector", 3: "no connector", 4: "state queued", 5: "no connector", 6: "state unknown"}


def test_csv_files_keep_their_bytes(spark, tmp_path):
    out = tmp_path / "out"
    r = export.render(invoice(spark), "invoice", {"format": "both"})
    export.write_files(r, str(out))
    want = {(x["document_id"], x["extension"]): x["content"] for x in r.collect()}
    for (doc, ext), content in want.items():
        f = list((out / f"document_id={doc}" / f"extension={ext}").glob("part-*"))
        assert len(f) == 1 and f[0].read_bytes().decode() == content + ("" if ext == "csv" else "\n")


def test_merge_keeps_first_value_else_last(spark):
    schema = "document_id int, chunk int, fields struct<supplier:struct<name:struct<value:string,confidence:double>>,line_items:array<string>>, failed int"
    rows = [(1, 2, ((("late", 0.9),), ["c"]), 1), (1, 0, ((("", 0.1),), ["a"]), None), (1, 1, ((("first", 0.8),), None), 0), (2, 0, ((("", 0.1),), []), 0), (2, 1, (((None, 0.2),), []), 0)]
    got = {r["document_id"]: r for r in chunks.merge(spark.createDataFrame(rows, schema), "line_items", {"supplier": ["name"]}).collect()}
    assert got[1]["supplier"]["name"]["value"] == "first" and got[1]["line_items"] == ["a", "c"] and got[1]["pages_failed"] == 1
    assert got[2]["supplier"]["name"]["confidence"] == 0.2 and got[2]["item_count"] == 0


def test_catalog_write_replaces_its_shops_only(spark, tmp_path):
    path, c = str(tmp_path / "catalog"), catalog(spark)
    export.write_catalog(c, path)
    export.write_catalog(c.filter("id = 'c1'"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["c1", "c4"]
    export.write_catalog(c.filter("id = 'c1'"), path, replace=False)
    assert spark.read.parquet(path).count() == 3
    assert export.delete_catalog(spark, path, "s") and not export.delete_catalog(spark, path, "s")
    assert [r["id"] for r in spark.read.parquet(path).collect()] == ["c4"]


def test_options(spark):
    got = export.options(spark).collect()
    assert [r["value"] for r in got if r["option"] == "format"] == ["csv", "json", "tally_xml", "both"]
    assert {r["value"] for r in got if r["option"] == "profile"} == set(nested.PROFILES)


def test_a_rows_words_stay_in_their_cells(spark):
    """A header is found by cells, not by what neighbouring cells say together; blanks and dots within a cell don't count."""
    t = spark.createDataFrame([(1, [["ba", "tch", "qty"], ["B a.tch", None, "Pro duct", "Q.ty"]]), (2, [["batch"], ["qty"]]), (3, [])], "k int, rows array<array<string>>")
    assert {r["k"]: r["h"] for r in t.select("k", tables.header_row(F.col("rows")).alias("h")).collect()} == {1: 1, 2: None, 3: None}


def test_columns_are_chosen_once_a_table(spark):
    """The fold over the fields stood in the plan once for each field."""
    t = spark.createDataFrame([("d", 1, 1, [["Product", "Batch", "Qty"], ["Pen", "b", "2"]])], "document_id string, page int, table int, rows array<array<string>>")
    items = tables.line_items(t)
    assert items._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2  # and the shares of GST
    assert [(r["description"], r["quantity"]) for r in items.collect()] == [("Pen", "2")]


def test_names_that_repeat_are_matched_once(spark, monkeypatch):
    """Every item was a query of its own, its candidates gathered by item."""
    asked = []
    monkeypatch.setattr(matching, "match_names", lambda q, *a, f=matching.match_names, **b: asked.append(q.count()) or f(q, *a, **b))
    c = spark.createDataFrame([(1, "s", "K", "Pen Red", "pen red", "1", 1.0, None, 2.0)], "id int, shop_id string, sku string, name string, normalized_name string, strength string, mrp double, composition string, stock_qty double")
    rows = [("d", 0, "s", "Pen Red"), ("d", 1, "s", "pen red Tab"), ("e", 0, "s", "zzz"), ("e", 1, None, "Pen Red"), ("e", 2, "s", None)]
    items = spark.createDataFrame(rows, "document_id string, item_no int, shop_id string, name string")
    each, total = matching.match_items(items, c, "jaccard")
    assert {(r[0], r[1]): (r["best_score"], r["candidates"] and r["candidates"][0]["id"]) for r in each.collect()} == {("d", 0): (100.0, 1), ("d", 1): (100.0, 1), ("e", 0): (0.0, None), ("e", 1): (0.0, None), ("e", 2): (0.0, None)}
    assert {tuple(r) for r in total.collect()} == {("d", 2, 2), ("e", 0, 3)} and asked == [4]
    linked = matching.link_items(items, c, scorer="jaccard")
    assert linked.columns == ["document_id", "item_no", "shop_id", "name", "inventory_match"] and linked.filter("inventory_match IS NOT NULL").count() == 2
