import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import names as N
from docloom.functions import scores as S
from docloom.functions import values as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("name", "normal", "molecule"), [
    ("Paracetamol 500mg Tab", "paracetamol 500mg", "paracetamol"), ("AMOXICILLIN CAPSULE", "amoxicillin", "amoxicillin"), ("Calpol 500", "calpol 500", "calpol"),
    ("500 mg", "500", ""), ("Tab Cap", "tab cap", "tab cap"), (None, "", ""), ("", "", ""),
])
def test_names(spark, name, normal, molecule):
    assert one(spark, name, N.normalize) == normal
    assert one(spark, name, N.base_molecule) == molecule


def test_molecule_prefers_composition(spark):
    df = spark.createDataFrame([("Paracetamol IP", "Calpol 500"), ("", "Calpol 500"), (None, "Calpol 500")], "c string, n string")
    assert [r[0] for r in df.select(N.molecule_of(F.col("c"), F.col("n"))).collect()] == ["paracetamol ip", "calpol", "calpol"]


@pytest.mark.parametrize(("said", "expected"), [("2.5 strips", 2.5), ("qty: 30 nos", 30.0), ("1,750", 1.0), ("-4", -4.0), ("none", None), (None, None)])
def test_quantity(spark, said, expected):
    assert one(spark, said, V.quantity) == expected


@pytest.mark.parametrize(("said", "expected"), [("5ml", (5.0, "ml")), ("Tab 500 MG twice", (500.0, "mg")), ("0.5%", (0.5, "%")), ("ten mg", None), (None, None)])
def test_strength(spark, said, expected):
    got = one(spark, said, V.strength)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(("said", "expected"), [
    ("27/07/2026", "2026-07-27"), ("2026-07-05", "2026-07-05"), ("12/2027", "2027-12-01"), ("exp 05-MAR-2024", "2024-03-05"), ("1.2.2024", "2024-02-01"), ("99/99/2024", None), ("soon", None), (None, None),
])
def test_date(spark, said, expected):
    got = one(spark, said, V.date)
    assert got == (datetime.date.fromisoformat(expected) if expected else None)


@pytest.mark.parametrize(("cell", "expected"), [("1,750.25", "1750.25"), ("abc", None), (None, None), ("-3 nos", "-3")])
def test_plain_number(spark, cell, expected):
    assert one(spark, cell, V.plain_number) == expected


@pytest.mark.parametrize(("said", "expected"), [("1,250.50", 1250.5), (" 7 ", 7.0), ("1.5d", None), ("x", None), ("", None), (None, None)])
def test_to_float(spark, said, expected):
    assert one(spark, said, V.to_float) == expected


def test_buckets_differ_only_at_their_edges(spark):
    df = spark.createDataFrame([(None,), (0.59,), (0.6,), (0.7,), (0.85,), (0.9,)], "c double")
    got = [tuple(r) for r in df.select(V.bucket_at_least(F.col("c")), V.bucket_above(F.col("c")), V.confidence_percent(F.col("c"))).collect()]
    assert got == [("none", "none", None), ("low", "low", 59), ("medium", "low", 60), ("medium", "medium", 70), ("high", "medium", 85), ("high", "high", 90)]


def test_signing():
    s = V.sign("k", "body")
    assert V.verify("k", "body", s) and not V.verify("k", "other", s) and not V.verify("k", "body", None)


def test_transient_and_types(spark):
    df = spark.createDataFrame([(429, "", "a.pdf", "Tax invoice"), (None, "model overloaded", "b.PNG", "Rx"), (400, "bad request", "c", None)], "code int, m string, n string, t string")
    got = [tuple(r) for r in df.select(V.is_transient(F.col("code"), F.col("m")), V.content_type(F.col("n")), V.doc_type_of(F.col("t"))).collect()]
    assert got == [(True, "application/pdf", "invoice"), (True, "image/png", "prescription"), (False, "image/jpeg", "prescription")]


def test_token_set():
    assert S.token_set("paracetamol 500", "paracetamol 500mg") == pytest.approx(93.75)
    assert S.token_set("a b", "b a c") == 100.0 and S.token_set("", "a") == 0.0
    assert S.common_subsequence("abcbdab", "bdcaba") == 4


def test_jaccard(spark):
    df = spark.createDataFrame([("a b", "b c"), ("", "a"), ("a a", "a")], "x string, y string")
    assert [round(r[0], 3) for r in df.select(S.jaccard(F.col("x"), F.col("y"))).collect()] == [33.333, 0.0, 100.0]


@pytest.mark.parametrize(
    ("said", "expected"),
    [
        ("5th March 2024", "2024-03-05"), ("March 5, 2024", "2024-03-05"), ("the 21st of Sept, 2023, 10:30 pm", "2023-09-21"), ("Tuesday 05 MARCH 2024 9.15 a.m.", "2024-03-05"),
        ("2024 august 1", "2024-08-01"), ("12 Dec 24", "2024-12-12"), ("December 2025", "2025-12-01"), ("31 February 2024", None), ("March 24", None), ("5 2024", None), ("ma 5 2024", None),
        ("7 June, 2021 to 9 July 2022", "2021-06-07"), ("batch 99999 1 jan 2020", "2020-01-01"), (None, None), ("", None),
    ],
)
def test_dates_in_words(spark, said, expected):
    got = one(spark, said, V.date)
    assert got == (datetime.date.fromisoformat(expected) if expected else None)


def test_a_date_is_read_once_and_as_by_its_forms_in_turn(spark):
    said = ["45 Jan 2024", "x5-6-24", "5/6/2024 and 2023-01-02", "1900-2-29", "0000-1-1", "2024-1-", "24-5-6", "--2024-5-6", "5.6.24", "", "\n", "March 2024", "dt. Sep-07", "5-Xyz-2024", "2024"]
    want = ["2024-01-01", "2024-06-05", "2023-01-02", None, "0000-01-01", None, None, None, None, None, None, "2024-03-01", "2007-09-01", None, None]
    df = spark.createDataFrame(list(enumerate(said)), "k int, t string").select("k", V.date(F.upper("t")).cast("string").alias("d"))
    assert [r["d"] for r in df.orderBy("k").collect()] == want
    # What it is read from is named twice at most, not once a form.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("upper(") <= 2
