import pytest

from docloom.functions.scores import token_set
from docloom.operators import matching

CATALOG = [
    (1, 1, "Para 500 Tab", "para 500", "paracetamol", 3.0), (2, 1, "Para 500 Tab", "para 500", "paracetamol", 9.0), (3, 1, "Dolo", "dolo", "paracetamol", None),
    (4, 1, "Zinc Oxide", "zinc oxide", None, 1.0), (5, 1, "Zinc", "zinc", "", 1.0), (6, 2, "Para 500", "para 500", "paracetamol", 7.0), (7, 1, "123", "123", None, 2.0),
]
QUERIES = [(10, 1, "para 500"), (11, 1, "para 500"), (12, 1, "Para 500 tab"), (13, 2, "para 500"), (14, 1, None), (15, None, "para 500"), (16, 1, "zinc oxide"), (17, 3, "zinc"), (None, 1, "zinc oxide"), (18, 1, ""), (19, 1, "zinc"), (19, 1, "dolo")]
MOLECULES = {1: "paracetamol", 2: "paracetamol", 3: "paracetamol", 4: "zinc oxide", 5: "zinc", 6: "paracetamol", 7: ""}
ASKED = {"para 500": "paracetamol", "Para 500 tab": "paracetamol", "zinc oxide": "zinc oxide", "zinc": "zinc", "dolo": "paracetamol"}


def expected(limit):
    out = []
    for query_id, shop, name in QUERIES:
        molecule = ASKED.get(name, "")
        hits = [(-round(s, 1), -(stock or 0.0), i) for i, at, _, _, _, stock in CATALOG if at == shop and molecule.split(" ")[0] in MOLECULES[i].split(" ") and (s := token_set(molecule, MOLECULES[i])) >= 75]
        out += [(query_id, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(hits)[:limit], 1)]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.fixture
def tables(spark):
    c = spark.createDataFrame(CATALOG, "id long, shop_id int, name string, normalized_name string, composition string, stock_qty double")
    return spark.createDataFrame(QUERIES, "query_id long, shop_id int, name string"), c


@pytest.mark.parametrize("names", [0, 50_000])
@pytest.mark.parametrize("limit", [1, 2, 5])
def test_rows_fare_by_their_names(tables, monkeypatch, limit, names):
    """Rows of one id, or of none, are rows as others; found names are broadcast or shuffled."""
    monkeypatch.setattr(matching, "NAMES", names)
    got = matching.alternatives_for(*tables, limit).collect()
    assert ordered((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == ordered(expected(limit))


def test_a_name_is_matched_once(tables, monkeypatch):
    seen, match = [], matching.match_names
    monkeypatch.setattr(matching, "match_names", lambda queries, *a, **k: seen.append(queries.count()) or match(queries, *a, **k))
    queries, catalog = tables
    many = queries.union(queries).union(queries.filter("query_id = 10"))
    assert len(matching.alternatives_for(many, catalog).collect()) > 2 * len(QUERIES)
    assert seen == [len({(s, n) for _, s, n in QUERIES})]
