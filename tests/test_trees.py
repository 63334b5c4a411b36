"""Leaves of JSON without a schema against a recursive walk in Python."""

import json
import random
from collections import Counter

from docloom.operators import trees


def plain(node, path="", depth=0):
    if isinstance(node, dict) and node:
        for k, x in node.items():
            name = k if k and all(c.isascii() and (c.isalnum() or c in "-_") for c in k) else '"' + k.replace("\\", "\\\\").replace('"', '\\"') + '"'
            yield from plain(x, f"{path}.{name}" if path else name, depth + 1)
    elif isinstance(node, list) and node:
        for i, x in enumerate(node):
            yield from plain(x, f"{path}[{i}]", depth + 1)
    else:
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(node), "number")
        yield path, depth, kind, None if node is None else node if isinstance(node, str) else json.dumps(node)


def made(r, depth):
    if depth == 0 or r.random() < 0.3:
        return r.choice([None, True, False, "", "x y", "ü", 0, -7, 12345678901, 2.5, [], {}])
    if r.random() < 0.5:
        return [made(r, depth - 1) for _ in range(r.randrange(4))]
    keys = r.sample(["a", "b-c", "d.e", "f g", 'q"r', "s\\t", "", "ключ", "own", "path", "pos"], r.randrange(5))
    return {k: made(r, depth - 1) for k in keys}


def test_against_a_recursive_walk(spark):
    r = random.Random(4)
    trees_ = [made(r, k % 7) for k in range(200)] + [{}, [], None, "x", {"a": [[[[[1]]]]]}]
    docs = spark.createDataFrame([(k, json.dumps(t, ensure_ascii=False)) for k, t in enumerate(trees_)], "id int, j string")
    got = Counter(tuple(x) for x in trees.leaves(docs, "j", ["id"]).collect())
    assert got == Counter((k, *leaf) for k, t in enumerate(trees_) for leaf in plain(t))


def test_what_is_no_json(spark):
    docs = spark.createDataFrame([(1, None), (2, "{"), (3, '{"a":1,"a":2}'), (4, '{"a":1}'), (4, '{"a":1}'), (5, "")], "`own` int, `path` string")
    rows = sorted((tuple(x) for x in trees.leaves(docs, "path", ["own"]).collect()), key=str)
    assert rows == [(2, None, 0, "invalid", None), (3, None, 0, "invalid", None), (4, "a", 1, "number", "1"), (4, "a", 1, "number", "1"), (5, None, 0, "invalid", None)]
    assert trees.leaves(docs.limit(0), "path", ["own"]).columns == ["own", "path", "depth", "kind", "value"]
    assert trees.leaves(docs.limit(0), "path", ["own"]).isEmpty()


def test_objects_with_value_and_confidence(spark):
    record = {"a": {"value": "x", "confidence": 0.5}, "b": [{"c": {"value": None, "confidence": 1}}, {"c": {"value": "y"}}], "d": {"value": {"e": 1}, "confidence": 1}, "f": {"value": "z", "confidence": "high"}}
    docs = spark.createDataFrame([(1, json.dumps(record)), (2, '{"value":"top","confidence":0.25}'), (3, '{"my_value":1,"my_confidence":2}')], "id int, j string")
    got = {tuple(x) for x in trees.scored(trees.leaves(docs, "j", ["id"]), ["id"]).collect()}
    assert got == {(1, "a", "x", 0.5), (1, "b[0].c", None, 1.0), (2, "", "top", 0.25)}


def test_nothing_is_written_and_deep_texts_are_whole(spark, monkeypatch):
    """Each level was a checkpoint of all its nodes; brackets and quotes within strings are no levels."""
    cuts = []
    monkeypatch.setattr(trees, "cut", lambda df, f=trees.cut: cuts.append(1) or f(df))
    odd = {"a": ["}{[", '\\"[[', {"b": "x\\"}]}
    docs = spark.createDataFrame([(1, json.dumps(odd)), (2, "[[["), (3, '["' + "[" * 30)], "id int, j string")
    got = Counter(tuple(x) for x in trees.leaves(docs.filter("id = 1"), "j", ["id"]).collect())
    assert got == Counter((1, *leaf) for leaf in plain(odd)) and not cuts
    assert {(r["id"], r["kind"]) for r in trees.leaves(docs.filter("id > 1"), "j", ["id"]).collect()} == {(2, "invalid"), (3, "invalid")} and not cuts
    deep = spark.createDataFrame([(1, "[" * 30 + "7" + "]" * 30)], "id int, j string")
    assert [tuple(r) for r in trees.leaves(deep, "j", ["id"]).collect()] == [(1, "[0]" * 30, 30, "number", "7")] and len(cuts) == 2


def test_scored_objects_without_a_shuffle(spark):
    """As value and confidence are in one row, they needn't be brought together; deep, odd and nested ones come out too."""
    leaf = lambda x, c=0.5, **more: {"value": x, "confidence": c, **more}
    deep = leaf("deep")
    for k in range(30):
        deep = {"f g": deep} if k % 3 else [{}, deep, 7]
    records = [
        leaf("top", 1), {"a": leaf(None, 1), "b": [{"c": leaf(7, 1)}, {"c": {"value": "y"}}, [leaf(True, 2.25)]], "d": leaf({"e": 1}), "e": leaf([]), "f": leaf("z", "0.5"), "g": leaf("z", True), "h": leaf("z", None)},
        {"a": leaf("x", 1, more={"b": leaf("in", 0.25, list=[leaf("y")]), "c<d": {}}), "b<": leaf("x", 1, **{"o<<": 1})}, {"a": leaf({"value": 1, "confidence": 0.75})}, deep, {"x": [deep, deep]}, [], {}, 7, None, {"q\"r": {"": {"a.b": leaf("k")}}},
    ]
    r = random.Random(7)

    def some(n):
        if n == 0 or r.random() < 0.2:
            return r.choice([1, "s", None, {}, [], True, 2.5, -1.25e10])
        return [some(n - 1) for _ in range(r.randrange(4))] if r.random() < 0.3 else {k: some(n - 1) for k in r.sample(["value", "confidence", "a", "b c"], r.randrange(5))}

    records += [some(k % 9) for k in range(300)]
    docs = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(records)] + [(-1, None), (-2, "{"), (-3, '{"value":1,"value":2,"confidence":1}')], "path int, own string")
    got = trees.scored_objects(docs, "own", ["path"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    named = docs.toDF("id", "j")
    want = Counter(tuple(x) for x in trees.scored(trees.leaves(named, "j", ["id"]), ["id"]).collect())
    assert Counter(tuple(x) for x in got.collect()) == want and len(want) > 60 and max(p.count("[") for _, p, *_ in want) > 9
