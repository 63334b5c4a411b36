"""JSON whose schema nobody knows, walked leaf by leaf as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def _step(path: Column, key: Column, place: Column) -> Column:
    """A path and what comes next: ``a.b``, ``a[0]``; a key that isn't letters, digits, - and _ is quoted."""
    name = F.when(key.rlike("^[A-Za-z0-9_-]+$"), key).otherwise(F.concat(F.lit('"'), F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    under = F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))
    return F.when(key.isNull(), F.concat(path, F.lit("["), place.cast("string"), F.lit("]"))).otherwise(under)


def _kind(value: Column) -> Column:
    of = F.schema_of_variant(value)
    kinds = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    found = F.lit("number")
    for start, kind in kinds.items():
        found = F.when(of.startswith(start), kind).otherwise(found)
    return found


#: Levels that are walked in one step.
LEVELS = 12


def _depth(json: Column) -> Column:
    """How deep a JSON text's brackets are nested, outside of its strings."""
    unquoted = F.regexp_replace(F.regexp_replace(json, r"\\[\s\S]", ""), '"[^"]*"', "")
    brackets = F.split(F.regexp_replace(unquoted, r"[^\[\]{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, b: Column) -> Column:
        now = acc["now"] + F.when(b.isin("{", "["), 1).when(b.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(brackets, start, step, lambda acc: acc["most"])


def leaves(rows: DataFrame, json: str, through: list[str]) -> DataFrame:
    """(json text, ...) -> the columns ``through``, path, depth, kind and value: every scalar and every empty object or list.

    One reading of the texts says how many levels the deepest has; then that many narrow steps run as one over the rows,
    without a shuffle, and nothing is written. Only beyond ``LEVELS`` levels rows are cut from their lineage. ``value`` is
    text (null for null; ``{}`` or ``[]`` for what is empty), ``kind`` is object, array, string, number, boolean or null.

    A text that isn't JSON, or has a key twice in one object, gives one row of kind ``invalid``, without path and value; a
    null text gives none; rows that repeat are walked each. Columns of ``through`` may have any names.
    """
    spark = rows.sparkSession
    own = F.struct(*[F.col(f"`{c}`") for c in through]).alias("own")
    texts = rows.filter(F.col(f"`{json}`").isNotNull())
    here = texts.select(own, F.lit("").alias("path"), F.lit(0).alias("depth"), F.try_parse_json(F.col(f"`{json}`")).alias("node"))
    # A text that isn't JSON has no levels, however many brackets.
    levels = texts.agg(F.max(F.when(F.try_parse_json(F.col(f"`{json}`")).isNotNull(), _depth(F.col(f"`{json}`"))))).first()[0] or 0
    for level in range(levels):
        if level and level % LEVELS == 0:
            here = cut(here)
        # A scalar and an empty object or list have no parts: they come out as they are, without a place.
        parts, inner = here.lateralJoin(spark.tvf.variant_explode_outer(F.col("node").outer())), F.col("pos").isNotNull()
        here = parts.select(
            "own", F.when(inner, _step(F.col("path"), F.col("key"), F.col("pos"))).otherwise(F.col("path")).alias("path"),
            (F.col("depth") + inner.cast("int")).alias("depth"), F.when(inner, F.col("value")).otherwise(F.col("node")).alias("node"),
        )
    invalid, kind = F.col("node").isNull(), _kind(F.col("node"))
    text = F.when(kind.isin("object", "array"), F.to_json("node")).otherwise(F.col("node").cast("string"))
    return here.select("own.*", F.when(~invalid, F.col("path")).alias("path"), "depth", F.when(invalid, "invalid").otherwise(kind).alias("kind"), text.alias("value"))


#: Levels of a record that are walked as rows; what is deeper is walked within its row.
WIDE = 4

_FOUND, _OPEN = "array<struct<path:string,value:string,confidence:double>>", "array<struct<path:string,node:variant>>"


def _has_parts(node: Column) -> Column:
    """Whether it is an object, or a list that isn't empty."""
    return F.try_variant_get(node, "$", "struct<_:int>").isNotNull() | F.try_variant_get(node, "$[0]", "variant").isNotNull()


def _is_scored(node: Column) -> Column:
    """Whether its value is a scalar and its confidence a number."""
    value, sure = (F.schema_of_variant(F.try_variant_get(node, f"$.{name}", "variant")) for name in ("value", "confidence"))
    listed = lambda kind: kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.coalesce(~listed(value) & ~listed(sure) & ~sure.isin("STRING", "BOOLEAN", "VOID"), F.lit(False))


#: The schema of an object with both and scalars besides, if any, under plain names (others are quoted). Names come in order.
_LEAF = r"^OBJECT<([^<`]*, )?confidence: (BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\)), ([^<`]*, )?value: [^<`]*>$"


def _scored_within(path: Column, node: Column) -> Column:
    """The scored objects of a node, itself included, level by level down to its last: for the few nodes that are deep."""

    def parts(n: Column) -> Column:
        fields = F.map_entries(F.try_variant_get(n["node"], "$", "map<string,variant>"))
        items = F.try_variant_get(n["node"], "$", "array<variant>")
        of = F.transform(fields, lambda e: F.struct(_step(n["path"], e["key"], F.lit(None)).alias("path"), e["value"].alias("node")))
        return F.coalesce(of, F.transform(items, lambda x, i: F.struct(_step(n["path"], F.lit(None).cast("string"), i).alias("path"), x.alias("node"))), F.array().cast(_OPEN))

    def step(acc: Column, _: Column) -> Column:
        hit = lambda n: _is_scored(n["node"])
        said = lambda n: F.struct(n["path"].alias("path"), F.try_variant_get(n["node"], "$.value", "string").alias("value"), F.try_variant_get(n["node"], "$.confidence", "double").alias("confidence"))
        under = F.filter(F.flatten(F.transform(acc["open"], parts)), lambda n: _has_parts(n["node"]))
        return F.struct(F.concat(acc["found"], F.transform(F.filter(acc["open"], hit), said)).alias("found"), under.alias("open"))

    start = F.struct(F.array().cast(_FOUND).alias("found"), F.array(F.struct(path.alias("path"), node.alias("node"))).alias("open"))
    return F.aggregate(F.sequence(F.lit(1), _depth(F.to_json(node))), start, step, lambda acc: acc["found"])


def scored_objects(rows: DataFrame, json: str, through: list[str]) -> DataFrame:
    """(json text, ...) -> as ``scored`` of ``leaves``, but rows are walked each by itself: one narrow step, nothing is shuffled, written or read twice.

    Objects and lists are taken apart as rows for ``WIDE`` levels; an object that has a value and a confidence stays one row, and
    so does one that has more levels besides, or is deeper: what is in it comes out at the end. Rows that repeat are walked each.
    """
    spark = rows.sparkSession
    own = F.struct(*[F.col(f"`{c}`") for c in through]).alias("own")
    # What a row is: "open", or "done" (as _LEAF; it has no node), or "late" (scored, with parts that may have parts).
    here = rows.select(own, F.lit("").alias("path"), F.try_parse_json(F.col(f"`{json}`")).alias("node"))
    here = _marked(here.select("own", "path", "node", F.lit(True).alias("new"), F.lit("open").alias("is"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("sure")))
    for _ in range(WIDE):
        parts = here.lateralJoin(spark.tvf.variant_explode_outer(F.when(F.col("is") == "open", F.col("node")).outer()))
        new = F.col("pos").isNotNull()
        parts = parts.filter(F.when(new, _has_parts(F.col("value"))).otherwise(F.col("is") != "open"))
        here = _marked(parts.select("own", F.when(new, _step(F.col("path"), F.col("key"), F.col("pos"))).otherwise(F.col("path")).alias("path"), F.when(new, F.col("value")).otherwise(F.col("node")).alias("node"), new.alias("new"), "is", "text", "sure"))
    one = F.array(F.struct("path", F.col("text").alias("value"), F.col("sure").alias("confidence")))
    return here.select("own", F.inline(F.when(F.col("is") == "done", one).otherwise(_scored_within(F.col("path"), F.col("node"))))).select("own.*", "path", "value", "confidence")


def _marked(nodes: DataFrame) -> DataFrame:
    """(own, path, node, new, is, text, sure) -> the same without new: new nodes are looked at, as little as will do."""
    new, done = F.col("new"), F.col("is") == "done"
    nodes = nodes.select("own", "path", "node", "new", "is", "text", F.when(new, F.try_variant_get("node", "$.confidence", "double")).otherwise(F.col("sure")).alias("sure"))
    # What is no number may be read as one, but a number is.
    looked = F.when(F.schema_of_variant("node").rlike(_LEAF), "done").when(_is_scored(F.col("node")), "late").otherwise("open")
    nodes = nodes.select("own", "path", "node", "new", "text", "sure", F.when(~new, F.col("is")).when(F.col("sure").isNull(), "open").otherwise(looked).alias("is"))
    text = F.when(new & done, F.try_variant_get("node", "$.value", "string")).otherwise(F.col("text"))
    return nodes.select("own", "path", F.when(~done, F.col("node")).alias("node"), "is", text.alias("text"), "sure")


def scored(leaves: DataFrame, through: list[str]) -> DataFrame:
    """Of ``leaves``, objects that have both a ``value`` and a numeric ``confidence``: the columns ``through``, path, value, confidence.

    The path is that of the object. A value may be null; one that is an object or list itself is none. The two are
    brought together by (``through``, path), which therefore must tell documents apart.
    """
    part = F.regexp_extract("path", r"(?:^|\.)(value|confidence)$", 1)
    ends = leaves.withColumn("_part", part).filter("_part <> '' AND kind NOT IN ('object', 'array')")
    ends = ends.filter((F.col("_part") == "value") | (F.col("kind") == "number")).withColumn("path", F.regexp_replace("path", r"\.?(value|confidence)$", ""))
    of = lambda name: F.max(F.when(F.col("_part") == name, F.col("value")))
    both = ends.groupBy(*[F.col(f"`{c}`") for c in through], "path").agg(of("value").alias("value"), of("confidence").cast("double").alias("confidence"), F.countDistinct("_part").alias("_parts"))
    return both.filter("_parts = 2").drop("_parts")
