"""Quality rules: lines first, then the document by what is left of it.

A line with a word fails if it is
* navigation: three or more separators (``|``, ``»``, ``>``, a bullet) between short entries;
* badly punctuated: signs of ``#*$%&|<>{}[]=~^_\\`` are over a tenth of its characters, or it repeats ``!!`` or ``??`` three times or more;
* boilerplate: a licence, rights, cookie or script notice makes up the line, which has 240 characters at most; a
  long line that mentions one is prose.
Failing lines are removed. A document that keeps less than half of its word characters, or none at all, is rejected, as
is one that fails the base rules (under 10 words, or over 20 % of its words in 5-word windows found twice or more in it).

All of it is arithmetic inside one row, with no shuffle. Windows are compared by a 64-bit hash of their five words;
only documents with an equal pair of hashes pay for the exact cover, by sorting (hash, position).

Edge cases: a null text has no words and fails; an empty table gives an empty one; the columns of the input other
than doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, table

#: RE2 and Java read these alike.
NAVIGATION = r"([|»•>][^|»•>]{1,40}){3}"
SHOUTS = r"(?s)(!!|\?\?).*(!!|\?\?).*(!!|\?\?)"
BOILERPLATE = r"(?i)(licensed under|released under the|all rights reserved|public license, version|accept (all )?cookies|cookie policy|enable javascript|terms of (use|service)|privacy policy|creative commons)"
SIGNS = r"[^#*$%&|<>{}\[\]=~^_\\]+"
BASE_SIGNS = r"[^#*$%&|<>]+"
SPACE = r"[\x20\x09-\x0D]+"
WINDOW, MIN_WORDS, MAX_REPEATED, MAX_SIGNS, MIN_LEFT, NOTICE = 5, 10, 20, 10, 50, 240


def _length_without(text, pattern):
    return F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line):
    signs = _length_without(line, SIGNS) * 100 > F.length(line) * MAX_SIGNS
    return line.rlike(NAVIGATION) | signs | line.rlike(SHOUTS) | ((F.length(line) <= NOTICE) & line.rlike(BOILERPLATE))


def judged(docs: DataFrame) -> DataFrame:
    """row (a struct of the given columns), q (a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, left_chars, cleaned, base_failed, kept)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    q = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"))
    q = q.select("row", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.split("text", "\n", -1).alias("lines"))
    q = q.select("row", "text", "words", F.filter("lines", lambda x: x.rlike(WORD)).alias("lines"), F.array_join(F.filter("lines", lambda x: ~line_fails(x)), "\n").alias("cleaned"))
    words = F.col("words")
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    q = q.withColumn("grams", F.when(F.size(words) >= WINDOW, grams))
    pairs = F.sort_array(F.transform(F.col("grams"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    q = q.withColumn("pairs", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), pairs))
    at = lambda k: F.get(F.col("pairs"), k)["h"]
    found = F.filter(F.col("pairs"), lambda x, k: F.coalesce(at(k - 1) == x["h"], F.lit(False)) | F.coalesce(at(k + 1) == x["h"], F.lit(False)))
    q = q.withColumn("at", F.sort_array(F.transform(found, lambda x: x["i"])))
    cover = F.transform(F.col("at"), lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), k + 1) - p, F.lit(WINDOW))))
    long = lambda c: c.cast("long")
    q = q.select(
        "row", "cleaned",
        long(F.size("words")).alias("n_words"),
        long(_length_without(F.col("text"), SPACE)).alias("word_chars"),
        long(_length_without(F.col("text"), BASE_SIGNS)).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0))).alias("n_repeat_words"),
        long(_length_without(F.col("cleaned"), SPACE)).alias("left_chars"),
    )
    q = q.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED))
    enough = (F.col("left_chars") > 0) & (F.col("left_chars") * 100 >= F.col("word_chars") * MIN_LEFT)
    q = q.withColumn("kept", ~F.col("base_failed") & enough)
    return q.select("row", F.struct(*[c for c in q.columns if c != "row"]).alias("q"))


def assess(docs: DataFrame) -> DataFrame:
    """The given columns, and those of ``judged``; of two with one name the latter."""
    q = judged(docs)
    new = q.schema["q"].dataType.names
    return q.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in new], "q.*")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op2_quality(spark, sf_dir):
    return assess(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


def oracle(source: str = "documents") -> str:
    w = WORD
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM {source}),
w AS (SELECT *, regexp_extract_all(text, '{w}') AS words, string_split(text, chr(10)) AS lines FROM d),
p AS (SELECT row_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT row_id, i, string_agg(word, ' ') OVER b AS gram, count(*) OVER b AS n FROM p
      WINDOW b AS (PARTITION BY row_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
c AS (SELECT row_id, i, n = 5 AND count(*) OVER (PARTITION BY row_id, gram, n) > 1 AS twice FROM g),
v AS (SELECT row_id, max(twice::INT) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM c),
r AS (SELECT row_id, sum(hit)::BIGINT AS n_repeat_words FROM v GROUP BY row_id),
q AS (SELECT w.*, len(words)::BIGINT AS n_words, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(text, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '{BASE_SIGNS}', '', 'g'))::BIGINT AS n_symbols,
        list_filter(lines, lambda x: regexp_matches(x, '{w}')) AS full_lines,
        array_to_string(list_filter(lines, lambda x: NOT (regexp_matches(x, '{NAVIGATION}') OR regexp_matches(x, '{SHOUTS}') OR (length(x) <= {NOTICE} AND regexp_matches(x, '{BOILERPLATE}'))
          OR length(regexp_replace(x, '{SIGNS}', '', 'g')) * 100 > length(x) * {MAX_SIGNS})), chr(10)) AS cleaned
      FROM w LEFT JOIN r USING (row_id)),
z AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED} AS base_failed,
        (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
        length(regexp_replace(cleaned, '{SPACE}', '', 'g')) AS left_chars FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND left_chars > 0 AND left_chars * 100 >= word_chars * {MIN_LEFT} AS kept FROM z
"""


ORACLE = oracle()
